"""Connected components, and similarity links found bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import checkpointed, dropped, released, staged

#: Edges a task takes.
PER_TASK = 500_000
#: Edges at most that the driver links by itself: rounds of jobs over so few take longer.
LOCAL = 50_000
#: Pairs for each row that a bucket may hold to be compared pair by pair.
FEW = 8


def _with_least(pairs: DataFrame, tasks: int) -> DataFrame:
    """(u, v, m): m the least of u and its partners.  The minimum is taken before the shuffle, so a
    hub with very many partners is a small group; the join back is one that Spark can split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m")).coalesce(tasks)


def _mark(edges: DataFrame) -> tuple:
    mark = (F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20))))
    return tuple(edges.agg(*mark).first())


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v): comp is the least node reachable.

    Large and small stars alternate: each round points every node at the least node it sees, and a
    component of diameter d is a star after O(log d) rounds.  ``LOCAL`` edges or less are linked by the driver.  Tasks are as many as the edges need,
    ``PER_TASK`` each, whatever the shuffle's partitions.  Edges are checkpointed in the shared folder
    after each round."""
    edges = checkpointed(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(edges)
    if mark[0] <= LOCAL:
        return _linked_here(edges)
    tasks = max(8, mark[0] // PER_TASK)
    edges = edges.coalesce(tasks)
    for _ in range(most_rounds if mark[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, tasks).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large.distinct().coalesce(tasks), tasks)
        new = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = checkpointed(new.where("u <> v").distinct().coalesce(tasks))
        if (now := _mark(edges)) == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(own)


def _linked_here(edges: DataFrame) -> DataFrame:
    """``components`` of a few edges (u, v), u > v, in the driver."""
    up: dict = {}

    def top(i):
        while (j := up.setdefault(i, i)) != i:
            up[i] = i = up[j]
        return i

    for link in edges.collect():
        a, b = (top(bytes(i) if isinstance(i, bytearray) else i) for i in link)
        up[max(a, b)] = min(a, b)
    schema = StructType([StructField(name, edges.schema["u"].dataType) for name in ("node", "comp")])
    return edges.sparkSession.createDataFrame([(i, top(i)) for i in up], schema)


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``comps`` (node, comp) and those that ``links`` (u, v) between their nodes, or others, add and put together."""
    ends = links
    for i in "uv":
        ends = ends.join(comps.select(F.col("node").alias(i), F.col("comp").alias(f"c{i}")), i, "left")
    new = checkpointed(components(ends.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))))
    to = new.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return comps.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")).unionByName(new.join(comps, "node", "left_anti"))


def by_slices(rows: DataFrame, slices: int, column: str, make: Callable[[DataFrame], DataFrame], name: str = "slice") -> DataFrame:
    """``make`` of ``rows``, ``staged``, in ``slices`` parts that have the values of ``column`` apart and come one after another: what a part
    shuffles is let go before the next, so the disk holds a part of it at a time."""
    out = None
    for i in range(slices):
        part = staged(make(rows.where(F.pmod(F.xxhash64(column), F.lit(slices)) == i) if slices > 1 else rows), name)
        out = part if out is None else out.unionByName(part)
        if slices > 1:
            released(rows.sparkSession)
    return out


def linked(
    buckets: DataFrame,
    near: Callable[[Column, Column], Column],
    verify: Callable[[DataFrame], DataFrame],
    rest: Callable[[DataFrame], DataFrame] | None = None,
    most_rounds: int = 3,
    slices: int = 1,
    small: int = 0,
) -> DataFrame:
    """Components (node, comp) of the verified links between ids that share a bucket (key, id, code).

    ``near`` says of two codes if their ids may be linked at all; it is part of the joins, so what it
    rules out is never a row.

    Every id of a bucket is first compared with a pivot of it; ids already known to be connected
    need no comparison, so a bucket of n alike ids costs n comparisons, not n squared.  The first pivot is
    the id of most weight, a column of ``buckets``, which are a written table then and deleted, or else the id whose buckets hold the
    most rows: what a group was copied from shares most with all others.
    Buckets of at most ``small`` rows, as a column of theirs, held, says, are compared pair by pair at once, and are done.
    Buckets that then hold at most ``FEW`` pairs of unconnected ids for each of their rows are compared pair by pair;
    the others meet further pivots, and what is left of them after ``most_rounds`` is given to ``rest``: it finds the pairs among
    ids (id, comp), all that ``verify`` can hold, without going through buckets.  (Without ``rest`` they are compared
    pair by pair.)  Buckets are worked on in ``slices``, see ``by_slices``.  ``verify`` takes distinct pairs (x, y), x < y, and returns those that hold, as a written table (u, v)."""
    rows = buckets if "weight" in buckets.columns else _weighed(buckets)

    def first(part: DataFrame) -> DataFrame:
        part = part.withColumn("comp", F.col("id"))
        if not small:
            return _with_pivots(part, 0, near).distinct()
        return _in_buckets(part.where(F.col("held") <= small), near).unionByName(_with_pivots(part.where(F.col("held") > small), 0, near)).distinct()

    pairs = by_slices(rows, slices, "key", first, "pairs")
    found = verify(pairs.distinct())
    dropped(pairs)
    comps = checkpointed(components(found))
    for turn in range(1, most_rounds + 1):
        left = rows.where(F.col("held") > small) if small and turn == 1 else rows
        before, rows = rows, by_slices(left, slices, "key", lambda part, comps=comps: _open(part, comps), "open")
        dropped(before)
        del before
        released(rows.sparkSession)
        some = rows.where("few")
        many = rows.where("NOT few")
        left = many.limit(1).count()
        if not left and not some.limit(1).count():
            break
        last = not left or turn == most_rounds

        def compared(part: DataFrame, turn: int = turn, last: bool = last, left: int = left) -> DataFrame:
            pairs = _in_buckets(part.where("few") if rest is not None or not last else part, near)
            return (pairs.unionByName(_with_pivots(part.where("NOT few"), turn, near)) if left and not last else pairs).distinct()

        pairs = by_slices(rows, slices, "key", compared, "pairs")
        more = rest(checkpointed(many.select("id", "comp").distinct())) if left and last and rest is not None else None
        found = verify((pairs if more is None else pairs.unionByName(more)).distinct())
        dropped(pairs)
        if found.limit(1).count():
            comps = checkpointed(joined(comps, found))
        if last:
            break
        rows = many
    dropped(rows)
    return comps


def _with_pivots(rows: DataFrame, turn: int, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (x, y) of the ids of each bucket with one of them."""
    order = F.struct(F.when(F.lit(turn) == 0, -F.col("weight")).otherwise(0), F.xxhash64("id", F.pmod("key", F.lit(3)), F.lit(turn)))
    pivots = rows.groupBy("key").agg(F.min_by(F.struct("id", "comp", "code"), order).alias("p"))
    pairs = rows.join(pivots, "key").where("comp <> p.comp").where(near(F.col("code"), F.col("p.code")))
    return pairs.select(F.least("id", "p.id").alias("x"), F.greatest("id", "p.id").alias("y"))


def _in_buckets(rows: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (x, y) of the unconnected ids of each bucket."""
    rows = rows.repartition("key")  # both sides read one shuffle
    a, b = (rows.select("key", *(F.col(c).alias(s + i) for c, s in (("id", "i"), ("comp", "c"), ("code", "e")))) for i in "xy")
    pairs = a.join(b, "key").where("ix < iy AND cx <> cy").where(near(F.col("ex"), F.col("ey")))
    return pairs.select(F.col("ix").alias("x"), F.col("iy").alias("y"))


def _weighed(buckets: DataFrame) -> DataFrame:
    """``buckets`` with weight, the rows in all buckets of the id, as a written table."""
    buckets = staged(buckets, "buckets")
    rows = buckets.select("key", "id").join(buckets.groupBy("key").agg(F.count("*").alias("n")), "key")
    weights = rows.groupBy("id").agg(F.sum("n").alias("weight"))
    weighed = staged(buckets.join(weights, "id"), "weighed")
    dropped(buckets)
    return weighed


def _open(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` of buckets whose ids are in more than one component, with comp and few: whether the bucket holds
    at most ``FEW`` pairs of different components for each row."""
    rows = rows.select("key", "id", "code", "weight").join(comps, F.col("id") == comps["node"], "left")
    rows = rows.select("key", "id", "code", "weight", F.coalesce("comp", "id").alias("comp"))
    n, q = F.col("n"), F.col("q")
    by = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(n * n).alias("q"))
    several = by.where("q < n * n").select("key", (n * n - q <= 2 * FEW * n).alias("few"))
    return rows.join(several, "key")
