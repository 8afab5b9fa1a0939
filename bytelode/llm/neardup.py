"""Near duplicates by HyperMinHash (operator 9).

Each of 216 registers keeps, of the least hash its bucket saw, the count of leading zeros (6 bits)
and the 10 bits after the leading one.  Every bucket hashes all shingles with a multiplier of its
own, so short documents fill their registers as long ones do.  Bands of six compressed registers
propose pairs; at similarity 0.8 a pair misses all 36 bands with probability 2e-5, at 0.1 it shares one with
probability 4e-5.  The share of equal
registers, corrected for chance collisions of the compressed values, estimates the Jaccard
similarity; only pairs that fall short by more than five standard errors are put aside, the
others are confirmed on their full shingle sets.  The last bits of the registers make a code that goes with
the bands, so that pairs sharing a band and little else are dropped inside the join.

Documents with equal shingle sets are one class and compared once.  Within a bucket every class
meets pivots first; classes already known to be connected need no further comparison, so a group of n
near copies costs about n comparisons.  Pairs that remain unconnected are compared bucket by bucket where they are
few, else found by an exact prefix filter on the shingles that are rarest among the open sets, so no link between
different texts is lost and no group is compared pair by pair.

Nulls: a null or empty text has no shingle and no link; a null ``doc_id`` is carried and takes the
least number of its component.  Repeated rows fall into one class.  An empty table gives no rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, checkpointed, numbered, staged
from .components import linked
from .hashing import mixed, shingle_sets

REGISTERS, ROWS, MANTISSA = 216, 6, 10
BANDS = REGISTERS // ROWS
#: Numbers of documents that are sent to all tasks at most.
MOST_SENT = 1_000_000
_seeds = mixed(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_times, _flips = _seeds[:REGISTERS, None] | np.uint64(1), _seeds[REGISTERS:, None]


def registers(grams: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), 1024):
        np.minimum(least, ((grams[None, lo : lo + 1024] ^ _flips) * _times).min(axis=1), out=least)
    part, bits = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    zeros = np.clip(64 - bits, 0, 63).astype(np.uint16)
    return zeros << np.uint16(MANTISSA) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def band_keys(r: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in r.reshape(BANDS, ROWS).astype(np.uint64).T:
        key = mixed((key ^ part) * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def code_of(r: np.ndarray) -> np.ndarray:
    """The last bit of every register."""
    bits = np.zeros(256, np.uint8)
    bits[:REGISTERS] = r & 1
    return np.packbits(bits).view(np.int64)


def maybe_near(a: Column, b: Column, threshold: float) -> Column:
    """Codes of sets at the threshold differ in half of the other registers; five standard errors more
    are allowed."""
    p = (1 - threshold) / 2
    most = int(REGISTERS * p + 5 * (REGISTERS * p * (1 - p)) ** 0.5)
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, 4)), F.bit_count(a[0].bitwiseXOR(b[0]))) <= most


def chance(n: int = 1000) -> float:
    """Probability that registers of disjoint sets of ``n`` shingles agree: the sum over all register
    values of the squared probability that the least of n uniform hashes falls there."""
    zeros, mantissa = np.arange(40)[:, None], np.arange(1 << MANTISSA)[None, :]
    low = 2.0 ** -(zeros + 1) * (1 + mantissa / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1) / (1 << MANTISSA)
    p = (1 - low) ** n - (1 - np.minimum(high, 1)) ** n
    return float((p * p).sum())


CHANCE = chance()


def estimate(a: bytes, b: bytes) -> float:
    same = np.count_nonzero(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)) / REGISTERS
    return (same - CHANCE) / (1 - CHANCE)


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row number, n_shingles, digest of the shingle set, registers, band keys, code (null without shingles)."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                cut = batch.slice(lo, 500)
                size, digest, regs, bands, codes = [], [], [], [], []
                for grams in shingle_sets(cut.column(1).to_pylist(), width):
                    size.append(len(grams))
                    if not len(grams):
                        digest.append(None), regs.append(None), bands.append(None), codes.append(None)
                        continue
                    r = registers(grams)
                    digest.append(_digest(grams)), regs.append(r.tobytes())
                    bands.append(band_keys(r)), codes.append(code_of(r))
                yield pa.RecordBatch.from_arrays(
                    [
                        cut.column(0),
                        cut.column(2),
                        pa.array(size, pa.int64()),
                        *(pa.array(x, pa.binary()) for x in (digest, regs)),
                        *(pa.array(x, pa.list_(pa.int64())) for x in (bands, codes)),
                    ],
                    names=["doc_id", "row", "n_shingles", "digest", "registers", "bands", "code"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.col("__row").alias("row"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, row long, n_shingles long, digest binary, registers binary, bands array<long>, code array<long>"
    )


def _promising(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) whose estimate is not below the threshold by over five standard errors."""
    floor = threshold - 5.0 * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def run(batches):
        for b in batches:
            keep = [estimate(x, y) >= floor for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=b.schema.names[:4]).filter(pa.array(keep, pa.bool_()))

    sides = [classes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("digest", "rep_id", "registers"))) for s in "xy"]
    both = (
        pairs.join(sides[0], pairs["x"] == sides[0]["digest_x"])
        .join(sides[1], F.col("y") == sides[1]["digest_y"])
        .select("x", "y", "rep_id_x", "rep_id_y", "registers_x", "registers_y")
    )
    return both.mapInArrow(run, both.drop("registers_x", "registers_y").schema)


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (x, y, rep_id_x, rep_id_y) those whose full sets share ``percent`` of their union."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                cut = b.slice(lo, 200)
                x, y, xt, yt = (c.to_pylist() for c in cut.columns)
                texts = list(dict.fromkeys(xt + yt))
                sets = dict(zip(texts, shingle_sets(texts, width)))
                own = {t: _digest(g) for t, g in sets.items()}
                keep = []
                for dx, dy, tx, ty in zip(x, y, xt, yt):
                    p, q = sets[tx], sets[ty]
                    # a doc_id that stands for several texts is fetched with each of them
                    good = own[tx] == dx and own[ty] == dy
                    if good:
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        good = 100 * both >= percent * (len(p) + len(q) - both)
                    keep.append(good)
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    ids = checkpointed(pairs.select(F.explode(F.array("rep_id_x", "rep_id_y")).alias("want")).distinct())
    ids = bounded_broadcast(ids, MOST_SENT)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["want"]), "left_semi").select("doc_id", "text")
    tx, ty = (texts.select(F.col("doc_id").alias(f"d{s}"), F.col("text").alias(f"t{s}")) for s in "xy")
    both = (
        pairs.join(tx, F.col("rep_id_x").eqNullSafe(F.col("dx")))
        .join(ty, F.col("rep_id_y").eqNullSafe(F.col("dy")))
        .select("x", "y", "tx", "ty")
    )
    return both.mapInArrow(run, "u binary, v binary")


def _sharing_rare(open_: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (x, y) of ``open_`` (id, comp, rep_id, code) of different components that can reach ``percent``.

    Prefix filter: the shingles of each set are ordered from the rarest among the open sets on.  Sets that
    share enough have their first common shingle so early in both that enough of each set is left from there on;
    only pairs that meet at such places, given both sizes, become rows.  Exact, and where a group's members differ from one another in
    shingles of their own, as copies with edits do, few pairs are left whatever the size of the group."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                no, own, texts = (c.to_pylist() for c in b.slice(lo, 200).columns)
                # a doc_id that stands for several texts is fetched with each of them
                sets = [g if len(g) and _digest(g) == d else g[:0] for g, d in zip(shingle_sets(texts, width), own)]
                sizes = [len(g) for g in sets]
                columns = np.repeat(np.array(no, np.int64), sizes), np.repeat(np.array(sizes, np.int32), sizes), np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["no", "size", "gram"])

    open_ = staged(open_.withColumn("no", F.monotonically_increasing_id()), "open")
    ids = bounded_broadcast(open_.select("no", "id", "rep_id"), MOST_SENT // 10)
    texts = docs.select("doc_id", "text").join(ids, docs["doc_id"].eqNullSafe(F.col("rep_id"))).select("no", "id", "text")
    grams = staged(texts.mapInArrow(run, "no long, size int, gram long").distinct(), "grams")
    # a shingle of one set alone makes the prefix shorter but no pair
    rare = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = grams.join(rare, "gram").groupBy("no", "size").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    first = F.slice("g", F.lit(1), F.col("size") - F.ceil(percent * F.col("size") / 100).cast("int") + 1)
    placed = ranked.select("no", "size", F.posexplode(first).alias("pos", "g")).where("g.df > 1")
    placed = staged(placed.join(open_.select("no", "id", "comp", "code"), "no").select("id", "size", "comp", "code", "pos", F.col("g.gram").alias("gram")), "prefixes")
    x, y = (placed.select("gram", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "size", "comp", "code", "pos"))) for s in "xy")
    left = F.least(F.col("size_x") - F.col("pos_x"), F.col("size_y") - F.col("pos_y"))
    both = x.join(y, "gram").where("id_x < id_y AND comp_x <> comp_y").where(left * (100 + percent) >= percent * (F.col("size_x") + F.col("size_y")))
    both = both.where(maybe_near(F.col("code_x"), F.col("code_y"), percent / 100))
    return both.select(F.col("id_x").alias("x"), F.col("id_y").alias("y"))


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_class, row and comp for every row of ``docs``; rows are numbered
    in the order they are read, if they are not ``numbered`` yet.  comp tells components apart also where ids are null
    or repeated; it is null without shingles."""
    if "__row" not in docs.columns:
        docs = docs.withColumn("__row", F.monotonically_increasing_id())
    docs = docs.select("doc_id", "text", "__row")
    made = staged(sketches(docs, width), "sketches")
    classes = staged(
        made.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep_id"),
            F.first("registers").alias("registers"),
            F.first("bands").alias("bands"),
            F.first("code").alias("code"),
            F.count("*").alias("n_class"),
        ),
        "classes",
    )
    bands = classes.select(F.col("digest").alias("id"), F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    codes = classes.select(F.col("digest").alias("id"), "code")
    buckets = bands.join(shared, "key").join(codes, "id")

    def verify(pairs: DataFrame) -> DataFrame:
        return checkpointed(_confirmed(checkpointed(_promising(pairs, classes, percent / 100)), docs, width, percent))

    def rest(open_: DataFrame) -> DataFrame:
        return _sharing_rare(open_.join(classes.select(F.col("digest").alias("id"), "rep_id", "code"), "id"), docs, width, percent)

    comps = linked(buckets, lambda a, b: maybe_near(a, b, percent / 100), verify, rest)
    ids = classes.select("digest", "rep_id", "n_class").join(comps, classes["digest"] == comps["node"], "left")
    ids = ids.select("digest", "rep_id", "n_class", F.coalesce("comp", "digest").alias("comp"))
    least = ids.groupBy("comp").agg(F.min("rep_id").alias("component_id"))
    named = ids.join(least, "comp").select("digest", "component_id", "n_class", "comp")
    component = F.coalesce("component_id", "doc_id")
    return (
        made.select("doc_id", "row", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            component.eqNullSafe(F.col("doc_id")).alias("kept"),
            F.coalesce("n_class", F.lit(1)).alias("n_class"),
            "row",
            "comp",
        )
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for those that another row of their group stands for: of a group stays
    its least number, of rows with that number the first.  Rows without shingles stay."""
    docs = numbered(docs)
    found = staged(near_duplicates(docs, width, percent).where("comp IS NOT NULL").select("comp", "doc_id", "row"), "groups")
    stays = found.groupBy("comp").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("stays"))
    gone = checkpointed(found.join(stays, "comp").where("row <> stays").select(F.col("row").alias("__gone")))
    return docs.join(bounded_broadcast(gone, MOST_SENT), F.col("__row") == F.col("__gone"), "left_anti").drop("__row")
