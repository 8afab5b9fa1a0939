"""Fuzzy line deduplication with SimHash, in DataFrame functions alone (operator 2).

Lines are normalised to lower-case letters and digits (all digits alike).  Of a distinct line of at most ``FULL`` characters
(and a quarter more) pieces of ``LONG`` characters from each character on, of a longer one runs of whole words of at least ``WHOLE``
characters from each word on, are hashed; those below a bound that leaves about ``KEYS`` or ``KEYS_LONG`` of them are its keys, and
lines that share a key are candidates.  A piece outlives every edit that does not touch it, as the blocks of a pigeonhole
argument do, wherever in the line it stands, and edits move it by as many characters as they are at most.  Of candidates are put aside
those whose piece in common stands where no such edits bring it, long ones with less than a fifth of their longer words in common (by bits), those
whose lengths rule the similarity out and those whose 63-bit SimHashes, of all distinct words of the whole line, differ
in more than ``CUT`` bits (``CUT_LONG`` for long ones).  The others are confirmed by edit distance on the whole lines, whatever their length,
and of each connected group the first occurrence stays.

Neither keys nor SimHash promise an edit similarity: how many pairs at the threshold are found is held
against brute force in the tests and given in the README.

Lines of less than ``shortest`` normalised characters stay as they are: too little to tell them apart.

Nulls: a null text has no lines and stays null, an empty one stays empty.  Repeated rows are told apart by their
place, which is written once, so one of them keeps the line.  A table without rows gives none."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dropped, numbered, released, staged
from .components import by_slices, linked

#: Pairs of lines whose distance a task takes.
PER_TASK = 2000
#: Distinct lines whose keys, and pairs whose texts, are shuffled at once; larger tables go in ``SLICES`` parts at most, one after another.
LINES_AT_ONCE, PAIRS_AT_ONCE, SLICES = 400_000, 100_000, 6
#: Rows of a bucket that is compared pair by pair at once, and rounds of pivots in larger ones.
SMALL, ROUNDS = 16, 2
#: Line numbers that are sent to all tasks at most; above, texts are shuffled.
MOST_SENT = 200_000
#: Longest line of which pieces begin at every character, their characters, and how many of them are keys.
FULL, LONG, KEYS = 160, 12, 18
#: In longer lines pieces are runs of whole words from each word on: characters that a run has at least, words at most, how many runs are keys.
#: Lines with less than a word in ``FEWEST`` characters are written without spaces, and their characters count as words.
WHOLE, WORDS, KEYS_LONG, FEWEST = 13, 5, 16, 16
#: Bits in which the SimHashes of candidates differ at most; less for lines of more than ``FULL`` characters, which have words enough for
#: typos in half of them to be more edits than the similarity allows.
CUT, CUT_LONG = 26, 24
#: Characters from one passage of a line that is sought in another to the next.  Length of passages and characters by which they may be
#: off, as tried on lines of more than so many characters.
STEP, PASSAGES = 32, ((160, 12, 48), (2000, 24, 2000), (10_000, 24, 8000))
#: Counters of SimHash bits in a long: seven of 9 bits for lines of at most 511 words, three of 21 bits for longer ones.
LANES = ((9, 7), (21, 3))
#: Letters of a word that has a bit among ``BITS`` longs: frequent ones are short.  Bits of a line that tell enough.
LETTERS, BITS, TELLING = 5, 4, (6, 128)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` has lambdas of its own."""
    return F.transform(F.array(value), use)[0]


def normal(text: Column) -> Column:
    """Lower-case letters, digits as 0, and single spaces; the lines of ``text`` stay lines."""
    plain = F.regexp_replace(F.lower(text), r"\p{N}", "0")
    return F.regexp_replace(plain, r"[^\p{L}0\n]+", " ")


def kept(key: str, of: str, most: int) -> Column:
    """Whether ``key``, one of the hashes of ``of`` pieces of a line, is among about ``most`` of them: those below a bound, so that lines
    with pieces in common take the same ones, without a sort."""
    return F.col(key).bitwiseAND(F.lit((1 << 63) - 1)).cast("double") * F.col(of) < F.lit(most * 2.0**63)


def keys_of(rows: DataFrame) -> DataFrame:
    """key, node and place of lines (node, n, norm): hashes of pieces, and where they begin.

    Pieces are rows, where code is compiled; a hash stands in an array of one, so that it is computed once and not for the bound again."""
    # lines that may be near to one of at most FULL characters have the pieces of such as well
    short = rows.where((F.col("n") >= LONG) & (F.col("n") * 4 <= FULL * 5)).select("node", "norm", (F.col("n") - (LONG - 1)).alias("of"))
    places = short.select("*", F.explode(F.sequence(F.lit(1), "of")).alias("i"))
    every = F.xxhash64(F.substring(F.col("norm"), F.col("i"), F.lit(LONG)))
    every = places.select("node", "of", "i", F.explode(F.array(every)).alias("key")).where(kept("key", "of", KEYS))

    spaced = F.size("words") * FEWEST >= F.col("n")
    # the low bits of a word's hash are its length, as far as it matters
    marks = F.transform(F.col("words"), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-16)).bitwiseOR(F.least(F.length(w), F.lit(15)).cast("long")))
    places = rows.where(F.col("n") > FULL).select("node", "norm", "n", F.split("norm", " ").alias("words"))
    places = places.select("node", "norm", spaced.alias("spaced"), F.when(spaced, F.col("words")).otherwise(F.split("norm", "")).alias("words"))
    places = places.select("node", "norm", "spaced", marks.alias("marks"))
    places = places.select("node", "norm", "spaced", "marks", F.posexplode_outer("marks").alias("i", "m0"))
    run = [f"m{k}" for k in range(WORDS)]
    places = places.select("node", "norm", "spaced", "i", F.size("marks").alias("of"), "m0", *(F.get("marks", F.col("i") + k).alias(m) for k, m in enumerate(run) if k))
    size, whole = F.lit(-1), None
    for k, m in enumerate(run, 1):
        size = size + F.col(m).bitwiseAND(F.lit(15)) + 1
        held = size >= WHOLE if k < WORDS else F.col(m).isNotNull()
        piece = F.xxhash64(*run[:k])
        whole = F.when(held, piece) if whole is None else whole.when(held, piece)
    whole = places.select("node", "norm", "spaced", "i", "of", F.explode(F.array(whole)).alias("key")).where(F.col("key").isNotNull() & kept("key", "of", KEYS_LONG))
    place = F.when(F.col("spaced"), F.length(F.call_function("substring_index", "norm", F.lit(" "), "i"))).otherwise(F.col("i"))
    return every.select("key", "node", F.col("i").alias("place")).unionByName(whole.select("key", "node", place.alias("place")))


def lines(docs: DataFrame, shortest: int) -> DataFrame:
    """row, pos, norm, n and two hashes, node and more, of lines of ``shortest`` normalised characters or more.  Lines are
    equal if both hashes and n are."""
    normed = F.transform(F.split(normal(F.col("text")), "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("norm")))
    # an outer one, as of others Spark asks first if they have rows at all, by working out the array once more
    rows = docs.select(F.col("__row").alias("row"), F.explode_outer(F.filter(normed, lambda x: F.length(x["norm"]) >= shortest)).alias("l"))
    rows = rows.where(F.col("l").isNotNull()).select("row", "l.pos", "l.norm")
    return rows.withColumns({"node": F.xxhash64("norm"), "more": F.xxhash64(F.lit(7), "norm"), "n": F.length("norm")})


def simhashes(rows: DataFrame) -> DataFrame:
    """id, sim and bits of lines (id, norm).  sim: bits set in over half of the hashes of the distinct words, 63 of them.  Were words counted
    as often as they occur, the frequent ones of a language would make all its lines alike.

    Words are counted in rows of their own, where code is compiled; counters share longs (``LANES``).  Lines of two
    million distinct words, which would overflow them, have none and pass for near to any.  bits: one of 64 ``BITS`` for each
    word of ``LETTERS`` letters or more, null for lines whose words would fill them."""
    size, none, least_size, out = F.size(F.split("norm", " ")), F.lit(0).cast("long"), 0, None
    for width, lanes in LANES:
        # n characters are (n + 1) / 2 words at most, so few lines are split to tell which counters suffice
        most = (1 << width) - 1
        some = rows.where((F.length("norm") < 2 * most) | (size <= most))
        some = some.where((F.length("norm") > 2 * least_size) & (size > least_size)) if least_size else some
        some = some.select("id", F.explode_outer(F.array_distinct(F.split("norm", " "))).alias("w"))
        some = some.select("id", F.xxhash64("w").alias("h"), (F.length("w") >= LETTERS).alias("rare"))
        ones = F.lit(sum(1 << width * k for k in range(lanes)))
        sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(ones)).alias(f"c{i}") for i in range(width)]
        bit, of = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")), F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(BITS - 1))
        sets = [F.bit_or(F.when(F.col("rare") & (of == k), bit)) for k in range(0 if least_size else BITS)]
        counted = some.groupBy("id").agg(F.count("*").alias("all"), *sums, *(F.coalesce(x, none).alias(f"b{k}") for k, x in enumerate(sets)))

        def bits(counts: Column, i: Column, width=width, lanes=lanes) -> Column:
            found = none
            for k in range(lanes):
                full = F.shiftrightunsigned(counts, width * k).bitwiseAND(F.lit((1 << width) - 1)) * 2 > F.col("all")
                found = found.bitwiseOR(F.when(full, F.lit(1 << width * k)).otherwise(none))
            return F.call_function("shiftleft", found, i)

        by_place = F.transform(F.array(*(f"c{i}" for i in range(width))), lambda c, i: bits(c, i))
        sets = [F.lit(None).cast("long").alias(f"b{k}") if least_size else F.col(f"b{k}") for k in range(BITS)]
        made = counted.select("id", F.aggregate(by_place, none, lambda a, x: a.bitwiseOR(x)).alias("sim"), F.struct(*sets).alias("bits"))
        out = made if out is None else out.unionByName(made)
        least_size = most
    return out


def by_pieces(x: Column, y: Column, most: Column, passage: int, slip: int) -> Column:
    """Whether pieces of ``x`` and ``y`` that lie between passages they have in common differ in ``most`` edits at most altogether: then
    the whole texts do too.  False says nothing.  Time grows with the length, not with its square.

    Passages of ``passage`` characters are taken from ``x`` at every ``STEP`` and sought in ``y`` up to ``slip`` characters off."""
    longest = 8 * STEP + slip

    def edits(a: Column, b: Column, left: Column) -> Column:
        return F.when(a == b, 0).otherwise(F.call_function("levenshtein", a, b, left))

    def step(s: Column, cut: Column) -> Column:
        gap = cut - s["p"]
        lost = F.struct(s["p"].alias("p"), s["q"].alias("q"), F.lit(-1).alias("left"))

        def found(w: Column) -> Column:
            spent = edits(F.substring(x, s["p"] + 1, gap), F.substring(w["text"], F.lit(1), w["at"] - 1), s["left"])
            on = let(spent, lambda e: F.struct(cut.alias("p"), (s["q"] + w["at"] - 1).alias("q"), F.when(e < 0, -1).otherwise(s["left"] - e).alias("left")))
            return F.when(w["at"] > 0, on).when(gap > longest, lost).otherwise(s)

        sought = F.struct(F.substring(x, cut + 1, F.lit(passage)).alias("passage"), F.substring(y, s["q"] + 1, gap + slip + passage).alias("text"))

        def place(t: Column) -> Column:  # where it would be without edits, so that repeated words do not lead astray, or the first one near
            same = F.substring(t["text"], gap + 1, F.lit(passage)) == t["passage"]
            at = F.when(same, gap + 1).otherwise(F.call_function("locate", t["passage"], t["text"], F.greatest(F.lit(1), gap + 1 - slip)))
            return F.struct(t["text"].alias("text"), at.alias("at"))

        at = let(sought, place)
        return F.when(s["left"] < 0, s).otherwise(let(at, found))

    def rest(s: Column) -> Column:
        a, b = F.substring(x, s["p"] + 1, F.length(x)), F.substring(y, s["q"] + 1, F.length(y))
        short = (s["left"] >= 0) & (F.greatest(F.length(x) - s["p"], F.length(y) - s["q"]) <= 2 * longest)
        return F.when(short, edits(a, b, s["left"]) >= 0).otherwise(False)

    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), most.alias("left"))
    return F.aggregate(F.sequence(F.lit(STEP), F.greatest(F.lit(STEP), F.length(x) - passage), F.lit(STEP)), start, step, rest)


def other_words(x: Column, y: Column) -> Column:
    """Whether less than a fifth of the bits of two lines are the same, if they have ``TELLING`` many: bits that are the same by chance
    only let more lines pass."""
    have = [sum((F.bit_count(z[f"b{k}"]) for k in range(BITS)), F.lit(0)) for z in (x, y)]
    same = sum((F.bit_count(x[f"b{k}"].bitwiseAND(y[f"b{k}"])) for k in range(BITS)), F.lit(0))
    few, many = F.least(*have), F.greatest(*have)
    return F.coalesce((few >= TELLING[0]) & (many <= TELLING[1]) & (same * 5 < few), F.lit(False))


def similar(x: str, y: str, similarity: float) -> Column:
    """Edit similarity of two text columns; the distance is given up beyond what the threshold allows.  Time
    grows with the limit, and most near lines are far within it, so a part of it is tried first, and of longer lines pieces.  Lines of more than ``FULL`` characters that have less than a third of their words in common, as lines with one
    phrase in common have, are not tried."""
    most = f"cast(floor({1 - similarity:.6f} * greatest(length({x}), length({y})) + 1e-6) as int)"
    wx, wy = (f"array_distinct(split({t}, ' '))" for t in (x, y))
    size = F.expr(f"greatest(length({x}), length({y}))")
    apart = (size > FULL) & F.expr(f"3 * size(array_intersect({wx}, {wy})) < least(size({wx}), size({wy}))")
    whole = F.expr(f"CASE WHEN length({x}) <= {FULL} AND levenshtein({x}, {y}, {most} div 4) >= 0 THEN true ELSE levenshtein({x}, {y}, {most}) >= 0 END")
    pieces = [(size > least_size) & by_pieces(F.col(x), F.col(y), F.expr(most), *how) for least_size, *how in PASSAGES]
    return functools.reduce(lambda out, held: out.when(held, True), pieces, F.when(apart, False)).otherwise(whole)


def repeated_lines(docs: DataFrame, similarity: float = 0.8, shortest: int = 20) -> DataFrame:
    """Of ``docs``, which are ``numbered``, row and drop: the places, within their row, of lines that another line of their group stands for."""
    spark = docs.sparkSession
    rows = staged(lines(docs, shortest).withColumn("id", F.monotonically_increasing_id()), "lines")
    # a distinct line has the number of its first occurrence, a group that of its first line
    distinct = staged(rows.groupBy("node", "more", "n").agg(F.min("id").alias("id"), F.count("*").alias("times")), "distinct")
    slices = min(SLICES, 1 + distinct.count() // LINES_AT_ONCE)
    every = staged(keys_of(rows), "every")
    released(spark)

    def shared(keys: DataFrame) -> DataFrame:
        keys = keys.repartition("key")  # shuffled once, for counts and join
        several = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("held")).where("a <> b").select("key", "held")
        return keys.join(several.hint("shuffle_hash"), "key").distinct()

    keys = by_slices(every, slices, "key", shared, "keys")
    dropped(every)
    codes = staged(distinct.select("node", "id", "n").join(simhashes(rows), "id", "left").select("node", "id", F.struct("sim", "n", "bits").alias("code")), "codes")
    released(spark)
    # lines with the same hash are two here, and told apart by their texts
    buckets = staged(keys.join(codes, "node").select("key", "held", "id", F.col("code").withField("place", F.col("place")).alias("code"), (-F.col("id")).alias("weight")), "buckets")
    dropped(keys)
    dropped(codes)
    del every, keys, codes
    released(spark)

    def near(a: Column, b: Column) -> Column:
        longer = F.greatest(a["n"], b["n"])
        most = F.when(longer <= FULL, CUT).otherwise(CUT_LONG)
        sim = F.coalesce(F.bit_count(a["sim"].bitwiseXOR(b["sim"])) <= most, F.lit(True))
        # edits before a piece in common move it, those behind it change what is left of the line
        before, behind = a["place"] - b["place"], a["n"] - a["place"] - (b["n"] - b["place"])
        moved = F.coalesce(F.abs(before) + F.abs(behind) <= (1 - similarity) * longer + 1e-6, F.lit(True))
        return (F.least(a["n"], b["n"]) >= similarity * longer) & moved & sim & ~((longer > FULL) & other_words(a["bits"], b["bits"]))

    def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        tx, ty = (texts.select(F.col("id").alias(i), F.col("norm").alias(f"t{i}")) for i in "xy")
        # rows are small and each takes long, so they are dealt out by their number, not by their bytes
        both = tx.join(pairs.hint("shuffle_hash"), "x").repartition(max(8, pairs.count() // PER_TASK), "y").join(ty, "y")
        return checkpointed(both.where(similar("tx", "ty", similarity)).select(F.col("x").alias("u"), F.col("y").alias("v")))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs)
        released(spark)
        wanted = checkpointed(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct())
        few = wanted.limit(MOST_SENT + 1).count() <= MOST_SENT
        # either no text is shuffled, or those of all lines are, once
        texts = staged(rows.select("id", "norm").join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "id"), "texts")
        found, parts = None, min(SLICES, 1 + pairs.count() // PAIRS_AT_ONCE)
        for i in range(parts):
            part = confirmed(pairs.where(F.pmod(F.xxhash64("y"), F.lit(parts)) == i) if parts > 1 else pairs, texts)
            found = part if found is None else found.unionByName(part)
            released(spark)
        dropped(texts)
        return found

    comps = linked(buckets, near, verify, most_rounds=ROUNDS, slices=slices, small=SMALL).select(F.col("node").alias("id"), "comp")
    groups = distinct.join(comps, "id", "left").withColumn("stays", F.coalesce("comp", "id"))
    groups = groups.where("times > 1 OR id <> stays").select("node", "more", "n", "stays")
    gone = rows.select("row", "pos", "node", "more", "n", "id").join(groups, ["node", "more", "n"]).where("id <> stays")
    drops = staged(gone.groupBy("row").agg(F.collect_list("pos").alias("drop")), "drops")
    dropped(rows)
    dropped(distinct)
    del comps, groups, gone
    released(spark)
    return drops


def dedup_lines(docs: DataFrame, similarity: float = 0.8, shortest: int = 20) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and how many: n_dropped.  Other columns are carried as
    they are; one of ``docs`` named n_dropped is replaced."""
    docs = numbered(docs.drop("n_dropped"))
    drops = repeated_lines(docs, similarity, shortest).select(F.col("row").alias("__of"), F.col("drop").alias("__drop"))
    kept = let(
        F.struct(F.split("text", "\n", -1).alias("lines"), F.col("__drop").alias("drop")),
        lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["drop"]), lambda i: s["lines"][i]), "\n"),
    )
    joined = docs.join(drops, F.col("__row") == F.col("__of"), "left")
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept)
    return joined.withColumns({"text": text, "n_dropped": F.coalesce(F.size("__drop"), F.lit(0))}).drop("__row", "__of", "__drop")
