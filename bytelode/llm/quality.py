"""Quality rules by robust multivariate outliers (operator 3).

Counts of each text become five transformed statistics.  For every language and source a
minimum-covariance-determinant estimate is fitted: from three starts, the documents nearest to the medians by three
norms in units of absolute deviations, concentration steps keep the three quarters of the documents nearest by Mahalanobis
distance and estimate again; after two steps the start with the least determinant goes on until determinants settle.  A
document is rejected by a base rule or if its squared distance exceeds the one in a million quantile.

A source with less than ``least`` documents that pass the base rule is judged by its language, a language with less by all;
with less than 20 in all, only the base rule holds.  Variances have a floor for each statistic, so that sources
without any spread do not reject the first document that has some.

Quantiles come from counts in fine bins and moments from sums, so a source that holds a third of
all rows is added up before any shuffle.  Everything is DataFrame functions.

Nulls: a null text, like an empty one, has no words and fails the base rule; null ``lang`` and ``source`` are groups of
their own.  Repeated rows count each; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bounded_broadcast, staged
from .line_dedup import let

#: Least standard deviation of each statistic.
FLOORS = (0.04, 0.06, 0.03, 0.12, 0.12)
DIMS = range(len(FLOORS))
X = [f"x{i}" for i in DIMS]
# Quantiles of chi squared with five degrees of freedom, at 0.5 and 1 - 1e-6
CHI_HALF, CHI_CUT = 4.35146, 35.88819
KEPT_SHARE, STEPS, SETTLED, MOST_GROUPS = 0.75, 8, 0.02, 20_000


#: Key of the group of all rows.
ALL = '{"level":0}'


def repeated_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more, the first included."""
    starts = F.sequence(F.lit(0), F.size(words) - 5)
    windows = F.transform(starts, lambda i: F.xxhash64(*(words[i + k] for k in range(5))))

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1

        def again(k: Column) -> Column:
            before = (k > 0) & (pairs[F.greatest(k - 1, F.lit(0))]["h"] == pairs[k]["h"])
            after = (k < last) & (pairs[F.least(k + 1, last)]["h"] == pairs[k]["h"])
            return before | after

        at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), again), lambda k: pairs[k]["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("to"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["to"])).alias("n"), i.alias("to"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, covered))

    return F.when(F.size(words) < 6, 0).otherwise(let(windows, count))


def text_counts(text: Column) -> Column:
    """struct of the contract's counts and of what the statistics need besides."""
    text = F.coalesce(text, F.lit(""))
    size = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    by_words = let(
        F.array_remove(F.split(text, SPACE), ""),
        lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
    )
    by_lines = let(full, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return F.struct(
        by_words.alias("w"),
        by_lines.alias("l"),
        size(r"[^#*$%&|<>]+").alias("n_symbols"),
        size(r"[^\p{Lu}]+").alias("n_upper"),
        size(r"[^\p{L}]+").alias("n_letters"),
        F.length(text).alias("n_chars"),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and
    the statistics x0 to x4."""
    made = docs.withColumn("__c", text_counts(F.col("text")))
    c = lambda name: F.col(f"__c.{name}").cast("long")
    made = made.withColumns(
        {n: c(p) for n, p in {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words", "__lines": "l.n_lines", "__upper": "n_upper", "__letters": "n_letters", "__chars": "n_chars"}.items()}
    ).drop("__c")
    n = F.col
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), a / b)))
    return made.withColumns(
        {
            "base_failed": (n("n_words") < 10) | (100 * n("n_repeat_words") > 20 * n("n_words")),
            "x0": share(n("n_symbols"), n("__chars") + 50),
            "x1": F.log((n("word_chars") + 100) / (n("n_words") + 20)),
            "x2": share(n("__upper") + 1.5, n("__letters") + 50),
            "x3": share(n("n_dup_lines"), n("__lines") + 8),
            "x4": share(n("n_repeat_words"), n("n_words") + 50),
        }
    ).drop("__lines", "__upper", "__letters", "__chars")


def _keys() -> list[Column]:
    """A row's groups, the finest first; JSON leaves null members out, so the level tells them apart."""
    return [F.to_json(F.struct(F.lit(k).alias("level"), *cols)) for k, cols in ((2, ("lang", "source")), (1, ("lang",)), (0, ()))]


def _quantile(rows: DataFrame, by: list[str], value: Column, share: float, width: float) -> DataFrame:
    """``by`` and q: the upper edge of the bin of ``width`` where the share is reached."""
    bins = rows.select(*by, F.floor(value / width).alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    running = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumns({"cum": F.sum("n").over(running), "all": F.sum("n").over(Window.partitionBy(*by))})
    return bins.where(F.col("cum") >= share * F.col("all")).groupBy(*by).agg(((F.min("bin") + 1) * width).alias("q"))


def _wide(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("key").agg(*(F.max(F.when(F.col("dim") == i, F.col("q"))).alias(f"{name}{i}") for i in DIMS))


def _attached(rows: DataFrame, params: DataFrame) -> DataFrame:
    return rows.join(bounded_broadcast(params, MOST_GROUPS), "key")


def with_distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d from the columns mu0.. and the Cholesky factor l00, l10, l11.."""
    for i in DIMS:
        inner = F.col(X[i]) - F.col(f"mu{i}")
        for j in range(i):
            inner -= F.col(f"l{i}{j}") * F.col(f"__y{j}")
        rows = rows.withColumn(f"__y{i}", inner / F.col(f"l{i}{i}"))
    total = sum((F.col(f"__y{i}") * F.col(f"__y{i}") for i in DIMS[1:]), F.col("__y0") * F.col("__y0"))
    return rows.withColumn("d", total).drop(*(f"__y{i}" for i in DIMS))


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean, Cholesky factor of the covariance, floors added, and half its log determinant, of each key and start."""
    sums = [F.avg(x).alias(f"mu{i}") for i, x in enumerate(X)]
    cross = [F.avg(F.col(X[i]) * F.col(X[j])).alias(f"c{i}{j}") for i in DIMS for j in range(i + 1)]
    out = rows.groupBy("key", "start").agg(*sums, *cross)
    for i in DIMS:
        for j in range(i + 1):
            v = F.col(f"c{i}{j}") - F.col(f"mu{i}") * F.col(f"mu{j}")
            v = F.greatest(v, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else v
            for k in range(j):
                v -= F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            v = F.sqrt(F.greatest(v, F.lit(1e-8))) if i == j else v / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", v)
    half = sum((F.log(f"l{i}{i}") for i in DIMS[1:]), F.log("l00"))
    return out.drop(*(f"c{i}{j}" for i in DIMS for j in range(i + 1))).withColumn("det", half)


def fit(stats: DataFrame, least: int = 100) -> DataFrame:
    """key, mean, Cholesky factor and scale of every group that has enough documents.

    ``stats`` is a written table with lang, source, base_failed and the statistics."""
    rows = stats.where(~F.col("base_failed")).select(F.explode(F.array(*_keys())).alias("key"), *X)
    groups = rows.groupBy("key").agg(F.count("*").alias("n"))
    enough = F.when(F.col("key") == ALL, 20).otherwise(least)
    groups = staged(groups.where(F.col("n") >= enough).select("key"), "groups")
    rows = _attached(rows, groups)
    long = lambda df, cols: df.select("key", F.posexplode(F.array(*cols)).alias("dim", "v"))
    middle = staged(_wide(_quantile(long(rows, [F.col(x) for x in X]), ["key", "dim"], F.col("v"), 0.5, 0.002), "m"), "medians")
    off = [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(X)]
    spread = staged(_wide(_quantile(long(_attached(rows, middle), off), ["key", "dim"], F.col("v"), 0.5, 0.001), "s").join(middle, "key"), "spreads")
    z = [(F.col(x) - F.col(f"m{i}")) / F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOORS[i])) for i, x in enumerate(X)]
    squares = [v * v for v in z]
    starts = [sum(squares[1:], squares[0]), F.greatest(*squares), sum(map(F.abs, z[1:]), F.abs(z[0]))]
    near = _attached(rows, spread).select("key", *X, F.posexplode(F.array(*starts)).alias("start", "d"))
    log = F.log(F.col("d") + 1e-6)
    before = None
    for step in range(STEPS):
        edge = staged(_quantile(near, ["key", "start"], log, KEPT_SHARE, 1 / 32), "edges")
        kept = near.join(bounded_broadcast(edge, MOST_GROUPS), ["key", "start"]).where(log <= F.col("q"))
        params = staged(_estimate(kept), "estimates")
        if step == 1:
            best = params.groupBy("key").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
            params = staged(params.join(best, ["key", "start"]), "best")
        near = with_distance(_attached(rows, params)).select("key", "start", *X, "d")
        if step > 1:
            moved = params.join(before, "key").agg(F.max(F.abs(F.col("det") - F.col("det_before")))).first()[0]
            if moved is None or moved < SETTLED:
                break
        before = params.select("key", F.col("det").alias("det_before"))
    half = _quantile(near, ["key"], log, 0.5, 1 / 32)
    scale = F.greatest(F.lit(1.0), F.exp("q") / CHI_HALF).alias("scale")
    return staged(params.drop("start", "det").join(half.select("key", scale), "key"), "mcd")


def judge(stats: DataFrame, params: DataFrame) -> DataFrame:
    """``stats`` with d2 (null where no group is large enough) and kept."""
    known = bounded_broadcast(params, MOST_GROUPS)
    names = [c for c in params.columns if c != "key"]
    finer = _keys()[:-1]
    of_all = params.where(F.col("key") == ALL).select(*names).first()
    best = stats
    for k, key in enumerate(finer):
        side = known.select(F.col("key").alias(f"__k{k}"), F.struct(*names).alias(f"__p{k}"))
        best = best.join(side, key == F.col(f"__k{k}"), "left")
    rest = F.struct(*(F.lit(of_all[c] if of_all else None).cast("double").alias(c) for c in names))
    best = best.withColumn("__p", F.coalesce("__p0", "__p1", rest)).select(*stats.columns, "__p.*")
    d2 = F.col("d") / F.col("scale")
    out = with_distance(best).withColumn("d2", d2)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CHI_CUT, F.lit(True))
    return out.select(*stats.columns, "d2", kept.alias("kept"))


CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the squared distance of every row."""
    stats = staged(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "statistics")
    return judge(stats, fit(stats)).select("doc_id", *CONTRACT, "kept", "d2")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    made = with_statistics(docs.select("text", "lang", "source", F.struct(*docs.columns).alias("__doc"))).drop("text")
    stats = staged(made.select("lang", "source", "base_failed", *X, "__doc"), "statistics")
    return judge(stats, fit(stats)).where("kept").select("__doc.*")
