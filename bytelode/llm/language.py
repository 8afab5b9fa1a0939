"""Language identification with averaged hashed subword embeddings (operator 7).

A text is the mean of the embeddings of its hashed runs of 2, 3 and 4 bytes (lower case, everything
in ASCII that is no letter being a gap), followed by a linear softmax; both layers are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows.  A part of the sample that
training does not see sets the temperature and the score below which a prediction is rejected.

Prediction multiplies the two layers once, so each subword adds one row of logits, and reads whole
texts in blocks of bounded size.

Nulls: a null text or one without a letter is ``und`` with score 0; rows without ``lang`` are not learned
from.  Without any labelled row every prediction is ``und``; an empty table gives no rows.  Repeated rows are learned from
and predicted each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, staged

BUCKETS, WIDTH, SIZES = 1 << 16, 16, (2, 3, 4)
#: Bounds of the training sample: rows of each language and of all, characters of a row and of all.
PER_LANGUAGE, MOST_ROWS, LONGEST, MOST_CHARS = 1500, 100_000, 32_768, 200_000_000
BLOCK = 1 << 19
_GAPS = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def _plain(text: str | None) -> bytes:
    """Between gaps wide enough that no run of bytes reaches into the next text."""
    return b" " + (text.lower().encode("utf-8", "surrogatepass").translate(_GAPS) if text else b"") + b"   "


def _buckets(a: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the run of ``size`` bytes that starts at each place; -1 for runs of gaps."""
    n = len(a) - size + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    h = np.full(n, 2166136261 + size, np.uint32)
    for k in range(size):
        h ^= a[k : k + n]
        h *= np.uint32(16777619)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    out = (h >> np.uint32(16)).astype(np.int32)
    out[(a[:n] == 32) & (a[1 : n + 1] == 32)] = -1
    return out


class Subwords:
    """The two layers, trained; ``table`` has the logits each bucket adds."""

    def __init__(self, rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.6, seed: int = 7):
        self.langs = sorted({lang for _, lang in rows})
        rng = np.random.default_rng(seed)
        self.table = np.zeros((BUCKETS, max(1, len(self.langs))), np.float32)
        self.reject = 0.0
        if not rows:
            return
        of = {lang: i for i, lang in enumerate(self.langs)}
        texts = [(self._counts(t), of[lang]) for t, lang in rows]
        texts = [(x, y) for x, y in texts if len(x[0])]
        order = rng.permutation(len(texts))
        held = max(1, len(texts) // 5)
        train, check = order[held:], order[:held]
        emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        out = np.zeros((WIDTH, len(self.langs)), np.float32)
        steps, done = epochs * len(train), 0
        for _ in range(epochs):
            for i in rng.permutation(train):
                (at, share), y = texts[i]
                mean = share @ emb[at]
                z = mean @ out
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                lr = rate * (1 - done / steps)
                back = out @ p
                out -= lr * np.outer(mean, p)
                emb[at] -= lr * 20 * np.outer(share, back)
                done += 1
        self.table = emb @ out
        self._calibrate([texts[i] for i in (check if len(train) else order)])

    @staticmethod
    def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(_plain(text), np.uint8)
        found = np.concatenate([_buckets(a, n) for n in SIZES])
        at, times = np.unique(found[found >= 0], return_counts=True)
        return at, (times / max(1, times.sum())).astype(np.float32)

    def _calibrate(self, check: list, accuracy: float = 0.99) -> None:
        z = np.array([share @ self.table[at] for (at, share), _ in check])
        y = np.array([y for _, y in check])

        def scores(t: float) -> np.ndarray:
            e = np.exp((z - z.max(axis=1, keepdims=True)) * t)
            return e / e.sum(axis=1, keepdims=True)

        grid = 2.0 ** np.arange(-3, 5.1, 0.5)
        loss = [-np.log(np.maximum(scores(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        best = float(grid[int(np.argmin(loss))])
        self.table *= np.float32(best)
        top = scores(best)
        order = np.argsort(-top.max(axis=1))
        right = np.cumsum((top.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= accuracy)
        self.reject = float(top.max(axis=1)[order][good[-1]]) if len(good) else 1.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        plain = [_plain(t) for t in texts]
        joined = np.frombuffer(b"".join(plain), np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(p) for p in plain]))).astype(np.int64)
        sums, counts = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        for lo in range(0, len(joined), BLOCK):
            hi = min(len(joined), lo + BLOCK)
            first = int(np.searchsorted(begins, lo, "right")) - 1
            marks = np.concatenate(([lo], begins[(begins > lo) & (begins < hi)])) - lo
            rows = np.arange(first, first + len(marks))
            for size in SIZES:
                at = _buckets(joined[lo : hi + size - 1], size)
                inside = marks[marks < len(at)]
                if not len(inside):
                    continue
                good = at >= 0
                values = self.table[np.where(good, at, 0)]
                values[~good] = 0
                sums[rows[: len(inside)]] += np.add.reduceat(values, inside, axis=0)
                counts[rows[: len(inside)]] += np.add.reduceat(good.astype(np.int32), inside)
        z = sums / np.maximum(counts, 1)[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        lang, score = [], []
        for t, k, row in zip(texts, best.tolist(), p):
            none = not self.langs or not t or not any(map(str.isalpha, t))
            lang.append("und" if none else self.langs[k])
            score.append(0.0 if none else float(row[k]))
        return lang, score


def sample_rows(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, lang) of a bounded sample, alike in size for every language, chosen by a hash of the row.

    Every language that has rows takes part; the more there are, the fewer rows has each."""
    fit = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= LONGEST)
    counts = staged(fit.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), "languages")
    langs = counts.count()
    if not langs:
        return []
    rows, chars = max(1, min(per_language, MOST_ROWS // langs)), max(1, MOST_CHARS // langs)
    share = F.least(F.lit(1.0), F.lit(rows) / F.col("n"), F.lit(chars) / F.greatest("chars", F.lit(1)))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_000)) / F.lit(1_000_000)
    shares = bounded_broadcast(counts.select("lang", share.alias("share")), MOST_ROWS)
    drawn = fit.join(shares, "lang").where(draw < F.col("share")).select("text", "lang")
    # equal rows are drawn together, so the bound is put on what is drawn as well
    return sorted((r["text"], r["lang"]) for r in drawn.limit(2 * MOST_ROWS).collect())


def identify(docs: DataFrame, labelled: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted (score reaches the calibrated rejection score)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Subwords(sample_rows(labelled)))

    def run(batches):
        m = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                cut = batch.slice(lo, 250)
                lang, score = m.predict(cut.column(2).to_pylist())
                accepted = [s >= m.reject and k != "und" for k, s in zip(lang, score)]
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), cut.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                    names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean"
    )
