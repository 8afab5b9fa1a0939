"""Toxicity by maximum-scoring segments (operator 1).

Words, and for long words their first letters, are scored by log-odds between toxic and other
documents under a Dirichlet prior, half a document each and more in proportion to the whole sample; words whose log-odds are
significant keep them, less one standard error, all others cost a little.  One linear scan of a text finds all
its maximal scoring segments.  Segment scores of documents that are not toxic follow an extreme-value
law; its slope and constant turn a segment into an expected number of chance segments as good
in a text of that length, and a logistic curve turns the best of a text into a probability.

Learning takes a bounded sample of labelled rows (``MOST_LABELS``), scoring every whole text.

Nulls: a null or empty text has no segment and gets the score of one; labels that are null are left
out, a document labelled more than once is toxic if any label says so.  Repeated rows are learned from and scored each; an
empty table gives no rows, and without labels every score is the same."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, staged

#: Bound of what is learned from.  The lexicon has every significant token of it.
MOST_LABELS = 200_000
PRIOR, LEAST, SIGNIFICANT, COST, PREFIXES = 500.0, 0.5, 4.0, 0.2, (5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def tokens(word: str) -> list[str]:
    """A word and, marked by a hyphen, its beginnings."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def segments(scores: list[tuple[int, float]], cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose words cost
    ``cost`` each but for those in ``scores`` (place, score > 0); Ruzzo and Tompa's scan, in time
    linear in the scored words."""
    total, last = 0.0, -1
    found: list[list] = []  # first, last, sum before, sum after, nearest one with less before it
    for at, s in scores:
        total -= cost * (at - last - 1)
        last = at
        new = [at, at, total, total + s, -1]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            new[4] = j
            if j < 0 or found[j][3] >= new[3]:
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
        found.append(new)
    return [(a, b, after - before) for a, b, before, after, _ in found]


class Lexicon:
    """Scores of tokens, and of the words seen so far."""

    def __init__(self, score: dict[str, float]):
        self.score, self.words = score, {}

    def word(self, w: str) -> float:
        s = self.words.get(w)
        if s is None:
            if len(self.words) > 500_000:
                self.words.clear()
            s = self.words[w] = max((self.score.get(t, 0.0) for t in tokens(w)), default=0.0)
        return s

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = _WORD.findall(text.lower()) if text else []
        scores = [(i, s) for i, s in enumerate(map(self.word, words)) if s > 0]
        return len(words), segments(scores)


def token_counts(labelled: DataFrame) -> DataFrame:
    """token, toxic, other: documents of ``labelled`` (text, toxic) that have the token."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            names = list(seen[0].keys() | seen[1].keys())
            got = [pa.array([c[t] for t in names], pa.int64()) for c in (seen[1], seen[0])]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *got], names=["token", "toxic", "other"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORD.findall(text.lower())) if text else ()
                seen[int(toxic)].update({t for w in words for t in tokens(w)})
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield out()
        yield out()

    parts = labelled.select("text", "toxic").mapInArrow(run, "token string, toxic long, other long")
    return parts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Tokens whose log-odds with an informative Dirichlet prior are significant.

    The totals come first; the test of each token is a column expression, so only significant tokens reach the
    driver: at least three toxic documents of the bounded sample have each."""
    counts = staged(token_counts(labelled), "tokens")
    nt, nc = counts.agg(F.sum("toxic"), F.sum("other")).first()
    if not nt or not nc:
        return Lexicon({})
    a = F.lit(LEAST) + F.lit(PRIOR) * (F.col("toxic") + F.col("other")) / F.lit(float(nt + nc))
    yt, yc = F.col("toxic") + a, F.col("other") + a
    odds = F.log(yt / (nt + PRIOR - yt)) - F.log(yc / (nc + PRIOR - yc))
    error = F.sqrt(1 / yt + 1 / yc)
    scored = counts.where("toxic >= 3").select("token", odds.alias("odds"), error.alias("error"))
    top = scored.where(F.col("odds") > SIGNIFICANT * F.col("error"))
    return Lexicon({r["token"]: r["odds"] - r["error"] for r in top.collect() if r["odds"] > r["error"] + 2 * COST})


class Calibration:
    """Extreme-value law of segment scores and the logistic curve over it.

    ``slope`` and ``constant`` say how many segments of score s chance gives in n words:
    constant * n * exp(-slope * s)."""

    def __init__(self, rows: list[tuple[float, int, int, float]]):
        """rows: (best score, toxic, documents, their words), of documents grouped by the first two."""
        other = [(s, n, w) for s, t, n, w in rows if not t]
        hits = [(s, n) for s, n, _ in other if s > 0]
        words = sum(w for _, _, w in other) or 1.0
        n = sum(k for _, k in hits)
        self.slope = 1.0 / max(0.5, sum(s * k for s, k in hits) / n) if n else 1.0
        self.constant = max(0.5, float(n)) / words
        x = np.array([self.evidence(s, w / k) for s, _, k, w in rows] or [0.0])
        y, weight = np.array([t for _, t, _, _ in rows] or [0]), np.array([float(k) for _, _, k, _ in rows] or [1.0])
        at = np.array([0.0, float(np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5)))])

        def loss(c: np.ndarray) -> float:
            z = c[0] * x + c[1]
            return float(weight @ (np.logaddexp(0, z) - y * z)) + 5e-4 * float(c @ c)

        for _ in range(60):  # Newton's steps, halved until the loss falls
            p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
            g, v = weight * (y - p), weight * p * (1 - p)
            grad = np.array([g @ x, g.sum()]) - 1e-3 * at
            step = np.linalg.solve(np.array([[v @ (x * x) + 1e-3, v @ x], [v @ x, v.sum() + 1e-3]]), grad)
            while loss(at + step) > loss(at) and abs(step).max() > 1e-9:
                step /= 2
            at = at + step
        self.a, self.b = max(0.0, float(at[0])), float(at[1])

    def evidence(self, score: float, words: float) -> float:
        """Minus the log of the probability that chance gives such a segment in so many words."""
        if score <= 0:
            return 0.0
        expected = self.constant * max(words, 1.0) * math.exp(-min(self.slope * score, 500.0))
        return -math.log(max(-math.expm1(-expected), 1e-12))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * evidence + self.b))))


def _best(labelled: DataFrame, lexicon: Lexicon) -> list[tuple[float, int, int, float]]:
    """Documents counted by their best score, in steps of a quarter, and label."""
    shared = labelled.sparkSession.sparkContext.broadcast(lexicon.score)

    def run(batches):
        own = Lexicon(shared.value)
        for batch in batches:
            found = [own.segments(t) for t in batch.column(0).to_pylist()]
            best = [round(max((s for *_, s in seg), default=0.0) * 4) / 4 for _, seg in found]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), batch.column(1), pa.array([float(n) for n, _ in found])], names=["best", "toxic", "words"])

    rows = labelled.select("text", "toxic").mapInArrow(run, "best double, toxic int, words double")
    grouped = rows.groupBy("best", "toxic").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    return sorted((r["best"], r["toxic"], r["n"], r["words"]) for r in grouped.collect())


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """text and toxic of at most about ``most`` labelled documents, drawn by a hash of the number.

    The labels' side is what is bounded, so it is the one broadcast; texts are not shuffled."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    drawn = known.where(draw < F.lit(math.ceil(1_000_000 * min(1.0, most / max(n, 1)))))
    return docs.select("doc_id", "text").join(bounded_broadcast(staged(drawn, "labels"), 2 * most), "doc_id").select("text", "toxic")


def score_toxicity(docs: DataFrame, train: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and passages (first and last word, score).

    ``train`` has text and toxic (0 or 1)."""
    lexicon = learn_lexicon(train)
    calibration = Calibration(_best(train, lexicon))
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.score, calibration))

    def run(batches):
        score, law = shared.value
        own = Lexicon(score)
        for batch in batches:
            out, passages = [], []
            for text in batch.column(2).to_pylist():
                n, found = own.segments(text)
                evidence = [law.evidence(s, n) for *_, s in found]
                out.append(law.probability(max(evidence, default=0.0)))
                # significant: chance gives fewer than one such segment in twenty texts like this
                passages.append([{"first": a, "last": b, "score": s} for (a, b, s), e in zip(found, evidence) if e >= -math.log(0.05)])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(out, pa.float64()),
                    pa.array([int(x >= 0.5) for x in out], pa.int32()),
                    pa.array([len(x) for x in passages], pa.int32()),
                    pa.array(passages, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))),
                ],
                names=["doc_id", "held_out", "score", "predicted", "n_passages", "passages"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages int, passages array<struct<first int, last int, score double>>"
    )
