"""Document log-likelihood under a gated recurrent language model (operator 4).

Words are counted over all training documents.  The most frequent are the model's own words; the
others fall into tail classes by their first and last byte, and within a class a word has its share
of the class's count, half a count added to each and half kept for an unknown word.  So the softmax is
factored by classes throughout, and every text, unknown words included, has a probability.

A bounded draw of documents gives all tasks the same start.  Then each task makes one pass of truncated
backpropagation over its training documents, and the tasks' parameters are averaged by their tokens:
every training document takes part, and what is gathered grows with the input.  Scoring carries the
state across windows through each whole document.

The counts of a bounded head of words go to all tasks; the counts of all others are joined.  Texts are cut into words for the counts,
and once more for the ids that training and scoring read, two bytes each.

Each task trains apart, so scores depend a little on how the documents are dealt out; the probability of each text is whole
whatever the dealing.

Nulls: a null or empty text is the end mark alone; a null ``doc_id`` is in no fold, hence learned from and not
held out.  Repeated rows are documents of their own.  Long words are joined by a 128-bit digest.  An empty table gives no rows,
and without training documents the model is the unigram one."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, words_of
from .recurrent import Gru

#: Words of the model with the end mark, tail classes, words whose counts every task holds, and the documents and
#: characters of one of them that the common start is fitted on.
WORDS, TAILS, HEAD, START_DOCS, START_CHARS = 1024, 16, 49_152, 1500, 32_768
#: Not UTF-8, so no word: the end mark, and what stands before the digest of a long word.
END, LONG = b"\xfe", b"\xff"
CHUNK = 8192


def key_of(word: bytes) -> bytes:
    return word if len(word) <= 40 else LONG + hashlib.blake2b(word, digest_size=16).digest()


def tail_of(word: bytes) -> int:
    return (word[0] * 5 + word[-1]) % TAILS


def word_counts(train: DataFrame) -> DataFrame:
    """key, tail, n over all texts of ``train``, the end mark of each included (tail -1)."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: Counter = Counter()

        def out():
            keys = [w if len(w) <= 40 else key_of(w) for w in seen]
            tails = [tail_of(w) if w != END else -1 for w in seen]
            times = list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(tails, pa.int32()), pa.array(times, pa.int64())], names=["key", "tail", "n"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                seen[END] += 1
                if len(seen) > 300_000:
                    yield out()
        yield out()

    return train.select("text").mapInArrow(run, "key binary, tail int, n long").groupBy("key", "tail").agg(F.sum("n").alias("n"))


class Words(dict):
    """key to its place in the head; of other words minus their class, less one."""

    def __missing__(self, word: bytes) -> int:
        found = self.get(key_of(word)) if len(word) > 40 else None
        return -1 - tail_of(word) if found is None else found


class Vocabulary:
    """Ids and shares of the head's words; totals of tail classes; sums over the corpus."""

    def __init__(self, counts: DataFrame):
        head = counts.where("tail >= 0").orderBy(F.desc("n"), "key").limit(HEAD).collect()
        self.n, self.v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        ends = counts.where("tail < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.known_end = ends > 0
        self.log_end = math.log10(ends + 0.5)
        totals, kinds = np.zeros(TAILS), np.zeros(TAILS)
        for r in counts.where("tail >= 0").groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            totals[r["tail"]], kinds[r["tail"]] = r["n"], r["v"]
        own = head[: WORDS - 1]
        for r in own:
            totals[r["tail"]] -= r["n"]
            kinds[r["tail"]] -= 1
        self.log_tail = np.log10(totals + 0.5 * kinds + 0.5)
        self.counts = np.concatenate([[ends], [r["n"] for r in own], np.zeros(WORDS - 1 - len(own)), totals])
        self.words = Words({bytes(r["key"]): i for i, r in enumerate(head)})
        # for every place of the head, then for every other word by its class (places count from the end): the id,
        # log10 of the count and a half, and that less the log10 of its class where it is no word of the model
        tails, logs = np.array([r["tail"] for r in head[len(own) :]], np.int32), np.log10(np.array([r["n"] for r in head], float) + 0.5)
        others = np.arange(TAILS)[::-1]
        self.id = np.concatenate([np.arange(1, len(own) + 1), WORDS + tails, WORDS + others]).astype(np.int32)
        self.log = np.concatenate([logs, np.zeros(TAILS)])
        self.rest = np.concatenate([np.zeros(len(own)), logs[len(own) :] - self.log_tail[tails], -self.log_tail[others]])
        self.log_all = math.log10(self.n + 0.5 * (self.v + 1))

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.append(self.id[self.places(words)], np.int32(0))


def unpacked(ids: pa.Array) -> list[np.ndarray]:
    """The ids of each document, of two bytes each."""
    return [np.frombuffer(x, np.uint16).astype(np.int32) for x in ids.to_pylist()]


def _task_models(train: DataFrame, start: Callable[[], Gru]) -> DataFrame:
    """part, chunk, weight, values: each task's parameters after its pass over ``train`` (ids)."""

    def run(batches):
        model = start()
        squares, weight = model.fresh_squares(), 0
        for batch in batches:
            docs = unpacked(batch.column(0))
            if docs:
                model.train(docs, squares, rate=0.05)
                weight += sum(map(len, docs))
        flat = model.flat()
        if weight:
            rows = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()] * n, pa.int32()),
                    pa.array(range(n), pa.int32()),
                    pa.array([float(weight)] * n),
                    pa.array([r.tolist() for r in rows], pa.list_(pa.float32())),
                ],
                names=["part", "chunk", "weight", "values"],
            )

    return train.select("ids").mapInArrow(run, "part int, chunk int, weight double, values array<float>")


def _mean(parts: DataFrame, *by: str) -> DataFrame:
    def mean(group: pd.DataFrame) -> pd.DataFrame:
        weight = group["weight"].to_numpy()
        values = sum(w * np.asarray(v, np.float64) for w, v in zip(weight, group["values"])) / weight.sum()
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) % 256], "chunk": [group["chunk"].iloc[0]], "weight": [weight.sum()], "values": [values.astype(np.float32)]})

    return parts.groupBy(*by).applyInPandas(mean, "part int, chunk int, weight double, values array<float>")


def started(train: DataFrame, vocabulary: Vocabulary) -> Gru:
    """A model fitted on a bounded draw of the training documents: what all tasks start from."""
    model = Gru(vocabulary.counts, WORDS)
    n = train.count()
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1_000_000))
    first = train.where(F.length("text") <= START_CHARS).where(draw < math.ceil(1_000_000 * min(1.0, START_DOCS / max(1, n))))
    # equal rows are drawn together, so the bound is put on what is drawn as well; every document is trained on later
    docs = [vocabulary.ids(words_of(t)) for t in sorted(r["text"] for r in first.select("text").limit(2 * START_DOCS).collect())]
    if docs:
        squares = model.fresh_squares()
        for _ in range(2):
            model.train(docs, squares)
    return model


def fit(train: DataFrame, vocabulary: Vocabulary, model: Gru) -> np.ndarray:
    """The averaged parameters, of bounded size, from ``model`` and the ids of all training documents."""
    shared = train.sparkSession.sparkContext.broadcast((vocabulary.counts, model.flat()))

    def start() -> Gru:
        counts, flat = shared.value
        own = Gru(counts, WORDS)
        own.set_flat(flat)
        return own

    parts = _task_models(train, start).withColumn("part", F.pmod("part", F.lit(256)))
    chunks = _mean(_mean(parts, "chunk", "part"), "chunk").select("chunk", "values").collect()
    return np.concatenate([np.asarray(r["values"], np.float32) for r in sorted(chunks, key=lambda r: r["chunk"])]) if chunks else model.flat()


def _looked_up(docs: DataFrame, train: Column, held_out: Column, vocabulary: Vocabulary) -> DataFrame:
    """The ids of every document, what the head says of its words, and the words outside the head; texts are cut into words once for
    training and scoring."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared.value
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                cut = batch.slice(lo, 1000)
                ids, sizes, known, base, rest, keys, times = [], [], [], [], [], [], []
                for text in cut.column(3).to_pylist():
                    words = words_of(text)
                    found = v.places(words)
                    others = Counter([key_of(words[i]) for i in np.flatnonzero(found < 0).tolist()])
                    ids.append(np.append(v.id[found], np.int32(0)).astype(np.uint16).tobytes())
                    sizes.append(len(words) + 1)
                    known.append(len(words) - others.total() + v.known_end)
                    base.append(float(v.log[found].sum()) + v.log_end)
                    rest.append(float(v.rest[found].sum()))
                    keys.append(list(others))
                    times.append(list(others.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range((part << 40) + nth, (part << 40) + nth + len(ids)), pa.int64()),
                        *cut.columns[:3],
                        pa.array(ids, pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(rest, pa.float64()),
                        pa.array(keys, pa.list_(pa.binary())),
                        pa.array(times, pa.list_(pa.int64())),
                    ],
                    names=["row", "doc_id", "held_out", "train", "ids", "n_tokens", "known", "base", "rest", "keys", "times"],
                )
                nth += len(ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out.alias("held_out"), train.alias("train"), "text").mapInArrow(
        run,
        f"row long, doc_id {kind}, held_out boolean, train boolean, ids binary, n_tokens long, known long, base double, rest double, keys array<binary>, times array<long>",
    )


def _scored(docs: DataFrame, counts: np.ndarray, flat: np.ndarray) -> DataFrame:
    """row, doc_id, held_out, n_tokens, known, base and score of ``_looked_up`` documents, words outside the head as their classes."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, flat))

    def run(batches):
        counts, flat = shared.value
        model = Gru(counts, WORDS)
        model.set_flat(flat)
        for batch in batches:
            if batch.num_rows:
                score = model.score(unpacked(batch.column(0))) / math.log(10) + batch.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(score, pa.float64())], names=[*batch.schema.names[2:], "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("ids", "rest", "row", "doc_id", "held_out", "n_tokens", "known", "base").mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double"
    )


def score_documents(docs: DataFrame, train: DataFrame | Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, learned from ``train``: documents, or the
    condition that tells those of ``docs``, whose texts are then cut into words once for both."""
    own = isinstance(train, Column)
    texts = docs.where(train) if own else train
    counts = staged(word_counts(texts), "words")
    vocabulary = Vocabulary(counts)
    model = started(texts, vocabulary)
    known = staged(_looked_up(docs, train if own else F.lit(False), held_out, vocabulary), "known")
    taught = known.where("train") if own else _looked_up(train, F.lit(True), F.lit(False), vocabulary)
    flat = fit(taught, vocabulary, model)
    made = staged(_scored(known, vocabulary.counts, flat), "scores")
    words = known.select("row", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("row", F.col("w.keys").alias("key"), F.col("w.times").alias("times"))
    found = words.join(counts.select("key", "n"), "key", "left").select(
        "row",
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log"),
    )
    sums = found.groupBy("row").agg(F.sum("known").alias("known_more"), F.sum("log").alias("log"))
    more = F.coalesce("log", F.lit(0.0))
    return made.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(vocabulary.log_all)).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
