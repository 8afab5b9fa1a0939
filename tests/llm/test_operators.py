"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows, no rows
at all and extra columns, against brute force where there is an answer to compare with."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bytelode.llm import decontamination, html_text, language, line_dedup, lm_scoring, neardup, packing, quality, tool_calls, toxicity
from bytelode.llm import queries as corpus
from bytelode.llm.common import crc_mod5

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, comp string, d double"
LONG = " ".join(f"w{i % 997} and" for i in range(30_000))


def odd_rows():
    texts = {
        1: None,
        2: "",
        3: " \n\t ",
        4: "One",
        5: "The quick brown fox jumps over the lazy dog near the river bank\nand a second line that is long enough to count",
        6: "The quick brown fox jumps over the lazy dog near the river bank\nand a second line that is long enough to count",
        7: "THE QUICK brown fox jumps over the lazy dog near the river bank\nand a second line that is long enough to count today",
        8: LONG,
        9: "a b a b a b a b a b a b a b",
        10: "Ünï cödé wörds ärę nöt ASCII bût wörds áll thé säme yes",
    }
    rows = [(i, t, None if i == 4 else "en", "s", None, i, "k", "c", 0.0) for i, t in texts.items()]
    return rows + [rows[4], (None, texts[5], None, None, None, 0, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).coalesce(2).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def words(text):
    return text.encode().lower().split() if text else []


def test_packing(odd, none, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(corpus.tokenizer_path())
    assert packing.pack(none, corpus.tokenizer_path(), 512).count() == 0
    for df in (odd, docs):
        rows = packing.pack(df, corpus.tokenizer_path(), 512).collect()
        want = Counter()
        for r in df.collect():
            ids = np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
            for k, at in enumerate(range(0, len(ids), 512)):
                part = ids[at : at + 512]
                want[(r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        by = defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 512
        assert len(by) <= 1.02 * sum(r["length"] for r in rows) / 512 + 2


def components(texts, width, percent):
    """Brute force: for each text the least index it is connected with."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(odd, none, docs, width):
    assert neardup.near_duplicates(none).count() == 0
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        sizes, comp = components([r["text"] for r in rows], width, 80)
        least = defaultdict(set)
        for r, c in zip(rows, comp):
            least[c].add(r["doc_id"])
        want = Counter((r["doc_id"], n, min((i for i in least[c] if i is not None), default=None)) for r, n, c in zip(rows, sizes, comp))
        got = neardup.near_duplicates(df, width).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_hot_group_of_near_copies(spark):
    base = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in ((i, i % 200) for i in range(120))]
    rows += [(200 + i, " ".join(f"x{i}y{j}" for j in range(50))) for i in range(20)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 200} == {0}
    assert all(r["kept"] for r in got if r["doc_id"] >= 200)


def test_keep_one(odd):
    left = neardup.keep_one(odd, 2).collect()
    assert Counter(r["doc_id"] for r in left) == Counter([1, 2, 3, 4, 5, 8, 9, 10])
    assert left[0].asDict().keys() == set(odd.columns)


def test_line_dedup(spark, odd, none):
    assert line_dedup.dedup_lines(none).count() == 0
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {*odd.columns, "n_dropped"}
    full = odd_rows()[4][1].split("\n")
    kept = Counter(line for r in rows if r["text"] for line in r["text"].split("\n"))
    assert kept[full[0]] + kept["THE QUICK brown fox jumps over the lazy dog near the river bank"] == 1
    assert sum(n for line, n in kept.items() if line.startswith("and a second line")) == 1
    assert [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"] or 0) if r["doc_id"] in (1, 2, 3, 4, 8)] == [r[1] for r in odd_rows() if r[0] in (1, 2, 3, 4, 8)]
    other = spark.createDataFrame([(1, "x\n\nshort\nshort\n12 34\n12 34")], "doc_id long, text string")
    assert line_dedup.dedup_lines(other).first()["text"] == "x\n\nshort\nshort\n12 34\n12 34"


def test_line_links_hold(docs):
    """Every dropped line has a kept one within the edit similarity somewhere in its group; exact
    repeats always go."""
    rows = line_dedup.dedup_lines(docs.select("doc_id", "text")).collect()
    norm = lambda line: re.sub(r"[^\w]|_", " ", re.sub(r"\d", "0", line.lower()))
    plain = Counter(" ".join(norm(line).split()) for r in rows for line in r["text"].split("\n"))
    assert not [x for x, n in plain.items() if n > 1 and len(x) >= 20]


def test_quality_counts(odd, none):
    assert quality.verdicts(none).count() == 0
    want = Counter()
    for r in odd.collect():
        t = r["text"] or ""
        w = re.findall(r"[^ \t-\r]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        full = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        want[(r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(again), failed)] += 1
    got = quality.verdicts(odd).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in got)


def test_quality_rejects_outliers(spark):
    rng = np.random.default_rng(1)
    clean = [(i, " ".join("abcdefgh"[: rng.integers(2, 9)] + str(rng.integers(0, 9999)) for _ in range(60)), "en", f"s{i % 2}") for i in range(400)]
    junk = [(1000 + i, " ".join(f"### $$$ {rng.integers(0, 9999)} |||" for _ in range(40)), "en", "s0") for i in range(40)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(df).collect()}
    assert not any(got[i] for i in range(1000, 1040)) and sum(got[i] for i in range(400)) >= 399
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == {i for i, k in got.items() if k}


def test_language_model(odd, none, docs):
    assert lm_scoring.score_documents(none, none, crc_mod5("doc_id") == 1).count() == 0
    for df in (docs, odd):
        train = df.where(crc_mod5("doc_id") != 1)
        counts, ids = Counter(), [r["text"] for r in train.collect()]
        for t in ids:
            counts.update(words(t) + [None])
        n, v = sum(counts.values()), len(counts)
        got = sorted(lm_scoring.score_documents(df, train, crc_mod5("doc_id") == 1).collect(), key=lambda r: (r["doc_id"] or 0, r["n_tokens"]))
        want = sorted(df.collect(), key=lambda r: (r["doc_id"] or 0, len(words(r["text"]))))
        for r, w in zip(got, want, strict=True):
            tokens = words(w["text"]) + [None]
            base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
            assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (w["doc_id"], len(tokens), sum(x in counts for x in tokens), n)
            assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] <= 0
        if df is docs:
            held = [r for r in got if r["held_out"]]
            assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_toxicity(spark, odd, none, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train = toxicity.labelled_sample(docs, labels)
    got = toxicity.score_toxicity(odd, train, crc_mod5("doc_id") == 0).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.score_toxicity(none, toxicity.labelled_sample(none, labels.limit(0)), F.lit(False)).count() == 0


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in corpus.op1_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in got) >= 0.9 * len(got)


def test_language(odd, none, docs):
    assert language.identify(none, none, F.lit(False)).count() == 0
    held = crc_mod5("doc_id") == 0
    got = {r["doc_id"]: r for r in language.identify(docs, docs.where(~held), held).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    mine = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in mine) >= 0.95 * len(mine)
    rows = language.identify(odd, docs, held).collect()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3}


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(7, odd_rows()[4][1][:60].upper()), (8, None), (9, ""), (10, "tiny")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.leaks(odd, items).collect())
    assert got == Counter({(5, 7, 0): 2, (6, 7, 0): 1, (7, 7, 0): 1, (None, 7, 0): 1})
    assert decontamination.leaks(none, items).count() == decontamination.leaks(odd, items.limit(0)).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article><p>a  b</p></article>"), (3, "u", "<article><p>a  b</p></article>")], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in html_text.extract(pages).fillna("-", ["url"]).collect())
    assert got == [(1, "u", "", 0), (2, "-", "", 0), (3, "u", "a b", 3), (3, "u", "a b", 3)]


def test_html_pages(spark):
    """The synthetic pages keep all of their article and nothing else."""
    import html

    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        plain = re.sub(r"<(?!/?(?:b|i|a)>)[^>]*>", " ", inside)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", plain)).split())


def test_tool_calls(spark):
    turns = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"add","arguments":{"y":2,"x":1}},{"id":"b","name":"add","arguments":{"x":"no"},"depends_on":["a"]}]}'),
        (1, 2, "tool", '{"tool_call_id":"b","content":"late"}'),
        (1, 3, "tool", '{"tool_call_id":"a","content":"3"}'),
        (1, 4, "assistant", '{"tool_calls":[{"id":"a","name":"none","arguments":{}},{"id":"c","name":"add","arguments":{"x":1,"y":1},"depends_on":["d"]},{"id":"d","name":"add","arguments":{"x":1,"y":1},"depends_on":["c"]}]}'),
        (2, 0, "tool", '{"tool_call_id":"a","content":"other conversation"}'),
        (2, 1, None, None),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    schema = {"add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}}}
    rows = tool_calls.link(tool_calls.embedded_calls(df), tool_calls.embedded_results(df), schema).collect()
    got = {(r["conv_id"], r["turn"], r["kind"], r["call_id"]): (r["level"], r["linked"], r["status"]) for r in rows}
    assert got == {
        (1, 1, 0, "a"): (0, True, "ok"),
        (1, 1, 0, "b"): (1, True, "invalid"),
        (1, 2, 1, "b"): (1, True, "ok"),
        (1, 3, 1, "a"): (0, True, "ok"),
        (1, 4, 0, "a"): (0, False, "duplicate"),
        (1, 4, 0, "c"): (-1, False, "pending"),
        (1, 4, 0, "d"): (-1, False, "pending"),
        (2, 0, 1, "a"): (0, False, "orphan"),
    }
    assert '{"arguments":{"x":1,"y":2},"id":"a","name":"add"}' in {r["json"] for r in rows}
    assert tool_calls.link(tool_calls.embedded_calls(df.limit(0)), tool_calls.embedded_results(df.limit(0)), schema).count() == 0


def test_tool_call_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got, want = corpus.op5_tool_call_linking(spark, SF).toPandas(), db.execute(corpus.SQL["op5_tool_call_linking"]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_pipeline_stages(spark, docs, odd, tmp_path):
    """Each stage keeps the columns and only takes rows away, and run() gives what the stages give."""
    kept = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in kept.collect()}
        stage(spark, kept, SF).write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        assert {r["doc_id"] for r in kept.collect()} <= before
        if i + 1 < len(corpus_pipeline.STAGES):
            assert kept.columns == corpus_pipeline.COLUMNS, name
    mark = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert mark(kept) == mark(corpus_pipeline.run(spark, SF))
    odd.write.parquet(f"{tmp_path}/odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/odd"), SF).count() <= odd.count()
    assert corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{tmp_path}/odd"), SF).count() >= odd.count()
