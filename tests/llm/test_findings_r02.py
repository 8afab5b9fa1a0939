"""Tests of what the second round of findings asked for."""

import os
import random

from pyspark.sql import functions as F

from bytelode.llm import components, line_dedup, lm_scoring
from bytelode.llm.common import crc_mod5
from bytelode.sources.staging import shared_folder


def test_texts_are_cut_into_words_once_for_training_and_scoring(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the cat {i % 3} sat on the mat " * (i % 5)) for i in range(60)] + [(None, None)], "doc_id long, text string")
    held, looked = crc_mod5("doc_id") == 1, []
    whole = lm_scoring._looked_up
    monkeypatch.setattr(lm_scoring, "_looked_up", lambda *a: looked.append(1) or whole(*a))
    own = {r["doc_id"]: r for r in lm_scoring.score_documents(df, ~held, held).collect()}
    assert len(looked) == 1 and len(own) == 61
    apart = {r["doc_id"]: r for r in lm_scoring.score_documents(df, df.where(~held), held).collect()}
    for i, r in own.items():
        assert all(r[c] == apart[i][c] for c in ("held_out", "n_tokens", "n_known", "train_tokens"))
        assert abs(r["base_score"] - apart[i]["base_score"]) < 1e-9 and r["score"] < 0
    assert own[None]["n_tokens"] == 1 and not own[None]["held_out"]


def near_lines(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(3, 8)))
    first = [[word() for _ in range(12)] for _ in range(40)]
    other = [[word() if i == rng.randrange(12) else w for i, w in enumerate(words)] for words in first for _ in range(3)]
    texts = ["\n".join(" ".join(w) for w in rng.sample(first + other, 6)) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(texts)) + [(None, None), (90, "")], "doc_id long, text string").coalesce(1)


def test_lines_in_parts_give_what_all_at_once_give(spark, monkeypatch):
    df, parts = near_lines(spark), []
    whole = sorted(map(tuple, line_dedup.dedup_lines(df).collect()), key=str)
    assert sum(n for _, _, n in whole) > 150
    by = components.by_slices
    for module in (components, line_dedup):
        monkeypatch.setattr(module, "by_slices", lambda rows, slices, *a: parts.append(slices) or by(rows, slices, *a))
    monkeypatch.setattr(line_dedup, "LINES_AT_ONCE", 20)
    monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", 20)
    monkeypatch.setattr(line_dedup, "MOST_SENT", 5)
    assert sorted(map(tuple, line_dedup.dedup_lines(df).collect()), key=str) == whole
    assert len(parts) >= 3 and set(parts) == {line_dedup.SLICES}


def test_tables_of_lines_are_let_go(spark):
    folder = shared_folder(spark).removeprefix("file:")
    tables = lambda: {f.rpartition("-")[0] for f in set(os.listdir(folder)) - before}
    before = set(os.listdir(folder))
    made = line_dedup.dedup_lines(near_lines(spark))
    names = {"lines", "keyed", "distinct", "codes", "keys", "buckets", "pairs", "open", "texts", "rows", "drops"}
    assert tables() & names <= {"rows", "drops"}
    assert made.count() == 62


def test_frequent_words_do_not_make_lines_alike(spark):
    """Lines with the same frequent words and other rare ones are no candidates."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(4, 8)))
    often = ["the", "and", "of", "to"] * 20
    rows = [(k, " ".join(rng.sample(words := often + [word() for _ in range(60)], len(words)))) for k in range(30)]
    rows += [(100 + k, " ".join(w if i % 20 else "changed" for i, w in enumerate(t.split(" ")))) for k, t in rows]
    sims = {r["id"]: r["sim"] for r in line_dedup.simhashes(spark.createDataFrame(rows, "id long, norm string")).collect()}
    apart = lambda a, b: (sims[a] ^ sims[b]).bit_count() > line_dedup.CUT_LONG
    other = [apart(a, b) for a in range(30) for b in range(a)]
    assert sum(other) > 0.8 * len(other) and not any(apart(k, 100 + k) for k in range(30))


def test_pieces_confirm_long_lines_and_no_others(spark):
    rng = random.Random(5)

    def edited(t, share):
        out = []
        for c in t:
            r = rng.random() / share if share else 1
            out.append(c if r >= 1 else "" if r < 0.3 else rng.choice("qxz") + (c if r < 0.6 else ""))
        return "".join(out)

    rows = []
    for n in (170, 400, 3000):
        for share in (0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.6):
            for _ in range(5):
                t = "".join(rng.choice("abcdefgh ") for _ in range(n))
                rows.append((t, edited(t, share)))
    line = " ".join(f"w{i}" for i in range(9000))
    rows += [("thor " * 1000 + line, "thor " * 1000 + "hodn " * 1400 + line), (line, line[::-1]), ("a" * 200, "b" * 200), ("x" * 300, ""), ("", "x" * 300)]
    df = spark.createDataFrame(rows, "x string, y string")
    most = F.expr("cast(floor(0.2 * greatest(length(x), length(y)) + 1e-6) as int)")
    tried = [line_dedup.by_pieces(F.col("x"), F.col("y"), most, *how).alias(f"p{k}") for k, (_, *how) in enumerate(line_dedup.PASSAGES)]
    got = df.select("*", *tried, most.alias("most"), F.expr("CASE WHEN length(x) < 10000 THEN levenshtein(x, y) END").alias("d")).collect()
    held = lambda r: any(r[f"p{k}"] for k in range(len(tried)))
    small = [r for r in got if r["d"] is not None]
    assert not [r for r in small if held(r) and r["d"] > r["most"]]
    near = [r for r in small if 2 * r["d"] <= r["most"]]
    assert len(near) > 40 and sum(map(held, near)) > 0.9 * len(near)
    assert [held(r) for r in got[-5:]] == [True, False, False, False, False]
