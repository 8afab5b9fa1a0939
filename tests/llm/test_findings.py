"""Fuzzy line links against brute force, on lines with edits planted in words and characters."""

import random

import pytest

import corpus_pipeline
from bytelode.llm import html_text, line_dedup, neardup, tool_calls

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def typo(rng, word):
    k = rng.randrange(len(word))
    return word[:k] + rng.choice("qxzjv") + word[k + 1 :]


def test_line_links_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(3, 8)))
    texts = []
    for _ in range(25):
        words = [word() for _ in range(10)]
        half, few = set(rng.sample(range(10), 5)), rng.randrange(10)
        texts += [
            " ".join(words),
            " ".join(typo(rng, w) if i in half else w for i, w in enumerate(words)),
            " ".join(word() if i == few else w for i, w in enumerate(words)),
        ]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            most = max(len(a), len(b)) // 5
            if abs(len(a) - len(b)) <= most and find(i) != find(j) and distance(a, b) <= most:
                up[max(find(i), find(j))] = min(find(i), find(j))
    want = {find(i) for i in range(len(texts))}
    assert len(want) < 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = {r["doc_id"] for r in line_dedup.dedup_lines(df).collect() if r["text"]}
    assert want <= kept and len(kept - want) <= 3  # of 50 copies; keys and SimHash are no certainty


def test_near_copies_of_long_lines_are_linked(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(6)) for _ in range(1300)]
    copy = [w if i % 50 else "changed" for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy))], "doc_id long, text string").coalesce(1)
    assert len(" ".join(words)) > 8192
    assert [r["n_dropped"] for r in line_dedup.dedup_lines(df).orderBy("doc_id").collect()] == [0, 1]


def test_stages_tell_rows_with_null_or_equal_ids_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    ids = [(None, 1), (None, 2), (7, 3), (7, 4), (7, 4), (5, 5), (None, 5)]
    rows = [(i, text(k), "en", "s", None) for i, k in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = neardup.keep_one(df).collect()
    assert sorted(r["text"] for r in left) == sorted(text(k) for k in range(1, 6))
    assert [r["doc_id"] for r in left if r["text"] == text(5)] == [5]
    leaked = spark.createDataFrame([(i, item, "en", "s", None) for i in (None, 7)], df.schema)
    clean = corpus_pipeline.decontaminate(spark, df.unionByName(leaked), SF).collect()
    assert sorted(r["text"] for r in clean) == sorted(r[1] for r in rows)


def test_of_calls_of_one_turn_the_first_is_linked(spark):
    turns = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":2}},{"id":"a","name":"f","arguments":{"x":1}}]}'),
        (1, 1, "tool", '{"tool_call_id":"a","content":"3"}'),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = tool_calls.link(tool_calls.embedded_calls(df), tool_calls.embedded_results(df), {"f": {}}).where("kind = 0").collect()
    assert {(r["json"][13:20], r["linked"], r["status"]) for r in rows} == {('{"x":2}', True, "ok"), ('{"x":1}', False, "duplicate")}


BODY, PART = ("A sentence of the article. " * 9).strip(), ("The second part goes on. " * 5).strip()


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<div class='post-content'><p>{BODY}</p></div><article><p>teaser</p></article>", BODY),
        (f"<article><p>{BODY}</p></article><article><p>{PART}</p></article>", f"{BODY} {PART}"),
        (f"<div class='entry-content'>{PART}</div><div class='entry-content'>{BODY}</div>", f"{PART} {BODY}"),
        (f"<main><h1>Head</h1><p>{BODY}</p><article>teaser</article></main>", f"Head {BODY} teaser"),
        (f"<article>teaser</article><nav>x</nav><nav>x</nav><nav>x</nav><div><p>{BODY}</p><p>{PART}</p></div>", f"{BODY} {PART}"),
        (f"<main><article><p>{BODY}</p></article><p>more</p></main>", BODY),
    ],
)
def test_holders_are_hints(page, text):
    assert html_text.main_text(page) == text
