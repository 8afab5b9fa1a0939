"""Tests of what the third round of findings asked for."""

import random

from pyspark.sql import functions as F

from bytelode.llm import components, line_dedup
from bytelode.llm.common import numbered


def words(rng, n):
    return ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(4, 8))) for _ in range(n)]


def test_lines_are_normalised_once(spark):
    """An inner explode has Spark work out its array once more, to ask if it is empty."""
    docs = spark.createDataFrame([(1, "Some line of a text")], "doc_id long, text string")
    plan = line_dedup.lines(numbered(docs), 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 2
    rows = spark.createDataFrame([(1, "some line of a text")], "id long, norm string")
    assert line_dedup.simhashes(rows)._jdf.queryExecution().executedPlan().toString().count("array_distinct(") <= len(line_dedup.LANES)


def test_passage_at_other_places_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(11)
    passage, texts = words(rng, 6), []
    for k in range(60):
        own = words(rng, 14)
        texts.append(" ".join(passage + own if k % 2 else own + passage))
    asked, linked = [], line_dedup.linked
    monkeypatch.setattr(line_dedup, "linked", lambda rows, near, verify, **how: linked(rows, near, lambda p: asked.append(p.count()) or verify(p), **how))
    made = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    assert made.where("n_dropped > 0").count() == 0
    assert sum(asked) < 30 * 29  # those with the passage at the same place


def test_lines_on_both_sides_of_the_longest_short_one_are_linked(spark):
    rng, texts = random.Random(12), []
    for _ in range(20):
        line = " ".join(words(rng, 40))[:155].strip()
        texts += [line, line[:60] + " another word" + line[60:], line[:90] + line[100:]]
    made = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    assert made.where("n_dropped > 0").count() == 40


def test_few_edges_are_linked_as_many_are(spark, monkeypatch):
    rng = random.Random(13)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "u long, v long")
    here = sorted(map(tuple, components.components(edges).collect()))
    some, others = edges.limit(120), edges.exceptAll(edges.limit(120))
    added = sorted(map(tuple, components.joined(components.components(some), others).collect()))
    monkeypatch.setattr(components, "LOCAL", -1)
    assert sorted(map(tuple, components.components(edges).collect())) == here == added
    names = edges.select(*(F.format_string("%05d", i).cast("binary").alias(i) for i in "uv"))
    far = sorted((bytes(a), bytes(b)) for a, b in components.components(names).collect())
    monkeypatch.setattr(components, "LOCAL", 1000)
    assert sorted((bytes(a), bytes(b)) for a, b in components.components(names).collect()) == far
