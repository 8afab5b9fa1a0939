"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, language, line_dedup, lm_scoring, neardup, packing, quality, tool_calls, toxicity
from .common import crc_mod5, dealt, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    train = toxicity.labelled_sample(docs.where(crc_mod5("doc_id") != 0), labels)
    return toxicity.score_toxicity(docs, train, crc_mod5("doc_id") == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(dealt(table(spark, sf_dir, "documents")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    return lm_scoring.score_documents(docs, crc_mod5("doc_id") != 1, crc_mod5("doc_id") == 1)


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    calls, results = tool_calls.replies_as_calls(turns)
    calls = calls.unionByName(tool_calls.embedded_calls(turns))
    results = results.unionByName(tool_calls.embedded_results(turns))
    linked = tool_calls.link(calls, results, tool_calls.REPLY)
    return linked.withColumn("n_errors", F.size("errors")).drop("errors")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(dealt(table(spark, sf_dir, "pages")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    return language.identify(docs, docs.where(crc_mod5("doc_id") != 0), crc_mod5("doc_id") == 0)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("row", "comp")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(dealt(table(spark, sf_dir, "documents")), tokenizer_path(), 4096)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_line_dedup,
        op3_quality_rules,
        op4_lm_scoring,
        op5_tool_call_linking,
        op6_html_extraction,
        op7_language_id,
        op8_benchmark_decontamination,
        op9_minhash_near_dedup,
        op10_best_fit_packing,
    )
}
#: Where SQL can say the same; the other operators are tested against brute force.
SQL: dict[str, str] = {
    "op5_tool_call_linking": """
WITH calls AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS call_id, text FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
firsts AS (SELECT conv_id, call_id, min(turn) AS call_turn FROM calls GROUP BY ALL),
answered AS (SELECT DISTINCT conv_id, call_id FROM results)
SELECT c.conv_id, 0 AS level, c.turn AS place, 0 AS kind, c.turn, c.call_id, a.call_id IS NOT NULL AS linked,
  CASE WHEN coalesce(c.text, '') = '' THEN 'invalid' WHEN a.call_id IS NULL THEN 'pending' ELSE 'ok' END AS status,
  '{"arguments":' || CASE WHEN c.text IS NULL THEN '{}' ELSE to_json({'text': c.text}) END || ',"id":' || to_json(c.call_id) || ',"name":"reply"}' AS json,
  CASE WHEN coalesce(c.text, '') = '' THEN 1 ELSE 0 END AS n_errors
FROM calls c LEFT JOIN answered a USING (conv_id, call_id)
UNION ALL
SELECT r.conv_id, 0, greatest(r.turn, f.call_turn), 1, r.turn, r.call_id, f.call_turn IS NOT NULL,
  CASE WHEN f.call_turn IS NULL THEN 'orphan' ELSE 'ok' END,
  '{"content":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || ',"tool_call_id":' || to_json(r.call_id) || '}', 0
FROM results r LEFT JOIN firsts f USING (conv_id, call_id)
""",
}
