"""The pN_ queries on text, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, table
from . import abuse, conversations, mixing, overlap, packing, pairs, pii, sizes, truncation


def _users(spark: SparkSession, d: str) -> DataFrame:
    return pii.user_texts(*[table(spark, d, t) for t in ("generic_log", "openai_chat", "inference")])


_KEYS = {k: F.col for k in ("source_table", "row_no", "item_pos")}


def _keys() -> dict:
    return {k: F.col(k) for k in _KEYS}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per personal mention in what users wrote."""
    return pii.find_pii(_users(spark, d), _keys(), F.col("body")).select("source_table", "row_no", "item_pos", "pii_type", "start_char")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Each text with typed placeholders in the place of its mentions."""
    return pii.redact_pii(_users(spark, d), _keys(), F.col("body"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The turns of every intact conversation."""
    return conversations.rebuild_log(spark, f"{d}/otel_events.parquet", table(spark, d, "otel_events").schema)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one training and one evaluation row that ask the same question."""
    found = overlap.overlaps(table(spark, d, "labeled_inference"))
    return found.select(F.least("eval_row", "train_row").alias("row_a"), F.greatest("eval_row", "train_row").alias("row_b"))


def p4_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source, how many evaluation rows also stand in training."""
    labeled = table(spark, d, "labeled_inference")
    return overlap.overlap_report(labeled, overlap.overlaps(labeled))


def _models(spark: SparkSession, d: str) -> DataFrame:
    return truncation.model_texts(*[table(spark, d, t) for t in ("openai_chat", "generic_log", "inference")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each defective prompt and answer pair with its defect."""
    cut = truncation.cut_texts(_models(spark, d).drop("source")).where("source_table = 'inference'")
    asked = table(spark, d, "inference").select("row_no", "question", "prompt", F.col("generated_answer").alias("answer"))
    return pairs.broken_pairs(asked, cut)


def p5_defect_rates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of each defect per source."""
    src = table(spark, d, "inference").select("row_no", F.coalesce("source", F.lit("")).alias("source"))
    return p5_found(spark, d).join(src, "row_no").groupBy("source", "defect").agg(F.count(F.lit(1)).alias("pairs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Model texts that were cut before their end."""
    return truncation.cut_texts(_models(spark, d).drop("source")).select("source_table", "row_no", "item_pos")


def p6_cut_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each provider or source cuts."""
    return truncation.cut_rates(_models(spark, d))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return sizes.token_sizes(table(spark, d, "documents"))


def p8_pack_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a bin of each kind of container."""
    return packing.pack(_sizes(spark, d), table(spark, d, "container_size"))


def p8_fill_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(materialise(p8_pack_documents(spark, d), "packed"), table(spark, d, "container_size"))


def p9_mix_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The mixed documents in order of the schedule."""
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_target"))


def p9_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.shares(p9_mix_schedule(spark, d), table(spark, d, "mix_target"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return abuse.flagged(abuse.score(table(spark, d, "documents")))


def p10_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of such documents per source."""
    return abuse.rates(abuse.score(table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_redacted, p2_found, p4_found, p4_overlap_report, p5_found, p5_defect_rates, p6_found, p6_cut_rates, p8_pack_documents, p8_fill_report, p9_mix_schedule, p9_mix_shares, p10_found, p10_source_rates)
    return {f.__name__: f for f in named}


_P2 = r"""
WITH kinds(name, kind) AS (VALUES ('gen_ai.system.message', 'system'), ('gen_ai.user.message', 'user'), ('gen_ai.assistant.message', 'assistant'), ('gen_ai.choice', 'assistant'), ('gen_ai.tool.message', 'tool')),
roles(said, role) AS (VALUES ('system', 'system'), ('developer', 'system'), ('user', 'user'), ('human', 'user'), ('assistant', 'assistant'), ('ai', 'assistant'), ('model', 'assistant'), ('bot', 'assistant'), ('tool', 'tool'), ('function', 'tool')),
e AS (
  SELECT lower(trim(trace_id)) AS t, min(row_no) AS row_no, span_id, e.name, user_key, event_seq AS seq, event_ts AS ts, CAST(attributes AS VARCHAR) AS a, any_value(kind) AS kind,
         any_value(attributes['role']) AS said, any_value(attributes['content']) AS content, any_value(attributes['message']) AS message
  FROM otel_events e JOIN kinds k ON trim(e.name) = k.name
  WHERE length(trim(trace_id)) > 0 AND NOT regexp_matches(trim(trace_id), '^0+$')
  GROUP BY ALL
),
turns AS (
  SELECT t, e.row_no, seq, ts, CASE WHEN kind = 'assistant' THEN kind ELSE coalesce(r.role, kind) END AS role,
         CASE WHEN e.name = 'gen_ai.choice' AND message IS NOT NULL THEN coalesce(CASE WHEN json_valid(message) THEN json_type(message) = 'OBJECT' END, false) ELSE e.name <> 'gen_ai.choice' OR content IS NOT NULL END AS readable,
         CASE WHEN e.name = 'gen_ai.choice' AND message IS NOT NULL THEN CASE WHEN json_valid(message) THEN
           CASE json_type(message, '$.content') WHEN 'VARCHAR' THEN json_extract_string(message, '$.content')
             WHEN 'ARRAY' THEN array_to_string(list_transform(CAST(json_extract(message, '$.content') AS JSON[]), lambda p: coalesce(json_extract_string(p, '$.text'), '')), '') END END
           ELSE content END AS body
  FROM e LEFT JOIN roles r ON lower(trim(e.said)) = r.said
),
placed AS (
  SELECT *, count(seq) OVER w AS numbered, count(*) OVER w AS n, count(ts) OVER w AS timed,
         row_number() OVER (PARTITION BY t ORDER BY seq NULLS LAST, CASE WHEN seq IS NULL THEN ts END, row_no) - 1 AS pos
  FROM turns WINDOW w AS (PARTITION BY t)
),
checked AS (
  SELECT *, lag(role) OVER (PARTITION BY t ORDER BY pos) AS before,
         lag(role) OVER (PARTITION BY t, role IN ('user', 'assistant') ORDER BY pos) AS spoke,
         last_value(role) OVER (PARTITION BY t ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ends
  FROM placed
),
broken AS (
  SELECT DISTINCT t FROM checked
  WHERE NOT readable OR ends <> 'assistant'
     OR (numbered > 0 AND (numbered < n OR seq <> pos)) OR (numbered = 0 AND timed < n)
     OR (role = 'system' AND pos > 0)
     OR (role = 'tool' AND coalesce(before, '') NOT IN ('user', 'tool'))
     OR (role IN ('user', 'assistant') AND length(regexp_replace(coalesce(body, ''), '[\s\p{Z}\p{C}]+', '', 'g')) = 0)
     OR (role = 'user' AND coalesce(spoke, 'assistant') <> 'assistant') OR (role = 'assistant' AND coalesce(spoke, '') <> 'user')
)
SELECT t AS trace_id, CAST(pos AS INTEGER) AS turn_no, role, row_no FROM checked WHERE t NOT IN (SELECT t FROM broken)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the others are tested against brute force, exact round trips or held-out accuracy."""
    return {"p2_found": _P2}
