"""The pN_ queries that are not about text: nested records and drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import drift, nested


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every child of the chat and generic records with its parent's key and its place."""
    return nested.child_positions(table(spark, d, "openai_chat"), table(spark, d, "generic_log"))


def p3_messages(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of request messages."""
    chat = table(spark, d, "openai_chat")
    spec = {"messages": ("request.messages[]", {"role": "string", "content": "string"})}
    record = F.struct(F.struct(F.col("request.messages").alias("messages")).alias("request"))
    return nested.flat_tables(chat, {"row_no": F.col("row_no")}, record, spec)["messages"].select("row_no", "child_pos", "role", "content")


def p3_hits(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of retrieval hits."""
    spec = {"hits": ("retrieval.hits[]", {"doc_id": "string", "similarity": "double", "passage": "string"})}
    record = F.struct(F.struct(F.col("retrieval.hits").alias("hits")).alias("retrieval"))
    return nested.flat_tables(table(spark, d, "generic_log"), {"row_no": F.col("row_no")}, record, spec)["hits"].select("row_no", "child_pos", "doc_id", "similarity", "passage")


def p3_choices(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of response choices with their finish reason and message."""
    spec = {"choices": ("response.choices[]", {"index": "int", "finish_reason": "string", "message.role": "string", "message.content": "string"})}
    record = F.struct(F.struct(F.col("response.choices").alias("choices")).alias("response"))
    return nested.flat_tables(table(spark, d, "openai_chat"), {"row_no": F.col("row_no")}, record, spec)["choices"].select("row_no", "child_pos", "index", "finish_reason", "message_role", "message_content")


def p3_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of tool calls, each with the place of its choice."""
    spec = {"calls": ("response.choices[].message.tool_calls[]", {"id": "string", "type": "string", "function.name": "string", "function.arguments": "string"})}
    record = F.struct(F.struct(F.col("response.choices").alias("choices")).alias("response"))
    return nested.flat_tables(table(spark, d, "openai_chat"), {"row_no": F.col("row_no")}, record, spec)["calls"].select("row_no", "parent_pos", "child_pos", "id", "type", "function_name", "function_arguments")


def p3_sections(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the labelled blocks of rendered prompts."""
    spec = {"sections": ("input.sections[]", {"label": "string", "body": "string"})}
    record = F.struct(F.struct(nested.sections(F.col("input.rendered_prompt")).alias("sections")).alias("input"))
    return nested.flat_tables(table(spark, d, "generic_log"), {"row_no": F.col("row_no")}, record, spec)["sections"].select("row_no", "child_pos", "label", "body")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of schema of every producer."""
    return drift.schema_changes(drift.ingest(table(spark, d, "raw_records")))


def p7_unified_chat(spark: SparkSession, d: str) -> DataFrame:
    """The one table of the chat feed, with two renamed members promoted from the rescue column."""
    out = drift.unified(drift.ingest(table(spark, d, "raw_records")), "openai_chat", drift.TARGETS["openai_chat"])
    return drift.promote(out, {"vendor": "string", "request.rng_seed": "bigint", "request.seed": "bigint", "request.temperature": "double"})


def p7_unified_spans(spark: SparkSession, d: str) -> DataFrame:
    """The one table of the flat span feed."""
    return drift.unified(drift.ingest(table(spark, d, "raw_records")), "otel_flat", drift.TARGETS["otel_flat"])


def p7_unified_events(spark: SparkSession, d: str) -> DataFrame:
    """The one table of the span event feed."""
    return drift.unified(drift.ingest(table(spark, d, "raw_records")), "otel_events", drift.TARGETS["otel_events"])


QUERIES = (p3_found, p3_messages, p3_choices, p3_tool_calls, p3_hits, p3_sections, p7_found, p7_unified_chat, p7_unified_spans, p7_unified_events)

ORACLE = {
    "p3_found": r"""
WITH m AS (SELECT row_no, unnest(request.messages) AS v, generate_subscripts(request.messages, 1) - 1 AS p FROM openai_chat),
c AS (SELECT row_no, unnest(response.choices) AS v, generate_subscripts(response.choices, 1) - 1 AS p FROM openai_chat),
t AS (SELECT row_no, p AS pp, unnest(v.message.tool_calls) AS v, generate_subscripts(v.message.tool_calls, 1) - 1 AS p FROM c),
h AS (SELECT row_no, unnest(retrieval.hits) AS v, generate_subscripts(retrieval.hits, 1) - 1 AS p FROM generic_log),
l AS (SELECT row_no, unnest(string_split(input.rendered_prompt, chr(10))) AS line, generate_subscripts(string_split(input.rendered_prompt, chr(10)), 1) AS i FROM generic_log),
s AS (SELECT row_no, row_number() OVER (PARTITION BY row_no ORDER BY i) - 1 AS p FROM l WHERE regexp_matches(line, '^[ \t]*[A-Z][A-Z0-9_]*(?:[ _/-][A-Z0-9]+)*[ \t\x{00A0}]*:'))
SELECT 'openai_chat' AS source_table, row_no, 'message' AS child_kind, -1 AS parent_pos, CAST(p AS INTEGER) AS child_pos FROM m WHERE v IS NOT NULL
UNION ALL SELECT 'openai_chat', row_no, 'choice', -1, CAST(p AS INTEGER) FROM c WHERE v IS NOT NULL
UNION ALL SELECT 'openai_chat', row_no, 'tool_call', CAST(pp AS INTEGER), CAST(p AS INTEGER) FROM t WHERE v IS NOT NULL
UNION ALL SELECT 'generic_log', row_no, 'hit', -1, CAST(p AS INTEGER) FROM h WHERE v IS NOT NULL
UNION ALL SELECT 'generic_log', row_no, 'section', -1, CAST(p AS INTEGER) FROM s
""",
    "p3_messages": r"""
WITH m AS (SELECT row_no, unnest(request.messages) AS v, generate_subscripts(request.messages, 1) - 1 AS p FROM openai_chat)
SELECT row_no, CAST(p AS INTEGER) AS child_pos, v.role AS role, v.content AS content FROM m WHERE v IS NOT NULL
""",
    "p3_choices": r"""
WITH c AS (SELECT row_no, unnest(response.choices) AS v, generate_subscripts(response.choices, 1) - 1 AS p FROM openai_chat)
SELECT row_no, CAST(p AS INTEGER) AS child_pos, v.index AS index, v.finish_reason AS finish_reason, v.message.role AS message_role, v.message.content AS message_content FROM c WHERE v IS NOT NULL
""",
    "p3_tool_calls": r"""
WITH c AS (SELECT row_no, unnest(response.choices) AS v, generate_subscripts(response.choices, 1) - 1 AS p FROM openai_chat),
t AS (SELECT row_no, p AS pp, unnest(v.message.tool_calls) AS v, generate_subscripts(v.message.tool_calls, 1) - 1 AS p FROM c)
SELECT row_no, CAST(pp AS INTEGER) AS parent_pos, CAST(p AS INTEGER) AS child_pos, v.id AS id, v.type AS type, v.function.name AS function_name, v.function.arguments AS function_arguments FROM t WHERE v IS NOT NULL
""",
    "p3_hits": r"""
WITH h AS (SELECT row_no, unnest(retrieval.hits) AS v, generate_subscripts(retrieval.hits, 1) - 1 AS p FROM generic_log)
SELECT row_no, CAST(p AS INTEGER) AS child_pos, v.doc_id AS doc_id, v.similarity AS similarity, v.passage AS passage FROM h WHERE v IS NOT NULL
""",
}
