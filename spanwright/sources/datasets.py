"""Public question sets, read from local copies, as facts for the corpus or as labelled traces.

Nothing is fetched: the caller names a file or folder of JSON lines in the published layout of each set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from .ingest import CHUNK


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")


def _first(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: F.length(F.trim(x)) > 0), F.lit(0))


def _texts(v: Column, path: str) -> Column:
    return F.transform(F.try_variant_get(P.resolve(v, path), "$", "array<variant>"), lambda x: P.text(x))


def _fact(q: Column, answer: Column, gold: Column, wrong: Column, known: bool, multihop: bool) -> list[Column]:
    return [q.alias("question"), answer.alias("answer"), gold.alias("gold_fact"), F.coalesce(wrong, F.lit("an unrelated entity")).alias("wrong_answer"), q.alias("ambiguous_question"), F.lit(known).alias("parametric"), F.lit(multihop).alias("multihop")]


def natural_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Facts of questions with a short answer; the gold fact is the sentence of the document that holds it."""
    v = F.col("v")
    q = F.coalesce(P.text(P.resolve(v, "question.text")), P.text(P.resolve(v, "question")))
    blocks = F.try_variant_get(P.resolve(v, "annotations.short_answers"), "$", "array<variant>")
    answer = _first(F.flatten(F.transform(blocks, lambda b: F.coalesce(F.transform(F.try_variant_get(b, "$.text", "array<variant>"), lambda t: P.text(t)), F.array(F.try_variant_get(b, "$.text", "string"))))))
    body = F.array_join(_texts(v, "document.tokens.token"), " ")
    rows = _rows(spark, path).select(q.alias("q"), answer.alias("a"), body.alias("body")).where("q IS NOT NULL AND a IS NOT NULL")
    gold = _first(F.filter(F.split("body", r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), F.lower(F.col("a")))))
    out = rows.select(*_fact(F.col("q"), F.col("a"), F.coalesce(gold, F.concat_ws(" ", "q", "a")), F.lit(None).cast("string"), False, False))
    return out.limit(limit) if limit else out


def hotpot(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Facts that need several sentences: the supporting ones, looked up by title and place."""
    v = F.col("v")
    titles = _texts(v, "context.title")
    sents = F.transform(F.try_variant_get(P.resolve(v, "context.sentences"), "$", "array<variant>"), lambda p: F.transform(F.try_variant_get(p, "$", "array<variant>"), lambda s: P.text(s)))
    ids = F.transform(F.try_variant_get(P.resolve(v, "supporting_facts.sent_id"), "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "int"))
    rows = _rows(spark, path).select(P.text(P.resolve(v, "question")).alias("q"), P.text(P.resolve(v, "answer")).alias("a"), titles.alias("titles"), sents.alias("sents"), F.arrays_zip(_texts(v, "supporting_facts.title").alias("t"), ids.alias("i")).alias("need"))
    found = F.filter(F.transform("need", lambda n: F.get(F.get(F.col("sents"), F.array_position("titles", n["t"]).cast("int") - 1), n["i"])), lambda s: s.isNotNull())
    out = rows.select("q", "a", found.alias("facts")).where("q IS NOT NULL AND size(facts) > 1").select(*_fact(F.col("q"), F.col("a"), F.array_join(F.transform("facts", lambda s: F.trim(s)), " "), F.lit(None).cast("string"), False, True))
    return out.limit(limit) if limit else out


def truthful(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Facts that are often believed otherwise: the best answer against the first wrong one."""
    v = F.col("v")
    q, best = P.text(P.resolve(v, "question")), P.text(P.resolve(v, "best_answer"))
    out = _rows(spark, path).select(*_fact(q, best, best, F.coalesce(_first(_texts(v, "incorrect_answers")), F.lit("a myth")), True, False)).where("question IS NOT NULL AND answer IS NOT NULL")
    return out.limit(limit) if limit else out


def annotated_answers(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Labelled traces of answers whose unsupported spans were marked by people."""
    v = F.col("v")
    passages = F.coalesce(_texts(v, "reference"), _texts(v, "passages"))
    chunks = F.transform(passages, lambda t, i: F.struct(t.alias("text"), F.lit(1.0).alias("retriever_score"), F.concat(F.lit("p"), i).alias("source_id"), F.lit(None).cast("boolean").alias("gold"), F.expr("CAST(NULL AS struct<start:int,end:int>)").alias("char_span")))
    marked = F.coalesce(F.size(F.try_variant_get(P.first_present(v, "labels", "hallucination_spans"), "$", "array<variant>")), F.lit(0)) > 0
    out = _rows(spark, path).select(
        P.text(P.resolve(v, "id")).alias("id"), F.coalesce(P.first_text(v, "prompt", "question"), F.lit("")).alias("prompt"), P.text(P.resolve(v, "question")).alias("question"), F.coalesce(P.text(P.resolve(v, "response")), F.lit("")).alias("generated_answer"),
        F.when(F.size(chunks) > 0, chunks).cast(f"array<{CHUNK}>").alias("retrieved_context"), F.lit(None).cast("array<string>").alias("ground_truth"), F.when(marked, F.array(F.lit("hallucination"))).otherwise(F.array().cast("array<string>")).alias("labels"), F.lit("real").alias("provenance"), F.coalesce(P.text(P.resolve(v, "task_type")), F.lit("QA")).alias("task_type"),
    )
    return out.limit(limit) if limit else out
