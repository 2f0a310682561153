"""Queries of ingest, text and log operators over the trace tables, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import retrieval
from ..session import table, work_dir
from ..sources import ingest as I
from ..sources import store
from ..streaming import triage as stream


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("rec_id", F.col("file_name").alias("file"), F.col("line_no").cast("bigint").alias("position"), "payload")


def route_sources(spark, d):
    """Raw lines by the adapter that claims them."""
    v = F.try_parse_json("payload")
    return _raw(spark, d).groupBy(F.coalesce(I.detect(v), F.when(v.isNull(), F.lit("unreadable")), F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def ingested_traces(spark, d):
    """Every raw line as a trace, by source and what went wrong."""
    out = I.ingest(_raw(spark, d), keep=("rec_id",))
    return out.groupBy("source", F.regexp_replace("error", "^[^:]*: ", "").alias("error")).agg(F.count(F.lit(1)).alias("n"), F.count("question").alias("questions"), F.sum(F.length("generated_answer")).alias("answer_chars"))


def json_paths(spark, d):
    """Model and output tokens of raw lines, wherever they stand."""
    v = F.col("v")
    rows = _raw(spark, d).withColumn("v", F.try_parse_json("payload"))
    model = P.first_text(v, "request.model", "attributes['gen_ai.request.model']")
    tokens = F.coalesce(*[P.as_float(P.resolve(v, p)) for p in ("response.usage.completion_tokens", "attributes['gen_ai.usage.output_tokens']")])
    return rows.select("rec_id", model.alias("model"), tokens.alias("output_tokens"))


def chat_traces(spark, d):
    """Question, answer and number of choices of each logged chat."""
    m = F.transform(F.filter(F.coalesce("request.messages", F.array()), lambda m: m.isNotNull()), lambda m: F.struct(F.lower(F.trim(m["role"])).alias("role"), F.coalesce(m["content"], F.lit("")).alias("text")))
    user = F.try_element_at(F.filter(m, lambda x: x["role"].isin("user", "human")), F.lit(-1))["text"]
    said = F.filter(F.transform(F.coalesce("response.choices", F.array()), lambda c: c["message"]["content"]), lambda t: F.length(F.trim(t)) > 0)
    return table(spark, d, "openai_chat").select("row_no", user.alias("question"), F.get(said, F.lit(0)).alias("answer"), F.coalesce(F.size("response.choices"), F.lit(0)).alias("n_choices"), F.length(I.transcript(m)).alias("prompt_chars"))


def chat_context(spark, d):
    """Chunks cut from the context block of each chat's messages, and the id of the first."""
    m = F.transform(F.filter(F.coalesce("request.messages", F.array()), lambda m: m["content"].isNotNull()), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text")))
    chunks = I.messages_to_trace(m)["retrieved_context"]
    return table(spark, d, "openai_chat").select("row_no", chunks.alias("c")).where("c IS NOT NULL").select("row_no", F.size("c").alias("chunks"), F.get("c", F.lit(0))["source_id"].alias("first_id"))


def span_traces(spark, d):
    """Question and answer of each flat span, from its attribute list."""
    get = lambda k: F.get(F.filter("attributes", lambda a: a["key"] == k), F.lit(0))["value"]
    prompt = F.coalesce(get("gen_ai.prompt")["stringValue"], get("gen_ai.input.messages")["stringValue"])
    m = F.from_json(prompt, "array<struct<role:string,content:string>>")
    user = F.try_element_at(F.filter(m, lambda x: x["role"] == "user"), F.lit(-1))["content"]
    tokens = F.coalesce(get("gen_ai.usage.input_tokens")["intValue"].try_cast("double"), get("gen_ai.usage.input_tokens")["doubleValue"], get("gen_ai.usage.input_tokens")["stringValue"].try_cast("double"))
    return table(spark, d, "otel_flat").select("row_no", user.alias("question"), get("gen_ai.completion")["stringValue"].alias("answer"), tokens.alias("input_tokens"))


def mapped_traces(spark, d):
    """Generic rows projected by the field map each of them carries."""
    j = F.to_json(F.struct("trace", "config", "input", "output", "retrieval"))
    at = lambda k: F.call_function("get_json_object", F.col("j"), F.concat(F.lit("$."), F.col("field_map")[k]))
    base, item = F.split(F.col("field_map")["chunks"], r"\[\]\.")[0], F.get(F.split(F.col("field_map")["chunks"], r"\[\]\."), F.lit(1))
    items = F.from_json(F.call_function("get_json_object", F.col("j"), F.concat(F.lit("$."), base)), "array<map<string,string>>")
    texts = F.filter(F.transform(items, lambda x: F.try_element_at(x, item)), lambda t: F.length(F.trim(t)) > 0)
    rows = table(spark, d, "generic_log").where("field_map IS NOT NULL").withColumn("j", j)
    return rows.select("row_no", at("id").alias("id"), at("question").alias("question"), at("answer").alias("answer"), F.when(texts.isNotNull(), F.size(texts)).alias("chunks"))


def transcripts(spark, d):
    """Length and digest of each trace's rendered conversation, by event time."""
    ev = table(spark, d, "otel_events").where("attributes['content'] IS NOT NULL AND trace_id IS NOT NULL")
    line = F.concat(F.coalesce(F.lower(F.trim(F.col("attributes")["role"])), F.lit("user")), F.lit(": "), F.col("attributes")["content"])
    g = ev.groupBy(F.lower("trace_id").alias("trace_id")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("event_ts", "received_at").alias("at"), "row_no", line.alias("line")))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n\n")
    return g.select("trace_id", F.length(text).alias("chars"), F.sha1(text).alias("digest"))


def composed_prompts(spark, d):
    """Prompts rebuilt from question and chunks."""
    return table(spark, d, "inference").where("size(retrieved_context) > 0").select("row_no", F.md5(I.compose_prompt(F.col("question"), F.filter("retrieved_context", lambda c: F.length(c["text"]) > 0))).alias("digest"))


def context_provenance(spark, d):
    """Traces by whether their chunks carry scores and gold marks."""
    t = table(spark, d, "inference")
    return t.groupBy(I.provenance(F.col("retrieved_context"), "retriever_score").alias("scores"), I.provenance(F.col("retrieved_context"), "gold").alias("gold")).agg(F.count(F.lit(1)).alias("n"))


def reference_shapes(spark, d):
    """Rows whose reference can be used, once blanks are removed."""
    refs = F.filter(F.transform(F.coalesce("ground_truth", F.array()), lambda r: F.trim(r)), lambda r: F.length(r) > 0)
    return table(spark, d, "labeled_inference").groupBy(F.size(refs).alias("references")).agg(F.count(F.lit(1)).alias("n"))


def token_stats(spark, d):
    """Tokens, distinct tokens and content words of answers per source."""
    t = X.token_set(F.col("generated_answer"))
    return table(spark, d, "inference").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.size(X.token_list(F.col("generated_answer")))).alias("tokens"), F.sum(F.size(t)).alias("distinct_tokens"), F.sum(F.size(X.content_set(t))).alias("content_words"))


def seeded_units(spark, d):
    """The repeatable pseudo-random number of each labelled row."""
    return table(spark, d, "labeled_inference").select("row_no", F.round(X.seeded_unit(F.lit("seed"), F.col("id"), F.lit(7)), 9).alias("u"))


def entropy_events(spark, d):
    """Normalised entropy of each user's event types."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("user_id")
    p = n.withColumn("p", F.col("c") / F.sum("c").over(w))
    h = p.groupBy("user_id").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"), F.count(F.lit(1)).alias("k"))
    return h.select("user_id", F.round(F.when(F.col("k") > 1, F.greatest(F.col("h") / F.log(F.col("k").cast("double")), F.lit(0.0))).otherwise(0.0), 6).alias("entropy"))


def answer_clusters(spark, d):
    """Entropy of the answers that different rows gave to one question."""
    t = table(spark, d, "labeled_inference").where("question IS NOT NULL")
    g = t.groupBy(F.lower(F.trim("question")).alias("question")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "generated_answer"))), lambda x: x["generated_answer"]).alias("answers"))
    return g.where("size(answers) > 1").select("question", F.size("answers").alias("n"), X.semantic_entropy(F.col("answers")).alias("entropy"), X.self_consistency(F.col("answers"), F.col("answers")[0]).alias("consistency"))


def cache_keys(spark, d):
    """The content address of each trace's signals."""
    return table(spark, d, "inference").select("row_no", store.cache_key().alias("cache_key"))


def cached_signals(spark, d):
    """Signals through the content-addressed store, computed once and read the second time."""
    t, path = table(spark, d, "labeled_inference"), work_dir(spark, "signal-cache")
    store.cached_signals(spark, t, path)
    got = store.cached_signals(spark, t, path)
    return got.agg(F.count(F.lit(1)).alias("traces"), F.countDistinct("cache_key").alias("contents"), F.round(F.avg("answer_length_tokens"), 6).alias("mean_answer_tokens"))


def hash_split(spark, d):
    """Train, calibration and test parts by rank of the prompt's digest."""
    return E.hash_split(table(spark, d, "labeled_inference"), "prompt", "row_no").select("row_no", "part", E.tier_schedule(F.col("position")).alias("tier"))


def stripped_reference(spark, d):
    """What is left of references and gold marks in a production log."""
    s = E.strip_reference(table(spark, d, "labeled_inference"))
    return s.groupBy(F.col("ground_truth").isNull().alias("no_reference")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size(F.filter("retrieved_context", lambda c: c["gold"])), F.lit(0))).alias("gold_chunks"), F.sum(F.coalesce(F.size("retrieved_context"), F.lit(0))).alias("chunks"))


def dedup_first(spark, d):
    """The first row of each prompt and answer."""
    return E.dedup_first(table(spark, d, "inference"), ["prompt", "generated_answer"], "row_no").select("row_no")


def dense_topk(spark, d):
    """The five nearest vectors of every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return retrieval.top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


def serialized_rows(spark, d):
    """Labelled rows written as strict JSON and read back: a round trip that loses nothing."""
    t = table(spark, d, "labeled_inference").select("row_no", "id", "prompt", "question", "generated_answer", "retrieved_context", "ground_truth", "labels", "weight")
    path = work_dir(spark, "lines")
    store.write_lines(t, path)
    back = store.read_native(spark, path, t.schema)
    return back.select("row_no", F.md5(F.concat_ws("|", "id", "prompt", "question", "generated_answer", "weight")).alias("digest"))


def stream_triage(spark, d):
    """Cluster totals of the inference log read as a stream."""
    return stream.run(spark, f"{d}/inference.parquet", table(spark, d, "inference").schema)


QUERIES = (route_sources, ingested_traces, json_paths, chat_traces, chat_context, span_traces, mapped_traces, transcripts, composed_prompts, context_provenance, reference_shapes, token_stats, seeded_units, entropy_events, answer_clusters, cache_keys, cached_signals, hash_split, stripped_reference, dedup_first, dense_topk, serialized_rows, stream_triage)


def oracle_sql() -> dict[str, str]:
    from . import sqltext as Q

    prov = lambda part: f"CASE WHEN retrieved_context IS NULL OR len(retrieved_context) = 0 THEN 'n/a' WHEN len(list_filter(retrieved_context, lambda c: c.{part} IS NOT NULL)) = 0 THEN 'absent' WHEN len(list_filter(retrieved_context, lambda c: c.{part} IS NOT NULL)) < len(retrieved_context) THEN 'partial' ELSE 'present' END"
    num = lambda p: f"CASE json_type(j, '{p}') WHEN 'BOOLEAN' THEN NULL ELSE try_cast(trim(json_extract_string(j, '{p}')) AS DOUBLE) END"
    attr = lambda k: f"list_filter(attributes, lambda a: a.key = '{k}')[1].value"
    return {
        "route_sources": """
WITH j AS (SELECT CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_records)
SELECT CASE WHEN j IS NULL THEN 'unreadable' WHEN json_type(j) <> 'OBJECT' THEN 'none' WHEN json_exists(j, '$.field_map') THEN 'generic'
  WHEN json_exists(j, '$.generated_answer') AND json_exists(j, '$.prompt') THEN 'native'
  WHEN (json_exists(j, '$.traceId') OR json_exists(j, '$.trace_id') OR json_exists(j, '$.spanId') OR json_exists(j, '$.span_id')) AND json_exists(j, '$.attributes') THEN 'otel'
  WHEN json_exists(j, '$.request.messages') OR json_exists(j, '$.messages') OR json_exists(j, '$.response.choices') OR json_exists(j, '$.choices') THEN 'chat' ELSE 'none' END AS source, count(*) AS n FROM j GROUP BY 1""",
        "json_paths": f"""
WITH j AS (SELECT rec_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_records)
SELECT rec_id, coalesce(nullif(json_extract_string(j, '$.request.model'), ''), nullif(json_extract_string(j, '$.attributes."gen_ai.request.model"'), '')) AS model,
  coalesce({num('$.response.usage.completion_tokens')}, {num('$.attributes."gen_ai.usage.output_tokens"')}) AS output_tokens FROM j""",
        "chat_traces": r"""
WITH m AS (SELECT *, list_transform(list_filter(coalesce(request.messages, []), lambda m: m IS NOT NULL), lambda m: {'role': lower(trim(m.role)), 'text': coalesce(m.content, '')}) AS ms,
  list_filter(list_transform(coalesce(response.choices, []), lambda c: c.message.content), lambda t: length(trim(t)) > 0) AS said FROM openai_chat)
SELECT row_no, list_filter(ms, lambda x: x.role IN ('user', 'human'))[-1].text AS question, said[1] AS answer, CAST(len(coalesce(response.choices, [])) AS INTEGER) AS n_choices,
  CAST(length(array_to_string(list_transform(list_filter(ms, lambda x: length(x.text) > 0), lambda x: coalesce(x.role, 'user') || ': ' || x.text), chr(10) || chr(10))) AS INTEGER) AS prompt_chars FROM m""",
        "span_traces": f"""
WITH a AS (SELECT row_no, coalesce({attr('gen_ai.prompt')}.stringValue, {attr('gen_ai.input.messages')}.stringValue) AS p, {attr('gen_ai.completion')}.stringValue AS answer, {attr('gen_ai.usage.input_tokens')} AS u FROM otel_flat)
SELECT row_no, CASE WHEN json_valid(p) THEN json_extract_string(list_filter(CAST(p::JSON AS JSON[]), lambda x: json_extract_string(x, '$.role') = 'user')[-1], '$.content') END AS question, answer,
  coalesce(try_cast(u.intValue AS DOUBLE), u.doubleValue, try_cast(u.stringValue AS DOUBLE)) AS input_tokens FROM a""",
        "mapped_traces": """
WITH j AS (SELECT row_no, field_map AS m, to_json({'trace': trace, 'config': config, 'input': input, 'output': output, 'retrieval': retrieval}) AS j, retrieval.hits AS hits FROM generic_log WHERE field_map IS NOT NULL)
SELECT row_no, json_extract_string(j, '$.' || m['id']) AS id, json_extract_string(j, '$.' || m['question']) AS question, json_extract_string(j, '$.' || m['answer']) AS answer,
  CASE WHEN m['chunks'] IS NOT NULL AND hits IS NOT NULL THEN CAST(len(list_filter(list_transform(hits, lambda h: h.passage), lambda t: length(trim(t)) > 0)) AS INTEGER) END AS chunks FROM j""",
        "transcripts": """
WITH l AS (SELECT lower(trace_id) AS trace_id, string_agg(coalesce(lower(trim(attributes['role'])), 'user') || ': ' || attributes['content'], chr(10) || chr(10) ORDER BY coalesce(event_ts, received_at), row_no) AS t
  FROM otel_events WHERE attributes['content'] IS NOT NULL AND trace_id IS NOT NULL GROUP BY 1) SELECT trace_id, CAST(length(t) AS INTEGER) AS chars, sha1(t) AS digest FROM l""",
        "composed_prompts": """
SELECT row_no, md5(concat_ws(chr(10) || chr(10), CASE WHEN length(trim(question)) > 0 THEN question END, nullif(array_to_string(list_transform(list_filter(retrieved_context, lambda c: length(c.text) > 0), lambda c: c.text), chr(10) || chr(10)), ''))) AS digest
FROM inference WHERE len(retrieved_context) > 0""",
        "context_provenance": f"SELECT {prov('retriever_score')} AS scores, {prov('gold')} AS gold, count(*) AS n FROM inference GROUP BY ALL",
        "reference_shapes": "SELECT CAST(len(list_filter(coalesce(ground_truth, []), lambda r: length(trim(r)) > 0)) AS INTEGER) AS \"references\", count(*) AS n FROM labeled_inference GROUP BY 1",
        "token_stats": f"""WITH t AS (SELECT source, {Q.tok('generated_answer')} AS l, {Q.tset('generated_answer')} AS s FROM inference), c AS (SELECT *, {Q.content('s')} AS c FROM t)
SELECT coalesce(source, '') AS source, sum(len(l))::BIGINT AS tokens, sum(len(s))::BIGINT AS distinct_tokens, sum(len(c))::BIGINT AS content_words FROM c GROUP BY 1""",
        "seeded_units": "SELECT row_no, round(('0x' || left(sha1('seed|' || id || '|7'), 8))::BIGINT / 4294967295::DOUBLE, 9) AS u FROM labeled_inference",
        "entropy_events": """
WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT user_id, c::DOUBLE / sum(c) OVER (PARTITION BY user_id) AS p FROM n)
SELECT user_id, round(CASE WHEN count(*) > 1 THEN greatest(-sum(p * ln(p)) / ln(count(*)), 0.0) ELSE 0.0 END, 6) AS entropy FROM p GROUP BY user_id""",
        "cache_keys": """
SELECT row_no, left(sha1(concat_ws(chr(29), 'log', 'black', coalesce(prompt, ''), coalesce(question, ''), coalesce(generated_answer, ''),
  CASE WHEN retrieved_context IS NULL THEN '-' ELSE array_to_string(list_transform(retrieved_context, lambda c: concat_ws(chr(31), coalesce(c.text, ''), coalesce(CAST(round(c.retriever_score, 6) AS VARCHAR), '0.0'), coalesce(CAST(c.gold AS VARCHAR), 'null'))), chr(30)) END,
  array_to_string(list_transform(coalesce(ground_truth, []), lambda g: coalesce(g, 'null')), chr(30)))), 16) AS cache_key FROM inference""",
        "cached_signals": f"WITH {Q.features('labeled_inference')}, k AS (SELECT row_no, concat_ws(chr(29), prompt, coalesce(question, ''), generated_answer, CAST(retrieved_context AS VARCHAR), CAST(ground_truth AS VARCHAR)) AS c FROM labeled_inference) SELECT count(*) AS traces, count(DISTINCT c) AS contents, round(avg(answer_length_tokens), 6) AS mean_answer_tokens FROM f JOIN k USING (row_no)",
        "hash_split": """
WITH r AS (SELECT row_no, row_number() OVER (ORDER BY sha1(coalesce(prompt, '')), row_no) - 1 AS i, count(*) OVER () AS n FROM labeled_inference)
SELECT row_no, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.6) + floor(n * 0.2) THEN 'cal' ELSE 'test' END AS part, ['white', 'grey', 'black'][(i % 3) + 1] AS tier FROM r""",
        "stripped_reference": "SELECT true AS no_reference, count(*) AS n, 0::BIGINT AS gold_chunks, sum(coalesce(len(retrieved_context), 0))::BIGINT AS chunks FROM labeled_inference",
        "dedup_first": "SELECT min(row_no) AS row_no FROM inference GROUP BY prompt, generated_answer",
        "dense_topk": """
WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 5""",
        "serialized_rows": "SELECT row_no, md5(concat_ws('|', id, prompt, question, generated_answer, CASE WHEN weight IS NOT NULL THEN CAST(weight AS VARCHAR) END)) AS digest FROM labeled_inference",
        "stream_triage": f"WITH {Q.diagnosed('inference')} SELECT bucket, primary_mode, headline, count(*) AS n, round(sum(confidence) / count(*), 6) AS mean_confidence, count(*) FILTER (WHERE has_reference) AS with_reference FROM d GROUP BY ALL",
    }
