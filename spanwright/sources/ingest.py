"""Payloads of several systems as one table of traces.

Lines or files are read as text, parsed as variants, routed by what they hold and projected by the adapter of their
kind. A row that can't be read keeps its place and says why in error; nothing is dropped. All of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P

CHUNK = "struct<text:string,retriever_score:double,source_id:string,gold:boolean,char_span:struct<start:int,end:int>>"
TRACE_COLUMNS = ("id", "prompt", "question", "generated_answer", "retrieved_context", "ground_truth", "meta", "source")
MAX_CHUNKS = 512

# Where each kind of payload keeps its parts.
REFERENCE_KEYS = ("ground_truth", "ground_truths", "reference", "references", "reference_answer", "expected_answer", "expected", "gold_answer", "gold_answers")
GOLD_KEYS = ("gold", "is_gold", "is_ground_truth", "ground_truth_relevant")
SCORE_KEYS = ("score", "relevance_score", "similarity", "similarity_score", "retriever_score", "_score")
CHAIN_QUESTION = ("question", "query", "input", "inputs.question", "inputs.query", "inputs.input")
CHAIN_ANSWER = ("result", "answer", "output_text", "output", "text", "outputs.result", "outputs.answer", "outputs.output_text", "generated_answer")
CHAIN_DOCUMENTS = ("source_documents", "context", "documents", "contexts", "docs", "outputs.source_documents")
ENGINE_QUESTION = ("query_str", "query", "question", "user_query", "metadata.query_str", "metadata.query")
ENGINE_ANSWER = ("response", "response.response", "answer", "result", "output", "generated_answer", "text")
ENGINE_NODES = ("source_nodes", "response.source_nodes", "sources", "nodes")
CHAT_MESSAGES = ("messages", "request.messages", "body.messages", "input.messages")
CHAT_ANSWER = ("response.choices[0].message.content", "choices[0].message.content", "response.choices[0].text", "choices[0].text", "response.content", "response.output_text", "output_text", "response.output[0].content", "output[0].content", "completion", "response.completion", "generated_answer", "content")
CHAT_ID = ("id", "response.id", "request_id", "trace_id", "run_id")
SPAN_MARKS = ("gen_ai.system", "gen_ai.request.model", "gen_ai.response.model", "gen_ai.operation.name", "gen_ai.prompt", "gen_ai.completion", "gen_ai.input.messages", "gen_ai.output.messages")
FIELD_MAP_KEY = "field_map"

#: A line that opens a context block, and what separates its entries.
_LABELS = "contexts?|(?:retrieved|relevant) (?:context|documents|passages|excerpts)|documents|sources|passages|search results|excerpts|reference material|knowledge base|background"
_HEADER = rf"(?im)^[ \t]*(?:#{{1,6}}[ \t]*)?(?:\*\*)?(?:{_LABELS})(?:\*\*)?[ \t]*:[ \t]*\n?"
#: A labelled line after the block ends it.
_NEXT = r"(?im)^[ \t]*(?:#{1,6}[ \t]*)?(?:\*\*)?(?:(?:user )?(?:question|query)|instructions?|task|answer|rules|guidelines|constraints|(?:output )?format|examples?|notes?)(?:\*\*)?[ \t]*:"
_TAG = r"(?is)<\s*(contexts?|retrieved[_-]context|documents|sources|passages)\s*>(.*?)<\s*/\s*\1\s*>"
_DOCUMENT = r"(?is)<\s*(document|doc|passage|chunk|source)(?:\s[^>]*)?>(.*?)<\s*/\s*\1\s*>"
_MARKER = r"\[([^\]\n]{1,60})\]|\((\d{1,3})\)|(\d{1,3})[.)]|(?:document|doc|source|passage|chunk|excerpt)[ \t]+([^\s:.\n]{1,40})[ \t]*[:.]"
_ENTRY = rf"(?im)^(?=[ \t]*(?:{_MARKER})\s)"
_MARK = rf"(?i)^[ \t]*(?:{_MARKER})\s+"
#: A last line that tells what to do and speaks of the context; either alone may be retrieved text.
_TRAILING = r"(?i)\n+[ \t]*(?:answer|respond|reply|cite|quote|summari[sz]e|use|using|based|refer|do not|don't|only use|only answer|if the|please)\b[^\n]*\b(?:contexts?|documents?|passages?|sources?|excerpts?|above|below)\b[^\n]*$"


def strip(c: Column) -> Column:
    """Without blanks and line ends at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _at(items: Column, i: int) -> Column:
    return F.try_element_at(items, F.lit(i))


# --- scans ------------------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(file, position, payload) of each line that isn't blank; a leading byte order mark is removed.

    Lines are numbered from 1 in their file, blank ones too: the lines of each split are counted, and what comes before a
    split is added to the place within it. A stream has no numbers.
    """
    line = F.regexp_replace("value", "^\\x{FEFF}", "").alias("payload")
    some = F.length(F.trim("payload")) > 0
    if stream:
        return spark.readStream.text(path).select(F.col("_metadata.file_name").alias("file"), F.lit(None).cast("bigint").alias("position"), line).where(some)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("_id"), line)
    blocks = raw.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block")) - F.col("_n")
    placed = raw.join(blocks.select("_path", "_block", "_first", before.alias("_before")), ["_path", "_block"])
    return placed.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("position"), "payload").where(some)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, payload) of each record of whole JSON files: the elements of an array, or the one object."""
    whole = spark.read.text(path, wholetext=True)
    v = F.try_parse_json(F.regexp_replace("value", "^\\x{FEFF}", ""))
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    base = whole.select(F.col("_metadata.file_name").alias("file"), "value", v.alias("v"))
    good = base.where("v IS NOT NULL").select("file", F.posexplode(items).alias("position", "x")).select("file", F.col("position").cast("bigint").alias("position"), F.to_json("x").alias("payload"))
    return good.unionByName(base.where("v IS NULL").select("file", F.lit(None).cast("bigint").alias("position"), F.col("value").alias("payload")))


def valid_utf8(spark: SparkSession, path: str) -> DataFrame:
    """(path, ok) of files: whether their bytes are UTF-8."""
    return spark.read.format("binaryFile").load(path).select("path", F.is_valid_utf8("content").alias("ok"))


# --- detection --------------------------------------------------------------------------------------------------


def _has(v: Column, *ps: str) -> Column:
    return F.coalesce(*[P.resolve(v, p) for p in ps]).isNotNull()


def detect(v: Column) -> Column:
    """The adapter of a payload by priority, or null: added ones, generic, native, otel, engine, chain, chat."""
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    messages = F.coalesce(*[F.try_variant_get(P.resolve(v, p), "$", "array<variant>") for p in CHAT_MESSAGES])
    native = _has(v, "generated_answer") & _has(v, "prompt")
    chat = messages.isNotNull() | _has(v, "response.choices", "choices")
    span = (_has(v, "traceId", "trace_id", "spanId", "span_id") & _has(v, "attributes")) | _has(v, *[f"attributes['{k}']" for k in SPAN_MARKS], *[f"['{k}']" for k in SPAN_MARKS])
    # A chain has documents that hold text beside an answer, or, without messages, a question and an answer.
    answer = _has(v, *CHAIN_ANSWER)
    documents = F.coalesce(*[F.try_variant_get(P.resolve(v, p), "$", "array<variant>") for p in CHAIN_DOCUMENTS])
    held = F.coalesce(F.exists(documents, lambda d: F.coalesce(*[F.try_variant_get(d, f"$.{k}", "string") for k in ("page_content", "text", "content")]).isNotNull()), F.lit(False))
    chain = _has(v, "source_documents", "outputs.source_documents") | (_has(v, "run_id") & _has(v, "result", "outputs")) | (held & (answer | chat)) | (answer & _has(v, *CHAIN_QUESTION) & ~chat)
    claimed = F.when(~F.coalesce(is_object, F.lit(False)), F.lit(None))
    for name, claims in CLAIMS.items():
        claimed = claimed.when(F.coalesce(claims(v), F.lit(False)), name)
    return claimed.when(_has(v, FIELD_MAP_KEY), "generic").when(native, "native").when(span, "otel").when(_has(v, "source_nodes", "response.source_nodes"), "engine").when(chain, "chain").when(chat, "chat")


# --- chunks and context -----------------------------------------------------------------------------------------


def chunk(body: Column, score: Column, source: Column, gold: Column) -> Column:
    return F.struct(strip(body).alias("text"), score.cast("double").alias("retriever_score"), source.cast("string").alias("source_id"), gold.cast("boolean").alias("gold"), F.expr("CAST(NULL AS struct<start:int,end:int>)").alias("char_span"))


def keep_chunks(chunks: Column) -> Column:
    return F.filter(chunks, lambda c: F.length(c["text"]) > 0)


def provenance(chunks: Column, part: str) -> Column:
    """present, partial, absent or n/a: whether the chunks carry a score (or gold mark)."""
    n = F.size(F.filter(chunks, lambda c: c[part].isNotNull()))
    return F.when(chunks.isNull(), "n/a").when(F.size(chunks) == 0, "n/a").when(n == 0, "absent").when(n < F.size(chunks), "partial").otherwise("present")


def context_block(text: Column) -> Column:
    """The context block inside a message, or null: a tagged one, else all after a header line."""
    tagged = F.regexp_extract(text, _TAG, 2)
    header = _at(F.split(_at(F.split(text, _HEADER, 2), -1), _NEXT, 2), 1)
    return F.when(F.length(tagged) > 0, tagged).when(text.rlike(_HEADER), F.regexp_replace(strip(header), _TRAILING, ""))


def split_block(block: Column) -> Column:
    """Entries of a context block as chunks: by marker, else by rule or blank line, else whole; more than 512 are one."""
    marked = block.rlike(_ENTRY)
    documents = F.regexp_extract_all(block, F.lit(_DOCUMENT), 2)
    parts = F.when(F.size(documents) > 0, documents).when(marked, F.split(block, _ENTRY)).when(block.rlike(r"(?m)^[ \t]*[-=*_]{3,}[ \t]*$"), F.split(block, r"(?m)^[ \t]*[-=*_]{3,}[ \t]*$")).otherwise(F.split(block, r"\n[ \t]*\n"))
    one = lambda p: chunk(F.regexp_replace(strip(p), _MARK, ""), F.lit(None), F.coalesce(*[F.when(F.regexp_extract(p, _MARK, g) != "", F.regexp_extract(p, _MARK, g)) for g in (1, 4)]), F.lit(None))
    chunks = keep_chunks(F.transform(parts, one))
    return F.when(F.size(chunks) > MAX_CHUNKS, F.array(chunk(block, F.lit(None), F.lit(None), F.lit(None)))).otherwise(chunks)


def without_block(text: Column) -> Column:
    """A message without its context block."""
    after = _at(F.split(text, _HEADER, 2), -1)
    rest = F.when(text.rlike(_HEADER) & after.rlike(_NEXT), _at(F.split(after, _NEXT, 2), -1))
    return strip(F.regexp_replace(F.concat_ws("\n", _at(F.split(text, _HEADER, 2), 1), rest), _TAG, ""))


def transcript(messages: Column) -> Column:
    """'role: text' of each message (structs role, text) joined by blank lines."""
    return F.array_join(F.transform(F.filter(messages, lambda m: F.length(m["text"]) > 0), lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), m["text"])), "\n\n")


def compose_prompt(question: Column, chunks: Column) -> Column:
    """Question and chunks joined by blank lines; empty parts are left out."""
    q = F.when(F.length(F.trim(question)) > 0, question)
    body = F.array_join(F.transform(chunks, lambda c: c["text"]), "\n\n")
    return F.concat_ws("\n\n", q, F.when(F.length(body) > 0, body))


def messages_to_trace(messages: Column) -> dict[str, Column]:
    """Prompt, question and context of a list of messages (structs role, text)."""
    user = _at(F.filter(messages, lambda m: F.lower(m["role"]).isin("user", "human")), -1)
    blocks = F.filter(F.transform(messages, lambda m: context_block(m["text"])), lambda b: b.isNotNull())
    chunks = F.flatten(F.transform(blocks, lambda b: split_block(b)))
    return {"prompt": transcript(messages), "question": F.when(user.isNotNull(), without_block(user["text"])), "retrieved_context": F.when(F.size(blocks) > 0, chunks)}


# --- adapters ---------------------------------------------------------------------------------------------------


def _trace(**cols: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        cols.get("id", none).cast("string").alias("id"),
        F.coalesce(cols.get("prompt", none).cast("string"), F.lit("")).alias("prompt"),
        cols.get("question", none).cast("string").alias("question"),
        F.coalesce(cols.get("answer", none).cast("string"), F.lit("")).alias("generated_answer"),
        cols.get("retrieved_context", none).cast(f"array<{CHUNK}>").alias("retrieved_context"),
        cols.get("references", none).cast("array<string>").alias("ground_truth"),
    )


def _messages(v: Column, *ps: str) -> Column:
    raw = F.coalesce(*[F.try_variant_get(P.resolve(v, p), "$", "array<variant>") for p in ps])
    return F.transform(F.filter(raw, lambda m: m.isNotNull()), lambda m: F.struct(F.lower(F.trim(F.coalesce(F.try_variant_get(m, "$.role", "string"), F.try_variant_get(m, "$.author", "string")))).alias("role"), P.content_text(F.coalesce(F.try_variant_get(m, "$.content", "variant"), F.try_variant_get(m, "$.text", "variant"), F.try_variant_get(m, "$.parts", "variant"))).alias("text")))


def chat(v: Column) -> Column:
    m = _messages(v, *CHAT_MESSAGES)
    last = _at(m, -1)
    parts = messages_to_trace(m)
    answer = F.coalesce(P.first_text(v, *CHAT_ANSWER), P.let(last, lambda x: F.when(x["role"].isin("assistant", "ai", "model"), x["text"])))
    return _trace(id=P.text(P.first_present(v, *CHAT_ID)), answer=answer, references=P.references(v, *REFERENCE_KEYS), **parts)


def _documents(v: Column, ps: tuple[str, ...], body: tuple[str, ...], wrapped: str | None) -> Column:
    items = F.coalesce(*[F.try_variant_get(P.resolve(v, p), "$", "array<variant>") for p in ps])

    def one(d: Column) -> Column:
        inner = F.coalesce(F.try_variant_get(d, f"$.{wrapped}", "variant"), d) if wrapped else d

        def read(d: Column, inner: Column) -> Column:
            at = lambda x, *ks: [F.try_variant_get(x, f"$.{k}", "variant") for k in ks]
            text = F.coalesce(P.text(d), P.first_text(inner, *body))
            outer = at(d, *SCORE_KEYS) if wrapped else []
            score = F.get(F.filter(F.call_function("transform", F.array(*outer, *at(inner, *SCORE_KEYS), *at(inner, *[f"metadata.{k}" for k in SCORE_KEYS])), F.expr(f"v -> {P._FLOAT}")), lambda x: x.isNotNull()), F.lit(0))
            source = P.first_text(inner, "id_", "id", "node_id", "doc_id", "metadata.source", "metadata.file_name", "source")
            gold = F.get(F.filter(F.call_function("transform", F.array(*[x for a in ("", "metadata.") for x in at(inner, *[f"{a}{k}" for k in GOLD_KEYS])]), F.expr(f"v -> {P._GOLD}")), lambda x: x.isNotNull()), F.lit(0))
            return chunk(F.coalesce(text, F.lit("")), score, source, gold)

        return P.let(inner, lambda x: read(d, x)) if wrapped else read(d, d)

    return keep_chunks(F.transform(items, one))


def chain(v: Column) -> Column:
    chunks = _documents(v, CHAIN_DOCUMENTS, ("page_content", "text", "content"), None)
    q = P.first_text(v, *CHAIN_QUESTION)
    return _trace(id=P.text(P.first_present(v, "run_id", "id")), question=q, answer=P.first_text(v, *CHAIN_ANSWER), retrieved_context=chunks, prompt=F.coalesce(P.first_text(v, "prompt"), compose_prompt(q, chunks)), references=P.references(v, *REFERENCE_KEYS))


def engine(v: Column) -> Column:
    chunks = _documents(v, ENGINE_NODES, ("text", "content"), "node")
    q = P.first_text(v, *ENGINE_QUESTION)
    return _trace(id=P.text(P.first_present(v, "id", "query_id")), question=q, answer=P.first_text(v, *ENGINE_ANSWER), retrieved_context=chunks, prompt=F.coalesce(P.first_text(v, "prompt"), compose_prompt(q, chunks)), references=P.references(v, *REFERENCE_KEYS))


def _attribute(v: Column, key: str) -> Column:
    """An attribute of a span, from a map or from a list of keys and wrapped values."""
    listed = _at(F.filter(F.try_variant_get(v, "$.attributes", "array<variant>"), lambda a: F.try_variant_get(a, "$.key", "string") == key), 1)
    unwrapped = F.coalesce(*[F.try_variant_get(listed, f"$.value.{k}", "string") for k in ("stringValue", "str", "string_value", "intValue", "doubleValue", "boolValue")], F.try_variant_get(listed, "$.value", "string"))
    return F.coalesce(F.try_variant_get(P.resolve(v, f"attributes['{key}']"), "$", "string"), unwrapped)


def otel(v: Column) -> Column:
    prompt = F.coalesce(*[_attribute(v, k) for k in ("gen_ai.prompt", "gen_ai.input.messages", "input.value")])
    flat = _messages(F.try_parse_json(F.concat(F.lit('{"messages":'), prompt, F.lit("}"))), "messages")
    events = F.try_variant_get(v, "$.events", "array<variant>")
    spoken = F.filter(events, lambda e: F.try_variant_get(e, "$.name", "string").rlike(r"^gen_ai\.(system|user|assistant|tool)\.message$"))
    from_events = F.transform(spoken, lambda e: F.struct(F.coalesce(F.try_variant_get(e, "$.attributes.role", "string"), F.regexp_extract(F.try_variant_get(e, "$.name", "string"), r"^gen_ai\.(\w+)\.", 1)).alias("role"), P.content_text(F.try_variant_get(e, "$.attributes.content", "variant")).alias("text")))
    choice = _at(F.filter(events, lambda e: F.try_variant_get(e, "$.name", "string") == "gen_ai.choice"), 1)
    said = P.content_text(F.try_variant_get(F.try_parse_json(F.try_variant_get(choice, "$.attributes.message", "string")), "$.content", "variant"))
    m = F.coalesce(F.when(F.size(flat) > 0, flat), F.when(F.size(from_events) > 0, from_events))
    last = _at(m, -1)
    answer = F.coalesce(*[F.when(F.length(F.trim(x)) > 0, x) for x in (_attribute(v, "gen_ai.completion"), _attribute(v, "output.value"), said)], F.when(last["role"] == "assistant", last["text"]))
    return _trace(id=P.text(P.first_present(v, "traceId", "trace_id")), answer=answer, **messages_to_trace(m))


def native(v: Column) -> Column:
    chunks = _documents(v, ("retrieved_context",), ("text",), None)
    return _trace(id=P.text(P.resolve(v, "id")), prompt=P.text(P.resolve(v, "prompt")), question=P.text(P.resolve(v, "question")), answer=P.text(P.resolve(v, "generated_answer")), retrieved_context=chunks, references=P.references(v, "ground_truth"))


def mapped(v: Column, fields: dict[str, str]) -> Column:
    """The adapter of a field map: paths of id, question, prompt, answer, reference, chunks, chunk_scores, chunk_ids, chunk_gold, model."""
    known = {"id", "question", "prompt", "answer", "reference", "chunks", "chunk_scores", "chunk_ids", "chunk_gold", "model"}
    if extra := set(fields) - known:
        raise P.PathError(f"unknown keys {sorted(extra)}; known are {sorted(known)}")
    if "answer" not in fields:
        raise P.PathError("a field map needs an answer path")
    get = lambda k: P.content_text(P.resolve(v, fields[k])) if k in fields else F.lit(None).cast("string")
    chunks = F.lit(None)
    if "chunks" in fields:
        texts = F.transform(P.resolve(v, fields["chunks"]), lambda x: P.content_text(x))
        n = F.size(texts)

        def aligned(k: str, f: Callable[[Column], Column], kind: str) -> Column:
            if k not in fields:
                return F.expr(f"CAST(NULL AS array<{kind}>)")
            # The element keeps its place, so a missing value is null and not shifted.
            base, _, item = fields[k].partition("[].")
            items = F.try_variant_get(P.resolve(v, base.removesuffix("[]")), "$", "array<variant>")
            return F.transform(items, lambda x: f(P.resolve(x, item) if item else x))

        scores, ids, gold = aligned("chunk_scores", P.as_float, "double"), aligned("chunk_ids", P.text, "string"), aligned("chunk_gold", lambda x: P.gold_flag(x), "boolean")
        chunks = keep_chunks(F.transform(F.sequence(F.lit(0), n - 1), lambda i: chunk(texts[i], F.get(scores, i), F.get(ids, i), F.get(gold, i))))
        chunks = F.when(n == 0, F.expr(f"CAST(array() AS array<{CHUNK}>)")).when(n > 0, chunks)
    return _trace(id=get("id"), question=get("question"), prompt=F.coalesce(get("prompt"), compose_prompt(get("question"), chunks) if "chunks" in fields else get("question")), answer=get("answer"), retrieved_context=chunks, references=P.references(v, fields["reference"]) if "reference" in fields else F.lit(None))


def ragged(v: Column, fields: dict[str, str]) -> Column:
    """What is wrong with lists that should go together, or null: a list of scores, ids or marks of another length."""
    if "chunks" not in fields:
        return F.lit(None).cast("string")
    n = F.size(P.resolve(v, fields["chunks"]))
    out = F.lit(None).cast("string")
    for k in ("chunk_scores", "chunk_ids", "chunk_gold"):
        if k in fields:
            base, _, _ = fields[k].partition("[].")
            m = F.size(F.try_variant_get(P.resolve(v, base.removesuffix("[]")), "$", "array<variant>"))
            # A list beside another may lack its elements' members, but not elements.
            own, _, _ = fields["chunks"].partition("[].")
            if base.removesuffix("[]") != own.removesuffix("[]"):
                out = F.coalesce(out, F.when((m >= 0) & (n >= 0) & (m != n), F.concat(F.lit(f"{k} has "), m.cast("string"), F.lit(" values for "), n.cast("string"), F.lit(" chunks"))))
    return out


def embedded(v: Column) -> Column:
    """The adapter of payloads that carry a field map of their own: each value is read at the path the row itself names."""
    fields = F.try_variant_get(v, f"$.{FIELD_MAP_KEY}", "map<string,string>")
    at = lambda x, path: F.try_variant_get(x, F.concat(F.lit("$."), path), "variant")
    get = lambda k: P.content_text(at(v, F.try_element_at(fields, F.lit(k))))
    some = lambda k: F.when(F.length(get(k)) > 0, get(k))
    cut = lambda k: F.split(F.try_element_at(fields, F.lit(k)), r"\[\]\.?", 2)
    items = F.try_variant_get(at(v, _at(cut("chunks"), 1)), "$", "array<variant>")

    def member(x: Column, k: str) -> Column:
        # Members of the same elements only; lists of their own need a field map that is given.
        item = F.when(_at(cut(k), 1) == _at(cut("chunks"), 1), _at(cut(k), 2))
        return F.when(F.length(item) > 0, at(x, item)).otherwise(F.when(item == "", x))

    chunks = keep_chunks(F.transform(items, lambda x: chunk(P.content_text(member(x, "chunks")), P.as_float(member(x, "chunk_scores")), P.text(member(x, "chunk_ids")), P.gold_flag(member(x, "chunk_gold")))))
    reference = some("reference")
    return _trace(id=some("id"), question=some("question"), prompt=F.coalesce(some("prompt"), compose_prompt(some("question"), chunks)), answer=get("answer"), retrieved_context=chunks, references=F.when(reference.isNotNull(), F.array(reference)))


ADAPTERS: dict[str, Callable[[Column], Column]] = {"otel": otel, "engine": engine, "chain": chain, "chat": chat, "native": native}
#: What payloads adapters added by register() claim, before all others.
CLAIMS: dict[str, Callable[[Column], Column]] = {}


def register(name: str, adapter: Callable[[Column], Column], claims: Callable[[Column], Column] | None = None) -> None:
    """Adds an adapter, or replaces one: a function of a variant column to a trace struct, and one that says which it claims."""
    if claims is None and name not in ADAPTERS:
        raise ValueError(f"adapter {name!r} needs to say which payloads it claims")
    ADAPTERS[name] = adapter
    if claims is not None:
        CLAIMS[name] = claims


def ingest(lines: DataFrame, field_map: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Traces of (file, position, payload): the trace columns, source, and error for what can't be read.

    An error begins with the place, file#position, and says what is wrong; every row has a trace or an error.
    """
    v = F.col("v")
    parsed = lines.withColumn("v", F.try_parse_json("payload"))
    rows = parsed.withColumn("source", F.lit("generic") if field_map is not None else detect(v))
    trace = F.when(F.col("source") == "generic", mapped(v, field_map) if field_map is not None else embedded(v))
    for name, f in ADAPTERS.items():
        trace = trace.when(F.col("source") == name, f(v))
    out = rows.withColumn("trace", trace)
    locator = F.concat_ws("#", "file", F.col("position").cast("string"))
    uneven = ragged(v, field_map) if field_map is not None else F.lit(None).cast("string")
    answered = F.coalesce(F.length(F.trim("trace.generated_answer")), F.lit(0)) > 0
    wrong = F.when(v.isNull(), "not JSON").when(F.col("source").isNull(), F.concat(F.lit("no adapter for "), F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1), F.lit("nothing")))).when(F.col("trace").isNull(), "no trace").when(~answered, "no answer").otherwise(uneven)
    error = F.when(wrong.isNotNull(), F.concat_ws(": ", locator, wrong))
    return out.select(*keep, "file", "position", F.coalesce("trace.id", locator).alias("id"), *[f"trace.{c}" for c in ("prompt", "question", "generated_answer", "retrieved_context", "ground_truth")], "source", F.to_json(F.struct(F.col("source").alias("ingest_source"), locator.alias("origin"), provenance(F.col("trace.retrieved_context"), "retriever_score").alias("scores"), provenance(F.col("trace.retrieved_context"), "gold").alias("gold"))).alias("meta"), error.alias("error"))
