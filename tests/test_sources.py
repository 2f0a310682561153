import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright import cli
from spanwright.operators import retrieval
from spanwright.session import materialise
from spanwright.sources import drift, ingest, nested, store


def payloads(spark, items):
    return spark.createDataFrame([(f"f{i}", i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(items)], "file string, position bigint, payload string")


CHAT = {"id": "c1", "request": {"messages": [{"role": "system", "content": "Answer from the text.\n\nContext:\n[kb-1] Returns take 30 days.\n[kb-2] Refunds go to the card."}, {"role": "user", "content": "How long do returns take?"}]}, "response": {"choices": [{"message": {"role": "assistant", "content": "30 days."}}]}}
CHAIN = {"run_id": "r1", "question": "Which port?", "result": "Odell", "ground_truth": "Odell", "source_documents": [{"page_content": "Ships leave Odell.", "metadata": {"source": "a.md", "score": 0.9, "gold": True}}, {"page_content": "Hours are nine to five.", "metadata": {"source": "b.md"}}]}
ENGINE = {"query_str": "Who?", "response": "The lead.", "source_nodes": [{"score": 0.7, "node": {"id_": "n1", "text": "Ask the lead."}}, {"node": {"id_": "n2", "text": "Or wait."}}]}
OTEL = {"traceId": "t1", "spanId": "s", "attributes": [{"key": "gen_ai.prompt", "value": {"stringValue": '[{"role": "user", "content": "Who painted it?"}]'}}, {"key": "gen_ai.completion", "value": {"stringValue": "Anna."}}]}
EVENTS = {"trace_id": "t2", "span_id": "s", "attributes": {"gen_ai.system": "x"}, "events": [{"name": "gen_ai.user.message", "attributes": {"content": "When?"}}, {"name": "gen_ai.choice", "attributes": {"message": '{"content": "At noon."}'}}]}
NATIVE = {"id": "n", "prompt": "p", "generated_answer": "a", "retrieved_context": [{"text": "x", "gold": True}], "ground_truth": ["a"]}
JUNK = ["{}", '{"foo": "bar"}', "[]", '"s"', "3", "null", '{"messages": "not a list"}', "{broken", None]


def test_each_payload_has_one_adapter(spark):
    rows = {r.file: r for r in ingest.ingest(payloads(spark, [CHAT, CHAIN, ENGINE, OTEL, EVENTS, NATIVE, *JUNK])).collect()}
    assert [rows[f"f{i}"].source for i in range(6)] == ["chat", "chain", "engine", "otel", "otel", "native"]
    assert all(rows[f"f{i}"].error for i in range(6, 6 + len(JUNK)))
    c = rows["f0"]
    assert c.question == "How long do returns take?" and c.generated_answer == "30 days." and [x.source_id for x in c.retrieved_context] == ["kb-1", "kb-2"] and c.retrieved_context[0].retriever_score is None
    k = rows["f1"]
    assert k.ground_truth == ["Odell"] and [x.gold for x in k.retrieved_context] == [True, None] and json.loads(k.meta)["scores"] == "partial"
    assert [x.retriever_score for x in rows["f2"].retrieved_context] == [0.7, None]
    assert rows["f3"].retrieved_context is None and rows["f3"].generated_answer == "Anna." and rows["f4"].generated_answer == "At noon."


def test_field_map(spark):
    row = {"q": {"text": "Q?"}, "out": {"text": "A"}, "docs": [{"body": "one", "rel": "0.5"}, {"body": " "}, {"body": "two", "rel": None}], "expected": "A"}
    fields = {"question": "q.text", "answer": "out.text", "chunks": "docs[].body", "chunk_scores": "docs[].rel", "reference": "expected"}
    r = ingest.ingest(payloads(spark, [row]), fields).first()
    assert (r.question, r.generated_answer, r.ground_truth) == ("Q?", "A", ["A"])
    assert [(c.text, c.retriever_score) for c in r.retrieved_context] == [("one", 0.5), ("two", None)]
    with pytest.raises(ValueError):
        ingest.ingest(payloads(spark, [row]), {"answer": "a", "bogus": "b"})
    with pytest.raises(ValueError):
        ingest.ingest(payloads(spark, [row]), {"question": "q"})


def test_embedded_field_map_and_errors(spark):
    own = {"field_map": {"id": "trace.id", "question": "input.user", "answer": "output.text", "chunks": "retrieval.hits[].passage", "chunk_scores": "retrieval.hits[].sim", "reference": "expected"}, "trace": {"id": "t9"}, "input": {"user": "Q?"}, "output": {"text": "A"}, "retrieval": {"hits": [{"passage": "one", "sim": 0.5}, {"passage": "two"}]}, "expected": "A"}
    empty = {"field_map": {"answer": "nowhere"}, "x": 1}
    rows = {r.file: r for r in ingest.ingest(payloads(spark, [own, empty, {"question": "Q?", "answer": "A", "contexts": [{"page_content": "one"}]}, {"name": "s", "attributes": {"gen_ai.prompt": "[]", "gen_ai.completion": "A"}}, {"query": "Q?", "result": "A"}])).collect()}
    r = rows["f0"]
    assert (r.id, r.question, r.generated_answer, r.ground_truth, r.error) == ("t9", "Q?", "A", ["A"], None)
    assert [(c.text, c.retriever_score) for c in r.retrieved_context] == [("one", 0.5), ("two", None)]
    assert rows["f1"].error == "f1#1: no answer"
    assert [rows[f"f{i}"].source for i in (2, 3, 4)] == ["chain", "otel", "chain"] and rows["f2"].retrieved_context[0].text == "one"
    uneven = {"a": "A", "docs": ["x", "y"], "sims": [0.1]}
    r = ingest.ingest(payloads(spark, [uneven]), {"answer": "a", "chunks": "docs[]", "chunk_scores": "sims[]"}).first()
    assert r.error == "f0#0: chunk_scores has 1 values for 2 chunks"


def test_exact_casts():
    cast = drift._cast
    assert cast(12.0, "bigint") == (True, 12) and cast("7", "bigint") == (True, 7) and cast("1e3", "bigint") == (True, 1000) and cast(2**63 - 1, "bigint") == (True, 2**63 - 1) and cast(-(2**63), "bigint") == (True, -(2**63))
    for v in (2**63, 10**23, 1e23, 1.5, "7_000", "", "x", "nan", float("inf"), True, [], {}):
        assert cast(v, "bigint")[0] is False, v
    assert cast(1.5, "double") == (True, 1.5) and cast("1.5", "double") == (True, 1.5) and cast(2**53, "double") == (True, 2.0**53)
    for v in (2**53 + 1, 10**400, "1e999", float("nan"), False, "1_0"):
        assert cast(v, "double")[0] is False, v
    assert cast(True, "boolean") == (True, True) and cast(1, "boolean")[0] is False and cast(3, "string")[0] is False and cast(None, "bigint") == (True, None)


def test_no_value_is_lost(spark):
    rows = [{"n": 12.0}, {"n": 10**23}, {"n": "7_000"}, {"n": 1.5}, {"n": -(2**63)}, {"d": 2**53 + 1}, {"d": 0.1}]
    df = spark.createDataFrame([(i, "f", "p", "a", 0, json.dumps(r)) for i, r in enumerate(rows)], "rec_id int, feed string, producer string, file_name string, line_no int, payload string")
    target = {"n": "bigint", "d": "double"}
    got = {r.rec_id: r for r in drift.unified(drift.ingest(df, {"f": target}, ("rec_id", "feed", "producer", "file_name", "line_no")), "f", target).collect()}
    assert [got[i].n for i in range(5)] == [12, None, None, None, -(2**63)] and got[6].d == 0.1
    assert all((got[i].rescued is None) == (i in (0, 4, 6)) for i in range(7))


def test_added_adapter(spark):
    ingest.register("pairs", lambda v: ingest._trace(answer=F.try_variant_get(v, "$.says", "string")), lambda v: F.try_variant_get(v, "$.says", "string").isNotNull())
    try:
        r = ingest.ingest(payloads(spark, [{"says": "yes"}])).first()
        assert (r.source, r.generated_answer, r.error) == ("pairs", "yes", None)
    finally:
        del ingest.ADAPTERS["pairs"], ingest.CLAIMS["pairs"]
    with pytest.raises(ValueError):
        ingest.register("unclaimed", lambda v: v)


def test_context_blocks(spark):
    def block(s):
        return spark.range(1).select(ingest.context_block(F.lit(s)).alias("c")).first().c

    assert block("Context: alpha beta") == "alpha beta"
    assert block("Context:\none\nBased on the survey, ships leave.") == "one\nBased on the survey, ships leave."
    assert block("Context:\none\nAnswer using only the context above.") == "one"
    assert block("Passages:\none\n\nQuestion: Who?") == "one"
    cut = lambda s: [(c.text, c.source_id) for c in spark.range(1).select(ingest.split_block(F.lit(s)).alias("c")).first().c]
    assert cut("(1) one\n(2) two") == [("one", None), ("two", None)]
    assert cut("Document 3: one\nDocument b: two") == [("one", "3"), ("two", "b")]
    assert cut("<doc id='1'>one</doc><doc>two</doc>") == [("one", None), ("two", None)]


def test_blocks(spark):
    cut = lambda s: [c.text for c in spark.range(1).select(ingest.split_block(F.lit(s)).alias("c")).first().c]
    assert cut("1. one\n2. two") == ["one", "two"] and cut("- a\n- b") == ["- a\n- b"] and cut("one\n\ntwo") == ["one", "two"]
    assert len(cut("\n".join(f"{i}. x{i}" for i in range(500)))) == 500
    assert len(cut("\n".join(f"{i}. x{i}" for i in range(600)))) == 1
    assert len(cut("\n\n".join(f"x{i}" for i in range(600)))) == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("﻿" + json.dumps(CHAT) + "\n\n" + json.dumps(OTEL) + "\n{broken\n")
    (tmp_path / "b.json").write_text(json.dumps([CHAIN, ENGINE], indent=1))
    (tmp_path / "c.json").write_text(json.dumps(NATIVE, indent=1))
    (tmp_path / "d.bin").write_bytes(b"\xff\xfe\x00")
    lines = ingest.ingest(ingest.read_lines(spark, str(tmp_path / "a.jsonl"))).collect()
    assert sorted(str(r.source) for r in lines) == ["None", "chat", "otel"]
    assert sorted(r.position for r in lines) == [1, 3, 4] and [r.error for r in lines if r.error] == ["a.jsonl#4: not JSON"]
    docs = ingest.ingest(ingest.read_documents(spark, str(tmp_path / "b.json"))).collect()
    assert [(r.source, r.position) for r in sorted(docs, key=lambda r: r.position)] == [("chain", 0), ("engine", 1)]
    assert ingest.ingest(ingest.read_documents(spark, str(tmp_path / "c.json"))).first().source == "native"
    ok = {r.path[-5:]: r.ok for r in ingest.valid_utf8(spark, str(tmp_path)).collect()}
    assert ok["d.bin"] is False and ok["jsonl"] is True


def test_cli(tmp_path, capsys):
    p = tmp_path / "log.jsonl"
    p.write_text("\n".join(json.dumps(CHAIN | {"result": a}) for a in ("Linn", "Odell", "nowhere")) + "\n{broken\n")
    assert cli.main(["triage", str(p)]) == 0
    got = capsys.readouterr()
    assert "3 traces" in got.out and "not JSON" in got.err
    assert cli.main(["analyze", str(p), "--top", "2"]) == 0 and len(capsys.readouterr().out.strip().splitlines()) == 2
    assert cli.main(["triage", str(tmp_path / "missing.jsonl")]) == 2


def test_store(spark, tmp_path):
    t = spark.createDataFrame([(i, f"t{i % 2}", "p", "Which port?", "Odell", None, ["Odell"], None, "s") for i in range(3)], "row_no bigint, id string, prompt string, question string, generated_answer string, retrieved_context array<struct<text:string,retriever_score:double,source_id:string,gold:boolean,char_span:struct<start:int,end:int>>>, ground_truth array<string>, meta string, source string")
    path = f"file://{tmp_path}/cache"
    a = store.cached_signals(spark, t, path).collect()
    b = store.cached_signals(spark, t, path).collect()
    assert len(a) == len(b) == 3 and spark.read.parquet(path).count() == 1 and a[0].has_reference
    store.clear(spark, path)
    nums = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "k int, x double")
    assert [json.loads(r.value)["x"] for r in store.to_lines(nums).collect()] == [None, None, 1.5]
    store.save_heads(spark, {"m": (0.5, [1.0, 2.0])}, path)
    assert store.load_heads(spark, path) == {"m": (0.5, [1.0, 2.0])}


def test_dense_search_against_all_pairs(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(230, 8))
    v[7] = v[9]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None)], "id bigint, v array<double>").repartition(5)
    got = {}
    for x in retrieval.top_k(df, df.where("id % 50 = 0"), "id", "v", 4).collect():
        got.setdefault(x.query_id, {})[x.rank] = x.doc_id
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 230, 50):
        order = sorted(range(230), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:4]
        assert [got[q][k] for k in range(1, 5)] == order


# --- nested records ---------------------------------------------------------------------------------------------


def test_triples_and_pivot_keep_every_value():
    r = random.Random(5)

    def value(depth):
        k = r.random()
        if depth and k < 0.3:
            return {f"k{i}": value(depth - 1) for i in range(r.randint(0, 3))}
        if depth and k < 0.6:
            return [value(depth - 1) for _ in range(r.randint(0, 3))]
        return r.choice([None, 1, 2.5, True, "x", "é\n"])

    def leaves(v, path, at):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from leaves(x, f"{path}.{k}" if path else k, at)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from leaves(x, path + "[]", (*at, i))
        elif v is not None:
            yield path, at, v if isinstance(v, str) else json.dumps(v)

    for _ in range(100):
        rec = {"a": value(3), "b": value(3)}
        got = sorted((f"{node}.{c}".strip(".") if c != "value" or not node else node, at, x) for node, at, cells in nested.pivot(rec) for c, x in cells.items())
        assert got == sorted(leaves(rec, "", ()))


def test_flat_tables(spark):
    rows = [(1, '{"o": [{"n": 1, "i": [{"v": "a"}, null, {"v": "b"}]}, null, {"n": "x", "i": []}], "z": null}', "k"), (2, None, "k"), (3, '{"o": null}', "k"), (4, "{bad", "k"), (1, '{"o": [{"n": 7}]}', "k")]
    df = spark.createDataFrame(rows, "row_no bigint, record string, node string")
    t = nested.flat_tables(df, {"row_no": F.col("row_no")}, F.col("record"), {"outer": ("o[]", {"n": "int"}), "inner": ("o[].i[]", {"v": "string"})})
    assert {(r.row_no, r.child_pos, r.n) for r in t["outer"].collect()} == {(1, 0, 1), (1, 2, None), (1, 0, 7)}
    assert {(r.row_no, r.parent_pos, r.child_pos, r.v) for r in t["inner"].collect()} == {(1, 0, 0, "a"), (1, 0, 2, "b")}
    assert nested.nested_rows(df.limit(0), {"row_no": F.col("row_no")}, F.col("record")).count() == 0


def test_sections(spark):
    text = "before\nSYSTEM: a\nb\n\nUSER NOTES :c\nNote: no label\n10:30 no\nQ:"
    got = spark.range(1).select(nested.sections(F.lit(text)).alias("s")).first().s
    assert [(x.label, x.body) for x in got] == [("SYSTEM", "a\nb"), ("USER NOTES", "c\nNote: no label\n10:30 no"), ("Q", "")]
    assert spark.range(1).select(nested.sections(F.lit(None).cast("string")).alias("s")).first().s == []


# --- drifting schemas -------------------------------------------------------------------------------------------


def raw(spark, files, producer="p", feed="openai_chat"):
    rows, n = [], 0
    for i, recs in enumerate(files):
        for j, rec in enumerate(recs):
            n += 1
            rows.append((n, feed, producer, f"f{i:02}", j, f"2026-{1 + i // 28:02}-{1 + i % 28:02} 00:00:00", rec if isinstance(rec, str) or rec is None else json.dumps(rec)))
    return spark.createDataFrame(rows, "rec_id bigint, feed string, producer string, file_name string, line_no int, landed string, payload string").select("*", F.col("landed").cast("timestamp").alias("landed_at"), F.lit("clash").alias("typed"))


def changes(spark, files):
    return sorted(tuple(r)[2:] for r in drift.schema_changes(drift.ingest(raw(spark, files))).collect())


def test_changes(spark):
    r = random.Random(1)
    base = lambda **k: {"id": f"r-{r.randint(1000, 9999)}", "model": r.choice(["lumen", "quarry"]), "n": r.randint(80, 200), "m": [{"role": "user", "text": "What is it?"}]} | k

    def without(*ks):
        return {k: v for k, v in base().items() if k not in ks}

    files = [
        [base() for _ in range(10)],
        [base(extra=1.5) if i % 2 else base() for i in range(10)],
        [without("model") | {"engine": r.choice(["lumen", "quarry"]), "extra": 2.5} for _ in range(10)],
        [without("model") | {"engine": r.choice(["lumen", "quarry"]), "extra": 2.5, "n": "12"} for _ in range(10)] + ["{broken", None],
        [without("model", "id") | {"engine": r.choice(["lumen", "quarry"]), "extra": 2.5, "n": "12"} for _ in range(10)],
        [without("model", "id") | {"engine": r.choice(["lumen", "quarry"]), "extra": 2.5, "n": "12", "m": [{"role": "user", "text": {"value": "x"}}]} for _ in range(10)],
        [without("model", "id") | {"engine": None, "extra": 2.5, "n": "12", "m": [{"role": "user", "text": {"value": "x"}}]} for _ in range(10)],
    ]
    assert changes(spark, files) == [("f01", "added", "", "extra"), ("f02", "renamed", "model", "engine"), ("f03", "type_changed", "n", "n"), ("f04", "removed", "id", ""), ("f05", "type_changed", "m[].text", "m[].text")]
    assert changes(spark, [[base()] * 3]) == []
    assert drift.schema_changes(drift.ingest(raw(spark, [[base()]]).limit(0))).count() == 0


def test_optional_members_and_changes_back(spark):
    on = [{"a": 1, "o": {"x": 1}} if i % 2 else {"a": 1} for i in range(8)]
    off = [{"a": 1}] * 3
    assert changes(spark, [on, off, on, on]) == []
    back = changes(spark, [[{"a": 1, "b": "x"}] * 9, [{"a": 1}] * 9, [{"a": 1, "b": "x"}] * 9])
    assert back == [("f01", "removed", "b", ""), ("f02", "added", "", "b")]


def test_segments_of_many_files(spark):
    r = random.Random(4)
    make = lambda i: [{"id": f"r-{r.randint(1000, 9999)}", "n": 1} | ({"b": 2.5} if (i // 7) % 2 else {}) | ({"c": "x"} if i >= 20 else {"d": True}) for _ in range(6)]
    files = [make(i) for i in range(33)]
    want = changes(spark, files)
    cut = sorted(tuple(x)[2:] for x in drift.schema_changes(drift.ingest(raw(spark, files)), 12, 9).collect())
    assert cut == want and len(want) == 6


def test_removal_at_the_edge_of_a_segment(spark):
    # 'b' is optional and goes for good in the last file of the first segment; 'k' has two kinds in every file.
    some = lambda i: {"b": 2.5} if i < 11 else {}
    files = [[{"a": 1, "k": 1} | some(i), {"a": 1, "k": "x"}, {"a": 2, "k": 2}] for i in range(30)]
    want = changes(spark, files)
    cut = sorted(tuple(x)[2:] for x in drift.schema_changes(drift.ingest(raw(spark, files)), 12, 9).collect())
    assert ("f11", "removed", "b", "") in want
    assert cut == want


def test_rescue_keeps_every_value_and_promotion_replays(spark):
    recs = [{"id": "a", "request": {"model": "m", "temperature": "hot", "messages": [{"role": "u"}], "seed": 4}, "new": {"x": [1]}}, {"id": 7, "request": {"temperature": "0.5"}}, {}, "{bad"]
    target = drift.TARGETS["openai_chat"]
    got = drift.ingest(raw(spark, [recs]))
    rows = {r.rec_id: r for r in drift.unified(got, "openai_chat", target).collect()}
    assert rows[1].request_model == "m" and rows[1].request_temperature is None and json.loads(rows[1].rescued) == {"request.temperature": "hot", "request.seed": 4, "new": {"x": [1]}}
    assert rows[2].request_temperature == 0.5 and json.loads(rows[2].rescued) == {"id": 7} and rows[3].rescued is None and 4 not in rows
    out = {r.rec_id: r for r in drift.promote(materialise(drift.unified(got, "openai_chat", target), "u"), {"request.seed": "bigint", "id": "string"}).collect()}
    assert out[1].request_seed == 4 and out[2].id == "7" and out[2].rescued is None
    assert set(json.loads(out[1].rescued)) == {"request.temperature", "new"}
