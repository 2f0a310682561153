import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import diagnosis as D
from spanwright.operators import evaluation as E
from spanwright.operators import profiles as PR
from spanwright.operators import signals as S
from spanwright.operators import triage as T
from spanwright.sources import datasets
from spanwright.streaming import triage as stream

TRACE = "row_no bigint, id string, prompt string, question string, generated_answer string, retrieved_context array<struct<text:string,retriever_score:double,source_id:string,gold:boolean,char_span:struct<start:int,end:int>>>, ground_truth array<string>, meta string, source string"


def lines(tmp_path, rows):
    p = tmp_path / "set.jsonl"
    p.write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n")
    return str(p)


def test_question_sets(spark, tmp_path):
    nq = lines(tmp_path, [{"question": {"text": "Who lit it?"}, "annotations": {"short_answers": [{"text": []}, {"text": ["Anna"]}]}, "document": {"tokens": {"token": ["It", "rains.", "Anna", "lit", "it."]}}}, {"question": "no answer", "annotations": {}}])
    r = datasets.natural_questions(spark, nq).collect()
    assert [(x.question, x.answer, x.gold_fact) for x in r] == [("Who lit it?", "Anna", "Anna lit it.")]
    hp = lines(tmp_path, [{"question": "Q?", "answer": "A", "context": {"title": ["t", "u"], "sentences": [["a.", "b."], ["c."]]}, "supporting_facts": {"title": ["u", "t", "gone"], "sent_id": [0, 1, 0]}}])
    assert datasets.hotpot(spark, hp).first().gold_fact == "c. b."
    tq = lines(tmp_path, [{"question": "Q?", "best_answer": "no", "incorrect_answers": ["yes"]}, {"question": "R?", "best_answer": "x", "incorrect_answers": []}])
    assert [x.wrong_answer for x in datasets.truthful(spark, tq).collect()] == ["yes", "a myth"] and datasets.truthful(spark, tq, 1).count() == 1
    rt = lines(tmp_path, [{"prompt": "p", "response": "r", "passages": ["one", "two"], "labels": [{"start": 0}]}, {"prompt": "p", "response": "s", "labels": []}])
    rows = datasets.annotated_answers(spark, rt).collect()
    assert [x.labels for x in rows] == [["hallucination"], []] and [c.source_id for c in rows[0].retrieved_context] == ["p0", "p1"] and rows[1].retrieved_context is None


def test_profiles(spark):
    assert PR.table(spark).count() == 6 and PR.usable_tier("gemma3-4b", "white") == "grey" and PR.usable_tier("mock-4b", "black") == "black"
    with pytest.raises(ValueError):
        PR.register("x", 1, 1, 1, "violet")
    toy = lambda ts: np.array([[t.count("a"), t.count("b") + 1e-3] for t in ts])
    df = spark.createDataFrame([("aa", "aaa"), ("aa", "bb"), (None, "a")], "x string, y string")
    got = [r.s for r in df.select(PR.embedded_relevance(toy)(F.col("x"), F.col("y")).alias("s")).collect()]
    assert got[0] > 0.99 and got[1] < 0.01


def test_chunk_spans_walk_on(spark):
    chunks = [("ab", None, None, None, None), ("ab", None, None, None, None), ("zz", None, None, None, None), ("x", None, None, None, None), ("", None, None, None, None)]
    df = spark.createDataFrame([(1, "t", "x ab é ab", None, "", chunks, None, None, None)], TRACE)
    got = df.select(PR.chunk_spans(F.col("prompt"), F.col("retrieved_context")).alias("s")).first().s
    assert [None if s is None else (s.start, s.end) for s in got] == [(2, 4), (7, 9), None, (0, 1), None]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"t{i}", f"q{i}", "When was it built?" if i % 3 else "Which port is it in?", "yes" if i % 2 else "no", [("built then", None, None, i % 5 == 0, None)] if i % 4 else None, ["yes"] if i % 7 else None, None, "s") for i in range(120)]
    df = spark.createDataFrame(rows, TRACE)
    path = f"file://{tmp_path}/log.parquet"
    df.repartition(3).write.parquet(path)
    got = sorted((r.bucket, r.primary_mode, r.headline, r.n, r.with_reference) for r in stream.run(spark, path, df.schema).collect())
    batch = D.diagnose(S.log_signals(df)).groupBy("bucket", "primary_mode", "headline").agg(F.count("*").alias("n"), F.count_if("has_reference").alias("r"))
    assert got == sorted(tuple(r) for r in batch.collect())


def test_notes_and_experiments(spark):
    rows = [(i, f"t{i}", f"q{i}", "What did it say?", "no", [("unrelated", None, None, None, None)], ["yes"], None, "s") for i in range(20)]
    f = S.log_signals(spark.createDataFrame(rows, TRACE)).withColumn("labels", F.array(F.lit("retrieval_failure"), F.lit("hallucination"))).withColumn("injection_recipe", F.lit("context_dilution"))
    r = D.diagnose(f)
    assert T.notes(T.clusters(r), T.summary(r), failed=2)[0].startswith("2 of 22")
    none = r.limit(0)
    assert T.notes(T.clusters(none), T.summary(none)) == ["No trace was given."]
    o = E.override_slice(r).first()
    assert o.tp + o.fp + o.fn + o.tn == 20
    noisy = S.observe_with_noise(f, 0.5).select("is_correct", "max_chunk_relevance").collect()
    assert all(0 <= x.max_chunk_relevance <= 1 and x.is_correct in (0, 1) for x in noisy)
    assert S.observe_with_noise(f, 0.0).select(F.sum("is_correct")).first()[0] == f.select(F.sum("is_correct")).first()[0]
    d = {x.metric: x.delta for x in E.no_reference_delta(r, D.diagnose(S.log_signals(E.strip_reference(spark.createDataFrame(rows, TRACE))).withColumn("labels", F.array(F.lit("retrieval_failure"))))).collect()}
    assert "accuracy" in d
