import math

import pytest
from pyspark.sql import functions as F

from spanwright.functions import paths as P
from spanwright.functions import text as X
from spanwright.operators import calibration as C
from spanwright.operators import corpus, recommend
from spanwright.operators import diagnosis as D
from spanwright.operators import evaluation as E
from spanwright.operators import rules as R
from spanwright.operators import signals as S
from spanwright.operators import simulator as M
from spanwright.operators import triage as T
from spanwright.session import materialise

TRACE = "row_no bigint, id string, prompt string, question string, generated_answer string, retrieved_context array<struct<text:string,retriever_score:double,source_id:string,gold:boolean,char_span:struct<start:int,end:int>>>, ground_truth array<string>, meta string, source string"


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def lit(s):
    return F.lit(s)


def ctx(*items):
    return [(t, None, None, g, None) for t, g in items]


def traces(spark, rows):
    return spark.createDataFrame([(i, f"t{i}", p, q, a, c, g, None, "s") for i, (p, q, a, c, g) in enumerate(rows)], TRACE)


def ambiguity(q):
    import re

    w = re.findall("[A-Za-z0-9]+", q)
    low = [x.lower() for x in w]
    if not w:
        return 0.5
    proper = [i > 0 and len(x) >= 3 and x[0].isupper() and x.lower() not in X.QUESTION_STOP for i, x in enumerate(w)]
    pron = [i for i, x in enumerate(low) if x in X.PRONOUNS]
    n = sum(x not in X.PRONOUNS for x in low)
    s = 0.6 * (bool(pron) and not any(proper[: pron[0]])) + 0.2 * (n <= 4) + 0.2 * (not pron and not any(proper) and n <= 4)
    s += 0.1 * (any(x in low for x in ("when", "how")) and any(x in low for x in X.VAGUE_TIME))
    return round(min(1.0, s), 4)


@pytest.mark.parametrize("q", ["When was it built?", "What is the Veldt tower and when was it lit?", "", "Why?", "When will they come later", "Which team owns the Kuruvost pipeline?", "How is Anna today", "???"])
def test_ambiguity_against_plain_python(spark, q):
    assert one(spark, X.ambiguity(lit(q))) == pytest.approx(ambiguity(q))


def test_scores(spark):
    t = lambda s: X.token_set(lit(s))
    assert one(spark, X.relevance(t("a b c"), t("b c d"))) == 0.5 and one(spark, X.relevance(t(""), t("x"))) == 0
    assert one(spark, X.match(t("The tower was finished in 1889"), F.array(t("1889")))) == 1.0
    assert one(spark, X.match(t("x y"), F.array(t("x z")))) == 0.5
    assert one(spark, X.support(X.content_set(t("the of")), F.array(t("the of it")))) == 1.0
    assert one(spark, X.multihop(lit("Which is older?"))) == 1.0 and one(spark, X.multihop(lit("What Ran?"))) == 0.0
    assert one(spark, X.contains_text(lit("in 1889."), lit("9"))) and not one(spark, X.contains_text(lit("x"), lit("")))
    same = F.array(*[lit("yes")] * 4)
    mixed = F.array(*[lit(x) for x in ("red hat", "red hat", "blue cap", "Red hat!")])
    assert one(spark, X.semantic_entropy(same)) == 0
    h = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(4)
    assert one(spark, X.semantic_entropy(mixed)) == pytest.approx(round(h, 4))
    assert one(spark, X.self_consistency(mixed, lit("red hat"))) == 0.75
    import hashlib

    want = int(hashlib.sha1(b"a|7").hexdigest()[:8], 16) / 4294967295
    assert one(spark, X.seeded_unit(lit("a"), lit(7))) == pytest.approx(want)


def test_paths(spark):
    assert P.parse_path("a.b[0].c[-1]['x.y'][]") == ["a", "b", 0, "c", -1, "x.y", "*"]
    for bad in ("", ".a", "a.", "a..b", "a[", "a[--1]", "a[x]"):
        with pytest.raises(P.PathError):
            P.parse_path(bad)
    v = F.parse_json(lit('{"a": [{"b": 1}, {"c": 2}, {"b": null}], "k.l": "x", "n": "3.5", "t": true, "g": 0.3, "z": 0, "refs": ["", " yes "], "empty": "", "parts": [{"type": "text", "text": "hi "}, "you"]}'))
    get = lambda p: one(spark, F.to_json(P.resolve(v, p)))
    assert get("a[0].b") == "1" and get("a[-1].b") == "null" and get("['k.l']") == '"x"' and get("a[9].b") is None
    assert one(spark, F.size(P.resolve(v, "a[].b"))) == 2
    assert one(spark, P.as_float(P.resolve(v, "n"))) == 3.5 and one(spark, P.as_float(P.resolve(v, "t"))) is None
    flag = lambda p: one(spark, P.gold_flag(P.resolve(v, p)))
    assert flag("t") is True and flag("z") is False and flag("g") is None
    assert one(spark, P.references(v, "empty", "refs")) == ["yes"] and one(spark, P.references(v, "empty")) is None
    assert one(spark, P.content_text(P.resolve(v, "parts"))) == "hi you" and one(spark, P.first_text(v, "empty", "n")) == "3.5"


def test_missing_is_never_zero(spark):
    df = S.log_signals(traces(spark, [("q", "When was it built?", "1889", None, None), ("q", "When was the Veldt tower built?", "1889", [], ["1889"]), ("", None, "", ctx(("built in 1889", None)), ["", " "])]))
    a, b, c = df.orderBy("row_no").collect()
    assert a.n_chunks is None and a.is_correct is None and b.n_chunks == 0 and b.max_chunk_relevance == 0 and b.is_correct == 1
    assert c.is_correct is None and c.gold_recall_in_context is None and c.prompt_ambiguity == 0.5
    sig = [r.s for r in df.orderBy("row_no").select(S.signature().alias("s")).collect()]
    assert sig == ["prompt|noref", "prompt+retrieval", "prompt+retrieval|noref"]
    fired = R.fire(df.where("row_no = 0")).first()
    assert fired.rule_ret_gold_absent is None and fired.z_retrieval_failure == R.PRIOR


def test_rules_against_plain_python(spark):
    import random

    r = random.Random(7)
    rows = [tuple([i, True, True] + [None if r.random() < 0.3 else round(r.random() * (10 if s == "n_chunks" else 300 if "tokens" in s else 1), 3) for s in S.SIGNALS]) for i in range(120)]
    df = spark.createDataFrame(rows, "row_no bigint, is_rag boolean, has_reference boolean, " + ", ".join(f"{s} double" for s in S.SIGNALS))

    def act(f, row):
        x = row[f.signal]
        if isinstance(f, R.Raw):
            return x
        if isinstance(f, R.Middle):
            return 1 - abs(x - 0.5) * 2
        up = max(0.0, min(1.0, (x - f.lo) / (f.hi - f.lo)))
        return 1 - up if f.falling else up

    out = D.diagnose(df)
    for row in out.withColumn("ledgers", F.array(*[F.aggregate(D.ledger(m), F.lit(0.0), lambda a, x: a + x["contribution"]) for m in R.MODES])).collect():
        for m, total in zip(R.MODES, row.ledgers, strict=True):
            z = R.PRIOR
            for rule in R.RULES:
                if rule.mode == m and all(row[s] is not None for s in rule.required):
                    z += rule.weight * (math.prod(act(f, row) for f in rule.factors) - sum(s * act(f, row) for s, f in rule.less))
            assert row[f"z_{m}"] == pytest.approx(z, abs=1e-5)
            assert total == pytest.approx(z, abs=2e-3)
        ps = [row[f"p_{m}"] for m in R.MODES]
        want = sorted(range(5), key=lambda i: -ps[i])
        assert [x.mode for x in row.ranked] == [R.MODES[i] for i in want]
        assert (row.bucket == "diagnosed") == (not row.abstained)


def test_rules_all_can_fire_and_modes_are_masked(spark):
    used = {s for r in R.RULES for s in r.required}
    assert used <= set(S.SIGNALS) and len(R.RULES) == 20
    df = S.log_signals(traces(spark, [("q", "What did it say?", "x", None, ["unknown"])]))
    r = D.diagnose(df).first()
    assert r.p_retrieval_failure == 0 and r.p_context_dilution == 0


def test_scenarios(spark):
    gold = "The Veldt tower was completed in 1889."
    noise = ("Market days are on the north road.", None)
    rows = [("When was the Veldt tower completed?", "When was the Veldt tower completed?", "1889", ctx((gold, True)), ["1889"]), ("When was the Veldt tower completed?", "When was the Veldt tower completed?", "in 1921", ctx(noise), ["1889"])]
    out = D.diagnose(S.log_signals(traces(spark, rows))).orderBy("row_no").collect()
    assert out[0].bucket == "healthy" and out[1].primary_mode == "retrieval_failure"
    notes = D.diagnose(S.log_signals(traces(spark, rows))).select(D.notes().alias("n")).collect()
    assert "healthy" in notes[0].n


def test_simulator_branches(spark):
    sim = lambda **k: spark.createDataFrame([(k.get("answer", "1889"), "1921", k.get("fact", "built in 1889"), k.get("ambiguous"), k.get("readings"), k.get("hop"), k.get("hard"), k.get("known"), k.get("override"))], "answer string, distractor string, gold_fact string, ambiguous boolean, readings array<string>, requires_multihop boolean, hard_composition boolean, parametric_known boolean, parametric_override boolean").select(F.struct("*").alias("sim"))
    shape = "array<struct<text:string,retriever_score:double,source_id:string,gold:boolean,char_span:struct<start:int,end:int>>>"

    def kind(gold, **k):
        c = F.from_json(F.lit('[{"text": "built in 1889", "gold": true}]'), shape) if gold else F.lit(None).cast(shape)
        return sim(**k).select(M.decide(F.lit("q"), c, F.array(F.lit("1889")), F.col("sim"))["kind"].alias("k")).first().k

    assert kind(True) == "grounded" and kind(False) == "fabricated" and kind(False, known=True) == "parametric"
    assert kind(True, override=True) == "override" and kind(True, hop=True, hard=True) == "reasoning" and kind(True, ambiguous=True) == "ambiguous"


@pytest.fixture(scope="module")
def made(spark):
    rows = materialise(corpus.build(corpus.facts(spark), 2), "corpus")
    return rows, materialise(D.diagnose(rows), "reports")


def test_corpus_and_learning(made):
    rows, reports = made
    counts = {r.injection_recipe: r.n for r in rows.groupBy("injection_recipe").agg(F.count("*").alias("n")).collect()}
    assert set(counts) >= {"clean", "retrieval_failure", "context_dilution", "prompt_ambiguity", "hallucination_override", "reasoning_failure"}
    assert rows.groupBy("prompt", "generated_answer", "labels").count().where("count > 1").count() == 0
    base = E.metrics(reports).first()
    assert base.accuracy > 0.8 and base.top3 > 0.9
    heads = C.fit_residual(reports)
    after = D.decide(D.roles(D.probabilities(C.add_residual(R.fire(rows), heads))))
    assert E.metrics(after).first().accuracy >= 0.93


def test_recommendations(made):
    _, reports = made
    rec = materialise(recommend.recommend(reports), "rec")
    o = recommend.outcomes(rec)
    assert o.groupBy("row_no", "action").count().where("count > 1").count() == 0
    by = {(r.action, r.validated): r.n for r in o.groupBy("action", "validated").agg(F.count("*").alias("n")).collect()}
    assert by.get(("add_gold_context", True), 0) > 0 and by.get(("decompose_question", True), 0) > 0
    impact = T.with_fixes(T.clusters(rec), o).collect()
    assert all(r.validated + r.refuted + r.unknown >= r.n for r in impact)
    assert {r.f for r in rec.select(recommend.fix_outcome().alias("f")).distinct().collect()} <= {"validated", "refuted", "unknown"}


def test_triage_is_independent_of_order_and_counts(made):
    _, reports = made
    a = [tuple(r) for r in T.clusters(reports).orderBy("rank").collect()]
    b = [tuple(r) for r in T.clusters(reports.orderBy(F.rand(3))).orderBy("rank").collect()]
    assert a == b
    s = T.summary(reports).first()
    assert s.n_input == s.n_diagnosed + s.n_healthy + s.n_declined and sum(r[3] for r in a) == s.n_diagnosed
    assert "traces" in T.render(T.clusters(reports), T.summary(reports))
    assert T.clusters(reports.limit(0)).count() == 0


def test_isotonic_and_platt():
    import numpy as np

    r = np.random.default_rng(2)
    z = r.normal(0, 2, 800)
    y = (r.random(800) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    a, b = C.platt(z, y, np.ones(800))
    assert abs(a - 0.5) < 0.15 and abs(b + 1) < 0.3
    xs, ps = C.isotonic(z, y, np.ones(800))
    assert xs == sorted(xs) and all(p <= q + 1e-12 for p, q in zip(ps, ps[1:]))
    brute = lambda i: max(min(y[np.argsort(z)][lo : hi + 1].mean() for hi in range(i, 800, 40)) for lo in range(0, i + 1, 40))
    assert abs(C.apply_map("isotonic", xs, ps, np.sort(z))[400] - brute(400)) < 0.1


def test_calibration_ladder(made):
    _, reports = made
    maps = C.fit_maps(reports)
    out = C.calibrate(reports, maps).select("row_no", *[f"p_cal_{m}" for m in R.MODES], "level_hallucination").collect()
    assert all(0 <= r[f"p_cal_{m}"] <= 1 for r in out for m in R.MODES)
    tau = C.conformal_tau(C.conformal_scores(reports)).first()
    assert 0 < tau.tau < 1 and tau.n > 0


def test_hash_split_against_sorting(spark):
    import hashlib

    rows = [(i, f"p{i % 37}") for i in range(200)]
    got = {r.k: (r.part, r.position) for r in E.hash_split(spark.createDataFrame(rows, "k bigint, p string"), "p", "k").collect()}
    order = sorted(rows, key=lambda r: (hashlib.sha1(r[1].encode()).hexdigest(), r[0]))
    for i, (k, _) in enumerate(order):
        assert got[k] == ("train" if i < 120 else "cal" if i < 160 else "test", i)
