"""Queries of evaluation, calibration, simulation and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import corpus, recommend
from ..operators import profiles as PR
from ..operators import diagnosis as D
from ..operators import evaluation as E
from ..operators import rules as R
from ..operators import signals as S
from ..operators import simulator as M
from ..operators import triage as T
from ..session import materialise, table
from . import core
from . import sqltext as Q


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return core.reports(spark, d, "labeled_inference")


def evaluation_metrics(spark, d):
    """How good rules alone are on the labelled rows."""
    return E.metrics(_labelled(spark, d))


def mode_scores(spark, d):
    """Precision, recall and F1 of each mode."""
    return E.mode_scores(_labelled(spark, d))


def confusion(spark, d):
    """Labelled against named modes."""
    return E.confusion(_labelled(spark, d))


def corpus_summary(spark, d):
    """Labelled rows by recipe and by label."""
    return E.corpus_summary(table(spark, d, "labeled_inference"))


def calibration_bins(spark, d):
    """Equal-mass bins of the hallucination probability against the label."""
    r = _labelled(spark, d).select(F.col("row_no").alias("key"), F.col("p_hallucination").alias("score"), F.array_contains(F.coalesce("labels", F.array()), "hallucination").alias("outcome"))
    return E.calibration_error(r)


def calibration_grid(spark, d):
    """Probabilities of all modes against labels on a fixed grid."""
    return E.grid_calibration_error(_labelled(spark, d))


def family_ablation(spark, d):
    """Metrics with each family of signals left out."""
    f = materialise(core.features(spark, d, "labeled_inference"), "features")
    return E.family_ablation(f).select("left_out", "n", "accuracy", "top3")


def conformal_fit(spark, d):
    """The threshold that covers nine in ten labelled rows."""
    return C.conformal_tau(C.conformal_scores(_labelled(spark, d)))


def calibration_maps(spark, d):
    """Fitted maps from log-odds to probabilities."""
    return C.fit_maps(_labelled(spark, d)).select("mode", "bucket", "kind", "n", "brier_raw", "brier")


def calibration_levels(spark, d):
    """How often each level of the calibration ladder serves a probability."""
    r = materialise(_labelled(spark, d), "reports")
    c = C.calibrate(r, C.fit_maps(r))
    return c.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"level_{m}").alias("level")) for m in R.MODES])).alias("x"), "has_reference").groupBy("x.mode", "x.level", "has_reference").agg(F.count(F.lit(1)).alias("n"))


def residual_fit(spark, d):
    """Metrics of rules with a learned residual, fitted on train rows and measured on the others."""
    r = E.hash_split(materialise(_labelled(spark, d), "reports"), "prompt", "row_no")
    heads = C.fit_residual(r.where("part = 'train'"))
    test = r.where("part <> 'train'")
    again = D.decide(D.roles(D.probabilities(C.add_residual(test, heads))))
    return E.metrics(test).withColumn("model", F.lit("rules")).unionByName(E.metrics(again).withColumn("model", F.lit("residual")))


def simulated_decisions(spark, d):
    """What the stand-in would do with each labelled row."""
    s = M.simulate(table(spark, d, "labeled_inference"))
    return s.groupBy(F.col("decision.kind").alias("kind"), F.col("decision.gold_present").alias("gold_present")).agg(F.count(F.lit(1)).alias("n"))


def interventions(spark, d):
    """What simulated fixes say of the clusters."""
    r = D.diagnose(S.missing_others(S.black_signals(S.tokens(table(spark, d, "labeled_inference")))))
    rec = materialise(recommend.recommend(r), "recommended")
    out = T.with_fixes(T.clusters(rec), recommend.outcomes(rec))
    return out.select("rank", "primary_mode", "headline", "n", "action", "validated", "refuted", "unknown", "measured_impact")


def dominant_actions(spark, d):
    """The most frequent action of each cluster."""
    r = D.diagnose(S.missing_others(S.black_signals(S.tokens(table(spark, d, "labeled_inference")))))
    return T.dominant_action(recommend.outcomes(recommend.recommend(r)))


def noise_sweep(spark, d):
    """Metrics under growing noise of observation."""
    return E.noise_sweep(materialise(core.features(spark, d, "labeled_inference"), "features")).select("sigma", "n", "accuracy", "top3")


def no_reference(spark, d):
    """What is lost where a log has no reference."""
    base = core.features(spark, d, "labeled_inference")
    stripped = S.log_signals(E.strip_reference(table(spark, d, "labeled_inference")))
    return E.no_reference_delta(D.diagnose(base), D.diagnose(stripped))


def synthetic_corpus(spark, d):
    """Rows of the made corpus by recipe, and how many rules alone get right."""
    rows = materialise(corpus.build(corpus.facts(spark)), "corpus")
    r = D.diagnose(rows)
    hit = F.coalesce(F.array_contains(E.gold_primary(), F.when(~F.col("abstained"), F.col("primary_mode"))), F.lit(False))
    return r.groupBy("injection_recipe").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit | ((F.size(E.gold_primary()) == 0) & F.col("abstained"))).alias("right"))


def override_slice(spark, d):
    """Overrides against dilutions."""
    return E.override_slice(_labelled(spark, d))


def shape_probe(spark, d):
    """What the shape of a trace alone gives away."""
    return E.shape_probe(materialise(core.features(spark, d, "labeled_inference"), "features"))


def frozen_replay(spark, d):
    """Decisions of the stand-in kept for rows whose references were stripped."""
    s = materialise(M.simulate(table(spark, d, "labeled_inference")), "simulated")
    again = E.frozen(s, E.strip_reference(s))
    return again.groupBy(F.col("decision.kind").alias("kind"), F.col("ground_truth").isNull().alias("stripped")).agg(F.count(F.lit(1)).alias("n"))


def tier_signals(spark, d):
    """How many signals each tier sees, on simulated rows."""
    f = materialise(S.black_signals(S.tokens(M.model_signals(M.simulate(table(spark, d, "labeled_inference")), "white"))), "simulated")
    out = None
    for tier in S.TIERS:
        n = sum((F.col(s).isNotNull().cast("int") for s in S.SIGNALS), F.lit(0))
        one = PR.at_tier(f, tier).agg(F.lit(tier).alias("tier"), F.count(F.lit(1)).alias("n"), F.sum(n).alias("signals"))
        out = one if out is None else out.unionByName(one)
    return out


def chunk_places(spark, d):
    """Chunks found in their prompts, and where the first stands."""
    t = table(spark, d, "inference").where("size(retrieved_context) > 0").select("row_no", PR.chunk_spans(F.col("prompt"), F.col("retrieved_context")).alias("s"))
    return t.select("row_no", F.size(F.filter("s", lambda x: x.isNotNull())).alias("found"), F.get("s", F.lit(0))["start"].alias("first_start"))


QUERIES = (override_slice, shape_probe, frozen_replay, tier_signals, chunk_places, evaluation_metrics, mode_scores, confusion, corpus_summary, calibration_bins, calibration_grid, family_ablation, conformal_fit, calibration_maps, calibration_levels, residual_fit, simulated_decisions, interventions, dominant_actions, noise_sweep, no_reference, synthetic_corpus)


def oracle_sql() -> dict[str, str]:
    d = Q.diagnosed("labeled_inference")
    roots = Q.lit([m for m in R.MODES if not D.PARENTS[m]])
    gold = f"CASE WHEN len(list_intersect(coalesce(labels, []), {roots})) > 0 THEN list_intersect(coalesce(labels, []), {roots}) ELSE coalesce(labels, []) END"
    g = f"{d}, q AS (SELECT *, {gold} AS gold, CASE WHEN NOT abstained THEN primary_mode END AS said FROM d)"
    metric = """count(*) AS n, round(avg(((len(gold) > 0 AND coalesce(list_contains(gold, said), false)) OR (len(gold) = 0 AND said IS NULL))::INT), 6) AS accuracy,
round(avg(CASE WHEN len(gold) > 0 THEN list_has_any(gold, list_transform(list_slice(ranked, 1, 3), lambda x: x.m))::INT END), 6) AS top3"""
    long = " UNION ALL ".join(f"SELECT '{m}' AS mode, p_{m} >= 0.5 AS said, list_contains(coalesce(labels, []), '{m}') AS true_, p_{m} AS p, z_{m} > {D.MASK} AS live FROM d" for m in R.MODES)
    edges = " + ".join(f"CASE WHEN rank >= floor({float(b)} * n / 10 + 0.5) THEN 1 ELSE 0 END" for b in range(1, 10))
    ablated = []
    for fam in ("none", *S.FAMILIES):
        swap = Q.diagnosed("labeled_inference")
        if fam != "none":
            gone = [s for s, (f, _) in S.SIGNALS.items() if f == fam]
            swap = swap.replace("r AS (SELECT *, ", "f2 AS (SELECT * REPLACE (" + ", ".join(f"NULL::DOUBLE AS {s}" for s in gone) + ") FROM f),\nr AS (SELECT *, ").replace(" FROM f),\nz AS", " FROM f2),\nz AS")
        ablated.append(f"SELECT * FROM (WITH {swap}, q AS (SELECT *, {gold} AS gold, CASE WHEN NOT abstained THEN primary_mode END AS said FROM d) SELECT '{fam}' AS left_out, {metric} FROM q)")
    return {
        "evaluation_metrics": f"""WITH {g} SELECT {metric}, round(avg(CASE WHEN len(gold) > 0 THEN list_has_any(gold, conformal_set)::INT END), 6) AS coverage, round(avg(CASE WHEN len(gold) > 0 THEN len(conformal_set) END), 6) AS mean_set,
round(avg(CASE WHEN len(gold) = 0 THEN abstained::INT END), 6) AS healthy_abstention, round(avg(CASE WHEN len(gold) > 0 THEN (bucket = 'declined')::INT END), 6) AS declined FROM q""",
        "mode_scores": f"""WITH {d}, l AS ({long}), a AS (SELECT mode, count(*) FILTER (WHERE said AND true_) AS tp, count(*) FILTER (WHERE said AND NOT true_) AS fp, count(*) FILTER (WHERE NOT said AND true_) AS fn FROM l GROUP BY mode)
SELECT mode, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, tp + fn AS support FROM a""",
        "confusion": f"WITH {g} SELECT coalesce(list_sort(gold)[1], 'none') AS gold, CASE WHEN abstained THEN 'none' ELSE primary_mode END AS predicted, count(*) AS n FROM q GROUP BY ALL",
        "corpus_summary": "SELECT 'recipe' AS kind, coalesce(injection_recipe, '') AS value, count(*) AS n FROM labeled_inference GROUP BY ALL UNION ALL SELECT 'label', l, count(*) FROM (SELECT unnest(CASE WHEN len(labels) > 0 THEN labels ELSE [''] END) AS l FROM labeled_inference) GROUP BY ALL",
        "calibration_bins": f"""WITH {d}, sc AS (SELECT p_hallucination AS score, list_contains(coalesce(labels, []), 'hallucination') AS outcome, row_number() OVER (ORDER BY p_hallucination, row_no) - 1 AS rank, count(*) OVER () AS n FROM d), b AS (SELECT *, {edges} AS bin FROM sc)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(outcome::INT), 6) AS mean_outcome FROM b GROUP BY bin""",
        "calibration_grid": f"WITH {d}, l AS ({long}) SELECT CAST(least(floor(p * 20), 19) AS INTEGER) AS cell, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(true_::INT), 6) AS mean_y FROM l WHERE live GROUP BY 1",
        "family_ablation": " UNION ALL ".join(ablated),
        "simulated_decisions": f"""
WITH a AS (SELECT *, list_filter(coalesce(ground_truth, []), lambda r: length(trim(r)) > 0) AS refs, coalesce(retrieved_context, []) AS cs FROM labeled_inference),
b AS (SELECT *, array_to_string(list_transform(cs, lambda c: coalesce(c.text, '')), ' ') AS joined, coalesce(refs[1], '') AS fact, coalesce(list_position(list_transform(cs, lambda c: coalesce(c.gold, false)), true), 0) - 1 AS flag FROM a),
c AS (SELECT *, array_to_string({Q.tok("coalesce(prompt, '') || ' ' || joined")}, ' ') AS hay, array_to_string({Q.tok("fact")}, ' ') AS needle, len({Q.tok("joined")}) AS words FROM b),
d AS (SELECT *, flag >= 0 OR (length(needle) > 0 AND contains(hay, needle)) AS gold, CASE WHEN flag >= 0 AND len(cs) > 1 THEN flag::DOUBLE / (len(cs) - 1) ELSE 0.0 END AS pos FROM c)
SELECT CASE WHEN gold AND NOT (len(cs) >= 5 AND pos >= 0.2 AND pos <= 0.8 AND words > 150) THEN 'grounded' ELSE 'fabricated' END AS kind, gold AS gold_present, count(*) AS n FROM d GROUP BY ALL""",
        "conformal_fit": f"""WITH {d}, pl AS (SELECT live, mass, coalesce(list_position(list_transform(live, lambda x: list_contains(labels, x.m)), true), 0) AS a FROM d WHERE len(labels) > 0),
sc AS (SELECT CASE WHEN a > 0 THEN round(list_sum(list_transform(list_slice(live, 1, a), lambda x: x.p)) / mass, 6) ELSE 1.0 END AS score FROM pl),
rk AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM sc)
SELECT max(n) AS n, least(min(score), {1 - 1e-6}) AS tau FROM rk WHERE i >= least(ceil((n + 1) * {1 - C.ALPHA}), n)""",
        "override_slice": f"""WITH {d}, o AS (SELECT i.injection_recipe = 'hallucination_override' AS o, NOT abstained AND primary_mode = 'hallucination' AS said FROM d JOIN labeled_inference i USING (row_no) WHERE i.injection_recipe IN ('hallucination_override', 'context_dilution')),
n AS (SELECT count(*) FILTER (WHERE o AND said) AS tp, count(*) FILTER (WHERE NOT o AND said) AS fp, count(*) FILTER (WHERE o AND NOT said) AS fn, count(*) FILTER (WHERE NOT o AND NOT said) AS tn FROM o)
SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM n""",
    }
