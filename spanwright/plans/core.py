"""Queries of signals, rules, diagnosis and triage over the inference tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnosis as D
from ..operators import rules as R
from ..operators import signals as S
from ..operators import triage as T
from ..session import table
from . import sqltext as Q

_BLACK = Q._BLACK


def features(spark: SparkSession, d: str, name: str = "inference") -> DataFrame:
    return S.log_signals(table(spark, d, name))


def reports(spark: SparkSession, d: str, name: str = "inference") -> DataFrame:
    return D.diagnose(features(spark, d, name))


def prompt_signals(spark, d):
    """Ambiguity, length and multi-hop marks of every question."""
    return features(spark, d).select("row_no", "prompt_ambiguity", "prompt_n_content_words", "multihop_query")


def retrieval_signals(spark, d):
    """Support, relevance and size of every trace's context."""
    return features(spark, d).select("row_no", "answer_supported_by_context", "max_chunk_relevance", "mean_chunk_relevance", "n_chunks", "context_length_tokens")


def gold_signals(spark, d):
    """Where the answer-bearing chunk stands, whether the reference is in the context, and whether the answer is right."""
    return features(spark, d, "labeled_inference").select("row_no", F.round("gold_position_frac", 6).alias("gold_position_frac"), "gold_recall_in_context", "is_correct", "answer_length_tokens")


def missingness(spark, d):
    """Traces by which signal families they have."""
    return features(spark, d).groupBy(S.signature().alias("signature")).agg(F.count(F.lit(1)).alias("traces"))


def signals_long(spark, d):
    """Mean and number of each signal that is there."""
    long = S.long_form(features(spark, d, "labeled_inference"))
    return long.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def rule_logits(spark, d):
    """Log-odds of each mode from the rules alone."""
    out = R.fire(features(spark, d, "labeled_inference"))
    return out.select("row_no", *[F.round(f"z_{m}", 6).alias(f"z_{m}") for m in R.MODES])


def rule_firings(spark, d):
    """How often each rule fires and what it adds."""
    lines = R.fired(R.fire(features(spark, d)))
    return lines.groupBy("rule", "mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("contribution"), 6).alias("mean_contribution"))


def mode_probabilities(spark, d):
    """Probability of each mode."""
    return reports(spark, d).select("row_no", *[f"p_{m}" for m in R.MODES])


def ranked_modes(spark, d):
    """Modes of each trace from the most to the least probable."""
    r = reports(spark, d, "labeled_inference")
    return r.select("row_no", F.posexplode("ranked").alias("rank", "x")).select("row_no", "rank", "x.mode", F.col("x.p").alias("probability"))


def causal_roles(spark, d):
    """Root, contributing or consequence: the part of each mode."""
    return reports(spark, d, "labeled_inference").select("row_no", "root", *[f"role_{m}" for m in R.MODES])


def evidence_ledger(spark, d):
    """Evidence lines of the hallucination mode; they sum to its log-odds."""
    r = reports(spark, d).withColumn("l", F.explode(D.ledger("hallucination")))
    return r.groupBy("row_no").agg(F.round(F.sum("l.contribution"), 3).alias("total"), F.count(F.lit(1)).alias("lines"))


def decisions(spark, d):
    """Confidence, abstention, bucket and headline of each trace."""
    return reports(spark, d).select("row_no", "primary_mode", "headline", "confidence", "abstained", "bucket", F.size("conformal_set").alias("set_size"))


def triage_clusters(spark, d):
    """What to fix first: ranked clusters of diagnosed traces."""
    return T.clusters(reports(spark, d))


def triage_summary(spark, d):
    """How many traces were diagnosed, healthy or declined."""
    return T.summary(reports(spark, d))


def triage_top(spark, d):
    """The three first clusters of the labelled traces."""
    return T.top(T.clusters(reports(spark, d, "labeled_inference")), 3)


def report_notes(spark, d):
    """How often each note is attached."""
    return reports(spark, d, "labeled_inference").select(F.explode(D.notes()).alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("n"))


QUERIES = (prompt_signals, retrieval_signals, gold_signals, missingness, signals_long, rule_logits, rule_firings, mode_probabilities, ranked_modes, causal_roles, evidence_ledger, decisions, triage_clusters, triage_summary, triage_top, report_notes)


def _clusters_sql(name: str) -> str:
    actions = "CASE " + " ".join(f"WHEN primary_mode = '{m}' THEN '{a}'" for m, a in T.ACTIONS.items()) + " END"
    return f"""WITH {Q.diagnosed(name)},
x AS (SELECT *, row_number() OVER (PARTITION BY primary_mode, headline ORDER BY row_no) AS k FROM d WHERE bucket = 'diagnosed'),
a AS (SELECT primary_mode, headline, count(*) AS n, avg(confidence) AS mc, avg(p_primary) AS mp, avg(z_primary) AS mz, count(*) FILTER (WHERE has_reference) AS with_reference, count(*) FILTER (WHERE NOT is_rag) AS non_rag,
        string_agg(coalesce(id, '#' || row_no), ',' ORDER BY k) FILTER (WHERE k <= {T.EXEMPLARS}) AS exemplars FROM x GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY round(n * mc, 6) DESC, n DESC, round(mc, 6) DESC, primary_mode, headline) AS INTEGER) AS rank, primary_mode, headline, n, round(mc, 6) AS mean_confidence, round(mp, 6) AS mean_probability, round(mz, 6) AS mean_logodds,
       with_reference, non_rag, round(n / sum(n) OVER (), 6) AS share, {actions} AS action, exemplars FROM a"""


def _notes_sql() -> str:
    pairs = " OR ".join(f"list_sort([ranked[1].m, ranked[2].m]) = {Q.lit(sorted(p))}" for p in D.CONTRASTS)
    return f"""WITH {Q.diagnosed("labeled_inference")},
n AS (SELECT unnest([CASE WHEN ranked[1].p < {D.ABSTAIN_PROBABILITY} THEN 'healthy' END, CASE WHEN ranked[1].p >= {D.ABSTAIN_PROBABILITY} AND abstained THEN 'insufficient_evidence' END, CASE WHEN NOT has_reference THEN 'no_reference' END,
  CASE WHEN is_correct = 1 AND answer_supported_by_context < 0.3 THEN 'correct_but_unsupported' END, CASE WHEN confidence < 0.5 AND ({pairs}) THEN 'escalate_tier' END]) AS note FROM d)
SELECT note, count(*) AS n FROM n WHERE note IS NOT NULL GROUP BY note"""


def oracle_sql() -> dict[str, str]:
    inf, lab = Q.features("inference"), Q.features("labeled_inference")
    dinf, dlab = Q.diagnosed("inference"), Q.diagnosed("labeled_inference")
    fired = " UNION ALL ".join(f"SELECT row_no, '{r.name}' AS rule, '{r.mode}' AS mode, {R.column_name(r)} AS c FROM r WHERE {R.column_name(r)} IS NOT NULL" for r in R.RULES)
    long = " UNION ALL ".join(f"SELECT '{s}' AS signal, {s} AS value FROM f WHERE {s} IS NOT NULL" for s in S.SIGNALS)
    lines = ", ".join(R.column_name(r) for r in R.RULES if r.mode == "hallucination")
    return {
        "prompt_signals": f"WITH {inf} SELECT row_no, prompt_ambiguity, prompt_n_content_words, multihop_query FROM f",
        "retrieval_signals": f"WITH {inf} SELECT row_no, answer_supported_by_context, max_chunk_relevance, mean_chunk_relevance, n_chunks, context_length_tokens FROM f",
        "gold_signals": f"WITH {lab} SELECT row_no, round(gold_position_frac, 6) AS gold_position_frac, gold_recall_in_context, is_correct, answer_length_tokens FROM f",
        "missingness": f"WITH {inf} SELECT {Q.signature()} AS signature, count(*) AS traces FROM f GROUP BY 1",
        "signals_long": f"WITH {lab}, l AS ({long}) SELECT signal, count(*) AS n, round(avg(value), 6) AS mean FROM l GROUP BY signal",
        "rule_logits": f"WITH {dlab} SELECT row_no, " + ", ".join(f"round({R.PRIOR}" + "".join(f" + coalesce({R.column_name(r)}, 0.0)" for r in R.RULES if r.mode == m) + f", 6) AS z_{m}" for m in R.MODES) + " FROM d",
        "rule_firings": f"WITH {dinf}, l AS ({fired}) SELECT rule, mode, count(*) AS n, round(avg(round(c, 6)), 6) AS mean_contribution FROM l GROUP BY ALL",
        "mode_probabilities": f"WITH {dinf} SELECT row_no, " + ", ".join(f"p_{m}" for m in R.MODES) + " FROM d",
        "ranked_modes": f"WITH {dlab}, u AS (SELECT row_no, unnest(ranked) AS x, generate_subscripts(ranked, 1) - 1 AS i FROM d) SELECT row_no, CAST(i AS INTEGER) AS rank, x.m AS mode, x.p AS probability FROM u",
        "causal_roles": f"WITH {dlab} SELECT row_no, root, " + ", ".join(f"role_{m}" for m in R.MODES) + " FROM d",
        "evidence_ledger": f"WITH {dinf}, v AS (SELECT row_no, list_filter([{lines}], lambda x: x IS NOT NULL) AS c FROM d) SELECT row_no, round({R.PRIOR} + coalesce(list_sum(list_transform(c, lambda x: round(x, 4))), 0.0), 3) AS total, least(len(c), {D.KEEP}) + CASE WHEN len(c) > {D.KEEP} THEN 1 ELSE 0 END + 1 AS lines FROM v",
        "decisions": f"WITH {dinf} SELECT row_no, primary_mode, headline, confidence, abstained, bucket, CAST(len(conformal_set) AS INTEGER) AS set_size FROM d",
        "triage_clusters": _clusters_sql("inference"),
        "triage_summary": f"WITH {dinf} SELECT count(*) AS n_input, count(*) FILTER (WHERE bucket = 'diagnosed') AS n_diagnosed, count(*) FILTER (WHERE bucket = 'healthy') AS n_healthy, count(*) FILTER (WHERE bucket = 'declined') AS n_declined, round(count(*) FILTER (WHERE abstained) / count(*), 6) AS abstention_rate FROM d",
        "triage_top": f"SELECT * FROM ({_clusters_sql('labeled_inference')}) ORDER BY rank LIMIT 3",
        "report_notes": _notes_sql(),
    }
