"""The fleet view: diagnosed traces grouped by cause and headline signal, and ranked by what to fix first.

One shuffle on (mode, signal), which is at most some hundred groups; all aggregates combine before it. Exemplars are the
first ids by order of arrival, kept bounded by a partial minimum on each side of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

EXEMPLARS, FAILURES = 3, 50
# The corrective action of each mode.
ACTIONS = {"prompt_ambiguity": "clarify_prompt", "retrieval_failure": "add_gold_context", "context_dilution": "rerank_gold_first", "hallucination": "ground_or_abstain", "reasoning_failure": "decompose_question"}


def action_of(mode) -> F.Column:
    return F.coalesce(*[F.when(mode == m, F.lit(a)) for m, a in ACTIONS.items()])


def _first_ids(reports: DataFrame, order: str, n: int) -> DataFrame:
    """The first n ids of each cluster; rows beyond are dropped within each slice of the order before slices meet."""
    ids = F.coalesce(F.col("id"), F.concat(F.lit("#"), F.col(order).cast("string")))
    slim = reports.select("primary_mode", "headline", F.col(order).alias("ord"), ids.alias("ex"), F.pmod(F.xxhash64(order), F.lit(64)).alias("slice"))
    inner = Window.partitionBy("primary_mode", "headline", "slice").orderBy("ord")
    outer = Window.partitionBy("primary_mode", "headline").orderBy("ord")
    few = slim.withColumn("k", F.row_number().over(inner)).where(F.col("k") <= n).withColumn("k", F.row_number().over(outer)).where(F.col("k") <= n)
    return few.groupBy("primary_mode", "headline").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "ex"))), lambda x: x["ex"]), ",").alias("exemplars"), F.min("ord").alias("first_row"))


def clusters(reports: DataFrame, order: str = "row_no") -> DataFrame:
    """Ranked clusters of the diagnosed reports."""
    # Two aggregates read the diagnosed reports; their few columns are written once.
    slim = ["id", "primary_mode", "headline", "confidence", "p_primary", "z_primary", "has_reference", "is_rag"]
    diag = materialise(reports.where("bucket = 'diagnosed'").select(order, *slim), "diagnosed")
    agg = diag.groupBy("primary_mode", "headline").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("p_primary").alias("mean_probability"),
        F.avg("z_primary").alias("mean_logodds"),
        F.count_if("has_reference").alias("with_reference"),
        F.count_if(~F.col("is_rag")).alias("non_rag"),
    )
    out = agg.join(_first_ids(diag, order, EXEMPLARS), ["primary_mode", "headline"])
    every = Window.partitionBy(F.lit(0))
    impact = F.col("n") * F.col("mean_confidence")
    finite = F.when(F.isnan(impact) | impact.isNull(), 1).otherwise(0)
    rank = F.row_number().over(every.orderBy(finite, F.desc(F.round(impact, 6)), F.desc("n"), F.desc(F.round("mean_confidence", 6)), "primary_mode", "headline"))
    share = F.col("n") / F.sum("n").over(every)
    return out.select(
        rank.alias("rank"), "primary_mode", "headline", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("mean_probability", 6).alias("mean_probability"), F.round("mean_logodds", 6).alias("mean_logodds"),
        "with_reference", "non_rag", F.round(share, 6).alias("share"), action_of(F.col("primary_mode")).alias("action"), "exemplars",
    )


def with_fixes(ranked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Adds measured impact: of each cluster's traces, those a simulated fix validated, refuted or left unknown.

    outcomes: (primary_mode, headline, action, validated), one row for each trace and distinct action.
    """
    per = outcomes.groupBy("primary_mode", "headline").agg(F.count_if("validated").alias("validated"), F.count_if(~F.col("validated")).alias("refuted"), F.count_if(F.col("validated").isNull()).alias("unknown"))
    scored = F.col("validated") + F.col("refuted")
    return ranked.join(per, ["primary_mode", "headline"], "left").withColumn("measured_impact", F.when(scored > 0, F.round(F.col("validated") / scored, 6)))


def dominant_action(outcomes: DataFrame) -> DataFrame:
    """(primary_mode, headline, action): the most frequent action of each cluster, the first by name on a tie."""
    n = outcomes.groupBy("primary_mode", "headline", "action").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("primary_mode", "headline").agg(F.min(F.struct((-F.col("n")).alias("k"), "action")).alias("b")).select("primary_mode", "headline", F.col("b.action").alias("action"))


def summary(reports: DataFrame) -> DataFrame:
    """Totals of the three buckets and the share that abstained."""
    n = F.count(F.lit(1))
    return reports.agg(n.alias("n_input"), *[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("diagnosed", "healthy", "declined")], F.round(F.coalesce(F.try_divide(F.count_if("abstained"), n), F.lit(0.0)), 6).alias("abstention_rate"))


def failures(reports: DataFrame, order: str = "row_no", n: int = FAILURES) -> DataFrame:
    """The first rows that could not be read, a bounded list for display."""
    return reports.where("error IS NOT NULL").orderBy(order).limit(n)


def top(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.orderBy("rank").limit(k)


def render(ranked: DataFrame, total: DataFrame, k: int = 10) -> str:
    """A text table of the first clusters, for a console."""
    t = total.first()
    lines = [f"{t['n_input']} traces: {t['n_diagnosed']} diagnosed, {t['n_healthy']} healthy, {t['n_declined']} declined"]
    for r in top(ranked, k).collect():
        lines.append(f"{r['rank']:>3}  {r['primary_mode']:<18} {r['headline']:<22} n={r['n']:<7} conf={r['mean_confidence']:.2f} logodds={r['mean_logodds']:+.2f}  {r['action']}")
    return "\n".join(lines)


def notes(ranked: DataFrame, total: DataFrame, failed: int = 0, with_reference: int | None = None) -> list[str]:
    """What a reader of the report should know, from its one row of totals and its few clusters."""
    t = total.first()
    n, diagnosed = t["n_input"], t["n_diagnosed"]
    if n == 0:
        return ["No trace was given." if not failed else f"None of {failed} traces could be read."]
    out = []
    if failed:
        out.append(f"{failed} of {n + failed} traces could not be read and are in no cluster.")
    if 0 < diagnosed < n:
        out.append(f"Shares are of the {diagnosed} diagnosed traces, not of all {n}.")
    if diagnosed == 0:
        out.append("No trace was diagnosed: each was healthy or had too little evidence.")
    elif t["abstention_rate"] >= 0.5:
        out.append(f"No cause was named for {t['abstention_rate']:.0%} of the traces.")
    if with_reference == 0:
        out.append("No trace has a reference: these are risks, not confirmed errors.")
    elif "measured_impact" in ranked.columns and diagnosed and ranked.where("measured_impact IS NOT NULL").limit(1).count() == 0:
        out.append("No fix was scored by a second run.")
    return out
