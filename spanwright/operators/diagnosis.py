"""From log-odds to ranked modes, causal roles, an evidence ledger, confidence and abstention. Row-local throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import barrier
from . import signals as S
from .rules import MODES, PRIOR, RULES, column_name, fire

# Fixed values of the decision.
MASK = -50.0
ACTIVE, PRIMARY, PARENT_RATIO = 0.25, 0.40, 0.7
ABSTAIN_PROBABILITY, ABSTAIN_CONFIDENCE = 0.40, 0.35
TAU, MAX_SET, KEEP = 0.9, 4, 4
PARENTS = {"prompt_ambiguity": (), "retrieval_failure": (), "context_dilution": (), "hallucination": ("prompt_ambiguity", "retrieval_failure", "context_dilution"), "reasoning_failure": ("prompt_ambiguity", "context_dilution")}
CONTRASTS = (("hallucination", "context_dilution"), ("hallucination", "retrieval_failure"), ("context_dilution", "reasoning_failure"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def probabilities(df: DataFrame) -> DataFrame:
    """Adds p_<mode>: 0 exactly where the mode can't apply, else the rounded sigmoid of its log-odds (or p_cal_<mode>)."""
    masked = {f"z_{m}": F.when(~F.col("is_rag"), F.lit(MASK)).otherwise(F.col(f"z_{m}")) for m in ("retrieval_failure", "context_dilution")}
    out = df.withColumns(masked)
    return out.withColumns({f"p_{m}": F.when(F.col(f"z_{m}") <= MASK, 0.0).otherwise(F.round(F.col(f"p_cal_{m}") if f"p_cal_{m}" in df.columns else sigmoid(F.col(f"z_{m}")), 4)) for m in MODES})


def ranked() -> Column:
    """Array of (p, ordinal, mode) from the most to the least probable; ties in the order of the modes."""
    items = F.array(*[F.struct((-F.col(f"p_{m}")).alias("k"), F.lit(i).alias("ordinal"), F.lit(m).alias("mode"), F.col(f"p_{m}").alias("p")) for i, m in enumerate(MODES)])
    return F.transform(F.array_sort(items), lambda x: F.struct(x["p"].alias("p"), x["ordinal"].alias("ordinal"), x["mode"].alias("mode")))


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def roles(df: DataFrame) -> DataFrame:
    """Adds ranked, root (the mode named as the cause, or null) and role_<mode>."""
    out = df.withColumn("ranked", ranked())
    top = F.col("ranked")[0]
    start = F.when(top["p"] > ACTIVE, top["mode"])
    # The graph has depth one: at most one step up, to the strongest parent that is comparably strong.
    step = F.lit(None).cast("string")
    for m, parents in PARENTS.items():
        if parents:
            able = _able(m, parents)
            step = F.when(start == m, F.when(F.size(able) > 0, able[0]["mode"])).otherwise(step)
    out = out.withColumn("_root", F.coalesce(step, start))
    p_root = F.coalesce(*[F.when(F.col("_root") == m, F.col(f"p_{m}")) for m in MODES])
    out = out.withColumn("root", F.when(p_root >= PRIMARY, F.col("_root"))).drop("_root")
    cols = {}
    for m in MODES:
        active = F.col(f"p_{m}") > ACTIVE
        caused = _any([F.col(f"p_{q}") > ACTIVE for q in PARENTS[m]])
        cols[f"role_{m}"] = F.when(active, F.when(F.col("root").isNull(), "contributing").when(F.col("root") == m, "primary_root").when(caused, "sequela").otherwise("contributing"))
    return out.withColumns(cols)


def _able(m: str, parents: tuple[str, ...]) -> Column:
    return F.filter(F.col("ranked"), lambda x: x["mode"].isin(*parents) & (x["p"] > ACTIVE) & (x["p"] >= PARENT_RATIO * F.col(f"p_{m}")))


def ledger(mode: str, residual: list[tuple[str, Column]] | None = None, base: Column | None = None) -> Column:
    """Evidence lines of a mode, strongest first: the kept ones, the rest folded into one, and the base rate."""
    line = lambda s, c, src: F.struct((-F.abs(c)).alias("k"), F.lit(s).alias("signal"), F.round(c, 4).alias("contribution"), F.lit(src).alias("source"))
    items = [line(r.name, F.col(column_name(r)), "rule") for r in RULES if r.mode == mode]
    items += [line(n, F.when(F.abs(c) >= 1e-6, c), "learned") for n, c in residual or []]
    own = F.array_sort(F.filter(F.array(*items), lambda x: x["contribution"].isNotNull()))
    rest = F.aggregate(F.slice(own, KEEP + 1, 64), F.lit(0.0), lambda a, x: a + x["contribution"])
    tail = F.when(F.size(own) > KEEP, F.array(line("other_signals", rest, "aggregate"))).otherwise(F.slice(own, 1, 0))
    prior = F.lit(PRIOR) + (base if base is not None else F.lit(0.0))
    full = F.array_sort(F.concat(F.slice(own, 1, KEEP), tail, F.array(line("base_rate", prior, "prior"))))
    return F.transform(full, lambda x: F.struct(x["signal"].alias("signal"), x["contribution"].alias("contribution"), x["source"].alias("source")))


def conformal_set(tau: Column | float = TAU) -> Column:
    """The shortest run of modes from the top whose probability mass reaches tau; at most four, none of probability 0."""
    t = F.lit(tau) if isinstance(tau, float) else tau
    live = F.filter("ranked", lambda x: x["p"] > 0)
    total = F.aggregate(live, F.lit(0.0), lambda a, x: a + x["p"])
    start = F.struct(F.lit(0.0).alias("mass"), F.expr("CAST(array() AS array<string>)").alias("modes"))
    grown = F.aggregate(live, start, lambda a, x: F.when((a["mass"] < t - 1e-12) & (F.size(a["modes"]) < MAX_SET), F.struct((a["mass"] + x["p"] / total).alias("mass"), F.concat(a["modes"], F.array(x["mode"])).alias("modes"))).otherwise(a), lambda a: a["modes"])
    return grown


def decide(df: DataFrame, tau: Column | float = TAU) -> DataFrame:
    """Adds conformal_set, confidence, abstained, bucket, primary mode and its headline signal."""
    out = df.withColumn("conformal_set", conformal_set(tau))
    top, second = F.col("ranked")[0]["p"], F.col("ranked")[1]["p"]
    families = sum((S.present(f).cast("int") for f in S.FAMILIES), F.lit(0))
    complete = F.least(F.lit(1.0), families / F.when(F.col("is_rag"), 4).otherwise(3))
    penalty = 1 / F.greatest(F.size("conformal_set"), F.lit(1))
    conf = top * (0.55 + 0.45 * (top - second)) * (0.6 + 0.4 * complete) * (0.7 + 0.3 * penalty)
    out = out.withColumn("confidence_raw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)))
    abstain = (top < ABSTAIN_PROBABILITY) | (F.col("confidence_raw") < ABSTAIN_CONFIDENCE)
    primary = F.coalesce("root", F.col("ranked")[0]["mode"])
    out = out.withColumns({"abstained": abstain, "primary_mode": primary, "confidence": F.round("confidence_raw", 4)}).drop("confidence_raw")
    bucket = F.when(F.col("abstained") & (top < ABSTAIN_PROBABILITY), "healthy").when(F.col("abstained"), "declined").otherwise("diagnosed")
    heads = F.coalesce(*[F.when(F.col("primary_mode") == m, _headline(m)) for m in MODES])
    return out.withColumns({"bucket": bucket, "headline": heads, "p_primary": F.coalesce(*[F.when(F.col("primary_mode") == m, F.col(f"p_{m}")) for m in MODES]), "z_primary": F.coalesce(*[F.when(F.col("primary_mode") == m, F.col(f"z_{m}")) for m in MODES])})


def _headline(mode: str) -> Column:
    """The strongest rule of a mode, or the base rate where none fired."""
    items = F.array(*[F.struct((-F.abs(F.col(column_name(r)))).alias("k"), F.lit(i).alias("i"), F.lit(r.name).alias("signal")) for i, r in enumerate(RULES) if r.mode == mode])
    best = F.array_min(F.filter(items, lambda x: x["k"].isNotNull()))
    return F.coalesce(best["signal"], F.lit("base_rate"))


def mode_confidence(mode: str) -> Column:
    """Probability tempered by how much evidence there is."""
    mass = F.aggregate(ledger(mode), F.lit(0.0), lambda a, x: a + F.abs(x["contribution"]))
    return F.round(F.least(F.lit(1.0), F.col(f"p_{mode}") * (0.6 + 0.4 * F.least(F.lit(1.0), mass / 4.0))), 4)


def notes(tier: str = "black") -> Column:
    """What a reader should know of a report."""
    top = F.col("ranked")[0]["p"]
    pair = F.array_sort(F.array(F.col("ranked")[0]["mode"], F.col("ranked")[1]["mode"]))
    contrast = _any([pair == F.array_sort(F.array(F.lit(a), F.lit(b))) for a, b in CONTRASTS])
    return F.array_compact(
        F.array(
            F.when(top < ABSTAIN_PROBABILITY, F.lit("healthy")),
            F.when((top >= ABSTAIN_PROBABILITY) & F.col("abstained"), F.lit("insufficient_evidence")),
            F.when(~F.col("has_reference"), F.lit("no_reference")),
            F.when((F.col("is_correct") == 1) & (F.col("answer_supported_by_context") < 0.3), F.lit("correct_but_unsupported")),
            F.when(F.lit(tier == "black") & (F.col("confidence") < 0.5) & contrast, F.lit("escalate_tier")),
        )
    )


def diagnose(features: DataFrame, tau: Column | float = TAU) -> DataFrame:
    """Signals to reports, rules only: fire, probabilities, roles, decision."""
    return barrier(decide(barrier(roles(probabilities(fire(barrier(features))))), tau))
