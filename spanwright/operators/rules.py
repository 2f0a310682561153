"""Rules as data: each adds weighted evidence to the log-odds of one failure mode, or abstains where a signal is missing.

The same table gives column expressions and SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("prompt_ambiguity", "retrieval_failure", "context_dilution", "hallucination", "reasoning_failure")
PRIOR = -1.4
SMALLEST = 1e-6


@dataclass(frozen=True)
class Ramp:
    """Rises from 0 at lo to 1 at hi, or falls."""

    signal: str
    lo: float
    hi: float
    falling: bool = False


@dataclass(frozen=True)
class Middle:
    """1 at a half, 0 at either end."""

    signal: str


@dataclass(frozen=True)
class Raw:
    signal: str


@dataclass(frozen=True)
class Rule:
    name: str
    mode: str
    weight: float
    factors: tuple
    less: tuple = ()  # (share, Ramp): subtracted from the product

    @property
    def required(self) -> list[str]:
        return list(dict.fromkeys([f.signal for f in self.factors] + [r.signal for _, r in self.less]))


def up(s: str, lo: float, hi: float) -> Ramp:
    return Ramp(s, lo, hi)


def down(s: str, lo: float, hi: float) -> Ramp:
    return Ramp(s, lo, hi, True)


_pa, _se, _sc, _gr, _ic = "prompt_ambiguity", "semantic_entropy", "self_consistency", "gold_recall_in_context", "is_correct"
_sup, _rel, _ga, _par, _ext = "answer_supported_by_context", "max_chunk_relevance", "gold_attention_ratio", "parametric_knowledge_score", "external_context_score"
_al, _st, _gp, _mh = "logit_lens_answer_layer", "logit_lens_stability", "gold_patch_effect", "multihop_query"

# Names, weights and thresholds of the rules.
RULES = (
    Rule("amb.signal", MODES[0], 3.0, (up(_pa, 0.4, 0.9),), ((0.4, down(_pa, 0.1, 0.4)),)),
    Rule("amb.entropy_valid", MODES[0], 1.2, (up(_se, 0.3, 0.8), up(_pa, 0.4, 0.9))),
    Rule("ret.gold_absent", MODES[1], 2.4, (down(_gr, 0.3, 0.6),)),
    Rule("ret.irrelevant", MODES[1], 1.6, (down(_rel, 0.1, 0.35), down(_sup, 0.2, 0.5))),
    Rule("dil.present_wrong", MODES[2], 2.0, (up(_gr, 0.5, 0.9), down(_ic, 0.5, 1.0))),
    Rule("dil.buried", MODES[2], 1.4, (Middle("gold_position_frac"), up("n_chunks", 4, 10), up("context_length_tokens", 60, 400))),
    Rule("dil.gold_unattended", MODES[2], 1.6, (down(_ga, 0.1, 0.3), up(_gr, 0.5, 0.9))),
    Rule("dil.attended", MODES[2], -1.4, (up(_ga, 0.3, 0.55),)),
    Rule("hal.redeep", MODES[3], 2.2, (down(_sup, 0.2, 0.5), up(_par, 0.5, 0.85), down(_ext, 0.2, 0.5))),
    Rule("hal.confab", MODES[3], 1.5, (down(_sup, 0.2, 0.5), up(_se, 0.3, 0.8))),
    Rule("hal.override", MODES[3], 2.4, (up(_gr, 0.5, 0.9), up(_ga, 0.25, 0.45), up(_par, 0.6, 0.85), down(_al, 0.3, 0.55))),
    Rule("hal.override_causal", MODES[3], 1.6, (up(_gr, 0.5, 0.9), up(_ga, 0.25, 0.45), up(_par, 0.55, 0.8), down(_ic, 0.5, 1.0), down(_gp, 0.15, 0.45))),
    Rule("hal.confab_nonrag", MODES[3], 1.8, (up(_se, 0.35, 0.8), down(_sc, 0.3, 0.7))),
    Rule("reason.hops_present", MODES[4], 2.0, (Raw(_mh), up(_gr, 0.5, 0.9), down(_ic, 0.5, 1.0))),
    Rule("reason.late_unstable", MODES[4], 1.5, (up(_al, 0.75, 0.95), down(_st, 0.3, 0.6))),
    Rule("amb.explains_dilution", MODES[2], -1.8, (up(_pa, 0.55, 0.9),)),
    Rule("amb.explains_reasoning", MODES[4], -1.2, (up(_pa, 0.55, 0.9),)),
    Rule("ok.suppress_dilution", MODES[2], -1.6, (up(_ic, 0.5, 1.0),)),
    Rule("ok.suppress_reasoning", MODES[4], -1.6, (up(_ic, 0.5, 1.0),)),
    Rule("ok.suppress_halluc", MODES[3], -1.0, (up(_ic, 0.5, 1.0), up(_sup, 0.5, 0.9))),
)


def _column(f: object) -> Column:
    if isinstance(f, Raw):
        return F.col(f.signal)
    if isinstance(f, Middle):
        return 1 - F.abs(F.col(f.signal) - 0.5) * 2
    rise = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(f.signal) - f.lo) / (f.hi - f.lo)))
    return 1 - rise if f.falling else rise


def _sql(f: object) -> str:
    if isinstance(f, Raw):
        return f.signal
    if isinstance(f, Middle):
        return f"(1 - abs({f.signal} - 0.5) * 2)"
    rise = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({f.signal} - {f.lo}::DOUBLE) / {f.hi - f.lo!r}::DOUBLE))"
    return f"(1 - {rise})" if f.falling else rise


def contribution(r: Rule) -> Column:
    """Weighted activation; null where a required signal is missing or nothing is added."""
    act = _column(r.factors[0])
    for f in r.factors[1:]:
        act = act * _column(f)
    for s, f in r.less:
        act = act - F.lit(s) * _column(f)
    known = F.col(r.required[0]).isNotNull()
    for s in r.required[1:]:
        known = known & F.col(s).isNotNull()
    value = F.lit(r.weight) * act
    return F.when(known & (F.abs(value) >= SMALLEST), value)


def contribution_sql(r: Rule) -> str:
    act = " * ".join(_sql(f) for f in r.factors)
    for s, f in r.less:
        act = f"({act}) - {s}::DOUBLE * {_sql(f)}"
    known = " AND ".join(f"{s} IS NOT NULL" for s in r.required)
    return f"CASE WHEN {known} AND abs({r.weight}::DOUBLE * ({act})) >= 0.000001 THEN {r.weight}::DOUBLE * ({act}) END"


def column_name(r: Rule) -> str:
    return "rule_" + r.name.replace(".", "_")


def fire(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds a contribution column for each rule and the log-odds z_<mode> of each mode."""
    out = df.withColumns({column_name(r): contribution(r) for r in rules})
    z = {}
    for m in MODES:
        total = F.lit(PRIOR)
        for r in rules:
            if r.mode == m:
                total = total + F.coalesce(F.col(column_name(r)), F.lit(0.0))
        z[f"z_{m}"] = total
    return out.withColumns(z)


def fired(df: DataFrame, key: str = "row_no", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rule, mode, contribution) of each rule that fired."""
    lines = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.mode).alias("mode"), F.col(column_name(r)).alias("contribution")) for r in rules])
    return df.select(key, F.explode(F.filter(lines, lambda x: x["contribution"].isNotNull())).alias("l")).select(key, "l.rule", "l.mode", F.round("l.contribution", 6).alias("contribution"))
