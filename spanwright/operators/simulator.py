"""A deterministic stand-in for a model: what it would answer to a trace, how sure it would be, and what it attended to.

Its world is described by hints (struct sim, or the member _sim of meta). Every result is a column expression of prompt,
context, references and hints, so a changed trace can be run again within the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import barrier

SIM = "struct<answer:string,distractor:string,gold_fact:string,ambiguous:boolean,readings:array<string>,requires_multihop:boolean,hard_composition:boolean,parametric_known:boolean,parametric_override:boolean>"
SAMPLES = 8

# Entropy of each kind of decision, and what a capture of it reads:
# context attention, gold attention, external, parametric, answer layer, stability, patch effect.
ENTROPY = {"ambiguous": 1.2, "override": 0.28, "reasoning": 0.85, "grounded": 0.22, "parametric": 0.30, "fabricated": 1.45}
CAPTURE = {
    "grounded": (0.62, 0.55, 0.70, 0.35, 0.70, 0.90, 0.8),
    "parametric": (0.18, 0.10, 0.20, 0.82, 0.30, 0.85, None),
    "override": (0.45, 0.42, 0.35, 0.88, 0.28, 0.88, 0.05),
    "ambiguous": (0.50, 0.40, 0.55, 0.40, 0.40, 0.85, 0.3),
    "reasoning": (0.50, 0.45, 0.55, 0.50, 0.90, 0.35, 0.05),
    "diluted": (0.35, 0.12, 0.40, 0.55, 0.80, 0.50, 0.05),
    "fabricated": (0.15, 0.05, 0.15, 0.85, 0.35, 0.80, 0.02),
}
CAPTURED = ("context_attention_ratio", "gold_attention_ratio", "external_context_score", "parametric_knowledge_score", "logit_lens_answer_layer", "logit_lens_stability", "gold_patch_effect")
GUESSES = ("a different guess", "yet another guess")


def with_hints(traces: DataFrame) -> DataFrame:
    """Adds sim from meta where it isn't a column yet; missing hints are null."""
    if "sim" in traces.columns:
        return traces
    return traces.withColumn("sim", F.from_json(F.get_json_object("meta", "$._sim"), SIM))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def decide(prompt: Column, context: Column, refs: Column, sim: Column) -> Column:
    """struct(kind, answer, correct, gold_present, position, n_chunks, words) of a trace."""
    answer = F.coalesce(sim["answer"], F.get(refs, F.lit(0)), F.lit(""))
    distractor = F.coalesce(sim["distractor"], F.lit("an unrelated entity"))
    chunks = F.coalesce(context, F.expr("CAST(array() AS array<struct<text:string,retriever_score:double,source_id:string,gold:boolean,char_span:struct<start:int,end:int>>>)"))
    joined = F.array_join(F.transform(chunks, lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    fact = F.coalesce(sim["gold_fact"], answer)
    flag = F.array_position(F.transform(chunks, lambda c: _yes(c["gold"])), True).cast("int") - 1
    n = F.size(chunks)
    gold = (flag >= 0) | X.contains_text(F.concat(F.coalesce(prompt, F.lit("")), F.lit(" "), joined), fact)
    position = F.when((flag >= 0) & (n > 1), flag / (n - 1)).otherwise(0.0)
    n_words = F.size(X.token_list(joined))
    ambiguous = _yes(sim["ambiguous"]) | (F.coalesce(F.size(sim["readings"]), F.lit(0)) > 0)
    readings = F.when(F.coalesce(F.size(sim["readings"]), F.lit(0)) > 0, sim["readings"]).otherwise(F.array(answer, distractor))
    other = F.coalesce(F.get(F.filter(readings, lambda r: ~X.contains_text(answer, r)), F.lit(0)), F.get(readings, F.lit(0)))
    diluted = gold & (n >= 5) & (position >= 0.2) & (position <= 0.8) & (n_words > 150)
    kind = (
        F.when(ambiguous, "ambiguous")
        .when(_yes(sim["parametric_override"]) & gold, "override")
        .when(_yes(sim["requires_multihop"]) & _yes(sim["hard_composition"]) & gold, "reasoning")
        .when(gold & ~diluted, "grounded")
        .when(_yes(sim["parametric_known"]), "parametric")
        .otherwise("fabricated")
    )
    said = F.when(kind == "ambiguous", other).when(kind.isin("grounded", "parametric"), answer).otherwise(distractor)
    right = F.when(kind == "ambiguous", (F.size(refs) > 0) & X.contains_text(other, F.get(refs, F.lit(0)))).otherwise(kind.isin("grounded", "parametric"))
    return F.struct(kind.alias("kind"), said.alias("answer"), _yes(right).alias("correct"), gold.alias("gold_present"), position.alias("position"), n.alias("n_chunks"), n_words.alias("words"), readings.alias("readings"), (F.coalesce(F.size(sim["readings"]), F.lit(0)) > 0).alias("has_readings"))


def _by_kind(kind: Column, values: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in values.items()])


def samples(d: Column, prompt: Column, k: int = SAMPLES) -> Column:
    """k answers at temperature one; only what isn't grounded or known varies."""
    pool = F.when((d["kind"] == "ambiguous") & d["has_readings"], d["readings"]).otherwise(F.array(d["answer"], *[F.lit(g) for g in GUESSES]))
    steady = d["kind"].isin("grounded", "parametric")
    pick = lambda s: F.get(pool, F.pmod(F.floor(X.seeded_unit(prompt, s) * F.size(pool)).cast("int"), F.size(pool)))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.when(steady, d["answer"]).otherwise(pick(s)))


def token_entropies(d: Column, prompt: Column, seed: int = 0) -> Column:
    """Entropy of each word of the answer; its log-probability is the negative of it."""
    h = _by_kind(d["kind"], ENTROPY)
    return F.transform(F.split(d["answer"], " "), lambda _, i: F.round(F.greatest(F.lit(0.02), h * (0.7 + 0.6 * X.seeded_unit(prompt, F.lit(seed), i))), 4))


def capture(d: Column, white: bool) -> dict[str, Column]:
    """What looking inside the model would show."""
    kind = F.when((d["kind"] == "fabricated") & d["gold_present"], "diluted").otherwise(d["kind"])
    out = {c: _by_kind(kind, {k: v[i] for k, v in CAPTURE.items() if v[i] is not None}) for i, c in enumerate(CAPTURED)}
    bury = F.when(d["gold_present"] & (d["n_chunks"] >= 5), 1 - 0.5 * (1 - F.abs(d["position"] - 0.5) * 2)).otherwise(1.0)
    out["gold_attention_ratio"] = F.round(out["gold_attention_ratio"] * bury, 3)
    patch = F.when(kind == "parametric", F.when(d["gold_present"], 0.05).otherwise(0.02)).otherwise(out["gold_patch_effect"])
    out["gold_patch_effect"] = patch if white else F.lit(None).cast("double")
    return out


def simulate(traces: DataFrame) -> DataFrame:
    """Adds the decision of the stand-in for each trace as a struct."""
    t = with_hints(traces)
    refs = F.filter(F.coalesce("ground_truth", F.array()), lambda r: F.length(F.trim(r)) > 0)
    return barrier(t.withColumn("decision", decide(F.col("prompt"), F.col("retrieved_context"), refs, F.col("sim"))))


def model_signals(simulated: DataFrame, tier: str = "white") -> DataFrame:
    """Adds the confidence and mechanistic signals a tier allows; those above it are null."""
    d = F.col("decision")
    cols = {"samples": samples(d, F.col("prompt")), "entropies": token_entropies(d, F.col("prompt"))}
    out = barrier(simulated.withColumns(cols))
    grey = tier in ("grey", "white")
    none = F.lit(None).cast("double")
    e, n = F.col("entropies"), F.size("entropies")
    mean = F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / n
    sig = {"semantic_entropy": X.semantic_entropy(F.col("samples")), "self_consistency": X.self_consistency(F.col("samples"), F.col("generated_answer"))}
    sig |= {"mean_token_entropy": F.round(mean, 4) if grey else none, "max_token_entropy": F.round(F.array_max(e), 4) if grey else none, "answer_perplexity": F.round(F.exp(mean), 4) if grey else none}
    sig |= {k: (v if grey else none) for k, v in capture(d, tier == "white").items()}
    return out.withColumns(sig).drop("samples", "entropies")
