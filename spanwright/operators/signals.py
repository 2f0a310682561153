"""Signals of a trace as nullable columns. A missing signal is null, never zero.

Each operator takes the trace columns (id, prompt, question, generated_answer, retrieved_context, ground_truth) and adds
columns; nothing is shuffled. Token sets are made once, in a select of their own, since lambdas don't share work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Signals in order with their family and lowest tier.
SIGNALS: dict[str, tuple[str, str]] = {
    "prompt_ambiguity": ("prompt", "black"),
    "prompt_n_content_words": ("prompt", "black"),
    "multihop_query": ("prompt", "black"),
    "answer_supported_by_context": ("retrieval", "black"),
    "max_chunk_relevance": ("retrieval", "black"),
    "mean_chunk_relevance": ("retrieval", "black"),
    "n_chunks": ("retrieval", "black"),
    "context_length_tokens": ("retrieval", "black"),
    "gold_position_frac": ("retrieval", "black"),
    "gold_recall_in_context": ("retrieval", "black"),
    "semantic_entropy": ("confidence", "black"),
    "self_consistency": ("confidence", "black"),
    "mean_token_entropy": ("confidence", "grey"),
    "max_token_entropy": ("confidence", "grey"),
    "answer_perplexity": ("confidence", "grey"),
    "context_attention_ratio": ("mechanistic", "grey"),
    "gold_attention_ratio": ("mechanistic", "grey"),
    "logit_lens_answer_layer": ("mechanistic", "grey"),
    "logit_lens_stability": ("mechanistic", "grey"),
    "external_context_score": ("mechanistic", "grey"),
    "parametric_knowledge_score": ("mechanistic", "grey"),
    "gold_patch_effect": ("mechanistic", "white"),
    "is_correct": ("meta", "black"),
    "answer_length_tokens": ("meta", "black"),
}
TIERS = ("black", "grey", "white")
FAMILIES = ("confidence", "mechanistic", "prompt", "retrieval")
CORRECT, GOLD_SUPPORT = 0.6, 0.35


def tokens(traces: DataFrame) -> DataFrame:
    """Token columns of a trace: query, answer, chunks, references, and whether it retrieved and has a reference."""
    refs = F.filter(F.coalesce("ground_truth", F.array()), lambda r: r.isNotNull() & (F.length(F.trim(r)) > 0))
    query = F.coalesce(F.when(F.length("question") > 0, F.col("question")), F.col("prompt"), F.lit(""))
    # Only the fields that are used are named, so that the scan reads no others.
    none = lambda kind: F.expr(f"CAST(array() AS array<{kind}>)")
    return (
        traces.withColumns({"query": query, "is_rag": F.col("retrieved_context.text").isNotNull(), "refs": refs})
        .withColumns(
            {
                "has_reference": F.size("refs") > 0,
                "q_tok": X.token_set(F.col("query")),
                "q_list": X.token_list(F.col("query")),
                "a_list": X.token_list(F.col("generated_answer")),
                "c_list": F.coalesce(F.transform("retrieved_context.text", lambda t: X.token_list(t)), none("array<string>")),
                "c_gold": F.coalesce(F.transform("retrieved_context.gold", lambda g: F.coalesce(g, F.lit(False))), none("boolean")),
                "r_tok": F.transform("refs", lambda r: X.token_set(r)),
            }
        )
        .withColumns({"a_tok": F.array_distinct("a_list"), "c_tok": F.transform("c_list", lambda c: F.array_distinct(c))})
        .withColumns({"a_content": X.content_set(F.col("a_tok")), "r_content": F.transform("r_tok", lambda r: X.content_set(r))})
    )


def _gold_index() -> Column:
    """0-based place of the first gold chunk, else of the best supported one above the threshold; null for none."""
    flagged = F.array_position("c_gold", True).cast("int") - 1
    use = F.when(F.size(F.coalesce("ground_truth", F.array())) > 0, F.transform(F.filter("r_content", lambda r: F.lit(True)), lambda r: r)).otherwise(F.array("a_content"))
    score = F.transform("c_tok", lambda c: F.round(F.coalesce(F.array_max(F.transform(use, lambda h: X.support_one(h, c))), F.lit(0.0)), 4))
    best = F.array_max(score)
    return F.when(flagged >= 0, flagged).when(best > GOLD_SUPPORT, F.array_position(score, best).cast("int") - 1)


def black_signals(tokened: DataFrame) -> DataFrame:
    """Adds the signals that need no model: prompt, retrieval and correctness."""
    q, rag = F.col("query"), F.col("is_rag")
    rel = F.transform("c_tok", lambda c: X.relevance(F.col("q_tok"), c))
    n = F.size("c_tok")
    mean = F.when(n > 0, F.round(F.aggregate(rel, F.lit(0.0), lambda a, x: a + x) / n + 1e-9, 4)).otherwise(0.0)
    recall = F.round(F.coalesce(F.array_max(F.transform("r_content", lambda r: F.coalesce(F.array_max(F.transform("c_tok", lambda c: X.support_one(r, c))), F.lit(0.0)))), F.lit(0.0)), 4)
    out = tokened.withColumn("gold_index", F.when(rag, _gold_index()))
    return out.withColumns(
        {
            "prompt_ambiguity": X.ambiguity(q),
            "prompt_n_content_words": F.size("q_list").cast("double"),
            "multihop_query": X.multihop(q),
            "answer_supported_by_context": F.when(rag, X.support(F.col("a_content"), F.col("c_tok"))),
            "max_chunk_relevance": F.when(rag, F.coalesce(F.array_max(rel), F.lit(0.0))),
            "mean_chunk_relevance": F.when(rag, mean),
            "n_chunks": F.when(rag, n.cast("double")),
            "context_length_tokens": F.when(rag, F.aggregate("c_list", F.lit(0), lambda a, c: a + F.size(c)).cast("double")),
            "gold_position_frac": F.when(rag & (n > 1), F.col("gold_index") / (n - 1)),
            "gold_recall_in_context": F.when(rag & F.col("has_reference"), recall),
            "is_correct": F.when(F.col("has_reference"), F.when(X.match(F.col("a_tok"), F.col("r_tok")) >= CORRECT, 1.0).otherwise(0.0)),
            "answer_length_tokens": F.size("a_list").cast("double"),
        }
    )


def missing_others(df: DataFrame) -> DataFrame:
    """Adds every signal that isn't there as null."""
    return df.withColumns({s: F.lit(None).cast("double") for s in SIGNALS if s not in df.columns})


def log_signals(traces: DataFrame) -> DataFrame:
    """All 24 signals of logged traces without a model: what needs one stays null. Token columns are dropped."""
    out = missing_others(black_signals(tokens(traces)))
    return out.drop("q_tok", "q_list", "a_list", "c_list", "c_gold", "r_tok", "a_tok", "c_tok", "a_content", "r_content", "refs", "gold_index")


def present(family: str) -> Column:
    """Whether any signal of a family is there."""
    flags = [F.col(s).isNotNull() for s, (f, _) in SIGNALS.items() if f == family]
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def signature() -> Column:
    """The families present, joined, with a mark where there is no reference."""
    fams = F.array_join(F.filter(F.array(*[F.when(present(f), F.lit(f)) for f in FAMILIES]), lambda x: x.isNotNull()), "+")
    return F.concat(F.when(fams == "", "none").otherwise(fams), F.when(F.col("has_reference"), "").otherwise("|noref"))


def long_form(df: DataFrame, key: str = "row_no") -> DataFrame:
    """(key, signal, value) of the signals that are there."""
    return df.select(key, *SIGNALS).unpivot(key, list(SIGNALS), "signal", "value").where("value IS NOT NULL")


def dense_vector() -> Column:
    """Signals in fixed order as an array, 0 where missing, followed by their missing marks."""
    return F.array(*[F.coalesce(F.col(s), F.lit(0.0)) for s in SIGNALS], *[F.col(s).isNull().cast("double") for s in SIGNALS])


def observe_with_noise(df: DataFrame, sigma: float, order: str = "row_no") -> DataFrame:
    """Signals blurred by a repeatable noise keyed on the row and the signal; correctness flips with chance 0.2 sigma."""
    bounded = [s for s in SIGNALS if s not in ("n_chunks", "context_length_tokens", "prompt_n_content_words", "answer_length_tokens", "is_correct", "multihop_query", "answer_perplexity")]
    unit = lambda s: X.seeded_unit(F.lit("noise"), F.col(order), F.lit(s))
    cols = {s: F.when(F.col(s).isNotNull(), F.greatest(F.least(F.col(s) + sigma * 0.5 * (2 * unit(s) - 1), F.lit(1.0)), F.lit(0.0))) for s in bounded}
    cols["is_correct"] = F.when(F.col("is_correct").isNotNull(), F.when(unit("is_correct") < 0.2 * sigma, 1 - F.col("is_correct")).otherwise(F.col("is_correct")))
    return df.withColumns(cols)
