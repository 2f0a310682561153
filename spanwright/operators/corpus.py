"""A labelled corpus made from facts by breaking what works, each row checked by its own signals before it is kept.

Every choice is a seeded function of (label, question, seed), so the corpus is the same on every run and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import barrier
from . import signals as S
from . import simulator as M

FACT = "question string, answer string, gold_fact string, wrong_answer string, ambiguous_question string, parametric boolean, multihop boolean"
#: Invented facts to begin with; any table of these columns will do.
FACTS = [
    ("In which year was the Veldt lighthouse lit?", "1907", "The Veldt lighthouse was lit in 1907 after two winters of work.", "1921", "When was it lit?", True, False),
    ("Which metal is the Corin bridge made of?", "bronze", "The Corin bridge is made of bronze cast in four pieces.", "granite", "What is it made of?", False, False),
    ("Who designed the Ambry reading room?", "Lena Ostrow", "Lena Ostrow designed the Ambry reading room.", "Piet Hallam", "Who designed it?", True, False),
    ("How many steps lead to the Saltern tower?", "212", "Exactly 212 steps lead to the Saltern tower.", "96", "How many lead there?", False, False),
    ("What river runs past the Odell mill?", "Tarrow", "The river Tarrow runs past the Odell mill.", "Linn", "What runs past it?", True, False),
    ("Which plant gives Brennan dye its colour?", "woad", "Brennan dye takes its colour from woad.", "madder", "Which gives it that colour?", False, False),
    ("Which is older, the Pell chapel or the Dunmore gate?", "Dunmore gate", "The Pell chapel dates from 1644. The Dunmore gate dates from 1590.", "Pell chapel", "Which is older?", False, True),
    ("Which is taller, Mount Arden or Mount Sele?", "Mount Sele", "Mount Arden rises 1210 metres. Mount Sele rises 1344 metres.", "Mount Arden", "Which is taller?", False, True),
]
RECIPES = ("clean", "retrieval_failure", "retrieval_failure+parametric", "context_dilution", "prompt_ambiguity", "hallucination", "hallucination_override", "reasoning_failure")
POOL = [f"{a} {b} {c}." for a in ("The harbour office", "A survey of the coast", "The almanac", "The village council", "An old ledger") for b in ("lists", "describes", "forgot", "compared", "counted") for c in ("market days and tolls", "carts on the north road", "winters without frost", "lamps along the quay", "the price of rope")]


def facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTS, FACT)


def unit(label: str, *more: Column) -> Column:
    return X.seeded_unit(F.lit(label), F.col("question"), F.col("seed"), *more, divisor=4294967296)


def between(label: str, lo: int, hi: int) -> Column:
    return (F.floor(unit(label) * (hi - lo + 1)) + lo).cast("int")


def fillers(label: str, n: Column, sentences: Column) -> Column:
    """n chunks that share no word with the answer: a walk through the pool with stride five."""
    pool = F.array(*[F.lit(p) for p in POOL])
    size = len(POOL)
    start = F.floor(unit(label) * size).cast("int")
    walk = F.transform(F.sequence(F.lit(0), F.lit(6 * 14)), lambda i: F.array_join(F.transform(F.sequence(F.lit(0), sentences - 1), lambda j: F.get(pool, F.pmod(start + 5 * i + j, F.lit(size)))), " "))
    answer = X.token_set(F.col("answer"))
    free = F.array_distinct(F.filter(walk, lambda t: ~F.arrays_overlap(X.token_set(t), answer)))
    return F.transform(F.slice(free, F.lit(1), n), lambda t: chunk(t, False))


def chunk(text: Column, gold: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(None).cast("double").alias("retriever_score"), F.lit(None).cast("string").alias("source_id"), F.lit(gold).alias("gold"), F.expr("CAST(NULL AS struct<start:int,end:int>)").alias("char_span"))


def place(fill: Column, at: Column) -> Column:
    """The gold chunk among fillers, at a share of their number rounded half to even."""
    i = F.bround(at * F.size(fill)).cast("int")
    return F.concat(F.slice(fill, F.lit(1), i), F.array(chunk(F.col("gold_fact"), True)), F.slice(fill, i + 1, F.lit(64)))


def _row(df: DataFrame, recipe: str, labels: list[str], context: Column, question: Column | None = None, **hints: Column) -> DataFrame:
    q = question if question is not None else F.col("question")
    fields = {"answer": F.col("answer"), "distractor": F.col("wrong_answer"), "gold_fact": F.col("gold_fact")} | hints
    sim = F.struct(*[(fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in _sim_fields()])
    out = df.withColumns({"retrieved_context": context.cast(f"array<{_CHUNK}>"), "sim": sim, "asked": q})
    prompt = F.concat(F.col("asked"), F.lit("\n"), F.array_join(F.transform(F.coalesce("retrieved_context", F.array()), lambda c: c["text"]), " "))
    return out.select(
        F.concat_ws("/", F.lit(recipe), F.substring(F.sha1("question"), 1, 8), "seed").alias("id"), prompt.alias("prompt"), F.col("asked").alias("question"), F.col("retrieved_context").cast(f"array<{_CHUNK}>").alias("retrieved_context"),
        F.array("answer").alias("ground_truth"), "sim", F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias("labels"), F.lit(recipe).alias("injection_recipe"), F.lit("synthetic").alias("provenance"),
    )


_CHUNK = "struct<text:string,retriever_score:double,source_id:string,gold:boolean,char_span:struct<start:int,end:int>>"


def _sim_fields() -> list[tuple[str, str]]:
    return [("answer", "string"), ("distractor", "string"), ("gold_fact", "string"), ("ambiguous", "boolean"), ("readings", "array<string>"), ("requires_multihop", "boolean"), ("hard_composition", "boolean"), ("parametric_known", "boolean"), ("parametric_override", "boolean")]


def build(facts_: DataFrame, seeds: int = 4) -> DataFrame:
    """The corpus: every recipe on every fact and seed, answered by the stand-in, gated, first of equal rows kept."""
    base = facts_.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    one, multi = base.where("NOT multihop"), base.where("multihop")
    yes = F.lit(True)
    fill = lambda label, lo, hi, s=1: fillers(label + "_fill", between(label + "_n", lo, hi), F.lit(s) if isinstance(s, int) else s)
    none = F.lit(None)
    n_dil = between("dil_n", 6, 13)
    dil = fillers("dil_fill", n_dil, F.greatest(F.lit(3), F.ceil(F.lit(240) / (8 * n_dil))).cast("int"))
    rows = [
        _row(one, "clean", [], F.when(F.col("parametric") & (unit("clean_nonrag") < 0.25), none).otherwise(place(fill("clean", 2, 11), unit("clean_pos"))), parametric_known=F.col("parametric")),
        _row(one, "retrieval_failure", ["retrieval_failure", "hallucination"], fill("ret", 2, 11, between("ret_len", 1, 3))),
        _row(one.where("parametric"), "retrieval_failure+parametric", ["retrieval_failure"], fill("retp", 2, 11, between("retp_len", 1, 3)), parametric_known=yes),
        _row(one, "context_dilution", ["context_dilution"], place(dil, 0.3 + 0.4 * unit("dil_pos"))),
        _row(one, "prompt_ambiguity", ["prompt_ambiguity"], F.when(unit("amb_nonrag") < 0.3, none).otherwise(place(fill("amb", 2, 11), unit("amb_pos"))), F.col("ambiguous_question"), ambiguous=yes, readings=F.array("answer", "wrong_answer")),
        _row(one, "hallucination", ["hallucination"], none),
        _row(one, "hallucination_override", ["hallucination"], place(fill("ovr", 2, 10), F.floor(unit("ovr_pos") * 2)), parametric_override=yes),
        _row(multi, "reasoning_failure", ["reasoning_failure"], place(fill("rea", 2, 11), unit("rea_pos")), requires_multihop=yes, hard_composition=yes),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    sim = M.simulate(out.withColumn("meta", F.lit(None).cast("string")))
    answered = barrier(sim.withColumn("generated_answer", F.col("decision.answer")))
    featured = barrier(S.missing_others(S.black_signals(S.tokens(M.model_signals(answered, "white")))))
    gate = (
        F.when(F.col("injection_recipe") == "clean", F.col("is_correct") == 1)
        .when(F.col("injection_recipe") == "retrieval_failure", (F.col("gold_recall_in_context") < 0.3) & (F.col("is_correct") == 0))
        .when(F.col("injection_recipe") == "retrieval_failure+parametric", (F.col("gold_recall_in_context") < 0.3) & (F.col("is_correct") == 1))
        .when(F.col("injection_recipe").isin("context_dilution", "hallucination_override"), (F.col("gold_recall_in_context") >= 0.6) & (F.col("is_correct") == 0))
        .when(F.col("injection_recipe") == "prompt_ambiguity", (F.col("prompt_ambiguity") >= 0.5) & (F.col("is_correct") == 0))
        .when(F.col("injection_recipe") == "hallucination", (F.col("is_correct") == 0) & (F.col("semantic_entropy") > 0.15))
        .otherwise((F.col("multihop_query") == 1) & (F.col("gold_recall_in_context") >= 0.6) & (F.col("is_correct") == 0))
    )
    # Of equal rows the first in order of recipe, question and seed stands.
    order = F.array_position(F.array(*[F.lit(r) for r in RECIPES]), F.col("injection_recipe"))
    ranked = featured.where(gate).withColumn("_place", F.row_number().over(Window.partitionBy("prompt", "generated_answer", "labels").orderBy(order, "id")))
    kept = ranked.where("_place = 1").drop("_place")
    drop = ("q_tok", "q_list", "a_list", "c_list", "c_gold", "r_tok", "a_tok", "c_tok", "a_content", "r_content", "refs", "gold_index", "decision")
    return kept.drop(*drop).withColumn("row_no", F.abs(F.xxhash64("id"))).withColumn("source", F.lit("corpus"))
