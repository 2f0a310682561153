"""Corrective actions and what a second run says of them. Each action edits the trace within its row and runs it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import barrier
from . import simulator as M
from .rules import MODES
from .triage import ACTIONS

FLOOR = 0.4
PRIORITY = {"primary_root": 0, "contributing": 1, "sequela": 2}


def _chunk(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(0.99).alias("retriever_score"), F.lit("gold").alias("source_id"), F.lit(True).alias("gold"), F.expr("CAST(NULL AS struct<start:int,end:int>)").alias("char_span"))


def rewrites(refs: Column, sim: Column, context: Column) -> dict[str, tuple[Column, Column]]:
    """(context, hints) of the trace after each action; null context where nothing is retrieved."""
    chunks = F.coalesce(context, F.expr("CAST(array() AS array<struct<text:string,retriever_score:double,source_id:string,gold:boolean,char_span:struct<start:int,end:int>>>)"))
    fact = F.coalesce(sim["gold_fact"], F.get(refs, F.lit(0)))
    plain = F.filter(chunks, lambda c: ~F.coalesce(c["gold"], F.lit(False)))
    flagged = F.filter(chunks, lambda c: F.coalesce(c["gold"], F.lit(False)))
    content = X.content_set(X.token_set(F.coalesce(fact, F.lit(""))))
    scored = F.transform(chunks, lambda c, i: F.struct((-X.support_one(content, X.token_set(c["text"]))).alias("k"), i.alias("i"), c.alias("c")))
    best = F.get(F.transform(F.array_sort(scored), lambda x: x["c"]), F.lit(0))
    gold_first = F.when(F.size(flagged) > 0, flagged[0]).otherwise(best)
    grounded = F.when(fact.isNotNull(), F.concat(F.array(_chunk(fact)), plain)).otherwise(chunks)
    reranked = F.when(F.size(chunks) > 0, F.concat(F.array(gold_first), F.slice(F.filter(plain, lambda c: c["text"] != gold_first["text"]), 1, 2))).otherwise(chunks)
    sim0 = F.coalesce(sim, F.from_json(F.lit("{}"), M.SIM))
    clear = sim0.withField("ambiguous", F.lit(False)).withField("readings", F.expr("CAST(NULL AS array<string>)"))
    easy = sim0.withField("hard_composition", F.lit(False))
    keep = lambda c: F.when(F.size(c) > 0, c)
    return {"clarify_prompt": (keep(chunks), clear), "add_gold_context": (keep(grounded), sim0), "rerank_gold_first": (keep(reranked), sim0), "ground_or_abstain": (keep(grounded), sim0), "decompose_question": (keep(chunks), easy)}


def recommend(reports: DataFrame) -> DataFrame:
    """Adds recommendations: array of (action, mode, priority, validated) of each mode likely enough and with a role.

    validated is null where there is no reference to hold the second answer against, or the answer was right before.
    """
    t = M.with_hints(reports)
    refs = F.filter(F.coalesce("ground_truth", F.array()), lambda r: F.length(F.trim(r)) > 0)
    # Edits, prompts, second answers and verdicts are made one after the other, each from columns of the step before.
    t = t.withColumns({"_refs": refs, "_query": F.coalesce(F.when(F.length("question") > 0, F.col("question")), F.col("prompt"))})
    edited = rewrites(F.col("_refs"), F.col("sim"), F.col("retrieved_context"))
    distinct = {a: e for a, e in edited.items() if a != "ground_or_abstain"}
    t = barrier(t.withColumns({f"_ctx_{a}": ctx for a, (ctx, _) in distinct.items()} | {f"_sim_{a}": sim for a, (_, sim) in distinct.items()}))
    t = barrier(t.withColumns({f"_prompt_{a}": F.concat_ws("\n", "_query", F.array_join(F.transform(f"_ctx_{a}", lambda c: c["text"]), " ")) for a in distinct}))
    for a in distinct:
        t = barrier(t.withColumn(f"_said_{a}", M.decide(F.col(f"_prompt_{a}"), F.col(f"_ctx_{a}"), F.col("_refs"), F.col(f"_sim_{a}"))["answer"]))
    scored = (F.size("_refs") > 0) & F.coalesce(F.col("is_correct") == 0, F.lit(False))
    right = {a: F.when(scored, X.match(X.token_set(F.col(f"_said_{a}")), F.transform("_refs", lambda r: X.token_set(r))) >= 0.6) for a in distinct}
    runs = {f"fix_{a}": right["add_gold_context" if a == "ground_or_abstain" else a] for a in edited}
    out = barrier(t.withColumns(runs))
    out = out.drop(*[c for c in out.columns if c.startswith("_")])
    rank = lambda role: F.coalesce(*[F.when(role == r, F.lit(p)) for r, p in PRIORITY.items()])
    items = [F.when((F.col(f"p_{m}") >= FLOOR) & F.col(f"role_{m}").isNotNull(), F.struct(rank(F.col(f"role_{m}")).alias("priority"), F.lit(i).alias("ordinal"), F.lit(ACTIONS[m]).alias("action"), F.lit(m).alias("mode"), F.col(f"fix_{ACTIONS[m]}").alias("validated"))) for i, m in enumerate(MODES)]
    return out.withColumn("recommendations", F.array_sort(F.filter(F.array(*items), lambda x: x.isNotNull()))).drop(*runs)


def outcomes(recommended: DataFrame) -> DataFrame:
    """(row_no, primary_mode, headline, action, validated): one row for each trace and distinct action."""
    # Actions of a trace are told apart within its row; nothing is shuffled.
    actions = F.array_distinct(F.transform("recommendations", lambda r: r["action"]))
    said = lambda a: F.filter(F.transform(F.filter("recommendations", lambda r: r["action"] == a), lambda r: r["validated"]), lambda v: v.isNotNull())
    distinct = F.transform(actions, lambda a: F.struct(a.alias("action"), F.when(F.size(said(a)) > 0, F.exists(said(a), lambda v: v)).alias("validated")))
    return recommended.where("bucket = 'diagnosed'").select("row_no", "primary_mode", "headline", F.inline(distinct))


def fix_outcome() -> Column:
    """Of a trace: validated if any action was, else refuted if any was, else unknown."""
    v = F.transform("recommendations", lambda r: r["validated"])
    return F.when(F.exists(v, lambda x: F.coalesce(x, F.lit(False))), "validated").when(F.exists(v, lambda x: ~F.coalesce(x, F.lit(True))), "refuted").otherwise("unknown")
