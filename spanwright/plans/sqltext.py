"""SQL of the signal, rule and diagnosis stages, composed from the same tables as the column expressions."""

from __future__ import annotations

from ..functions import text as X
from ..operators import diagnosis as D
from ..operators import rules as R
from ..operators import signals as S


def lit(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def tset(x: str) -> str:
    return f"list_distinct({tok(x)})"


def content(t: str) -> str:
    rest = f"list_filter({t}, lambda w: NOT list_contains({lit(X.STOP_WORDS)}, w))"
    return f"CASE WHEN len({rest}) > 0 THEN {rest} ELSE {t} END"


def traces(table: str) -> str:
    """CTEs t and f: traces with token lists, then all 24 signals."""
    q = "CASE WHEN length(question) > 0 THEN question ELSE coalesce(prompt, '') END"
    sup = lambda h, c: f"(CASE WHEN len({h}) > 0 THEN len(list_intersect({h}, {c}))::DOUBLE / len({h}) ELSE 0.0 END)"
    rel = "list_transform(c_tok, lambda c: CASE WHEN len(q_tok) > 0 AND len(c) > 0 THEN round(len(list_intersect(q_tok, c))::DOUBLE / len(list_distinct(list_concat(q_tok, c))), 4) ELSE 0.0 END)"
    m1 = "CASE WHEN len(a_tok) = 0 OR len(r) = 0 OR len(list_intersect(a_tok, r)) = 0 THEN 0.0 WHEN len(list_intersect(a_tok, " + content("r") + ")) = len(" + content("r") + ") AND len(a_tok) <= 4 * len(r) + 5 THEN 1.0 ELSE 2 * (len(list_intersect(a_tok, r))::DOUBLE / len(a_tok)) * (len(list_intersect(a_tok, r))::DOUBLE / len(r)) / (len(list_intersect(a_tok, r))::DOUBLE / len(a_tok) + len(list_intersect(a_tok, r))::DOUBLE / len(r)) END"
    use = "CASE WHEN len(coalesce(ground_truth, [])) > 0 THEN r_content ELSE [a_content] END"
    none = ", ".join(f"NULL::DOUBLE AS {s}" for s in S.SIGNALS if s not in _BLACK)
    return f"""
t0 AS (
  SELECT *, {q} AS query, retrieved_context IS NOT NULL AS is_rag,
         list_filter(coalesce(ground_truth, []), lambda r: r IS NOT NULL AND length(trim(r)) > 0) AS refs FROM {table}
),
t1 AS (
  SELECT *, len(refs) > 0 AS has_reference, {tset("query")} AS q_tok, len({tok("query")}) AS q_n, {tset("generated_answer")} AS a_tok, len({tok("generated_answer")}) AS a_n,
         list_transform(coalesce(retrieved_context, []), lambda c: {tset("c.text")}) AS c_tok,
         list_sum(list_transform(coalesce(retrieved_context, []), lambda c: len({tok("c.text")}))) AS c_n,
         list_transform(coalesce(retrieved_context, []), lambda c: coalesce(c.gold, false)) AS c_gold,
         list_transform(refs, lambda r: {tset("r")}) AS r_tok,
         regexp_extract_all(query, '[A-Za-z0-9]+') AS w, regexp_extract_all(query, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*') AS runs
  FROM t0
),
t2 AS (
  SELECT *, {content("a_tok")} AS a_content, list_transform(r_tok, lambda r: {content("r")}) AS r_content, list_transform(w, lambda x: lower(x)) AS low,
         list_transform(w, lambda x, i: i > 1 AND length(x) >= 3 AND regexp_matches(x, '^[A-Z]') AND NOT list_contains({lit(X.QUESTION_STOP)}, lower(x))) AS proper
  FROM t1
),
t3 AS (
  SELECT *, coalesce(list_position(list_transform(low, lambda x: list_contains({lit(X.PRONOUNS)}, x)), true), 0) AS first,
         len(list_filter(low, lambda x: NOT list_contains({lit(X.PRONOUNS)}, x))) AS n_content,
         list_transform(c_tok, lambda c: round(coalesce(list_max(list_transform({use}, lambda h: {sup("h", "c")})), 0.0), 4)) AS c_sup,
         coalesce(list_position(c_gold, true), 0) - 1 AS flagged, {rel} AS rels
  FROM t2
),
t4 AS (
  SELECT *, CASE WHEN is_rag THEN CASE WHEN flagged >= 0 THEN flagged WHEN list_max(c_sup) > {S.GOLD_SUPPORT} THEN list_position(c_sup, list_max(c_sup)) - 1 END END AS gold_index FROM t3
),
f AS (
  SELECT row_no, id, source, is_rag, has_reference, labels_or_null AS labels, split_or_null AS split,
    CASE WHEN len(w) = 0 THEN 0.5 ELSE round(least(1.0, CASE WHEN first > 0 AND len(list_filter(list_slice(proper, 1, first - 1), lambda p: p)) = 0 THEN 0.6 ELSE 0.0 END
      + CASE WHEN n_content <= 4 THEN 0.2 ELSE 0.0 END
      + CASE WHEN first = 0 AND len(list_filter(proper, lambda p: p)) = 0 AND n_content <= 4 THEN 0.2 ELSE 0.0 END
      + CASE WHEN (list_contains(low, 'when') OR list_contains(low, 'how')) AND list_has_any(low, {lit(X.VAGUE_TIME)}) THEN 0.1 ELSE 0.0 END), 4) END::DOUBLE AS prompt_ambiguity,
    q_n::DOUBLE AS prompt_n_content_words,
    CASE WHEN list_has_any(q_tok, {lit(X.COMPARISON)}) OR len(list_filter(runs, lambda r: NOT (list_contains({lit(X.LEADING_WORDS)}, r)))) >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS multihop_query,
    CASE WHEN is_rag THEN round(coalesce(list_max(list_transform(c_tok, lambda c: {sup("a_content", "c")})), 0.0), 4) END AS answer_supported_by_context,
    CASE WHEN is_rag THEN coalesce(list_max(rels), 0.0) END AS max_chunk_relevance,
    CASE WHEN is_rag THEN CASE WHEN len(rels) > 0 THEN round(list_sum(rels) / len(rels) + 1e-9, 4) ELSE 0.0 END END AS mean_chunk_relevance,
    CASE WHEN is_rag THEN len(c_tok)::DOUBLE END AS n_chunks,
    CASE WHEN is_rag THEN coalesce(c_n, 0)::DOUBLE END AS context_length_tokens,
    CASE WHEN is_rag AND len(c_tok) > 1 THEN gold_index::DOUBLE / (len(c_tok) - 1) END AS gold_position_frac,
    CASE WHEN is_rag AND has_reference THEN round(coalesce(list_max(list_transform(r_content, lambda r: coalesce(list_max(list_transform(c_tok, lambda c: {sup("r", "c")})), 0.0))), 0.0), 4) END AS gold_recall_in_context,
    CASE WHEN has_reference THEN CASE WHEN round(coalesce(list_max(list_transform(r_tok, lambda r: {m1})), 0.0), 4) >= {S.CORRECT} THEN 1.0 ELSE 0.0 END END::DOUBLE AS is_correct,
    a_n::DOUBLE AS answer_length_tokens, {none}
  FROM t4
)"""


_BLACK = ("prompt_ambiguity", "prompt_n_content_words", "multihop_query", "answer_supported_by_context", "max_chunk_relevance", "mean_chunk_relevance", "n_chunks", "context_length_tokens", "gold_position_frac", "gold_recall_in_context", "is_correct", "answer_length_tokens")


def features(table: str) -> str:
    labeled = table == "labeled_inference"
    return traces(table).replace("labels_or_null", "labels" if labeled else "NULL::VARCHAR[]").replace("split_or_null", "split" if labeled else "NULL::VARCHAR")


def present(family: str) -> str:
    return "(" + " OR ".join(f"{s} IS NOT NULL" for s, (f, _) in S.SIGNALS.items() if f == family) + ")"


def signature() -> str:
    parts = ", ".join(f"CASE WHEN {present(f)} THEN '{f}' END" for f in S.FAMILIES)
    joined = f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), '+')"
    return f"(CASE WHEN {joined} = '' THEN 'none' ELSE {joined} END || CASE WHEN has_reference THEN '' ELSE '|noref' END)"


def diagnosed(table: str, rules: tuple[R.Rule, ...] = R.RULES) -> str:
    """CTEs up to d: one row per trace with contributions, log-odds, probabilities, roles and decision."""
    contrib = ", ".join(f"{R.contribution_sql(r)} AS {R.column_name(r)}" for r in rules)
    zs = []
    for m in R.MODES:
        z = f"{R.PRIOR}::DOUBLE" + "".join(f" + coalesce({R.column_name(r)}, 0.0)" for r in rules if r.mode == m)
        zs.append(f"CASE WHEN NOT is_rag THEN {D.MASK}::DOUBLE ELSE {z} END AS z_{m}" if m in ("retrieval_failure", "context_dilution") else f"{z} AS z_{m}")
    ps = ", ".join(f"CASE WHEN z_{m} <= {D.MASK} THEN 0.0 ELSE round(1 / (1 + exp(-z_{m})), 4) END::DOUBLE AS p_{m}" for m in R.MODES)
    items = ", ".join(f"{{'k': -p_{m}, 'o': {i}, 'm': '{m}', 'p': p_{m}}}" for i, m in enumerate(R.MODES))
    p_of = lambda x: "CASE " + " ".join(f"WHEN {x} = '{m}' THEN p_{m}" for m in R.MODES) + " END"
    z_of = lambda x: "CASE " + " ".join(f"WHEN {x} = '{m}' THEN z_{m}" for m in R.MODES) + " END"
    step = "CASE " + " ".join(f"WHEN start = '{m}' THEN list_filter(ranked, lambda x: list_contains({lit(list(ps_))}, x.m) AND x.p > {D.ACTIVE} AND x.p >= {D.PARENT_RATIO} * p_{m})[1].m" for m, ps_ in D.PARENTS.items() if ps_) + " END"
    role = ", ".join(f"CASE WHEN p_{m} > {D.ACTIVE} THEN CASE WHEN root IS NULL THEN 'contributing' WHEN root = '{m}' THEN 'primary_root' " + (f"WHEN {' OR '.join(f'p_{q} > {D.ACTIVE}' for q in D.PARENTS[m])} THEN 'sequela' " if D.PARENTS[m] else "") + f"ELSE 'contributing' END END AS role_{m}" for m in R.MODES)
    heads = "CASE " + " ".join("WHEN coalesce(root, ranked[1].m) = '" + m + "' THEN coalesce(list_sort(list_filter([" + ", ".join(f"{{'k': -abs({R.column_name(r)}), 'i': {i}, 's': '{r.name}'}}" for i, r in enumerate(rules) if r.mode == m) + "], lambda x: x.k IS NOT NULL))[1].s, 'base_rate')" for m in R.MODES) + " END"
    fam = " + ".join(f"{present(f)}::INT" for f in S.FAMILIES)
    return (
        features(table)
        + f""",
r AS (SELECT *, {contrib} FROM f),
z AS (SELECT *, {", ".join(zs)} FROM r),
p AS (SELECT *, {ps} FROM z),
k AS (SELECT *, list_sort([{items}]) AS ranked FROM p),
s AS (SELECT *, CASE WHEN ranked[1].p > {D.ACTIVE} THEN ranked[1].m END AS start FROM k),
g AS (SELECT *, coalesce({step}, start) AS root0 FROM s),
h AS (SELECT *, CASE WHEN {p_of("root0")} >= {D.PRIMARY} THEN root0 END AS root,
        list_sum(list_transform(list_filter(ranked, lambda x: x.p > 0), lambda x: x.p)) AS mass,
        list_filter(ranked, lambda x: x.p > 0) AS live FROM g),
cs AS (SELECT *, list_transform(live, lambda x, i: coalesce(list_sum(list_transform(list_slice(live, 1, i - 1), lambda y: y.p / mass)), 0.0)) AS before FROM h),
c AS (SELECT *, list_filter(list_transform(live, lambda x, i: CASE WHEN i <= {D.MAX_SET} AND before[i] < {D.TAU} - 1e-12 THEN x.m END), lambda m: m IS NOT NULL) AS conformal_set FROM cs),
e AS (SELECT *, greatest(0.0, least(1.0, ranked[1].p * (0.55 + 0.45 * (ranked[1].p - ranked[2].p)) * (0.6 + 0.4 * least(1.0, ({fam})::DOUBLE / CASE WHEN is_rag THEN 4 ELSE 3 END)) * (0.7 + 0.3 * (1.0 / greatest(len(conformal_set), 1))))) AS conf FROM c),
d AS (SELECT *, {role}, round(conf, 4) AS confidence, (ranked[1].p < {D.ABSTAIN_PROBABILITY} OR conf < {D.ABSTAIN_CONFIDENCE}) AS abstained,
        coalesce(root, ranked[1].m) AS primary_mode,
        CASE WHEN ranked[1].p < {D.ABSTAIN_PROBABILITY} THEN 'healthy' WHEN conf < {D.ABSTAIN_CONFIDENCE} THEN 'declined' ELSE 'diagnosed' END AS bucket,
        {heads} AS headline, {p_of("coalesce(root, ranked[1].m)")} AS p_primary, {z_of("coalesce(root, ranked[1].m)")} AS z_primary FROM e)"""
    )
