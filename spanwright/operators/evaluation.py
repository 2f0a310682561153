"""How good diagnoses are against labels: one pass of conditional aggregates, and experiments that repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ranked
from . import diagnosis as D
from . import rules as R
from . import signals as S

PRESENT = 0.5
SPLIT = (0.6, 0.2)


def gold_primary() -> Column:
    """The labelled modes that stand first in the causal graph: roots if any, else the others."""
    roots = F.array(*[F.lit(m) for m in R.MODES if not D.PARENTS[m]])
    labels = F.coalesce("labels", F.array())
    first = F.array_intersect(labels, roots)
    return F.when(F.size(first) > 0, first).otherwise(labels)


def metrics(reports: DataFrame) -> DataFrame:
    """One row: accuracy, top-3, coverage, set size, abstention of healthy and of failing traces."""
    r = reports.withColumn("gold", gold_primary())
    faulty = F.size("gold") > 0
    predicted = F.when(~F.col("abstained"), F.col("primary_mode"))
    hit = faulty & F.coalesce(F.array_contains("gold", predicted), F.lit(False))
    right = hit | (~faulty & predicted.isNull())
    top3 = F.arrays_overlap("gold", F.transform(F.slice("ranked", 1, 3), lambda x: x["mode"]))
    covered = F.arrays_overlap("gold", "conformal_set")
    avg = lambda c: F.round(F.avg(c.cast("double")), 6)
    return r.agg(
        F.count(F.lit(1)).alias("n"),
        avg(right).alias("accuracy"),
        avg(F.when(faulty, top3)).alias("top3"),
        avg(F.when(faulty, covered)).alias("coverage"),
        avg(F.when(faulty, F.size("conformal_set"))).alias("mean_set"),
        avg(F.when(~faulty, F.col("abstained"))).alias("healthy_abstention"),
        avg(F.when(faulty, F.col("bucket") == "declined")).alias("declined"),
    )


def mode_scores(reports: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each mode."""
    rows = reports.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), (F.col(f"p_{m}") >= PRESENT).alias("said"), F.array_contains(F.coalesce("labels", F.array()), m).alias("true")) for m in R.MODES])).alias("r")).select("r.*")
    a = rows.groupBy("mode").agg(F.count_if(F.col("said") & F.col("true")).alias("tp"), F.count_if(F.col("said") & ~F.col("true")).alias("fp"), F.count_if(~F.col("said") & F.col("true")).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return a.select("mode", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(r, F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(f1, F.lit(0.0)), 6).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def confusion(reports: DataFrame) -> DataFrame:
    """(gold, predicted, n): labelled first mode, or none, against what was named, or none."""
    gold = F.coalesce(F.get(F.array_sort(gold_primary()), F.lit(0)), F.lit("none"))
    pred = F.when(F.col("abstained"), "none").otherwise(F.col("primary_mode"))
    return reports.groupBy(gold.alias("gold"), pred.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Per equal-mass bin of (key, score, outcome): n, mean score, mean outcome; bins are cut at rounded ranks."""
    return _bins(ranked(scored, F.col("score"), F.col("key"), label="calibration"), bins)


def _bins(placed: DataFrame, bins: int) -> DataFrame:
    edge = lambda b: F.floor(F.lit(float(b)) * F.col("_n") / bins + 0.5)
    bucket = sum((F.when(F.col("rank") >= edge(b), 1).otherwise(0) for b in range(1, bins)), F.lit(0))
    return placed.withColumn("bin", bucket).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("outcome").cast("double")), 6).alias("mean_outcome"))


def grid_calibration_error(reports: DataFrame, cells: int = 20) -> DataFrame:
    """Calibration over all modes on a fixed grid of probabilities, which needs no global order."""
    rows = reports.select(F.explode(F.array(*[F.struct(F.col(f"p_{m}").alias("p"), F.array_contains(F.coalesce("labels", F.array()), m).cast("double").alias("y"), (F.col(f"z_{m}") > D.MASK).alias("live")) for m in R.MODES])).alias("r")).select("r.*").where("live")
    return rows.groupBy(F.least(F.floor(F.col("p") * cells), F.lit(cells - 1)).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("mean_y"))


def hash_split(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Adds part (train, cal or test) by the rank of the text's SHA-1: 60, 20 and the rest, repeatable on the same rows.

    The order is made by ranges of hash and key, so neither all rows nor the copies of one text are sorted in one task.
    """
    out = ranked(rows.withColumn("_h", F.sha1(F.coalesce(F.col(text), F.lit("")))), F.col("_h"), F.col(key), label="split").withColumnRenamed("rank", "position")
    a, b = F.floor(F.col("_n") * SPLIT[0]), F.floor(F.col("_n") * SPLIT[0]) + F.floor(F.col("_n") * SPLIT[1])
    return out.withColumn("part", F.when(F.col("position") < a, "train").when(F.col("position") < b, "cal").otherwise("test")).drop("_h", "_n")


def tier_schedule(position: Column) -> Column:
    """Tiers in turn by place: white, grey, black."""
    return F.element_at(F.array(F.lit("white"), F.lit("grey"), F.lit("black")), (F.pmod(position, F.lit(3)) + 1).cast("int"))


def strip_reference(rows: DataFrame) -> DataFrame:
    """What a production log would hold: no reference, and no chunk marked as gold."""
    ctx = F.transform("retrieved_context", lambda c: c.withField("gold", F.lit(False)))
    return rows.withColumn("ground_truth", F.lit(None).cast("array<string>")).withColumn("retrieved_context", ctx)


def without_family(features: DataFrame, family: str) -> DataFrame:
    """The same rows with one family's signals missing."""
    return features.withColumns({s: F.lit(None).cast("double") for s, (f, _) in S.SIGNALS.items() if f == family})


def without_rules(prefix: str) -> tuple[R.Rule, ...]:
    return tuple(r for r in R.RULES if not r.name.startswith(prefix))


def labelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels.select("row_no", "labels"), "row_no") if "labels" not in features.columns else features


def family_ablation(features: DataFrame) -> DataFrame:
    """Metrics with every signal and with each family left out: (family, accuracy, ...)."""
    runs = [metrics(D.diagnose(features)).withColumn("left_out", F.lit("none"))]
    runs += [metrics(D.diagnose(without_family(features, f))).withColumn("left_out", F.lit(f)) for f in S.FAMILIES]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def noise_sweep(features: DataFrame, sigmas: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75)) -> DataFrame:
    """Metrics under growing noise of observation."""
    out = None
    for s in sigmas:
        m = metrics(D.diagnose(S.observe_with_noise(features, s))).withColumn("sigma", F.lit(s))
        out = m if out is None else out.unionByName(m)
    return out


def no_reference_delta(base: DataFrame, stripped: DataFrame) -> DataFrame:
    """Metrics of both runs and what is lost without a reference; null where one isn't defined."""
    a, b = metrics(base), metrics(stripped)
    cols = [c for c in a.columns if c != "n"]
    pick = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in cols])).alias("m")).select("m.metric", f"m.{name}")
    return pick(a, "with_reference").join(pick(b, "without"), "metric").withColumn("delta", F.round(F.col("without") - F.col("with_reference"), 6))


def corpus_summary(labeled: DataFrame) -> DataFrame:
    """Rows by recipe and by label."""
    by = labeled.groupBy(F.lit("recipe").alias("kind"), F.coalesce("injection_recipe", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    lab = labeled.select(F.explode_outer("labels").alias("l")).groupBy(F.lit("label").alias("kind"), F.coalesce("l", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(lab)


def dedup_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row in order of each key; combines before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def override_slice(reports: DataFrame) -> DataFrame:
    """Overrides against dilutions, which look alike from outside: whether naming hallucination tells them apart."""
    r = reports.where("injection_recipe IN ('hallucination_override', 'context_dilution')")
    is_override = F.col("injection_recipe") == "hallucination_override"
    said = ~F.col("abstained") & (F.col("primary_mode") == "hallucination")
    n = r.agg(F.count_if(is_override & said).alias("tp"), F.count_if(~is_override & said).alias("fp"), F.count_if(is_override & ~said).alias("fn"), F.count_if(~is_override & ~said).alias("tn"))
    return n.withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6))


def frozen(simulated: DataFrame, stripped: DataFrame) -> DataFrame:
    """Stripped rows with the decisions made before: joined by what stripping leaves as it was."""
    key = lambda df: df.withColumn("_key", F.sha1(F.concat_ws("\x1d", F.col("prompt"), F.array_join(F.transform(F.coalesce("retrieved_context", F.array()), lambda c: F.coalesce(c["text"], F.lit(""))), "\x1e"), F.coalesce(F.to_json("sim"), F.lit("")))))
    before = key(simulated).groupBy("_key").agg(F.first("decision").alias("decision"))
    return key(stripped.drop("decision") if "decision" in stripped.columns else stripped).join(before, "_key", "left").drop("_key")


def shape_probe(features: DataFrame, depth: int = 4) -> DataFrame:
    """How well a small tree tells labels from the shape of a trace alone: (accuracy, majority) on a hashed fifth."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    shape = ["n_chunks", "context_length_tokens", "answer_length_tokens", "prompt_n_content_words"]
    label = F.coalesce(F.get(F.array_sort(gold_primary()), F.lit(0)), F.lit("none"))
    rows = features.select("row_no", label.alias("label"), *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in shape])
    rows = VectorAssembler(inputCols=shape, outputCol="x").transform(rows)
    rows = StringIndexer(inputCol="label", outputCol="y").fit(rows).transform(rows)
    test = F.pmod(F.xxhash64("row_no"), F.lit(5)) == 0
    model = DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=depth, seed=1).fit(rows.where(~test))
    scored = model.transform(rows.where(test))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("y")).cast("double")), 6).alias("accuracy"), F.round(F.avg((F.col("y") == 0).cast("double")), 6).alias("majority"))
