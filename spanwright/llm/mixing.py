"""Sources mixed to target weights along a low-discrepancy schedule.

Slots are numbered; the golden-ratio sequence maps each to a point, and the cumulative target weights map the point to
a source, so that every stretch of the schedule is close to the targets. A source's documents, shuffled anew for each
permitted repetition, are laid end to end and cut into blocks of equal tokens; the k-th slot of a source takes its k-th
block. A document that lies across a border is continued in the source's next block, so every slot has exactly as many
tokens as a block and every stretch of slots keeps to the targets in tokens too. The length of the schedule is the longest for which every source can supply its share within its repetitions.

Sources without a target, or with a share of 0 or null, are left out; shares are scaled to 1; a target without
documents shortens nothing and is reported with share 0; a repeats limit that is null or below 1 counts as 1; empty
documents are never drawn; ties in the shuffle go by id; empty tables give an empty schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .sizes import running_start

#: Tokens of a block, and the fractional part of the golden ratio.
BLOCK, PHI = 512, 0.6180339887498949
_CHUNK = 1 << 14
#: Rows of a source sorted together, about.
BUCKET_ROWS = 20_000


def targets_of(sizes: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per source: share scaled to 1, lower and upper bound of its points, tokens, repetitions, blocks, and slots in all."""
    have = sizes.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    want = targets.where("target_share > 0 AND source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(1)).alias("max_repeats"))
    t = want.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    live = t.where("tokens > 0")
    every = Window.partitionBy(F.lit(0))
    # A handful of rows: one for each source.
    w = live.withColumn("w", F.col("share") / F.sum("share").over(every))
    w = w.withColumn("hi", F.sum("w").over(every.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("w"))
    w = w.withColumn("blocks", F.floor(F.col("tokens") * F.col("max_repeats") / block)).withColumn("top", F.row_number().over(every.orderBy(F.desc("source"))) == 1).withColumn("hi", F.when(F.col("top"), F.lit(1.0)).otherwise(F.col("hi")))
    return w.withColumn("slots", F.greatest(F.floor(F.min(F.greatest(F.col("blocks") - 1, F.lit(0)) / F.col("w")).over(every)), F.lit(0)).cast("bigint")).drop("top")


def schedule(plan: DataFrame) -> DataFrame:
    """(slot, source, block): the source of each slot and the slot's rank among those of its source."""
    spark = plan.sparkSession
    # The plan has one row for each source of the target table, a table of settings; its bounds travel as two arrays.
    bounds = plan.select("source", "hi", "slots").orderBy("hi").collect()
    n = max((int(r["slots"] or 0) for r in bounds), default=0)
    sources, ends = F.array(*[F.lit(r["source"]) for r in bounds]).cast("array<string>"), F.array(*[F.lit(float(r["hi"])) for r in bounds]).cast("array<double>")
    slots = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * F.lit(PHI) % 1).alias("u"), F.floor(F.col("id") / _CHUNK).alias("chunk"))
    named = slots.withColumn("source", F.get(sources, F.size(F.filter(ends, lambda h: F.col("u") >= h))))
    per = named.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = per.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    return named.withColumn("r", rank).join(base, ["source", "chunk"]).select("slot", "source", (F.col("before") + F.col("r")).alias("block"))


def mix(sizes: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, block, copy_no, doc_id, from_token, tokens): what each slot holds of each document, in order of the schedule."""
    sizes = materialise(sizes.where("tokens > 0 AND source IS NOT NULL").select("doc_id", "source", "tokens"), "mix-sizes")
    plan = materialise(targets_of(sizes, targets, block), "mix-plan")
    docs = sizes.join(F.broadcast(plan.select("source", "max_repeats", F.col("tokens").alias("total"))), "source")
    copies = docs.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("max_repeats").cast("int") - 1)))
    buckets = max(64, sizes.count() // BUCKET_ROWS)
    laid = running_start(copies.withColumn("stream", F.concat_ws("#", "source", "copy_no")), "stream", F.xxhash64("doc_id", "copy_no"), "tokens", buckets)
    begin = F.col("start") + F.col("copy_no") * F.col("total")
    spans = laid.withColumn("begin", begin).withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("tokens") - 1) / block))))
    lo, hi = F.greatest(F.col("begin"), F.col("block") * block), F.least(F.col("begin") + F.col("tokens"), (F.col("block") + 1) * block)
    parts = spans.select("source", "block", "copy_no", "doc_id", (lo - F.col("begin")).alias("from_token"), (hi - lo).alias("tokens"))
    return schedule(plan).join(parts, ["source", "block"]).select("slot", "source", "block", "copy_no", "doc_id", "from_token", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: target share, share reached, tokens drawn, documents, and the most often one was used."""
    per = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.countDistinct("copy_no").alias("uses"))
    per = per.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("uses").alias("most_uses"))
    joined = targets.select("source", "target_share", "max_repeats").join(per, "source", "left")
    # One row for each source of the target table.
    every = Window.partitionBy(F.lit(0))
    wanted = F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(F.lit(0.0))
    return joined.select("source", F.round(F.coalesce(F.try_divide(wanted, F.sum(wanted).over(every)), F.lit(0.0)), 6).alias("target_share"), F.round(F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(every)), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
