"""Triage of a growing log: the batch plan on a file stream, with running cluster totals.

The running aggregate is keyed by (mode, headline), some hundred groups at most, whatever the log's length. There is no
event time in a trace log of this kind, so nothing expires; a row that can't be read is counted and not fatal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import diagnosis as D
from ..operators import signals as S
from ..session import work_dir


def running_clusters(traces: DataFrame) -> DataFrame:
    """Streaming totals of each cluster of a stream of traces."""
    r = D.diagnose(S.log_signals(traces))
    return r.groupBy("bucket", "primary_mode", "headline").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"), F.count_if("has_reference").alias("with_reference"))


def run(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Runs over all files there are and returns the totals after the last of them."""
    root = work_dir(spark, "stream-triage")
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")

    def keep(batch: DataFrame, number: int) -> None:
        # Written under the batch's number: a batch that is repeated after a failure replaces its own file.
        batch.coalesce(1).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = running_clusters(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    number = max(p["batchId"] for p in query.recentProgress) if query.recentProgress else last["batchId"]
    out = spark.read.parquet(f"{root}/out/batch={number}")
    return out.select("bucket", "primary_mode", "headline", "n", F.round(F.col("confidence") / F.col("n"), 6).alias("mean_confidence"), "with_reference")
