"""Tables that keep results: a content-addressed cache of signals, fitted parameters, and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import signals as S


def finite(c: Column) -> Column:
    """The number, or null where it is none or endless, so that JSON stays strict."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def cache_key(model: str = "log", tier: str = "black") -> Column:
    """Sixteen digits of the SHA-1 of everything a trace's signals depend on."""
    ctx = F.transform(F.coalesce("retrieved_context", F.array()), lambda c: F.concat_ws("\x1f", F.coalesce(c["text"], F.lit("")), F.coalesce(F.round(finite(c["retriever_score"]), 6).cast("string"), F.lit("0.0")), F.coalesce(c["gold"].cast("string"), F.lit("null"))))
    parts = [F.lit(model), F.lit(tier), F.coalesce("prompt", F.lit("")), F.coalesce("question", F.lit("")), F.coalesce("generated_answer", F.lit("")), F.when(F.col("retrieved_context").isNull(), "-").otherwise(F.array_join(ctx, "\x1e")), F.array_join(F.coalesce("ground_truth", F.array()), "\x1e", "null")]
    return F.substring(F.sha1(F.concat_ws("\x1d", *parts)), 1, 16)


def cached_signals(spark: SparkSession, traces: DataFrame, path: str) -> DataFrame:
    """Signals of traces, computed once for each content: known keys are read, new ones computed and appended."""
    keyed = traces.withColumn("cache_key", cache_key())
    columns = ["cache_key", "has_reference", *S.SIGNALS]
    schema = "cache_key string, has_reference boolean, " + ", ".join(f"{s} double" for s in S.SIGNALS)
    # Only a table that isn't there yet counts as empty; any other failure to read it is one.
    fresh = keyed.join(spark.read.schema(schema).parquet(path).select("cache_key"), "cache_key", "left_anti") if _exists(spark, path) else keyed
    S.log_signals(fresh.dropDuplicates(["cache_key"])).select(*columns).write.mode("append").parquet(path)
    return keyed.select("row_no", "cache_key").join(spark.read.schema(schema).parquet(path).dropDuplicates(["cache_key"]), "cache_key")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clear(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def save_heads(spark: SparkSession, heads: dict[str, tuple[float, list[float]]], path: str) -> None:
    """Fitted residual heads as a table."""
    spark.createDataFrame([(m, b, w) for m, (b, w) in heads.items()], "mode string, base double, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_heads(spark: SparkSession, path: str) -> dict[str, tuple[float, list[float]]]:
    return {r["mode"]: (r["base"], list(r["weights"])) for r in spark.read.parquet(path).collect()}


def to_lines(df: DataFrame) -> DataFrame:
    """Each row as strict JSON text; members that are null are kept, numbers that are none become null."""
    cols = [finite(F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    to_lines(df).write.mode("overwrite").text(path)


def read_native(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows written by write_lines; members that are missing or of another type are null, and the raw line is kept."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("r"), F.col("value").alias("raw")).select("r.*", "raw")
