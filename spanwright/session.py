"""Session helpers: tables, the shared work folder and shipping of this package to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pandas as pd
from pyspark import SparkConf
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: int = 4, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def current_session() -> SparkSession:
    """The session that spark-submit or a shell has set up, else a local one."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    return SparkSession.builder.getOrCreate() if SparkConf().get("spark.master", None) else local_session()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared one the cluster names; a temporary one only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def barrier(df: DataFrame) -> DataFrame:
    """The same rows; expressions and filters above it are not folded into those below, which keeps wide plans small."""
    inner = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.explode(F.array(inner)).alias("_b")).select("_b.*")


def ranked(df: DataFrame, *order: Column, label: str = "ranked") -> DataFrame:
    """Adds rank, from 0 in the given order over all rows, and _n, their number.

    The order is made by ranges, so a value that a third of the rows have is still cut by what orders its rows further;
    rows are then counted by part of the sort, and only these counts, one for each part, meet in a task.
    """
    made = materialise(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), label).withColumn("_part", F.shiftright("_id", 33))
    counts = made.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    every = Window.partitionBy(F.lit(0))
    base = counts.select("_part", (F.sum("_c").over(every.orderBy("_part")) - F.col("_c")).alias("_before"), F.sum("_c").over(every).alias("_n"))
    # One row for each part of the sort, as many as there are shuffle partitions.
    placed = made.join(F.broadcast(base), "_part")
    return placed.withColumn("rank", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def emit(pdf: pd.DataFrame) -> list[pd.DataFrame]:
    """What a task yields of a result: nothing for an empty one, whose columns have no type that Arrow could take."""
    return [pdf] if len(pdf) else []


def spread(df: DataFrame) -> DataFrame:
    """Dealt to all cores before a costly Python stage where the scan has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once a session, so that a cluster needs no installation."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if sc.master.startswith("local["):
        # Workers of a local session start in its folder; they find the package where the driver did.
        home = str(_PACKAGE.parent)
        known = os.environ.get("PYTHONPATH", "")
        if home not in known.split(os.pathsep):
            os.environ["PYTHONPATH"] = home + (os.pathsep + known if known else "")
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spanwright-ship-"), "spanwright_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, str(p.relative_to(_PACKAGE.parent)))
    sc.addPyFile(target)
