"""Sizes of documents in tokens of a public tokenizer, and positions in a running total without a single-task window."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import emit, ship, spread

#: A tokenizers file; give another path as a parameter or in the setting spanwright.tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _count(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for pdf in batches:
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            sizes = []
            for at in range(0, len(texts), 256):
                sizes += [len(e.ids) for e in t.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]
            yield from emit(pdf.drop(columns="text").assign(tokens=sizes))

    return run


def token_sizes(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document; null and empty texts have 0 tokens."""
    spark = documents.sparkSession
    ship(spark)
    path = tokenizer or spark.conf.get("spark.spanwright.tokenizer", TOKENIZER)
    return spread(documents.select("doc_id", "source", "text")).mapInPandas(_count(path), "doc_id bigint, source string, tokens bigint")


def running_start(df: DataFrame, group: str, order: Column, size: str, buckets: int = 64, out: str = "start") -> DataFrame:
    """Adds the running total of size before each row, within group, in the order of a uniform hash (ties by row).

    Rows are cut into buckets of the hash's range; totals of buckets are small, and only rows of one bucket are sorted
    together, so a group may hold any share of the rows.
    """
    keyed = df.withColumn("_h", order).withColumn("_b", F.floor((F.col("_h").cast("double") / F.lit(2.0**63) + 1) * (buckets / 2)).cast("int"))
    totals = keyed.groupBy(group, "_b").agg(F.sum(size).alias("_t"))
    offsets = totals.select(F.col(group).alias("_g"), F.col("_b").alias("_k"), (F.sum("_t").over(Window.partitionBy(group).orderBy("_b")) - F.col("_t")).alias("_o"))
    inside = F.sum(size).over(Window.partitionBy(group, "_b").orderBy("_h", *[c for c in ("doc_id", "copy_no") if c in df.columns]).rowsBetween(Window.unboundedPreceding, -1))
    return keyed.join(F.broadcast(offsets), (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_k"))).withColumn(out, F.col("_o") + F.coalesce(inside, F.lit(0))).drop("_h", "_b", "_g", "_k", "_o")
