"""Exact dense retrieval: normalised vectors, inner products in blocks, the best k of each query.

Queries are written to the shared folder in blocks of bounded size; each task multiplies its batches with every block
and keeps the best k of each query for the batch, so no pairs are formed in Spark and nothing is broadcast.
Null or zero vectors are left out; ties go by id; fewer than k rows give fewer results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, work_dir

BLOCK = 2048


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _search(folder: str, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        names = [i.path for i in files.get_file_info(fs.FileSelector(root)) if i.path.endswith(".parquet")]
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf["id"].to_numpy()
            rows = _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
            for name in names:
                with files.open_input_file(name) as f:
                    for part in pq.ParquetFile(f).iter_batches(BLOCK):
                        q = _unit(np.stack(part.column("v").to_numpy(zero_copy_only=False)).astype(np.float64))
                        qid = part.column("id").to_numpy()
                        sim = q @ rows.T
                        take = min(k, sim.shape[1])
                        # By similarity, then by id, so that ties don't depend on the batch.
                        best = np.stack([np.lexsort((ids, -np.round(s, 9)))[:take] for s in sim])
                        yield pd.DataFrame({"query_id": np.repeat(qid, take), "doc_id": ids[best.ravel()], "score": np.take_along_axis(sim, best, 1).ravel()})

    return run


def top_k(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k nearest rows of each query by cosine."""
    ship(rows.sparkSession)
    keep = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0")
    folder = work_dir(rows.sparkSession, "queries")
    keep(queries).write.parquet(folder)
    uri = folder if folder.startswith("file:///") or not folder.startswith("file:/") else folder.replace("file:/", "file:///", 1)
    local = keep(rows).mapInPandas(_search(uri if "://" in uri else f"file://{uri}", k), "query_id bigint, doc_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def assemble(hits: DataFrame, docs: DataFrame, gold_ids: Column | None = None) -> DataFrame:
    """(query_id, retrieved_context): the texts found for each query in order, gold where the source is among gold_ids."""
    gold = F.array_contains(gold_ids, F.concat(F.lit("doc-"), F.col("doc_id"))) if gold_ids is not None else F.lit(None).cast("boolean")
    c = F.struct("rank", F.struct(F.col("text"), F.col("score").alias("retriever_score"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("source_id"), gold.alias("gold"), F.expr("CAST(NULL AS struct<start:int,end:int>)").alias("char_span")).alias("c"))
    return hits.join(docs.select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["c"]).alias("retrieved_context"))
