"""What is known of models and how much of them can be seen, and scorers that use an embedding instead of words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .signals import SIGNALS, TIERS

_PROFILE = "name string, n_layers int, n_heads int, d_model int, max_tier string"
# Layers, heads, width and highest tier of each profile.
PROFILES: dict[str, tuple[int, int, int, str]] = {
    "mock-4b": (32, 32, 2560, "white"),
    "qwen3-4b": (36, 32, 2560, "white"),
    "gemma3-4b": (34, 16, 2560, "grey"),
    "phi4-mini": (32, 24, 3072, "white"),
    "qwen3-0.6b": (28, 16, 1024, "white"),
    "qwen3-1.7b": (28, 16, 2048, "white"),
}


def register(name: str, layers: int, heads: int, width: int, tier: str) -> None:
    if tier not in TIERS:
        raise ValueError(f"no tier {tier!r}; there are {', '.join(TIERS)}")
    PROFILES[name] = (layers, heads, width, tier)


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *p) for n, p in PROFILES.items()], _PROFILE)


def usable_tier(name: str, wanted: str) -> str:
    """The wanted tier, or the highest the model allows if that is lower."""
    return TIERS[min(TIERS.index(wanted), TIERS.index(PROFILES[name][3]))]


def at_tier(features: DataFrame, tier: str) -> DataFrame:
    """The same rows with the signals above a tier missing."""
    top = TIERS.index(tier)
    return features.withColumns({s: F.lit(None).cast("double") for s, (_, t) in SIGNALS.items() if TIERS.index(t) > top})


def embedded_relevance(embed: Callable[[list[str]], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A relevance of two texts by the cosine of their embeddings, none below 0; embed maps texts to rows of a matrix.

    The function is called on Arrow batches and should load its model once for each worker.
    """

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.asarray(embed([t or "" for t in s]), float) for s in (a, b))
        n = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        return pd.Series(np.round(np.maximum((x * y).sum(1) / np.where(n > 0, n, 1), 0), 4))

    return score


def chunk_spans(prompt: Column, chunks: Column) -> Column:
    """Where each chunk stands in a prompt: array of (start, end) by code point, null for a chunk that isn't there.

    A cursor walks on, so that the second of two equal chunks is the second occurrence; one that stands before the
    cursor is looked for from the start.
    """
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"

    def step(acc: Column, c: Column) -> Column:
        after = F.call_function("locate", c, prompt, acc["at"] + 1)
        any_ = F.call_function("locate", c, prompt, F.lit(1))
        pos = F.when(F.length(c) == 0, 0).when(after > 0, after).otherwise(any_)
        end = pos - 1 + F.length(c)
        span = F.when(pos > 0, F.struct((pos - 1).alias("start"), end.alias("end")))
        return F.struct(F.when(pos > 0, F.greatest(acc["at"], end)).otherwise(acc["at"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")).cast(kind)

    start = F.expr(f"CAST(named_struct('at', 0, 'spans', array()) AS {kind})")
    return F.aggregate(F.transform(chunks, lambda c: F.coalesce(c["text"], F.lit(""))), start, step, lambda a: a["spans"])
