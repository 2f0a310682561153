"""Fitted maps from log-odds to probabilities, conformal thresholds, and a learned residual with an offset.

Fits run once per (mode, group) in Arrow groups. What reaches one group is bounded: the log-odds are first counted on a
grid of 1/50, so a group is at most some thousand rows however many traces there are.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship
from . import diagnosis as D
from . import signals as S
from .rules import MODES

# Fixed values of the fits.
LEAST, LEAST_ISOTONIC, ALPHA, TAU_MAX = 40, 60, 0.1, 1 - 1e-6
GRID = 50


def platt(z: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with smoothed targets."""
    pos, neg = float((w * y).sum()), float((w * (1 - y)).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([(w * (p - t) * z).sum(), (w * (p - t)).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-9, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def isotonic(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the rising step fit by pooling neighbours that fall."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for x, t, v in zip(z[order], y[order], w[order], strict=True):
        blocks.append([t * v, v, x, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, v2, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += v2
            blocks[-1][3] = hi
    xs, ps = [], []
    for s, v, lo, hi in blocks:
        for x in ([lo] if lo == hi else [lo, hi]):
            xs.append(float(x))
            ps.append(float(s / v))
    return xs, ps


def apply_map(kind: str, xs: list[float], ps: list[float], z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(xs[0] * z + ps[0], -50, 50))) if kind == "platt" else np.interp(z, xs, ps)


_MAP = "mode string, bucket string, kind string, xs array<double>, ps array<double>, n bigint, brier_raw double, brier double"


def _fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A map is adopted only where it beats the plain sigmoid on a third that was held out."""
    mode, bucket = key
    z, y, w, hold = (pdf[c].to_numpy(float) for c in ("z", "y", "w", "hold"))
    n = int(w.sum())
    none = pd.DataFrame(columns=[c.split()[0] for c in _MAP.split(", ")])
    if n < LEAST or (w * y).sum() == 0 or (w * (1 - y)).sum() == 0:
        return none
    kind = "isotonic" if n >= LEAST_ISOTONIC else "platt"

    def fit(m: np.ndarray) -> tuple[list[float], list[float]]:
        if kind == "isotonic":
            return isotonic(z[m], y[m], w[m])
        a, b = platt(z[m], y[m], w[m])
        return [a], [b]

    out, held = hold > 0, hold == 0
    if not out.any() or not held.any():
        return none
    xs, ps = fit(held)
    raw = 1 / (1 + np.exp(-np.clip(z[out], -50, 50)))
    brier = lambda p: float((w[out] * (p - y[out]) ** 2).sum() / w[out].sum())
    b0, b1 = brier(raw), brier(apply_map(kind, xs, ps, z[out]))
    if b1 >= b0:
        return none
    xs, ps = fit(np.ones(len(z), bool))
    return pd.DataFrame({"mode": [mode], "bucket": [bucket], "kind": [kind], "xs": [xs], "ps": [ps], "n": [n], "brier_raw": [round(b0, 6)], "brier": [round(b1, 6)]})


def fit_maps(labelled: DataFrame, key: str = "row_no") -> DataFrame:
    """Maps by mode and group of labelled reports (z_<mode>, labels): exact signature, with or without reference, all."""
    ship(labelled.sparkSession)
    labelled = materialise(labelled.select(key, "labels", "has_reference", S.signature().alias("signature"), *[f"z_{m}" for m in MODES]), "labelled")
    z = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"z_{m}").alias("z"), F.array_contains(F.coalesce("labels", F.array()), m).cast("int").alias("y")) for m in MODES])
    buckets = F.array("signature", F.when(F.col("has_reference"), "__ref__").otherwise("__noref__"), F.lit("__global__"))
    rows = labelled.select(F.col(key).alias("k"), F.explode(z).alias("r"), buckets.alias("bs")).where(F.col("r.z") > D.MASK)
    rows = rows.select("k", "r.mode", (F.round(F.col("r.z") * GRID) / GRID).alias("z"), "r.y", F.explode("bs").alias("bucket"))
    hold = (F.pmod(F.xxhash64("k", "mode"), F.lit(3)) == 0).cast("int")
    grid = rows.groupBy("mode", "bucket", "z", "y", hold.alias("hold")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return grid.groupBy("mode", "bucket").applyInPandas(_fit, _MAP)


def calibrate(reports: DataFrame, maps: DataFrame) -> DataFrame:
    """Adds p_cal_<mode> and its level: the map of the exact signature, else of the reference class, else of all."""
    # At most five modes by some tens of signatures: a table of fixed size, sent along as literals.
    fitted: dict[tuple[str, str], tuple] = {(r["mode"], r["bucket"]): (r["kind"], r["xs"], r["ps"]) for r in maps.collect()}
    sig, coarse = S.signature(), F.when(F.col("has_reference"), F.lit("__ref__")).otherwise(F.lit("__noref__"))

    def value(m: str, f: tuple) -> Column:
        kind, xs, ps = f
        z = F.col(f"z_{m}")
        if kind == "platt":
            return D.sigmoid(xs[0] * z + ps[0])
        knots, levels = F.array(*[F.lit(float(x)) for x in xs]), F.array(*[F.lit(float(p)) for p in ps])
        i = F.size(F.filter(knots, lambda x: x <= z))
        lo, hi = F.get(knots, i - 1), F.get(knots, i)
        a, b = F.get(levels, i - 1), F.get(levels, i)
        return F.when(i == 0, ps[0]).when(i == len(xs), ps[-1]).otherwise(a + (b - a) * (z - lo) / (hi - lo))

    cols = {}
    for m in MODES:
        p, level = D.sigmoid(F.col(f"z_{m}")), F.lit("sigmoid")
        if (m, "__global__") in fitted:
            p, level = value(m, fitted[m, "__global__"]), F.lit("global")
        for b in ("__ref__", "__noref__"):
            if (m, b) in fitted:
                p, level = F.when(coarse == b, value(m, fitted[m, b])).otherwise(p), F.when(coarse == b, "coarse").otherwise(level)
        for (mm, b), f in fitted.items():
            if mm == m and not b.startswith("__"):
                p, level = F.when(sig == b, value(m, f)).otherwise(p), F.when(sig == b, "exact").otherwise(level)
        cols[f"p_cal_{m}"], cols[f"level_{m}"] = p, level
    return reports.withColumns(cols)


def conformal_scores(reports: DataFrame) -> DataFrame:
    """(row_no, score): normalised mass from the top down to the first true mode, of reports with labels."""
    live = F.filter("ranked", lambda x: x["p"] > 0)
    total = F.aggregate(live, F.lit(0.0), lambda a, x: a + x["p"])
    hits = F.transform(live, lambda x: F.array_contains(F.col("labels"), x["mode"]))
    at = F.array_position(hits, True).cast("int")
    mass = F.aggregate(F.slice(live, F.lit(1), F.greatest(at, F.lit(1))), F.lit(0.0), lambda a, x: a + x["p"]) / total
    return reports.where("size(labels) > 0").select("row_no", F.when(at > 0, F.round(mass, 6)).otherwise(1.0).alias("score"))


def conformal_tau(scores: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row (n, tau): the exact order statistic that covers 1 - alpha. Scores are counted on a grid of 1e-6 first."""
    grid = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("score")
    run = grid.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    k = F.least(F.ceil((F.col("all") + 1) * (1 - alpha)), F.col("all"))
    return run.where(F.col("upto") >= k).agg(F.max("all").alias("n"), F.least(F.min("score"), F.lit(TAU_MAX)).alias("tau"))


# --- learned residual -------------------------------------------------------------------------------------------


def design() -> list[tuple[str, Column]]:
    """Inputs of the residual: each signal, 0 where missing and scaled, and whether it is missing."""
    scale = {"n_chunks": 10.0, "context_length_tokens": 400.0, "prompt_n_content_words": 20.0, "answer_length_tokens": 40.0, "answer_perplexity": 5.0}
    return [(s, F.coalesce(F.col(s) / scale.get(s, 1.0), F.lit(0.0))) for s in S.SIGNALS] + [(f"{s}:missing", F.col(s).isNull().cast("double")) for s in S.SIGNALS]


def fit_residual(labelled: DataFrame, rounds: int = 12, ridge: float = 0.02) -> dict[str, tuple[float, list[float]]]:
    """Per mode (base, weights) of a logistic head beside the rules' log-odds. Newton steps on sums over all rows.

    Each step is one aggregation of moments: nothing but sums of a few thousand numbers reaches the driver.
    """
    names = [n for n, _ in design()]
    k = len(names) + 1
    x = F.array(F.lit(1.0), *[c for _, c in design()])
    src = labelled.select(x.alias("x"), *[F.col(f"z_{m}") for m in MODES], *[F.array_contains(F.coalesce("labels", F.array()), m).cast("double").alias(f"y_{m}") for m in MODES]).cache()
    beta = {m: np.zeros(k) for m in MODES}
    iu = np.triu_indices(k)

    def moments(batches):
        for pdf in batches:
            xs = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, k))
            out = []
            for m in MODES:
                z = pdf[f"z_{m}"].to_numpy(float)
                live = z > D.MASK
                xm, zm, ym = xs[live], z[live], pdf[f"y_{m}"].to_numpy(float)[live]
                p = 1 / (1 + np.exp(-np.clip(zm + xm @ beta[m], -40, 40)))
                h = (xm * (p * (1 - p))[:, None]).T @ xm
                out.append((m, float(live.sum()), (xm.T @ (p - ym)).tolist(), h[iu].tolist()))
            yield pd.DataFrame(out, columns=["mode", "n", "g", "h"])

    def total(a: list[list[float]]) -> np.ndarray:
        return np.sum(np.array(a), 0)

    for _ in range(rounds):
        parts = src.mapInPandas(moments, "mode string, n double, g array<double>, h array<double>")
        # Element sums by position: partial sums are combined before the shuffle.
        pos = parts.select("mode", "n", F.posexplode(F.concat("g", "h")).alias("i", "v")).groupBy("mode", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        got: dict[str, np.ndarray] = {m: np.zeros(k + len(iu[0])) for m in MODES}
        count = dict.fromkeys(MODES, 0.0)
        for r in pos.collect():
            got[r["mode"]][r["i"]] = r["v"]
            count[r["mode"]] = r["n"]
        moved = 0.0
        for m in MODES:
            n = max(count[m], 1.0)
            g, h = got[m][:k], np.zeros((k, k))
            h[iu] = got[m][k:]
            h = h + np.triu(h, 1).T
            pen = np.full(k, ridge * n)
            pen[0] = 1e-6 * n
            step = np.linalg.solve(h + np.diag(pen) + 1e-9 * np.eye(k), g + pen * beta[m])
            step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            beta[m] = beta[m] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-4:
            break
    src.unpersist()
    return {m: (float(b[0]), [float(v) for v in b[1:]]) for m, b in beta.items()}


def add_residual(fired: DataFrame, heads: dict[str, tuple[float, list[float]]]) -> DataFrame:
    """Adds the learned part to each z_<mode>; contributions are weight times input, so the ledger still adds up."""
    cols = {}
    for m, (base, w) in heads.items():
        total = F.lit(base)
        for (_, c), v in zip(design(), w, strict=True):
            if abs(v) > 1e-9:
                total = total + F.lit(v) * c
        cols[f"z_{m}"] = F.col(f"z_{m}") + total
    return fired.withColumns(cols)


def contributions(mode: str, heads: dict[str, tuple[float, list[float]]]) -> tuple[Column, list[tuple[str, Column]]]:
    """(base, lines) of the learned evidence of a mode, for its ledger."""
    base, w = heads[mode]
    return F.lit(base), [(n, F.lit(v) * c) for (n, c), v in zip(design(), w, strict=True) if abs(v) > 1e-9]
