"""Temperature of a logistic confidence, by a grid and ternary steps on binned margins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1000


def fit_temperature(rows: DataFrame, margin: str = "margin", ok: str = "ok", steps: int = 60) -> DataFrame:
    """(temperature, nll). Margins are summed in BINS bins of equal width, so the driver sees at most 2 * BINS rows."""
    spark = rows.sparkSession
    lo, hi = rows.agg(F.min(margin), F.max(margin)).first()
    if lo is None:
        return spark.createDataFrame([], "temperature double, nll double")
    width = (hi - lo) / BINS or 1.0
    got = rows.groupBy(F.least(F.lit(BINS - 1), F.floor((F.col(margin) - lo) / width)).alias("b"), F.col(ok).cast("int").alias("ok")).agg(F.count(F.lit(1)).alias("n"), F.sum(margin).alias("s")).collect()
    m, y, n = np.array([r["s"] / r["n"] for r in got]), np.array([r["ok"] for r in got]), np.array([r["n"] for r in got], float)

    def nll(t: float) -> float:
        p = 1 / (1 + np.exp(-np.clip(m / t, -700, 700)))
        return float(-(n * np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-12))).sum() / n.sum())

    grid = np.geomspace(0.01, 100, 41)
    k = int(np.argmin([nll(t) for t in grid]))
    a, b = grid[max(0, k - 1)], grid[min(40, k + 1)]
    for _ in range(steps):
        x, z = a + (b - a) / 3, b - (b - a) / 3
        a, b = (a, z) if nll(x) < nll(z) else (x, b)
    t = (a + b) / 2
    return spark.createDataFrame([(float(t), nll(t))], "temperature double, nll double")
