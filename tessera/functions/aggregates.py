"""Aggregates over points (rows where the field is not NULL).

Each builder returns an aggregate Column for ``groupBy(bucket).agg``.  NaN is
ignored by min, max, spread, mode, quantiles, histogram and distinct_count, but
not by sum and avg.  Functions that need the order of points within a series
(trajectories, pid, pid_estimate), and histogram and tdigest_agg, have a plan of
their own in ``plans.aggregate``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def d(f: Column) -> Column:
    return f.cast("double")


def _solid(f: Column) -> Column:
    f = d(f)
    return F.when(~F.isnan(f), f)


def quantile(f: Column, q: float) -> Column:
    return F.percentile(_solid(f), F.lit(float(q)))


def percentile(f: Column, p: float) -> Column:
    if not 0 < p <= 100:
        raise ValueError("percentile takes a value in (0, 100]")
    return quantile(f, p / 100.0)


#: The seven core aggregates: an empty slot that another aggregate opened holds 0.
CORE: dict[str, Callable[[Column, Column], Column]] = {
    "count": lambda f, t: F.count(f),
    "sum": lambda f, t: F.coalesce(F.sum(d(f)), F.lit(0.0)),
    "min": lambda f, t: F.coalesce(F.min(_solid(f)), F.lit(0.0)),
    "max": lambda f, t: F.coalesce(F.max(_solid(f)), F.lit(0.0)),
    "avg": lambda f, t: F.coalesce(F.avg(d(f)), F.lit(0.0)),
    "first": lambda f, t: F.coalesce(F.min_by(d(f), F.when(f.isNotNull(), t)), F.lit(0.0)),
    "last": lambda f, t: F.coalesce(F.max_by(d(f), F.when(f.isNotNull(), t)), F.lit(0.0)),
}
EXTENDED: dict[str, Callable[..., Column]] = {
    "stddev": lambda f: F.stddev_samp(_solid(f)),
    "variance": lambda f: F.var_samp(_solid(f)),
    "spread": lambda f: F.max(_solid(f)) - F.min(_solid(f)),
    "mode": lambda f: F.mode(_solid(f), True),
    "median": lambda f: quantile(f, 0.5),
    "p50": lambda f: quantile(f, 0.5),
    "p90": lambda f: quantile(f, 0.9),
    "p95": lambda f: quantile(f, 0.95),
    "p99": lambda f: quantile(f, 0.99),
    "percentile": percentile,
    "distinct_count": lambda f: F.approx_count_distinct(_solid(f), 0.0081),
    "trajectory_centroid": lambda g: F.when(F.count(g) > 0, F.struct(F.avg(g["lat"]).alias("lat"), F.avg(g["lon"]).alias("lon"))),
    "trajectory_bbox": lambda g: F.when(F.count(g) > 0, F.to_json(F.struct(F.min(g["lat"]).alias("min_lat"), F.min(g["lon"]).alias("min_lon"), F.max(g["lat"]).alias("max_lat"), F.max(g["lon"]).alias("max_lon")))),
}
#: Aggregates with a plan of their own.
SPECIAL = ("histogram", "centroid", "tdigest_agg", "trajectory_length", "trajectory_speed_max", "trajectory_speed_avg", "trajectory_speed_p95", "pid", "pid_estimate")
NAMES = (*CORE, *EXTENDED, *SPECIAL)


def dimension_mean(v: Column, dim: int) -> Column:
    """Mean vector as float32; one partial sum for each dimension, so nothing is collected."""
    means = [F.avg(F.get(v, F.lit(i)).cast("double")).cast("float") for i in range(dim)]
    return F.when(F.count(v) > 0, F.array(*means))


class TDigest:
    """Merging t-digest: centroids of at most ``4 n q (1 - q) / compression`` points."""

    def __init__(self, compression: float = 100.0) -> None:
        self.compression, self.means, self.weights = compression, np.zeros(0), np.zeros(0)

    def add(self, means: np.ndarray, weights: np.ndarray | None = None) -> None:
        weights = np.ones(len(means)) if weights is None else weights
        m, w = np.concatenate((self.means, means)), np.concatenate((self.weights, weights))
        order = np.argsort(m, kind="stable")
        m, w = m[order], w[order]
        total = w.sum()
        if total < 2 * self.compression:
            self.means, self.weights = m, w
            return
        out_m, out_w, done = [m[0]], [w[0]], 0.0
        for x, k in zip(m[1:].tolist(), w[1:].tolist(), strict=True):
            q = (done + (out_w[-1] + k) / 2) / total
            if out_w[-1] + k <= 4 * total * q * (1 - q) / self.compression:
                out_w[-1] += k
                out_m[-1] += (x - out_m[-1]) * k / out_w[-1]
            else:
                done += out_w[-1]
                out_m.append(x)
                out_w.append(k)
        self.means, self.weights = np.array(out_m), np.array(out_w)

    def quantile(self, q: float) -> float | None:
        if not len(self.means):
            return None
        centre = np.cumsum(self.weights) - self.weights / 2
        return float(np.interp(q * self.weights.sum(), centre, self.means))

    def to_json(self) -> str:
        return json.dumps({"compression": int(self.compression), "count": int(self.weights.sum()), "centroids": [[a, int(b)] for a, b in zip(self.means.tolist(), self.weights.tolist(), strict=True)]}, separators=(",", ":"))
