"""Aggregate queries: one pass of Catalyst partial aggregation, and extra plans only for functions that need them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import aggregates as ag
from tessera.functions import control
from tessera.functions.scalars import geo_distance

BUCKET = "__bucket"


@dataclass(eq=False)
class Item:
    """One aggregate of a query: function, field, further arguments, and output name."""

    name: str
    field: Column | None
    args: tuple = ()
    out: str = ""
    dim: int = 0


def bucket(time: str, width: int) -> Column:
    """Start of the epoch-aligned bucket of a time, also before the epoch."""
    return F.col(time) - F.pmod(F.col(time), F.lit(width))


def _histogram(points: DataFrame, item: Item) -> DataFrame:
    width = float(item.args[0])
    if width <= 0:
        raise ValueError("the bin width must be positive")
    v = item.field.cast("double")
    bins = points.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).groupBy(BUCKET, F.floor(v / width).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    edge = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    text = lambda x: F.concat(F.lit('"['), edge(x["b"] * width), F.lit(","), edge((x["b"] + 1) * width), F.lit(')":'), x["n"].cast("string"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("b", "n"))), text)
    return bins.groupBy(BUCKET).agg(F.concat(F.lit("{"), F.array_join(rows, ","), F.lit("}")).alias(item.out))


def _trajectory(points: DataFrame, item: Item, time: str, ties: Sequence[str]) -> DataFrame:
    g = points.withColumn("__g", item.field).where(F.col("__g").isNotNull())
    order = Window.partitionBy(BUCKET).orderBy(time, *ties)
    step = g.withColumn("__d", geo_distance(F.lag("__g").over(order), F.col("__g"))).withColumn("__t", F.col(time) - F.lag(time).over(order))
    speed = F.when(F.col("__t") > 0, F.col("__d") * 1000.0 / F.col("__t"))
    made = {"trajectory_length": F.coalesce(F.sum("__d"), F.lit(0.0)), "trajectory_speed_max": F.max(speed), "trajectory_speed_avg": F.avg(speed), "trajectory_speed_p95": F.percentile(speed, F.lit(0.95))}[item.name]
    return step.groupBy(BUCKET).agg(made.alias(item.out))


def _digest(points: DataFrame, item: Item) -> DataFrame:
    """Partial digests in each task, merged by bucket: a task hands on a bounded number of centroids."""
    v, out = points.select(BUCKET, item.field.cast("double").alias("v")).where("v is not null and not isnan(v)"), item.out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests: dict = {}
        for batch in batches:
            for key, part in batch.groupby(BUCKET, dropna=False)["v"]:
                digests.setdefault(key, ag.TDigest()).add(part.to_numpy())
        for key, d in digests.items():
            yield pd.DataFrame({BUCKET: [int(key)] * len(d.means), "m": d.means, "w": d.weights})

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        d = ag.TDigest()
        d.add(part["m"].to_numpy(), part["w"].to_numpy())
        return pd.DataFrame({BUCKET: [key[0]], out: [d.to_json()]})

    parts = v.mapInPandas(partial, f"{BUCKET} long, m double, w double")
    return parts.groupBy(BUCKET).applyInPandas(merge, f"{BUCKET} long, `{out}` string")


def _estimate(points: DataFrame, item: Item, time: str, ties: Sequence[str]) -> DataFrame:
    order = {c: f"__o{i}" for i, c in enumerate(ties)}
    v = points.select(BUCKET, F.col(time).alias("t"), item.field.cast("double").alias("v"), *(F.col(c).alias(o) for c, o in order.items())).where("v is not null and not isnan(v)")
    return control.pid_estimate(v, [BUCKET], "t", item.out, *item.args, ties=tuple(order.values()))


def simple(item: Item, time: str) -> Column:
    if item.name in ag.CORE:
        return ag.CORE[item.name](item.field, F.col(time))
    if item.name == "centroid":
        return ag.dimension_mean(item.field, item.dim)
    if item.name in ag.EXTENDED:
        return ag.EXTENDED[item.name](item.field, *item.args)
    raise ValueError(f"unknown aggregate {item.name!r}")


def aggregate(points: DataFrame, items: list[Item], needed: list[Column], time: str = "time", width: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Aggregates of points, globally or by bucket, ascending; only buckets that hold a needed point.

    The output has BUCKET (0 without buckets) and one column for each item.  A
    query without matching points has no rows.  ``ties`` order points of one time.
    """
    keyed = points.withColumn(BUCKET, bucket(time, width) if width else F.lit(0).cast("long"))
    live = reduce(lambda a, b: a | b, [c.isNotNull() for c in needed])
    keyed = keyed.where(live)
    plain = [i for i in items if i.name not in ag.SPECIAL or i.name == "centroid"]
    out = keyed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__rows"), *(simple(i, time).alias(i.out) for i in plain))
    for item in items:
        if item in plain:
            continue
        if item.name == "histogram":
            extra = _histogram(keyed, item)
        elif item.name.startswith("trajectory_"):
            extra = _trajectory(keyed, item, time, ties)
        elif item.name == "tdigest_agg":
            extra = _digest(keyed, item)
        elif item.name == "pid":
            extra = control.pid(keyed, [BUCKET], time, item.field, *item.args, out=item.out, ties=ties)
        else:
            extra = _estimate(keyed, item, time, ties)
        out = out.join(extra, BUCKET, "left")
    return out.select(BUCKET, *(i.out for i in items))


def quantile_of_digests(digests: list[np.ndarray], q: float) -> float | None:
    """Quantile of several (means, weights) pairs, for callers that keep digests of their own."""
    d = ag.TDigest()
    for means, weights in digests:
        d.add(means, weights)
    return d.quantile(q)
