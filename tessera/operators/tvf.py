"""Table-valued functions: forecast and knn."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import forecast as fc
from tessera.functions.series import Series

METRICS = {"cosine": "cosine", "cosine_distance": "cosine", "l2": "l2", "l2_distance": "l2", "euclidean": "l2", "inner_product": "ip", "dot": "ip", "ip": "ip"}


def forecast(df: DataFrame, s: Series, field: str, horizon: int, method: str = "linear", season: int = 0) -> DataFrame:
    """(time, value, lower, upper, tags) of ``horizon`` steps beyond each series of two points or more.

    The line is fitted by sums over rows, without Python; smoothing folds each series in one group.
    """
    if horizon < 1 or method.lower() not in fc.METHODS:
        raise ValueError("the horizon must be 1 at least and the method linear or holt_winters")
    if fc.METHODS[method.lower()] == "linear":
        return _linear(df, s, field, horizon)
    kinds = dict(df.dtypes)
    schema = "time long, value double, lower double, upper double" + "".join(f", `{t}` {kinds[t]}" for t in s.tags)

    def each(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([s.time, *s.order], kind="stable")
        if len(part) < 2:
            return pd.DataFrame(columns=["time", "value", "lower", "upper", *s.tags])
        at, value, width = fc.forecast(part[s.time].to_numpy(), part[field].to_numpy(dtype=float), horizon, method, season)
        return pd.DataFrame({"time": at, "value": value, "lower": value - width, "upper": value + width} | {t: [k] * horizon for t, k in zip(s.tags, key)})

    points = df.where(F.col(field).isNotNull()).select(s.time, F.col(field).cast("double").alias(field), *s.tags, *(c for c in s.order if c != field))
    return points.groupBy(*s.tags).applyInPandas(each, schema)


def _linear(df: DataFrame, s: Series, field: str, horizon: int) -> DataFrame:
    v = F.col(field).cast("double")
    points = df.where(v.isNotNull() & ~F.isnan(v)).select(*s.tags, F.col(s.time).alias("__t"), v.alias("__y"))
    first = Window.partitionBy(*(s.tags or [F.lit(0)]))
    x = points.withColumn("__0", F.min("__t").over(first)).withColumn("__x", (F.col("__t") - F.col("__0")) / 1000.0)
    fit = x.groupBy(*s.tags).agg(
        F.count(F.lit(1)).alias("n"), F.min("__t").alias("t0"), F.max("__t").alias("t1"), F.avg("__x").alias("mx"), F.avg("__y").alias("my"),
        F.coalesce(F.covar_pop("__x", "__y"), F.lit(0.0)).alias("cxy"), F.var_pop("__x").alias("vx"), F.var_pop("__y").alias("vy"),
    ).where("n >= 2")
    slope = F.when(F.col("vx") > 0, F.col("cxy") / F.col("vx")).otherwise(0.0)
    fit = fit.withColumn("b", slope).withColumn("a", F.col("my") - F.col("b") * F.col("mx"))
    sse = F.greatest(F.lit(0.0), F.col("n") * (F.col("vy") - F.col("b") * F.col("cxy")))
    fit = fit.withColumn("dev", F.sqrt(sse / F.greatest(F.lit(1), F.col("n") - 2))).withColumn("step", F.greatest(F.lit(1).cast("long"), F.floor((F.col("t1") - F.col("t0")) / (F.col("n") - 1))))
    ahead = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("time", F.col("t1") + F.col("step") * F.col("h"))
    value = F.col("a") + F.col("b") * (F.col("time") - F.col("t0")) / 1000.0
    width = fc.Z95 * F.col("dev") * F.sqrt("h")
    return ahead.select("time", value.alias("value"), (value - width).alias("lower"), (value + width).alias("upper"), *s.tags)


def distance(v: Column, query: Sequence[float], metric: str = "cosine") -> Column:
    """Distance to a literal vector in doubles; inner product gives minus the product, a zero vector is at cosine distance 1."""
    kind = METRICS[metric.lower()]
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    if kind == "ip":
        return -dot
    if kind == "l2":
        return F.sqrt(F.aggregate(F.zip_with(v, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    norm = own * float(np.sqrt(np.square(np.asarray(query, float)).sum()))
    return F.when(norm > 0, 1 - dot / norm).otherwise(1.0)


def knn(df: DataFrame, s: Series, field: str, query: Sequence[float], k: int, metric: str = "cosine", others: Sequence[str] = ()) -> DataFrame:
    """(time, distance, tags, other fields) of the k nearest rows: a top-k, so each task keeps k rows only."""
    if k < 1 or not query:
        raise ValueError("k must be 1 at least and the query not empty")
    near = df.where(F.col(field).isNotNull()).withColumn("distance", distance(F.col(field), query, metric))
    return near.select(s.time, "distance", *s.tags, *others).orderBy("distance", s.time, *s.tags).limit(k)
