"""Result sinks: ndjson and GeoJSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.series import Series


def ndjson(df: DataFrame) -> Iterator[str]:
    """A meta line, one JSON array a row, an end line; non-finite numbers become null."""
    yield json.dumps({"type": "meta", "columns": df.columns})
    n = 0
    clean = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v.asDict() if hasattr(v, "asDict") else v
    for row in df.toLocalIterator():
        n += 1
        yield json.dumps([clean(v) for v in row], default=str)
    yield json.dumps({"type": "end", "rowCount": n})


def geojson_points(df: DataFrame, s: Series, field: str) -> DataFrame:
    """(feature): a Point feature for each position, with time and tags as properties."""
    g = F.col(field)
    made = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(g["lon"], g["lat"]).alias("coordinates")).alias("geometry"),
        F.struct(F.col(s.time), *s.tags).alias("properties"),
    )
    return df.where(g.isNotNull()).select(F.to_json(made).alias("feature"))


def geojson_lines(df: DataFrame, s: Series, field: str) -> DataFrame:
    """(feature): a LineString feature for each series, with its time range, point count and tags."""
    g = F.col(field)
    path = F.sort_array(F.collect_list(F.struct(F.col(s.time).alias("t"), F.array(g["lon"], g["lat"]).alias("c"))))
    grouped = df.where(g.isNotNull()).groupBy(*s.tags).agg(path.alias("__p"), F.min(s.time).alias("from"), F.max(s.time).alias("to"), F.count(F.lit(1)).alias("pointCount"))
    made = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), F.transform("__p", lambda x: x["c"]).alias("coordinates")).alias("geometry"),
        F.struct("from", "to", "pointCount", *s.tags).alias("properties"),
    )
    return grouped.select(F.to_json(made).alias("feature"))


def feature_collection(features: DataFrame) -> Iterator[str]:
    """The text of a FeatureCollection, piece by piece."""
    yield '{"type":"FeatureCollection","features":['
    for i, row in enumerate(features.toLocalIterator()):
        yield ("," if i else "") + row.feature
    yield "]}"
