"""Registered queries over stored measurements, ingestion, sinks, user functions and streams, with their SQL.

Each writes ``events`` into a measurement of a store of its own, in the folder
that the cluster shares (``spark.checkpoint.dir``), and reads it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.series import Series
from tessera.plans.queries import EVENTS, QUERIES, SQL, events, rounded, session
from tessera.schema import MeasurementSchema
from tessera.session import TimeSeriesSession
from tessera.sources import ingest, sinks
from tessera.streaming import stream

CREATE = "CREATE MEASUREMENT ev (event_type TAG, value FIELD FLOAT, k FIELD INT, flag FIELD BOOL)"
#: The oracle's view of a raw query: each field's last value of a series and time.
LAST = "SELECT event_type, time, {fields} FROM {source} GROUP BY event_type, time"
START, END = 1704500000000, 1704900000000


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/tessera-store-{uuid.uuid4().hex}"


def _empty(spark: SparkSession) -> tuple[TimeSeriesSession, MeasurementSchema]:
    s = TimeSeriesSession(spark, _folder(spark))
    s.sql(CREATE)
    return s, s.storage.schema("default", "ev")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("_row", F.col("event_id"))


def _filled(spark: SparkSession, sf_dir: str) -> TimeSeriesSession:
    s, schema = _empty(spark)
    s.storage.append("default", schema, _rows(spark, sf_dir))
    return s


def add(name: str, oracle: str) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        SQL[name] = oracle.replace("{E}", EVENTS)
        return fn

    return register


def _last(*fields: str, source: str = "{E}", order: str = "event_id") -> str:
    made = [f"round(arg_max({f}, {order}) FILTER (WHERE {f} IS NOT NULL), 4) AS {f}" if f in ("value", "k2") else f"arg_max({f}, {order}) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in fields]
    return LAST.format(fields=", ".join(made), source=source)


@add("store_roundtrip", _last("value", "k", "flag"))
def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).sql("SELECT time, event_type, value, k, flag FROM ev")


@add("store_points", "SELECT count(value) AS n, round(avg(value), 4) AS mean, max(k) AS top FROM {E}")
def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates see every stored point, also those that a later write at the same time hides from raw queries."""
    out = _filled(spark, sf_dir).sql("SELECT count(value) AS n, avg(value) AS mean, max(k) AS top FROM ev")
    return out.withColumn("top", F.col("top").cast("long"))


@add("store_overwrite", _last("value", "k", source="(SELECT event_id, event_type, time, value, k FROM {E} UNION ALL SELECT event_id + 1000000000, event_type, time, whole * 2, NULL FROM {E} WHERE event_id % 5 = 0)"))
def _overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later write wins field by field."""
    s = _filled(spark, sf_dir)
    again = _rows(spark, sf_dir).where("event_id % 5 = 0").select("time", "event_type", (F.col("whole") * 2).alias("value"), "_row")
    s.storage.append("default", s.storage.schema("default", "ev"), again)
    return s.sql("SELECT time, event_type, value, k FROM ev")


_LIVE = f"(SELECT * FROM {{E}} WHERE NOT (event_type = 'click' AND time BETWEEN {START} AND {END - 1}) UNION ALL SELECT * FROM {{E}} WHERE event_type = 'click' AND time BETWEEN {START} AND {END - 1} AND event_id % 10 = 0)"


@add("store_delete_compact", _last("value", "k", source=_LIVE))
def _delete_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete hides a series' range until the compaction; points written after that are seen."""
    s = _filled(spark, sf_dir)
    s.sql(f"DELETE FROM ev WHERE event_type = 'click' AND time >= {START} AND time < {END}")
    s.storage.compact("default", "ev")
    again = _rows(spark, sf_dir).where(f"event_type = 'click' AND time BETWEEN {START} AND {END - 1} AND event_id % 10 = 0")
    s.storage.append("default", s.storage.schema("default", "ev"), again)
    return s.sql("SELECT time, event_type, value, k FROM ev")


@add("store_delete_hides_later_writes", f"SELECT count(k) AS n FROM {{E}} WHERE NOT (event_type = 'click' AND time BETWEEN {START} AND {END - 1})")
def _hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, schema = _empty(spark)
    rows = _rows(spark, sf_dir)
    s.storage.append("default", schema, rows.where("event_id % 2 = 0"))
    s.sql(f"DELETE FROM ev WHERE event_type = 'click' AND time >= {START} AND time < {END}")
    s.storage.append("default", schema, rows.where("event_id % 2 = 1"))
    return s.sql("SELECT count(k) AS n FROM ev")


@add("store_time_range", _last("value", "k", source=f"(SELECT * FROM {{E}} WHERE time >= {START} AND time < {END})"))
def _time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).sql(f"SELECT time, event_type, value, k FROM ev WHERE time >= {START} AND time < {END}")


@add("store_schema_change", "SELECT event_type, time, arg_max(CASE WHEN event_id % 2 = 0 THEN k ELSE CAST(k + 0.5 AS DOUBLE) END, event_id) AS k, arg_max(event_id % 9, event_id) FILTER (WHERE event_id % 2 = 1) AS fresh FROM {E} GROUP BY event_type, time")
def _schema_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer field becomes FLOAT and a field comes up: a new generation beside the old one, in odd rows written later.

    Even rows that come after an odd one of their series and time are written later too: event_id is the order of writes.
    """
    from tessera.schema import Column

    s, schema = _empty(spark)
    odd = F.col("event_id") % 2 == 1
    rows = _rows(spark, sf_dir).withColumn("late", F.max(odd).over(Series(("event_type",), order=("event_id",)).same_time))
    s.storage.append("default", schema, rows.where("NOT late"))
    schema = schema.promoted("k").with_columns(Column("fresh", "field", "int64"))
    s.storage.save_schema("default", schema)
    late = rows.where("late").withColumn("k", F.when(odd, F.col("k") + 0.5).otherwise(F.col("k"))).withColumn("fresh", F.when(odd, F.col("event_id") % 9))
    s.storage.append("default", schema, late)
    return s.sql("SELECT time, event_type, k, fresh FROM ev")


@add("store_retention", f"SELECT count(k) AS n, min(time) >= {START} AS kept FROM {{E}} WHERE time >= {START}")
def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filled(spark, sf_dir)
    s.storage.retain("default", "ev", 1000, START + 1000)
    return s.storage.log("default", "ev").agg(F.count("k").alias("n"), (F.min("time") >= START).alias("kept"))


def _ingested(spark: SparkSession, points: DataFrame) -> DataFrame:
    s, schema = _empty(spark)
    s.storage.append("default", schema, ingest.as_measurement(points, schema))
    return s.sql("SELECT count(value) AS n, sum(value) AS total, count(k) AS n_k, sum(k) AS total_k FROM ev").select("n", F.round("total", 2).alias("total"), "n_k", F.col("total_k").cast("long").alias("total_k"))


_INGESTED = "SELECT count(value) AS n, round(sum(value), 2) AS total, count(k) AS n_k, CAST(sum(k) AS BIGINT) AS total_k FROM {E}"


@add("ingest_line_protocol", _INGESTED)
def _line_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.coalesce(F.concat(F.lit("value="), F.col("value").cast("string"), F.lit(",")), F.lit(""))
    line = F.concat(F.lit("ev,event_type="), "event_type", F.lit(" "), value, F.lit("k="), F.col("k").cast("string"), F.lit("i "), F.col("time").cast("string"))
    path = _folder(spark)
    events(spark, sf_dir).select(line.alias("value")).write.text(path)
    return _ingested(spark, ingest.read_line_protocol(spark, path))


@add("ingest_json", _INGESTED)
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(F.col("time").alias("t"), F.struct("event_type").alias("tags"), F.struct("value", "k").alias("fields"))
    payload = F.to_json(F.struct(F.lit("ev").alias("m"), F.lit("ms").alias("precision"), F.collect_list(point).alias("points")))
    texts = events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 500)).agg(payload.alias("value")).select("value")
    return _ingested(spark, ingest.parse_json(texts))


@add("ingest_values", _INGESTED)
def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.format_string("(%d,'%s',%s%d)", F.col("time"), F.col("event_type"), F.coalesce(F.concat(F.col("value").cast("decimal(30,15)").cast("string"), F.lit(",")), F.lit("")), F.col("k"))
    rows = events(spark, sf_dir).select(F.col("value").isNull().alias("none"), F.floor(F.col("event_id") / 500).alias("part"), row.alias("row"))
    head = F.when(F.col("none"), "INSERT INTO ev (time, event_type, k) VALUES ").otherwise("INSERT INTO ev (time, event_type, value, k) VALUES ")
    texts = rows.groupBy("none", "part").agg(F.array_join(F.collect_list("row"), ",").alias("rows")).select(F.concat(head, "rows").alias("value"))
    return _ingested(spark, ingest.parse_values(texts))


@add("sink_geojson_points", "SELECT time, event_type, round(lon, 4) AS lon, round(lat, 4) AS lat FROM {E}")
def _geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sinks.geojson_points(events(spark, sf_dir), Series(("event_type",)), "pos")
    read = F.from_json("feature", "geometry struct<coordinates: array<double>>, properties struct<time: long, event_type: string>").alias("f")
    return made.select(read).select("f.properties.time", "f.properties.event_type", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


@add("sink_geojson_lines", "SELECT event_type, min(time) AS first, max(time) AS last, count(*) AS n, round(sum(lat), 2) AS lats, round(arg_max(lat, time), 4) AS final FROM {E} GROUP BY event_type")
def _geojson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sinks.geojson_lines(events(spark, sf_dir), Series(("event_type",)), "pos")
    read = F.from_json("feature", "geometry struct<coordinates: array<array<double>>>, properties struct<event_type: string, `from`: long, `to`: long, pointCount: long>").alias("f")
    lats = F.transform(F.col("f.geometry.coordinates"), lambda c: c[1])
    total = F.round(F.aggregate(lats, F.lit(0.0), lambda a, x: a + x), 2).alias("lats")
    return made.select(read).select("f.properties.event_type", F.col("f.properties.from").alias("first"), F.col("f.properties.to").alias("last"), F.col("f.properties.pointCount").alias("n"), total, F.element_at(lats, -1).alias("final"))


@add("scalar_st_aliases", "SELECT time, round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(lat - 48.5) / 2), 2) + cos(radians(48.5)) * cos(radians(lat)) * pow(sin(radians(lon - 9.2) / 2), 2)))), 2) AS d, d <= 4000000 AS near, d <= 4000000 AS near2, lat BETWEEN -10 AND 30 AND lon BETWEEN -20 AND 40 AS box FROM {E} WHERE event_type = 'view'")
def _st(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = session(spark, sf_dir).sql("SELECT time, st_distance(pos, POINT(48.5, 9.2)) AS d, st_within(pos, 48.5, 9.2, 4000000) AS near, st_dwithin(pos, 48.5, 9.2, 4000000) AS near2, geo_bbox(pos, -10, -20, 30, 40) AS box FROM events WHERE event_type = 'view'")
    return rounded(out, 2)


@add("raw_literals", "SELECT time, 1 AS one, 'x' AS word, round(value * 2 + 1, 4) AS v FROM {E} WHERE value IS NOT NULL")
def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("SELECT time, 1 AS one, 'x' AS word, value * 2 + 1 AS v FROM events")


@add("user_functions", "SELECT time, event_type, round(value * 2, 4) AS twice, round(lag(value) OVER (PARTITION BY event_type ORDER BY time), 4) AS before FROM (SELECT * FROM {E} WHERE value IS NOT NULL)")
def _user(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.functions.register_scalar("twice", lambda x: x * 2)
    s.functions.register_window("before", lambda df, series, out, f: df.where(f.isNotNull()).withColumn(out, F.lag(f).over(series.w)))
    return s.sql("SELECT time, event_type, twice(value) AS twice, before(value) AS before FROM events")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of one file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    value = F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")
    return raw.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), "event_type", value, "event_id")


def _drained(spark: SparkSession, out: DataFrame) -> DataFrame:
    path = _folder(spark)
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@add("stream_tumbling", "SELECT time // 3600000 * 3600000 AS time, event_type, count(value) AS count, round(sum(value), 4) AS sum, round(min(value), 4) AS min, round(max(value), 4) AS max FROM {E} GROUP BY time // 3600000, event_type HAVING (time // 3600000 + 1) * 3600000 <= (SELECT max(time) - 600000 FROM {E})")
def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, stream.tumbling(_streamed(spark, sf_dir), Series(("event_type",)), "value", 3_600_000))


def _stream_window(name: str, oracle: str, *args: float) -> None:
    text = f"SELECT time, event_type, round(value, 4) AS value, round({oracle}, 4) AS out FROM {{E}} WINDOW w AS (PARTITION BY event_type ORDER BY time ROWS UNBOUNDED PRECEDING), m AS (PARTITION BY event_type ORDER BY time ROWS 3 PRECEDING)"
    add(f"stream_{name}", text)(lambda spark, sf_dir: _drained(spark, stream.stateful_window(_streamed(spark, sf_dir), Series(("event_type",), order=("event_id",)), "value", name, *args)))


_stream_window("cumulative_sum", "sum(value) OVER w")
_stream_window("running_max", "max(value) OVER w")
_stream_window("moving_average", "CASE WHEN count(*) OVER m = 4 THEN avg(value) OVER m END", 4)
