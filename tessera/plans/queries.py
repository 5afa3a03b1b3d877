"""Registered queries of the engine over the driver's tables, with DuckDB SQL of the same meaning.

``events`` is a measurement with the tag event_type.  ``value`` is made sparse,
and a position, an integer and a flag are derived, by the same arithmetic on both
sides.  Results are rounded, since the two engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import TimeSeriesSession

Query = Callable[[SparkSession, str], DataFrame]

EVENTS = """(SELECT event_id, epoch_us(ts) // 1000 AS time, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, value AS whole,
  CAST(event_id % 11 AS BIGINT) AS k, event_id % 3 = 0 AS flag, (user_id % 170) - 85 + value / 1e6 AS lat, CAST((event_id % 358) - 179 AS DOUBLE) AS lon FROM events)"""
VECTOR = ",".join(f"{((i * 37) % 64 - 32) / 32:.5f}" for i in range(64))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    lat, lon = (F.col("user_id") % 170) - 85 + F.col("value") / 1e6, ((F.col("event_id") % 358) - 179).cast("double")
    return raw.select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.col("value").alias("whole"),
        (F.col("event_id") % 11).cast("long").alias("k"), (F.col("event_id") % 3 == 0).alias("flag"), F.struct(lat.alias("lat"), lon.alias("lon")).alias("pos"), "event_id",
    )


def session(spark: SparkSession, sf_dir: str) -> TimeSeriesSession:
    s = TimeSeriesSession(spark)
    s.register("events", events(spark, sf_dir), ["event_type"], order=["event_id"])
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    s.register("embeddings", emb.select(F.col("vec_id").alias("time"), F.col("label").cast("string").alias("label"), "embedding"), ["label"])
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ship = li.select(F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("time"), "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    s.register("shipments", ship, ["l_returnflag", "l_linestatus"])
    od = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s.register("orders_ts", od.select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("time"), "o_orderpriority", "o_totalprice"), ["o_orderpriority"])
    return s


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, text: str, oracle: str | None = None, digits: int = 4) -> None:
    """A statement of the dialect; the oracle's {E} is the events view."""
    QUERIES[name] = lambda spark, sf_dir: rounded(session(spark, sf_dir).sql(text), digits)
    if oracle:
        SQL[name] = oracle.replace("{E}", EVENTS)


def aggregate(name: str, call: str, expression: str, where: str = "", oracle_where: str | None = None) -> None:
    """One aggregate by hour; the oracle has the same buckets."""
    add(f"agg_{name}", f"SELECT {call} AS r, count(value) AS n FROM events {where} GROUP BY time(1h)", f"SELECT {expression} AS r, count(value) AS n FROM {{E}} {where if oracle_where is None else oracle_where} GROUP BY time // 3600000".replace(", 4)", ", 7)"), 7)


def window(name: str, call: str, expression: str, source: str = "{E}", digits: str = "round({x}, 4)") -> None:
    """One window function over each event type; the oracle's W is the series in order."""
    add(f"win_{name}", f"SELECT time, event_type, {call} AS r, value FROM events", f"SELECT time, event_type, {digits.format(x='r')} AS r, round(value, 4) AS value FROM (SELECT *, {expression} AS r FROM {source} WINDOW w AS (PARTITION BY event_type ORDER BY time)) WHERE value IS NOT NULL")


# statements and filters
add("raw_select", "SELECT time, event_type, value, k FROM events WHERE event_type = 'click'", "SELECT time, event_type, round(value, 4) AS value, k FROM {E} WHERE event_type = 'click'")
add("raw_time_range", "SELECT time, k FROM events WHERE time >= 1704500000000 AND time < 1704900000000", "SELECT time, k FROM {E} WHERE time >= 1704500000000 AND time < 1704900000000")
add("raw_axis_first_field", "SELECT time, event_type FROM events", "SELECT time, event_type FROM {E} WHERE value IS NOT NULL")
add("raw_order_limit", "SELECT time, value FROM events WHERE event_type = 'click' ORDER BY time DESC LIMIT 20 OFFSET 5", "SELECT time, round(value, 4) AS value FROM {E} WHERE event_type = 'click' AND value IS NOT NULL ORDER BY time DESC LIMIT 20 OFFSET 5")
add("raw_fetch_first", "SELECT time, k FROM events WHERE event_type = 'view' ORDER BY time FETCH FIRST 7 ROWS ONLY", "SELECT time, k FROM {E} WHERE event_type = 'view' ORDER BY time LIMIT 7")
add("raw_or_extension", "SELECT time, value FROM events WHERE event_type = 'click' OR k > 8", "SELECT time, round(value, 4) AS value FROM {E} WHERE (event_type = 'click' OR k > 8) AND value IS NOT NULL")
add("geo_where_within", "SELECT time, value, lat(pos) AS lat FROM events WHERE event_type = 'click' AND geo_within(pos, 10, 20, 3000000)", """SELECT time, round(value, 4) AS value, round(CASE WHEN d <= 3000000 THEN lat END, 4) AS lat FROM
  (SELECT *, 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 20) / 2), 2)))) AS d FROM {E}) WHERE event_type = 'click' AND (value IS NOT NULL OR d <= 3000000)""")
add("geo_where_bbox", "SELECT count(pos) AS n FROM events WHERE geo_bbox(pos, -10, -20, 30, 40)", "SELECT count(*) AS n FROM {E} WHERE lat BETWEEN -10 AND 30 AND lon BETWEEN -20 AND 40")

# aggregates
aggregate("count", "count(k)", "count(k)")
aggregate("sum", "sum(value)", "round(coalesce(sum(value), 0), 4)")
aggregate("min", "min(value)", "round(coalesce(min(value), 0), 4)")
aggregate("max", "max(value)", "round(coalesce(max(value), 0), 4)")
aggregate("avg", "avg(value)", "round(coalesce(avg(value), 0), 4)")
for _n, _c in (("first", "arg_min"), ("last", "arg_max")):
    add(f"agg_{_n}", f"SELECT {_n}(value) AS r FROM events WHERE event_type = 'click' GROUP BY time(6h)", f"SELECT round({_c}(value, time), 4) AS r FROM {{E}} WHERE event_type = 'click' AND value IS NOT NULL GROUP BY time // 21600000")
add("agg_count_star", "SELECT count(*) AS n FROM events WHERE event_type = 'click'", "SELECT count(value) + count(whole) + count(k) + count(flag) + count(event_id) AS n FROM {E} WHERE event_type = 'click'")
add("agg_count_star_buckets", "SELECT count(1) AS n, sum(flag) AS f FROM events GROUP BY time(1d)", "SELECT count(value) + count(whole) + count(k) + count(flag) + count(event_id) AS n, round(CAST(sum(CAST(flag AS INT)) AS DOUBLE), 4) AS f FROM {E} GROUP BY time // 86400000")
add("agg_empty", "SELECT sum(value) AS r FROM events WHERE time < 5", "SELECT sum(value) AS r FROM {E} WHERE time < 5 HAVING count(*) > 0")
add("agg_duplicates_count", "SELECT avg(l_quantity) AS q, sum(l_extendedprice) AS p, count(l_quantity) AS n FROM shipments WHERE l_returnflag = 'R' GROUP BY time(30d)", "SELECT round(avg(l_quantity), 4) AS q, round(sum(l_extendedprice), 4) AS p, count(l_quantity) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY (epoch_us(l_shipdate) // 1000) // 2592000000")
aggregate("stddev", "stddev(value)", "round(stddev_samp(value), 4)")
aggregate("variance", "variance(value)", "round(var_samp(value), 4)")
aggregate("spread", "spread(value)", "round(max(value) - min(value), 4)")
aggregate("mode", "mode(k)", "CAST((list_sort(map_entries(histogram(-k)), 'DESC')[1]).key AS DOUBLE)")
SQL["agg_mode"] = "WITH c AS (SELECT time // 3600000 AS b, k, count(*) AS m FROM {E} GROUP BY 1, 2), r AS (SELECT b, k, row_number() OVER (PARTITION BY b ORDER BY m DESC, k) AS i FROM c), n AS (SELECT time // 3600000 AS b, count(value) AS n FROM {E} GROUP BY 1) SELECT CAST(k AS DOUBLE) AS r, n FROM r JOIN n USING (b) WHERE i = 1".replace("{E}", EVENTS)
for _n, _q in (("median", 0.5), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)):
    aggregate(_n, f"{_n}(value)", f"round(quantile_cont(value, {_q}), 4)")
aggregate("percentile", "percentile(value, 12.5)", "round(quantile_cont(value, 0.125), 4)")


def _distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch beside the exact count, and whether it is within 15 % (three standard errors)."""
    s = session(spark, sf_dir)
    s.functions.register_aggregate("exact_distinct", F.count_distinct)
    out = s.sql("SELECT distinct_count(value) AS r, exact_distinct(value) AS n FROM events GROUP BY time(1d)")
    return out.select("n", (F.abs(F.col("r") - F.col("n")) <= F.greatest(F.lit(1.0), 0.15 * F.col("n"))).alias("near"))


def _tdigest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, weight and mean of each digest, and whether its median lies within 5 % of the range of the exact one."""
    out = session(spark, sf_dir).sql("SELECT tdigest_agg(value) AS r, median(value) AS m, spread(value) AS w FROM events GROUP BY time(7d)")
    out = out.withColumn("d", F.from_json("r", "count long, centroids array<array<double>>"))
    total = lambda f: F.aggregate("d.centroids", F.lit(0.0), lambda a, c: a + f(c))
    step = lambda a, c: F.struct((a["seen"] + c[1]).alias("seen"), F.when(a["seen"] * 2 < F.col("d.count"), c[0]).otherwise(a["mid"]).alias("mid"))
    mid = F.aggregate("d.centroids", F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("mid")), step)["mid"]
    weight = total(lambda c: c[1])
    return out.select(F.col("d.count").alias("n"), weight.cast("long").alias("weight"), F.round(total(lambda c: c[0] * c[1]) / weight, 4).alias("mean"), (F.abs(mid - F.col("m")) <= 0.05 * F.col("w")).alias("near"))


QUERIES["agg_distinct_count"] = _distinct_count
SQL["agg_distinct_count"] = "SELECT count(DISTINCT value) AS n, true AS near FROM {E} WHERE value IS NOT NULL GROUP BY time // 86400000".replace("{E}", EVENTS)
QUERIES["agg_tdigest"] = _tdigest
SQL["agg_tdigest"] = "SELECT count(value) AS n, count(value) AS weight, round(avg(value), 4) AS mean, true AS near FROM {E} WHERE value IS NOT NULL GROUP BY time // 604800000".replace("{E}", EVENTS)
add("agg_histogram", "SELECT histogram(value, 25) AS r FROM events WHERE event_type = 'click'", """SELECT '{' || string_agg('"[' || CAST(b * 25 AS BIGINT) || ',' || CAST((b + 1) * 25 AS BIGINT) || ')":' || n, ',' ORDER BY b) || '}' AS r FROM (SELECT floor(value / 25) AS b, count(*) AS n FROM {E} WHERE event_type = 'click' AND value IS NOT NULL GROUP BY 1)""")
QUERIES["agg_centroid"] = lambda spark, sf_dir: session(spark, sf_dir).sql("SELECT centroid(embedding) AS c FROM embeddings").select(*[F.round(F.col("c")[i].cast("double"), 4).alias(f"c{i}") for i in range(64)])
SQL["agg_centroid"] = "SELECT " + ", ".join(f"round(CAST(CAST(avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS FLOAT) AS DOUBLE), 4) AS c{i}" for i in range(64)) + " FROM embeddings"
_STEP = """WITH s AS (SELECT *, lag(lat) OVER o AS pa, lag(lon) OVER o AS po, time - lag(time) OVER o AS dt FROM {E} WHERE event_type = 'click' WINDOW o AS (PARTITION BY time // 86400000 ORDER BY time)),
  d AS (SELECT *, CASE WHEN pa IS NOT NULL THEN 1 END * 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(lat - pa) / 2), 2) + cos(radians(pa)) * cos(radians(lat)) * pow(sin(radians(lon - po) / 2), 2)))) AS m FROM s) """
for _n, _x in (("length", "coalesce(sum(m), 0) / 1000"), ("speed_max", "max(CASE WHEN dt > 0 THEN m * 1000 / dt END)"), ("speed_avg", "avg(CASE WHEN dt > 0 THEN m * 1000 / dt END)"), ("speed_p95", "quantile_cont(CASE WHEN dt > 0 THEN m * 1000 / dt END, 0.95)")):
    _call = f"trajectory_{_n}(pos" + ("" if _n == "length" else ", time") + ")"
    QUERIES[f"trajectory_{_n}"] = lambda spark, sf_dir, c=_call, k=_n: rounded(session(spark, sf_dir).sql(f"SELECT {c} AS r FROM events WHERE event_type = 'click' GROUP BY time(1d)").select((F.col("r") / (1000 if k == "length" else 1)).alias("r")), 2)
    SQL[f"trajectory_{_n}"] = (_STEP + f"SELECT round({_x}, 2) AS r FROM d GROUP BY time // 86400000").replace("{E}", EVENTS)
QUERIES["trajectory_centroid"] = lambda spark, sf_dir: rounded(session(spark, sf_dir).sql("SELECT trajectory_centroid(pos) AS g FROM events GROUP BY time(1d)").select("g.lat", "g.lon"))
SQL["trajectory_centroid"] = "SELECT round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon FROM {E} GROUP BY time // 86400000".replace("{E}", EVENTS)
QUERIES["trajectory_bbox"] = lambda spark, sf_dir: rounded(session(spark, sf_dir).sql("SELECT trajectory_bbox(pos) AS g FROM events GROUP BY time(1d)").select(F.from_json("g", "min_lat double, min_lon double, max_lat double, max_lon double").alias("g")).select("g.*"))
SQL["trajectory_bbox"] = "SELECT round(min(lat), 4) AS min_lat, min(lon) AS min_lon, round(max(lat), 4) AS max_lat, max(lon) AS max_lon FROM {E} GROUP BY time // 86400000".replace("{E}", EVENTS)
_PID = """WITH s AS (SELECT *, 50 - value AS e, {b} AS b FROM {E} WHERE event_type = 'click' AND value IS NOT NULL), p AS (SELECT *, lag(e) OVER o AS pe, (time - lag(time) OVER o) / 1000.0 AS dt FROM s WINDOW o AS (PARTITION BY b ORDER BY time)),
  u AS (SELECT *, 1.5 * e + 0.01 * coalesce(sum(e * dt) OVER (PARTITION BY b ORDER BY time), 0) + 2 * coalesce((e - pe) / dt, 0) AS u FROM p) """
add("pid_series", "SELECT time, pid_series(value, 50, 1.5, 0.01, 2) AS u, value FROM events WHERE event_type = 'click'", (_PID + "SELECT time, round(u, 4) AS u, round(value, 4) AS value FROM u").replace("{b}", "0"))
add("pid_buckets", "SELECT pid(value, 50, 1.5, 0.01, 2) AS u FROM events WHERE event_type = 'click' GROUP BY time(1d)", (_PID + "SELECT round(arg_max(u, time), 4) AS u FROM u GROUP BY b").replace("{b}", "time // 86400000"))
SQL["pid_estimate"] = """WITH y AS (SELECT event_id * 1000 AS t, n, row_number() OVER (ORDER BY event_id) AS i, 100 * (1 - exp(-greatest(0, event_id - 0.06 * n) / (0.1 * n))) AS v FROM events, (SELECT CAST(count(*) AS DOUBLE) AS n FROM events)),
  b AS (SELECT min(t) AS t0, avg(v) FILTER (WHERE i <= greatest(1, floor(n * 0.05))) AS low, avg(v) FILTER (WHERE i > n - greatest(1, floor(n * 0.1))) AS high FROM y),
  s AS (SELECT t - t0 AS t, (v - low) / (high - low) AS x, lag(t - t0) OVER (ORDER BY t) AS pt, lag((v - low) / (high - low)) OVER (ORDER BY t) AS px FROM y, b),
  c AS (SELECT min(pt + (0.35 - px) / (x - px) * (t - pt)) FILTER (WHERE px < 0.35 AND x >= 0.35) AS a, min(pt + (0.85 - px) / (x - px) * (t - pt)) FILTER (WHERE px < 0.85 AND x >= 0.85) AS e FROM s),
  m AS (SELECT (e - a) / (1.8971 - 0.4308) AS tau, a - (e - a) / (1.8971 - 0.4308) * 0.4308 AS theta, high - low AS gain FROM c, b),
  k AS (SELECT *, (tau + theta / 2) / (gain * 1.5 * theta) AS kp, tau * theta / (2 * tau + theta) AS td FROM m)
  SELECT round(kp, 4) AS kp, round(kp / (tau + theta / 2) * 1e6, 4) AS ki_e6, round(kp * td, 4) AS kd FROM k"""
QUERIES["pid_estimate"] = lambda spark, sf_dir: _pid_estimate(spark, sf_dir)


def _pid_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuning of a step response made from the event numbers, over all events: dead time 6 % and time constant 10 % of their count."""
    s = TimeSeriesSession(spark)
    rows = events(spark, sf_dir)
    n = rows.count()
    rise = 100 * (1 - F.exp(-F.greatest(F.lit(0.0), F.col("event_id") - 0.06 * n) / (0.1 * n or 1.0)))
    s.register("reactor", rows.select((F.col("event_id") * 1000).alias("time"), rise.alias("temperature")))
    parsed = F.from_json("r", "kp double, ki double, kd double")
    return rounded(s.sql("SELECT pid_estimate(temperature, 'imc', NULL, 0.05, NULL, NULL) AS r FROM reactor").select(parsed.alias("p")).select("p.kp", (F.col("p.ki") * 1e6).alias("ki_e6"), "p.kd"))


# window functions
_LAG = "last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LAG_T = "last_value(CASE WHEN value IS NOT NULL THEN time END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_CUM = "OVER (PARTITION BY event_type ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DIFF, _RATE = f"value - {_LAG}", f"(value - {_LAG}) * 60000 / ((time - {_LAG_T}))"
_LIVE = "(SELECT * FROM {E} WHERE value IS NOT NULL)"
for _n in ("difference", "delta"):
    window(_n, f"{_n}(value)", _DIFF)
window("increase", "increase(value)", f"CASE WHEN {_DIFF} >= 0 THEN {_DIFF} END")
window("derivative", "derivative(value, 1m)", _RATE)
for _n in ("non_negative_derivative", "rate", "irate"):
    window(_n, f"{_n}(value, 1m)", f"CASE WHEN {_RATE} >= 0 THEN {_RATE} END")
for _n in ("cumulative_sum", "running_sum"):
    window(_n, f"{_n}(value)", f"sum(value) {_CUM}")
window("running_min", "running_min(value)", f"min(value) {_CUM}")
window("running_max", "running_max(value)", f"max(value) {_CUM}")
window("integral", "integral(value, 1h)", f"sum(a) {_CUM}", f"(SELECT *, coalesce(0.5 * (value + {_LAG}) * (time - {_LAG_T}) / 3600000, CASE WHEN value IS NOT NULL THEN 0 END) AS a FROM {{E}})")
window("moving_average", "moving_average(value, 5)", "CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY time) >= 5 THEN avg(value) OVER (PARTITION BY event_type ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END", _LIVE)


def sparse(name: str, call: str, expression: str, digits: str = "round(r, 4)") -> None:
    """A window function seen on rows where value is missing: ``whole`` keeps the rows."""
    add(f"win_{name}", f"SELECT time, event_type, {call} AS r, whole FROM events", f"SELECT time, event_type, {digits} AS r, round(whole, 4) AS whole FROM (SELECT *, {expression} AS r FROM {{E}})")


_NEXT, _NEXT_T = (f"first_value({x} IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY time ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)" for x in ("value", "CASE WHEN value IS NOT NULL THEN time END"))
sparse("fill", "fill(value, -1)", "coalesce(value, -1)")
sparse("locf", "locf(value)", f"last_value(value IGNORE NULLS) {_CUM}")
sparse("interpolate", "interpolate(value)", f"coalesce(value, {_LAG} + ({_NEXT} - {_LAG}) * (time - {_LAG_T}) / ({_NEXT_T} - {_LAG_T}))")
SQL["win_state_changes"] = f"SELECT time, event_type, CAST(sum(c) {_CUM} AS BIGINT) AS r, flag FROM (SELECT *, CASE WHEN flag <> lag(flag) OVER (PARTITION BY event_type ORDER BY time) THEN 1 ELSE 0 END AS c FROM {{E}})".replace("{E}", EVENTS)
QUERIES["win_state_changes"] = lambda spark, sf_dir: session(spark, sf_dir).sql("SELECT time, event_type, state_changes(flag) AS r, flag FROM events")
SQL["win_state_duration"] = f"SELECT time, event_type, time - last_value(s IGNORE NULLS) {_CUM} AS r, flag FROM (SELECT *, CASE WHEN lag(flag) OVER (PARTITION BY event_type ORDER BY time) IS DISTINCT FROM flag THEN time END AS s FROM {{E}})".replace("{E}", EVENTS)
QUERIES["win_state_duration"] = lambda spark, sf_dir: session(spark, sf_dir).sql("SELECT time, event_type, state_duration(flag) AS r, flag FROM events")
_ANOMALY = {
    "zscore": "abs(value - m) > 1.5 * d FROM (SELECT *, avg(value) OVER p AS m, stddev_samp(value) OVER p AS d FROM {E} WINDOW p AS (PARTITION BY event_type))",
    "mad": "r > 1.2 * 1.4826 * median(r) OVER (PARTITION BY event_type) FROM (SELECT *, abs(value - median(value) OVER (PARTITION BY event_type)) AS r FROM {E})",
    "iqr": "value < a - 0.3 * (b - a) OR value > b + 0.3 * (b - a) FROM (SELECT *, quantile_cont(value, 0.25) OVER p AS a, quantile_cont(value, 0.75) OVER p AS b FROM {E} WINDOW p AS (PARTITION BY event_type))",
}
for _n, _t in (("zscore", 1.5), ("mad", 1.2), ("iqr", 0.3)):
    _test, _, _from = _ANOMALY[_n].partition(" FROM ")
    add(f"anomaly_{_n}", f"SELECT time, event_type, anomaly(value, '{_n}', {_t}) AS r, k FROM events", f"SELECT time, event_type, CASE WHEN value IS NOT NULL THEN {_test} END AS r, k FROM {_from}")
_REC = "WITH RECURSIVE v AS (SELECT event_type, time, value, row_number() OVER (PARTITION BY event_type ORDER BY time) AS i FROM {E} WHERE value IS NOT NULL), "
add("win_ewma", "SELECT time, event_type, ewma(value, 0.3) AS r FROM events", _REC + "s AS (SELECT *, value AS r FROM v WHERE i = 1 UNION ALL SELECT v.*, 0.3 * v.value + 0.7 * s.r FROM s JOIN v ON v.event_type = s.event_type AND v.i = s.i + 1) SELECT time, event_type, round(r, 4) AS r FROM s")
add("win_holt_winters", "SELECT time, event_type, holt_winters(value, 0.4, 0.1) AS r FROM events", _REC + """s AS (SELECT v.*, value AS l, CAST(0 AS DOUBLE) AS t FROM v WHERE i = 1 UNION ALL SELECT v.*, CASE WHEN v.i = 2 THEN v.value ELSE 0.4 * v.value + 0.6 * (s.l + s.t) END,
  CASE WHEN v.i = 2 THEN v.value - s.l ELSE 0.1 * (0.4 * v.value + 0.6 * (s.l + s.t) - s.l) + 0.9 * s.t END FROM s JOIN v ON v.event_type = s.event_type AND v.i = s.i + 1) SELECT time, event_type, round(l + t, 4) AS r FROM s""")
add("changepoint", "SELECT time, event_type, changepoint(value, 'cusum', 4, 0.5) AS r FROM events", _REC + """n AS (SELECT event_type, count(*) AS n FROM v GROUP BY 1), b AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS d FROM v JOIN n USING (event_type) WHERE i <= least(greatest(5, n // 4), n - 1) GROUP BY 1),
  z AS (SELECT v.event_type, time, i, (value - m) / d AS z FROM v JOIN b USING (event_type)),
  s AS (SELECT event_type, time, i, greatest(0, z - 0.5) AS u, greatest(0, -z - 0.5) AS w FROM z WHERE i = 1 UNION ALL SELECT z.event_type, z.time, z.i,
    greatest(0, CASE WHEN s.u > 4 OR s.w > 4 THEN 0 ELSE s.u END + z.z - 0.5), greatest(0, CASE WHEN s.u > 4 OR s.w > 4 THEN 0 ELSE s.w END - z.z - 0.5) FROM s JOIN z ON z.event_type = s.event_type AND z.i = s.i + 1)
  SELECT time, event_type, u > 4 OR w > 4 AS r FROM s""")

# scalars
add("scalar_math", "SELECT time, abs(value - 50) AS a, round(value, 1) AS b, sqrt(value) AS c, log(value) AS d, log(value, 2) AS e, coalesce(value, -1) AS f FROM events WHERE event_type = 'click'", "SELECT time, round(abs(value - 50), 4) AS a, CASE WHEN value IS NOT NULL THEN round(round_even(value, 1), 4) END AS b, round(sqrt(value), 4) AS c, round(ln(value), 4) AS d, round(ln(value) / ln(2), 4) AS e, round(value, 4) AS f FROM {E} WHERE event_type = 'click' AND value IS NOT NULL")
_GEO = "2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(lat - 48.5) / 2), 2) + cos(radians(48.5)) * cos(radians(lat)) * pow(sin(radians(lon - 9.2) / 2), 2))))"
add("scalar_geo", "SELECT time, geo_distance(pos, POINT(48.5, 9.2)) AS d, geo_speed(pos, POINT(48.5, 9.2), 60000) AS s, lat(pos) AS a, lon(pos) AS o, geo_bearing(POINT(48.5, 9.2), pos) AS b FROM events WHERE event_type = 'view'", f"SELECT time, round(d, 4) AS d, round(d / 60, 4) AS s, round(lat, 4) AS a, lon AS o, round(fmod(degrees(atan2(sin(radians(lon - 9.2)) * cos(radians(lat)), cos(radians(48.5)) * sin(radians(lat)) - sin(radians(48.5)) * cos(radians(lat)) * cos(radians(lon - 9.2)))) + 360, 360), 4) AS b FROM (SELECT *, {_GEO} AS d FROM {{E}}) WHERE event_type = 'view'")
_Q = f"[{VECTOR}]::DOUBLE[]"
add("scalar_vector", f"SELECT time, cosine_distance(embedding, [{VECTOR}]) AS c, l2_distance(embedding, [{VECTOR}]) AS l, inner_product(embedding, [{VECTOR}]) AS i, vector_norm(embedding) AS n FROM embeddings", f"SELECT vec_id AS time, round(1 - list_cosine_similarity(v, {_Q}), 4) AS c, round(list_distance(v, {_Q}), 4) AS l, round(list_inner_product(v, {_Q}), 4) AS i, round(sqrt(list_inner_product(v, v)), 4) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
add("vector_operators", f"SELECT time, embedding <=> [{VECTOR}] AS c, embedding <-> [{VECTOR}] AS l, embedding <#> [{VECTOR}] AS i FROM embeddings", f"SELECT vec_id AS time, round(1 - list_cosine_similarity(v, {_Q}), 4) AS c, round(list_distance(v, {_Q}), 4) AS l, round(list_inner_product(v, {_Q}), 4) AS i FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")

# table-valued functions
_DIST = {"cosine": f"1 - list_cosine_similarity(v, {_Q})", "l2": f"list_distance(v, {_Q})", "inner_product": f"-list_inner_product(v, {_Q})"}
for _n, _x in _DIST.items():
    QUERIES[f"knn_{_n}"] = lambda spark, sf_dir, m=_n: rounded(session(spark, sf_dir).sql(f"SELECT * FROM knn(embeddings, embedding, [{VECTOR}], 10, '{m}')").select("time", "distance", "label"))
    SQL[f"knn_{_n}"] = f"SELECT vec_id AS time, round({_x}, 4) AS distance, CAST(label AS VARCHAR) AS label FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) ORDER BY {_x}, vec_id LIMIT 10"
add("forecast_linear", "SELECT * FROM forecast(events, value, 5, 'linear')", """WITH p AS (SELECT event_type, time, value AS y, (time - min(time) OVER (PARTITION BY event_type)) / 1000.0 AS x FROM {E} WHERE value IS NOT NULL),
  f AS (SELECT event_type, count(*) AS n, min(time) AS t0, max(time) AS t1, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, var_pop(y) AS vy, covar_pop(x, y) AS c FROM p GROUP BY 1),
  g AS (SELECT *, sqrt(n * (vy - b * c) / greatest(1, n - 2)) AS d, greatest(1, (t1 - t0) // (n - 1)) AS s, h FROM f, range(1, 6) r(h)),
  o AS (SELECT event_type, t1 + s * h AS time, a + b * (t1 + s * h - t0) / 1000.0 AS v, 1.959963984540054 * d * sqrt(h) AS w FROM g) SELECT time, round(v, 4) AS value, round(v - w, 4) AS lower, round(v + w, 4) AS upper, event_type FROM o""")
add("forecast_holt_winters", "SELECT * FROM forecast(events, value, 5, 'holt_winters', 24)")

# programmatic aggregate interface
QUERIES["aggregate_series"] = lambda spark, sf_dir: rounded(session(spark, sf_dir).aggregate_series("events", "value", "avg", 86_400_000))
SQL["aggregate_series"] = "SELECT event_type, time // 86400000 * 86400000 AS start, (time // 86400000 + 1) * 86400000 AS end_exclusive, count(value) AS count, round(avg(value), 4) AS value FROM {E} WHERE value IS NOT NULL GROUP BY event_type, time // 86400000".replace("{E}", EVENTS)
add("group_by_tag", "SELECT event_type, avg(value) AS a, count(k) AS n FROM events GROUP BY event_type, time(1d)", "SELECT event_type, round(coalesce(avg(value), 0), 4) AS a, count(k) AS n FROM {E} GROUP BY event_type, time // 86400000")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean and p95 by event type, with hours whose mean is an outlier of its series."""
    from tessera.functions.series import Series
    from tessera.functions.windows import with_window

    s = session(spark, sf_dir)
    hours = s.measurement("events").points.where(F.col("value").isNotNull()).groupBy("event_type", (F.col("time") - F.pmod(F.col("time"), F.lit(3_600_000))).alias("time")).agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.95)).alias("p95"))
    out = with_window(hours, Series(("event_type",)), "outlier", "anomaly", F.col("mean"), "mad", 3.0)
    return rounded(out.orderBy("time", "event_type"))


QUERIES["flagship"] = flagship
SQL["flagship"] = """WITH h AS (SELECT event_type, time // 3600000 * 3600000 AS time, avg(value) AS mean, quantile_cont(value, 0.95) AS p95 FROM {E} WHERE value IS NOT NULL GROUP BY 1, 2), d AS (SELECT *, abs(mean - median(mean) OVER (PARTITION BY event_type)) AS r FROM h)
  SELECT event_type, time, round(mean, 4) AS mean, round(p95, 4) AS p95, r > 3 * 1.4826 * median(r) OVER (PARTITION BY event_type) AS outlier FROM d""".replace("{E}", EVENTS)
