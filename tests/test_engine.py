"""The engine end to end: statements, semantics, storage, ingestion, sinks, streams, user functions."""

import json
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.plans.sql import Parser, SqlError, tokenize
from tessera.schema import SchemaError
from tessera.session import TimeSeriesSession
from tessera.sources import ingest, sinks

SEED = "INSERT INTO pump (time, unit, hall, flow, ticks) VALUES (4000,'p1','north',1.5,4),(6000,'p1','north',4.5,9),(9000,'p1','north',3.0,2),(5000,'p2','south',8.0,7),(7500,'p2','south',8.5,1)"


@pytest.fixture
def pump(spark, tmp_path):
    s = TimeSeriesSession(spark, str(tmp_path / "root"))
    s.script("CREATE MEASUREMENT pump (unit TAG, hall TAG, flow FIELD FLOAT, ticks FIELD INT, ok FIELD BOOL, note FIELD STRING);" + SEED)
    return s


def values(df):
    return [tuple(r) for r in df.collect()]


def test_aggregate_rules(pump):
    assert values(pump.sql("SELECT count(*) FROM pump WHERE unit = 'p1'")) == [(6,)]
    assert pump.sql("SELECT count(1) FROM pump").columns == ["count(1)"]
    assert values(pump.sql("SELECT AVG(flow), count(flow) FROM pump WHERE unit='p1' GROUP BY time(5000ms)")) == [(1.5, 1), (3.75, 2)]
    assert values(pump.sql("SELECT sum(flow) FROM pump WHERE time > 99999")) == []
    assert values(pump.sql("SELECT first(flow), last(flow) FROM pump WHERE unit='p1'")) == [(1.5, 3.0)]
    assert values(pump.sql("SELECT stddev(flow), spread(flow), mode(ticks) FROM pump WHERE unit='p1'")) == [(1.5, 3.0, 2.0)]
    assert values(pump.sql("SELECT stddev(flow) FROM pump WHERE time = 4000")) == [(None,)]
    with pytest.raises(SqlError):
        pump.sql("SELECT last(flow) FROM pump")
    with pytest.raises(SqlError):
        pump.sql("SELECT flow, avg(flow) FROM pump")
    digest = json.loads(values(pump.sql("SELECT tdigest_agg(flow) FROM pump"))[0][0])
    assert digest["count"] == 5 and digest["centroids"][0] == [1.5, 1]


def test_raw_rules(pump):
    assert values(pump.sql("SELECT time, flow FROM pump c WHERE c.unit = 'p1' ORDER BY time DESC LIMIT 2")) == [(9000, 3.0), (6000, 4.5)]
    pump.sql("INSERT INTO pump (time, unit, hall, note) VALUES (20000, 'p1', 'north', 'x')")
    assert values(pump.sql("SELECT time FROM pump WHERE unit='p1' ORDER BY time")) == [(4000,), (6000,), (9000,)]
    assert values(pump.sql("SELECT time, note FROM pump WHERE unit='p1' ORDER BY time")) == [(20000, "x")]
    pump.sql("INSERT INTO pump (time, unit, hall, flow) VALUES (4000, 'p1', 'north', 9.0)")  # the last write wins for rows, both count
    assert values(pump.sql("SELECT flow, ticks FROM pump WHERE unit='p1' AND time = 4000")) == [(9.0, 4)]
    assert values(pump.sql("SELECT count(flow) FROM pump WHERE unit='p1' AND time = 4000")) == [(2,)]


@pytest.mark.parametrize("text", ["SELECT flow FROM pump WHERE flow > 1", "SELECT flow FROM pump WHERE unit != 'p1'", "SELECT flow FROM pump WHERE unit='a' OR unit='b'", "SELECT flow FROM pump WHERE unit='a' AND unit='b'", "SELECT flow*2 FROM pump", "SELECT flow FROM pump WHERE time > 5 AND time < 5", "SELECT avg(flow) FROM pump GROUP BY unit", "SELECT flow FROM pump ORDER BY flow"])
def test_strict_mode(pump, text):
    pump.strict = True
    with pytest.raises(SqlError):
        pump.sql(text)


@pytest.mark.parametrize("text", ["SELECT nope FROM pump", "SELECT avg(unit) FROM pump", "SELECT sum(note) FROM pump", "SELECT x.flow FROM pump", "SELECT f(flow) FROM pump", "SELECT flow FROM none", "INSERT INTO pump (time, unit) VALUES (1,'a')", "INSERT INTO pump (unit, flow) VALUES ('a', NULL)", "CREATE MEASUREMENT pump (a FIELD INT)", "SELECT moving_average(flow, 0) FROM pump"])
def test_errors(pump, text):
    with pytest.raises(ValueError):
        pump.sql(text).collect()


def test_windows(pump):
    pump.script("CREATE MEASUREMENT m (unit TAG, a FIELD FLOAT, b FIELD FLOAT); INSERT INTO m (time,unit,a) VALUES (0,'x',1.0),(1000,'x',3.0),(4000,'x',2.0); INSERT INTO m (time,unit,b) VALUES (2000,'x',5.0),(5000,'x',6.0)")
    got = values(pump.sql("SELECT time, b, locf(a), fill(a,0), interpolate(a), difference(a), increase(a), integral(a), cumulative_sum(a), ewma(a,0.5), state_changes(a), state_duration(a) FROM m ORDER BY time"))
    assert got == [
        (0, None, 1.0, 1.0, 1.0, None, None, 0.0, 1.0, 1.0, 0, 0), (1000, None, 3.0, 3.0, 3.0, 2.0, 2.0, 2.0, 4.0, 2.0, 1, 0), (2000, 5.0, 3.0, 0.0, 3.0 - 1 / 3, None, None, 2.0, 4.0, 2.0, 1, 1000),
        (4000, None, 2.0, 2.0, 2.0, -1.0, None, 9.5, 6.0, 2.0, 2, 0), (5000, 6.0, 2.0, 0.0, None, None, None, 9.5, 6.0, 2.0, 2, 1000),
    ]
    flat = values(pump.sql("SELECT anomaly(flow,'zscore',3), changepoint(flow,'cusum',4) FROM pump"))
    assert flat == [(False, False)] * 5


def test_changepoint_and_estimate(spark):
    import math

    s = TimeSeriesSession(spark)
    rows = [(i * 1000, float(i % 2) + (10 if i >= 40 else 0), 0.0 if i < 20 else 10 * (1 - math.exp(-max(0, i - 25) / 10))) for i in range(100)]
    s.register("r", spark.createDataFrame(rows, "time long, v double, y double"))
    fired = [t for t, f in values(s.sql("SELECT time, changepoint(v, 'cusum', 4) FROM r ORDER BY time")) if f]
    assert fired[0] == 40_000
    p = json.loads(values(s.sql("SELECT pid_estimate(y, 'zn', NULL, NULL, NULL, NULL) FROM r"))[0][0])
    assert p["kp"] > 0 and p["ki"] > 0 and p["kd"] > 0
    with pytest.raises(Exception, match="samples"):
        s.sql("SELECT pid_estimate(y, 'zn', NULL, NULL, NULL, NULL) FROM r WHERE time < 5000").collect()


def test_schema_evolution_delete_and_upkeep(pump):
    assert [r[2] for r in values(pump.sql("DESCRIBE pump"))] == ["string", "string", "float64", "int64", "boolean", "string"]
    pump.sql("INSERT INTO pump (time, unit, ticks, fresh) VALUES (30000, 'p3', 1.5, 2)")
    assert dict((r[0], r[2]) for r in values(pump.sql("DESCRIBE pump")))["ticks"] == "float64"
    with pytest.raises(SchemaError):
        pump.sql("INSERT INTO pump (time, unit, flow) VALUES (9000, 'p3', TRUE)")
    assert pump.sql("DELETE FROM pump WHERE unit = 'p1' AND time <= 6000") == 5
    live = "SELECT time, flow FROM pump ORDER BY time"
    before = values(pump.sql(live))
    assert before == [(5000, 8.0), (7500, 8.5), (9000, 3.0)]
    pump.sql("INSERT INTO pump (time, unit, hall, flow) VALUES (4000, 'p1', 'north', 7.0)")  # hidden as well
    assert values(pump.sql(live)) == before
    assert pump.storage.compact("default", "pump") and values(pump.sql(live)) == before
    day = 86_400_000
    pump.sql(f"INSERT INTO pump (time, unit, hall, flow) VALUES ({9 * day}, 'p1', 'north', 8.0)")
    assert pump.storage.retain("default", "pump", day, 10 * day) >= 1
    assert values(pump.sql(live)) == [(9 * day, 8.0)]


def test_databases_and_accounts(pump):
    pump.script("CREATE DATABASE other; USE other")
    assert values(pump.sql("SHOW MEASUREMENTS")) == [] and values(pump.sql("SELECT current_database()")) == [("other",)]
    pump.script("CREATE USER ann WITH PASSWORD 'x'; GRANT READ ON DATABASE other TO ann")
    assert values(pump.sql("SHOW GRANTS FOR ann")) == [("ann", "other", "read")]
    token = pump.sql("ISSUE TOKEN FOR ann").first()
    assert values(pump.sql("SHOW TOKENS")) == [(token.token_id, "ann")]
    pump.sql("DROP USER ann")
    assert values(pump.sql("SHOW USERS")) == []


def test_parser():
    assert [t.text for t in tokenize("SELECT a -- note\n FROM /* x */ b")][:-1] == ["SELECT", "a", "FROM", "b"]
    assert Parser("SELECT avg(x) FROM m GROUP BY time(1500us)").single().group[0].args[0].value == 1
    for bad in ("SELECT", "SELECT a FROM", "INSERT INTO m (a) VALUES (1, 2)", "CREATE MEASUREMENT m (a FIELD VECTOR(0))", "CREATE MEASUREMENT m (v FIELD VECTOR(3) WITH INDEX hnsw(m=1, ef=8))", "SELECT a FROM m WHERE p = POINT(91, 0)", "SELECT ? FROM m"):
        with pytest.raises(SqlError):
            Parser(bad).single()


def test_line_protocol_and_json(spark, tmp_path):
    p = ingest.parse_line(r'test,ho\ st=a\=b usage=1.5,errors=2i,ok=T,status="a \"b\" c, d" 1704067200000000', "us")
    assert (p.measurement, p.time, p.tags, p.fields) == ("test", 1704067200000, {"ho st": "a=b"}, {"usage": 1.5, "errors": 2, "ok": True, "status": 'a "b" c, d'})
    s = TimeSeriesSession(spark, str(tmp_path / "lp"))
    assert s.load("# note\ncpu,host=a v=1,n=2i 1000\ncpu,host=a v=x 5\ncpu,host=b v=3 2000\n", policy="skip") == (2, 1)
    with pytest.raises(ValueError):
        s.load("cpu,host=a v=x 5")
    assert s.load('{"m":"cpu","precision":"s","points":[{"t":3,"tags":{"host":"a"},"fields":{"v":0.5}}]}') == (1, 0)
    assert s.load("INSERT INTO cpu (time, host, v) VALUES (4000, 'a', 4.0)") == (1, 0)
    assert values(s.sql("SELECT time, host, v FROM cpu ORDER BY time")) == [(1000, "a", 1.0), (2000, "b", 3.0), (3000, "a", 0.5), (4000, "a", 4.0)]
    (tmp_path / "x.lp").write_text("cpu,host=a v=1 1000\nbroken\n")
    got = ingest.read_line_protocol(spark, str(tmp_path / "x.lp"))
    assert got.where("error is null").count() == 1 and got.where("error is not null").count() == 1


def test_sinks(spark):
    from tessera.functions.scalars import point
    from tessera.functions.series import Series

    df = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "a", 1.5, 2.5)], "time long, car string, x double, y double").select("time", "car", point(F.col("x"), F.col("y")).alias("g"))
    s = Series(("car",))
    lines = json.loads("".join(sinks.feature_collection(sinks.geojson_lines(df, s, "g"))))
    assert lines["features"][0]["geometry"]["coordinates"] == [[2.0, 1.0], [2.5, 1.5]]
    assert len(json.loads("".join(sinks.feature_collection(sinks.geojson_points(df, s, "g"))))["features"]) == 2
    out = list(sinks.ndjson(spark.createDataFrame([(1, float("nan"))], "a int, b double")))
    assert json.loads(out[1]) == [1, None] and json.loads(out[2])["rowCount"] == 1


def test_user_functions(pump):
    pump.functions.register_scalar("twice", lambda x: x * 2)
    pump.functions.register_aggregate("product", F.product)
    pump.functions.register_window("lagged", lambda df, s, out, f: df.withColumn(out, F.lag(f).over(s.w)))
    pump.functions.register_table("numbers", lambda session, n: session.spark.range(n))
    assert values(pump.sql("SELECT twice(flow) AS t FROM pump WHERE unit='p2' ORDER BY t")) == [(16.0,), (17.0,)]
    assert values(pump.sql("SELECT product(flow) FROM pump WHERE unit='p2'")) == [(68.0,)]
    assert values(pump.sql("SELECT time, lagged(flow) FROM pump WHERE unit='p2' ORDER BY time")) == [(5000, None), (7500, 8.0)]
    assert pump.sql("SELECT * FROM numbers(4)").count() == 4
    assert pump.functions.unregister("twice") and not pump.functions.unregister("twice")
    with pytest.raises(PermissionError):
        TimeSeriesSession(pump.spark, user_functions=False).functions.register_scalar("f", abs)


def test_streams(spark, tmp_path):
    from tessera.functions.series import Series
    from tessera.schema import Column, MeasurementSchema
    from tessera.sources.storage import Storage
    from tessera.streaming import stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.lp").write_text("m,h=a v=1 1000\nm,h=a v=3 2000\nm,h=b v=5 1000\n")
    store, schema = Storage(spark, str(tmp_path / "root")), MeasurementSchema("m", (Column("h", "tag"), Column("v", "field", "float64")))
    for _ in range(2):
        q = stream.into_measurement(stream.line_protocol_stream(spark, str(source)), store, "db", schema, str(tmp_path / "cp"))
        q.awaitTermination(120)
        (source / "b.lp").write_text("m,h=a v=8 3000\n")
    assert sorted(values(store.rows("db", "m"))) == [(1000, "a", 1.0), (1000, "b", 5.0), (2000, "a", 3.0), (3000, "a", 8.0)]
    points = stream.as_measurement(stream.line_protocol_stream(spark, str(source)), schema)
    out = stream.stateful_window(points, Series(("h",)), "v", "cumulative_sum")
    q = out.writeStream.format("memory").queryName("sums").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.h, r.time, r.out) for r in spark.table("sums").collect()) == [("a", 1000, 1.0), ("a", 2000, 4.0), ("a", 3000, 12.0), ("b", 1000, 5.0)]


def test_entry_and_oracles():
    import __spark_entry__ as entry

    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(names) >= 60


def test_stored_values_survive_a_new_session(pump, spark):
    again = TimeSeriesSession(spark, pump.storage.root)
    assert values(again.sql("SELECT count(*) FROM pump")) == [(10,)]


def test_pid_estimate_query_takes_all_events(spark, tmp_path):
    """Against a plain two-point fit over 4000 events."""
    import math

    from tessera.plans.queries import QUERIES

    n = 4000
    spark.range(n).selectExpr("id AS event_id", "timestamp_millis(1704067200000 + id * 1000) AS ts", "'click' AS event_type", "CAST(id % 90 AS DOUBLE) AS value", "id % 40 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    y = [100 * (1 - math.exp(-max(0, i - 0.06 * n) / (0.1 * n))) for i in range(n)]
    head, tail = n // 20, n // 10  # the statement gives 0.05 for the first, and the last is 0.1
    low, high = sum(y[:head]) / head, sum(y[-tail:]) / tail
    cross = []
    for level in (0.35, 0.85):
        goal = low + level * (high - low)
        i = next(i for i in range(n) if y[i + 1] >= goal > y[i])
        cross.append(1000 * (i + (goal - y[i]) / (y[i + 1] - y[i])))
    tau = (cross[1] - cross[0]) / (1.8971 - 0.4308)
    theta = cross[0] - 0.4308 * tau
    gain = high - low
    kp = (tau + theta / 2) / (gain * 1.5 * theta)
    kd = kp * tau * theta / (2 * tau + theta)
    (got,) = QUERIES["pid_estimate"](spark, str(tmp_path)).collect()
    assert abs(got.kp - kp) < 1e-3 and abs(got.kd - kd) < 1e-3 * kd


def _store(spark, tmp_path):
    from tessera.schema import Column, MeasurementSchema
    from tessera.sources.storage import Storage

    store = Storage(spark, str(tmp_path / "store"))
    schema = MeasurementSchema("m", (Column("h", "tag"), Column("v", "field", "float64")))
    store.save_schema("db", schema)
    return store, schema


def test_last_write_wins_in_a_large_batch(spark, tmp_path):
    s = TimeSeriesSession(spark, str(tmp_path / "root"))
    points = [ingest.Point("m", 10 if i in (10, 4096) else i + 10_000, {}, {"v": 777.0 if i == 4096 else float(i)}) for i in range(5000)]
    s.write(points)
    assert values(s.sql("SELECT v FROM m WHERE time = 10")) == [(777.0,)]
    s.write([ingest.Point("m", 10, {}, {"v": 5.0})])
    assert values(s.sql("SELECT v FROM m WHERE time = 10")) == [(5.0,)]


def test_only_what_the_log_names_is_read(spark, tmp_path):
    store, schema = _store(spark, tmp_path)
    rows = spark.createDataFrame([(1000, "a", 1.0)], "time long, h string, v double")
    assert store.append("db", schema, rows, stream=("s", 3))
    assert not store.append("db", schema, rows, stream=("s", 3))  # the same batch once more
    folder = next(iter(store.state("db", "m").data))
    path = store.path("db", "m")
    spark.read.parquet(f"{path}/{folder}/date=1970-01-01").write.parquet(f"{path}/data/batch=000000000099-left/date=1970-01-01")  # a write cut short
    store.put(f"{path}/_log/000000000002.claim", "")  # and its claim
    assert store.log("db", "m").count() == 1
    assert store.append("db", schema, rows) and store.state("db", "m").version == 3
    assert store.log("db", "m").count() == 2 and store.rows("db", "m").count() == 1


def test_compaction_merges_tiers_and_recycles_tombstones(spark, tmp_path):
    store, schema = _store(spark, tmp_path)
    rows = lambda *v: spark.createDataFrame([(t, "a", x) for t, x in v], "time long, h string, v double")
    for i in range(4):
        assert not store.compact("db", "m")
        store.append("db", schema, rows((i, float(i)), (0, 10.0 + i)))
    assert store.compact("db", "m") and len(store.state("db", "m").data) == 1 and not store.compact("db", "m")
    assert sorted(values(store.rows("db", "m"))) == [(0, "a", 13.0), (1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)]
    store.add_tombstones("db", schema, store.log("db", "m"), 1, 2)
    store.append("db", schema, rows((2, 5.0)))
    assert store.log("db", "m").where("time = 2").count() == 0
    assert store.compact("db", "m") and not store.state("db", "m").tombstones and not store.compact("db", "m")
    store.append("db", schema, rows((2, 6.0)))
    assert sorted(values(store.rows("db", "m"))) == [(0, "a", 13.0), (2, "a", 6.0), (3, "a", 3.0)]


def test_many_tombstones(spark, tmp_path):
    """Beyond the number that a filter holds, by a join."""
    store, schema = _store(spark, tmp_path)
    rows = spark.createDataFrame([(t, f"h{i}", 1.0) for i in range(100) for t in (1, 2)], "time long, h string, v double")
    store.append("db", schema, rows)
    assert store.add_tombstones("db", schema, store.log("db", "m").where("h <> 'h7'"), 2, 2) == 99
    assert sorted(values(store.log("db", "m").where("time = 2").select("h"))) == [("h7",)]


def test_scans_read_only_the_days_of_the_range(spark, tmp_path):
    s = TimeSeriesSession(spark, str(tmp_path / "root"))
    s.sql("CREATE MEASUREMENT m (h TAG, v FIELD FLOAT)")
    schema, day = s.storage.schema("default", "m"), 86_400_000
    s.storage.append("default", schema, spark.range(20).selectExpr(f"id * {day} + 5 AS time", "'a' AS h", "CAST(id AS DOUBLE) AS v"))
    for text in (f"SELECT time, v FROM m WHERE time >= {3 * day} AND time < {5 * day}", f"SELECT avg(v) FROM m WHERE time >= {3 * day} AND time < {5 * day}"):
        df = s.sql(text)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(date" in plan and "1970-01-04" in plan and "1970-01-05" in plan
        df.collect()
    assert values(s.sql(f"SELECT v FROM m WHERE time >= {3 * day} AND time < {5 * day}")) == [(3.0,), (4.0,)]


def test_payloads_read_in_tasks(spark):
    texts = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    got = ingest.parse_values(texts("INSERT INTO m (time, h, v) VALUES (1, 'a', 1.5), (2, 'b', 2.5)", "INSERT INTO m (time) VALUES (1)")).collect()
    assert sorted((r.time, r.tags, r.doubles) for r in got if r.error is None) == [(1, {"h": "a"}, {"v": 1.5}), (2, {"h": "b"}, {"v": 2.5})]
    assert sum(r.error is not None for r in got) == 1
    got = ingest.parse_json(texts('{"m": "m", "points": [{"t": 1, "fields": {"v": 2}}]}', "{")).collect()
    assert [r.longs for r in got if r.error is None] == [{"v": 2}] and len(got) == 2


def test_interpolation_in_linear_time(spark):
    """60,000 missing values after the first of a series: a frame that is read anew for each row takes minutes."""
    s, n = TimeSeriesSession(spark), 60_000
    points = spark.range(n + 1).selectExpr("id AS time", "'a' AS tag", f"CASE WHEN id % {n} = 0 THEN CAST(id AS DOUBLE) END AS v", "id AS k")
    s.register("m", points, ["tag"])
    out = s.sql("SELECT time, interpolate(v) AS r, k FROM m")
    frames = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line]
    assert frames and not any("unboundedfollowing" in line for line in frames)
    assert out.where("r IS NULL OR abs(r - time) > 1e-6").count() == 0 and out.count() == n + 1


def _tied(spark):
    """A series with two rows at 2000 ms and two equal ones at 3000 ms."""
    s = TimeSeriesSession(spark)
    s.register("m", spark.createDataFrame([(1000, "a", 1.0, 1), (2000, "a", 3.0, 2), (2000, "a", 5.0, 3), (3000, "a", 4.0, 4), (3000, "a", 4.0, 5)], "time long, tag string, v double, k long").orderBy(F.desc("k")), ["tag"], order=["k"])
    return s


@pytest.mark.parametrize("name", ["non_negative_derivative", "rate", "derivative", "irate"])
def test_slopes_between_rows_of_one_time(spark, name):
    """As SQL divides doubles: infinite, and NaN for no change; NaN counts as the largest."""
    got = values(_tied(spark).sql(f"SELECT {name}(v, 1s) AS r, k FROM m ORDER BY k"))
    fall = -1.0 if name == "derivative" else None
    assert [str(r) for r, _ in got] == [str(x) for x in (None, 2.0, math.inf, fall, math.nan)]


def test_controller_between_rows_of_one_time(spark):
    got = values(_tied(spark).sql("SELECT pid_series(v, 0, 0, 1, 1) AS r, k FROM m ORDER BY k"))
    assert [str(r) for r, _ in got] == [str(x) for x in (0.0, -3.0 - 2.0, -math.inf, -3.0 - 4.0 + 1.0, math.nan)]


@pytest.mark.parametrize("call,expected", [("increase(v)", [None, 2.0, 2.0, None, 0.0]), ("state_changes(v)", [0, 1, 2, 3, 3])])
def test_order_of_rows_of_one_time(spark, call, expected):
    """The rows come in reverse; the column of order decides."""
    assert [r for r, _ in values(_tied(spark).sql(f"SELECT {call} AS r, k FROM m ORDER BY k"))] == expected


def test_recursions_and_aggregates_take_the_order_of_rows_of_one_time(spark):
    s = _tied(spark)
    assert [r for r, _ in values(s.sql("SELECT ewma(v, 0.5) AS r, k FROM m ORDER BY k"))] == [1.0, 2.0, 3.5, 3.75, 3.875]
    assert [r for r, _ in values(s.sql("SELECT interpolate(v) AS r, k FROM m ORDER BY k"))] == [1.0, 3.0, 5.0, 4.0, 4.0]
    assert values(s.sql("SELECT pid(v, 0, 1, 0, 1) AS u FROM m WHERE tag = 'a'")) == [(-4.0 + 1.0,)]


def test_duration_of_a_state_takes_the_order_of_rows_of_one_time(spark):
    s = TimeSeriesSession(spark)
    s.register("m", spark.createDataFrame([(3000, True, 4), (2000, True, 3), (2000, False, 2), (1000, True, 1)], "time long, b boolean, k long"), order=["k"])
    assert [r for r, _ in values(s.sql("SELECT state_duration(b) AS r, k FROM m ORDER BY k"))] == [0, 0, 0, 1000]


@pytest.mark.parametrize("kind", ["values", "json"])
def test_parsed_points_are_handed_on_in_parts(kind):
    """Texts of 300 points in one batch of 60: the first part is there before the 20th text is read."""
    made = {
        "values": (lambda i: "INSERT INTO m (time, v) VALUES " + ",".join(f"({i * 300 + j}, 1.5)" for j in range(300)), lambda text: ingest.rows_of_insert(Parser(text).single(), None)),
        "json": (lambda i: json.dumps({"m": "m", "points": [{"t": i * 300 + j, "fields": {"v": 1.5}} for j in range(300)]}), ingest.parse_json_points),
    }
    text, parse = made[kind]
    seen = []
    out = ingest.parsed_batches(iter([pa.RecordBatch.from_pydict({"value": [*map(text, range(60)), "{"]})]), lambda x: seen.append(x) or parse(x))
    first = next(out)
    assert first.num_rows <= 4096 and len(seen) < 20
    rows = [r for b in (first, *out) for r in b.to_pylist()]
    assert [r["time"] for r in rows if r["error"] is None] == list(range(18_000)) and sum(r["error"] is not None for r in rows) == 1


def test_streamed_rows_are_sorted_in_runs(monkeypatch):
    """Four runs of 1000 rows; of the frames, one run is held at most."""
    import weakref

    import numpy as np
    import pandas as pd

    from tessera.streaming import stream

    monkeypatch.setattr(stream, "_RUN", 1000)
    rng, alive, most = np.random.default_rng(3), [], 0

    def frames():
        nonlocal most
        for i in range(40):
            frame = pd.DataFrame({"time": rng.integers(0, 500, 100), "k": np.arange(100 * i, 100 * i + 100)[::-1], "value": [None if j % 9 == 0 else float(j) for j in range(100)]})
            given.append(frame.copy())
            alive.append(weakref.ref(frame))
            most = max(most, sum(r() is not None for r in alive))
            yield frame

    given: list = []
    got = pd.concat(stream.in_order(frames(), ["time", "k"], "value")).reset_index(drop=True)
    expected = pd.concat(given).sort_values(["time", "k"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, expected)
    given_time = pd.concat(stream.in_order(iter(given), ["time"], "k")).reset_index(drop=True)
    pd.testing.assert_frame_equal(given_time, pd.concat(given).sort_values("time", kind="stable")[["time", "k"]].reset_index(drop=True))
    assert most <= 12


def test_stored_schema_change_takes_the_order_of_events(spark, tmp_path):
    """An even event after an odd one of its series and millisecond is the last."""
    import tessera.plans.stored  # noqa: F401  registers its queries
    from tessera.plans.queries import QUERIES

    rows = [(1, 5), (2, 5), (4, 6), (5, 6), (8, 7), (11, 8)]  # event_id, time
    spark.createDataFrame(rows, "event_id long, at long").selectExpr("event_id", "timestamp_millis(at) AS ts", "'click' AS event_type", "1.0D AS value", "1L AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.time, r.k, r.fresh) for r in QUERIES["store_schema_change"](spark, str(tmp_path)).collect())
    assert got == [(5, 2.0, 1), (6, 5.5, 5), (7, 8.0, None), (8, 0.5, 2)]


def test_distinct_user_aggregates_have_a_grouping_of_their_own(spark):
    """distinct_count's registers are made once a group, not once for each distinct value."""
    s = TimeSeriesSession(spark)
    s.functions.register_aggregate("exact_distinct", F.count_distinct)
    s.register("m", spark.range(3000).selectExpr("id AS time", "CASE WHEN id % 3 > 0 THEN CAST(id % 3 AS STRING) END AS tag", "CAST(id % 500 AS DOUBLE) AS v"), ["tag"])
    out = s.sql("SELECT tag, distinct_count(v) AS r, exact_distinct(v) AS n FROM m GROUP BY tag, time(1s)")
    sketches = [line.split("keys=[")[1].split("]")[0] for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "approx_count_distinct" in line]
    assert sketches and all(len(keys.split(",")) == 2 for keys in sketches)
    got = values(out)
    assert sorted(n for _, _, n in got) == [333] * 6 + [334] * 3 and {t for t, _, _ in got} == {None, "1", "2"}
    assert all(abs(r - n) <= 0.05 * n for _, r, n in got)


def test_step_response_of_rows_in_slabs(spark, monkeypatch):
    """Irregular times with gaps, in two buckets, cut into slabs of about 50 rows, against one pass over the sorted rows."""
    import random

    from tessera.functions import control

    monkeypatch.setattr(control, "ROWS", 50)
    rng, rows = random.Random(5), []
    for b in range(2):
        t = b * 10_000_000
        for i in range(700):
            t += rng.choice((1, 3, 40, 4000 if i % 97 == 0 else 7))
            rows.append((t, 0.0 if i < 90 else (b + 2) * (1 - math.exp(-(i - 90) / 80)) + rng.random() / 50))
    s = TimeSeriesSession(spark)
    s.register("r", spark.createDataFrame(rng.sample(rows, len(rows)) + [(5, None), (6, math.nan)], "time long, y double"))
    out = s.sql("SELECT pid_estimate(y, 'imc', NULL, 0.05, NULL, NULL) AS r FROM r GROUP BY time(10000s)")
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    expected = []
    for b in range(2):
        own = [r for r in sorted(rows) if r[0] // 10_000_000 == b]
        low, high = sum(y for _, y in own[:35]) / 35, sum(y for _, y in own[-70:]) / 70
        at = []
        for level in (0.35, 0.85):
            (t0, x0), (t1, x1) = next((p, q) for p, q in ((tuple((t, (y - low) / (high - low)) for t, y in own[i : i + 2])) for i in range(699)) if p[1] < level <= q[1])
            at.append(t0 - own[0][0] + (level - x0) / (x1 - x0) * (t1 - t0))
        expected.append(control.tune(*control.model(700, low, high, own[1][0] - own[0][0], *at), "imc"))
    for (got,), want in zip(values(out), expected, strict=True):
        assert list(json.loads(got).values()) == pytest.approx(list(want), rel=1e-9)
