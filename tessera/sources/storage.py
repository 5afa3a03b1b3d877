"""Storage of measurements: Parquet by batch and day under a commit log, tombstones, retention, compaction.

Layout of ``<root>/<db>/<measurement>``:

* ``_schema.json``, ``_gen_<n>.json``: the schema, and that of each generation;
* ``data/batch=<version>-<id>/date=<day>/*.parquet``: the rows of one write.  ``_seq``
  (the version) and ``_row`` give the order of writes;
* ``tombstones/<version>-<id>/*.parquet``: series and time ranges that are hidden;
* ``_log/<version>.json``: what a write added or took away.  Only what the log
  names is read, so a write that failed, or a compaction that was cut short, is
  never seen, and one that ran twice (a stream's batch) counts once.

Versions are claimed, before anything is written, by creating a file that must not exist.  Deletes hide earlier
and later writes until the next compaction, which drops what they hide and them.
"""

from __future__ import annotations

import datetime
import json
import time as clock
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.schema import MeasurementSchema, SchemaError

_MAX_INLINE = 64
MIN_TIME, MAX_TIME = -(1 << 62), 1 << 62
_DAY = 86_400_000
#: Days that a date column can name; times beyond them aren't pruned.
_FIRST_DAY, _LAST_DAY = -719_162, 2_932_896


def _day(time: int) -> str | None:
    """The day of a time in milliseconds."""
    days = time // _DAY
    return str(datetime.date(1970, 1, 1) + datetime.timedelta(days)) if _FIRST_DAY <= days <= _LAST_DAY else None


@dataclass
class State:
    """What the log adds up to: folders of rows with their generation, folders of tombstones, the last batch of each stream."""

    version: int = 0
    data: dict[str, int] = field(default_factory=dict)
    tombstones: list[str] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)
    floor: int = MIN_TIME


class Storage:
    """One warehouse root with databases of measurements, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # files
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def listing(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def make(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.mkdirs(p)

    def put(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def get(self, path: str) -> str:
        fs, p = self._fs(path)
        size = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        finally:
            stream.close()
        return bytes(raw)[:size].decode()

    # measurements
    def path(self, db: str, name: str) -> str:
        return f"{self.root}/{db}/{name}"

    def names(self, db: str) -> list[str]:
        return sorted(n for n in self.listing(f"{self.root}/{db}") if self.exists(f"{self.path(db, n)}/_schema.json"))

    def schema(self, db: str, name: str) -> MeasurementSchema | None:
        path = f"{self.path(db, name)}/_schema.json"
        return MeasurementSchema.from_json(self.get(path)) if self.exists(path) else None

    def save_schema(self, db: str, schema: MeasurementSchema) -> None:
        base = self.path(db, schema.name)
        self.make(base)
        self.put(f"{base}/_gen_{schema.generation}.json", schema.to_json())
        self.put(f"{base}/_schema.json", schema.to_json())

    # the log
    def state(self, db: str, name: str) -> State:
        out, base = State(), f"{self.path(db, name)}/_log"
        for entry in self.listing(base):
            out.version = max(out.version, int(entry.split(".")[0]))
            if not entry.endswith(".json"):
                continue
            change = json.loads(self.get(f"{base}/{entry}"))
            gone = set(change.get("remove", ()))
            out.data = {k: v for k, v in out.data.items() if k not in gone} | change.get("data", {})
            out.tombstones = [t for t in out.tombstones if t not in gone] + change.get("tombstones", [])
            out.streams |= change.get("streams", {})
            out.floor = max(out.floor, change.get("floor", MIN_TIME))
        return out

    def _claim(self, db: str, name: str) -> int:
        """A version that no other writer has."""
        base = f"{self.path(db, name)}/_log"
        version = self.state(db, name).version + 1
        while True:
            fs, p = self._fs(f"{base}/{version:012d}.claim")
            try:
                fs.create(p, False).close()
                return version
            except Py4JJavaError:
                if not fs.exists(p):
                    raise
                version += 1

    def _commit(self, db: str, name: str, version: int, **change) -> None:
        """Makes a write visible, in one step: a file that is put under its name when it is whole."""
        base = f"{self.path(db, name)}/_log"
        self.put(f"{base}/{version:012d}.part", json.dumps(change))
        fs, source = self._fs(f"{base}/{version:012d}.part")
        fs.rename(source, self._fs(f"{base}/{version:012d}.json")[1])
        self.delete(f"{base}/{version:012d}.claim")

    # rows
    def append(self, db: str, schema: MeasurementSchema, rows: DataFrame, stream: tuple[str, int] | None = None) -> bool:
        """rows: time and any of the schema's columns; later writes win, and in one write the larger ``_row`` (or the later row).

        A stream names its batch: (name, number); a batch that the log holds already isn't written again.
        """
        if stream and self.state(db, schema.name).streams.get(stream[0], -1) >= stream[1]:
            return False
        version = self._claim(db, schema.name)
        own = [(F.col(c.name) if c.name in rows.columns else F.lit(None)).cast(c.spark).alias(c.name) for c in schema.columns]
        row = F.col("_row") if "_row" in rows.columns else F.monotonically_increasing_id()
        out = rows.select(F.col("time").cast("long").alias("time"), *own, F.lit(version).cast("long").alias("_seq"), row.cast("long").alias("_row"))
        folder = f"data/batch={version:012d}-{uuid.uuid4().hex}"
        day = F.to_date(F.timestamp_millis("time")).cast("string")
        out.withColumn("date", day).write.partitionBy("date").parquet(f"{self.path(db, schema.name)}/{folder}")
        self._commit(db, schema.name, version, data={folder: schema.generation}, **({"streams": {stream[0]: stream[1]}} if stream else {}))
        return True

    def log(self, db: str, name: str, tombstones: bool = True, start: int = MIN_TIME, end: int = MAX_TIME) -> DataFrame:
        """Every stored row (time, columns, _seq, _row) in the present schema, without deleted ones: the view of aggregates.

        Days outside [start, end] aren't read; rows of the first and last day may lie outside.
        """
        schema = self.schema(db, name)
        if schema is None:
            raise SchemaError(f"unknown measurement {name!r}")
        state, base, out = self.state(db, name), self.path(db, name), None
        start = max(start, state.floor)
        for generation in sorted(set(state.data.values())):
            then = MeasurementSchema.from_json(self.get(f"{base}/_gen_{generation}.json"))
            folders = [f"{base}/{f}" for f, g in state.data.items() if g == generation]
            stored = T.StructType([*then.struct().fields, *(T.StructField(n, T.StringType()) for n in ("batch", "date"))])
            raw = self.spark.read.schema(stored).option("basePath", f"{base}/data").parquet(*folders)
            first, last = _day(start), _day(end)
            raw = raw.where(F.col("date") >= first) if first else raw
            raw = raw.where(F.col("date") <= last) if last else raw
            own = [(F.col(c.name) if then.get(c.name) else F.lit(None)).cast(c.spark).alias(c.name) for c in schema.columns]
            part = raw.select("time", *own, "_seq", "_row")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], schema.struct())
        out = out.where(F.col("time") >= state.floor) if state.floor > MIN_TIME else out
        return self._without_deleted(db, schema, out) if tombstones else out

    def rows(self, db: str, name: str, start: int = MIN_TIME, end: int = MAX_TIME) -> DataFrame:
        """One row for each series and time, each field with its last written value: the view of raw queries."""
        schema = self.schema(db, name)
        log = self.log(db, name, start=start, end=end)
        last = [F.max_by(c.name, F.when(F.col(c.name).isNotNull(), F.struct("_seq", "_row"))).alias(c.name) for c in schema.fields]
        out = log.groupBy(*schema.tags, "time").agg(*last)
        return out.select("time", *[c.name for c in schema.columns])

    # deletes
    def _tombstone_schema(self, schema: MeasurementSchema) -> T.StructType:
        return T.StructType([*(T.StructField(t, T.StringType()) for t in schema.tags), T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType())])

    def add_tombstones(self, db: str, schema: MeasurementSchema, series: DataFrame, start: int, end: int) -> int:
        """Hide [start, end] of the given series for good; returns how many tombstones that made (one a series and field)."""
        marks = series.select(*schema.tags).distinct().withColumn("_from", F.lit(start).cast("long")).withColumn("_to", F.lit(end).cast("long"))
        version = self._claim(db, schema.name)
        folder = f"tombstones/{version:012d}-{uuid.uuid4().hex}"
        path = f"{self.path(db, schema.name)}/{folder}"
        marks.write.parquet(path)
        n = self.spark.read.schema(marks.schema).parquet(path).count()
        self._commit(db, schema.name, version, tombstones=[folder] if n else [])
        return n * len(schema.fields)

    def tombstones(self, db: str, schema: MeasurementSchema) -> DataFrame | None:
        folders = [f"{self.path(db, schema.name)}/{f}" for f in self.state(db, schema.name).tombstones]
        return self.spark.read.schema(self._tombstone_schema(schema)).parquet(*folders) if folders else None

    def _without_deleted(self, db: str, schema: MeasurementSchema, df: DataFrame) -> DataFrame:
        """Few tombstones become literals of a filter; many a null-safe anti join on the tags."""
        marks = self.tombstones(db, schema)
        if marks is None:
            return df
        few = marks.limit(_MAX_INLINE + 1).collect()
        if len(few) <= _MAX_INLINE:
            for m in few:
                same = F.col("time").between(m["_from"], m["_to"])
                for t in schema.tags:
                    same = same & F.col(t).eqNullSafe(F.lit(m[t]))
                df = df.where(~same)
            return df
        marks = marks.toDF(*[f"__{c}" for c in marks.columns])
        match = F.col("time").between(F.col("___from"), F.col("___to"))
        for t in schema.tags:
            match = match & F.col(t).eqNullSafe(F.col(f"__{t}"))
        return df.join(marks, match, "left_anti")

    # upkeep
    def retain(self, db: str, name: str, ttl_ms: int, now_ms: int | None = None) -> int:
        """Drop points older than now - ttl: whole expired days as files, the rest by a floor that every scan applies.  Returns dropped days."""
        cutoff = (int(clock.time() * 1000) if now_ms is None else now_ms) - ttl_ms
        state, base, dropped = self.state(db, name), self.path(db, name), 0
        if cutoff > state.floor:
            self._commit(db, name, self._claim(db, name), floor=cutoff)
        for folder in state.data:
            for day in (d for d in self.listing(f"{base}/{folder}") if d.startswith("date=") and d[5].isdigit()):
                end = (datetime.date.fromisoformat(day[5:]) - datetime.date(1970, 1, 1)).days * _DAY + _DAY
                if end <= cutoff:
                    self.delete(f"{base}/{folder}/{day}")
                    dropped += 1
        return dropped

    def compact(self, db: str, name: str, files: int = 4) -> bool:
        """Merge size tiers: ``files`` or more folders of about one size (within a factor of ``files``) become one, in the present generation.

        With tombstones, all folders are merged, what they hide is left out, and they are dropped.
        """
        schema, base, state = self.schema(db, name), self.path(db, name), self.state(db, name)
        marks = state.tombstones
        tiers: dict[int, list[str]] = {}
        for folder in state.data:
            fs, p = self._fs(f"{base}/{folder}")
            size, tier = max(int(fs.getContentSummary(p).getLength()), 1), 0
            while size >= 1 << 20 and files > 1:
                size, tier = size // files, tier + 1
            tiers.setdefault(tier, []).append(folder)
        old = list(state.data) if marks else next((t for _, t in sorted(tiers.items()) if len(t) >= files), [])
        if not old:
            return False
        version = self._claim(db, name)
        folder = f"data/batch={version:012d}-{uuid.uuid4().hex}"
        day = F.to_date(F.timestamp_millis("time")).cast("string")
        # a day may go to several tasks: its hours, so that none holds more of it than that
        hour = F.floor(F.col("time") / (_DAY // 24))
        rows = self._only(db, name, old).withColumn("date", day).repartition("date", hour)
        rows.sortWithinPartitions("date", *schema.tags, "time", "_seq", "_row").write.partitionBy("date").parquet(f"{base}/{folder}")
        self._commit(db, name, version, data={folder: schema.generation}, remove=[*old, *marks])
        for gone in [*old, *marks]:
            self.delete(f"{base}/{gone}")
        return True

    def _only(self, db: str, name: str, folders: list[str]) -> DataFrame:
        """The view of aggregates over some folders."""
        whole, keep = self.state, set(folders)

        def some(db: str, name: str) -> State:
            state = whole(db, name)
            state.data = {k: v for k, v in state.data.items() if k in keep}
            return state

        view = Storage(self.spark, self.root)
        view.state = some
        return view.log(db, name)

    # databases
    def databases(self) -> list[str]:
        return sorted(n for n in self.listing(self.root) if not n.startswith("_"))

    def control(self) -> dict:
        path = f"{self.root}/_control.json"
        return json.loads(self.get(path)) if self.exists(path) else {"users": {}, "grants": [], "tokens": []}

    def save_control(self, state: dict) -> None:
        self.make(self.root)
        self.put(f"{self.root}/_control.json", json.dumps(state))
