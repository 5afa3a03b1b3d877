"""Streams: Line Protocol files into a measurement, tumbling buckets with a watermark, and stateful window functions."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator
from itertools import islice
from typing import IO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import windows as wf
from tessera.functions.series import Series
from tessera.schema import MeasurementSchema, SchemaError
from tessera.sources.ingest import as_measurement, parse_lines
from tessera.sources.storage import Storage


def line_protocol_stream(spark: SparkSession, folder: str, precision: str = "ms") -> DataFrame:
    """Points of the Line Protocol files that arrive in a folder."""
    return parse_lines(spark.readStream.text(folder), precision)


def into_measurement(points: DataFrame, storage: Storage, db: str, schema: MeasurementSchema, checkpoint: str) -> StreamingQuery:
    """Append a stream of parsed points to a stored measurement; late points are always taken.

    The stored log names each batch by the checkpoint and its number, so a batch
    that is run again after a failure is written once.  An existing schema has to
    hold the stream's columns.
    """
    known = storage.schema(db, schema.name)
    if known is None:
        storage.save_schema(db, schema)
    elif any(known.get(c.name) != c for c in schema.columns):
        raise SchemaError(f"the stream's columns don't fit measurement {schema.name!r}")
    schema = known or schema
    rows = as_measurement(points, schema)
    write = lambda df, batch: storage.append(db, schema, df, stream=(checkpoint, batch)) and None
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def tumbling(points: DataFrame, s: Series, field: str, width_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Count, sum, minimum and maximum by series and bucket, emitted once the watermark passes."""
    timed = points.withColumn("__ts", F.timestamp_millis(s.time)).withWatermark("__ts", delay)
    value = F.col(field).cast("double")
    grouped = timed.groupBy(F.window("__ts", f"{width_ms} milliseconds").alias("w"), *s.tags)
    out = grouped.agg(F.count(field).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.unix_millis("w.start").alias("time"), *s.tags, "count", "sum", "min", "max")


def _moving(n: int):
    def update(state: list, x: float | None) -> tuple[list, float | None]:
        state = [*state, x][-n:]
        have = [v for v in state if v is not None]
        return state, sum(have) / len(have) if len(state) == n and have else None

    return [], update


def _fold(combine):
    def update(state: list, x: float | None) -> tuple[list, float | None]:
        if x is not None:
            state = [combine(state[0], x)] if state else [x]
        return state, state[0] if state else None

    return [], update


def _holt(alpha: float, beta: float):
    def update(state: list, x: float | None) -> tuple[list, float | None]:
        if x is not None:
            if not state:
                return [x], x
            if len(state) == 1:
                state = [x, x - state[0]]
            else:
                level = alpha * x + (1 - alpha) * (state[0] + state[1])
                state = [level, beta * (level - state[0]) + (1 - beta) * state[1]]
        return state, sum(state) if state else None

    return [], update


def machine(name: str, *args: float):
    """(initial state, update) of a streamed window function; the state is a short list of numbers."""
    makers = {
        "cumulative_sum": lambda: _fold(lambda s, x: s + x), "running_sum": lambda: _fold(lambda s, x: s + x),
        "running_min": lambda: _fold(min), "running_max": lambda: _fold(max),
        "moving_average": lambda: _moving(int(args[0])), "ewma": lambda: _fold(lambda s, x: args[0] * x + (1 - args[0]) * s),
        "holt_winters": lambda: _holt(float(args[0]), float(args[1])),
    }
    if name not in makers:
        raise ValueError(f"{name!r} has no streamed form; those of {sorted(makers)} have")
    assert name in wf.NAMES
    return makers[name]()


#: Rows of a series and micro-batch that a task sorts in memory, and that it reads of a run at once.  More rows are sorted in runs on its disk.
_RUN, _READ = 1 << 18, 8192


def _spilled(rows: pd.DataFrame) -> IO[bytes]:
    run = tempfile.TemporaryFile()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(run, table.schema) as out:
        out.write_table(table, max_chunksize=_READ)
    run.seek(0)
    return run


def _rows(run: IO[bytes]) -> Iterator[tuple]:
    with run:
        for batch in pa.ipc.open_stream(run):
            yield from zip(*(c.to_pylist() for c in batch.columns))


def in_order(frames: Iterator[pd.DataFrame], by: list[str], *others: str) -> Iterator[pd.DataFrame]:
    """The rows sorted by some columns, rows alike in them as they come, in parts; in bounded memory."""
    runs, held, n = [], [], 0
    for frame in frames:
        held.append(frame[[*by, *others]])
        n += len(frame)
        if n >= _RUN:
            runs.append(_spilled(pd.concat(held).sort_values(by, kind="stable")))
            held, n = [], 0
    if held:
        rest = pd.concat(held).sort_values(by, kind="stable")
        if not runs:
            yield rest
            return
        runs.append(_spilled(rest))
    key = lambda row: [(x is None or x != x, x) for x in row[: len(by)]]
    rows = heapq.merge(*map(_rows, runs), key=key)
    while part := list(islice(rows, _READ)):
        yield pd.DataFrame(part, columns=[*by, *others])


def stateful_window(points: DataFrame, s: Series, field: str, name: str, *args: float) -> DataFrame:
    """(tags, time, value, out) of a window function whose state lives on over micro-batches, by series."""
    start, update = machine(name, *args)
    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"`{t}` {kinds[t]}" for t in s.tags), f"{s.time} long", "value double", "out double"])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [None if v != v else v for v in state.get[0]] if state.exists else list(start)
        for rows in in_order(frames, [s.time, *s.order], "value"):
            out = []
            for x in rows["value"].tolist():
                held, y = update(held, None if x != x or x is None else x)
                out.append(y)
            yield pd.DataFrame({t: [k] * len(out) for t, k in zip(s.tags, key)} | {s.time: rows[s.time].to_numpy(), "value": rows["value"].to_numpy(dtype=float), "out": pd.array(out, dtype="Float64").to_numpy(dtype=float, na_value=float("nan"))})
        state.update((held,))

    shaped = points.select(*s.tags, s.time, F.col(field).cast("double").alias("value"), *s.order)
    return shaped.groupBy(*s.tags).applyInPandasWithState(run, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)
