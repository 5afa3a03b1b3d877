"""Readers of point payloads: Line Protocol, JSON points, bulk VALUES; and the sniffing of a payload's kind.

A parsed point is (measurement, time in ms, tags, fields).  The parsers are plain
Python functions; ``read_line_protocol`` runs one over text files of any size in
parallel, with errors in a column instead of exceptions.
"""

from __future__ import annotations

import json
import re
import time as clock
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.sql import Insert, Literal, Parser, SqlError
from tessera.schema import MeasurementSchema, check_name


class IngestError(ValueError):
    """A payload that can't be read."""


@dataclass
class Point:
    measurement: str
    time: int
    tags: dict[str, str] = field(default_factory=dict)
    fields: dict[str, Any] = field(default_factory=dict)


#: Fixed values of Line Protocol: the spellings of booleans.
TRUE, FALSE = ("t", "T", "true", "True", "TRUE"), ("f", "F", "false", "False", "FALSE")
_SCALE = {"ns": (1, 1_000_000), "us": (1, 1000), "u": (1, 1000), "ms": (1, 1), "s": (1000, 1)}


def to_ms(value: int, precision: str) -> int:
    """ns and us are truncated towards zero, s are multiplied."""
    if precision not in _SCALE:
        raise IngestError(f"unknown precision {precision!r}")
    times, parts = _SCALE[precision]
    return int(value) * times if parts == 1 else int(abs(value) // parts) * (1 if value >= 0 else -1)


def _pieces(text: str, stop: str) -> list[str]:
    """Split at unescaped, unquoted characters of ``stop``."""
    out, part, quoted, i = [], [], False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            part.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        if c in stop and not quoted:
            out.append("".join(part))
            part = []
        else:
            part.append(c)
        i += 1
    return [*out, "".join(part)]


def _plain(text: str) -> str:
    return re.sub(r"\\([,= \\\"])", r"\1", text)


def _pair(text: str) -> tuple[str, str]:
    parts = _pieces(text, "=")
    if len(parts) < 2 or not parts[0]:
        raise IngestError(f"expected key=value, found {text!r}")
    return _plain(parts[0]), "=".join(parts[1:])


def _field(text: str) -> Any:
    if len(text) > 1 and text[0] == '"' and text[-1] == '"':
        return re.sub(r'\\(["\\])', r"\1", text[1:-1])
    if text in TRUE or text in FALSE:
        return text in TRUE
    try:
        if text.endswith("i"):
            return int(text[:-1])
        return float(text)
    except ValueError:
        raise IngestError(f"bad field value {text!r}") from None


def parse_line(line: str, precision: str = "ms", measurement: str | None = None, now: int | None = None) -> Point | None:
    """One line; None for blank lines and comments.  A given measurement replaces the line's."""
    line = line.strip("\r\n ")
    if not line or line[0] == "#":
        return None
    parts = [p for p in _pieces(line, " ") if p]
    if not 2 <= len(parts) <= 3:
        raise IngestError(f"expected 2 or 3 parts, found {len(parts)}")
    name, *tags = _pieces(parts[0], ",")
    point = Point(measurement or _plain(name), 0, {k: _plain(v) for k, v in map(_pair, tags)}, {k: _field(v) for k, v in map(_pair, _pieces(parts[1], ","))})
    check_name(point.measurement, 255)
    if len(parts) == 3:
        try:
            point.time = to_ms(int(parts[2]), precision)
        except ValueError:
            raise IngestError(f"bad timestamp {parts[2]!r}") from None
    else:
        point.time = int(clock.time() * 1000) if now is None else now
    return point


def _json_value(v: Any) -> Any:
    if v is None or isinstance(v, (dict, list)):
        raise IngestError("fields must be numbers, booleans or strings")
    return v


def parse_json_points(text: str, measurement: str | None = None, now: int | None = None) -> list[Point]:
    try:
        raw = json.loads(text)
        precision, default = raw.get("precision", "ms"), measurement or raw.get("m") or raw.get("measurement")
        points = raw["points"]
    except (ValueError, KeyError, AttributeError) as e:
        raise IngestError(f"bad JSON payload: {e}") from None
    out = []
    for p in points:
        at = next((p[k] for k in ("t", "time", "timestamp") if k in p), None)
        name = measurement or p.get("m") or p.get("measurement") or default
        if not name or not p.get("fields"):
            raise IngestError("a point needs a measurement and a field")
        out.append(Point(name, to_ms(at, precision) if at is not None else int(clock.time() * 1000) if now is None else now, {k: str(v) for k, v in p.get("tags", {}).items()}, {k: _json_value(v) for k, v in p["fields"].items()}))
    return out


def rows_of_insert(statement: Insert, schema: MeasurementSchema | None, now: int | None = None) -> list[Point]:
    """Points of an INSERT; unknown columns whose values are all strings are tags, others fields."""
    strings = {c: all(r[i].kind == "string" for r in statement.rows) for i, c in enumerate(statement.columns)}
    out = []
    for row in statement.rows:
        p = Point(statement.name, int(clock.time() * 1000) if now is None else now)
        for c, v in zip(statement.columns, row, strict=True):
            if c.lower() == "time":
                if v.kind != "int" or v.value < 0:
                    raise SqlError("time must be an integer of 0 at least")
                p.time = v.value
                continue
            if v.kind == "null":
                raise SqlError(f"{c}: NULL can't be written")
            known = schema.get(c) if schema else None
            tag = known.role == "tag" if known else strings[c]
            if tag and v.kind != "string":
                raise SqlError(f"tag {c} must be a string")
            (p.tags if tag else p.fields)[c] = v if isinstance(v, Literal) and v.kind in ("vector", "point") else v.value
        if not p.fields:
            raise SqlError("a row needs a field at least")
        out.append(p)
    return out


def sniff(payload: str) -> str:
    """json, values or lp."""
    head = payload.lstrip("﻿ \t\r\n")
    return "json" if head[:1] == "{" else "values" if re.match(r"(?i)insert\b", head) else "lp"


def parse_payload(payload: str, measurement: str | None = None, precision: str = "ms", policy: str = "fail", schema: MeasurementSchema | None = None) -> tuple[list[Point], int]:
    """(points, skipped) of a payload of any kind; policy "skip" counts bad lines or points instead of raising."""
    kind = sniff(payload)
    if kind == "json":
        return parse_json_points(payload, measurement), 0
    if kind == "values":
        statement = Parser(payload).single()
        if not isinstance(statement, Insert):
            raise IngestError("expected INSERT")
        statement.name = measurement or statement.name
        return rows_of_insert(statement, schema), 0
    lines = payload.split("\n")
    first = lines[0].strip()
    if measurement is None and first and re.fullmatch(r"[\w.-]+", first):  # a first line that only names the measurement
        measurement, lines = first, lines[1:]
    out, skipped = [], 0
    for line in lines:
        try:
            p = parse_line(line, precision, measurement)
        except ValueError:
            if policy == "fail":
                raise
            skipped += 1
            continue
        if p:
            out.append(p)
    return out, skipped


POINT_SCHEMA = "measurement string, time long, tags map<string,string>, doubles map<string,double>, longs map<string,long>, booleans map<string,boolean>, strings map<string,string>, error string"


_KINDS = (("doubles", float, pa.float64()), ("longs", int, pa.int64()), ("booleans", bool, pa.bool_()), ("strings", str, pa.string()))
_ARROW = pa.schema([("measurement", pa.string()), ("time", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), *((n, pa.map_(pa.string(), t)) for n, _, t in _KINDS), ("error", pa.string())])


def _batch(points: list[Point], errors: list[str]) -> pa.RecordBatch:
    none = [None] * len(errors)
    columns: list[list] = [[p.measurement for p in points] + none, [p.time for p in points] + none, [list(p.tags.items()) for p in points] + none]
    for _, kind, _ in _KINDS:
        columns.append([[(k, v) for k, v in p.fields.items() if type(v) is kind] for p in points] + none)
    columns.append([None] * len(points) + errors)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


#: Points or errors that a task holds before it hands them on; a text that holds more is handed on in parts.
_HELD = 4096


def parsed_batches(batches: Iterator[pa.RecordBatch], parse: Callable[[str], list[Point]]) -> Iterator[pa.RecordBatch]:
    points: list[Point] = []
    errors: list[str] = []
    for batch in batches:
        for text in batch.column(0):
            try:
                points += parse(text.as_py())
            except ValueError as e:
                errors.append(str(e))
            if len(points) + len(errors) >= _HELD:
                for i in range(0, len(points), _HELD):
                    yield _batch(points[i : i + _HELD], [])
                yield _batch([], errors)
                points, errors = [], []
    yield _batch(points, errors)


def _parsed(texts: DataFrame, parse: Callable[[str], list[Point]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parsed_batches(batches, parse)

    return texts.select("value").mapInArrow(run, POINT_SCHEMA)


def parse_lines(lines: DataFrame, precision: str = "ms") -> DataFrame:
    """Points of a DataFrame of text lines (column ``value``, batch or stream), bad lines with ``error``."""
    return _parsed(lines, lambda line: [p for p in (parse_line(line, precision),) if p])


def read_line_protocol(spark: SparkSession, path: str, precision: str = "ms") -> DataFrame:
    return parse_lines(spark.read.text(path), precision)


def as_measurement(points: DataFrame, schema: MeasurementSchema) -> DataFrame:
    """Rows of one measurement, in the columns of its schema, from parsed points."""
    source = {"float64": "doubles", "int64": "longs", "boolean": "booleans", "string": "strings"}

    def column(c):
        if c.role == "tag":
            return F.col("tags")[c.name].alias(c.name)
        own = F.col(source[c.kind])[c.name]
        return (F.coalesce(own, F.col("longs")[c.name].cast("double")) if c.kind == "float64" else own).alias(c.name)

    return points.where(F.col("error").isNull() & (F.col("measurement") == schema.name)).select("time", *[column(c) for c in schema.columns])


def parse_json(payloads: DataFrame) -> DataFrame:
    """Points of a DataFrame of JSON payloads (column ``value``), in the same layout as ``parse_lines``; a bad payload is one row with ``error``."""
    return _parsed(payloads, parse_json_points)


def read_json_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of JSON files (one payload a file)."""
    return parse_json(spark.read.text(path, wholetext=True))


def parse_values(statements: DataFrame, schema: MeasurementSchema | None = None) -> DataFrame:
    """Points of a DataFrame of INSERT statements (column ``value``), in the same layout as ``parse_lines``; a bad statement is one row with ``error``."""
    return _parsed(statements, lambda text: rows_of_insert(Parser(text).single(), schema))
