"""Measurement schemas: string tags, typed sparse fields, and a millisecond ``time``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

#: Field types by their SQL name (fixed values of the dialect).
FIELD_TYPES = {"FLOAT": "float64", "INT": "int64", "BOOL": "boolean", "STRING": "string", "VECTOR": "vector", "GEOPOINT": "geopoint"}
NUMERIC = ("float64", "int64", "boolean")
POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


class SchemaError(ValueError):
    """A statement or payload that doesn't fit a measurement's schema."""


@dataclass(frozen=True)
class Column:
    name: str
    role: str  # "tag" or "field"
    kind: str = "string"  # a value of FIELD_TYPES
    dim: int = 0

    @property
    def spark(self) -> T.DataType:
        return {"float64": T.DoubleType(), "int64": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType(), "vector": T.ArrayType(T.FloatType()), "geopoint": POINT}[self.kind]

    @property
    def shown(self) -> str:
        return f"vector({self.dim})" if self.kind == "vector" else self.kind

    @property
    def numeric(self) -> bool:
        return self.role == "field" and self.kind in NUMERIC


@dataclass(frozen=True)
class MeasurementSchema:
    name: str
    columns: tuple[Column, ...] = ()
    generation: int = 0
    options: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        check_name(self.name, 255)
        seen: set[str] = set()
        for c in self.columns:
            check_name(c.name)
            if c.name.lower() == "time":
                raise SchemaError("'time' is reserved")
            if c.name in seen:
                raise SchemaError(f"column {c.name!r} is declared twice")
            seen.add(c.name)

    @property
    def tags(self) -> list[str]:
        return [c.name for c in self.columns if c.role == "tag"]

    @property
    def fields(self) -> list[Column]:
        return [c for c in self.columns if c.role == "field"]

    def get(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def need(self, name: str) -> Column:
        found = self.get(name)
        if found is None:
            raise SchemaError(f"unknown column {name!r} of measurement {self.name!r}")
        return found

    def with_columns(self, *more: Column) -> MeasurementSchema:
        return replace(self, columns=(*self.columns, *more))

    def promoted(self, name: str) -> MeasurementSchema:
        """INT column to FLOAT; a new generation of files begins."""
        return replace(self, columns=tuple(replace(c, kind="float64") if c.name == name else c for c in self.columns), generation=self.generation + 1)

    def struct(self, seq: bool = True) -> T.StructType:
        own = [T.StructField(c.name, c.spark, True, {"role": c.role, **({"dim": c.dim} if c.dim else {})}) for c in self.columns]
        return T.StructType([T.StructField("time", T.LongType()), *own, *([T.StructField(n, T.LongType()) for n in ("_seq", "_row")] if seq else [])])

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "generation": self.generation, "options": self.options, "columns": [[c.name, c.role, c.kind, c.dim] for c in self.columns]})

    @staticmethod
    def from_json(text: str) -> MeasurementSchema:
        raw = json.loads(text)
        return MeasurementSchema(raw["name"], tuple(Column(*c) for c in raw["columns"]), raw["generation"], raw.get("options", {}))


def check_name(name: str, longest: int = 1 << 20) -> None:
    if not name or not name.strip() or len(name) > longest or any(ch in name for ch in ',=\n\r\t"'):
        raise SchemaError(f"bad name {name!r}")
