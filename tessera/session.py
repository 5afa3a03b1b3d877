"""A session: databases of measurements, SQL statements lowered to DataFrames, and user functions."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import aggregates as ag
from tessera.functions import scalars as sc
from tessera.functions import windows as wf
from tessera.functions.registry import UserFunctions
from tessera.functions.series import Series
from tessera.operators import tvf
from tessera.plans import sql as q
from tessera.plans.aggregate import BUCKET, Item, aggregate
from tessera.plans.sql import SqlError
from tessera.schema import FIELD_TYPES, Column, MeasurementSchema, SchemaError
from tessera.sources import ingest
from tessera.sources.storage import MAX_TIME, Storage

#: Scalar functions: least and most arguments, and how many of the last ones are plain numbers.
SCALARS = {
    "abs": (sc.abs_, 1, 1, 0), "round": (sc.round_, 1, 2, 1), "sqrt": (sc.sqrt, 1, 1, 0), "log": (sc.log, 1, 2, 0), "coalesce": (sc.coalesce, 1, 99, 0),
    "cosine_distance": (sc.cosine_distance, 2, 2, 0), "l2_distance": (sc.l2_distance, 2, 2, 0), "inner_product": (sc.inner_product, 2, 2, 0), "vector_norm": (sc.vector_norm, 1, 1, 0),
    "lat": (sc.lat, 1, 1, 0), "lon": (sc.lon, 1, 1, 0), "geo_distance": (sc.geo_distance, 2, 2, 0), "st_distance": (sc.geo_distance, 2, 2, 0), "geo_bearing": (sc.geo_bearing, 2, 2, 0),
    "geo_within": (sc.geo_within, 4, 4, 3), "st_within": (sc.geo_within, 4, 4, 3), "st_dwithin": (sc.geo_within, 4, 4, 3), "geo_bbox": (sc.geo_bbox, 5, 5, 4), "geo_speed": (sc.geo_speed, 3, 3, 0),
}
GEO_FILTERS = ("geo_within", "st_within", "st_dwithin", "geo_bbox")


@dataclass
class Source:
    """A measurement as two DataFrames: ``points`` for aggregates, ``rows`` (one a series and time) for raw queries."""

    schema: MeasurementSchema
    points: DataFrame
    rows: DataFrame
    order: tuple[str, ...] = ()

    @property
    def series(self) -> Series:
        return Series(tuple(self.schema.tags), order=self.order)


@dataclass
class Filters:
    row: SparkColumn | None
    geo: dict[str, SparkColumn]


class TimeSeriesSession:
    """strict=True raises where the dialect's definition does; otherwise OR, NOT, field filters, top-level arithmetic and grouping by tag work too."""

    def __init__(self, spark: SparkSession, root: str | None = None, database: str = "default", strict: bool = False, user_functions: bool = True) -> None:
        self.spark, self.strict, self.database = spark, strict, database
        self.storage = Storage(spark, root) if root else None
        self.functions = UserFunctions(user_functions)
        self._registered: dict[str, Source] = {}

    # measurements
    def register(self, name: str, df: DataFrame, tags: Sequence[str] = (), unique: bool = True, order: Sequence[str] = ()) -> None:
        """Make a DataFrame with a ``time`` column (ms) a measurement; tags are strings, other columns fields.

        unique: no (series, time) occurs twice, or all such rows count, so raw queries need no shuffle.
        order: columns that order rows of one series and time, for whatever depends on order.
        """
        kinds = {"double": "float64", "float": "float64", "bigint": "int64", "int": "int64", "smallint": "int64", "boolean": "boolean", "string": "string"}
        columns = []
        for n, t in df.dtypes:
            if n == "time":
                continue
            kind = "vector" if t.startswith("array") else "geopoint" if t.startswith("struct<lat:") else kinds[t]
            columns.append(Column(n, "tag" if n in tags else "field", kind, 0))
        schema = MeasurementSchema(name, tuple(columns))
        df = df.select("time", *[c.name for c in columns])
        last = [(F.max_by(c.name, F.when(F.col(c.name).isNotNull(), F.struct(*order))) if order else F.last(c.name, ignorenulls=True)).alias(c.name) for c in schema.fields]
        rows = df if unique else df.groupBy(*schema.tags, "time").agg(*last).select(df.columns)
        self._registered[name] = Source(schema, df, rows, tuple(order))

    def measurement(self, name: str, where: Any = None) -> Source:
        """A measurement; of a stored one, days outside the time range of ``where`` aren't read."""
        if name in self._registered:
            return self._registered[name]
        schema = self.storage.schema(self.database, name) if self.storage else None
        if schema is None:
            raise SchemaError(f"unknown measurement {name!r}")
        start, end, _ = self._time_range(where)
        return Source(schema, self.storage.log(self.database, name, start=start, end=end), self.storage.rows(self.database, name, start, end))

    def _need_storage(self) -> Storage:
        if self.storage is None:
            raise SqlError("this session has no warehouse root")
        return self.storage

    # statements
    def sql(self, text: str) -> DataFrame | int | None:
        """Run one statement: a DataFrame for queries, a count for writes, else None."""
        return self.execute(q.Parser(text).single())

    def script(self, text: str) -> list:
        return [self.execute(s) for s in q.Parser(text).script()]

    def execute(self, s: Any) -> DataFrame | int | None:
        if isinstance(s, q.Select):
            return self.select(s)
        if isinstance(s, q.Create):
            return self.create(s)
        if isinstance(s, q.Insert):
            schema = self._need_storage().schema(self.database, s.name)
            return self.write(ingest.rows_of_insert(s, schema))
        if isinstance(s, q.Delete):
            return self.remove(s)
        if isinstance(s, q.Show):
            return self.show(s)
        if isinstance(s, q.Database):
            store = self._need_storage()
            if s.action == "create":
                store.make(store.path(s.name, ""))
            elif s.action == "drop":
                store.delete(store.path(s.name, ""))
            else:
                self.database = s.name
            return None
        return self.account(s)

    def create(self, s: q.Create) -> None:
        store = self._need_storage()
        if store.schema(self.database, s.name):
            raise SchemaError(f"measurement {s.name!r} exists")
        columns = tuple(Column(n, role, FIELD_TYPES[kind], dim) for n, role, kind, dim, _ in s.columns)
        schema = MeasurementSchema(s.name, columns, 0, {"index": {n: o for n, *_, o in s.columns if o}})
        if not schema.fields:
            raise SchemaError("a measurement needs a field at least")
        store.save_schema(self.database, schema)

    def _evolve(self, schema: MeasurementSchema | None, p: ingest.Point) -> MeasurementSchema:
        schema = schema or MeasurementSchema(p.measurement)
        for t in p.tags:
            known = schema.get(t)
            if known is None:
                schema = schema.with_columns(Column(t, "tag"))
            elif known.role != "tag":
                raise SchemaError(f"{t!r} is a field, not a tag")
        for name, value in p.fields.items():
            kind, dim = self._kind(value)
            known = schema.get(name)
            if known is None:
                schema = schema.with_columns(Column(name, "field", kind, dim))
            elif known.role != "field":
                raise SchemaError(f"{name!r} is a tag, not a field")
            elif known.kind == "int64" and kind == "float64":
                schema = schema.promoted(name)
            elif (known.kind, kind) not in ((kind, kind), ("float64", "int64")):
                raise SchemaError(f"{name!r} is {known.kind}, not {kind}")
            elif kind == "vector" and known.dim and known.dim != dim:
                raise SchemaError(f"{name!r} takes vectors of {known.dim} numbers")
        return schema

    @staticmethod
    def _kind(value: Any) -> tuple[str, int]:
        if isinstance(value, q.Literal):
            return ("geopoint", 0) if value.kind == "point" else ("vector", len(value.value))
        return {bool: "boolean", int: "int64", float: "float64", str: "string"}[type(value)], 0

    def write(self, points: Iterable[ingest.Point]) -> int:
        """Append points of any measurements.  Points before one that doesn't fit stay written."""
        store = self._need_storage()
        schemas: dict[str, MeasurementSchema] = {}
        rows: dict[str, list[ingest.Point]] = {}
        before: dict[str, MeasurementSchema | None] = {}
        failure, n = None, 0
        for p in points:
            if p.measurement not in before:
                before[p.measurement] = schemas[p.measurement] = store.schema(self.database, p.measurement)
            try:
                schemas[p.measurement] = self._evolve(schemas[p.measurement], p)
            except SchemaError as e:
                failure = e
                break
            rows.setdefault(p.measurement, []).append(p)
            n += 1
        for name, own in rows.items():
            schema = schemas[name]
            if schema != before[name]:
                store.save_schema(self.database, schema)
            data = [(p.time, *(self._cell(c, p) for c in schema.columns), 0, i) for i, p in enumerate(own)]
            store.append(self.database, schema, self.spark.createDataFrame(data, schema.struct()))
        if failure:
            raise failure
        return n

    @staticmethod
    def _cell(c: Column, p: ingest.Point) -> Any:
        v = p.tags.get(c.name) if c.role == "tag" else p.fields.get(c.name)
        if isinstance(v, q.Literal):
            return list(v.value) if v.kind == "vector" else v.value
        return float(v) if c.kind == "float64" and v is not None else v

    def load(self, payload: str, measurement: str | None = None, precision: str = "ms", policy: str = "fail") -> tuple[int, int]:
        """(written, skipped) of a Line Protocol, JSON or VALUES payload."""
        points, skipped = ingest.parse_payload(payload, measurement, precision, policy, self._need_storage().schema(self.database, measurement) if measurement else None)
        return self.write(points), skipped

    def remove(self, s: q.Delete) -> int:
        store, source = self._need_storage(), self.measurement(s.name)
        start, end, rest = self._time_range(s.where)
        if start > end:
            raise SqlError("the time range is empty")
        self._check_where(s.where, source.schema, geo=False)
        series = store.log(self.database, s.name, tombstones=False)
        keep = self._condition(rest, source) if rest is not None else None
        return store.add_tombstones(self.database, source.schema, series.where(keep) if keep is not None else series, start, end)

    def show(self, s: q.Show) -> DataFrame:
        frame = self.spark.createDataFrame
        if s.what in ("measurements", "tables"):
            names = set(self._registered) | set(self.storage.names(self.database) if self.storage else ())
            return frame([(n,) for n in sorted(names)], "name string")
        if s.what == "describe":
            schema = self._registered[s.name].schema if s.name in self._registered else self._need_storage().schema(self.database, s.name)
            if schema is None:
                raise SchemaError(f"unknown measurement {s.name!r}")
            return frame([(c.name, c.role, c.shown) for c in schema.columns], "column_name string, column_type string, data_type string")
        if s.what == "databases":
            return frame([(n,) for n in self._need_storage().databases()], "name string")
        if s.what == "current_database":
            return frame([(self.database,)], "current_database string")
        state = self._need_storage().control()
        if s.what == "users":
            return frame([(u, v["superuser"]) for u, v in sorted(state["users"].items())], "name string, is_superuser boolean")
        if s.what == "grants":
            return frame([tuple(g) for g in state["grants"] if s.name in (None, g[0])], "user_name string, database string, permission string")
        return frame([(t["id"], t["user"]) for t in state["tokens"] if s.name in (None, t["user"])], "token_id string, user_name string")

    def account(self, s: q.Account) -> DataFrame | None:
        """Users, grants and tokens are rows of a small control file; passwords and tokens are stored as salted hashes."""
        store = self._need_storage()
        state, a = store.control(), s.args
        secret = lambda text: (salt := secrets.token_hex(8)) + ":" + hashlib.sha256((salt + text).encode()).hexdigest()
        if s.action == "create_user":
            if a["user"] in state["users"]:
                raise SqlError(f"user {a['user']!r} exists")
            state["users"][a["user"]] = {"password": secret(a["password"]), "superuser": a["superuser"] == "True"}
        elif s.action != "revoke_token" and a.get("user") not in state["users"]:
            raise SqlError(f"unknown user {a.get('user')!r}")
        elif s.action == "alter_user":
            state["users"][a["user"]]["password"] = secret(a["password"])
        elif s.action == "drop_user":
            del state["users"][a["user"]]
            state["grants"] = [g for g in state["grants"] if g[0] != a["user"]]
            state["tokens"] = [t for t in state["tokens"] if t["user"] != a["user"]]
        elif s.action == "grant":
            state["grants"] = [g for g in state["grants"] if g[:2] != [a["user"], a["database"]]] + [[a["user"], a["database"], a["right"]]]
        elif s.action == "revoke":
            state["grants"] = [g for g in state["grants"] if g[:2] != [a["user"], a["database"]]]
        elif s.action == "issue_token":
            token, ident = secrets.token_urlsafe(24), f"tok_{secrets.token_hex(4)}"
            state["tokens"].append({"id": ident, "user": a["user"], "hash": secret(token)})
            store.save_control(state)
            return self.spark.createDataFrame([(ident, token)], "token_id string, token string")
        elif s.action == "revoke_token":
            state["tokens"] = [t for t in state["tokens"] if t["id"] != a["token"]]
        store.save_control(state)
        return None

    # where
    def _conjuncts(self, e: Any) -> list[Any]:
        if e is None:
            return []
        return [*self._conjuncts(e.left), *self._conjuncts(e.right)] if isinstance(e, q.Binary) and e.op == "and" else [e]

    @staticmethod
    def _compare(e: Any) -> tuple[str, str, Any] | None:
        """(column, operator, literal) with the column on the left."""
        turn = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
        if isinstance(e, q.Binary) and e.op in ("=", "!=", "<", "<=", ">", ">="):
            neg = lambda x: q.Literal(-x.operand.value, x.operand.kind) if isinstance(x, q.Unary) and x.op == "-" and isinstance(x.operand, q.Literal) else x
            left, right = neg(e.left), neg(e.right)
            if isinstance(left, q.Name) and isinstance(right, q.Literal):
                return left.name, e.op, right
            if isinstance(right, q.Name) and isinstance(left, q.Literal):
                return right.name, turn.get(e.op, e.op), left
        return None

    def _time_range(self, where: Any) -> tuple[int, int, Any]:
        """(first, last, the other conjuncts) of a WHERE."""
        low, high, rest = -MAX_TIME, MAX_TIME, None
        for e in self._conjuncts(where):
            c = self._compare(e)
            if c and c[0].lower() == "time" and c[1] != "!=" and c[2].kind in ("int", "duration"):
                _, op, v = c
                low = max(low, v.value + (op == ">")) if op in (">", ">=", "=") else low
                high = min(high, v.value - (op == "<")) if op in ("<", "<=", "=") else high
            else:
                rest = e if rest is None else q.Binary("and", rest, e)
        return low, high, rest

    def _check_where(self, where: Any, schema: MeasurementSchema, geo: bool = True) -> None:
        """What the strict dialect doesn't allow in a WHERE."""
        seen: dict[str, str] = {}
        low, high, _ = self._time_range(where)
        if low > high:
            raise SqlError("the time range is empty")
        for e in self._conjuncts(where) if self.strict else []:
            if geo and isinstance(e, q.Call) and e.name in GEO_FILTERS:
                continue
            c = self._compare(e)
            if not c:
                raise SqlError("only AND of tag, time and geo conditions is allowed in WHERE")
            name, op, v = c
            if name.lower() == "time":
                if op == "!=" or v.kind != "int":
                    raise SqlError("time takes =, <, <=, > and >= with an integer")
                continue
            if schema.need(name).role != "tag" or op != "=" or v.kind != "string":
                raise SqlError(f"only tag = 'text' is allowed in WHERE, not {name} {op}")
            if seen.setdefault(name, v.value) != v.value:
                raise SqlError(f"{name} can't have two values")

    def _filters(self, where: Any, source: Source) -> Filters:
        self._check_where(where, source.schema)
        low, high, _ = self._time_range(where)
        out = Filters(None, {})
        conditions = []
        if low > -MAX_TIME:
            conditions.append(F.col("time") >= low)
        if high < MAX_TIME:
            conditions.append(F.col("time") <= high)
        for e in self._conjuncts(self._time_range(where)[2]):
            if isinstance(e, q.Call) and e.name in GEO_FILTERS and isinstance(e.args[0], q.Name):
                name = e.args[0].name
                test = self._scalar(e, source)
                out.geo[name] = out.geo[name] & test if name in out.geo else test
            else:
                conditions.append(self._condition(e, source))
        out.row = reduce(lambda a, b: a & b, conditions) if conditions else None
        return out

    def _condition(self, e: Any, source: Source) -> SparkColumn:
        if isinstance(e, q.Binary) and e.op in ("and", "or"):
            a, b = self._condition(e.left, source), self._condition(e.right, source)
            return a & b if e.op == "and" else a | b
        if isinstance(e, q.Unary) and e.op == "not":
            return ~self._condition(e.operand, source)
        if isinstance(e, q.Binary) and e.op in ("=", "!=", "<", "<=", ">", ">="):
            a, b = self._scalar(e.left, source), self._scalar(e.right, source)
            return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]
        return self._scalar(e, source)

    # expressions
    @staticmethod
    def _constant(e: Any) -> Any:
        if isinstance(e, q.Unary) and e.op == "-":
            return -TimeSeriesSession._constant(e.operand)
        if not isinstance(e, q.Literal):
            raise SqlError("a literal is needed here")
        return e.value

    def _scalar(self, e: Any, source: Source) -> SparkColumn:
        if isinstance(e, q.Literal):
            if e.kind == "vector":
                return F.array(*(F.lit(x) for x in e.value))
            return sc.point(*e.value) if e.kind == "point" else F.lit(e.value)
        if isinstance(e, q.Name):
            if e.name.lower() == "time":
                return F.col("time")
            source.schema.need(e.name)
            return F.col(e.name)
        if isinstance(e, q.Unary):
            return -self._scalar(e.operand, source).cast("double")
        if isinstance(e, q.Binary) and e.op in "+-*/%":
            a, b = (self._scalar(x, source).cast("double") for x in (e.left, e.right))
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": F.when(b != 0, a % F.when(b != 0, b))}[e.op]
        if isinstance(e, q.Call):
            user = self.functions.scalar.get(e.name)
            if user:
                fn, least, most = user
                if not least <= len(e.args) <= most:
                    raise SqlError(f"{e.name} takes {least} to {most} arguments")
                return fn(*(self._scalar(a, source) for a in e.args))
            if e.name not in SCALARS:
                raise SqlError(f"unknown function {e.name!r}")
            fn, least, most, plain = SCALARS[e.name]
            if not least <= len(e.args) <= most:
                raise SqlError(f"{e.name} takes {least} to {most} arguments")
            n = len(e.args) - (plain if len(e.args) == most else 0)
            args = [self._scalar(a, source) for a in e.args[:n]]
            if self.strict and e.name != "coalesce":
                args = [F.coalesce(a, F.raise_error(F.lit(f"{e.name}: argument is NULL")).cast("double")) if isinstance(x, q.Name) and source.schema.get(x.name) and source.schema.get(x.name).numeric else a for a, x in zip(args, e.args)]
            return fn(*args, *(self._constant(a) for a in e.args[n:]))
        raise SqlError("this expression isn't supported here")

    @staticmethod
    def _names(e: Any) -> list[str]:
        if isinstance(e, q.Name):
            return [e.name]
        parts = e.args if isinstance(e, q.Call) else (e.operand,) if isinstance(e, q.Unary) else (e.left, e.right) if isinstance(e, q.Binary) else ()
        return [n for p in parts for n in TimeSeriesSession._names(p)]

    @staticmethod
    def _title(e: Any) -> str:
        if isinstance(e, q.Name):
            return e.name
        if isinstance(e, q.Literal):
            return e.text
        if isinstance(e, q.Call):
            if len(e.args) == 1 and isinstance(e.args[0], (q.Name, q.Literal, q.Star)):
                return f"{e.name}({'*' if isinstance(e.args[0], q.Star) else TimeSeriesSession._title(e.args[0])})"
            return e.name
        return "expr"

    def _is_aggregate(self, e: Any) -> bool:
        return isinstance(e, q.Call) and (e.name in self.functions.aggregate or e.name in ag.NAMES)

    def _is_window(self, e: Any) -> bool:
        return isinstance(e, q.Call) and (e.name in self.functions.window or e.name in wf.NAMES)

    # select
    def select(self, s: q.Select) -> DataFrame:
        if s.tvf:
            return self._finish(self._table_function(s), s)
        if s.source is None:
            if len(s.items) == 1 and isinstance(s.items[0][0], q.Call) and s.items[0][0].name in ("current_database", "database"):
                return self.spark.createDataFrame([(self.database,)], f"{s.items[0][1] or s.items[0][0].name} string")
            raise SqlError("FROM is missing")
        source = self.measurement(s.source, s.where)
        self._check_aliases(s)
        aggregates = [self._is_aggregate(e) for e, _ in s.items]
        if any(aggregates):
            if not all(aggregates) and (self.strict or not s.group):
                raise SqlError("aggregates and other columns can't be mixed")
            return self._finish(self._aggregate(s, source), s)
        if s.group:
            raise SqlError("GROUP BY needs an aggregate")
        return self._finish(self._raw(s, source), s)

    def _check_aliases(self, s: q.Select) -> None:
        def walk(e: Any) -> None:
            if isinstance(e, q.Name) and e.qualifier and e.qualifier not in ((s.alias,) if s.alias else (s.source,)):
                raise SqlError(f"unknown alias {e.qualifier!r}")
            for p in e.args if isinstance(e, q.Call) else (e.operand,) if isinstance(e, q.Unary) else (e.left, e.right) if isinstance(e, q.Binary) else ():
                walk(p)

        for e, _ in s.items:
            walk(e)
        if s.where is not None:
            walk(s.where)

    def _finish(self, df: DataFrame, s: q.Select) -> DataFrame:
        if s.order:
            name, down = s.order
            if name.lower() != "time" and self.strict:
                raise SqlError("only ORDER BY time is allowed")
            if name not in df.columns and name.lower() != "time" or (name.lower() == "time" and "time" not in df.columns):
                raise SqlError(f"ORDER BY {name} needs that column in the result")
            df = df.orderBy(F.col(name).desc() if down else F.col(name).asc())
        if s.offset:
            df = df.offset(s.offset)
        return df.limit(s.limit) if s.limit is not None else df

    def _raw(self, s: q.Select, source: Source) -> DataFrame:
        schema, series = source.schema, source.series
        filters = self._filters(s.where, source)
        df = source.rows.where(filters.row) if filters.row is not None else source.rows
        for name, test in filters.geo.items():
            df = df.withColumn(name, F.when(test, F.col(name)))
        items: list[tuple[Any, str]] = []
        for e, alias in s.items:
            if isinstance(e, q.Star):
                items += [(q.Name(n), n) for n in ("time", *[c.name for c in schema.columns])]
            else:
                items.append((e, alias or self._title(e)))
        used = list(dict.fromkeys(n for e, _ in items for n in self._names(e)))
        for n in used:
            if n.lower() != "time":
                schema.need(n)
        fields = [n for n in used if schema.get(n) and schema.get(n).role == "field"] or [schema.fields[0].name]
        df = df.where(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in fields]))
        outputs = []
        for i, (e, title) in enumerate(items):
            if self._is_window(e):
                column = self._field_argument(e, schema, wf.ANY_TYPE)
                args = [self._constant(a) for a in e.args[1:]]
                own = self.functions.window.get(e.name)
                df = own(df, series, f"__w{i}", F.col(column.name), *args) if own else wf.with_window(df, series, f"__w{i}", e.name, F.col(column.name), *args)
                outputs.append(F.col(f"__w{i}").alias(title))
            elif isinstance(e, (q.Name, q.Literal, q.Call)) or not self.strict:
                outputs.append(self._scalar(e, source).alias(title))
            else:
                raise SqlError("arithmetic is allowed inside function arguments only")
        return df.select(*outputs)

    def _field_argument(self, e: q.Call, schema: MeasurementSchema, any_type: Sequence[str] = ()) -> Column:
        if not e.args or not isinstance(e.args[0], q.Name):
            raise SqlError(f"{e.name} takes a field first")
        c = schema.need(e.args[0].name)
        geo = e.name.startswith("trajectory_")
        if c.role != "field" or not (c.numeric or e.name in any_type or (c.kind == "geopoint" and geo) or (c.kind == "vector" and e.name == "centroid") or e.name in self.functions.aggregate):
            raise SqlError(f"{e.name} doesn't take {c.name}")
        return c

    def _aggregate(self, s: q.Select, source: Source) -> DataFrame:
        schema, width, keys = source.schema, None, []
        for g in s.group:
            if isinstance(g, q.Call) and g.name == "time" and len(g.args) == 1 and isinstance(g.args[0], q.Literal):
                width = int(g.args[0].value)
                if width <= 0:
                    raise SqlError("the bucket must be longer than 0")
            elif isinstance(g, q.Name) and not self.strict:
                schema.need(g.name)
                keys.append(g.name)
            else:
                raise SqlError("GROUP BY takes time(duration) only")
        if len(s.group) > 1 and self.strict:
            raise SqlError("GROUP BY takes one item")
        filters = self._filters(s.where, source)
        points = source.points.where(filters.row) if filters.row is not None else source.points
        for name, test in filters.geo.items():
            points = points.withColumn(name, F.when(test, F.col(name)))
        numeric = [c.name for c in schema.fields if c.numeric]
        items, titles, needed = [], [], []
        ordered = False
        for i, (e, alias) in enumerate(s.items):
            if not self._is_aggregate(e):
                if not (isinstance(e, q.Name) and e.name in keys):
                    raise SqlError("a column beside aggregates must be in GROUP BY")
                titles.append((F.col(e.name), alias or e.name))
                continue
            out = f"__a{i}"
            if e.name == "count" and e.args and (isinstance(e.args[0], q.Star) or e.args[0] == q.Literal(1, "int")):
                total = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("long") for n in numeric])
                items.append(Item("sum", total, (), out))
                titles.append((F.col(out).cast("long"), alias or self._title(e)))
                needed += [F.col(n) for n in numeric]
                continue
            column = self._field_argument(e, schema, ("count",))
            args = [None if isinstance(a, q.Name) else self._constant(a) for a in e.args[1:]]
            ordered |= e.name in ("first", "last", "pid", "pid_estimate") or e.name.startswith("trajectory_speed") or e.name == "trajectory_length"
            user = self.functions.aggregate.get(e.name)
            dim = column.dim or (self._dimension(source, column.name) if e.name == "centroid" else 0)
            items.append(Item("user:" + e.name if user else e.name, F.col(column.name), tuple(a for a in args if a is not None or e.name == "pid_estimate"), out, dim))
            titles.append((F.col(out), alias or self._title(e)))
            needed.append(F.col(column.name))
        if ordered and points.select(*schema.tags).distinct().limit(2).count() > 1 if schema.tags and ordered and not set(schema.tags) <= set(keys) else False:
            raise SqlError("an aggregate that depends on order needs one series; filter the tags")
        plain = [i for i in items if not i.name.startswith("user:")]
        own = [i for i in items if i.name.startswith("user:")]
        if keys or own:
            return self._grouped(points, plain, own, needed, keys, width, titles)
        out = aggregate(points, plain, needed, "time", width, source.order)
        return out.orderBy(BUCKET).select(*[c.alias(t) for c, t in titles])

    def _grouped(self, points: DataFrame, plain: list[Item], own: list[Item], needed: list, keys: list[str], width: int | None, titles: list) -> DataFrame:
        """Grouping by tags, and user aggregates: functions that a single groupBy can hold.

        User aggregates have a groupBy of their own: one of distinct values would make the buffers of the others
        (32,768 registers of distinct_count) once for each value.
        """
        from tessera.plans.aggregate import bucket, simple

        live = points.where(reduce(lambda a, b: a | b, [c.isNotNull() for c in needed]))
        live = live.withColumn(BUCKET, bucket("time", width) if width else F.lit(0).cast("long"))
        groups = [*keys, BUCKET]
        made = [[simple(i, "time").alias(i.out) for i in plain], [self.functions.aggregate[i.name[5:]](i.field, *i.args).alias(i.out) for i in own]]
        out, *more = (live.groupBy(*groups).agg(*m) for m in made if m)
        for other in more:
            other = other.withColumnsRenamed({k: f"__{i}" for i, k in enumerate(groups)})
            out = out.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(groups)]))
        return out.orderBy(*keys, BUCKET).select(*[c.alias(t) for c, t in titles])

    @staticmethod
    def _dimension(source: Source, name: str) -> int:
        row = source.points.where(F.col(name).isNotNull()).select(F.size(name)).first()
        return row[0] if row else 0

    def _table_function(self, s: q.Select) -> DataFrame:
        call = s.tvf
        if len(s.items) != 1 or not isinstance(s.items[0][0], q.Star):
            raise SqlError("table-valued functions allow SELECT * only")
        if call.name in self.functions.table and call.name != "forecast":
            return self.functions.table[call.name](self, *[a.name if isinstance(a, q.Name) else self._constant(a) for a in call.args])
        if call.name not in ("forecast", "knn"):
            raise SqlError(f"unknown table-valued function {call.name!r}")
        if len(call.args) < 4 - (call.name == "forecast") or not all(isinstance(a, q.Name) for a in call.args[:2]):
            raise SqlError(f"{call.name} takes a measurement, a column, and more")
        source = self.measurement(call.args[0].name, s.where)
        column = source.schema.need(call.args[1].name)
        filters = self._filters(s.where, source)
        rows = source.rows.where(filters.row) if filters.row is not None else source.rows
        args = [self._constant(a) for a in call.args[2:]]
        if call.name == "forecast":
            if not column.numeric:
                raise SqlError("forecast takes a numeric field")
            return tvf.forecast(rows, source.series, column.name, *args)
        if column.kind != "vector" or (column.dim and column.dim != len(args[0])):
            raise SqlError("knn takes a vector field and a query of its dimension")
        others = [c.name for c in source.schema.fields]
        return tvf.knn(rows, source.series, column.name, *args[:2], *(args[2:] or ["cosine"]), others=others)

    # programmatic interface
    def aggregate_series(self, name: str, field: str, function: str, bucket_ms: int = 0, start: int = -MAX_TIME, end: int = MAX_TIME) -> DataFrame:
        """(tags, start, end_exclusive, count, value) of one aggregate for every series."""
        from tessera.plans.aggregate import bucket, simple

        source = self.measurement(name)
        points = source.points.where(F.col("time").between(start, end) & F.col(field).isNotNull())
        keyed = points.withColumn(BUCKET, bucket("time", bucket_ms) if bucket_ms else F.lit(None).cast("long"))
        out = keyed.groupBy(*source.schema.tags, BUCKET).agg(F.min("time").alias("__first"), F.max("time").alias("__last"), F.count(field).alias("count"), simple(Item(function, F.col(field)), "time").cast("double").alias("value"))
        first = F.coalesce(BUCKET, F.lit(start) if start > -MAX_TIME else F.col("__first"))
        last = F.col(BUCKET) + bucket_ms if bucket_ms else (F.lit(end + 1) if end < MAX_TIME else F.col("__last") + 1)
        return out.select(*source.schema.tags, first.alias("start"), last.alias("end_exclusive"), "count", "value")

    def explain(self, text: str) -> str:
        """The physical plan of a query."""
        df = self.sql(text)
        return df._jdf.queryExecution().explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
