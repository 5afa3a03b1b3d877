"""The SQL dialect: tokens, syntax tree and a recursive-descent parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class SqlError(ValueError):
    """Text that isn't a statement of the dialect, or one that the engine can't run."""


_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|//[^\n]*|/\*.*?\*/)
      | (?P<duration>\d+(?:ns|us|ms|s|m|h|d)\b)
      | (?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*")
      | (?P<name>[^\W\d]\w*)
      | (?P<op><=>|<->|<\#>|<=|>=|!=|<>|[=<>+\-*/%(),.;\[\]])""",
    re.X | re.S,
)
#: Milliseconds of a duration unit; ns and us are divided and truncated.
_UNIT = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokenize(sql: str) -> list[Token]:
    sql = re.sub(r"(?im)^[ \t]*REM\b[^\n]*", "", sql)
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m.group(), at))
        at = m.end()
    return [*out, Token("end", "", at)]


# expressions
@dataclass(frozen=True)
class Literal:
    value: Any
    kind: str  # int, float, string, bool, null, vector, point, duration

    @property
    def text(self) -> str:
        return {None: "NULL", True: "TRUE", False: "FALSE"}.get(self.value, str(self.value)) if self.kind in ("null", "bool") else str(self.value)


@dataclass(frozen=True)
class Name:
    name: str
    qualifier: str | None = None


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


# statements
@dataclass
class Select:
    items: list[tuple[Any, str | None]]
    source: str | None = None
    tvf: Call | None = None
    alias: str | None = None
    where: Any = None
    group: list[Any] = field(default_factory=list)
    order: tuple[str, bool] | None = None
    limit: int | None = None
    offset: int = 0


@dataclass
class Create:
    name: str
    columns: list[tuple[str, str, str, int, dict]]  # name, role, kind, dim, options


@dataclass
class Insert:
    name: str
    columns: list[str]
    rows: list[list[Literal]]


@dataclass
class Delete:
    name: str
    where: Any


@dataclass
class Show:
    what: str
    name: str | None = None


@dataclass
class Database:
    action: str  # create, drop, use
    name: str


@dataclass
class Account:
    """User, grant and token statements of the control plane."""

    action: str
    args: dict[str, str]


_VECTOR_OPS = {"<=>": "cosine_distance", "<->": "l2_distance", "<#>": "inner_product"}


class Parser:
    def __init__(self, sql: str) -> None:
        self.tokens, self.i = tokenize(sql), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def word(self, *words: str) -> bool:
        """Take a run of keywords if it comes next."""
        for k, w in enumerate(words):
            t = self.tokens[min(self.i + k, len(self.tokens) - 1)]
            if t.kind != "name" or t.text.upper() != w:
                return False
        self.i += len(words)
        return True

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.i += 1
            return True
        return False

    def fail(self, wanted: str) -> None:
        raise SqlError(f"expected {wanted} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def need_op(self, text: str) -> None:
        if not self.op(text):
            self.fail(repr(text))

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            self.fail(" ".join(words))

    def identifier(self) -> str:
        t = self.now
        if t.kind == "name":
            self.i += 1
            return t.text
        if t.kind == "quoted":
            self.i += 1
            return t.text[1:-1].replace('""', '"')
        self.fail("a name")

    def integer(self) -> int:
        t = self.now
        if t.kind != "number" or not t.text.isdigit():
            self.fail("an integer")
        self.i += 1
        return int(t.text)

    def string(self) -> str:
        t = self.now
        if t.kind != "string":
            self.fail("a string")
        self.i += 1
        return t.text[1:-1].replace("''", "'")

    # statements
    def script(self) -> list:
        out = []
        while self.now.kind != "end":
            if not self.op(";"):
                out.append(self.statement())
                if self.now.kind != "end":
                    self.need_op(";")
        return out

    def single(self) -> Any:
        found = self.script()
        if len(found) != 1:
            raise SqlError("one statement is needed")
        return found[0]

    def statement(self) -> Any:
        if self.word("SELECT"):
            return self.select()
        if self.word("CREATE", "MEASUREMENT"):
            return self.create()
        if self.word("INSERT", "INTO"):
            return self.insert()
        if self.word("DELETE", "FROM"):
            name = self.identifier()
            self.need_word("WHERE")
            return Delete(name, self.expression())
        if self.word("SHOW"):
            for words in (("MEASUREMENTS",), ("TABLES",), ("DATABASES",), ("CURRENT_DATABASE",), ("USERS",), ("TOKENS",), ("GRANTS",)):
                if self.word(*words):
                    return Show(words[0].lower(), self.identifier() if words[0] in ("GRANTS", "TOKENS") and self.word("FOR") else None)
            self.fail("what to show")
        if self.word("DESCRIBE") or self.word("DESC"):
            self.word("MEASUREMENT")
            return Show("describe", self.identifier())
        if self.word("CREATE", "DATABASE"):
            return Database("create", self.identifier())
        if self.word("DROP", "DATABASE"):
            return Database("drop", self.identifier())
        if self.word("USE"):
            return Database("use", self.identifier())
        return self.account()

    def account(self) -> Account:
        if self.word("CREATE", "USER"):
            name = self.identifier()
            self.need_word("WITH", "PASSWORD")
            return Account("create_user", {"user": name, "password": self.string(), "superuser": str(self.word("SUPERUSER"))})
        if self.word("ALTER", "USER"):
            name = self.identifier()
            self.need_word("WITH", "PASSWORD")
            return Account("alter_user", {"user": name, "password": self.string()})
        if self.word("DROP", "USER"):
            return Account("drop_user", {"user": self.identifier()})
        if self.word("GRANT"):
            right = self.identifier().lower()
            self.need_word("ON", "DATABASE")
            db = self.identifier() if not self.op("*") else "*"
            self.need_word("TO")
            return Account("grant", {"right": right, "database": db, "user": self.identifier()})
        if self.word("REVOKE", "TOKEN"):
            return Account("revoke_token", {"token": self.string()})
        if self.word("REVOKE"):
            self.need_word("ON", "DATABASE")
            db = self.identifier() if not self.op("*") else "*"
            self.need_word("FROM")
            return Account("revoke", {"database": db, "user": self.identifier()})
        if self.word("ISSUE", "TOKEN", "FOR"):
            return Account("issue_token", {"user": self.identifier()})
        self.fail("a statement")

    def create(self) -> Create:
        name, columns = self.identifier(), []
        self.need_op("(")
        while True:
            column, options, dim = self.identifier(), {}, 0
            if self.word("TAG"):
                role, kind = "tag", "STRING"
                if self.now.kind == "name" and not self.word("STRING"):
                    self.fail("STRING")
            else:
                self.need_word("FIELD")
                role, kind = "field", self.identifier().upper()
                if kind == "VECTOR":
                    self.need_op("(")
                    dim = self.integer()
                    self.need_op(")")
                    if dim < 1:
                        raise SqlError("a vector needs a dimension of 1 at least")
                elif kind not in ("FLOAT", "INT", "BOOL", "STRING", "GEOPOINT"):
                    raise SqlError(f"unknown type {kind}")
                if not self.word("NOT", "NULL"):
                    self.word("NULL")
                if self.word("DEFAULT"):
                    raise SqlError("DEFAULT isn't supported")
                if self.word("WITH", "INDEX"):
                    self.need_word("HNSW")
                    self.need_op("(")
                    while not self.op(")"):
                        key = self.identifier().lower()
                        self.need_op("=")
                        options[key] = self.integer()
                        self.op(",")
                    if kind != "VECTOR" or options.get("m", 16) < 2 or options.get("ef", 200) < max(1, options.get("m", 16)):
                        raise SqlError("hnsw needs a vector column, m of 2 at least and ef of m at least")
            columns.append((column, role, kind, dim, options))
            if not self.op(","):
                break
        self.need_op(")")
        return Create(name, columns)

    def insert(self) -> Insert:
        name = self.identifier()
        self.need_op("(")
        columns = [self.identifier()]
        while self.op(","):
            columns.append(self.identifier())
        self.need_op(")")
        self.need_word("VALUES")
        rows = []
        while True:
            self.need_op("(")
            row = [self.constant()]
            while self.op(","):
                row.append(self.constant())
            self.need_op(")")
            if len(row) != len(columns):
                raise SqlError("a row has another number of values than there are columns")
            rows.append(row)
            if not self.op(","):
                return Insert(name, columns, rows)

    def constant(self) -> Literal:
        e = self.unary()
        if isinstance(e, Unary) and isinstance(e.operand, Literal) and e.operand.kind in ("int", "float"):
            return Literal(-e.operand.value, e.operand.kind)
        if not isinstance(e, Literal):
            raise SqlError("only literals are allowed in VALUES")
        return e

    def select(self) -> Select:
        out = Select([self.item()])
        while self.op(","):
            out.items.append(self.item())
        if not self.word("FROM"):
            return out
        name = self.identifier()
        if self.op("("):
            out.tvf = Call(name.lower(), self.arguments())
        else:
            out.source = name
        if self.word("AS") or (self.now.kind in ("name", "quoted") and self.now.text.upper() not in ("WHERE", "GROUP", "ORDER", "LIMIT", "OFFSET", "FETCH")):
            out.alias = self.identifier()
        if self.word("WHERE"):
            out.where = self.expression()
        if self.word("GROUP", "BY"):
            out.group = [self.expression()]
            while self.op(","):
                out.group.append(self.expression())
        if self.word("ORDER", "BY"):
            column = self.identifier()
            out.order = (column, not self.word("ASC") and self.word("DESC"))
        while True:
            if self.word("LIMIT"):
                out.limit = self.integer()
            elif self.word("OFFSET"):
                out.offset = self.integer()
                _ = self.word("ROWS") or self.word("ROW")
            elif self.word("FETCH"):
                _ = self.word("FIRST") or self.word("NEXT")
                out.limit = self.integer()
                _ = self.word("ROWS") or self.word("ROW")
                self.need_word("ONLY")
            else:
                return out

    def item(self) -> tuple[Any, str | None]:
        if self.op("*"):
            if self.word("AS"):
                raise SqlError("* can't have an alias")
            return Star(), None
        e = self.expression()
        if self.word("AS"):
            return e, self.identifier()
        return e, None

    # expressions, loosest first
    def expression(self) -> Any:
        left = self.conjunction()
        while self.word("OR"):
            left = Binary("or", left, self.conjunction())
        return left

    def conjunction(self) -> Any:
        left = self.negation()
        while self.word("AND"):
            left = Binary("and", left, self.negation())
        return left

    def negation(self) -> Any:
        return Unary("not", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> Any:
        left = self.sum()
        while self.now.kind == "op" and self.now.text in ("=", "!=", "<>", "<", "<=", ">", ">=", *_VECTOR_OPS):
            op = self.now.text
            self.i += 1
            right = self.sum()
            left = Call(_VECTOR_OPS[op], (left, right)) if op in _VECTOR_OPS else Binary("!=" if op == "<>" else op, left, right)
        return left

    def sum(self) -> Any:
        left = self.product()
        while self.now.kind == "op" and self.now.text in "+-":
            op = self.now.text
            self.i += 1
            left = Binary(op, left, self.product())
        return left

    def product(self) -> Any:
        left = self.unary()
        while self.now.kind == "op" and self.now.text in "*/%":
            op = self.now.text
            self.i += 1
            left = Binary(op, left, self.unary())
        return left

    def unary(self) -> Any:
        if self.op("-"):
            return Unary("-", self.unary())
        return self.primary()

    def arguments(self) -> tuple:
        if self.op(")"):
            return ()
        out = [Star() if self.op("*") else self.expression()]
        while self.op(","):
            out.append(self.expression())
        self.need_op(")")
        return tuple(out)

    def primary(self) -> Any:
        t = self.now
        if t.kind == "number":
            self.i += 1
            return Literal(int(t.text), "int") if t.text.isdigit() else Literal(float(t.text), "float")
        if t.kind == "duration":
            self.i += 1
            n, unit = re.fullmatch(r"(\d+)(\w+)", t.text).groups()
            ms = int(n) * _UNIT[unit] if unit in _UNIT else int(n) // {"us": 1000, "ns": 1_000_000}[unit]
            return Literal(ms, "duration")
        if t.kind == "string":
            return Literal(self.string(), "string")
        if self.op("("):
            e = self.expression()
            self.need_op(")")
            return e
        if self.op("["):
            values = []
            while not self.op("]"):
                values.append(float(self.constant().value))
                if not self.op(",") and self.now.text != "]":
                    self.fail("']'")
            return Literal(tuple(values), "vector")
        for word, literal in (("NULL", Literal(None, "null")), ("TRUE", Literal(True, "bool")), ("FALSE", Literal(False, "bool"))):
            if self.word(word):
                return literal
        name = self.identifier()
        if self.op("("):
            if name.upper() == "POINT":
                lat = float(self.constant().value)
                self.need_op(",")
                lon = float(self.constant().value)
                self.need_op(")")
                if not (-90 <= lat <= 90 and -180 <= lon <= 180):
                    raise SqlError("a point is out of range")
                return Literal((lat, lon), "point")
            return Call(name.lower(), self.arguments())
        if self.op("."):
            return Name(self.identifier(), name)
        return Name(name)
