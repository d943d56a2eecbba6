"""Expression trees: columns, literals, comparisons, AND, OR, NOT, arithmetic.

A tree is checked against a schema and becomes one Spark ``Column``. In
``reference`` semantics NOT keeps rows for which its operand is unknown, and
division by zero gives 0; in ``sql`` semantics NOT of unknown is unknown and
division by zero fails as Spark's does. Positive terms stay as they are, so that
they reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import EngineError
from millrace.functions.types import DOUBLE, INT32, INT64, SPARK_TYPES, STRING, coerce, format_value, literal_type, payload_is_set, type_of

REFERENCE, SQL = "reference", "sql"
COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
#: Spellings that the command line takes.
SPELLINGS = {"=": "=", "==": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def parse_comparison(text: str) -> str:
    if text not in SPELLINGS:
        raise EngineError(f"unknown operator: {text}")
    return SPELLINGS[text]


class Expr:
    """Base of all nodes; Python's operators build trees (``&``, ``|``, ``~`` for AND, OR, NOT)."""

    def __eq__(self, other):  # noqa: D105
        return Compare("=", self, _expr(other))

    def __ne__(self, other):
        return Compare("<>", self, _expr(other))

    def __lt__(self, other):
        return Compare("<", self, _expr(other))

    def __le__(self, other):
        return Compare("<=", self, _expr(other))

    def __gt__(self, other):
        return Compare(">", self, _expr(other))

    def __ge__(self, other):
        return Compare(">=", self, _expr(other))

    __hash__ = object.__hash__

    def __add__(self, other):
        return Arithmetic("+", self, _expr(other))

    def __sub__(self, other):
        return Arithmetic("-", self, _expr(other))

    def __mul__(self, other):
        return Arithmetic("*", self, _expr(other))

    def __truediv__(self, other):
        return Arithmetic("/", self, _expr(other))

    def __and__(self, other):
        return And(self, _expr(other))

    def __or__(self, other):
        return Or(self, _expr(other))

    def __invert__(self):
        return Not(self)

    # What a node means, by schema and semantics; the default is an error.
    def type(self, schema: T.StructType) -> str:
        """The type of the value; predicates report INT32."""
        return INT32

    def value(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        raise EngineError(f"{self} is a predicate, not a value")

    def predicate(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        raise EngineError(f"{self} is not a predicate")


def _expr(x: object) -> Expr:
    return x if isinstance(x, Expr) else Literal(x)


@dataclass(frozen=True, eq=False)
class ColumnRef(Expr):
    """A column by name, or by place in the input (then named ``#place`` in plans)."""

    name: str | None
    place: int | None = None

    def __str__(self) -> str:
        return self.name if self.name is not None else f"#{self.place}"

    def field(self, schema: T.StructType) -> T.StructField:
        if self.name is None:
            if not 0 <= self.place < len(schema.fields):
                raise EngineError(f"there is no column {self}")
            return schema.fields[self.place]
        found = [f for f in schema.fields if f.name == self.name]
        if not found:
            raise EngineError(f"there is no column {self.name}; there are {', '.join(schema.fieldNames())}")
        return found[0]

    def type(self, schema: T.StructType) -> str:
        return type_of(self.field(schema).dataType, str(self))

    def value(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        return F.col("`" + self.field(schema).name.replace("`", "``") + "`")


@dataclass(frozen=True, eq=False)
class Literal(Expr):
    content: object

    def __post_init__(self):
        literal_type(self.content)

    def __str__(self) -> str:
        return f"'{self.content}'" if isinstance(self.content, str) else format_value(self.content)

    def type(self, schema: T.StructType) -> str:
        return literal_type(self.content)

    def value(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        return F.lit(self.content).cast(SPARK_TYPES[literal_type(self.content)])

    def as_type(self, to: str) -> Column:
        return F.lit(coerce(self.content, to)).cast(SPARK_TYPES[to])

    def predicate(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        return F.lit(payload_is_set(self.content))


@dataclass(frozen=True, eq=False)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr

    def __post_init__(self):
        if self.op not in COMPARISONS:
            raise EngineError(f"unknown operator: {self.op}")

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"

    def predicate(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        a, b = self._sides(schema, semantics)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[self.op]

    def _sides(self, schema: T.StructType, semantics: str) -> tuple[Column, Column]:
        left, right = self.left, self.right
        x, y = left.type(schema), right.type(schema)
        if isinstance(left, ColumnRef) and isinstance(right, Literal):
            return left.value(schema, semantics), right.as_type(x)
        if isinstance(left, Literal) and isinstance(right, ColumnRef):
            return left.as_type(y), right.value(schema, semantics)
        if (x == STRING) != (y == STRING) or (isinstance(left, ColumnRef) and isinstance(right, ColumnRef) and x != y):
            raise EngineError(f"{self} compares {x} with {y}")
        return left.value(schema, semantics), right.value(schema, semantics)


@dataclass(frozen=True, eq=False)
class And(Expr):
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} AND {self.right})"

    def predicate(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        return self.left.predicate(schema, semantics) & self.right.predicate(schema, semantics)


@dataclass(frozen=True, eq=False)
class Or(Expr):
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} OR {self.right})"

    def predicate(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        return self.left.predicate(schema, semantics) | self.right.predicate(schema, semantics)


@dataclass(frozen=True, eq=False)
class Not(Expr):
    term: Expr

    def __str__(self) -> str:
        return f"(NOT {self.term})"

    def predicate(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        p = self.term.predicate(schema, semantics)
        return ~p if semantics == SQL else ~F.coalesce(p, F.lit(False))


@dataclass(frozen=True, eq=False)
class Arithmetic(Expr):
    """``+ - * /``. Any DOUBLE makes DOUBLE, else any INT64 makes INT64; null operands give null.

    Whole-number division truncates toward zero and keeps its type. Overflow is
    an error, as in Spark.
    """

    op: str
    left: Expr
    right: Expr

    def __post_init__(self):
        if self.op not in "+-*/" or len(self.op) != 1:
            raise EngineError(f"unknown operator: {self.op}")

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"

    def type(self, schema: T.StructType) -> str:
        kinds = {self.left.type(schema), self.right.type(schema)}
        if STRING in kinds:
            raise EngineError(f"{self} is arithmetic on a string")
        return DOUBLE if DOUBLE in kinds else INT64 if INT64 in kinds else INT32

    def value(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        kind = self.type(schema)
        to = SPARK_TYPES[kind]
        a, b = self.left.value(schema, semantics).cast(to), self.right.value(schema, semantics).cast(to)
        if self.op != "/":
            return {"+": a + b, "-": a - b, "*": a * b}[self.op]
        whole = kind != DOUBLE
        if semantics == SQL:
            return F.call_function("div", a, b).cast(to) if whole else a / b
        quotient = F.call_function("div", a, F.nullif(b, F.lit(0).cast(to))) if whole else F.try_divide(a, b)
        zero = F.lit(0).cast(to)
        return F.when(a.isNotNull() & (b == zero), zero).otherwise(quotient.cast(to))


def col(name: str | int) -> ColumnRef:
    """A column by name, or by place."""
    return ColumnRef(None, name) if isinstance(name, int) else ColumnRef(name)


def lit(value: object) -> Literal:
    return Literal(value)
