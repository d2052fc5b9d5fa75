"""Expressions: Columns with `.str` and `.dt` namespaces.  Every operation is a Column operation, so plans stay in codegen."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def unwrap(value):
    """The Column (or plain value) of an expression."""
    return value.column if isinstance(value, Expression) else value


class Expression:
    """A Column with operators, `.str` and `.dt`; other Column methods (cast, isin, between, ...) work as they do there."""

    __slots__ = ("column",)

    def __init__(self, column: Column):
        self.column = unwrap(column)

    def __getattr__(self, name: str):
        if name.startswith("_") or not hasattr(Column, name):
            raise AttributeError(name)
        method = getattr(self.column, name)

        def call(*args, **kwargs):
            out = method(*map(unwrap, args), **{k: unwrap(v) for k, v in kwargs.items()})
            return Expression(out) if isinstance(out, Column) else out

        return call

    def __pow__(self, other):
        return Expression(F.pow(self.column, _column(other)))

    def __rpow__(self, other):
        return Expression(F.pow(_column(other), self.column))

    def __repr__(self) -> str:
        return f"Expression({self.sql()})"

    def __bool__(self):
        raise ValueError("an expression has no truth value: use &, | and ~")

    __hash__ = None

    def sql(self) -> str:
        """The expression as Spark prints it."""
        return str(self.column).removeprefix("Column<'").removesuffix("'>")

    def required_columns(self) -> set[str]:
        """Names of the columns that the expression reads."""
        from pyspark.sql import SparkSession

        tree = SparkSession.active()._jsparkSession.expression(self.column._jc)
        leaves = tree.collectLeaves()
        found = (leaves.apply(i) for i in range(leaves.size()))
        return {".".join(x.nameParts().apply(i) for i in range(x.nameParts().size())) for x in found if x.getClass().getSimpleName() == "UnresolvedAttribute"}

    @property
    def str(self) -> Strings:
        return Strings(self.column)

    @property
    def dt(self) -> Datetimes:
        return Datetimes(self.column)


def _column(value) -> Column:
    value = unwrap(value)
    return value if isinstance(value, Column) else F.lit(value)


def _binary(op, swapped: bool = False):
    def apply(self, other):
        a, b = self.column, _column(other)
        return Expression(op(b, a) if swapped else op(a, b))

    return apply


for _name in ("add", "sub", "mul", "truediv", "mod"):
    setattr(Expression, f"__{_name}__", _binary(getattr(operator, _name)))
    setattr(Expression, f"__r{_name}__", _binary(getattr(operator, _name), swapped=True))
for _name in ("eq", "ne", "lt", "le", "gt", "ge"):
    setattr(Expression, f"__{_name}__", _binary(getattr(operator, _name)))
for _name in ("and_", "or_"):
    setattr(Expression, f"__{_name.rstrip('_')}__", _binary(getattr(operator, _name)))
    setattr(Expression, f"__r{_name.rstrip('_')}__", _binary(getattr(operator, _name), swapped=True))
Expression.__invert__ = lambda self: Expression(~self.column)
Expression.__neg__ = lambda self: Expression(-self.column)


class Strings:
    """String functions of a column."""

    __slots__ = ("column",)

    def __init__(self, column: Column):
        self.column = column

    def to_uppercase(self) -> Expression:
        return Expression(F.upper(self.column))

    def to_lowercase(self) -> Expression:
        return Expression(F.lower(self.column))

    def contains(self, text: str) -> Expression:
        """Whether the text occurs literally."""
        return Expression(F.contains(self.column, _column(text)))

    def starts_with(self, text: str) -> Expression:
        return Expression(F.startswith(self.column, _column(text)))

    def ends_with(self, text: str) -> Expression:
        return Expression(F.endswith(self.column, _column(text)))

    def length(self) -> Expression:
        """Characters, not bytes."""
        return Expression(F.length(self.column))

    def slice(self, start: int, length: int) -> Expression:
        """`length` characters from 0-based `start`."""
        return Expression(F.substring(self.column, start + 1, length))

    def json_extract(self, field: str) -> Expression:
        """A field (or dotted path) of a JSON text as string, null where absent."""
        return Expression(F.get_json_object(self.column, f"$.{field}"))

    def strptime(self, format: str = "datetime") -> Expression:
        """Parse ISO text: "datetime", "date", or "time" (as HH:mm:ss.ffffff text)."""
        if format == "datetime":
            return Expression(self.column.cast("timestamp_ntz"))
        if format == "date":
            return Expression(self.column.cast("date"))
        if format == "time":
            return Expression(F.date_format(F.concat(F.lit("1970-01-01 "), self.column).cast("timestamp_ntz"), "HH:mm:ss.SSSSSS"))
        raise ValueError(f"unknown format {format!r}: datetime, date or time")

    def hash(self) -> Expression:
        """A stable 64-bit hash."""
        return Expression(F.xxhash64(self.column))

    def tokens(self) -> Expression:
        """White-space separated words as an array."""
        inner = F.btrim(self.column, F.lit(" \t\n\x0b\f\r"))  # without blanks at its ends a text splits into no empty words
        return Expression(F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"\s+")))


_UNITS = {"ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days", "M": "months", "y": "years"}


class Datetimes:
    """Date and time functions of a column."""

    __slots__ = ("column",)

    def __init__(self, column: Column):
        self.column = column

    def year(self) -> Expression:
        return Expression(F.year(self.column))

    def month(self) -> Expression:
        return Expression(F.month(self.column))

    def day(self) -> Expression:
        return Expression(F.day(self.column))

    def hour(self) -> Expression:
        return Expression(F.hour(self.column))

    def minute(self) -> Expression:
        return Expression(F.minute(self.column))

    def second(self) -> Expression:
        return Expression(F.second(self.column))

    def millisecond(self) -> Expression:
        """Milliseconds within the minute."""
        return Expression(F.floor(F.extract(F.lit("SECOND"), self.column) * 1000).cast("long"))

    def microsecond(self) -> Expression:
        """Microseconds within the minute."""
        return Expression(F.floor(F.extract(F.lit("SECOND"), self.column) * 1_000_000).cast("long"))

    def weekday(self) -> Expression:
        """0 is Sunday."""
        return Expression(F.dayofweek(self.column) - 1)

    def week(self) -> Expression:
        """ISO week."""
        return Expression(F.weekofyear(self.column))

    def offset_by(self, num: int, unit: str) -> Expression:
        """Moved by a number of ms, s, m, h, d, M or y; month ends clamp."""
        if unit not in _UNITS:
            raise ValueError(f"unknown unit {unit!r}: one of {', '.join(_UNITS)}")
        return Expression(self.column + F.expr(f"interval '{int(num)}' {_UNITS[unit]}"))

    def strftime(self) -> Expression:
        """As text."""
        return Expression(self.column.cast("string"))


def col(name: str) -> Expression:
    return Expression(F.col(f"`{name}`"))


def lit(value) -> Expression:
    return Expression(F.lit(value))
