"""Compiled values: a column and what is known of it.

The language is untyped text. What a column's type tells is used at once, so that numbers compare as numbers
without a test; only text fields are tested row by row. NaN is null inside: comparisons with it are false.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType

from ..natural import NUMBER

SEPARATORS = "[;, ]"
_INTEGER = r"^[+-]?\d+$"


@dataclass(frozen=True)
class Value:
    """kind: num, bool, list (array of text) or text. literal: the Python value of a constant."""

    col: Column
    kind: str
    literal: Any = None


def of_type(col: Column, dtype: DataType) -> Value:
    if isinstance(dtype, NumericType):
        return Value(col, "num")
    if isinstance(dtype, BooleanType):
        return Value(col, "bool")
    if isinstance(dtype, ArrayType):
        return Value(col.cast("array<string>"), "list")
    return Value(col.cast("string"), "text")


def constant(x: Any) -> Value:
    if isinstance(x, (list, tuple)):
        return Value(F.array(*[F.lit(str(v)) for v in x]).cast("array<string>"), "list", tuple(map(str, x)))
    return Value(F.lit(x), "num" if isinstance(x, (int, float)) else "text", x)


def is_number(x: Column) -> Column:
    return x.rlike(NUMBER)


def is_integer(x: Column) -> Column:
    return x.rlike(_INTEGER)


def number(v: Value) -> Column:
    """The number, null where it's none."""
    if v.kind == "num":
        return v.col
    if v.kind == "bool":
        return v.col.cast("int")
    if v.kind == "list":
        return number(Value(text(v), "text"))
    if isinstance(v.literal, str):
        try:
            return F.lit(float(v.literal)) if not _is_int(v.literal) else F.lit(int(v.literal))
        except ValueError:
            return F.lit(None).cast("double")
    return F.when(is_number(v.col), v.col.cast("double"))


def _is_int(x: str) -> bool:
    return x.lstrip("+-").isdigit()


def integer(v: Value) -> Column:
    return number(v).cast("long")


def text(v: Value) -> Column:
    if v.kind == "bool":
        return v.col.cast("int").cast("string")
    if v.kind == "list":
        return F.array_join(v.col, ",")
    return v.col.cast("string")


def items(v: Value) -> Column:
    """The elements of a vector; none of an empty text."""
    if v.kind == "list":
        return v.col
    if v.kind in ("num", "bool"):
        return F.array(text(v))
    # one separator of one character: a pattern would be compiled again for each row
    return F.when(v.col == "", F.array().cast("array<string>")).otherwise(F.split(F.translate(v.col, SEPARATORS[1:-1], "," * len(SEPARATORS[1:-1])), ","))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x made once wherever f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def truth(v: Value) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind == "num":
        return v.col != 0
    return F.coalesce(number(v) != 0, F.lower(text(v)).isin("true", "yes", "on"))


def numbers(array: Column) -> Column:
    """The numeric elements of an array of text."""
    return F.transform(F.filter(array, is_number), lambda x: x.cast("double"))


def equal(a: Value, b: Value) -> Column:
    """Numeric if both are numbers, else as text."""
    if a.kind == b.kind == "num":
        return a.col == b.col
    for x in (a, b):  # a text constant that is no number compares as text
        if x.kind == "text" and isinstance(x.literal, str):
            try:
                float(x.literal)
            except ValueError:
                return text(a) == text(b)
    na, nb = number(a), number(b)
    if a.kind == "num" or b.kind == "num":
        other = b if a.kind == "num" else a
        return F.when(number(other).isNotNull(), na == nb).otherwise(text(a) == text(b))
    return F.when(na.isNotNull() & nb.isNotNull(), na == nb).otherwise(text(a) == text(b))


def checked(v: Value, op: str) -> Column:
    """A number, or an error where there is something else than a number or null."""
    n = number(v)
    if v.kind in ("num", "bool"):
        return n
    x = text(v)
    return F.when(n.isNotNull() | x.isNull() | (x == "NaN"), n).otherwise(F.raise_error(F.concat(F.lit(f"not a number for {op}: "), x)).cast("double"))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def total(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x))


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    return F.when(F.size(a) > 0, F.sqrt(F.aggregate(F.transform(a, lambda x: F.pow(x - mean(a), F.lit(2))), F.lit(0.0), lambda s, x: s + x) / F.size(a)))


def middle(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def quartile(a: Column, upper: bool) -> Column:
    """Median of the lower or upper half, the middle element in neither."""
    s, n = F.array_sort(a), F.size(a)
    half = F.floor(n / 2).cast("int")
    part = F.slice(s, n - half + 1, half) if upper else F.slice(s, F.lit(1), half)
    return F.when(half > 0, middle(part)).otherwise(F.get(s, F.lit(0)))


def modes(a: Column) -> Column:
    """The most frequent elements, ties in natural order."""
    from ..natural import nat_sort

    counted = F.transform(F.array_distinct(a), lambda x: F.struct(F.size(F.filter(a, lambda y: y == x)).alias("n"), x.alias("x")))
    most = F.array_max(F.transform(counted, lambda c: c["n"]))
    return nat_sort(F.transform(F.filter(counted, lambda c: c["n"] == most), lambda c: c["x"]))


def same_length(a: Column, b: Column) -> tuple[Column, Column]:
    """Vectors of one length; an element by itself is repeated, other lengths are an error."""
    na, nb = F.size(a), F.size(b)
    bad = F.raise_error(F.lit("vectors of different length")).cast("array<string>")
    x = F.when((na == nb) | (nb == 1), a).when(na == 1, F.array_repeat(F.get(a, F.lit(0)), nb)).otherwise(bad)
    y = F.when((na == nb) | (na == 1), b).when(nb == 1, F.array_repeat(F.get(b, F.lit(0)), na)).otherwise(bad)
    return x, y


def fixed(x: Column, places: int) -> Column:
    """x with so many decimals as C's printf writes it: the binary value is rounded, ties to even. Java's own
    format rounds the shortest decimal text up instead."""
    return F.call_function("format_number", x.cast("double"), F.lit("0" + ("." + "0" * places if places else "")))
