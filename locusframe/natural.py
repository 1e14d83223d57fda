"""Natural order: numbers before strings and by value, digits inside strings by value, case only as a tie-break, ``*`` last."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_number = re.compile(NUMBER)
_WIDTH = 20


def nat_columns(col: Column | str) -> list[Column]:
    """Columns that sort as natural order does, the first by number: texts are after all numbers. Null sorts as null
    does. A sort has to be by columns that are there already (`select.ordered`), as it makes expressions again for
    each comparison."""
    x = (F.col(col) if isinstance(col, str) else col).cast("string")
    number = F.when(x.rlike(NUMBER), x.cast("double"))
    pieces = F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d+$") & (F.length(p) < _WIDTH), F.lpad(p, _WIDTH, "0")).otherwise(p)), "")
    padded = F.translate(padded, "*", "\U0010ffff")
    return [F.coalesce(number, F.when(x.isNotNull(), float("inf"))), number.isNull().cast("int"), F.when(number.isNull(), padded).otherwise(""), x]


def nat_key(col: Column | str) -> Column:
    """The same as one struct."""
    x = (F.col(col) if isinstance(col, str) else col).cast("string")
    number, text, padded, raw = nat_columns(x)
    return F.when(x.isNotNull(), F.struct(text.alias("text"), number.alias("number"), padded.alias("padded"), raw.alias("raw")))


def nat_sort_key(x: str) -> tuple:
    """The same order for Python strings."""
    if _number.match(x):
        return (0, float(x), "", x)
    return (1, 0.0, "".join(p.zfill(_WIDTH) if p.isdigit() else p for p in re.findall(r"\d+|\D+", x.lower())).replace("*", "\U0010ffff"), x)


def nat_sort(array: Column) -> Column:
    """An array of strings in natural order."""
    keyed = F.transform(array, lambda x: F.struct(nat_key(x).alias("key"), x.alias("value")))
    return F.transform(F.array_sort(keyed), lambda x: x["value"])


def chr_clip(col: Column | str) -> Column:
    """A chromosome name without its chr prefix; MT is M."""
    x = (F.col(col) if isinstance(col, str) else col).cast("string")
    x = F.when(F.lower(F.substring(x, 1, 3)) == "chr", F.regexp_replace(x, r"^[Cc][Hh][Rr]-?", "")).otherwise(x)
    return F.when(x == "MT", F.lit("M")).otherwise(x)
