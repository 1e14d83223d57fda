"""Wide tables to long ones and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..natural import nat_sort_key

MAX_COLUMNS = 20_000


def long(df: DataFrame, by: str = "analysis") -> DataFrame:
    """A row for each row and analysis (or sample): the common columns, sample, and the fields without their
    suffix. A common column of a field's name becomes name_global."""
    part = model.analysis_of if by == "analysis" else model.sample_of
    suffixes = model.analyses(df.columns) if by == "analysis" else model.samples(df.columns)
    fields = list(dict.fromkeys(c[: -len(s) - 1] for c in df.columns if (s := part(c)) is not None))
    common = [c for c in df.columns if part(c) is None]
    kinds = {f: next(df.schema[f"{f}-{s}"].dataType for s in suffixes if f"{f}-{s}" in df.columns) for f in fields}
    rows = F.array(*[F.struct(F.lit(s).alias("sample"), *[(model.col(f"{f}-{s}") if f"{f}-{s}" in df.columns else F.lit(None)).cast(kinds[f]).alias(f) for f in fields]) for s in suffixes])
    return df.select(*[model.col(c).alias(f"{c}_global" if c in fields or c == "sample" else c) for c in common], F.inline(rows))


def normalised(df: DataFrame, key: str = "id", by: str = "analysis") -> tuple[DataFrame, DataFrame]:
    """Common columns and long fields as two tables that an id links."""
    part = model.analysis_of if by == "analysis" else model.sample_of
    with_id = df.withColumn(key, F.monotonically_increasing_id())
    common = with_id.select(key, *[model.col(c) for c in df.columns if part(c) is None])
    return common, long(with_id.select(key, *[model.col(c) for c in df.columns if part(c) is not None]), by)


def _labels(df: DataFrame, fields: list[str]) -> list[str]:
    rows = [r[0] for r in df.select(F.concat_ws("-", *[model.col(f) for f in fields])).distinct().limit(MAX_COLUMNS + 1).collect()]
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    return sorted(rows, key=nat_sort_key)


def wide(df: DataFrame, common: list[str], sample_fields: list[str], order: list[str] | None = None, missing: str = "?", values: list[str] | None = None) -> DataFrame:
    """A row for each combination of the common fields, field-sample for the rest. Of repeated cells the last
    in order counts, the largest without an order."""
    rest = [c for c in df.columns if c not in common and c not in sample_fields]
    values = values or _labels(df, sample_fields)
    label = F.concat_ws("-", *[model.col(f) for f in sample_fields])
    own = lambda f: F.when(F.col("_s") == v, model.col(f))
    place = F.struct(*[model.col(o) for o in order or []])
    cells = []
    for v in values:
        for f in rest:
            cell = F.max_by(model.col(f), F.when(F.col("_s") == v, place)) if order else F.max(own(f))
            cells.append(F.coalesce(cell, F.lit(missing)).alias(f"{f}-{v}"))
    extra = [model.col(o) for o in order or [] if o not in common and o not in rest]
    texts = df.select(*[model.col(c) for c in common], label.alias("_s"), *[model.col(f).cast("string").alias(f) for f in rest], *extra)
    return texts.groupBy(*[model.col(c) for c in common]).agg(*cells)


def keyvalue(df: DataFrame, ids: list[str]) -> DataFrame:
    """ids, sample, key, value: a row for each other column. The sample is what follows the last - of its
    name, empty without one."""
    cells = F.array(
        *[F.struct(F.lit(model.sample_of(c) or "").alias("sample"), F.lit(c.rsplit("-", 1)[0]).alias("key"), model.col(c).cast("string").alias("value")) for c in df.columns if c not in ids]
    )
    return df.select(*[model.col(i) for i in ids], F.inline(cells))


def colvalue(df: DataFrame, ids: list[str], keys: list[str], value: str, missing: str = "", values: list[str] | None = None) -> DataFrame:
    """The inverse: a column for each combination of keys."""
    values = values or _labels(df, keys)
    label = F.concat_ws("-", *[model.col(k) for k in keys])
    cells = [F.coalesce(F.max(F.when(label == v, model.col(value).cast("string"))), F.lit(missing)).alias(v) for v in values]
    return df.groupBy(*[model.col(i) for i in ids]).agg(*cells)
