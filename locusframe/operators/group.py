"""Summaries: groups, pivots and the fixed set of aggregates.

Rows are aggregated once per group and pivot value, with map-side combination; the pivot then works on that
small table. Quartiles are picked by position from pre-aggregated values in a window, which spills, so no
group is gathered in memory for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.compiler import Compiler, output
from ..functions.library import glob
from ..functions.parser import parse
from ..functions.values import fixed, number, of_type, text
from ..natural import nat_sort, nat_sort_key
from .select import _calculated, filter_rows, ordered, split_fields, with_row

#: More pivot columns than this are refused: the table would be wider than Spark plans well.
MAX_PIVOT = 5000
#: Rows of a window in which runs are found.
RUN_CHUNK = 1 << 17
_ALL = ("all", "-", "_")


@dataclass(frozen=True)
class Aggregate:
    how: str
    field: str | None

    @property
    def name(self) -> str:
        return f"{self.how}_{self.field}" if self.field else self.how


def parse_aggregates(source: str | Iterable[str]) -> list[Aggregate]:
    parts = re.findall(r"([a-z0-9]+)(?:\(([^()]*)\))?", source) if isinstance(source, str) else [re.match(r"([a-z0-9]+)(?:\(([^()]*)\))?", p).groups() for p in source]
    return [Aggregate(how, field or None) for how, field in parts]


def _pairs(spec: str | Iterable[str]) -> list[tuple[str, str]]:
    parts = split_fields(spec)
    return [(parts[i], parts[i + 1].strip("{}") if i + 1 < len(parts) else "*") for i in range(0, len(parts), 2)]


def _allowed(c: Column, patterns: str) -> Column | None:
    """Values or globs, any of which may match; * is no filter."""
    names = patterns.split()
    if not names or names == ["*"]:
        return None
    plain = [n for n in names if not re.search(r"[*?\[]", n)]
    out = c.isin(plain) if plain else F.lit(False)
    for n in names:
        if n not in plain:
            out = out | c.rlike(glob(n))
    return out


def expand_samples(df: DataFrame, fields: list[str], by: str = "sample") -> DataFrame:
    """A row for each sample (what follows the last -) or analysis (the first -) of a wide table that has all
    the fields of its own; other columns as they are."""
    every = model.samples(df.columns) if by == "sample" else model.analyses(df.columns)
    own = [f for f in fields if f != by and any(f"{f}-{s}" in df.columns for s in every)]
    chosen = [s for s in every if all(f"{f}-{s}" in df.columns for f in own)]
    rows = F.array(*[F.struct(F.lit(s).alias(by), *[model.col(f"{f}-{s}").cast("string").alias(f) for f in own]) for s in chosen])
    plain = [c for c in df.columns if c not in own and c != by and "-" not in c]
    return df.select(*[model.col(c) for c in plain], F.inline(rows))


def group(df: DataFrame, by: str | Iterable[str], columns: str | Iterable[str] | None = None, query: str | None = None, sort_by: str | None = None, reverse: bool = False) -> DataFrame:
    """by: field filter field filter ...; columns: field filter ... aggregates. A field may be calculated
    (name=expression), +field or -field (a list, each element or each different element counts), sample or
    analysis of a wide table, or all. Groups come in natural order."""
    groups = _pairs(by)
    parts = split_fields(columns) if columns else ["count"]
    aggregates = parse_aggregates(parts[-1])
    pivots = _pairs(parts[:-1])
    if query:
        df = filter_rows(df, query)
    for special in ("sample", "analysis"):
        if any(f == special for f, _ in groups + pivots) and special not in df.columns:
            needed = [f.lstrip("+-") for f, _ in groups + pivots] + [a.field for a in aggregates if a.field]
            df = expand_samples(df, needed, special)
    hidden = [f for f in [f.lstrip("+-") for f, _ in groups + pivots] + [a.field for a in aggregates if a.field] if f not in df.columns and any(c.startswith(f + "-") for c in df.columns)]
    if hidden:  # a field of samples without sample among the groups: all samples together
        df = expand_samples(df, hidden, "sample").drop("sample")
    df, names = _keys(df, groups)
    df, pivot_names = _keys(df, pivots)
    keys = names + (["_pivot"] if pivots else [])
    if pivots:
        df = df.withColumn("_pivot", F.concat_ws("-", *[model.col(n) for n in pivot_names]))
    long = aggregated(df, keys, names, ["_pivot"] if pivots else [], aggregates)
    if not pivots:
        out = long
    else:
        values = _pivot_values(long, pivots)
        wide = long.groupBy(*[model.col(n) for n in names]).pivot("_pivot", values).agg(*[F.first(model.col(a.name)).alias(a.name) for a in aggregates])
        new = []
        for v in values:
            for a in aggregates:
                c = model.col(v if len(aggregates) == 1 else f"{v}_{a.name}")
                new.append((F.coalesce(c, F.lit(0)) if a.how == "count" else c).alias(f"{a.name}-{v}"))
        out = wide.select(*[model.col(n) for n in names], *new)
    if sort_by:
        from .select import sort

        return sort(out, sort_by, reverse)
    return ordered(out, [(model.col(n), True, False) for n in names])


def _keys(df: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    names = []
    for f, allowed in pairs:
        calc = _calculated(f)
        name = calc[0] if calc else f
        if calc:
            df = df.withColumn(name, output(Compiler(df.schema)(parse(calc[1]))))
        elif f in _ALL and f not in df.columns:
            df, name = df.withColumn("all", F.lit("all")), "all"
        elif f[0] in "+-" and f not in df.columns:
            name = f[1:]
            v = F.split(model.col(name).cast("string"), "[;,]")
            df = df.withColumn(name, F.explode(F.array_distinct(v) if f[0] == "-" else v))
        cond = _allowed(model.col(name).cast("string"), allowed)
        if cond is not None:
            df = df.filter(cond)
        names.append(name)
    return df, names


def _pivot_values(long: DataFrame, pivots: list[tuple[str, str]]) -> list[str]:
    fixed = [a.split() for _, a in pivots]
    if all(f and not any(re.search(r"[*?\[]", x) for x in f) for f in fixed):
        values = [""]
        for f in fixed:
            values = [f"{v}-{x}" if v else x for v in values for x in f]
        return values
    rows = [r[0] for r in long.select("_pivot").distinct().limit(MAX_PIVOT + 1).collect()]
    if len(rows) > MAX_PIVOT:
        raise ValueError(f"more than {MAX_PIVOT} pivot columns")
    return sorted((r for r in rows if r is not None), key=nat_sort_key)


def _measure(df: DataFrame, field: str) -> Column:
    return number(of_type(model.col(field), df.schema[field].dataType))


def aggregated(df: DataFrame, keys: list[str], groups: list[str], pivot: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """A row for each combination of keys."""
    plain: dict[str, Column] = {}
    if any(a.how == "list" for a in aggregates):
        df = df.withColumn("_at", F.monotonically_increasing_id())  # lists are in the order of the input
    for a in aggregates:
        if a.how in ("count", "percent", "gpercent"):
            plain["_count"] = F.count(F.lit(1))
        if a.how in ("percentsum", "gpercentsum"):
            plain[f"_sum_{a.field}"] = F.sum(_measure(df, a.field))
        one = {
            "count": lambda a: F.count(F.lit(1)),
            "min": lambda a: F.min(_measure(df, a.field)),
            "max": lambda a: F.max(_measure(df, a.field)),
            "sum": lambda a: F.sum(_measure(df, a.field)),
            "avg": lambda a: F.avg(_measure(df, a.field)),
            "stdev": lambda a: F.stddev_pop(_measure(df, a.field)),
            "stddev": lambda a: F.stddev_pop(_measure(df, a.field)),
            "median": lambda a: F.median(_measure(df, a.field)),
            "ucount": lambda a: F.count_distinct(model.col(a.field)),
            "distinct": lambda a: F.array_join(nat_sort(F.collect_set(text(of_type(model.col(a.field), df.schema[a.field].dataType)))), ","),
            "list": lambda a: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_at"), text(of_type(model.col(a.field), df.schema[a.field].dataType)).alias("v")))), lambda s: F.coalesce(s["v"], F.lit(""))), ","),
        }.get(a.how)
        if one:
            plain[a.name] = one(a)
        elif a.how not in ("percent", "gpercent", "percentsum", "gpercentsum", "q1", "q3"):
            raise ValueError(f"no aggregate {a.how}")
    out = df.groupBy(*[model.col(k) for k in keys]).agg(*[c.alias(n) for n, c in (plain or {"_count": F.count(F.lit(1))}).items()])
    for a in aggregates:
        if a.how in ("percent", "gpercent", "percentsum", "gpercentsum"):
            part = groups if a.how.startswith("g") else pivot
            c = model.col(f"_sum_{a.field}" if a.field else "_count")
            # of the few summary rows; a constant key where there is nothing to part by
            w = Window.partitionBy(*([model.col(p) for p in part] or [F.lit(1)]))
            out = out.withColumn(a.name, fixed(F.lit(100.0) * c / F.sum(c).over(w), 2))
    # all quartiles of a field in one pass
    for field in dict.fromkeys(a.field for a in aggregates if a.how in ("q1", "q3")):
        own = [a for a in aggregates if a.field == field and a.how in ("q1", "q3")]
        q = _quartiles(df, keys, field, own).select(*[model.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[model.col(a.name) for a in own])
        cond = [out[f"`{k}`"].eqNullSafe(q[f"_k{i}"]) for i, k in enumerate(keys)]
        out = out.join(q, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return out.select(*[model.col(k) for k in keys], *[model.col(a.name) for a in aggregates])


def _quartiles(df: DataFrame, keys: list[str], field: str, aggregates: list[Aggregate]) -> DataFrame:
    """Medians of the lower and the upper half without the middle element, from counts of values."""
    k = [model.col(x) for x in keys]
    counts = df.select(*k, _measure(df, field).cast("double").alias("_v")).where("_v is not null").groupBy(*k, "_v").agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c").over(Window.partitionBy(*k))
    upto = F.sum("_c").over(Window.partitionBy(*k).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_n", n).withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    half = F.greatest(F.floor(F.col("_n") / 2), F.lit(1))
    at = lambda p: F.max(F.when((F.col("_from") <= p) & (p < F.col("_to")), F.col("_v")))
    out = []
    for a in aggregates:
        first = F.when(F.col("_n") > 1, F.col("_n") - half).otherwise(0) if a.how == "q3" else F.lit(0)
        low, high = first + F.floor((half - 1) / 2), first + F.floor(half / 2)
        out.append(((at(low) + at(high)) / 2).alias(a.name))
    return placed.groupBy(*k).agg(*out)


def _run_numbers(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """df with the number (_run) of the run of rows that agree in fields, in order."""
    x = with_row(df, order, "_at").withColumn("_chunk", F.floor(F.col("_at") / RUN_CHUNK))
    own = F.struct(*[model.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    w = Window.partitionBy("_chunk").orderBy("_at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lasts = x.groupBy("_chunk").agg(F.max_by(own, "_at").alias("_last")).select((F.col("_chunk") + 1).alias("_chunk"), "_last")
    x = x.join(lasts, "_chunk", "left")
    first = F.row_number().over(w) == 1
    before = F.when(first, F.col("_last")).otherwise(F.lag(own).over(w))
    new = before.isNull()
    for i, f in enumerate(fields):
        new = new | ~before[f"f{i}"].eqNullSafe(model.col(f))
    x = x.withColumn("_in", F.sum(new.cast("int")).over(upto))
    counts = x.groupBy("_chunk").agg(F.max("_in").alias("_n"))
    base = counts.select("_chunk", (F.sum("_n").over(Window.orderBy("_chunk")) - F.col("_n")).alias("_base"))  # a row for each chunk
    return x.join(base, "_chunk").withColumn("_run", F.col("_base") + F.col("_in")).select(*[model.col(c) for c in df.columns], "_run")


def runs(df: DataFrame, fields: list[str], order: list[str], sums: list[str] | None = None, stats: list[str] | None = None, sorted_input: bool = True) -> DataFrame:
    """Group rows that follow each other and agree in fields (all that agree unless sorted_input). Other
    columns are joined by commas in order; sums are added up; stats give min, total, count and max.

    Rows are numbered in order, and windows are over RUN_CHUNK rows each; what a chunk needs of those before it, their
    last row and their number of runs, comes from a table with a row for each chunk."""
    sums, stats = sums or [], stats or []
    keys = [model.col(f) for f in fields]
    o = [model.col(c) for c in order]
    if sorted_input:
        df = _run_numbers(df, fields, order)
        keys = [*keys, F.col("_run")]
    rest = [c for c in df.columns if c not in [*fields, *sums, *stats, "_run"]]
    text_of = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[x.alias(f"o{i}") for i, x in enumerate(o)], model.col(c).cast("string").alias("v")))), lambda s: F.coalesce(s["v"], F.lit(""))), ",")
    aggs = [text_of(c).alias(c) for c in rest]
    aggs += [F.sum(F.coalesce(_measure(df, c).cast("long"), F.lit(1) if not sorted_input else F.lit(0))).alias(c) for c in sums if c in df.columns]
    aggs += [F.count(F.lit(1)).alias(c) for c in sums if c not in df.columns]
    for c in stats:
        x = _measure(df, c)
        aggs += [F.min(x).alias(f"{c}_min"), F.sum(x).alias(f"{c}_total"), F.count(x).alias(f"{c}_count"), F.max(x).alias(f"{c}_max")]
    out = df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("count")]))
    return out.drop("_run")


def histogram(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(model.col(field)).agg(F.count(F.lit(1)).alias("count"))
