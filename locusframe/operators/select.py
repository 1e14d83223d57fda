"""Projection, filters and sorting in the expression language.

Everything becomes one plan of columns: hidden and calculated fields are columns of the same projection, so
pruning and pushdown reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.compiler import Compiler, output
from ..functions.parser import parse
from ..functions.values import Value, number, of_type, text, truth
from ..natural import chr_clip, nat_columns
from ..shared import checkpointed


def split_fields(spec: str | Iterable[str]) -> list[str]:
    """Fields of a list separated by white space; what stands in quotes, brackets and braces stays whole."""
    if not isinstance(spec, str):
        return list(spec)
    out, depth, quoted, now = [], 0, False, ""
    for c in spec + " ":
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c in "({[") - (c in ")}]")
        if c.isspace() and not depth and not quoted:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out


def _calculated(field: str) -> tuple[str, str] | None:
    m = re.match(r"(-?[A-Za-z_][\w.*-]*)=(?!=)(.*)$", field, re.S)
    return (m[1], m[2]) if m else None


def expand_calculated(columns: list[str], name: str, source: str) -> list[tuple[str, str]]:
    """name=source once for each value of its wildcards. Fields with the same wildcard (*, **, ...) match the
    same values; different ones are combined."""
    stars = list(dict.fromkeys(re.findall(r"\*+", name)))
    if not stars:
        return [(name, source)]
    combos: list[dict[str, str]] = [{}]
    for star in stars:
        values: list[str] | None = None
        for field in re.findall(r"\$\{?([A-Za-z0-9._*-]+)", source):
            found = re.findall(r"\*+", field)
            if star in found and len(set(found)) == 1:
                pattern = re.compile("^" + re.escape(field).replace(re.escape(star), "(.+)") + "$")
                own = [m[1] for c in columns if (m := pattern.match(c))]
                values = own if values is None else [v for v in values if v in own]
        combos = [c | {star: v} for c in combos for v in values or []]
    out = []
    for c in combos:
        put = lambda s, c=c: re.sub(r"\*+", lambda m: c.get(m[0], m[0]), s)
        out.append((put(name), re.sub(r"\$(\{?)([A-Za-z0-9._*-]+)(\}?)", lambda m: "${" + put(m[2]) + "}", source)))
    return out


def with_row(df: DataFrame, order: list[str] | None = None, name: str = "ROW") -> DataFrame:
    """Number rows from 0 in the order of the columns given. Without a window over all rows: counts of the
    partitions are added to the number in the partition."""
    if not order:
        raise ValueError("rows of a DataFrame have no order: name the columns that give it")
    ordered = df.orderBy(*[F.col(f"`{c}`") for c in order])
    return number_partitions(ordered, name)


def number_partitions(df: DataFrame, name: str) -> DataFrame:
    """0, 1, ... in the order of the partitions and of the rows in them."""
    marked = df.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    marked = checkpointed(marked)  # partition numbers must not change between the two uses
    sizes = marked.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each partition
    return marked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def project(df: DataFrame, fields: str | Iterable[str], sampleinfo: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Named fields in the order given, wildcards, -pattern (all but what matches), name=expression (usable by
    what follows), -name=expression (hidden)."""
    plan, keep = _resolve(df, split_fields(fields), sampleinfo)
    return df.select(*[output(plan[c]).alias(c) for c in keep])


def _resolve(df: DataFrame, fields: list[str], sampleinfo: dict[str, dict[str, str]] | None = None) -> tuple[dict[str, Value], list[str]]:
    raw = {f.name: Value(model.col(f.name), "raw") for f in df.schema.fields}
    extra: dict[str, Value] = _sample_fields(df.columns, sampleinfo)
    keep: list[str] = []
    for f in fields:
        calc = _calculated(f)
        if calc:
            hidden, name = calc[0].startswith("-"), calc[0].lstrip("-")
            for n, source in expand_calculated(df.columns, name, calc[1]):
                extra[n] = Compiler(df.schema, extra)(parse(source))
                if not hidden and n not in keep:
                    keep.append(n)
        elif f.startswith("-") and f[1:] not in df.columns:
            out = model.matching(df.columns, f[1:])
            keep += [c for c in df.columns if c not in out and c not in keep]
        else:
            found = model.matching(df.columns, f) or ([f] if f in extra else [])
            if not found:
                raise ValueError(f"no field {f}")
            keep += [c for c in found if c not in keep]
    return raw | extra, keep


def _sample_fields(columns: list[str], info: dict[str, dict[str, str]] | None) -> dict[str, Value]:
    """Attributes of samples as constants: attribute-sample, for the samples of a wide table."""
    out: dict[str, Value] = {}
    for s in model.samples(columns):
        for name, value in (info or {}).get(s, {}).items():
            out[f"{name}-{s}"] = Value(F.lit(value), "text", value)
    return out


def filter_rows(df: DataFrame, query: str, sampleinfo: dict[str, dict[str, str]] | None = None) -> DataFrame:
    return df.filter(predicate(df, query, sampleinfo))


def predicate(df: DataFrame, query: str, sampleinfo: dict[str, dict[str, str]] | None = None) -> Column:
    return truth(Compiler(df.schema, _sample_fields(df.columns, sampleinfo))(parse(query)))


def filter_by_table(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows that agree with any row of wanted in all of its columns (numbers by value, else as text)."""
    w = wanted.select(*[F.col(f"`{c}`").alias(f"_w{i}") for i, c in enumerate(wanted.columns)])
    if all(df.schema[c].dataType == wanted.schema[c].dataType for c in wanted.columns):
        cond = [df[f"`{c}`"] == w[f"_w{i}"] for i, c in enumerate(wanted.columns)]
        return df.join(w, cond, "left_semi")
    left = [_equality_key(of_type(df[f"`{c}`"], df.schema[c].dataType)) for c in wanted.columns]
    right = [_equality_key(of_type(w[f"_w{i}"], wanted.schema[c].dataType)) for i, c in enumerate(wanted.columns)]
    return df.join(w, [a == b for a, b in zip(left, right)], "left_semi")


def _equality_key(v: Value) -> Column:
    """Equal for values that == takes for equal, so that a join can hash it."""
    return F.coalesce(number(v).cast("double").cast("string"), F.concat(F.lit("t"), text(v)))


def sort_keys(df: DataFrame, keys: str | Iterable[str], reverse: bool = False) -> list[tuple[Column, bool, bool]]:
    """Each key as ordered takes it. Natural order: -f falling, =f as chromosomes, ~f both; - alone is the order of the
    roles."""
    names = split_fields(keys)
    if names == ["-"]:
        roles = model.resolve_roles(df.columns)
        have = [(roles.get(r) or (r if r in df.columns else None), r) for r in model.SORT_ROLES]
        names = [("=" if r == "chromosome" else "") + c for c, r in have if c]
    out = []
    for n in names:
        mark, name = (n[0], n[1:]) if n[0] in "-=~" and n not in df.columns else ("", n)
        c = model.col(name)
        natural = mark in ("=", "~") or of_type(c, df.schema[name].dataType).kind != "num"
        out.append((chr_clip(c) if mark in ("=", "~") else c, natural, (mark in ("-", "~")) != reverse))
    return out


def ordered(df: DataFrame, keys: list[tuple[Column, bool, bool]]) -> DataFrame:
    """df sorted by keys: a column, whether its order is natural, and whether it falls. Keys are columns while it is
    sorted: as expressions of the sort they would be made again for both rows of every comparison."""
    x = df.withColumns({f"_s{i}": c.cast("string") if natural else c for i, (c, natural, _) in enumerate(keys)})
    parts = {f"_s{i}": [f"_s{i}_{j}" for j in range(3)] * natural + [f"_s{i}"] for i, (_, natural, _) in enumerate(keys)}
    x = x.withColumns({n: c for k, names in parts.items() for n, c in zip(names[:-1], nat_columns(k))})
    return x.orderBy(*[F.col(n).desc() if down else F.col(n).asc() for names, (*_, down) in zip(parts.values(), keys) for n in names]).drop(*[n for names in parts.values() for n in names])


def sort(df: DataFrame, keys: str | Iterable[str] = "-", reverse: bool = False) -> DataFrame:
    return ordered(df, sort_keys(df, keys, reverse))


def select(
    df: DataFrame,
    fields: str | Iterable[str] | None = None,
    query: str | None = None,
    sort_by: str | Iterable[str] | None = None,
    reverse: bool = False,
    remove: str | Iterable[str] | None = None,
    samples: str | Iterable[str] | None = None,
    keep_order: bool = False,
    new_header: list[str] | None = None,
    sampleinfo: dict[str, dict[str, str]] | None = None,
) -> DataFrame:
    """Filter, project and sort in one plan. The query sees the fields that are calculated."""
    if samples:
        df = project_samples(df, samples)
    if fields:
        plan, keep = _resolve(df, split_fields(fields), sampleinfo)
        extra = {k: v for k, v in plan.items() if v.kind != "raw"}
    else:
        keep, extra = list(df.columns), _sample_fields(df.columns, sampleinfo)
        plan = {c: Value(model.col(c), "raw") for c in keep} | extra
    if remove:
        gone = {c for p in split_fields(remove) for c in model.matching(keep, p)}
        keep = [c for c in keep if c not in gone]
    if keep_order:
        keep = [c for c in df.columns if c in keep] + [c for c in keep if c not in df.columns]
    out = df
    if query:
        out = out.filter(truth(Compiler(df.schema, extra)(parse(query))))
    if sort_by:
        names = [n.lstrip("-=~") for n in split_fields(sort_by)]
        made = {n: output(extra[n]) for n in names if n in extra}
        if made:
            out = out.withColumns(made)
        out = sort(out, sort_by, reverse)
    out = out.select(*[output(plan[c]).alias(c) for c in keep])
    return out.toDF(*new_header) if new_header else out


def project_samples(df: DataFrame, patterns: str | Iterable[str]) -> DataFrame:
    """Columns of no sample, and those of the samples that match, sample by sample."""
    wanted = [s for p in split_fields(patterns) for s in model.matching(model.samples(df.columns), p)]
    plain = [c for c in df.columns if "-" not in c]
    own = [c for s in dict.fromkeys(wanted) for c in df.columns if model.sample_of(c) == s]
    return df.select(*[model.col(c) for c in plain + own])


def rename_samples(df: DataFrame, names: dict[str, str]) -> DataFrame:
    new = {c: c[: len(c) - len(s)] + names[s] for c in df.columns if (s := model.sample_of(c)) in names}
    return df.withColumnsRenamed(new)


def add_sampleinfo(df: DataFrame, info: DataFrame, key: str = "sample", attributes: list[str] | None = None) -> DataFrame:
    """Attributes of the sample of each row of a long table; rows of unknown samples stay."""
    ident = "id" if "id" in info.columns else "sample"
    attributes = attributes or [c for c in info.columns if c != ident and c not in df.columns]
    return df.join(info.select(F.col(ident).alias(key), *[model.col(a) for a in attributes]), key, "left")


def systematic_sample(df: DataFrame, skip: int, order: list[str]) -> DataFrame:
    """One row, then skip rows left out, and again."""
    return with_row(df, order, "_row").where(F.col("_row") % (skip + 1) == 0).drop("_row")


__all__ = ["add_sampleinfo", "filter_by_table", "filter_rows", "project", "project_samples", "rename_samples", "select", "sort", "systematic_sample", "with_row"]
