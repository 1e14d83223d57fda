"""Annotation by databases: what a database is follows from its name, what it gives from its parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame

from .. import model
from . import effects, intervals, variants
from .intervals import BIN

KINDS = ("reg", "var", "sv", "gene", "mir", "bcol")
#: Columns that are taken where the parameters name none, as far as the database has them.
DEFAULTS = {"reg": ("name", "name2", "score", "freq"), "var": ("name", "freq", "freqp", "id", "score"), "sv": ("name", "freq", "id", "score")}


@dataclass
class Database:
    """kind and name as describe() finds them; fields: given by the parameters."""

    table: DataFrame
    kind: str
    name: str
    fields: list[str] = field(default_factory=list)


def parse_parameters(lines: list[str]) -> dict[str, str]:
    """key<TAB>value lines of a database's .opt file."""
    return dict(x.split("\t", 1) for x in lines if "\t" in x and not x.startswith("#"))


def describe(path: str, table: DataFrame, parameters: list[str] | None = None) -> Database:
    """A database from its file's name: what stands before the first underscore is its kind (a region database if
    it is none), what follows the last the base of new columns, unless parameters say otherwise."""
    file = PurePosixPath(path).name
    stem = re.sub(r"\.(tsv|bcol)?(\.(gz|bgz|zst|lz4|bz2))?$", "", file)
    kind = "bcol" if ".bcol" in file else stem.split("_", 1)[0]
    options = parse_parameters(parameters or [])
    return Database(table, kind if kind in KINDS else "reg", options.get("name", stem.rsplit("_", 1)[-1]), options.get("fields", "").split())


def annotate(df: DataFrame, databases: list[Database], near: int | None = None, genome: DataFrame | None = None, upstream: int = 2000, replace: str = "e", bin_size: int = BIN, **limits) -> DataFrame:
    """df with the columns of all databases, one after another. A database of one field gives a column of its name,
    of several name_field each. replace: what to do with columns that are there: e (an error), n (keep), a (replace)."""
    for d in databases:
        fields = d.fields or [c for c in DEFAULTS.get(d.kind, ()) if c in d.table.columns]
        new = {f: d.name if len(fields) == 1 else f"{d.name}_{f}" for f in fields}
        made = list(new.values()) if d.kind in DEFAULTS else [d.name] if d.kind == "bcol" else [f"{d.name}_{k}" for k in (("impact", "gene", "descr") if d.kind == "gene" else ("impact", "mir"))]
        taken = [c for c in made if c in df.columns]
        if taken and replace == "e":
            raise ValueError(f"there already: {', '.join(taken)}")
        if taken and replace == "n":
            continue
        df = df.drop(*taken)
        # names of its own keep the fields apart from those of df
        table = d.table.select(*[model.col(c).alias(f"_db_{c}" if c in fields else c) for c in d.table.columns])
        own = [f"_db_{f}" for f in fields]
        if d.kind == "reg":
            got = intervals.annotate_regions(df, table, own, bin_size) if near is None else intervals.nearest(df, table, near, own, bin_size).withColumnRenamed("dist", f"{d.name}_dist")
        elif d.kind == "var":
            got = variants.annotate_variants(df, table, own)
        elif d.kind == "sv":
            got = variants.annotate_sv(df, table, own, bin_size, **limits).drop("distance")
        elif d.kind == "bcol":
            got = variants.annotate_positions(df, table.withColumnRenamed("value", "_db_value"), "_db_value", 0, bin_size).withColumnRenamed("_db_value", d.name)
        elif d.kind == "gene":
            got = effects.annotate_effects(df, d.table, genome, upstream, bin_size=bin_size) if genome is not None else variants.annotate_genes(df, d.table, upstream, bin_size=bin_size)
            got = got.withColumnsRenamed({f"gene_{k}": f"{d.name}_{k}" for k in ("impact", "gene", "descr")})
        else:
            got = effects.annotate_mir(df, d.table, upstream, bin_size=bin_size).withColumnsRenamed({f"mir_{k}": f"{d.name}_{k}" for k in ("impact", "mir")})
        df = got.withColumnsRenamed({f"_db_{f}": n for f, n in new.items()})
    return df
