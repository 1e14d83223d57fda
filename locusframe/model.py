"""Roles of columns by their names, and names of samples and analyses in wide tables."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALIASES: dict[str, tuple[str, ...]] = {
    "chromosome": ("chromosome", "chrom", "chr", "chr1", "genoName", "tName", "contig"),
    "begin": ("begin", "start", "end1", "chromStart", "genoStart", "tStart", "txStart", "pos", "offset"),
    "end": ("end", "start2", "chromEnd", "genoEnd", "tEnd", "txEnd"),
    "type": ("type",),
    "ref": ("ref", "reference"),
    "alt": ("alt", "alternative"),
    "strand": ("strand",),
}
SORT_ROLES = ("chromosome", "begin", "end", "type", "alt", "strand", "exonStarts", "exonEnds", "cdsStart", "cdsEnd")


class RoleError(ValueError):
    """A table lacks a column that an operator needs."""


def resolve_roles(columns: list[str], needed: tuple[str, ...] = ()) -> dict[str, str]:
    """Role -> column name, by alias in order of preference."""
    found = {role: next(c for c in names if c in columns) for role, names in ALIASES.items() if any(c in columns for c in names)}
    if missing := [r for r in needed if r not in found]:
        raise RoleError(f"no column for {', '.join(missing)} among {', '.join(columns)}")
    return found


def make_regular(df: DataFrame) -> DataFrame:
    """Role columns under their canonical names and first."""
    roles = resolve_roles(df.columns)
    rest = [c for c in df.columns if c not in roles.values()]
    return df.select(*[F.col(f"`{c}`").alias(r) for r, c in roles.items()], *[F.col(f"`{c}`") for c in rest])


def sample_of(column: str) -> str | None:
    """What follows the last - of a column name."""
    return column.rsplit("-", 1)[1] if "-" in column else None


def analysis_of(column: str) -> str | None:
    """What follows the first - of a column name."""
    return column.split("-", 1)[1] if "-" in column else None


def samples(columns: list[str]) -> list[str]:
    return list(dict.fromkeys(s for c in columns if (s := sample_of(c)) is not None))


def analyses(columns: list[str]) -> list[str]:
    return list(dict.fromkeys(a for c in columns if (a := analysis_of(c)) is not None))


def matching(columns: list[str], pattern: str) -> list[str]:
    return [c for c in columns if fnmatchcase(c, pattern)] if any(x in pattern for x in "*?[") else [c for c in columns if c == pattern]


def col(name: str):
    return F.col("`" + name.replace("`", "``") + "`")
