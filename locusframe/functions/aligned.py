"""Sequence of a read over a stretch of the reference, by its CIGAR string. Arrow batches: no native function walks a CIGAR."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

_OP = re.compile(r"(\d+)([MIDNSHP=X])")


def aligned(begin: int, cigar: str, seq: str, start: int, stop: int, insertions: bool = False) -> str:
    """Bases of [start, stop); - if all of it is deleted; empty if the read doesn't reach it."""
    at, read, out, touched = begin, 0, [], False
    for n, op in ((int(n), op) for n, op in _OP.findall(cigar or "")):
        if op in "M=X":
            a, z = max(at, start), min(at + n, stop)
            if a < z:
                out.append(seq[read + a - at : read + z - at])
                touched = True
            at, read = at + n, read + n
        elif op in "DN":
            touched |= max(at, start) < min(at + n, stop)
            at += n
        elif op in "IS":
            if op == "I" and start < at < stop or op == "I" and insertions and start <= at <= stop:
                out.append(seq[read : read + n])
            read += n
    return "".join(out) or ("-" if touched else "")


def alignedseq(begin, cigar, seq, start: int, stop: int, insertions: bool = False):
    @F.pandas_udf("string")
    def run(b: pd.Series, c: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else aligned(int(x), y, z or "", start, stop, insertions) for x, y, z in zip(b, c, s)], dtype=object)

    return run(begin, cigar, seq)
