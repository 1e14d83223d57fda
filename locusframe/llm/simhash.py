"""SimHash near-duplicates by generalised pigeonhole.

Two 64-bit fingerprints within distance t agree, on some part i of a split of the bits into m parts, up to
t_i bits, whenever the t_i add up to t - m + 1. Correlated bits are put into the same part, and the t_i
are allocated by dynamic programming on the estimated cost of candidates and probes. Every part value is
indexed once; a probe looks up all values within t_i of its own. Pairs are verified in the join itself, and
each is counted in the first part that finds it, so no pair has to be made distinct afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, drop_keys, guarded, join_classes, materialise, only, with_key

BITS = 64
#: Fingerprints looked at to estimate costs; results don't depend on it.
PLAN_SAMPLE = 2048
#: Cost of one probe row against that of one candidate in the join.
PROBE_COST = 12.0


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both concern ASCII only
    if not words:
        return 0
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        cut = map(joined.__getitem__, map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), np.uint64, len(words) - width + 1)
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _map_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for each row of docs. A null text counts as empty; repeated rows stay apart."""
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_map_fingerprints, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """Split the bit numbers into m parts of like size, correlated ones together."""
    with np.errstate(all="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(bits.T.astype(float)))) if len(bits) > 1 else np.zeros((BITS, BITS))
    left, parts = list(range(BITS)), []
    for i in range(m):
        size = BITS * (i + 1) // m - BITS * i // m
        part = [left.pop(0)]
        while len(part) < size:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            left.remove(best)
            part.append(best)
        parts.append(sorted(part))
    return parts


def plan(sample: np.ndarray, n: int, threshold: int) -> list[tuple[int, int]]:
    """(mask, t_i) of each part, those that need no probe left out."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    half = max(1, len(sample) // 2)
    xor = (sample[:half, None] ^ sample[None, half:]).reshape(-1) if len(sample) > 1 else np.zeros(0, np.int64)
    best: tuple[float, list[tuple[int, int]]] | None = None
    for m in range(1, threshold + 3):
        parts = _group_bits(bits, m)
        masks = [sum(1 << b for b in p) for p in parts]
        total = threshold - m + 1
        cost = []
        for p, mask in zip(parts, masks):
            near = _popcount(xor & np.int64(mask - (1 << 64) if mask >> 63 else mask))
            row = [0.0]  # t_i = -1: left out
            probes = 0
            for t in range(threshold + 1):
                probes += comb(len(p), t)
                share = max((near <= t).mean() if len(near) else 0.0, probes / 2.0 ** len(p))
                row.append(n * probes * PROBE_COST + float(n) * n * share if probes <= 5000 else float("inf"))
            cost.append(row)
        # reach[s]: least cost with the parts so far and thresholds, each from -1, adding up to s - parts
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in reach.items():
                for t in range(-1, threshold + 1):
                    if (v := c + row[t + 1]) < nxt.get(s + t + 1, (float("inf"),))[0]:
                        nxt[s + t + 1] = (v, [*chosen, t])
            reach = nxt
        c, chosen = reach.get(total + m, (float("inf"), []))
        if chosen and (best is None or c < best[0]):
            best = (c, [(mask, t) for mask, t in zip(masks, chosen) if t >= 0])
    assert best
    return best[1]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(parts: list[tuple[int, int]], variants: bool) -> F.Column:
    rows = []
    for i, (mask, t) in enumerate(parts):
        bits = [1 << b for b in range(BITS) if mask >> b & 1]
        for k in range(t + 1 if variants else 1):
            for flip in combinations(bits, k):
                rows.append(f"struct({i} as part, {_literal(_long(mask))} as mask, {_literal(_long(sum(flip)))} as flip)")
    return F.expr("array(" + ", ".join(rows) + ")")


def _literal(x: int) -> str:
    return f"{x}L" if x != -(1 << 63) else "(-9223372036854775807L - 1L)"


def links(distinct: DataFrame, threshold: int = 4) -> DataFrame:
    """x, y, w for each ordered pair of different fingerprints (fp, w) within threshold bits; w belongs to y."""
    sample = np.array([r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()], dtype=np.int64)
    n = distinct.count()
    parts = plan(sample, n, threshold)
    cut = lambda alias, variants: distinct.select("fp", "w", F.explode(_keys(parts, variants)).alias("v")).select(
        F.col("fp").alias(alias), F.col("w").alias(f"w_{alias}"), F.col("v.part").alias("part"), (F.col("fp").bitwiseAND(F.col("v.mask"))).bitwiseXOR(F.col("v.flip")).alias("key")
    )
    a, b = cut("x", True), cut("y", False)
    diff = F.col("x").bitwiseXOR(F.col("y"))
    ok = (a["part"] == b["part"]) & (a["key"] == b["key"]) & (F.col("x") != F.col("y")) & (F.bit_count(diff) <= threshold)
    for j, (mask, t) in enumerate(parts[:-1]):
        ok = ok & ((a["part"] <= j) | (F.bit_count(diff.bitwiseAND(F.expr(_literal(_long(mask))))) > t))
    return a.join(b, ok).select("x", "y", F.col("w_y").alias("w"))


def near_duplicates(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """doc_id, fingerprint, n_near, component_id for each row of docs.

    Null text: empty. No words: fingerprint zero, linked like any other. A null doc_id keeps its row and is
    passed over in component_id unless its component has no other. Repeated rows count as copies of each
    other. Empty table: no rows. Other columns are not read.
    """
    f = materialise(fingerprints(docs))
    d = f.groupBy("fp").agg(F.count(F.lit(1)).alias("w"), F.min("doc_id").alias("least"))
    pairs = materialise(links(d, threshold))
    near = pairs.groupBy(F.col("x").alias("fp")).agg(F.sum("w").alias("near"))
    comp = components(pairs.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    per = d.join(near, "fp", "left").join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "w", "least", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("component", "fp").alias("component"))
    per = materialise(per)
    discard(pairs, comp)
    ids = per.groupBy("component").agg(F.min("least").alias("component_id"))
    each = materialise(per.join(ids, "component").select("fp", "w", (F.col("near") + F.col("w") - 1).alias("n_near"), "component_id"))
    discard(per)
    return join_classes(f, each, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id")


@guarded
def keep_one(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """docs with one row of each component left: that of the smallest doc_id (nulls last), of repeated ids
    the first in the order of the input. Columns are those of docs, of any names."""
    keyed = with_key(docs)
    fps = materialise(keyed.select(F.col("_k"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_map_keyed, "_k long, id long, fp long"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_k"))
    d = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("w"), first.alias("first"))
    pairs = materialise(links(d, threshold))
    comp = components(pairs.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    best = (
        d.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left")
        .groupBy(F.coalesce("component", "fp").alias("component"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first._k").alias("_k"))
    )
    extra = materialise(fps.join(best, "_k", "left_anti").select("_k"))
    discard(pairs, comp, fps)
    return drop_keys(keyed, extra).drop("_k")


def _map_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([fingerprint(t.as_py()) for t in b.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], ["_k", "id", "fp"])
