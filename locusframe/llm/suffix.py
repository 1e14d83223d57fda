"""Removal of repeated byte strings by bucket-pointer refinement.

Buckets hold starts whose first bytes are equal, and a start's pointer names its bucket. A bucket is refined by
sorting it on the pointers at a later offset: pointers of depth d at an offset of d give depth 2 d, and those are
read again in the next round. Starts that are alone are done. What agrees to a depth of LENGTH bytes is repeated.

That is done twice, as a row for each byte of a corpus can't be sorted across tasks:

1. Across tasks, for stretches of starts. A string of LENGTH bytes is filed under the least of the q-grams inside
   it (hashes order them, the leftmost of equal ones counts), so equal strings meet in one bucket at the same
   offset. Starts with the same least q-gram are neighbours and go as one range (lo, n) with the bytes around it,
   its context. Initial buckets: ranges by the pointer of their q-gram; a bucket of one range is dropped.
   Pointers of depth 2 q and 4 q are made of those at later offsets, and a bucket is refined by the pointers
   of depth 4 q that cover the whole context. Ranges that agree in them are repeated as a whole; most copies
   are settled here, without any text being moved. Pointers are hashes here, 64 bits for the q-gram and 64 for
   the context, and both have to agree.
2. In a task, for single starts. Where contexts of a bucket differ somewhere (at the ends of a repeated passage),
   one range of each is read from its text, and the positions of all contexts are refined by their bytes:
   initial buckets by 8 bytes, then depths of 16, 32, 64, 128 and LENGTH (`refine`), exactly. What a context
   learns is used by all ranges that have it. Buckets of very many contexts are refined by a shuffle on two
   identifiers of each start instead of in one task; both give the same result.

Texts travel compressed, and only to where their spans or contexts are wanted.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import discard, guarded, materialise, only, with_key

LENGTH, Q = 200, 48
#: Contexts of one bucket that a task compares by itself; larger buckets are refined by a shuffle.
HOT = 2_000
_SEGMENT = 1 << 18
_POS = np.uint64((1 << 20) - 1)
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 8 + 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * _SEGMENT)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64)))) for b in (_BASE % (1 << 64), pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _join(ids: np.ndarray, depth: int) -> np.ndarray:
    """Pointers of twice the depth, from those of the depth here and at the offset of the depth."""
    out = ids[:-depth] * _MIX
    out ^= out >> np.uint64(29)
    out += ids[depth:] * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _power(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def ranges(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, q: int = Q) -> list[np.ndarray]:
    """text number, lo (in the text), n, bucket, context of all starts in texts
    that lie one after another in data, offsets[i] to offsets[i + 1]."""
    w, found = length - q + 1, []
    begin, end = int(offsets[0]), int(offsets[-1])
    while begin < end:
        stop = begin + _SEGMENT
        if stop >= end:
            stop = end
        elif (edge := int(offsets[np.searchsorted(offsets, stop, "right") - 1])) > begin:
            stop = edge  # else a text longer than a segment: its ranges are cut here, which step 3 makes good
        part = data[begin : min(end, stop + length - 1)]
        if len(part) >= length:
            found.append(_segment(part, begin, stop - begin, offsets, length, q, w))
        begin = stop
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5


def _segment(part: np.ndarray, begin: int, most: int, offsets: np.ndarray, length: int, q: int, w: int) -> tuple[np.ndarray, ...]:
    _, down = _power(len(part) + 1)
    sums = _sums(part)
    grams = _mix((sums[q:] - sums[:-q]) * down[: len(part) - q + 1])
    key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    low, have = key, 1
    while have < w:
        step = min(have, w - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    starts = min(most, len(low))
    at = (low[:starts] & _POS).astype(np.int64)
    # texts of this segment, and the starts that stay within theirs
    first, last = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, begin + starts, "left")
    edges = offsets[first : last + 1] - begin
    own = np.repeat(np.arange(first, last), np.diff(np.clip(edges, 0, starts)))
    ok = np.arange(starts) + length <= edges[own - first + 1]
    new = np.ones(starts, bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | ~ok[:-1]
    lo = np.flatnonzero(new & ok)
    stops = np.flatnonzero(np.concatenate((new | ~ok, [True])))
    n = stops[np.searchsorted(stops, lo, "right")] - lo
    p = at[lo]
    last = lo + n - 1 + length
    depth, ids = q, grams
    while 2 * depth <= length:
        ids = _join(ids, depth)
        depth *= 2
    context = _mix((n * 4096 + (p - lo)).astype(np.uint64))
    for k in range(-(-(length + w - 1) // depth)):
        context = _mix(context + ids[np.minimum(lo + k * depth, last - depth)])
    return own[lo], lo + begin - offsets[own[lo]], n, grams[p].view(np.int64), context.view(np.int64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each begins, without a copy."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def _map_ranges(length: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = _texts(b.column(1))
            own, lo, n, bucket, context = ranges(data, off, length, q)
            k = b.column(0).to_numpy(zero_copy_only=False)[own] if len(own) else own
            cols = [pa.array(k, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(bucket), pa.array(context)]
            yield pa.RecordBatch.from_arrays(cols, ["_k", "lo", "n", "h", "c"])

    return run


def _window_ids(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two identifiers of the length bytes at each start."""
    sums, (_, down) = _sums(data), _power(len(data) + 1)
    ids = _mix((sums[length:] - sums[:-length]) * down[: len(sums) - length])
    depth = 1
    second = _TABLE[data]
    while 2 * depth <= length:
        second = _join(second, depth)
        depth *= 2
    return ids, _mix(second[: len(ids)] + _mix(second[length - depth :]))


def refine(data: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of length bytes at each position of data occurs at another position as well, within
    the texts off[i] to off[i + 1]; False where a text is over sooner. By bucket-pointer refinement: a pointer
    is the place in the suffix order where the bucket begins."""
    size = len(data)
    twice = np.zeros(size, bool)
    if size < length:
        return twice
    room = np.repeat(off[1:], np.diff(off)) - np.arange(size)  # bytes from here to the end of the text
    depth = 1
    key = data.astype(np.uint64)
    while 2 * depth <= min(8, length):  # the bytes themselves are the first pointers
        key[:-depth] = (key[:-depth] << np.uint64(8 * depth)) | key[depth:]
        depth *= 2
    active = np.flatnonzero(room >= depth)
    pointer = np.zeros(size, np.uint64)
    base = np.zeros(len(active), np.uint64)
    key = key[active]
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(order)))
        group = np.repeat(starts, sizes)
        where = active[order]
        if depth == length:
            twice[where] = np.repeat(sizes > 1, sizes)
            return twice
        b = base[order]
        head = np.concatenate(([True], b[1:] != b[:-1]))
        first = np.repeat(np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), len(order))))
        pointer[where] = b + (group - first).astype(np.uint64)
        # the next round: what isn't alone, by the pointers of this depth at a later offset
        step = min(depth, length - depth)
        active = np.sort(where[np.repeat(sizes > 1, sizes)])
        active = active[room[active] >= depth + step]
        if not len(active):
            return twice
        base = pointer[active]
        key = (base << np.uint64(32)) | pointer[active + step]
        depth += step


def _runs(flags: np.ndarray) -> list[int]:
    """First and last + 1 of each run of flags, one after another."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()


def _compare(t: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The runs of repeated starts of each context, in a batch of whole buckets."""
    data, off = _texts(t.column("bytes"))
    twice = refine(data[off[0] : off[-1]], off - off[0], length)
    n = t.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    at = (off - off[0]).tolist()
    # a context of repeated text has many runs, others have one or two
    runs = [_runs(twice[a : a + k]) for a, k in zip(at, n.tolist())]
    return pa.RecordBatch.from_arrays([t.column("h"), t.column("c"), pa.array(runs, pa.list_(pa.int32()))], ["h", "c", "runs"])


def _map_compare(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def each(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Some hundred contexts at once (a position takes about 90 bytes), never a part of a bucket."""
            h = t.column("h").to_numpy()
            edges = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            first = 0
            for e, following in zip(edges[1:], [*edges[2:], len(h) + 1000]):
                if following - first > 1000:
                    yield _compare(t.slice(first, e - first), length)
                    first = e

        def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for b in batches:  # sorted by h: all but the last bucket of what is held are complete
            if not b.num_rows:
                continue
            held.append(b)
            if held[0].column("h")[0].as_py() == b.column("h")[-1].as_py():
                continue
            t = whole(held)
            h = t.column("h").to_numpy()
            cut = len(h) - int(np.argmax(h[::-1] != h[-1]))
            yield from each(t.slice(0, cut))
            held = [t.slice(cut)]
        if held:
            yield from each(whole(held))

    return run


def _map_starts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                t = b.slice(i, 2000)
                data, off = _texts(t.column("bytes"))
                n = t.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                a, z = (x[off[row] - off[0] + start] for x in _window_ids(data[off[0] : off[-1]], length))
                cols = [t.column("h").take(pa.array(row)), t.column("c").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(z.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["h", "c", "start", "id", "id2"])

    return run


def _squeezed(df: DataFrame, text: str) -> DataFrame:
    """df with the text column as compressed bytes and its size (_size, null for null) last, for a shuffle."""
    at = df.columns.index(text)
    schema = StructType([f if f.name != text else StructField(text, BinaryType()) for f in df.schema.fields]).add("_size", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            raw = [x.as_buffer() if x.is_valid else None for x in b.column(at)]
            cols = list(b.columns)
            cols[at] = pa.array([None if x is None else codec.compress(x, asbytes=True) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([None if x is None else x.size for x in raw], pa.int32())], [*b.schema.names, "_size"])

    return df.mapInArrow(run, schema)


_CODEC = pa.Codec("zstd")


def _text(squeezed: bytes | None, size: int | None) -> bytes:
    return b"" if not size else _CODEC.decompress(squeezed, decompressed_size=size, asbytes=True)


def _map_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts named in wanted, cut out of their text."""
    for b in batches:
        h, c, n, out = [], [], [], []
        for text, size, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = memoryview(_text(text, size))
            for x in wanted.as_py():
                h.append(x["h"]), c.append(x["c"]), n.append(x["n"])
                out.append(bytes(raw[x["lo"] : x["lo"] + x["n"] + x["more"]]))
        cols = [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int16()), pa.array(out, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["h", "c", "n", "bytes"])


def repeated_spans(keyed: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """_k, spans (array of struct of s and e) of the texts (_k, text) that hold bytes to remove, as a written
    table. Spans may overlap and touch."""
    texts = keyed.select("_k", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    r = materialise(texts.mapInArrow(_map_ranges(length, q), "_k long, lo int, n short, h long, c long"))
    buckets = r.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("m > 1").select("h", (F.col("c0") == F.col("c1")).alias("same"))
    met = materialise(r.join(buckets, "h"))
    discard(r)
    differ = met.where("not same")
    contexts = materialise(differ.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("_k", "lo", "n")).alias("x")))
    wanted = contexts.groupBy(F.col("x._k").alias("_k")).agg(F.collect_list(F.struct("h", "c", "x.lo", "x.n", F.lit(length - 1).alias("more"))).alias("wanted"))
    cut = _squeezed(texts, "text").join(wanted, "_k").select("text", "_size", "wanted").mapInArrow(_map_cut, "h long, c long, n short, bytes binary")
    many = contexts.groupBy("h").count().where(F.col("count") > hot).select("h")
    cut = materialise(cut)
    many = materialise(many)
    some = many.count() > 0
    cold = cut.join(many, "h", "left_anti") if some else cut
    runs = cold.repartition("h").sortWithinPartitions("h").mapInArrow(_map_compare(length), "h long, c long, runs array<int>").where(F.size("runs") > 0)
    spans = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct(F.element_at("runs", i + 1).alias("a"), F.element_at("runs", i + 2).alias("z")))
    found = runs.select("h", "c", F.explode(spans).alias("v")).select("h", "c", "v.a", "v.z")
    if some:
        each = cut.join(many, "h", "left_semi").mapInArrow(_map_starts(length), "h long, c long, start int, id long, id2 long")
        twice = each.groupBy("h", "id", "id2").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        found = found.union(each.join(twice, ["h", "id", "id2"]).select("h", "c", F.col("start").alias("a"), (F.col("start") + 1).alias("z")))
    full = met.where("same").select("_k", "lo", F.col("n").cast("int").alias("n"))
    copies = contexts.where("m > 1").select("h", "c")
    full = full.union(differ.join(copies, ["h", "c"]).select("_k", "lo", F.col("n").cast("int")))
    full = full.select("_k", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + length).alias("e"))
    part = differ.join(found, ["h", "c"]).select("_k", (F.col("lo") + F.col("a")).alias("s"), (F.col("lo") + F.col("z") - 1 + length).alias("e"))
    out = materialise(full.union(part).groupBy("_k").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    discard(met, contexts, cut, many)
    return out


def _merged(spans: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _kept(raw: bytes, runs: list[list[int]]) -> bytes:
    at, parts = 0, []
    for s, e in runs:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def _map_report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, size, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            raw, runs = _text(text, size), _merged(spans.as_py())
            rows.append((len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()))
        size, removed, runs, sha = list(zip(*rows)) or [()] * 4
        cols = [b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Every byte covered by a string of length bytes that also starts anywhere else is removed, strings judged
    on the input. Null text: empty. Repeated rows are copies of each other and lose all they have, if they
    are long enough. A null doc_id is passed on. Empty table: no rows. Other columns aren't read.
    """
    keyed = with_key(only(docs, "doc_id", "text"))
    spans = repeated_spans(keyed, length, q, hot)
    rows = _squeezed(keyed.select("_k", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text").join(spans, "_k", "left")
    return rows.select("doc_id", "text", "_size", "spans").mapInArrow(_map_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@guarded
def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """docs with the repeated bytes gone from text; n_chars, where there is one, follows. No row is dropped.
    A character that is cut in the middle goes too, as text has to stay text. Null text stays null, an empty one
    empty; repeated rows lose all they have, if they are long enough. Empty table: no rows."""
    keyed = with_key(docs)
    spans = repeated_spans(keyed, length, q, hot).withColumnRenamed("spans", "_spans")

    @F.pandas_udf("string")
    def cut(text: pd.Series, size: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _kept(_text(t, int(n)), _merged(list(s) if s is not None else None)).decode("utf-8", "ignore") for t, n, s in zip(text, size, spans)], dtype=object)

    squeezed = _squeezed(keyed.withColumn("text", F.col("text").cast("string")), "text")
    out = squeezed.join(spans, "_k", "left").withColumn("text", cut("text", "_size", "_spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


#: The rows of report() of a table documents (doc_id, text) in DuckDB: every string of 200 bytes is listed.
SQL = """WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, unnest(range(0, length(h) // 2 - 199)) AS s, h FROM d WHERE length(h) >= 400), i AS (SELECT k, s, md5_number(substr(h, 2 * s + 1, 400)) AS m FROM w),
twice AS (SELECT m FROM i GROUP BY m HAVING count(*) > 1), r AS (SELECT k, s FROM i JOIN twice USING (m)),
e AS (SELECT k, s, CASE WHEN s <= lag(s) OVER (PARTITION BY k ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM r), g AS (SELECT k, s, sum(new) OVER (PARTITION BY k ORDER BY s) AS run FROM e),
spans AS (SELECT k, run, min(s) AS a, max(s) + 200 AS z FROM g GROUP BY k, run),
pieces AS (SELECT k, z AS a, lead(a) OVER (PARTITION BY k ORDER BY a) AS z FROM spans UNION ALL SELECT k, 0, min(a) FROM spans GROUP BY k),
kept AS (SELECT k, string_agg(CASE WHEN p.z IS NULL THEN substr(h, 2 * p.a + 1) ELSE substr(h, 2 * p.a + 1, 2 * (p.z - p.a)) END, '' ORDER BY p.a) AS h FROM pieces p JOIN d USING (k) GROUP BY k),
n AS (SELECT k, CAST(sum(z - a) AS BIGINT) AS removed, count(*) AS spans FROM spans GROUP BY k)
SELECT CAST(doc_id AS BIGINT) AS doc_id, length(d.h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n.spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN n USING (k) LEFT JOIN kept USING (k)"""
