"""Quality rules: base counters of a text, and lines that too many documents of a host share.

A normalised line (A-Z lower-cased, white space runs as one space) is over the limit on a host when more of
the host's different texts hold it than both ``max_docs`` and ``max_share`` of them. Copies of a text count
once, so that a document isn't taken for boilerplate because it was crawled often. A document is depleted
when its lines below the limit hold less than ``min_left`` of its words. ``quality`` reports on the rows;
``keep_good`` drops those that are rejected and takes the lines over the limit out of the others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, drop_keys, guarded, materialise, only, with_key

MAX_DOCS, MAX_SHARE, MIN_LEFT = 30, 0.02, 0.5
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_SCHEMA = "_k long, doc_id long, host string, tid long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, sizes array<int>"


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def _line_hash(own: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(own)) - (1 << 63)


def without_lines(text: str, gone: set[int]) -> str:
    """text without the lines whose hashes are in gone."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return b"\n".join(x for x in lines if not (own := x.lower().split()) or _line_hash(own) not in gone).decode("utf-8", "surrogatepass")


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hashes of lines, their words. Null: no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, dups, hashes, sizes = set(), 0, [], []
    for line in raw.split(b"\n"):
        if own := line.lower().split():
            hashes.append(_line_hash(own))
            sizes.append(len(own))
            if line in seen:
                dups += 1
            seen.add(line)
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    return len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), dups, repeat_words(words), hashes, sizes


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(3).to_pylist()
        got = list(zip(*map(measure, texts))) or [[]] * 7
        tid = [xxhash.xxh64_intdigest(t or "") - (1 << 63) for t in texts]
        cols = [pa.array(c, pa.int64()) for c in got[:5]] + [pa.array(got[5], pa.list_(pa.int64())), pa.array(got[6], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(tid, pa.int64()), *cols], [x.split()[0] for x in _SCHEMA.split(", ")])


def _measured(keyed: DataFrame) -> DataFrame:
    cols = [F.col(c).cast(t).alias(c) for c, t in (("_k", "long"), ("doc_id", "long"), ("source", "string"), ("text", "string"))]
    return materialise(keyed.select(*cols).mapInArrow(_map, _SCHEMA))


def frequent_lines(measured: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """host, line of lines over the limit. Rows are combined before each shuffle, so a hot host is spread."""
    lines = measured.select("host", "tid", F.explode("lines").alias("line"))
    freq = lines.groupBy("host", "line").agg(F.countDistinct("tid").alias("n")).where(F.col("n") > max_docs)
    hosts = measured.groupBy(F.col("host").alias("h")).agg(F.countDistinct("tid").alias("docs"))
    return freq.join(hosts, freq["host"].eqNullSafe(hosts["h"])).where(F.col("n") > F.col("docs") * max_share).select("host", "line")


def _verdicts(measured: DataFrame, max_docs: int, max_share: float, min_left: float, lines: bool = False) -> DataFrame:
    """With lines, also gone_lines: the hashes of a row's lines over the limit."""
    over = materialise(frequent_lines(measured, max_docs, max_share)).withColumnRenamed("host", "h").withColumnRenamed("line", "l")
    each = measured.select("_k", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("_k", "host", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    gone = each.join(over, each["host"].eqNullSafe(over["h"]) & (each["line"] == over["l"])).groupBy("_k").agg(F.count(F.lit(1)).alias("lines_removed"), F.sum("size").alias("gone"), *([F.collect_set("line").alias("gone_lines")] if lines else []))
    base = measured.drop("lines", "sizes", "tid", "host").join(gone, "_k", "left").fillna(0, ["lines_removed", "gone"])
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return base.withColumn("base_failed", failed).withColumn("words_left", F.col("n_words") - F.col("gone")).withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= F.col("n_words") * F.lit(min_left)))


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of docs (doc_id, text, source): the counters, base_failed, lines_removed, words_left, kept.

    Null text: no words, so base_failed. Null source: a host of its own. Repeated rows are judged each, and
    count as one document in line frequencies. Null doc_id: kept as it is. Empty table: no rows. Other
    columns aren't read.
    """
    v = _verdicts(_measured(with_key(only(docs, "doc_id", "source", "text"))), max_docs, max_share, min_left)
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "words_left")


@guarded
def keep_good(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """docs without the rows that the rules reject, and without the lines over the limit in the text of the
    others; n_chars, where there is one, follows. Other columns as they are. Null or empty text is rejected, as it
    has no words; repeated rows get the same verdict, and equal texts of a host count once. Empty table: no rows."""
    keyed = with_key(docs)
    measured = _measured(keyed)
    verdicts = _verdicts(measured, max_docs, max_share, min_left, lines=True).select("_k", "kept", "gone_lines")
    verdicts = materialise(verdicts.where(~F.col("kept") | F.col("gone_lines").isNotNull()))
    discard(measured)
    bad, lines = verdicts.where(~F.col("kept")).select("_k"), verdicts.where("kept").select("_k", F.col("gone_lines").alias("_lines"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or x is None else without_lines(t, set(x)) for t, x in zip(text, lines)], dtype=object)

    out = drop_keys(keyed, bad).join(lines, "_k", "left").withColumn("text", cut(F.col("text").cast("string"), "_lines"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
often AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT j) AS n_repeat_words
        FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM often) GROUP BY k),
l AS (SELECT k, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT k, source, t, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM l),
ln AS (SELECT k, source, t, line, array_to_string(ws, ' ') AS norm, len(ws) AS size FROM lw WHERE len(ws) > 0),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY k),
freq AS (SELECT source, norm, count(DISTINCT t) AS n FROM ln GROUP BY source, norm HAVING count(DISTINCT t) > {max_docs}),
hosts AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
over_limit AS (SELECT f.source, f.norm FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > h.docs * {max_share}),
gone AS (SELECT ln.k, count(*) AS lines_removed, sum(ln.size) AS gone
         FROM ln JOIN over_limit o ON ln.source IS NOT DISTINCT FROM o.source AND ln.norm = o.norm GROUP BY ln.k),
b AS (SELECT w.k, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone.lines_removed, 0) AS BIGINT) AS lines_removed,
             CAST(len(ws) - coalesce(gone.gone, 0) AS BIGINT) AS words_left
      FROM w LEFT JOIN dup USING (k) LEFT JOIN rep USING (k) LEFT JOIN gone USING (k)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND words_left >= n_words * {min_left}) AS kept, lines_removed, words_left
FROM f
""".format(max_docs=MAX_DOCS, max_share=MAX_SHARE, min_left=MIN_LEFT)
