"""Tab-separated files with comments and a header line.

Only the head of a file is read on the driver, to find the header; rows are read by Spark. Fields are text,
as in the files; ``typed`` casts them by a type table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model

#: Lines at the head of a file that are looked at for comments and header at first; more if there are more comments.
HEAD = 10_000
#: Formats that Spark's own codecs don't read by their ending.
UNPACKED_HERE = (".zst", ".bgz")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) of text files, whatever packs them. A file packed with zstd or bgzip is unpacked by one
    task, as a stream."""
    path = str(path)
    if path.endswith(".rz"):
        raise ValueError("unpack .rz first: there is no public codec for it")
    if not path.endswith(UNPACKED_HERE):
        return spark.read.text(path)
    zst = path.endswith(".zst")

    def unpack(batches: Iterator) -> Iterator:
        import gzip
        import io

        import pyarrow as pa

        for b in batches:
            for raw in b.column(0):
                packed = io.BytesIO(raw.as_py())
                if zst:
                    import zstandard

                    stream = zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True)
                else:
                    stream = gzip.open(packed)
                part: list[str] = []
                size = 0
                for line in io.TextIOWrapper(stream, "utf-8", newline="\n"):
                    part.append(line.removesuffix("\n"))
                    size += len(line)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["value"])
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "value string")


def head_lines(spark: SparkSession, path: str, n: int = HEAD) -> list[str]:
    """The first lines of the first file, as many as it takes to meet one that is no comment."""
    while True:
        found = [r[0] for r in lines(spark, path).limit(n).collect()]
        if len(found) < n or not all(x.startswith("#") for x in found):
            return found
        n *= 8


def parse_comments(lines: list[str]) -> dict[str, list[str]]:
    """#key<TAB>value lines; values of repeated keys in order."""
    out: dict[str, list[str]] = {}
    for line in lines:
        key, _, value = line.lstrip("#").partition("\t")
        out.setdefault(key.strip(), []).append(value)
    return out


def find_header(lines: list[str], header_in_comment: bool = False) -> tuple[list[str], list[str], int]:
    """Comments, header and the number of lines before the data. A header may begin with # (VCF: #CHROM, or
    with header_in_comment the last comment) or >."""
    comments = []
    for i, line in enumerate(lines):
        if line.startswith("#CHROM\t"):
            return comments, line[1:].split("\t"), i + 1
        if line.startswith("#"):
            comments.append(line)
            continue
        if header_in_comment and comments:
            return comments[:-1], comments[-1].lstrip("#").split("\t"), i
        if line.startswith(">"):
            line = line[1:]
        return comments, line.split("\t"), i + 1
    return (comments[:-1], comments[-1].lstrip("#").split("\t"), len(lines)) if comments else ([], [], 0)


def read_tsv(spark: SparkSession, path: str, header: list[str] | None = None, header_in_comment: bool = False, header_file: str | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """All rows as text columns. Comment lines and the header line are left out wherever they stand, so that
    several files of one header can be read at once. Short rows get nulls at their end, spare fields go.
    Comments are in df.comments."""
    comments, found, _ = find_header(head_lines(spark, path), header_in_comment)
    if header_file:
        found = find_header(head_lines(spark, header_file))[1]
    names = _unique(header or found)
    own = "\t".join(found)
    body = lines(spark, path).where(~F.col("value").startswith("#") | (F.col("value") == ""))
    if not header and not header_file and not header_in_comment:
        body = body.where((F.col("value") != own) & (F.col("value") != ">" + own))
    parts = F.split("value", "\t", -1)
    df = body.select(parts.alias("_p")).select(*[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if types:
        df = typed(df, types)
    df.comments = parse_comments(comments)
    return df


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Integer, Float, String; a cell that is none of its type is null."""
    kinds = {"Integer": "bigint", "Float": "double", "String": "string"}
    return df.select(*[model.col(c).try_cast(kinds.get(types[c], types[c])).alias(c) if c in types else model.col(c) for c in df.columns])


def write_tsv(df: DataFrame, path: str, comments: list[str] | None = None, header: bool = True, compression: str | None = None, single: bool = False) -> None:
    """Text files with the header (and comments) in each. NaN and null are written as NaN and empty."""
    texts = [F.coalesce(model.col(c).cast("string"), F.lit("")) for c in df.columns]
    body = df.select(F.concat_ws("\t", *texts).alias("value"))
    body = body.coalesce(1) if single else body
    top = [*(comments or []), *(["\t".join(df.columns)] if header else [])]

    def with_top(batches):
        import pyarrow as pa

        if top:
            yield pa.RecordBatch.from_arrays([pa.array(top, pa.string())], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    out = body.mapInArrow(with_top, "value string")
    w = out.write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def check_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Lines whose number of fields isn't that of the header: value, fields."""
    comments, names, _ = find_header(head_lines(spark, path))
    n = F.size(F.split("value", "\t", -1))
    return spark.read.text(path).where(~F.col("value").startswith("#")).select("value", n.alias("fields")).where(F.col("fields") != len(names))


def fix_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows as wide as the header: short ones get empty fields at their end, spare fields go; a field whose name
    is there already is left out."""
    _, names, _ = find_header(head_lines(spark, path))
    own = "\t".join(names)
    parts = F.split("value", "\t", -1)
    keep = [i for i, n in enumerate(names) if n not in names[:i]]
    body = lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != own))
    return body.select(parts.alias("_p")).select(*[F.coalesce(F.get("_p", F.lit(i)), F.lit("")).alias(names[i]) for i in keep])


def add_columns(df: DataFrame, names: list[str], default: str = "") -> DataFrame:
    """df with the columns that it lacks, at the end."""
    return df.withColumns({n: F.lit(default) for n in names if n not in df.columns})
