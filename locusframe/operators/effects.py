"""Effects of variants on proteins: the place in each transcript, and where it is coding the change of the codon.

Places come from a join by overlap; only rows that hit a coding part meet the coding sequence of their
transcript, and a codon is looked at in Arrow batches, as it takes arithmetic over lists of exons.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from .intervals import BIN
from .sequences import extract, reverse_complement
from .variants import gene_hits, listed_hits

_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
_TURN = str.maketrans("ACGTacgt", "TGCAtgca")


def protein(coding: str) -> str:
    """Amino acids of whole codons; X for what isn't known."""
    return "".join(CODONS.get(coding[i : i + 3].upper(), "X") for i in range(0, len(coding) - 2, 3))


def effect(strand: str, parts: list[tuple[int, int]], coding: str, begin: int, end: int, ref: str, alt: str) -> tuple[str, str]:
    """Impact and description (coding position, change, and the protein's) of replacing [begin, end) by alt, where
    parts are the coding stretches in order of place and coding their sequence in the direction of the strand."""
    total = sum(e - b for b, e in parts)

    def offset(g: int) -> int:
        n = sum(min(max(g - b, 0), e - b) for b, e in parts)
        return n if strand == "+" else total - n

    first, last = sorted((offset(begin), offset(end)))
    new = alt if strand == "+" else alt.translate(_TURN)[::-1]
    old = coding[first:last]
    at = f"c.{first + 1}" + (f"_{last}" if last - first > 1 else "")
    if begin == end:
        at = f"c.{first}_{first + 1}"
        change = f"{at}ins{new}"
    elif not new:
        change = f"{at}del"
    elif len(old) == len(new) == 1:
        change = f"{at}{old}>{new}"
    else:
        change = f"{at}delins{new}"
    if not any(b <= begin and end <= e for b, e in parts):
        return "CDSSPLICE", change
    kind = "snp" if len(old) == len(new) == 1 else "del" if not new else "ins" if not old else "sub"
    if first < 3 and (last > 0 or begin != end) and not (kind == "ins" and first == 0):
        return {"snp": "CDSSTART", "del": "CDSSTARTDEL", "ins": "CDSSTARTCOMP", "sub": "CDSSTARTCOMP"}[kind], change
    if (len(new) - len(old)) % 3:
        return "CDSFRAME", f"{change}:p.{_amino(coding, first // 3)}{first // 3 + 1}fs"
    before, after = protein(coding), protein(coding[:first] + new + coding[last:])
    k = next((i for i, (x, y) in enumerate(zip(before, after)) if x != y), None)
    if k is None and len(before) == len(after):
        return "CDSsilent", f"{change}:p.{_amino(coding, first // 3)}{first // 3 + 1}="
    k = min(len(before), len(after)) if k is None else k
    x, y = (before[k] if k < len(before) else ""), (after[k] if k < len(after) else "")
    impact = "CDSSTOP" if x == "*" else "CDSNONSENSE" if y == "*" else {"snp": "CDSMIS", "del": "CDSDEL", "ins": "CDSINS", "sub": "CDSCOMP" if len(new) != 0 else "CDSDEL"}[kind]
    return impact, f"{change}:p.{x}{k + 1}{y if kind == 'snp' else kind}"


def _amino(coding: str, k: int) -> str:
    return CODONS.get(coding[3 * k : 3 * k + 3].upper(), "X")


def coding_sequences(genes: DataFrame, genome: DataFrame, chunk: int = 10_000) -> DataFrame:
    """name, chromosome, strand, parts (array of begin and end), coding of transcripts that are coding."""
    numbers = lambda c: F.transform(F.filter(F.split(F.col(c).cast("string"), ","), lambda x: x != ""), lambda x: x.cast("long"))
    cs, ce = F.col("cdsStart").cast("long"), F.col("cdsEnd").cast("long")
    parts = F.filter(F.zip_with(numbers("exonStarts"), numbers("exonEnds"), lambda b, e: F.struct(F.greatest(b, cs).alias("begin"), F.least(e, ce).alias("end"))), lambda p: p["begin"] < p["end"])
    each = genes.where(cs < ce).select("chromosome", "name", "strand", F.inline(parts))
    entry = F.struct("begin", "end", "sequence")
    g = extract(each, genome, chunk).groupBy("chromosome", "name", "strand").agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    whole = F.array_join(F.transform("_p", lambda p: p["sequence"]), "")
    return g.select("chromosome", "name", "strand", F.transform("_p", lambda p: F.struct(p["begin"].alias("begin"), p["end"].alias("end"))).alias("parts"), F.upper(F.when(F.col("strand") == "-", reverse_complement(whole)).otherwise(whole)).alias("coding"))


def annotate_effects(a: DataFrame, genes: DataFrame, genome: DataFrame, upstream: int = 2000, splice: int = 8, essential: int = 2, chunk: int = 10_000, bin_size: int = BIN) -> DataFrame:
    """a (with ref and alt, an allele a row) with gene_impact, gene_gene and gene_descr as annotate_genes gives them, but
    for coding places the impact on the protein, and in the description the change of the coding sequence and of
    the protein. A deletion of a whole transcript is a GENEDEL. Joins are merges, as Spark guesses too little for
    transcripts and their sequences and would broadcast them."""
    hits = gene_hits(a, genes, upstream, splice, essential, bin_size)
    whole = (F.col("a_begin") <= F.col("_tb")) & (F.col("a_end") >= F.col("_te")) & (F.col("a_begin") < F.col("a_end"))
    extent = genes.select(F.col("name").alias("b_name"), F.col("begin").cast("long").alias("_tb"), F.col("end").cast("long").alias("_te")).groupBy("b_name").agg(F.min("_tb").alias("_tb"), F.max("_te").alias("_te"))
    x = hits.join(extent.hint("merge"), "b_name", "left")
    impact = F.when(whole, F.when(F.col("a_alt") == "", "GENEDEL").otherwise("GENECOMP")).otherwise(F.col("v.impact"))
    x = x.withColumn("v", F.struct(impact.alias("impact"), F.col("v.descr").alias("descr"))).drop("_tb", "_te")
    coding = F.coalesce(F.col("v.impact") == "CDS", F.lit(False))
    genes_at = coding_sequences(genes, genome, chunk).select(F.col("name").alias("b_name"), F.col("strand").alias("_strand"), F.col("parts").alias("_parts"), F.col("coding").alias("_coding"))
    found = x.where(coding).select("a_row", "b_name", "a_begin", "a_end", "a_ref", "a_alt", "v").join(genes_at.hint("merge"), "b_name")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            rows = [effect(s, [(p["begin"], p["end"]) for p in ps], c, b, e, r or "", alt or "") for s, ps, c, b, e, r, alt in zip(t["_strand"], t["_parts"], t["_coding"], t["a_begin"], t["a_end"], t["a_ref"], t["a_alt"])]
            yield pd.DataFrame({"a_row": t["a_row"], "b_name": t["b_name"], "_impact": [i for i, _ in rows], "_change": [d for _, d in rows]})

    effects = found.mapInPandas(run, "a_row long, b_name string, _impact string, _change string")
    y = x.join(effects.hint("merge"), ["a_row", "b_name"], "left")
    return listed_hits(a, y.withColumn("v", F.struct(F.coalesce("_impact", "v.impact").alias("impact"), F.concat_ws(":", "v.descr", "_change").alias("descr"))).drop("_impact", "_change"))


MIR = ["mature1", "mature2"]


def annotate_mir(a: DataFrame, mirs: DataFrame, upstream: int = 2000, flank: int = 100, bin_size: int = BIN) -> DataFrame:
    """a with mir_impact and mir_mir: the gravest place in each microRNA gene it hits (chromosome, begin, end, strand,
    name, mature1start/end, loopstart/end, mature2start/end): seed (bases 2 to 7 of a mature sequence), mature,
    loop, arm, flank (up to flank bases from the hairpin), upstream, downstream."""
    from .intervals import overlap_join, regions

    b, e, plus = F.col("begin").cast("long"), F.col("end").cast("long"), F.col("strand") == "+"
    part = lambda kind, lo, hi: F.struct((kind if not isinstance(kind, str) else F.lit(kind)).alias("type"), lo.alias("begin"), hi.alias("end"))
    rows = [part("arm", b, e), part("loop", F.col("loopstart").cast("long"), F.col("loopend").cast("long"))]
    for m in MIR:
        lo, hi = F.col(m + "start").cast("long"), F.col(m + "end").cast("long")
        rows += [part("mature", lo, hi), part("seed", F.when(plus, lo + 1).otherwise(hi - 7), F.when(plus, lo + 7).otherwise(hi - 1))]
    rows += [part("flank", b - flank, b), part("flank", e, e + flank)]
    rows += [part(F.when(plus, "upstream").otherwise("downstream"), b - upstream, b - flank), part(F.when(plus, "downstream").otherwise("upstream"), e + flank, e + upstream)]
    elements = mirs.select("chromosome", model.col("name"), F.inline(F.filter(F.array(*rows), lambda p: p["begin"] < p["end"])))
    x, y = regions(a), regions(elements, ["type", "name"])
    point = F.col("a_begin") == F.col("a_end")
    cond = F.when(point, (F.col("b_begin") <= F.col("a_begin")) & (F.col("a_begin") < F.col("b_end"))).otherwise((F.col("a_begin") < F.col("b_end")) & (F.col("b_begin") < F.col("a_end")))
    pairs = overlap_join(x, y, "each", True, 0, bin_size, cond)
    rank = F.array_position(F.array(*map(F.lit, ("downstream", "upstream", "flank", "arm", "loop", "mature", "seed"))), F.col("b_type"))
    one = pairs.groupBy("a_row", "b_name").agg(F.max_by("b_type", rank).alias("impact"), *[F.first(model.col("a_" + c)).alias("a_" + c) for c in x.columns])
    lists = F.array_sort(F.collect_list(F.when(F.col("b_name").isNotNull(), F.struct(F.col("b_name").alias("name"), "impact"))))
    out = one.groupBy("a_row").agg(lists.alias("_l"), *[F.first(model.col("a_" + c)).alias(c) for c in x.columns])
    text = lambda k: F.coalesce(F.array_join(F.transform("_l", lambda s: s[k]), ";"), F.lit(""))
    return out.select(*[model.col(c) for c in x.columns], text("impact").alias("mir_impact"), text("name").alias("mir_mir"))
