"""Variant tables: annotation, alleles, merges of samples, structural variants, gene effects by place."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.library import zyg
from ..functions.values import Value
from ..natural import chr_clip, nat_key, nat_sort, nat_sort_key
from ..shared import checkpointed
from .intervals import BIN, best_match, overlap_join, regions
from .sequences import reverse_complement

KEY = ["chromosome", "begin", "end", "type", "ref", "alt"]


def split_alleles(df: DataFrame, alt: str = "alt") -> DataFrame:
    """A row for each different allele, in natural order. A field with as many elements as alleles is split,
    others are copied; zyg and sequenced follow the allele."""
    alts = F.split(model.col(alt), ",")
    texts = [c for c, t in df.dtypes if t == "string" and c not in (alt, "chromosome", "type", "ref")]
    x = df.withColumn("_alts", alts).withColumn("_each", F.explode(nat_sort(F.array_distinct(alts))))
    x = x.withColumn("_at", F.array_position("_alts", F.col("_each")).cast("int"))
    out = {alt: F.col("_each")}
    for c in texts:
        parts = F.split(model.col(c), ",")
        out[c] = F.when((F.size("_alts") > 1) & (F.size(parts) == F.size("_alts")), F.get(parts, F.col("_at") - 1)).otherwise(model.col(c))
    x = x.withColumns(out)
    suffixes = [""] + ["-" + s for s in model.analyses(df.columns)]
    for s in suffixes:
        need = [f"{f}{s}" for f in ("alleleSeq1", "alleleSeq2", "zyg")]
        if all(c in df.columns for c in need) and "ref" in df.columns:
            seq = Value(model.col(f"sequenced{s}"), "text") if f"sequenced{s}" in df.columns else Value(F.lit("v"), "text")
            known = F.when(seq.col == "u", "u").otherwise("v")
            z = zyg([Value(known, "text"), *[Value(model.col(c), "text") for c in (f"alleleSeq1{s}", f"alleleSeq2{s}", "ref", alt)]]).col
            x = x.withColumn(f"zyg{s}", z)
            if f"sequenced{s}" in df.columns:
                x = x.withColumn(f"sequenced{s}", F.when(seq.col == "u", "u").when(z.isin("r", "o"), "r").otherwise("v"))
    return x.drop("_alts", "_each", "_at")


def collapse_alleles(df: DataFrame, keys: list[str] | None = None, duplicates: str = "merge") -> DataFrame:
    """A row for each place: alleles and other fields that differ as lists in the order of the alleles.
    sequenced: v before u before r. duplicates (of an allele): first, min, max, merge or error."""
    keys = keys or [k for k in KEY if k != "alt" and k in df.columns]
    rest = [c for c in df.columns if c not in [*keys, "alt"]]
    if duplicates == "error":
        twice = F.count(F.lit(1)) > 1
        df = df.join(df.groupBy(*[model.col(k) for k in keys], "alt").agg(twice.alias("_twice")), [*keys, "alt"]).withColumn("alt", F.when(F.col("_twice"), F.raise_error(F.lit("an allele is repeated")).cast("string")).otherwise(F.col("alt"))).drop("_twice")
    pick = {"min": F.min, "max": F.max, "first": F.min, "merge": lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";"), "error": F.min}[duplicates]
    one = df.groupBy(*[model.col(k) for k in keys], "alt").agg(*[pick(model.col(c).cast("string")).alias(c) for c in rest])
    entries = F.array_sort(F.collect_list(F.struct(nat_key("alt").alias("_o"), F.col("alt"), *[model.col(c) for c in rest])))
    g = one.groupBy(*[model.col(k) for k in keys]).agg(entries.alias("_e"))

    def field(c: str):
        values = F.transform("_e", lambda s: s[c])
        if c.split("-")[0] == "sequenced":
            return F.when(F.array_contains(values, "v"), "v").when(F.array_contains(values, "u"), "u").otherwise("r")
        same = F.array_distinct(values)
        return F.when(F.size(same) <= 1, F.coalesce(F.get(same, F.lit(0)), F.lit(""))).otherwise(F.array_join(values, ",", "?"))

    return g.select(*[model.col(k) for k in keys], F.array_join(F.transform("_e", lambda s: s["alt"]), ",").alias("alt"), *[field(c).alias(c) for c in rest])


def annotate_variants(a: DataFrame, db: DataFrame, fields: list[str], keys: tuple[str, ...] = ("chromosome", "begin", "end", "type")) -> DataFrame:
    """a with fields of the database row at the same place and type; of its lists the elements of a's alleles.
    Of several rows the first in order of alleles."""
    b = db.select(*[(chr_clip(model.col(k)) if k == "chromosome" else model.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)], F.split("alt", ",").alias("_alts"), *[model.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)])
    x = a.withColumn("_id", F.monotonically_increasing_id()).withColumn("_mine", F.split("alt", ","))
    cond = [(chr_clip(model.col(k)) if k == "chromosome" else model.col(k)) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    pairs = x.join(b, [*cond, F.arrays_overlap("_mine", "_alts")], "left")

    def value(i: int):
        parts = F.split(F.col(f"_f{i}"), ",")
        listed = F.size(parts) == F.size("_alts")
        each = F.transform("_mine", lambda m: F.when(F.array_contains(F.col("_alts"), m), F.when(listed, F.get(parts, (F.array_position(F.col("_alts"), m) - 1).cast("int"))).otherwise(F.col(f"_f{i}"))).otherwise("-"))
        return F.array_join(each, ",", "-")

    values = F.struct(*[value(i).alias(f"v{i}") for i in range(len(fields))])
    order = F.when(F.col("_alts").isNotNull(), F.struct(F.array_join("_alts", ",").alias("o"), values.alias("v")))
    out = pairs.groupBy("_id").agg(F.min_by(values, order).alias("_v"), *[F.first(model.col(c)).alias(c) for c in a.columns])
    return out.select(*[model.col(c) for c in a.columns], *[F.coalesce(F.col(f"_v.v{i}"), F.lit("")).alias(f) for i, f in enumerate(fields)])


def annotate_positions(a: DataFrame, values: DataFrame, field: str, default: str | float = 0, bin_size: int = BIN) -> DataFrame:
    """a with the value at its begin from runs (chromosome, begin, end, field); the default where there is none."""
    at = (F.col("b_begin") <= F.col("a_begin")) & (F.col("a_begin") < F.col("b_end"))
    out = best_match(a, values, [field], [F.col("b_begin"), F.col("b_end")], {}, True, 0, bin_size, at)
    name = field if field in out.columns and field not in a.columns else f"{field}_2"
    return out.withColumn(name, F.coalesce(model.col(name), F.lit(default).cast(values.schema[field].dataType)))


def multicompar(tables: dict[str, DataFrame], sequenced: dict[str, DataFrame] | None = None, split: bool = True, fields: list[str] | None = None, bin_size: int = BIN) -> DataFrame:
    """Full outer merge of samples into a wide table. A sample without the variant is r where its sequenced
    regions cover it, else u (? without regions); with split, o in zyg where it has another allele there."""
    keys = KEY if split else KEY[:-1]
    fields = fields or list(dict.fromkeys(c for t in tables.values() for c in t.columns if c not in KEY))
    parts = []
    for s, t in tables.items():
        roles = t.select(chr_clip("chromosome").alias("chromosome"), *[model.col(k) for k in KEY[1:]], *[(model.col(f).cast("string") if f in t.columns else F.lit(None).cast("string")).alias(f) for f in fields])
        parts.append(roles.withColumn("_s", F.lit(s)))
    long = reduce(DataFrame.unionByName, parts)
    cells = [F.max(F.when(F.col("_s") == s, F.coalesce(model.col(f), F.lit("")))).alias(f"{f}-{s}") for s in tables for f in fields]
    marks = [F.max((F.col("_s") == s).cast("int")).alias(f"_has-{s}") for s in tables]
    alts = [] if split else [F.array_join(nat_sort(F.array_distinct(F.flatten(F.collect_set(F.split("alt", ","))))), ",").alias("alt")]
    wide = long.groupBy(*keys).agg(*alts, *cells, *marks)
    if split:  # another allele of the sample at the same place
        w = Window.partitionBy(*KEY[:4])
        for s in tables:
            wide = wide.withColumn(f"_near-{s}", F.max(f"_has-{s}").over(w))
    out = wide
    for s in tables:
        has = F.col(f"`_has-{s}`") == 1
        if sequenced and s in sequenced:
            cov = regions(sequenced[s], [])
            x = out.withColumn("_id", F.monotonically_increasing_id())
            ids = overlap_join(x.select("chromosome", "begin", "end", "_id"), cov, "inner", True, 0, bin_size, (F.col("b_begin") <= F.col("a_begin")) & (F.col("a_end") <= F.col("b_end"))).select(F.struct("a_chromosome", "a_begin", "a_end").alias("_place")).distinct()
            places = ids.select(F.col("_place.a_chromosome").alias("chromosome"), F.col("_place.a_begin").alias("begin"), F.col("_place.a_end").alias("end"), F.lit(True).alias("_cov"))
            out = x.drop("_id").join(places, ["chromosome", "begin", "end"], "left")
            code = F.when(F.col("_cov"), "r").otherwise("u")
        else:
            out, code = out.withColumn("_cov", F.lit(None).cast("boolean")), F.lit("?")
        new = {}
        for f in fields:
            c = f"{f}-{s}"
            missing = F.lit("?")
            if f == "sequenced":
                missing = F.when(F.col(f"`_near-{s}`") == 1, "r").otherwise(code) if split else code
            elif f == "zyg":
                missing = F.when(F.col(f"`_near-{s}`") == 1, "o").otherwise(code) if split else code
            elif f in ("alleleSeq1", "alleleSeq2"):
                missing = F.when(F.col("_cov") & (F.col(f"`_near-{s}`") != 1), F.col("ref")).otherwise("?") if split else F.lit("?")
            new[c] = F.when(has, model.col(c)).otherwise(missing)
        out = out.withColumns(new).drop("_cov")
    out = out.drop(*[f"_has-{s}" for s in tables], *[f"_near-{s}" for s in tables])
    return out.select(*KEY[:5], "alt", *[model.col(f"{f}-{s}") for s in tables for f in fields])


NO_MATCH = 2147483648


def sv_distance(margin: int = 30, lmargin: int = 300, tmargin: int = 300, overlap: float = 75.0):
    """Distance of two structural variants (columns a_ and b_): of begins and ends together. No match if the
    types differ, if either is beyond its margin (lmargin for large ones: del, dup, inv; tmargin for
    translocations), or if they share less than overlap percent."""
    kind = F.col("a_type")
    m = F.when(kind.isin("trans", "bnd"), F.lit(tmargin)).when(kind.isin("del", "dup", "inv", "cnv"), F.lit(lmargin)).otherwise(F.lit(margin))
    db, de = F.abs(F.col("a_begin") - F.col("b_begin")), F.abs(F.col("a_end") - F.col("b_end"))
    shared = F.least("a_end", "b_end") - F.greatest("a_begin", "b_begin")
    larger = F.greatest(F.col("a_end") - F.col("a_begin"), F.col("b_end") - F.col("b_begin"))
    enough = (larger == 0) | (shared * F.lit(100.0) >= larger * F.lit(overlap))
    return F.when((F.col("a_type") == F.col("b_type")) & (db <= m) & (de <= m) & enough, db + de).otherwise(F.lit(NO_MATCH))


def annotate_sv(a: DataFrame, db: DataFrame, fields: list[str], bin_size: int = BIN, **limits) -> DataFrame:
    """a with fields of the structural variant that is nearest; one of db may serve several."""
    near = max(limits.get("lmargin", 300), limits.get("tmargin", 300), limits.get("margin", 30))
    d = sv_distance(**limits)
    return best_match(a, db, fields, [d, F.col("b_begin"), F.col("b_end")], {"distance": d}, True, near, bin_size, d < NO_MATCH)


def sv_pairs(a: DataFrame, b: DataFrame, ids: str = "id", bin_size: int = BIN, **limits) -> DataFrame:
    """Pairs (a_id, b_id, distance) of a one-to-one match, as the greedy choice by rising distance gives: a
    pair is taken when it is the least of both of its rows; taken rows leave, and again until none is left.
    Rounds are few as a rule, as each takes every pair that is least on both sides; a chain of falling
    distances needs one for each of its pairs."""
    near = max(limits.get("lmargin", 300), limits.get("tmargin", 300), limits.get("margin", 30))
    pairs = overlap_join(regions(a, ["type", ids]), regions(b, ["type", ids]), "inner", True, near, bin_size).withColumn("distance", sv_distance(**limits)).where(F.col("distance") < NO_MATCH)
    left = pairs.select(F.col(f"a_{ids}").alias("a_id"), F.col(f"b_{ids}").alias("b_id"), "distance")
    left, taken = checkpointed(left), []
    while True:
        order = F.struct("distance", "a_id", "b_id")
        marked = left.withColumn("_x", F.min(order).over(Window.partitionBy("a_id"))).withColumn("_y", F.min(order).over(Window.partitionBy("b_id")))
        best = checkpointed(marked.where((F.col("_x") == order) & (F.col("_y") == order)).select("a_id", "b_id", "distance"))
        if not best.limit(1).count():
            break
        taken.append(best)
        left = checkpointed(left.join(best.select("a_id"), "a_id", "left_anti").join(best.select("b_id"), "b_id", "left_anti"))
    return reduce(DataFrame.union, taken) if taken else left


def svmulticompar(tables: dict[str, DataFrame], fields: list[str], **limits) -> DataFrame:
    """Structural variants of several samples in a wide table; each sample's are matched one to one to what
    the samples before it gave, others are rows of their own."""
    out = None
    for s, t in tables.items():
        own = regions(t, ["type", *fields]).withColumn("id", F.monotonically_increasing_id()).withColumnsRenamed({f: f"{f}-{s}" for f in fields})
        if out is None:
            out = own.drop("id")
            continue
        merged = checkpointed(out.withColumn("id", F.monotonically_increasing_id()))
        own = checkpointed(own)
        pairs = sv_pairs(merged, own, **limits)
        cells = own.select(F.col("id").alias("b_id"), *[model.col(f"{f}-{s}") for f in fields]).join(pairs.select("a_id", "b_id"), "b_id").drop("b_id")
        both = merged.join(cells, merged["id"] == cells["a_id"], "left").drop("id", "a_id")
        alone = own.join(pairs.select(F.col("b_id").alias("id")), "id", "left_anti").drop("id")
        out = both.unionByName(alone, allowMissingColumns=True)
    return out.fillna("?")


def gene_elements(genes: DataFrame, upstream: int = 0) -> DataFrame:
    """Exons, introns and stretches up- and downstream of transcripts (chromosome, begin, end, strand, name,
    exonStarts, exonEnds, cdsStart, cdsEnd), cut into CDS and UTR."""
    starts = F.transform(F.filter(F.split(F.col("exonStarts").cast("string"), ","), lambda x: x != ""), lambda x: x.cast("long"))
    ends = F.transform(F.filter(F.split(F.col("exonEnds").cast("string"), ","), lambda x: x != ""), lambda x: x.cast("long"))
    t = genes.withColumn("_s", starts).withColumn("_e", ends)
    cs, ce, plus = F.col("cdsStart"), F.col("cdsEnd"), F.col("strand") == "+"
    n = F.size("_s")

    def exon(i):
        b, e = F.get("_s", i), F.get("_e", i)
        number = F.when(plus, i + 1).otherwise(n - i)
        part = lambda kind, lo, hi: F.struct(F.lit(kind).alias("type"), lo.alias("begin"), hi.alias("end"), number.cast("long").alias("element"))
        left, right = F.when(plus, "UTR5").otherwise("UTR3"), F.when(plus, "UTR3").otherwise("UTR5")
        side = lambda kind, lo, hi: F.struct(kind.alias("type"), lo.alias("begin"), hi.alias("end"), number.cast("long").alias("element"))
        coding = cs < ce
        return F.when(coding, F.array(side(left, b, F.least(e, cs)), part("CDS", F.greatest(b, cs), F.least(e, ce)), side(right, F.greatest(b, ce), e))).otherwise(F.array(part("RNA", b, e)))

    exons = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), exon))
    introns = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.lit("intron").alias("type"), F.get("_e", i).alias("begin"), F.get("_s", i + 1).alias("end"), F.when(plus, i + 1).otherwise(n - 1 - i).cast("long").alias("element")))).otherwise(F.array().cast("array<struct<type:string,begin:bigint,end:bigint,element:bigint>>"))
    every = F.concat(exons, introns)
    if upstream:
        before = F.struct(F.when(plus, "upstream").otherwise("downstream").alias("type"), F.greatest(F.col("begin") - upstream, F.lit(0)).alias("begin"), F.col("begin").alias("end"), F.lit(0).cast("long").alias("element"))
        after = F.struct(F.when(plus, "downstream").otherwise("upstream").alias("type"), F.col("end").alias("begin"), (F.col("end") + upstream).alias("end"), F.lit(0).cast("long").alias("element"))
        every = F.concat(every, F.array(before, after))
    return t.select("chromosome", "name", "strand", F.inline(F.filter(every, lambda s: s["begin"] < s["end"]))).select("chromosome", "begin", "end", "type", "element", "name", "strand")


def _field(name: str):
    return lambda s: s[name]


def annotate_genes(a: DataFrame, genes: DataFrame, upstream: int = 2000, splice: int = 8, essential: int = 2, bin_size: int = BIN) -> DataFrame:
    """a with the transcripts that overlap each row and where it hits them: impact by place (CDS, UTR5, UTR3,
    RNA, intron, splice and ESPLICE at the ends of introns, upstream, downstream) and a description
    strand:transcript:element. The gravest place of a transcript counts. effects.annotate_effects looks at the
    protein as well."""
    return listed_hits(a, gene_hits(a, genes, upstream, splice, essential, bin_size))


def gene_hits(a: DataFrame, genes: DataFrame, upstream: int, splice: int, essential: int, bin_size: int) -> DataFrame:
    """A row for each row of a (a_row, a_*) and transcript it hits (b_name, null without any), with v: impact, descr."""
    from ..functions.library import IMPACTS

    x, y = regions(a), regions(gene_elements(genes, upstream), ["type", "element", "name", "strand"])
    pairs = overlap_join(x, y, "each", True, 0, bin_size, F.when(F.col("a_begin") == F.col("a_end"), (F.col("b_begin") <= F.col("a_begin")) & (F.col("a_begin") < F.col("b_end"))).otherwise((F.col("a_begin") < F.col("b_end")) & (F.col("b_begin") < F.col("a_end"))))
    into = lambda d: (F.col("a_begin") < F.col("b_begin") + d) | (F.col("a_end") > F.col("b_end") - d)
    place = F.when((F.col("b_type") == "intron") & into(essential), "ESPLICE").when((F.col("b_type") == "intron") & into(splice), "splice").otherwise(F.col("b_type"))
    rank = F.array_position(F.array(*map(F.lit, [i if i != "CDSMIS" else "CDS" for i in IMPACTS])), place)
    descr = F.concat(F.col("b_strand"), F.col("b_name"), F.lit(":"), F.when(F.col("b_type") == "intron", "intron").when(F.col("b_element") > 0, "exon").otherwise(F.col("b_type")), F.when(F.col("b_element") > 0, F.col("b_element").cast("string")).otherwise(""))
    own = [F.first(model.col("a_" + c)).alias("a_" + c) for c in x.columns]
    return pairs.groupBy("a_row", "b_name").agg(F.max_by(F.struct(place.alias("impact"), descr.alias("descr")), F.struct(rank, descr)).alias("v"), *own)


def listed_hits(a: DataFrame, one: DataFrame) -> DataFrame:
    """Rows of gene_hits as lists again, a row for each row of a."""
    columns = regions(a).columns
    lists = F.array_sort(F.collect_list(F.when(F.col("b_name").isNotNull(), F.struct(F.col("b_name").alias("name"), F.col("v.impact").alias("impact"), F.col("v.descr").alias("descr")))))
    out = one.groupBy("a_row").agg(lists.alias("_l"), *[F.first(model.col("a_" + c)).alias(c) for c in columns])
    return out.select(*[model.col(c) for c in columns], *[F.coalesce(F.array_join(F.transform("_l", _field(k)), ";"), F.lit("")).alias(f"gene_{n}") for n, k in (("impact", "impact"), ("gene", "name"), ("descr", "descr"))])


def _turned(x):
    """Alleles (a list, perhaps of one) as the other strand has them; what is no sequence stays."""
    return F.array_join(F.transform(F.split(x.cast("string"), ","), lambda v: F.when(v.rlike("^[ACGTNacgtn]*$"), reverse_complement(v)).otherwise(v)), ",")


def liftover(a: DataFrame, chain: DataFrame, bin_size: int = BIN) -> tuple[DataFrame, DataFrame]:
    """Rows in the coordinates of another build, by chain blocks (chromosome, begin, end, destchromosome,
    destbegin, destend, strand); and the rows that no block holds as a whole. Alleles (ref, alt, alleleSeq1 and 2) of
    a block on the minus strand are reverse complemented."""
    x, y = regions(a), regions(chain, ["destchromosome", "destbegin", "destend", "strand"])
    pairs = overlap_join(x, y, "each", True, 0, bin_size, (F.col("b_begin") <= F.col("a_begin")) & (F.col("a_end") <= F.col("b_end")))
    plus = F.col("b_strand") == "+"
    b = F.when(plus, F.col("b_destbegin") + F.col("a_begin") - F.col("b_begin")).otherwise(F.col("b_destend") - (F.col("a_end") - F.col("b_begin")))
    new = F.struct(F.col("b_destchromosome").alias("c"), b.alias("b"), (b + F.col("a_end") - F.col("a_begin")).alias("e"), F.col("b_strand").alias("s"))
    order = F.when(F.col("b_row"), F.struct("b_begin", "b_end", "b_destchromosome", "b_destbegin"))
    out = pairs.groupBy("a_row").agg(F.min_by(new, order).alias("_n"), *[F.first(model.col("a_" + c)).alias(c) for c in x.columns])
    rest = [c for c in x.columns if c not in ("chromosome", "begin", "end")]
    done = out.where("_n is not null").select(F.col("_n.c").alias("chromosome"), F.col("_n.b").alias("begin"), F.col("_n.e").alias("end"), *[(F.when(F.col("_n.s") == "-", _turned(model.col(c))).otherwise(model.col(c)).alias(c) if re.match("(ref|alt|alleleSeq[12])(-|$)", c) else model.col(c)) for c in rest], F.col("chromosome").alias("beforechromosome"), F.col("begin").alias("beforebegin"), F.col("end").alias("beforeend"))
    return done, out.where("_n is null").select("chromosome", "begin", "end", *[model.col(c) for c in rest])


def lift_regions(a: DataFrame, chain: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Regions cut at the blocks, lifted, and merged where they touch."""
    from .intervals import regjoin

    x, y = regions(a, []), regions(chain, ["destchromosome", "destbegin", "destend", "strand"])
    p = overlap_join(x, y, bin_size=bin_size)
    lo, hi, plus = F.greatest("a_begin", "b_begin"), F.least("a_end", "b_end"), F.col("b_strand") == "+"
    b = F.when(plus, F.col("b_destbegin") + lo - F.col("b_begin")).otherwise(F.col("b_destend") - (hi - F.col("b_begin")))
    return regjoin(p.select(F.col("b_destchromosome").alias("chromosome"), b.alias("begin"), (b + hi - lo).alias("end")), size=bin_size)


def correct_variants(a: DataFrame, genome: DataFrame, chunk: int = 10_000) -> DataFrame:
    """a with ref as the genome has it (chunks: chromosome, start, seq, each of chunk bases), and refok."""
    x = a.withColumn("_id", F.monotonically_increasing_id()).withColumn("chromosome", chr_clip("chromosome"))
    span = x.select("*", F.explode(F.sequence(F.floor(F.col("begin") / chunk), F.floor(F.greatest(F.col("end") - 1, F.col("begin")) / chunk))).alias("_c"))
    g = genome.select(chr_clip("chromosome").alias("_g"), F.floor(F.col("start") / chunk).alias("_gc"), F.col("start").alias("_st"), F.col("seq").alias("_seq"))
    parts = span.join(g, (F.col("chromosome") == F.col("_g")) & (F.col("_c") == F.col("_gc")), "left")
    lo, hi = F.greatest("begin", F.col("_st")), F.least(F.col("end"), F.col("_st") + chunk)
    piece = F.when(F.col("_seq").isNotNull(), F.struct("_c", F.substring(F.col("_seq"), (lo - F.col("_st") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("s")))
    pieces = F.array_sort(F.collect_list(piece))
    whole = F.when(F.size(pieces) > 0, F.array_join(F.transform(pieces, lambda s: s["s"]), ""))
    out = parts.groupBy("_id").agg(whole.alias("_ref"), *[F.first(model.col(c)).alias(c) for c in a.columns])
    return out.select(*[(F.coalesce(F.col("_ref"), F.col("ref")) if c == "ref" else model.col(c)).alias(c) for c in a.columns], F.coalesce(F.upper("ref") == F.upper("_ref"), F.lit(False)).cast("int").alias("refok"))


def exportplink(df: DataFrame, numeric: bool = False) -> DataFrame:
    """Lines of a tped file: a row for each allele; unsequenced samples are 0 0."""
    x = split_alleles(df)
    names = sorted({s for c in df.columns if c.startswith("alleleSeq1-") for s in [c.split("-", 1)[1]]}, key=nat_sort_key)

    def cell(s: str):
        a1, a2 = model.col(f"alleleSeq1-{s}"), model.col(f"alleleSeq2-{s}")
        code = (lambda v: F.when(v == F.col("alt"), "2").otherwise("1")) if numeric else (lambda v: F.when(v == "", "-").otherwise(v))
        seq = model.col(f"sequenced-{s}") if f"sequenced-{s}" in df.columns else F.lit("v")
        return F.when((seq == "u") | (a1 == "?") | (a2 == "?"), "0 0").otherwise(F.concat_ws(" ", code(a1), code(a2)))

    ident = F.concat_ws("-", chr_clip("chromosome"), "begin", "end", "type", "alt")
    return x.select(F.concat_ws(" ", chr_clip("chromosome"), ident, F.lit("0"), F.col("begin").cast("string"), *[cell(s) for s in names]).alias("line"))


def cluster_regions(df: DataFrame, match: int = 1, mismatch: int = -1, distance: int = 100, least: int = 20, stop: int = 5000) -> DataFrame:
    """Stretches of many variants close to each other: a running score rises where the next variant is within
    distance and falls where it isn't; a stretch ends at a gap beyond stop or when the score falls to zero,
    and counts with more than least variants. Rows of a chromosome go by in sorted batches, of which only the state
    of the stretch is kept, so that no call holds a whole chromosome."""
    x = regions(df, []).repartition("chromosome").sortWithinPartitions("chromosome", "begin", "end")

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, score, n, last = None, None, 0, 0, 0
        for t in parts:
            out = []
            for c, b, e in zip(t["chromosome"], t["begin"].tolist(), t["end"].tolist()):
                if c != now or b - last > stop:
                    if first is not None and n > least:
                        out.append((now, first, last, n))
                    now, first, score = c, None, 0
                elif first is not None:
                    score += match if b - last <= distance else mismatch
                if first is None or score < 0:
                    if first is not None and n > least:
                        out.append((now, first, last, n))
                    first, n, score = b, 0, 0
                n, last = n + 1, e
            yield pd.DataFrame(out, columns=["chromosome", "begin", "end", "count"])
        if first is not None and n > least:
            yield pd.DataFrame([(now, first, last, n)], columns=["chromosome", "begin", "end", "count"])

    return x.mapInPandas(scan, "chromosome string, begin long, end long, count long")
