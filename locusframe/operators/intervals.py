"""Interval algebra on half-open regions, and joins by overlap.

Joins: both sides get a row for each bin of ``bin_size`` positions they touch and are equi-joined on
chromosome and bin; a pair counts in the bin where the later of the two begins, so no pair has to be made
distinct. Algebra: intervals are cut at the bins, begins and ends become events, and running sums in a window
per chromosome and bin give the segments.
Segments that a bin edge has cut are stitched, which concerns two rows of a bin at most. So no step has to
take a whole chromosome in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..natural import chr_clip

BIN = 1 << 16
#: Bins that a row of a join takes at most before larger bins are better; a hint for callers.
KEYS = ("chromosome", "begin", "end")
#: Rows of a window in which rows are compared with the one before.
CHECK_CHUNK = 1 << 17


def regions(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """chromosome (without chr), begin, end, then other columns; rows without a place are left out."""
    roles = model.resolve_roles(df.columns, KEYS)
    rest = [c for c in (df.columns if keep is None else keep) if c not in {roles[k] for k in KEYS}]
    out = df.select(chr_clip(model.col(roles["chromosome"])).alias("chromosome"), model.col(roles["begin"]).cast("long").alias("begin"), model.col(roles["end"]).cast("long").alias("end"), *[model.col(c) for c in rest])
    return out.where("chromosome is not null and begin is not null and end is not null and begin <= end")


def _bins(begin: Column, end: Column, size: int, touch: bool = False) -> Column:
    last = end if touch else F.greatest(end - 1, begin)
    return F.explode(F.sequence(F.floor(begin / size), F.floor(last / size)))


# --- joins ---


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", touch: bool = False, near: int = 0, bin_size: int = BIN, condition: Column | None = None) -> DataFrame:
    """Pairs of rows of a (columns a_*) and b (columns b_*) whose regions overlap; touch: also where they
    only touch; near: with b widened by that much. how: inner, left_semi or left_anti (rows of a as they
    are), or each: all rows of a for each bin, with a_row (a number of the row) and b_row (null without a
    match), to be grouped by a_row. A row gets its number once, in one branch of the plan, so that it
    doesn't matter whether the rows of a come in the same order when they are made again. Sides are merged, never
    broadcast: Spark guesses their size by that of files, which may hold far less than rows made of them."""
    left = a.select(*[model.col(c).alias("a_" + c) for c in a.columns])
    if how != "inner":
        left = left.withColumn("a_row", F.monotonically_increasing_id())
    right = b.select(*[model.col(c).alias("b_" + c) for c in b.columns], *([F.lit(True).alias("b_row")] if how != "inner" else []))
    ab, ae, bb, be = (F.col(c) for c in ("a_begin", "a_end", "b_begin", "b_end"))
    wide = touch or near > 0
    x = left.select("*", _bins(ab, ae, bin_size, wide).alias("_bin"))
    y = right.select("*", _bins(bb - near, be + near, bin_size, wide).alias("_bin2")).hint("merge")
    first = F.greatest(F.floor(ab / bin_size), F.floor((bb - near) / bin_size))
    meet = ((ab <= be + near) & (bb - near <= ae)) if wide else ((ab < be) & (bb < ae))
    cond = (F.col("a_chromosome") == F.col("b_chromosome")) & (F.col("_bin") == F.col("_bin2")) & (F.col("_bin") == first) & meet
    if condition is not None:
        cond = cond & condition
    if how == "inner":
        return x.join(y, cond).drop("_bin", "_bin2")
    if how == "each":
        return x.join(y, cond, "left").drop("_bin", "_bin2")
    back = [model.col("a_" + c).alias(c) for c in a.columns]
    if how == "left_semi":
        return x.join(y, cond, "left_semi").dropDuplicates(["a_row"]).select(*back)
    rows = x.join(y, cond, "left").groupBy("a_row").agg(F.max("b_row").alias("_met"), *[F.first(model.col("a_" + c)).alias("a_" + c) for c in a.columns])
    return rows.where("_met is null").select(*back)


def regselect(a: DataFrame, b: DataFrame, near: int = 0, bin_size: int = BIN) -> DataFrame:
    """Rows of a that overlap a region of b. An insertion (begin = end) at the begin of a region counts, at
    its end it doesn't."""
    x, y = regions(a), regions(b, [])
    ab, ae, bb, be = (F.col(c) for c in ("a_begin", "a_end", "b_begin", "b_end"))
    cond = (ab < be + near) & ((bb - near < ae) | (ab == bb - near))
    return overlap_join(x, y, "left_semi", True, near, bin_size, cond)


def nearest(a: DataFrame, b: DataFrame, distance: int, fields: list[str], bin_size: int = BIN) -> DataFrame:
    """a with the fields of the nearest region of b less than distance away, and dist: the gap, or if they
    overlap the larger of (end1 - end2, begin2 - begin1 - 1), each -1 at most."""
    ab, ae, bb, be = (F.col(c) for c in ("a_begin", "a_end", "b_begin", "b_end"))
    inside = F.greatest(F.least(ae - be, F.lit(-1)), F.least(bb - ab - 1, F.lit(-1)))
    dist = F.when(bb >= ae, bb - ae).when(ab >= be, ab - be).otherwise(inside)
    return best_match(a, b, fields, [F.abs(dist), bb, be], {"dist": dist}, True, distance, bin_size, dist < distance)


def best_match(a: DataFrame, b: DataFrame, fields: list[str], by: list[Column], more: dict[str, Column], touch: bool, near: int, bin_size: int, condition: Column | None = None) -> DataFrame:
    """Each region of a with fields (and more) of the matching region of b that comes first; null without."""
    x, y = regions(a), regions(b, list(dict.fromkeys(fields + [c for c in ("type",) if c in b.columns and c not in fields])))
    pairs = overlap_join(x, y, "each", touch, near, bin_size, condition)
    values = F.struct(*[F.col(f"b_{f}").alias(f"_v{i}") for i, f in enumerate(fields)], *[c.alias(n) for n, c in more.items()])
    rest = [F.col(f"b_{f}").cast("string") for f in fields]
    order = F.when(F.col("b_row"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*by, *rest])]))
    out = pairs.groupBy("a_row").agg(F.min_by(values, order).alias("_b"), *[F.first(model.col("a_" + c)).alias(c) for c in x.columns])
    return out.select(*[model.col(c) for c in x.columns], *[F.col(f"_b._v{i}").alias(f if f not in x.columns else f"{f}_2") for i, f in enumerate(fields)], *[F.col(f"_b.{n}").alias(n) for n in more])


def annotate_regions(a: DataFrame, b: DataFrame, fields: list[str], bin_size: int = BIN) -> DataFrame:
    """a with fields of the first overlapping region of b. A row of length zero matches where it touches."""
    ab, ae, bb, be = (F.col(c) for c in ("a_begin", "a_end", "b_begin", "b_end"))
    cond = F.when((ab == ae) | (bb == be), (ab <= be) & (bb <= ae)).otherwise((ab < be) & (bb < ae))
    return best_match(a, b, fields, [bb, be], {}, True, 0, bin_size, cond)


def overlap_counts(a: DataFrame, b: DataFrame, bin_size: int = BIN) -> DataFrame:
    """a with the number of regions of b that overlap each row, and the positions they share."""
    x, y = regions(a), regions(b, [])
    pairs = overlap_join(x, y, "each", bin_size=bin_size)
    shared = F.when(F.col("b_row"), F.least("a_end", "b_end") - F.greatest("a_begin", "b_begin"))
    out = pairs.groupBy("a_row").agg(F.count("b_row").alias("count"), F.coalesce(F.sum(shared), F.lit(0)).alias("shared"), *[F.first(model.col("a_" + c)).alias(c) for c in x.columns])
    return out.select(*[model.col(c) for c in x.columns], "count", "shared")


# --- algebra ---


def _events(df: DataFrame, name: str, size: int, by: list[str]) -> DataFrame:
    """chromosome, _bin, pos, the change of the number of regions (name), and whether a region begins or ends.
    An end on the border of two bins is an edge in the next bin too, where another region may go on."""
    cut = df.select("chromosome", *by, "begin", "end", _bins(F.col("begin"), F.col("end"), size).alias("_bin"))
    b, e = F.greatest("begin", F.col("_bin") * size), F.least("end", (F.col("_bin") + 1) * size)
    event = lambda bin_, pos, change, edge: F.struct(bin_.alias("_bin"), pos.alias("pos"), F.lit(change).alias(name), edge.alias("edge"))
    here, ends = F.col("_bin"), e == F.col("end")
    two = F.array(event(here, b, 1, (b == F.col("begin")).cast("int")), event(here, e, -1, ends.cast("int")))
    border = F.array(event(here + 1, e, 0, F.lit(1)))
    return cut.where("begin < end").select("chromosome", *by, F.inline(F.when(ends & (e == (here + 1) * size), F.concat(two, border)).otherwise(two)))


def segments(sets: dict[str, DataFrame], size: int = BIN, by: list[str] | None = None) -> DataFrame:
    """chromosome, _bin, begin, end, the number of regions of each set there, and edge: a region begins or
    ends at its begin. Neighbouring rows of a bin touch; bins cut. by: columns whose values are kept apart."""
    by = by or []
    parts = []
    for name, df in sets.items():
        e = _events(df, f"n_{name}", size, by)
        parts.append(e.select("chromosome", *by, "_bin", "pos", *[(F.col(f"n_{s}") if s == name else F.lit(0)).alias(f"n_{s}") for s in sets], "edge"))
    # the events of a bin are sorted, not gathered in a table of positions: sorting spills, and there is one shuffle.
    # Of several at a position the last has the sum of all; the others are as long as nothing
    events = reduce(DataFrame.union, parts)
    w = Window.partitionBy("chromosome", *by, "_bin").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    edge = F.max("edge").over(w.rangeBetween(0, 0))
    return events.select("chromosome", *by, "_bin", F.col("pos").alias("begin"), F.lead("pos").over(w).alias("end"), *[F.sum(f"n_{s}").over(upto).alias(f"n_{s}") for s in sets], edge.alias("edge")).where("begin < end")


def _merge(pieces: DataFrame, size: int, values: list[str], edges: bool, by: list[str] | None = None) -> DataFrame:
    """Touching pieces of equal values as one, in bins and then across them; with edges not where a region
    begins or ends."""
    by = by or []

    def joined(x: DataFrame, part: str, alone: Column) -> DataFrame:
        """A row for each run; its first tells whether a true edge is there. Rows stay where they are sorted."""
        w = Window.partitionBy("chromosome", *by, part).orderBy("begin")
        first = alone | F.coalesce(F.lag("end").over(w) != F.col("begin"), F.lit(True))
        for v in values:
            first = first | ~F.lag(v).over(w).eqNullSafe(F.col(v))
        if edges:
            first = first | (F.col("edge") == 1)
        x = x.withColumn("_first", first)
        x = x.withColumn("_last", F.lead("_first", 1, True).over(w)).where("_first or _last")
        return x.withColumn("end", F.when(F.col("_last"), F.col("end")).otherwise(F.lead("end").over(w))).where("_first").drop("_first", "_last")

    runs = joined(pieces.select("chromosome", *by, "_bin", "begin", "end", "edge", *values), "_bin", F.lit(False))
    lo, hi = F.col("_bin") * size, (F.col("_bin") + 1) * size
    at_edge = (F.col("begin") == lo) | (F.col("end") == hi)
    # what a bin edge has cut, two rows of a bin at most, is in one window; the rest stays by bin and as it is
    runs = runs.withColumn("_group", F.when(~at_edge, F.col("_bin")))
    return joined(runs, "_group", F.col("_group").isNotNull()).select("chromosome", *by, "begin", "end", *values)


def _sweep(sets: dict[str, DataFrame], keep: Callable[..., Column], size: int, edges: bool) -> DataFrame:
    s = segments(sets, size)
    return _merge(s.where(keep(*[F.col(f"n_{n}") for n in sets])), size, [], edges)


def regjoin(a: DataFrame, b: DataFrame | None = None, size: int = BIN) -> DataFrame:
    """Regions of one or two tables, overlapping and touching ones merged. Regions of length zero stay where
    no other covers or touches them."""
    x = regions(a, [])
    if b is not None:
        x = x.union(regions(b, []))
    full = _sweep({"a": x}, lambda n: n > 0, size, False)
    points = x.where("begin = end").distinct()
    alone = overlap_join(points, full, "left_anti", True, bin_size=size)
    return full.union(alone)


def regjoin_fields(a: DataFrame, fields: list[str], size: int = BIN) -> DataFrame:
    """Regions that touch or overlap and agree in fields, as one with the last end. Regions of length zero stay
    where no other of the same fields covers or touches them. It is the sweep of regjoin, the fields kept apart."""
    by = [f"_f{i}" for i in range(len(fields))]
    x = regions(a, fields).select("chromosome", "begin", "end", *[model.col(f).alias(b) for f, b in zip(fields, by)])
    full = _merge(segments({"a": x}, size, by).where("n_a > 0"), size, [], False, by)
    same = reduce(lambda p, q: p & q, [F.col(f"a_{b}").eqNullSafe(F.col(f"b_{b}")) for b in by], F.lit(True))
    alone = overlap_join(x.where("begin = end").distinct(), full, "left_anti", True, bin_size=size, condition=same)
    return full.unionByName(alone).select("chromosome", "begin", "end", *[F.col(b).alias(f) for f, b in zip(fields, by)])


def regsubtract(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """What of the regions of a no region of b covers. Regions of a that touch stay apart."""
    return _sweep({"a": regions(a, []), "b": regions(b, [])}, lambda n, m: (n > 0) & (m == 0), size, True)


def regcommon(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Positions that both cover."""
    return _sweep({"a": regions(a, []), "b": regjoin(b, size=size)}, lambda n, m: (n > 0) & (m > 0), size, False)


def multireg(sets: dict[str, DataFrame], size: int = BIN) -> DataFrame:
    """Segments between all begins and ends, with 1 for each set that covers them and 0 for others; what no
    set covers isn't written. A column -that is already 0 or 1- of such a table can be a set by itself."""
    s = segments({n: regions(d, []) for n, d in sets.items()}, size)
    flags = [(F.col(f"n_{n}") > 0).cast("int").alias(n) for n in sets]
    some = reduce(lambda p, q: p | q, [F.col(f"n_{n}") > 0 for n in sets])
    return _merge(s.where(some).select("chromosome", "_bin", "begin", "end", "edge", *flags), size, list(sets), True)


def regcollapse(a: DataFrame, fields: list[str], score: str | None = None, numbers: list[str] | None = None, size: int = BIN) -> DataFrame:
    """Regions cut at overlaps. Where several meet: the fields of the highest score, or without one the
    different values joined by commas, numbers added up; then equal neighbours are merged."""
    numbers = numbers or []
    x = regions(a, [*fields, *numbers, *([score] if score and score not in fields else [])])
    cuts = segments({"a": x}, size).where("n_a > 0").select("chromosome", "begin", "end")
    # cuts are shorter than regions and as dense, and all rows of a bin meet: smaller bins than those of the sweep
    pairs = overlap_join(cuts, x, bin_size=max(size // 32, 1))
    key = ["a_chromosome", "a_begin", "a_end"]
    if score:
        top = F.max_by(F.struct(*[F.col(f"b_{f}").alias(f) for f in fields]), F.struct(F.col(f"b_{score}").alias("s"), -F.col("b_begin"), -F.col("b_end")))
        got = pairs.groupBy(*key).agg(top.alias("_t"), *[F.sum(f"b_{n}").alias(n) for n in numbers]).select(*key, *[F.col(f"_t.{f}").alias(f) for f in fields], *numbers)
    else:
        got = pairs.groupBy(*key).agg(*[F.array_join(F.array_sort(F.collect_set(F.col(f"b_{f}").cast("string"))), ",").alias(f) for f in fields], *[F.sum(f"b_{n}").alias(n) for n in numbers])
    got = got.withColumnsRenamed({"a_" + k: k for k in KEYS})
    return regjoin_fields(got, [*fields, *numbers], size)


def covered(a: DataFrame, by: str | None = None) -> DataFrame:
    """Positions in the regions by chromosome (or another column), and a row total."""
    x = regions(a, [by] if by else [])
    name = by or "chromosome"
    size = F.sum(F.col("end") - F.col("begin"))
    return x.groupBy(model.col(name)).agg(size.alias("bases")).union(x.agg(F.lit("total"), F.coalesce(size, F.lit(0))))


def reghisto(a: DataFrame) -> DataFrame:
    return regions(a, []).groupBy((F.col("end") - F.col("begin")).alias("size")).agg(F.count(F.lit(1)).alias("count"))


def compare_coverage(sets: dict[str, DataFrame], size: int = BIN) -> DataFrame:
    """Each set against the first: positions in common, sensitivity, specificity, false positives and negatives."""
    m = multireg(sets, size)
    names, length = list(sets), F.col("end") - F.col("begin")
    first = names[0]
    total = lambda c: F.coalesce(F.sum(F.when(c, length)), F.lit(0))
    parts = []
    for n in names[1:]:
        both, own, ref = total((F.col(first) == 1) & (F.col(n) == 1)), total(F.col(n) == 1), total(F.col(first) == 1)
        parts.append(F.struct(F.lit(n).alias("name"), both.alias("common"), (both / F.when(ref > 0, ref)).alias("sensitivity"), (both / F.when(own > 0, own)).alias("specificity"), (own - both).alias("fp"), (ref - both).alias("fn")))
    return m.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def regions_where(df: DataFrame, value: str, low: float | None = None, high: float | None = None, position: str = "pos", size: int = BIN) -> DataFrame:
    """Consecutive positions with low <= value <= high as regions; rows are single positions."""
    v = model.col(value).cast("double")
    cond = v.isNotNull()
    if low is not None:
        cond = cond & (v >= low)
    if high is not None:
        cond = cond & (v <= high)
    p = model.col(position).cast("long")
    chromosome = model.resolve_roles(df.columns)["chromosome"]
    return regjoin(df.where(cond).select(model.col(chromosome).alias("chromosome"), p.alias("begin"), (p + 1).alias("end")), size=size)


def depth(a: DataFrame, size: int = BIN) -> DataFrame:
    """Segments of equal depth: how many regions cover them."""
    s = segments({"a": regions(a, [])}, size).where("n_a > 0").withColumnRenamed("n_a", "depth")
    return _merge(s, size, ["depth"], False)


def covered_at_least(a: DataFrame, n: int, size: int = BIN) -> DataFrame:
    """Regions that n or more regions cover."""
    return _sweep({"a": regions(a, [])}, lambda c: c >= n, size, False)


def depth_histogram(a: DataFrame, target: DataFrame, most: int = 1000, size: int = BIN) -> DataFrame:
    """Positions by depth, most and more together, on and off target."""
    s = segments({"a": regions(a, []), "t": regions(target, [])}, size).where("n_a > 0")
    length = F.col("end") - F.col("begin")
    return s.groupBy(F.least("n_a", F.lit(most)).alias("depth")).agg(F.sum(F.when(F.col("n_t") > 0, length).otherwise(0)).alias("ontarget"), F.sum(F.when(F.col("n_t") == 0, length).otherwise(0)).alias("offtarget"))


def check_sort(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows that come before their predecessor in natural order of place; order gives the order of the file. Rows meet
    the one before in a window over CHECK_CHUNK of them; only the last of each meets the next chunk."""
    from ..natural import nat_columns
    from .select import with_row

    roles = model.resolve_roles(df.columns, KEYS)
    x = with_row(df, order, "_at").withColumn("_chr", chr_clip(model.col(roles["chromosome"]))).withColumn("_chunk", F.floor(F.col("_at") / CHECK_CHUNK))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate([*nat_columns("_chr"), model.col(roles["begin"]).cast("long"), model.col(roles["end"]).cast("long")])])
    lasts = x.where((F.col("_at") + 1) % CHECK_CHUNK == 0).select((F.col("_chunk") + 1).alias("_chunk"), key.alias("_last"))
    w = Window.partitionBy("_chunk").orderBy("_at")
    x = x.withColumn("_key", key).withColumn("_before", F.lag("_key").over(w)).join(F.broadcast(lasts), "_chunk", "left")
    x = x.withColumn("_before", F.coalesce("_before", F.when(F.col("_at") % CHECK_CHUNK == 0, F.col("_last"))))
    return x.where(F.col("_key") < F.col("_before")).select(*[model.col(c) for c in df.columns])
