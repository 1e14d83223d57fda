"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree splits recursively at the median of a random projection; a vector within ``spill`` of the split
goes to both sides. Two unit vectors of cosine c are at most sqrt(2 - 2c) apart and their projections differ
by far less as a rule, so a linked pair is rarely parted, and the trees part different pairs. Vectors meet in
leaves, where all pairs are verified in double precision; leaves larger than MAX_LEAF are cut into blocks of
which each pair is a task of its own. A pair that meets in several leaves counts in the first only, which is
found from the leaves that every vector carries. A leaf hands on counts and the edges of a spanning forest,
never its pairs, and equal vectors are one class with a weight, so dense groups cost no rows.

Splits are fitted on at most SAMPLE vectors; all vectors are routed through them. Where there are so many vectors
that leaves of the sample would be too large, each leaf goes on splitting below the sample: at the middle of what
it holds of the sample, along random directions, as many levels as the number of all vectors asks for. So a
leaf doesn't grow with the table, and each vector finds its leaves by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, discard, join_classes, materialise, only

THRESHOLD, TREES, SPILL = 0.95, 8, 0.02
#: Vectors that the splits are fitted on; vectors a leaf should have; rows of a block; the least of the sample in a leaf.
SAMPLE, LEAF, MAX_LEAF, LEAST = 60_000, 400, 4096, 4
#: A split that leaves a child more than this share of its parent isn't made.
PROGRESS = 0.75
#: Random directions of a tree at each depth.
POOL = 16


class Tree:
    """threshold[node] (nan: a leaf) and child[node] (left, the right one follows), nodes in order of creation."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.threshold: list[float] = []
        self.child: list[int] = []
        self.depth: list[int] = []
        self.below: dict[int, np.ndarray] = {}  # of a leaf: where it is split further, by level and direction
        self._directions: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_directions": {}}

    def directions(self, d: int) -> np.ndarray:
        if d not in self._directions:
            x = np.random.default_rng([self.seed, d]).standard_normal((POOL, self.dim))
            self._directions[d] = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._directions[d]

    def direction(self, node: int) -> np.ndarray:
        return self.directions(self.depth[node])[node % POOL]

    def _node(self, depth: int) -> int:
        self.threshold.append(np.nan), self.child.append(-1), self.depth.append(depth)
        return len(self.threshold) - 1

    def fit(self, x: np.ndarray, least: int, spill: float, levels: int = 0) -> Tree:
        def leaf(node: int, rows: np.ndarray) -> None:
            if levels:
                middle = x[rows].mean(axis=0) if len(rows) else np.zeros(x.shape[1])
                self.below[node] = np.array([self.directions(100 + i) @ middle for i in range(levels)], np.float32)

        todo = [(self._node(0), np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= least or self.depth[node] > 40:
                leaf(node, rows)
                continue
            p = x[rows] @ self.direction(node)
            cut = float(np.median(p))
            left, right = p <= cut + spill, p >= cut - spill
            if max(left.sum(), right.sum()) > PROGRESS * len(rows):
                leaf(node, rows)
                continue
            self.threshold[node] = cut
            a, b = self._node(self.depth[node] + 1), self._node(self.depth[node] + 1)
            self.child[node] = a
            assert b == a + 1
            todo += [(a, rows[left]), (b, rows[right])]
        return self

    def route(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """row, leaf of all leaves that each row reaches, rows in order. A leaf that is split further has the
        path below it in its number."""
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        levels = len(next(iter(self.below.values()))) if self.below else 0

        def further(cuts: np.ndarray, path: int, level: int, at: np.ndarray) -> None:
            if level == levels or not len(at):
                rows.append(at), leaves.append(np.full(len(at), path))
                return
            k = path % POOL
            p = x[at] @ self.directions(100 + level)[k]
            further(cuts, 2 * path, level + 1, at[p <= cuts[level, k] + spill])
            further(cuts, 2 * path + 1, level + 1, at[p >= cuts[level, k] - spill])

        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            cut = self.threshold[node]
            if cut != cut:
                further(self.below.get(node), node, 0, at)
                continue
            p = x[at] @ self.direction(node)
            todo += [(self.child[node], at[p <= cut + spill]), (self.child[node] + 1, at[p >= cut - spill])]
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        order = np.argsort(row, kind="stable")
        return row[order], leaf[order]


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of one dimension as unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _map_pack(kind: str):
    """vec_id, v: the components as bytes; null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                v = None
                if x.is_valid and len(x) and not x.values.null_count:
                    a = np.asarray(x.values.to_numpy(zero_copy_only=False), kind)
                    if np.isfinite(a).all() and a.any():
                        v = a.tobytes()
                out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    return run


def fit(sample: list[bytes], n: int, kind: str, trees: int, spill: float, leaf: int) -> dict[int, list[Tree]]:
    """Trees for each number of bytes in a vector."""
    by: dict[int, list[bytes]] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    out = {}
    least = max(LEAST, leaf * len(sample) // max(1, n))
    # vectors that a leaf of the sample would hold, against those it should
    levels = max(0, int(np.ceil(np.log2(max(1.0, least * n / max(1, len(sample)) / (2 * leaf))))))
    for size, rows in by.items():
        x = unit(rows, kind)
        out[size] = [Tree(x.shape[1], 1000 * size + t).fit(x, least, spill, levels) for t in range(trees)]
    return out


def _map_route(forest: dict[int, list[Tree]], kind: str, spill: float):
    """A row for each leaf that a vector reaches: its place (tree << 48) + leaf, and the vector's lesser places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            size = np.array(list(map(len, raw)), np.int64)
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                x = unit([raw[i] for i in at], kind)
                own = forest.get(s)  # a size that the sample lacks: one leaf for all
                met = [t.route(x, spill) for t in own] if own else [(np.arange(len(at)), np.zeros(len(at), np.int64))]
                row = np.concatenate([r for r, _ in met])
                place = np.concatenate([leaf + (t << 48) for t, (_, leaf) in enumerate(met)])
                order = np.lexsort((place, row))
                row, place = row[order], place[order]
                offsets = np.searchsorted(row, np.arange(len(at) + 1))
                before = np.arange(len(row)) - offsets[row]
                ends = np.concatenate(([0], np.cumsum(before)))
                flat = np.arange(ends[-1]) - np.repeat(ends[:-1], before) + np.repeat(offsets[row], before)
                places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[flat], pa.int64()))
                take = pa.array(at[row])
                cols = [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(np.full(len(row), s, np.int32)), pa.array(place, pa.int64()), places]
                yield pa.RecordBatch.from_arrays(cols, ["c", "v", "w", "size", "place", "places"])

    return run


class Meetings:
    """Which rows have lesser places in common: a bit for each place that several rows have. A pair costs a step for
    64 such places, not one for each two of its own. Bits are kept for PLACES places at a time."""

    PLACES = 1 << 13

    def __init__(self, places: list[np.ndarray]):
        counts = np.fromiter(map(len, places), np.int64, len(places))
        flat = np.concatenate([*places, np.zeros(0, np.int64)])
        _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
        several = often > 1
        nth = np.cumsum(several) - 1
        keep = several[at]
        self.n, self.row, self.place = len(places), np.repeat(np.arange(len(places)), counts)[keep], nth[at][keep]
        self.shared = int(several.sum())
        self.kept = self._bits(0) if self.shared <= self.PLACES else None

    def _bits(self, start: int) -> np.ndarray:
        own = (self.place >= start) & (self.place < start + self.PLACES)
        row, place = self.row[own], self.place[own] - start
        bits = np.zeros((-(-min(self.PLACES, self.shared - start) // 64), self.n), np.uint64)
        np.bitwise_or.at(bits, (place >> 6, row), np.uint64(1) << (place & 63).astype(np.uint64))
        return bits

    def first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the rows i and j have none of their lesser places in common."""
        ok, left = np.zeros(len(i), bool), np.arange(len(i))
        for start in range(0, self.shared, self.PLACES):
            for word in self.kept if self.kept is not None else self._bits(start):
                left = left[(word[i[left]] & word[j[left]]) == 0]
        ok[left] = True
        return ok


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row reaches by edges (i, j)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(c: np.ndarray, w: np.ndarray, x: np.ndarray, side: np.ndarray, places: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near: the weight linked to each row and met here first; a, b: edges of a spanning forest of the links.
    Rows of two sides are compared across, of one side with each other."""
    near = np.zeros(len(c), np.int64)
    two = side.min() != side.max()
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    ea, eb = [], []
    meetings = None
    for k in range(0, len(left), 512):
        rows = left[k : k + 512]
        cols = right if two else right[k:]
        hit_i, hit_j = np.nonzero(x[rows] @ x[cols].T >= threshold)
        i, j = rows[hit_i], cols[hit_j]
        if not two:
            keep = i < j
            i, j = i[keep], j[keep]
        for s in range(0, len(i), 1 << 18):
            a, b = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            meetings = meetings or Meetings(places)
            ok = meetings.first(a, b)
            near += np.bincount(a[ok], w[b[ok]], len(c)).astype(np.int64) + np.bincount(b[ok], w[a[ok]], len(c)).astype(np.int64)
        if len(i):
            # edges so far, as a forest
            root = _roots(len(c), np.concatenate([*ea, i]), np.concatenate([*eb, j]))
            at = np.flatnonzero(root != np.arange(len(c)))
            ea, eb = [root[at]], [at]
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate(ea), np.concatenate(eb)) if ea else (none, none)
    return near, c[a], c[b]


def _map_compare(kind: str, threshold: float):
    """Batches sorted by task (place, size, pair of blocks): a row for each class with links there: its weight
    of links, and another class it is linked to (a path of links) or null."""

    def work(t: pa.RecordBatch) -> pa.RecordBatch | None:
        c, w = t.column("c").to_numpy(), t.column("w").to_numpy()
        if len(c) < 2:
            return None
        off = t.column("places").offsets.to_numpy()
        flat = t.column("places").values.to_numpy()
        places = [flat[off[k] : off[k + 1]] for k in range(len(c))]
        x = unit(t.column("v").to_pylist(), kind)
        near, a, b = compare(c, w, x, t.column("side").to_numpy(), places, threshold)
        to = dict(zip(b.tolist(), a.tolist()))
        at = np.flatnonzero((near > 0) | np.isin(c, b))
        if not len(at):
            return None
        return pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(near[at]), pa.array([to.get(k) for k in c[at].tolist()], pa.int64())], ["c", "near", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                out = work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held.clear()
                if out is not None:
                    yield out

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in ("place", "size", "pair")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                key = tuple(keys[s].tolist())
                if key != last:
                    yield from flush()
                    last = key
                held.append(b.slice(s, e - s))
        yield from flush()

    return run


def links(classes: DataFrame, kind: str, threshold: float, trees: int, spill: float, leaf: int, sample: int, max_leaf: int) -> DataFrame:
    """c, near, to of classes (c, v, w), as a written table: rows of several leaves, to be summed."""
    n = classes.count()
    share = min(1.0, sample / max(1, n))
    some = classes.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else classes
    forest = fit([bytes(r[0]) for r in some.select("v").limit(sample + sample // 10).collect()], n, kind, trees, spill, leaf)
    routed = materialise(classes.select("c", "v", "w").mapInArrow(_map_route(forest, kind, spill), "c long, v binary, w long, size int, place long, places array<long>"))
    large = routed.groupBy("place", "size").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > max_leaf).select("place", "size", F.ceil(F.col("m") / max_leaf).cast("int").alias("blocks"))
    large = materialise(large)
    cols = ["place", "size", "pair", "side", "c", "w", "v", "places"]
    if large.limit(1).count():
        block = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
        # the row meets every block: pair (lesser, greater), numbered lesser * blocks + greater
        wide = routed.join(large, ["place", "size"]).withColumn("mine", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        wide = wide.withColumn("pair", F.least("mine", "with").cast("long") * F.col("blocks") + F.greatest("mine", "with")).withColumn("side", (F.col("mine") > F.col("with")).cast("int"))
        rest = routed.join(large, ["place", "size"], "left_anti").withColumn("pair", F.lit(0).cast("long")).withColumn("side", F.lit(0))
        tasks = rest.select(cols).union(wide.select(cols))
    else:
        tasks = routed.withColumn("pair", F.lit(0).cast("long")).withColumn("side", F.lit(0)).select(cols)
    found = tasks.repartition("place", "size", "pair").sortWithinPartitions("place", "size", "pair", "side", "c").mapInArrow(_map_compare(kind, threshold), "c long, near long, to long")
    found = materialise(found)
    discard(routed, large)
    return found


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, sample: int = SAMPLE, max_leaf: int = MAX_LEAF
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    Linked: cosine >= threshold. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different length. Equal vectors are linked, repeated rows too, and
    count each. A null vec_id keeps its row; it is passed over in component_id unless its component has no
    other, and never kept. Empty table: no rows. Other columns aren't read.
    """
    vectors = only(vectors, "vec_id", "embedding")
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding") if single else F.col("embedding").cast("array<double>"))
    packed = materialise(rows.mapInArrow(_map_pack(kind), "vec_id long, v binary"))
    classes = packed.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"))
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()))
    found = links(classes, kind, threshold, trees, spill, leaf, sample, max_leaf)
    comp = components(found.where("to is not null").select(F.col("c").alias("a"), F.col("to").alias("b")))
    near = found.groupBy("c").agg(F.sum("near").alias("near"))
    per = classes.join(near, "c", "left").join(comp.select(F.col("node").alias("c"), "component"), "c", "left")
    per = per.select("v", "w", "least", (F.coalesce("near", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "c").alias("component"))
    per = materialise(per)
    ids = per.groupBy("component").agg(F.min("least").alias("component_id"))
    each = materialise(per.join(ids, "component").select("v", "w", "n_links", "component_id"))
    discard(found, classes, comp, per)
    out = join_classes(packed, each, "v")
    alone = F.col("n_links").isNull()
    cid = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(False)).alias("kept"))


#: The same rows of a table embeddings (vec_id, embedding) in DuckDB: all pairs are compared.
SQL = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT k, vec_id, list_transform(e, lambda x: x / m) AS e FROM (SELECT *, list_max(list_transform(e, lambda x: abs(x))) AS m FROM v) WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND m > 0),
l AS (SELECT a.k AS x, b.k AS y FROM ok a JOIN ok b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(k, r) AS (SELECT x, x FROM l UNION SELECT l.y, reach.r FROM reach JOIN l ON l.x = reach.k),
c AS (SELECT reach.k, min(v.vec_id) AS component_id FROM reach JOIN v ON v.k = reach.r GROUP BY reach.k),
n AS (SELECT x AS k, count(*) AS n_links FROM l GROUP BY x)
SELECT CAST(vec_id AS BIGINT) AS vec_id, coalesce(n_links, 0) AS n_links, CAST(coalesce(component_id, vec_id) AS BIGINT) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept FROM v LEFT JOIN c USING (k) LEFT JOIN n USING (k)"""
