"""Packing of documents into sequences by swap-based local search.

Pieces of one length are exchangeable, so packing works on the numbers of pieces by length, which the capacity
bounds however many documents there are. All lengths of all tasks meet: best fit in falling length gives
patterns (how many pieces of which lengths) and how many sequences have each, then local search goes on. The
emptiest sequences are the sources; pieces move, or are exchanged one for one, two for one and one for two, so
that a fuller sequence gets fuller, which raises the sum of the squared fills, until sources are empty. A step
is made in as many sequences of a pattern at once as there are. The search ends when the number of sequences
meets the bound of the total length, or when what is free elsewhere can't take any whole source, or when no
step raises the sum.

Each piece is then put by its number among all pieces of its length.
"""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, only
from .wordbpe import Encoder

CAPACITY, END_ID = 4096, 1
#: Numbers of pieces by length, longest first.
Pattern = tuple[tuple[int, int], ...]


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of piece numbers: longest first, each where the least room is left."""
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0  # bit r: there is a sequence with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = have >> n
        if fit:
            r = n + ((fit & -fit).bit_length() - 1)
            b = rooms[r].pop()
            if not rooms[r]:
                have &= ~(1 << r)
            bins[b].append(i)
            r -= n
        else:
            b, r = len(bins), capacity - n
            bins.append([i])
        if r:
            rooms[r].append(b)
            have |= 1 << r
    return bins


def best_fit_counts(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Sequences by pattern, as best_fit makes them, all pieces of a length at once."""
    rooms: list[list[tuple[int, Pattern]]] = [[] for _ in range(capacity + 1)]
    have = 0

    def put(k: int, items: Pattern, room: int) -> None:
        nonlocal have
        if k:
            rooms[room].append((k, items))
            have |= (room > 0) << room

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            fit = have >> n
            if fit:
                r = n + ((fit & -fit).bit_length() - 1)
                k, items = rooms[r].pop()
                if not rooms[r]:
                    have &= ~(1 << r)
            else:
                r, items = capacity, ()
                k = -(-left // (capacity // n))
            q = r // n
            whole = min(k, left // q)
            put(whole, (*items, (n, q)), r - q * n)
            left -= whole * q
            if whole < k:  # so less than q are left
                if left:
                    put(1, (*items, (n, left)), r - left * n)
                put(k - whole - (left > 0), items, r)
                left = 0
    out: Counter[Pattern] = Counter()
    for group in rooms:
        for k, items in group:
            out[items] += k
    return out


def _changed(items: Pattern, out: list[int], into: list[int]) -> Pattern:
    c = Counter(dict(items))
    c.subtract(out)
    c.update(into)
    return tuple(sorted(((n, q) for n, q in c.items() if q), reverse=True))


def _fill(items: Pattern) -> int:
    return sum(n * q for n, q in items)


def _pairs(items: Pattern) -> list[tuple[int, int]]:
    return [(n, m) for x, (n, q) in enumerate(items) for m, _ in (items[x:] if q > 1 else items[x + 1 :])]


class Patterns:
    """Local search over sequences by pattern; have: how many sequences have each."""

    def __init__(self, have: Counter[Pattern], capacity: int):
        self.have, self.capacity = Counter(have), capacity
        self.fills = {p: _fill(p) for p in have}
        self.closed: set[Pattern] = set()  # sources that no step helps

    def squared_fill(self) -> int:
        return sum(k * self.fills[p] ** 2 for p, k in self.have.items())

    def _add(self, p: Pattern, k: int) -> None:
        self.have[p] += k
        if not self.have[p]:
            del self.have[p]
        elif p not in self.fills:
            self.fills[p] = _fill(p)

    def step(self, s: Pattern) -> bool:
        """The step that fills another sequence best from sources s; False if none raises the squared fill."""
        fills, cap = self.fills, self.capacity
        others = [p for p, k in self.have.items() if fills[s] <= fills[p] < cap and (p != s or k > 1)]
        if not others:
            return False
        by_room: dict[int, Pattern] = {cap - fills[p]: p for p in others}
        for n, _ in s:  # moves, the longest piece first
            fit = [r for r in by_room if r >= n]
            if fit:
                return self._apply(s, by_room[min(fit)], [n], [])
        mine = [(n, [n]) for n, _ in s]
        both = mine + [(n + m, [n, m]) for n, m in _pairs(s)]
        return self._exchange(s, others, both, lambda p: [(n,) for n, _ in p]) or self._exchange(s, others, mine, _pairs)

    def _exchange(self, s: Pattern, others: list[Pattern], gives: list[tuple[int, list[int]]], backs_of) -> bool:
        """Exchange of gives for backs with the largest gain that fits."""
        least: dict[int, tuple[int, tuple, Pattern]] = {}  # by size back and room: the least size back
        for p in others:
            room = self.capacity - self.fills[p]
            for back in backs_of(p):
                z = sum(back)
                if z + room not in least or z < least[z + room][0]:
                    least[z + room] = (z, back, p)
        tops = sorted(least, reverse=True)
        best, at, gain = None, 0, 0
        now = None
        for size, out in sorted(gives, key=lambda g: -g[0]):
            while at < len(tops) and tops[at] >= size:
                if now is None or least[tops[at]][0] <= now[0]:
                    now = least[tops[at]]
                at += 1
            if now and size - now[0] > gain:
                best, gain = (now[2], out, list(now[1])), size - now[0]
        return bool(best) and self._apply(s, *best)

    def _apply(self, s: Pattern, b: Pattern, out: list[int], back: list[int]) -> bool:
        k = self.have[s] // 2 if s == b else min(self.have[s], self.have[b])
        self._add(s, -k), self._add(b, -k)
        self._add(_changed(b, back, out), k)
        if rest := _changed(s, out, back):
            self._add(rest, k)
        return True

    def search(self) -> Counter[Pattern]:
        cap = self.capacity
        total = sum(k * self.fills[p] for p, k in self.have.items())
        least, n = -(-total // cap), sum(self.have.values())
        while n > least:
            live = [p for p in self.have if self.fills[p] < cap and p not in self.closed]
            if not live:
                break
            s = min(live, key=lambda p: (self.fills[p], p))
            if n * cap - total - (cap - self.fills[s]) < self.fills[s]:
                break
            if not self.step(s):
                self.closed.add(s)
            n = sum(self.have.values())
        return self.have


class Search(Patterns):
    """The same over lists of piece numbers."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.pieces: dict[int, list[int]] = {}
        for i, n in enumerate(lengths.tolist()):
            self.pieces.setdefault(n, []).append(i)
        super().__init__(Counter(_changed((), [], [int(lengths[i]) for i in b]) for b in bins), capacity)

    def run(self) -> list[list[int]]:
        left = {n: iter(p) for n, p in self.pieces.items()}
        return [[next(left[n]) for n, q in p for _ in range(q)] for p, k in self.search().items() for _ in range(k)]


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Counter[Pattern]:
    """Sequences by pattern. Lengths of zero or above capacity aren't allowed."""
    return Patterns(best_fit_counts(counts, capacity), capacity).search()


def _ranges(have: Counter[Pattern]) -> np.ndarray:
    """Rows length, first piece of that length, sequence, offset, pieces a sequence; sorted. Pieces of a length
    from that one to the next row's go into sequences one after another."""
    rows, seq, used = [], 0, Counter()
    for p, k in sorted(have.items(), reverse=True):
        offset = 0
        for n, q in p:
            rows.append((n, used[n], seq, offset, q))
            used[n] += k * q
            offset += n * q
        seq += k
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"]
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _map(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, seen = None, TaskContext.get().partitionId(), Counter()
        end = int(end_id).to_bytes(4, "little")
        for b in batches:
            encoder = encoder or Encoder(path)
            ids = b.column(0).to_pylist()
            rows: list[tuple] = []
            for i in range(0, b.num_rows, 256):
                for doc_id, raw in zip(ids[i : i + 256], encoder.encode(b.column(1).slice(i, 256).to_pylist())):
                    raw += end
                    for p, s in enumerate(range(0, len(raw) // 4, capacity)):
                        piece = raw[4 * s : 4 * (s + capacity)]
                        n = len(piece) // 4
                        rows.append((doc_id, p, s, n, zlib.crc32(piece), block, seen[n]))
                        seen[n] += 1
            if rows:
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _COLUMNS)

    return run


def _place(ranges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = (ranges[:, 0] << 40) + ranges[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            r = ranges[np.searchsorted(starts, (length << 40) + rank, "right") - 1]
            k = rank - r[:, 1]
            cols = [*b.columns[:5], pa.array(r[:, 2] + k // r[:, 4]), pa.array(r[:, 3] + k % r[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _PLACED.split(", ")])

    return run


def packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document is its ids and end_id; only one longer than capacity is cut, into pieces of capacity and a last
    one that may be shorter. Null or empty text: end_id alone. A null doc_id is passed on; repeated rows are
    documents each. Empty table: no rows. Other columns aren't read.
    """
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialise(texts.mapInArrow(_map(path, capacity, end_id), _SCHEMA))
    each = table.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in each.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = each.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = table.join(first, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(_ranges(pack(counts, capacity))), _PLACED)
