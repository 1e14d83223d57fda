"""Scores of whole documents by a gated recurrent language model.

Counts of all words of all training documents give the base score, the vocabulary of the model, the biases
its output begins with, and the shares of the words outside the vocabulary, which the model sees as one rare
word. The model has one layer of gated recurrent units and an output softmax in two factors, the class of a
word and the word in its class. It is trained by truncated backpropagation in numpy: first on some
WARM_TOKENS tokens, then on every training document, in shards whose weights are averaged.

What the score is doesn't hang on how the rows lie in partitions: documents go to shards by a hash of id and
words, are read there in the order of that hash, in blocks of BLOCK tokens, and models are averaged in the
order of the shards. Of words of one count the lesser in bytes comes first in the vocabulary.

Documents lie one after another in LANES lanes. The state of a lane is carried from window to window and
reset where a document begins, so a document is scored as a whole, however long.

Counts of the HEAD most frequent words go to every task, others are joined. A word of more than LONG bytes is
known by its digest, so what goes to tasks is bounded in bytes.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import repeat
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, only, with_key

HIDDEN, WORDS, CLASS = 16, 2016, 48
HEAD, LONG = 1 << 18, 64
#: Tokens of the first phase of training, of a block, and shards at most: a shard has as many blocks as it needs.
WARM_TOKENS, BLOCK, SHARDS = 600_000, 1 << 20, 1 << 14
#: Copies of a row that go to a shard together.
COPIES = 64
LANES, WINDOW, TRAIN_WINDOW = 512, 32, 16
#: Bound of an output weight.
LARGEST = 4.0
#: Different words that a task counts before it hands them on; tokens that a task encodes or scores at once.
FLUSH, GROUP = 400_000, 1 << 20
#: Tokens of a document that is scored with others as long.
LENGTHY = 4096
#: Models that are averaged in one task.
FAN = 16
END = b""

Weights = dict[str, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words and the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: both concern ASCII only
    out.append(END)
    return out


def name_of(word: bytes) -> bytes:
    """What a word is known by: a long one by a byte that no text has and its digest."""
    return word if len(word) <= LONG else b"\xff" + blake2b(word, digest_size=32).digest()


# --- model ---


def initial(counts: np.ndarray, rare: float, hidden: int = HIDDEN, seed: int = 7) -> Weights:
    """counts: of the vocabulary's words in falling order. The rare word follows them and is a class by itself.
    The output biases are the log shares in the corpus. The last class may have places without a word. Units
    are rows and lanes columns, so that gates are contiguous; the last column of output weights is the bias."""
    rng, n = np.random.default_rng(seed), len(counts)
    classes = -(-n // CLASS)
    full = np.zeros(classes * CLASS)
    full[:n] = counts
    per_class = np.append(full.reshape(classes, CLASS).sum(axis=1), rare) + 1.0
    normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    wo, wc = normal(classes * CLASS, hidden + 1), normal(classes + 1, hidden + 1)
    wo[:, -1], wc[:, -1] = -60, np.log(per_class / per_class.sum())
    wo[:n, -1] = np.log(counts + 1.0)
    return {"table": normal(3 * hidden, n + 1) * 3, "u": normal(3 * hidden, hidden) * 2, "wc": wc, "wo": wo}


def _lanes(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid into lanes, the longest first into the shortest lane: word ids and document numbers by
    step and lane, and how many lanes each step has. Lanes are in falling order of length."""
    lanes = max(1, min(lanes, len(docs)))
    size = np.zeros(lanes, np.int64)
    held: list[list[int]] = [[] for _ in range(lanes)]
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    width = 1 if len(docs) <= 4 * lanes else lanes
    for at in range(0, len(order), width):
        part = order[at : at + width]
        for k, d in zip([int(np.argmin(size))] if width == 1 else np.argsort(size, kind="stable")[: len(part)].tolist(), part):
            held[k].append(d)
            size[k] += len(docs[d])
    by = np.argsort(-size, kind="stable")
    steps = int(size.max())
    ids, own = np.zeros((steps, lanes), np.uint16), np.full((steps, lanes), -1, np.int32)
    for lane, k in enumerate(by.tolist()):
        if held[k]:
            ids[: size[k], lane] = np.concatenate([docs[d] for d in held[k]])
            own[: size[k], lane] = np.repeat(held[k], [len(docs[d]) for d in held[k]])
    live = np.searchsorted(-size[by], -np.arange(steps), "left")
    return ids, own, live


def _inputs(ids: np.ndarray, own: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each, the end before the first of a document; where documents begin."""
    before, first = np.full_like(ids, end), np.ones(own.shape, bool)
    before[1:] = ids[:-1]
    first[1:] = own[1:] != own[:-1]
    before[first] = end
    return before, first


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The next state of the units, their gates (reset, update; piecewise linear), what the reset gate scales,
    and the new value x / (1 + |x|)."""
    hg = u @ h
    g = x[: 2 * n] + hg[: 2 * n]
    g *= 0.25
    g += 0.5
    np.maximum(g, 0, out=g)
    np.minimum(g, 1, out=g)
    c = hg[2 * n :]
    new = g[:n] * c
    new += x[2 * n :]
    scale = np.abs(new)
    scale += 1
    new /= scale
    out = h - new
    out *= g[n:]
    out += new
    return out, g, c, new


def _bits(w: np.ndarray) -> np.ndarray:
    """Weights whose products are the bits of a float of that exponent."""
    out = w * np.float32((1 << 23) / np.log(2.0))
    out[:, -1] += np.float32(127 * (1 << 23))
    return out


def _output(w: Weights, h: np.ndarray, target: np.ndarray, grads: Weights | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target (h: rows of states, a one at the end); with grads also what flows
    back to h. The exponential is the piecewise linear one that the bits of a float give: 2 ** k * (1 + f) for
    2 ** (k + f), which needs no more than a conversion and adds up to one as well. States are below one and
    weights at most LARGEST, so it can't overflow."""
    n, other = len(h), w["table"].shape[1] - 1
    classes = len(w["wc"]) - 1
    order = np.argsort(target, kind="stable")
    h, t = np.take(h, order, axis=0), target[order].astype(np.int64)
    cls = t // CLASS
    cls[t == other] = classes
    e = (h @ _bits(w["wc"]).T).astype(np.int32).view(np.float32)
    rows = np.arange(n)
    total = e @ np.ones(classes + 1, np.float32)
    out = np.log(e[rows, cls] / total).astype(np.float64)
    m = int(np.searchsorted(t, other))  # the rare word is alone in its class and comes last
    cuts = np.searchsorted(t[:m], np.arange(classes + 1) * CLASS).tolist()
    wo = _bits(w["wo"])
    p = np.empty((m, CLASS), np.float32)
    live = [(slice(cuts[k], cuts[k + 1]), slice(k * CLASS, (k + 1) * CLASS)) for k in range(classes) if cuts[k + 1] > cuts[k]]
    for s, z in live:
        np.matmul(h[s], wo[z].T, out=p[s])
    p = p.astype(np.int32).view(np.float32)
    within = p @ np.ones(CLASS, np.float32)
    at = t[:m] % CLASS
    out[:m] += np.log(p[rows[:m], at] / within)
    result = np.empty(n)
    result[order] = out
    if grads is None:
        return result, None
    e *= (1 / total)[:, None]
    e[rows, cls] -= 1
    grads["wc"] += e.T @ h
    dh = e @ w["wc"]
    p *= (1 / within)[:, None]
    p[rows[:m], at] -= 1
    for s, z in live:
        grads["wo"][z] += p[s].T @ h[s]
        dh[s] += p[s] @ w["wo"][z]
    back = np.empty_like(dh)
    back[order] = dh
    return result, back


def score(w: Weights, docs: list[np.ndarray], end: int, lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
    """Natural log probability of each document's words."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    ids, own, live = _lanes(docs, lanes)
    before, first = _inputs(ids, own, end)
    n = w["u"].shape[1]
    h = np.zeros((n, ids.shape[1]), np.float32)
    some = first.any(axis=1)
    for t0 in range(0, len(ids), window):
        t1, a0 = min(len(ids), t0 + window), int(live[t0])
        mask = np.arange(a0) < live[t0:t1, None]
        x = np.take(w["table"], before[t0:t1, :a0][mask], axis=1)
        hs = np.ones((x.shape[1], n + 1), np.float32)
        at = 0
        for t in range(t0, t1):
            a = int(live[t])
            h = h[:, :a]
            if some[t]:
                h = h * ~first[t, :a]
            h, *_ = _step(x[:, at : at + a], h, w["u"], n)
            hs[at : at + a, :n] = h.T
            at += a
        logp, _ = _output(w, hs, ids[t0:t1, :a0][mask])
        total += np.bincount(own[t0:t1, :a0][mask], logp, len(docs))
    return total


class Trainer:
    """Adam over windows of documents, gradients cut at window edges. What was fed before is remembered."""

    def __init__(self, w: Weights, rate: float, lanes: int = LANES, window: int = TRAIN_WINDOW):
        self.w, self.rate, self.lanes, self.window = {k: v.copy() for k, v in w.items()}, rate, lanes, window
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        self.step = self.seen = 0

    def feed(self, docs: list[np.ndarray], end: int) -> None:
        """A document much longer than others goes in parts, which learn beside each other."""
        if not docs:
            return
        most = max(64 * self.window, 2 * sum(map(len, docs)) // self.lanes)
        docs = [d[i : i + most] for d in docs for i in range(0, len(d), most)]
        w, window = self.w, self.window
        n = w["u"].shape[1]
        ids, own, live = _lanes(docs, self.lanes)
        before, first = _inputs(ids, own, end)
        some = first.any(axis=1)
        h = np.zeros((n, ids.shape[1]), np.float32)
        for t0 in range(0, len(ids), window):
            t1, a0 = min(len(ids), t0 + window), int(live[t0])
            mask = np.arange(a0) < live[t0:t1, None]
            words = before[t0:t1, :a0][mask]
            x = np.take(w["table"], words, axis=1)
            hs, kept, at = np.ones((x.shape[1], n + 1), np.float32), [], 0
            for t in range(t0, t1):
                a = int(live[t])
                h = h[:, :a]
                if some[t]:
                    h = h * ~first[t, :a]
                out, g, c, new = _step(x[:, at : at + a], h, w["u"], n)
                kept.append((at, h, g, c, new))
                h = out
                hs[at : at + a, :n] = h.T
                at += a
            grads = {k: np.zeros_like(v) for k, v in w.items()}
            _, dhs = _output(w, hs, ids[t0:t1, :a0][mask], grads)
            dhs = np.ascontiguousarray(dhs[:, :n].T)
            dx, carry = np.empty_like(x), np.zeros((n, a), np.float32)
            for i in range(t1 - t0 - 1, -1, -1):
                at, h0, g, c, new = kept[i]
                a = h0.shape[1]
                dh = dhs[:, at : at + a]
                dh[:, : carry.shape[1]] += carry[:, :a]
                r, z = g[:n], g[n:]
                dnew = np.abs(new)
                np.subtract(1, dnew, out=dnew)
                dnew *= dnew
                dnew *= dh
                dnew *= 1 - z
                d = np.empty((3 * n, a), np.float32)
                np.multiply(dnew, c, out=d[:n])
                np.subtract(h0, new, out=d[n : 2 * n])
                d[n : 2 * n] *= dh
                d[: 2 * n] *= ((g > 0) & (g < 1)) * np.float32(0.25)
                d[2 * n :] = dnew
                dx[:, at : at + a] = d
                d[2 * n :] *= r
                grads["u"] += d @ h0.T
                carry = dh * z
                carry += w["u"].T @ d
                if some[t0 + i]:
                    carry *= ~first[t0 + i, :a]
            order = np.argsort(words, kind="stable")
            of = words[order]
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            grads["table"][:, of[starts]] = np.add.reduceat(np.take(dx, order, axis=1), starts, axis=1)
            self._apply(grads, len(hs))

    def _apply(self, grads: Weights, size: int) -> None:
        self.step += 1
        self.seen += size
        scale = 1.0 / size
        norm = scale * np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale *= min(1.0, 1.0 / max(norm, 1e-9))
        now = self.rate * min(1.0, self.step / 20)
        for k, g in grads.items():
            g *= np.float32(scale)
            m1, m2 = self.m1[k], self.m2[k]
            m1 *= np.float32(0.9)
            m1 += np.float32(0.1) * g
            m2 *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            m2 += g
            root = np.sqrt(m2 / np.float32(1 - 0.99**self.step))
            root += np.float32(1e-6)
            self.w[k] -= np.float32(now / (1 - 0.9**self.step)) * m1 / root
        for k in ("wc", "wo"):
            np.clip(self.w[k][:, :-1], -LARGEST, LARGEST, out=self.w[k][:, :-1])


def train(w: Weights, docs: list[np.ndarray], end: int, rate: float, lanes: int = LANES, window: int = TRAIN_WINDOW, epochs: int = 1) -> tuple[Weights, int]:
    """Weights after epochs over docs; words seen."""
    t = Trainer(w, rate, lanes, window)
    for _ in range(epochs):
        t.feed(docs, end)
    return t.w, t.seen


def _dump(w: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def _load(raw: bytes) -> Weights:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


# --- counts ---


def _map_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(map(name_of, counts)), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    for b in batches:
        for t in b.column(0):
            counts.update(words_of(t.as_py()))
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    if counts:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary, the end is empty), c of all whole texts (one column), as a written table."""
    return materialise(texts.mapInArrow(_map_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))


def _head(counts: DataFrame, n: int) -> tuple[list[tuple[bytes, int]], int]:
    """The most frequent words, n at most, the end first; and the least count among them: all words of that
    count or a larger one are here. n bounds what comes to the driver and goes to tasks. The least count is
    found from the numbers of words in some hundred classes of counts, so nothing is sorted."""
    level = F.floor(F.log2("c") * 16)
    left, cut = n, None
    for row in counts.where(F.length("word") > 0).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        left -= row[1]
        if left < 0:
            break
        cut = row[0]
    ends = counts.where(F.length("word") == 0).first()
    rows = [(bytes(r[0]), r[1]) for r in counts.where((F.length("word") > 0) & (level >= cut)).collect()] if cut is not None else []
    rows.sort(key=lambda r: (-r[1], r[0]))
    return [(END, ends[1] if ends else 0), *rows], rows[-1][1] if rows else 1 << 62


# --- encoding ---


_ENCODED = "_k long, doc_id long, held_out boolean, n_tokens long, known long, base double, extra double, n_rare long, rare array<struct<w:binary,n:int>>, ids binary"


class Encoder:
    """Per task: texts to word ids of the model and what the base score needs. head: the most frequent words,
    the end first; words: how many of them the model knows; rare: the count of all others."""

    def __init__(self, head: list[tuple[bytes, int]], words: int, floor: float, rare: float):
        # without a training document the end is unknown too
        self.index = {w: i for i, (w, c) in enumerate(head) if c}
        c = np.array([c for _, c in head], np.float64)
        self.words = words
        self.base = np.append(np.log10(c + 0.1) - floor, 0.0)
        self.share = np.append(np.where(np.arange(len(c)) < words, 0.0, np.log10((c + 0.1) / rare)), 0.0)

    def encode(self, texts: list[str | None]) -> list[pa.Array]:
        every: list[bytes] = []
        size = []
        for t in texts:
            ws = words_of(t)
            size.append(len(ws))
            every += ws
        idx = np.fromiter(map(self.index.get, every, repeat(-1)), np.int64, len(every))
        ends = np.cumsum(size)
        starts = ends - size
        unknown = idx < 0
        at = np.flatnonzero(unknown)
        for i in at.tolist():
            if len(every[i]) > LONG:
                every[i] = name_of(every[i])
                idx[i] = self.index.get(every[i], -1)
        unknown = idx < 0
        at = np.flatnonzero(unknown)
        pairs = Counter(zip((np.searchsorted(starts, at, "right") - 1).tolist(), map(every.__getitem__, at.tolist())))
        known = np.add.reduceat((~unknown).astype(np.int64), starts)
        base, extra = np.add.reduceat(self.base[idx], starts), np.add.reduceat(self.share[idx], starts)
        times = np.bincount(np.fromiter((d for d, _ in pairs), np.int64, len(pairs)), minlength=len(texts))
        entries = pa.StructArray.from_arrays([pa.array([w for _, w in pairs], pa.binary()), pa.array(list(pairs.values()), pa.int32())], ["w", "n"])
        rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(times))), pa.int32()), entries)
        ids = np.where(unknown | (idx >= self.words), self.words, idx)
        ids[ends - 1] = 0  # the end has its place in the model even where it wasn't seen
        raw = ids.astype("<u2").tobytes()
        offsets = pa.py_buffer(np.concatenate(([0], 2 * ends)).astype(np.int32).tobytes())
        coded = pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(raw)])
        return [pa.array(size, pa.int64()), pa.array(known), pa.array(base), pa.array(extra), pa.array(np.array(size) - known), rare, coded]


def grouped(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """First and one past the last of groups of neighbours of about most in all, one at least."""
    first, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if i >= first:
        yield first, i + 1


def _map_encode(encoder: Encoder):
    names = [x.split()[0] for x in _ENCODED.replace("array<struct<w:binary,n:int>>", "array").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in grouped((n or 0 for n in b.column(4).to_pylist()), 4 * GROUP):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *encoder.encode(part.column(3).to_pylist())], names)

    return run


# --- training ---


def _map_train(raw: bytes, rate: float, most: int = 0, epochs: int = 1):
    """Batches (shard, reps, ids) sorted by shard: a model for each shard, fed block by block. most: tokens
    after which the rest of a shard isn't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, now, trainer, held, size, last = None, None, None, [], 0, False

        def flush() -> None:
            nonlocal held, size
            for _ in range(epochs if not most else max(1, min(epochs, 2 * most // max(1, size)))):
                trainer.feed(held, 0)
            held, size = [], 0

        def out() -> pa.RecordBatch:
            flush()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([trainer.seen], pa.int64()), pa.array([_dump(trainer.w)], pa.binary())], ["shard", "seen", "weights"])

        for b in batches:
            for shard, reps, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if shard != now:
                    if trainer:
                        yield out()
                    first = first or _load(raw)
                    now, trainer, last = shard, Trainer(first, rate), False
                if last:
                    continue
                doc = np.frombuffer(ids.as_buffer(), "<u2")
                for _ in range(reps):
                    held.append(doc)
                    size += len(doc)
                    if most and size >= most:
                        last = True
                        break
                    if not most and size >= BLOCK:
                        flush()
        if trainer:
            yield out()

    return run


def _mean(models: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    """Weights averaged by words seen, in the order given."""
    total, seen = None, 0
    for n, raw in models:
        w = _load(raw)
        total = {k: n * v.astype(np.float64) + (total[k] if total else 0) for k, v in w.items()}
        seen += n
    return seen, _dump({k: (v / seen).astype(np.float32) for k, v in total.items()})


def _map_average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (to, shard, seen, weights) sorted by to and shard: a model for each to."""
    now, held = None, []

    def out() -> pa.RecordBatch:
        seen, raw = _mean(held)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([seen], pa.int64()), pa.array([raw], pa.binary())], ["shard", "seen", "weights"])

    for b in batches:
        for to, n, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            if to != now:
                if held:
                    yield out()
                now, held = to, []
            held.append((n, raw.as_py()))
    if held:
        yield out()


_MODEL = "shard long, seen long, weights binary"


def fit(coded: DataFrame, w: Weights, tokens: int, warm: int = WARM_TOKENS, block: int = BLOCK) -> Weights:
    """Weights learned from coded (doc_id, ids), the training documents as word ids; tokens: how many they have."""
    if not tokens:
        return w
    h = F.xxhash64("doc_id", "ids")
    share = int(min(1.0, 1.5 * warm / tokens) * 1_000_000) + 1
    some = coded.where(F.pmod(F.xxhash64("doc_id", "ids", F.lit(1)), F.lit(1_000_000)) < share).groupBy("doc_id", "ids").agg(F.lit(1).alias("reps"))
    some = some.select(F.lit(0).cast("long").alias("shard"), "reps", "ids", h.alias("h")).repartition(1).sortWithinPartitions("h", "ids").select("shard", "reps", "ids")
    row = some.mapInArrow(_map_train(_dump(w), 0.01, warm, 4), _MODEL).first()  # one model
    if row:
        w = _load(bytes(row["weights"]))
    # rows that are the same in all are counted first, so that a hot one is spread over shards by COPIES
    each = coded.groupBy("doc_id", "ids").agg(F.count(F.lit(1)).alias("m"))
    each = each.select("doc_id", "ids", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES))).alias("part"))
    shards = min(SHARDS, -(-tokens // block))
    each = each.select(h.alias("h"), F.pmod(F.xxhash64("doc_id", "ids", "part"), F.lit(shards)).alias("shard"), F.least(F.lit(COPIES), F.col("m") - F.col("part") * COPIES).cast("int").alias("reps"), "ids")
    parts = min(shards, int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    models = materialise(each.repartition(parts, "shard").sortWithinPartitions("shard", "h", "ids", "reps").select("shard", "reps", "ids").mapInArrow(_map_train(_dump(w), 0.004), _MODEL))
    while shards > FAN:
        shards = -(-shards // FAN)
        tall = models.select(F.floor(F.col("shard") / FAN).alias("to"), "shard", "seen", "weights")
        more = materialise(tall.repartition(min(shards, parts), "to").sortWithinPartitions("to", "shard").mapInArrow(_map_average, _MODEL))
        discard(models)
        models = more
    rows = models.orderBy("shard").collect()  # FAN models at most
    discard(models)
    return _load(_mean([(r["seen"], bytes(r["weights"])) for r in rows])[1]) if rows else w


# --- queries ---


def _map_score(weights: Weights):
    """Long documents wait for each other, so that they lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out(b: pa.RecordBatch) -> pa.RecordBatch:
            rest = [c for c in b.schema.names if c != "ids"]
            docs = [np.frombuffer(x.as_buffer(), "<u2") for x in b.column("ids")]
            return pa.RecordBatch.from_arrays([*map(b.column, rest), pa.array(score(weights, docs, 0) / np.log(10.0))], [*rest, "model"])

        for b in batches:
            n = b.column("n_tokens").to_numpy()
            for i, j in grouped(np.where(n < LENGTHY, n, 0).tolist(), 2 * GROUP):
                part = b.slice(i, j - i)
                long = pa.array(n[i:j] >= LENGTHY)
                if (few := part.filter(pc.invert(long))).num_rows:
                    yield out(few)
                if (few := part.filter(long)).num_rows:
                    held.append(few)
                    size += int(n[i:j][n[i:j] >= LENGTHY].sum())
                if size >= 4 * GROUP:
                    yield from map(out, pa.Table.from_batches(held).combine_chunks().to_batches())
                    held, size = [], 0
        if held:
            yield from map(out, pa.Table.from_batches(held).combine_chunks().to_batches())

    return run


def lm_scores(docs: DataFrame, words: int = WORDS, head_size: int = HEAD, folds: int = 10, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Rows whose crc32 of doc_id as text is 0 modulo folds are held out: nothing is learned from them. Null
    text: empty, so the end alone. A null doc_id counts as an empty text in the crc32 (held out) and is
    passed on. Repeated rows count and are scored each. Without any training row every count is zero.
    Empty table: no rows. Other columns aren't read.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0
    keyed = with_key(only(docs, "doc_id", "text")).select("_k", F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = word_counts(keyed.where("not held_out").select("text"))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head, least = _head(counts, head_size)
    words = min(words, len(head))
    in_model = sum(c for _, c in head[:words])
    known_types = sum(c > 0 for _, c in head[:words])
    floor = log10(tokens + 0.1 * (distinct + 1))
    rare = (tokens - in_model) + 0.1 * (distinct - known_types + 1)
    coded = materialise(keyed.withColumn("_n", F.length("text")).mapInArrow(_map_encode(Encoder(head, words, floor, rare)), _ENCODED))
    first = initial(np.array([c for _, c in head[:words]], np.float64), max(0.0, tokens - in_model))
    weights = fit(coded.where("not held_out").select("doc_id", "ids"), first, tokens, block=block)
    each = coded.where("n_rare > 0").select("_k", F.explode("rare").alias("x")).select("_k", F.col("x.w").alias("word"), F.col("x.n").alias("n"))
    tail = counts.where((F.col("c") < least) & (F.length("word") > 0))
    c = F.coalesce("c", F.lit(0))
    late = each.join(tail, "word", "left").groupBy("_k").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("late_known"), F.sum(F.col("n") * F.log10(c + F.lit(0.1))).alias("late")
    )
    late = materialise(late)
    discard(counts)
    scored = coded.drop("rare").mapInArrow(_map_score(weights), ", ".join(x for x in _ENCODED.split(", ") if x.split()[0] not in ("ids", "rare")) + ", model double")
    n = F.col("n_rare")
    out = scored.join(late, "_k", "left").fillna(0, ["late_known", "late"])
    # the end of a training-less corpus is in the model, not among the rare words
    in_rare = n if head[0][1] else n - 1
    late_model = F.col("late") if head[0][1] else F.col("late") - log10(0.1)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("late_known")).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("late") - n * F.lit(floor)).alias("base_score"), (F.col("model") + F.col("extra") + late_model - in_rare * F.lit(log10(rare))).alias("score"),
    )
