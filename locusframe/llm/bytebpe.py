"""Byte-level BPE: exact token counts per distinct pre-token, and encoding by a rank queue.

``token_counts`` keeps no ids: the pieces of each distinct pre-token of the corpus are counted once, that table
is joined to the pre-token frequencies of each document, and the products are summed. The HEAD most frequent
pre-tokens, most of a text, are joined in the task that reads it; only the others are shuffled.

``encode`` merges the parts of a pre-token with a queue of merge ranks: one bucket per rank holds the
positions whose pair has that rank, a hierarchy of bitmaps (64 bits a word) over the buckets gives the least
rank by three find-first-set steps, and entries whose pair has changed meanwhile are skipped when they come
up. A pre-token of n bytes takes O(n log n) steps, as positions of a bucket are a heap.

Short pre-tokens are merged many at a time by one queue (``merge_all``): no pair reaches across two of them, so the
least rank of all is the least of each that has it. A bucket is taken as a whole, but of each pre-token its first
position only, as a merge may make a pair of lesser rank there; the others go back.
"""

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from heapq import heappop, heappush
from itertools import repeat
from operator import mul

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import discard, materialise, only, with_key

#: Pre-tokens that go to every task; bytes beyond which one is known by its digest, which bounds that in bytes.
HEAD, LONG = 1 << 18, 64
#: Different pre-tokens that a task counts before it hands them on.
FLUSH = 300_000
#: Pre-tokens of up to LONG bytes that the encoder of a task remembers; beyond, the memory begins anew.
MEMORY = 1_000_000
#: Characters of the texts, and bytes of the pre-tokens, that the encoder takes at a time.
GROUP, AT_ONCE = 4_000_000, 1 << 22


# --- counts ---


class Pretokens:
    """Texts to pre-tokens, special tokens apart; the library's number of pieces of a pre-token."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer, self.split = Tokenizer.from_file(path), regex.compile(pattern).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None

    def of(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and how many special tokens it has."""
        if not any(s in text for s in self.special):
            return self.split(text), 0
        parts = self.cut(text)
        return [w for p in parts for w in self.split(p)], len(parts) - 1

    def pieces(self, words: list[str]) -> list[int]:
        """Between line feeds a pre-token splits as it does alone, unless it is white space itself; where that
        doesn't hold, each is encoded alone."""
        out = np.zeros(len(words), np.int64)
        alone = [i for i, w in enumerate(words) if w.isspace() or w in self.special]
        plain = [i for i, w in enumerate(words) if not (w.isspace() or w in self.special)]
        if plain:
            e = self.tokenizer.encode("\n".join(["", *map(words.__getitem__, plain)]), add_special_tokens=False)
            n = np.bincount(np.array(e.word_ids, np.int64))[1::2]
            if len(n) == len(plain):
                out[plain] = n
            else:
                alone = list(range(len(words)))
        if alone:
            out[alone] = [len(e.ids) for e in self.tokenizer.encode_batch([words[i] for i in alone], add_special_tokens=False)]
        return out.tolist()


def name_of(word: str) -> bytes:
    """What a pre-token is known by: its bytes, a long one's digest behind a byte that no text has."""
    raw = word.encode("utf-8", "surrogatepass")
    return raw if len(raw) <= LONG else b"\xff" + blake2b(raw, digest_size=32).digest()


def _map_distinct(path: str, pattern: str):
    """Pre-tokens with their number, each once for FLUSH different ones of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, size = None, Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for b in batches:
            own = own or Pretokens(path, pattern)
            for t in b.column(0):
                text = t.as_py() or ""
                counts.update(own.of(text)[0])
                size += len(text)
                if len(counts) > FLUSH or size > FLUSH * 100:
                    yield out()
                    counts.clear()
                    size = 0
        if counts:
            yield out()

    return run


def _map_pieces(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            own = own or Pretokens(path, pattern)
            words = [w.decode("utf-8", "surrogatepass") for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(name_of, words)), pa.binary()), b.column(1), pa.array(own.pieces(words), pa.int64())], ["word", "c", "pieces"])

    return run


def piece_table(texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """word (its name), c, pieces of each distinct pre-token of the texts (one column), as a written table."""
    distinct = texts.mapInArrow(_map_distinct(path, pattern), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return materialise(distinct.mapInArrow(_map_pieces(path, pattern), "word binary, c long, pieces long"))


def _map_sums(path: str, pattern: str, head: dict[bytes, int]):
    """Per document: the pieces of its pre-tokens that the head has, and those that are still to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = None, None
        for b in batches:
            if own is None:
                own, known = Pretokens(path, pattern), {w.decode("utf-8", "surrogatepass"): n for w, n in head.items() if w[:1] != b"\xff"}
                long = {w: n for w, n in head.items() if w[:1] == b"\xff"}
            size, total, rare, times, ends = [], [], [], [], [0]
            for t in b.column(2):
                text = t.as_py() or ""
                words, extra = own.of(text)
                freq = Counter(words)
                n = extra + sum(map(mul, map(known.get, freq, repeat(0)), freq.values()))
                for w in [w for w in freq if w not in known]:
                    name = name_of(w)
                    if name in long:
                        n += long[name] * freq[w]
                    else:
                        rare.append(name)
                        times.append(freq[w])
                size.append(len(text.encode("utf-8", "surrogatepass")))
                total.append(n)
                ends.append(len(rare))
            entries = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["w", "n"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["_k", "doc_id", "n_bytes", "n", "rare"])

    return run


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    Strings of special tokens inside a text count as one token each, the library's default. Null or empty
    text: no tokens. A null doc_id is passed on, repeated rows are counted each. Empty table: no rows. Other
    columns aren't read.
    """
    texts = with_key(only(docs, "doc_id", "text")).select("_k", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = piece_table(texts.select("text"), path, pattern)
    # all pre-tokens of at least some frequency go to every task, head at most; the rest is joined
    level = F.floor(F.log2("c") * 16)
    left, cut = head, 1 << 30
    for row in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        left -= row[1]
        if left < 0:
            break
        cut = row[0]
    known = {bytes(r[0]): r[1] for r in table.where(level >= cut).select("word", "pieces").collect()}
    done = materialise(texts.mapInArrow(_map_sums(path, pattern, known), "_k long, doc_id long, n_bytes long, n long, rare array<struct<w:binary,n:long>>"))
    each = done.where(F.size("rare") > 0).select("_k", F.explode("rare").alias("x")).select("_k", F.col("x.w").alias("word"), F.col("x.n").alias("times"))
    late = materialise(each.join(table.where(level < cut).select("word", "pieces"), "word").groupBy("_k").agg(F.sum(F.col("times") * F.col("pieces")).alias("late")))
    discard(table)
    n = F.col("n") + F.coalesce("late", F.lit(0))
    return done.drop("rare").join(late, "_k", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


# --- encoding ---


class RankQueue:
    """Positions by rank. low has a bit for each rank whose bucket holds positions, mid a bit for each word of
    low that isn't zero; the third level, a bit for each word of mid, and the buckets belong to one run. All
    bits are zero between two runs. RankEncoder.merge works on the fields itself: it is called for millions of
    pre-tokens, and calls of methods would double its time."""

    def __init__(self, ranks: int):
        words = -(-ranks // 64)
        self.low, self.mid = [0] * words, [0] * -(-words // 64)


class RankEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.known: dict[str, bytes] = {}
        # ranks of pairs by both ids, sorted; none is the id of what is beyond a pre-token
        self.none = max(ranks.values()) + 1
        self.size = self.none + 1
        get = ranks.get
        made = [(a, b, r) for w, r in ranks.items() for i in range(1, len(w)) if (a := get(w[:i])) is not None and (b := get(w[i:])) is not None]
        a, b, r = np.array([*made, (self.size, 0, -1)], np.int64).T  # the last is beyond all others
        pairs = a * self.size + b
        order = np.argsort(pairs)
        self.pairs, self.rank_of = pairs[order], r[order]
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "RankEncoder":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, low, mid = self.ranks, self.queue.low, self.queue.mid
        get = ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n, top = len(piece), 0
        buckets: dict[int, list[int]] = {}
        rank_at = [get(piece[i : i + 2]) for i in range(n - 1)]
        rank_at.append(None)
        for i, r in enumerate(rank_at):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)  # positions rise, so the list is a heap
                else:
                    buckets[r] = [i]
                    w = r >> 6
                    if not low[w]:
                        mid[w >> 6] |= 1 << (w & 63)
                        top |= 1 << (w >> 6)
                    low[w] |= 1 << (r & 63)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while top:
            t = (top & -top).bit_length() - 1  # find first set, three times
            m = mid[t]
            w = (t << 6) + (m & -m).bit_length() - 1
            x = low[w]
            rank = (w << 6) + (x & -x).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[w] = x = x & (x - 1)
                if not x:
                    mid[t] = m = m & (m - 1)
                    if not m:
                        top &= top - 1
            if rank_at[i] != rank:
                continue  # stale: one of the pair was merged since
            j = after[i]
            k = after[i] = after[j]
            rank_at[j] = None
            h = before[i]
            if k < n:
                before[k] = i
                r = rank_at[i] = get(piece[i : after[k]])
            else:
                r = rank_at[i] = None
            while True:  # the pair that begins here, then the one before
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        w = r >> 6
                        if not low[w]:
                            mid[w >> 6] |= 1 << (w & 63)
                            top |= 1 << (w >> 6)
                        low[w] |= 1 << (r & 63)
                if h < 0:
                    break
                r = get(piece[h:k])
                if r == rank_at[h]:
                    break
                rank_at[h], i, h = r, h, -1
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1: none."""
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.rank_of[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each of many short pre-tokens."""
        out = [b""] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif p:
                todo.append(i)
        lengths = np.array([len(pieces[i]) for i in todo], np.int64)
        chunk = np.cumsum(lengths) // AT_ONCE
        for c in np.unique(chunk).tolist():
            own = np.flatnonzero(chunk == c).tolist()
            for i, ids in zip((todo[k] for k in own), self._merge_all([pieces[todo[k]] for k in own], lengths[own])):
                out[i] = ids
        return out

    def _merge_all(self, pieces: list[bytes], lengths: np.ndarray) -> list[bytes]:
        low, mid, top = self.queue.low, self.queue.mid, 0
        size, rank_of = self.size, self._ranks
        ends = np.cumsum(lengths)
        n = int(ends[-1])  # also the place beyond every pre-token
        word = np.repeat(np.arange(len(pieces)), lengths)
        ids = np.append(self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], self.none)
        if (ids < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = before[ends - lengths] = n
        rank_at = rank_of(ids * size + ids[np.minimum(after, n)])
        live = np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        at, ranks = np.arange(n + 1), rank_at
        while True:
            if (ok := ranks >= 0).any():
                at, ranks = at[ok], ranks[ok]
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
                for r, s, e in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
                    if r in buckets:
                        buckets[r].append(at[s:e])
                    else:
                        buckets[r] = [at[s:e]]
                        w = r >> 6
                        if not low[w]:
                            mid[w >> 6] |= 1 << (w & 63)
                            top |= 1 << (w >> 6)
                        low[w] |= 1 << (r & 63)
            if not top:
                break
            t = (top & -top).bit_length() - 1  # find first set, three times
            m = mid[t]
            w = (t << 6) + (m & -m).bit_length() - 1
            x = low[w]
            rank = (w << 6) + (x & -x).bit_length() - 1
            at = np.concatenate(buckets[rank])
            at = at[rank_at[at] == rank]  # others are stale: one of the pair was merged since
            at.sort()
            first = np.ones(len(at), bool)
            np.not_equal(word[at[1:]], word[at[:-1]], out=first[1:])
            if first.all():
                del buckets[rank]
                low[w] = x = x & (x - 1)
                if not x:
                    mid[t] = m = m & (m - 1)
                    if not m:
                        top &= top - 1
            else:
                buckets[rank] = [at[~first]]
                at = at[first]
            j = after[at]
            k, h = after[j], before[at]
            after[at], before[k], ids[at], rank_at[j], live[j] = k, at, rank, -1, False
            # the pairs that begin here, and the ones before
            at = np.concatenate((at, h))
            ranks = rank_of(np.concatenate((rank * size + ids[k], ids[h] * size + rank)))
            rank_at[at] = ranks
        raw = ids[:n][live].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(np.bincount(word[live], minlength=len(pieces)))).tolist()]
        return [raw[s:e] for s, e in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        group, n = [], 0
        for t in texts:
            group.append(t)
            n += len(t)
            if n > GROUP:
                yield from self._group(group)
                group, n = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        split = list(map(self.split, texts))
        new = set().union(*split).difference(known)
        long = {w: np.array(self.merge(w.encode()), "<u4").tobytes() for w in new if len(w) > LONG}
        short = [w for w in new if len(w) <= LONG]
        known.update(zip(short, self.merge_all([w.encode() for w in short])))
        if long:
            return [b"".join([long[w] if w in long else known[w] for w in words]) for words in split]
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _map_encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or RankEncoder.from_file(path, pattern)
            n, ids_sha, text_sha = [], [], []
            for ids in encoder.encode([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoding_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs.

    Null or empty text: no ids. A null doc_id is passed on, repeated rows are encoded each. Empty table: no
    rows. Other columns aren't read.
    """
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_map_encode(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
