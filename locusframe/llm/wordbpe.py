"""Ids of the word-level BPE vocabulary, each distinct word encoded once per worker.

Texts of the characters in SAFE_TEXT, for which lower-casing and the splitting pattern are the same here and
in the library, are split here and their words looked up; others, and those that hold a special token's
string, are encoded by the library itself. New words of up to LONG characters are merged all at once, in rounds: in each
round every word merges its first pair of least rank.
"""

import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: Words remembered by a worker; beyond, the memory begins anew.
MEMORY = 400_000
#: Characters of a word that is merged here; longer ones, which would take as many rounds, are left to the library.
LONG = 64
_ODD = {0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x130}
SAFE_TEXT = frozenset(chr(c) for c in [*range(1, 0x250), *range(0x2010, 0x2028), 0x2030, 0x2039, 0x203A, 0x20AC, 0x2122] if c not in _ODD)


def _class(test) -> str:
    cs = sorted({ord(c) for x in SAFE_TEXT for c in (x, *x.lower()) if len(x.lower()) == 1} | {ord(c) for c in SAFE_TEXT})
    cs, out = [c for c in cs if test(chr(c))], []
    for c in cs:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


_LETTER, _NUMBER = (_class(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


#: The rank of what is no pair.
_NONE = 1 << 40


class Merges:
    """The merges of a vocabulary of bytes (as characters that can be seen), of which the last in a word has a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        char = dict(zip(seen, map(chr, seen)))
        char |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in char)}
        self.inside, self.last = (np.array([vocab[char[b] + x] for b in range(256)], np.int64) for x in ("", suffix))
        self.size = max(vocab.values()) + 1
        a, b, self.made = np.array([(vocab[x], vocab[y], vocab[x + y]) for x, y in model["merges"]], np.int64).T
        pairs = a * self.size + b
        self.rank = np.argsort(pairs)
        self.pairs = pairs[self.rank]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.rank[at], _NONE)

    def ids(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian unsigned 32-bit ids of each word; none is empty."""
        raw = [w.encode() for w in words]
        own, counts = np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw))  # of the words still at work
        text = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(counts)
        ids = self.inside[text]
        ids[ends - 1] = self.last[text[ends - 1]]
        rank = np.append(self._ranks(ids[:-1], ids[1:]), _NONE)  # of the pair that begins at a place
        rank[ends - 1] = _NONE
        out: dict[str, bytes] = {}
        while len(own):
            least = np.minimum.reduceat(rank, np.cumsum(counts) - counts)
            go = least < _NONE
            if not go.all():
                at = np.repeat(go, counts)
                done, cuts = ids[~at].astype("<u4").tobytes(), (4 * np.cumsum(counts[~go])).tolist()
                out.update(zip(map(words.__getitem__, own[~go].tolist()), map(done.__getitem__, map(slice, [0, *cuts], cuts))))
                ids, rank, own, counts, least = ids[at], rank[at], own[go], counts[go], least[go]
                if not len(own):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, counts))
            ends = np.cumsum(counts)
            hit = hit[np.searchsorted(hit, ends - counts)]  # the first of each word
            ids[hit] = self.made[least]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, rank = ids[keep], rank[keep]
            nth = np.arange(len(own))
            hit, first, counts = hit - nth, ends - counts - nth, counts - 1
            end = hit == first + counts - 1
            rank[hit[end]] = _NONE
            at = np.concatenate((hit[~end], hit[hit > first] - 1))
            rank[at] = self._ranks(ids[at], ids[at + 1])
        return out


class Encoder:
    def __init__(self, path: str):
        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, cuts = np.array(e.ids, "<u4"), np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1))
            raw, cuts = ids.tobytes(), (cuts * 4).tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:]))))

    def encode(self, texts: list[str | None], group: int = 256) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null: none."""
        out: list[bytes] = []
        for i in range(0, len(texts), group):
            out += self._group([t or "" for t in texts[i : i + group]])
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        split = [_WORDS.findall(t.lower()) if SAFE_TEXT.issuperset(t) and not any(s in t for s in self.special) else None for t in texts]
        new = set().union(*filter(None, split)).difference(known)
        known.update(self.merges.ids([w for w in new if len(w) <= LONG]))
        self._learn([w for w in new if len(w) > LONG])
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if ws is None else b"".join(map(known.__getitem__, ws)) for t, ws in zip(texts, split)]
