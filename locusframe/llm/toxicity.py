"""Toxicity by a weighted finite-state pattern grammar.

A clause is read by a composition of transducers. The insult transducer reads words and writes symbols: an
insult with its weight, a verb that threatens, intent, a target, negation, a reporting verb or quote, anything
else. The target transducer reads them from right to left and from left to right and marks what is aimed at
somebody. The threat transducer makes a threat of a verb that follows intent or is aimed; a verb alone is none.
The negation and the reported-speech transducers mark insults and threats that follow either. The last one names
the gravest pattern of the clause and gives it the weight of its heaviest arc. What is scored are clauses by
their pattern and the weight of their match, never words: a clause counts once, however many it has.

The weights of the patterns are learned by logistic regression, those of insult stems are log odds in the
training rows. Training looks at up to MAX_TRAIN rows of each label with texts of up to MAX_CHARS, chosen by a
hash of their id. Scoring reads all rows and whole texts, in time that grows with their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import exp, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import guarded, only

MAX_TRAIN, MAX_CHARS = 3000, 20_000
THRESHOLD = 0.3
#: Words at most between a mark's cause and what it marks.
AIM, NEGATE, REPORT, INTENT = 6, 3, 6, 5
#: Classes of words that the grammar knows beforehand, in the languages of the corpus; insults are learned.
LEXICON = {
    "verb": "kill hurt destroy murder smash stab beat shoot burn töten umbringen zerstören schlagen verletzen tuer frapper détruire brûler matar golpear destruir quemar",
    "intent": "will gonna going must should shall let want werde werden soll muss vais va dois veux voy vas debes quiero",
    "target": "you your yours yourself u du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted ustedes vosotros",
    "negation": "not no never none isn't aren't don't nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna",
    "report": "said says say called calls wrote claimed told reported quoted sagte sagt nannte schrieb behauptete dit disait appelé écrit dijo dice llamó escribió",
}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]")
_CLAUSE = re.compile(r"[.!?;:\n]+")
#: Weight of a threat, in the unit of the insults' log odds.
THREAT = 5.0

#: Symbols: class, weight, marks in order of the alphabet.
Symbol = tuple[str, float, tuple[str, ...]]


# --- transducers ---


class Transducer:
    """A sequential transducer: step(state, symbol) -> (state, output). memory: steps remembered."""

    def __init__(self, step: Callable, start=0, memory: int | None = None):
        self.step, self.start = lru_cache(maxsize=memory)(step), start

    def __matmul__(self, other: "Transducer") -> "Transducer":
        """Composition: other reads what self writes."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer(step, (self.start, other.start), 1 << 16)

    def run(self, symbols: Iterable) -> list:
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return out


def marking(trigger: str, reach: int, mark: str, kinds: tuple[str, ...] = ("insult", "threat")) -> Transducer:
    """Marks symbols of these kinds at most reach words after a trigger."""

    def step(left: int, s: Symbol):
        if s[0] == trigger:
            return reach, s
        if left and s[0] in kinds:
            s = (s[0], s[1], tuple(sorted({*s[2], mark})))
        return max(0, left - 1), s

    return Transducer(step)


def insults(weight: Callable[[str], float]) -> Transducer:
    """Words to symbols; weight: of a word as an insult, zero for others."""
    classes = {w: k for k, ws in LEXICON.items() for w in ws.split()}

    def step(state: int, word: str):
        if value := weight(word):
            return state, ("insult", value, ())
        return state, ("report" if not word[0].isalpha() else classes.get(word, "other"), 0.0, ())

    return Transducer(step, 0, 1 << 16)


def threats() -> Transducer:
    """A verb at most INTENT words after intent, or aimed, is a threat."""

    def step(left: int, s: Symbol):
        if s[0] == "intent":
            return INTENT, s
        if s[0] == "verb" and (left or "aimed" in s[2]):
            s = ("threat", THREAT, s[2])
        return max(0, left - 1), s

    return Transducer(step)


PATTERNS = ["+".join([k, *[m for m, on in zip(("aimed", "negated", "reported"), (a, b, c)) if on]]) for k in ("insult", "threat") for a in (0, 1) for b in (0, 1) for c in (0, 1)]
#: From the mildest to the gravest: reported and negated ones first, then what isn't aimed, then insults.
GRAVITY = {p: i for i, p in enumerate(sorted(PATTERNS, key=lambda p: ("reported" not in p, "negated" not in p, "aimed" in p, p.startswith("threat"))))}


def clauses() -> Transducer:
    """Writes the gravest pattern so far and the heaviest weight of it; None before any."""

    def step(best, s: Symbol):
        if s[0] in ("insult", "threat"):
            found = (GRAVITY["+".join([s[0], *s[2]])], s[1])
            best = found if best is None else max(best, found)
        return best, best

    return Transducer(step, None)


BACKWARD = marking("target", AIM, "aimed", ("insult", "verb"))


def grammar() -> Transducer:
    """What reads the symbols of a clause after BACKWARD, from left to right."""
    return marking("target", AIM, "aimed", ("insult", "verb")) @ threats() @ marking("negation", NEGATE, "negated") @ marking("report", REPORT, "reported") @ clauses()


_NAMES = sorted(GRAVITY, key=GRAVITY.get)


# --- model ---


class Model:
    """Stems with weights, pattern weights and a bias; small enough to be sent with the tasks."""

    def __init__(self, stems: dict[str, float], words: dict[str, float]):
        self.stems, self.words = stems, words
        self.weights, self.bias = np.zeros(len(PATTERNS) + 1), -3.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _scanner(self):
        if "_auto" not in self.__dict__:
            self._auto = ahocorasick.Automaton()
            for w in {*self.stems, *self.words, *LEXICON["verb"].split()}:
                self._auto.add_word(w, len(w))
            self._insults, self._grammar = insults(self.insult), grammar()
            self._auto.make_automaton()
        return self._auto

    def insult(self, word: str) -> float:
        if w := self.words.get(word):
            return w
        for n in range(min(len(word), 8), 3, -1):
            if w := self.stems.get(word[:n]):
                return w
        return 0.0

    def clause(self, words: list[str]) -> tuple[str, float] | None:
        """Pattern and weight of a clause's match."""
        self._scanner()
        symbols = BACKWARD.run(reversed(self._insults.run(words)))[::-1]
        best = self._grammar.run(symbols)[-1] if symbols else None
        return best and (_NAMES[best[0]], best[1])

    def features(self, text: str | None) -> np.ndarray:
        """log(1 + n) of the clauses of each pattern, and of the weights of all. Empty text: zeros."""
        out = np.zeros(len(PATTERNS) + 1)
        low, auto = (text or "").lower(), self._scanner()
        found, strength, done = Counter(), 0.0, 0
        for end, n in auto.iter(low):
            at = end - n + 1
            if at < done or at and low[at - 1].isalpha():
                continue
            # a clause begins behind the last one that was read at the soonest, so no text is searched twice
            left = max(done, *(low.rfind(c, done, at) + 1 for c in ".!?;:\n"))
            m = _CLAUSE.search(low, at)
            done = m.start() if m else len(low)
            if match := self.clause(_WORD.findall(low, left, done)):
                found[match[0]] += 1
                strength += match[1]
        for i, p in enumerate(PATTERNS):
            out[i] = log1p(found[p])
        out[-1] = log1p(strength)
        return out

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.weights) + self.bias
        return 1 / (1 + exp(-max(-60.0, min(60.0, z))))

    def fit(self, texts: list[str], y: np.ndarray, prior: float, ridge: float = 0.3) -> "Model":
        """Newton's method on the ridge-penalised likelihood; the bias is set back to the prior of label 1."""
        x = np.array([self.features(t) for t in texts])
        x = np.hstack([x, np.ones((len(x), 1))])
        share = y.mean()
        w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        pen[-1] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9), x.T @ (y - p) - pen * w)
            w += np.clip(step, -3, 3)
            if abs(step).max() < 1e-6:
                break
        self.weights, self.bias = w[:-1], float(w[-1] + log(prior / (1 - prior)) - log(share / (1 - share)))
        return self


def one_of_copies(texts: list[str], bins: int = 8, agree: int = 3) -> list[str]:
    """One text of each group of near copies: those with agree of bins least shingle hashes in common. What a
    text often copied says would else pass for a sign of its label."""
    seen: dict[tuple[int, int], list[int]] = defaultdict(list)
    out: list[str] = []
    for t in texts:
        words = t.encode().lower().split()
        least = np.full(bins, -1, np.int64)
        hashes = np.fromiter((zlib.crc32(b" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))), np.int64)
        order = np.argsort(hashes)[::-1]
        least[hashes[order] % bins] = hashes[order]  # the last written, so the least
        keys = [(i, v) for i, v in enumerate(least.tolist()) if v >= 0]
        common = Counter(j for k in keys for j in seen[k])
        if common and common.most_common(1)[0][1] >= min(agree, len(keys)):
            continue
        for k in keys:
            seen[k].append(len(out))
        out.append(t)
    return out


def _gain(k: int, m: int, pos: int, neg: int) -> float:
    """Twice the log likelihood ratio of k of pos against m of neg."""
    q, out = (k + m) / (pos + neg), 0.0
    for a, n in ((k, pos), (m, neg)):
        for b, r in ((a, q), (n - a, 1 - q)):
            out += 2 * b * log(b / (n * r)) if b else 0.0
    return out


def _odds(k: int, m: int, pos: int, neg: int) -> float:
    return log((k + 0.5) / (pos - k + 0.5)) - log((m + 0.5) / (neg - m + 0.5))


def learn_lexicon(pos: list[str], neg: list[str], margin: float = 12.0, least_odds: float = 3.0) -> tuple[dict[str, float], dict[str, float]]:
    """Stems (of 4 letters or more) and whole words that mark label 1, with their log odds. The gain asked of
    a candidate grows with their number, as the best of many grows by chance."""
    words = lambda t: {w for w in _WORD.findall((t or "").lower()) if w[0].isalpha()}
    p_words, n_words = Counter(), Counter()
    for t in pos:
        p_words.update(words(t))
    for t in neg:
        n_words.update(w for w in words(t) if w in p_words)
    P, N = len(pos), len(neg)
    if not P or not N:
        return {}, {}
    least_gain = margin + 2 * log(len(p_words) + 1)
    whole = {w: _odds(k, n_words[w], P, N) for w, k in p_words.items() if k >= 3 and k * N > 20 * n_words[w] * P and _gain(k, n_words[w], P, N) >= least_gain}
    clean = [w for w in p_words if not n_words[w] and len(w) > 4]
    rough = Counter(w[:n] for w in clean for n in range(4, min(len(w), 9)))
    rough = {s for s, c in rough.items() if c >= 3}
    least_gain = margin + 2 * log(len(rough) + len(p_words) + 1)
    p_docs, n_docs = Counter(), Counter()
    for docs, into in ((pos, p_docs), (neg, n_docs)):
        for t in docs:
            into.update({s for w in words(t) for n in range(4, min(len(w), 8) + 1) if (s := w[:n]) in rough})
    good = {s: _odds(k, n_docs[s], P, N) for s, k in p_docs.items() if k * N > 20 * n_docs[s] * P and _gain(k, n_docs[s], P, N) >= least_gain}
    good = {s: v for s, v in good.items() if v >= least_odds}
    stems: dict[str, float] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):  # the shortest stem covers the longer ones that add nothing
        if not any(s[:n] in stems for n in range(4, len(s))):
            stems[s] = good[s]
    return stems, {w: v for w, v in whole.items() if v >= least_odds and not any(w[:n] in stems for n in range(4, len(w) + 1))}


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn from labelled rows outside the held-out fold; at most max_train of each label, read by the driver.

    Rows without an id, label or text, and those with a text of more than MAX_CHARS, teach nothing. Of an id's
    texts, the least counts, so that no number of repeated rows comes to the driver. Of rows with the same
    hash the lesser id comes first.
    """
    ids = only(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id"))
    counts = {r[0]: r[1] for r in ids.groupBy("toxic").count().collect()}
    some = None
    for y in (0, 1):
        # of more rows a share by another hash, so that tasks have few to sort and send
        share = int(min(1.0, 1.3 * max_train / max(1, counts.get(y, 0))) * 1_000_000) + 1
        part = ids.where((F.col("toxic") == y) & (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
        some = part if some is None else some.union(part)
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(some), "doc_id").where(F.length("text") <= MAX_CHARS).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    got: dict[int, list] = defaultdict(list)
    for doc_id, text, y in rows.collect():
        got[y].append((doc_id, text))
    pos, neg = (one_of_copies([t for _, t in sorted(got[y])[: 2 * max_train]]) for y in (1, 0))
    model = Model(*learn_lexicon(pos, neg))
    n = counts.get(0, 0) + counts.get(1, 0)
    prior = min(max(counts.get(1, 0) / n, 1e-4), 1 - 1e-4) if n else 1e-3
    if pos and neg:
        return model.fit(pos + neg, np.array([1.0] * len(pos) + [0.0] * len(neg)), prior)
    model.bias = log(prior / (1 - prior))
    return model


def held_out(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def _mapper(model: Model, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.fromiter((model.score(t) for t in b.column("text").to_pylist()), float, b.num_rows)
            if keep:
                yield b.filter(pa.array(scores < THRESHOLD))
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null or empty text: the score of a text without matches. Null doc_id: not held out. Repeated rows are
    scored each. Texts with the same matches have the same score; one of exactly THRESHOLD is predicted toxic. Empty tables: no rows; without labels the score is the prior's. Other columns aren't read.
    """
    model = train(docs, labels, max_train)
    scored = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_mapper(model, False), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@guarded
def keep_clean(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs without the rows predicted toxic; columns as they are (one has to be called text). Null or empty
    text stays, unless most rows are toxic; repeated rows go or stay together. Empty table: no rows."""
    model = train(docs, labels, max_train)
    return docs.mapInArrow(_mapper(model, True), docs.schema)
