"""Operators over documents against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from locusframe.llm import bytebpe, lm, packing, quality, simhash, suffix, toxicity


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r.asDict())
    return out


def each(df, rows, expected):
    """expected(text) -> dict of columns, for every row, ids repeated or null too."""
    got = by_id(df)
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(expected(r[1]))
    assert got.keys() == want.keys()
    for k, v in want.items():
        slim = [{c: g[c] for c in v[0]} for g in got[k]]
        assert sorted(map(repr, slim)) == sorted(map(repr, v)), k


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))

    def expected(text):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        return {"n_bytes": len((text or "").encode()), "n_tokens": n, "over_limit": n > 1024}

    each(bytebpe.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN), rows, expected)


def test_encoding(docs, rows):
    import base64

    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def expected(text):
        ids = enc.encode_ordinary(text or "")
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256((text or "").encode()).hexdigest()}

    each(bytebpe.encoding_digest(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), rows, expected)


def test_pre_tokens_merged_together_are_those_merged_alone(monkeypatch):
    """Few letters give bytes that repeat, overlapping pairs, and merges that make a pair of lesser rank."""
    rng = np.random.default_rng(5)
    own = bytebpe.RankEncoder.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    letters = [b"a", b"e", b"n", b"t", b" ", "é".encode(), b"="]
    odd = {bytes([i]): 300 + i for i in range(256)} | {b"ab": 9, b"abc": 3, b"cd": 8, b"abcd": 7, b"ca": 5, b"aa": 6, b"aaa": 2, b"bca": 1}
    for encoder, some in ((own, letters), (bytebpe.RankEncoder(odd, P.PATTERN), [b"a", b"b", b"c", b"d"])):
        pieces = [b"", b"a", *(b"".join(some[i] for i in rng.integers(0, len(some), n)) for n in rng.integers(1, 40, 3000))]
        want = [np.array(encoder.merge(p), "<u4").tobytes() if p else b"" for p in pieces]
        for at_once in (1 << 22, 500):
            monkeypatch.setattr(bytebpe, "AT_ONCE", at_once)
            assert encoder.merge_all(pieces) == want
        assert not any(encoder.queue.low) and not any(encoder.queue.mid)
    assert own.merge_all([]) == []


def test_texts_are_encoded_in_groups_with_the_same_ids(monkeypatch):
    own = bytebpe.RankEncoder.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["", "one two", "x" * 500 + " one", " ", "two ünë \n\n", "one two"]
    want = [b"".join(np.array(own.merge(w.encode()), "<u4").tobytes() for w in own.split(t)) for t in texts]
    for group, memory in ((4_000_000, 1000), (5, 2)):
        monkeypatch.setattr(bytebpe, "GROUP", group)
        monkeypatch.setattr(bytebpe, "MEMORY", memory)
        assert list(own.encode(texts)) == want


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix(docs, rows, hot):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))

    def expected(text):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(t, gone) if not g)
        return {"n_bytes": len(t), "n_removed": sum(gone), "n_spans": len([x for x in bytes(gone).split(b"\0") if x]), "kept_sha256": hashlib.sha256(kept).hexdigest()}

    each(suffix.report(docs, hot=hot), rows, expected)


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, pairs):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(docs, rows):
    fps = [fingerprint(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    near = Counter(x for p in pairs for x in p)
    comp = components([r[0] for r in rows], pairs)
    want = sorted(repr((r[0], f"{fps[i]:016x}", near[i], comp[i])) for i, r in enumerate(rows))
    got = sorted(repr((r[0], r[1], r[2], r[3])) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "n_near", "component_id").collect())
    assert got == want


def test_simhash_finds_all_pairs_of_random_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    flips = [int(b) ^ int(np.bitwise_or.reduce(np.left_shift(np.int64(1), rng.choice(63, k, replace=False)))) for b in base for k in (1, 3, 4, 5)]
    values = sorted({int(b) for b in base} | set(flips))
    df = spark.createDataFrame([(v, 1) for v in values], "fp long, w long")
    got = {(r[0], r[1]) for r in simhash.links(df).select("x", "y").collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in values for b in values if a != b and ((a ^ b) & mask).bit_count() <= 4}
    assert got == want


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    cap = 256
    got = packing.packing(docs, P.path("word_bpe_49k.json"), capacity=cap).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, len(ids), cap)):
            want[(r[0], p, s, len(ids[s : s + cap]), zlib.crc32(ids[s : s + cap].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= cap
    total = sum(r["length"] for r in got)
    assert -(-total // cap) <= len(seqs) <= len(packing.best_fit(np.array([r["length"] for r in got]), cap))


def test_words_merged_together_have_the_ids_of_the_library():
    from locusframe.llm import wordbpe

    rng = np.random.default_rng(6)
    own = wordbpe.Encoder(P.path("word_bpe_49k.json"))
    letters = list("aaaeinstthéß")
    words = ["a", "'s", "7", "...", "aaaaaaaa", "ababab", *{"".join(letters[i] for i in rng.integers(0, len(letters), n)) for n in rng.integers(1, 30, 3000)}]
    words = [w for w in words if wordbpe._WORDS.findall(w) == [w]]
    assert len(words) > 1000 and own.merges.ids([]) == {}
    got = own.merges.ids(words)
    assert got == {w: np.array(own.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words}
    texts = [" ".join(words), "x" * 500 + " and " + "é" * 70, "", None, "Ünë <|endoftext|> two"]
    assert own.encode(texts) == [np.array(own.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_local_search_raises_the_squared_fill_and_empties_sequences():
    lengths = np.array([60, 60, 60, 50, 50, 40, 40, 20, 20])
    worst = [[0], [1], [2], [3, 5], [4, 6], [7, 8]]
    s = packing.Search(lengths, worst, 100)
    before = s.squared_fill()
    bins = s.run()
    assert s.squared_fill() > before and len(bins) <= 5 and sorted(i for b in bins for i in b) == list(range(9))


def test_packing_mixes_the_lengths_of_all_tasks(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {n: "the " * n for n in (15, 48)}
    size = {n: len(t.encode(x, add_special_tokens=False).ids) + 1 for n, x in texts.items()}
    cap = sum(size.values())
    docs = spark.createDataFrame([(i, texts[48 if i < 1500 else 15]) for i in range(3000)], "doc_id long, text string").coalesce(2)
    assert len({r[0] for r in packing.packing(docs, P.path("word_bpe_49k.json"), capacity=cap).select("sequence_id").collect()}) == 1500


def test_packing_by_counts_is_best_fit_and_the_search_no_worse():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(*[(1, 101), (20, 60), (34, 50), (26, 70)][seed % 4], int(rng.integers(1, 300)))
        counts = Counter(lengths.tolist())
        bins = packing.best_fit(lengths, 100)
        first = packing.best_fit_counts(counts, 100)
        assert sum(first.values()) == len(bins)
        have = packing.pack(counts, 100)
        assert -(-lengths.sum() // 100) <= sum(have.values()) <= len(bins)
        used = Counter()
        for p, k in have.items():
            assert 0 < sum(n * q for n, q in p) <= 100
            for n, q in p:
                used[n] += k * q
        assert used == counts


def test_quality(docs, rows, spark, tmp_path):
    from oracle import compare

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    compare(quality.quality(docs), quality.SQL, tmp_path)


def test_frequent_lines_are_cut_and_depleted_documents_rejected(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Accept  ALL cookies\n{body(i)}", "h") for i in range(40)] + [(100, "accept all cookies\n" * 1 + "accept all  cookies " + " ".join("z" for _ in range(3)), "h")]
    rows += [(200 + i, f"accept all cookies\n{body(1000 + i)}", "other") for i in range(5)]
    r = {x["doc_id"]: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=30, max_share=0.02).collect()}
    assert r[0]["lines_removed"] == 1 and r[0]["words_left"] == 60 and r[0]["kept"]
    assert r[200]["lines_removed"] == 0 and not r[100]["kept"]


def test_kept_documents_lose_the_lines_over_the_limit(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Accept  ALL cookies\n\n{body(i)}\naccept all cookies\nend {i}", "h", 0) for i in range(40)]
    rows += [(200 + i, f"accept all cookies\n{body(i)}", "other", -1) for i in range(5)]
    out = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    want = {i: f"\n{body(i)}\nend {i}" for i in range(40)}
    assert got == {i: (t, len(t)) for i, t in want.items()} | {r[0]: (r[1], -1) for r in rows[40:]}


def test_toxicity_learns_patterns_not_the_held_out_rows(spark):
    import random

    rng = random.Random(3)
    plain = "the river runs by a quiet town where people work and read books all day long".split()
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=40)
        if toxic:
            words[10:10] = ["you", "are", "a", rng.choice(["blorgfool", "blorghead", "blorgface"])]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out) and all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    kept = {r[0] for r in toxicity.keep_clean(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in out if not r["predicted"]}


def test_lm_scores(docs, rows):
    out = lm.lm_scores(docs, words=20, head_size=25)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for r in rows if not held(r[0]) for w in lm.words_of(r[1]))
    n, v = sum(c.values()), len(c)
    got = by_id(out)
    for r in rows:
        ws = lm.words_of(r[1])
        base = sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert any(g["n_tokens"] == len(ws) and g["n_known"] == sum(c[w] > 0 for w in ws) and g["train_tokens"] == n and g["held_out"] == held(r[0]) and abs(g["base_score"] - base) < 1e-6 * max(1, -base) and g["score"] < 0 for g in got[r[0]])


def test_toxic_clauses_match_as_defined():
    import random

    model = toxicity.Model({"blorg": 4.0}, {"idiot": 6.0, "clown": 5.0})
    classes = {w: k for k, ws in toxicity.LEXICON.items() for w in ws.split()}
    alphabet = ["idiot", "clown", "blorghead", "kill", "hurt", "will", "you", "your", "not", "said", '"', "tree", "house", "sky"]

    def plain(words):
        kind = ["insult" if model.insult(w) else "report" if w == '"' else classes.get(w, "other") for w in words]
        near = lambda i, k, lo, hi: any(kind[j] == k for j in range(max(0, i - lo), min(len(words), i + hi + 1)) if j != i)
        best = None
        for i, w in enumerate(words):
            aimed = near(i, "target", toxicity.AIM, toxicity.AIM)
            if kind[i] == "verb" and (aimed or near(i, "intent", toxicity.INTENT, 0)):
                name, weight = "threat", toxicity.THREAT
            elif kind[i] == "insult":
                name, weight = "insult", model.insult(w)
            else:
                continue
            marks = [m for m, on in (("aimed", aimed), ("negated", near(i, "negation", toxicity.NEGATE, 0)), ("reported", near(i, "report", toxicity.REPORT, 0))) if on]
            found = (toxicity.GRAVITY["+".join([name, *marks])], weight)
            best = found if best is None else max(best, found)
        return best and ({v: k for k, v in toxicity.GRAVITY.items()}[best[0]], best[1])

    rng = random.Random(8)
    for _ in range(3000):
        words = [rng.choice(alphabet) for _ in range(rng.randint(0, 14))]
        assert model.clause(words) == plain(words), words
    text = "The tree, idiot\nsaid: you clown! kill"
    want = np.zeros(len(toxicity.PATTERNS) + 1)
    for p in ("insult", "insult+aimed"):
        want[toxicity.PATTERNS.index(p)] = np.log1p(1)
    want[-1] = np.log1p(6.0 + 5.0)
    assert np.allclose(model.features(text), want)


def test_toxicity_reads_a_very_long_clause_once():
    import time

    model = toxicity.Model({}, {"idiot": 6.0})
    took = []
    for n in (30_000, 120_000):
        began = time.process_time()
        x = model.features("a river idiot of words " * n)
        took.append(time.process_time() - began)
        assert x[toxicity.PATTERNS.index("insult")] == np.log1p(1)
    assert took[1] < 12 * took[0]


def plain_lm(w, doc):
    """Natural log probability of word ids, a word at a time: the model's definition."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    n, other, classes = w["u"].shape[1], w["table"].shape[1] - 1, len(w["wc"]) - 1
    h, before, out = np.zeros(n), 0, 0.0

    def share(z, k):
        y = z / np.log(2)
        e = 2 ** np.floor(y) * (1 + y - np.floor(y))
        return np.log(e[k] / e.sum())

    for t in doc:
        x, g = w["table"][:, before], w["u"] @ h
        r, z = (np.clip(0.25 * (x[i * n : (i + 1) * n] + g[i * n : (i + 1) * n]) + 0.5, 0, 1) for i in (0, 1))
        new = x[2 * n :] + r * g[2 * n :]
        new = new / (1 + abs(new))
        h = new + z * (h - new)
        one = np.append(h, 1)
        k = classes if t == other else t // lm.CLASS
        out += share(w["wc"] @ one, k) + (share(w["wo"][k * lm.CLASS : (k + 1) * lm.CLASS] @ one, t % lm.CLASS) if t != other else 0.0)
        before = t
    return out


def test_lm_score_is_that_of_the_model_a_word_at_a_time(docs, rows, monkeypatch):
    kept = []
    real = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a, **k: kept.append(real(*a, **k)) or kept[-1])
    got = by_id(lm.lm_scores(docs, words=20, head_size=25))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for r in rows if not held(r[0]) for w in lm.words_of(r[1]))
    end = c.pop(lm.END)
    ids = {w: i for i, w in enumerate([lm.END, *sorted(c, key=lambda w: (-c[w], w))[:19]])}
    c[lm.END] = end
    rare = sum(n for w, n in c.items() if w not in ids) + 0.1 * (len(c) - len(ids) + 1)
    for r in rows[::4]:
        ws = lm.words_of(r[1])
        want = plain_lm(kept[0], [ids.get(w, 20) for w in ws]) / np.log(10) + sum(log10((c[w] + 0.1) / rare) for w in ws if w not in ids)
        assert any(abs(g["score"] - want) < 1e-4 * max(1, -want) for g in got[r[0]]), r[0]


def test_lm_score_does_not_hang_on_partitions(docs):
    a, b = (sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["score"]) for r in lm.lm_scores(d, words=20, head_size=25, block=3000).collect()) for d in (docs, docs.repartition(7)))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert np.allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-6)


def test_lm_network_learns_from_every_training_document(docs, rows, monkeypatch):
    real, seen = lm.materialise, []

    def spy(df):
        out = real(df)
        if out.columns == ["shard", "seen", "weights"]:
            seen.append(sum(r[0] for r in out.select("seen").collect()))
        return out

    monkeypatch.setattr(lm, "materialise", spy)
    monkeypatch.setattr(lm, "COPIES", 1)
    monkeypatch.setattr(lm, "FAN", 2)
    lm.lm_scores(docs, words=20, head_size=25, block=3000)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    assert len(seen) > 1 and set(seen) == {sum(len(lm.words_of(r[1])) for r in rows if not held(r[0]))}


def test_lm_probabilities_add_up_and_state_is_carried():
    rng = np.random.default_rng(0)
    counts = np.sort(rng.integers(1, 50, 70)).astype(float)[::-1]
    w = lm.initial(counts, 30.0)
    docs = [rng.integers(0, 71, n).astype(np.int32) for n in (5, 90, 1, 40)]
    w, _ = lm.train(w, docs * 5, 0, 0.01)
    total = sum(np.exp(lm.score(w, [np.append(docs[0], k).astype(np.int32)], 0)[0] - lm.score(w, [docs[0]], 0)[0]) for k in range(71))
    assert abs(total - 1) < 1e-4
    assert np.allclose(lm.score(w, docs, 0, lanes=2, window=7), [lm.score(w, [d], 0, window=1000)[0] for d in docs], atol=1e-3)


def test_lm_gradient():
    rng = np.random.default_rng(2)
    counts = np.array([9.0, 5, 4, 2])
    w = {k: v.astype(np.float64) for k, v in lm.initial(counts, 3.0, hidden=3).items()}
    docs = [rng.integers(0, 5, 12).astype(np.int32) for _ in range(3)]
    before = -lm.score(w, docs, 0).sum()
    after, _ = lm.train({k: v.astype(np.float32) for k, v in w.items()}, docs, 0, 0.02, epochs=30)
    assert -lm.score(after, docs, 0).sum() < before - 1


def test_suffix_gives_the_rows_of_its_sql(docs, tmp_path):
    from oracle import compare

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    compare(suffix.report(docs), suffix.SQL, tmp_path)


def test_packing_has_a_defined_order_of_ties(spark):
    """Equal pieces go into sequences in the order of the rows, so two runs over one table agree."""
    df = spark.createDataFrame([(i % 3, "the river " * (1 + i % 2)) for i in range(60)], "doc_id long, text string").coalesce(1)
    a, b = (sorted(map(tuple, packing.packing(df, P.path("word_bpe_49k.json"), capacity=16).collect())) for _ in range(2))
    assert a == b


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    line, words = "x" * 300_000, "The river runs by a quiet town. " * 12_000
    df = spark.createDataFrame([(1, line), (2, words), (3, None), (4, line)], "doc_id long, text string")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in bytebpe.token_counts(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert got == {1: len(t.encode(line).ids), 2: len(t.encode(words).ids), 3: 0, 4: len(t.encode(line).ids)}
    enc = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in bytebpe.encoding_digest(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert all(enc[i][1] == hashlib.sha256((x or "").encode()).hexdigest() for i, x in ((1, line), (2, words), (3, None), (4, line)))
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix.report(df).collect()}
    assert out[1] == out[4] == (len(line), len(line)) and out[2] == (len(words), len(words)) and out[3] == (0, 0)
    scores = {r["doc_id"]: r["score"] for r in lm.lm_scores(df, words=20, head_size=25).collect()}
    assert all(s < 0 for s in scores.values()) and scores[1] == pytest.approx(scores[4], rel=1e-6)


def test_token_counts_join_what_the_head_lacks(docs):
    a, b = (sorted(map(tuple, bytebpe.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN, head=n).collect()), key=repr) for n in (1 << 18, 40))
    assert a == b


def test_empty_tables(empty, labels):
    assert bytebpe.encoding_digest(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    for f in (lambda d: toxicity.keep_clean(d, labels), quality.keep_good, simhash.keep_one, suffix.remove_repeats):
        assert f(empty).count() == 0 and f(empty).columns == empty.columns
    assert bytebpe.token_counts(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert suffix.report(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert packing.packing(empty, P.path("word_bpe_49k.json")).count() == 0
    assert quality.quality(empty).count() == 0
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0
    assert lm.lm_scores(empty).count() == 0


def test_clashing_columns(clashing, docs, labels):
    for f in (lambda d: suffix.report(d), lambda d: simhash.near_duplicates(d), lambda d: quality.quality(d), lambda d: bytebpe.token_counts(d, P.path("byte_bpe_50k.json"), P.PATTERN), lambda d: bytebpe.encoding_digest(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), lambda d: toxicity.toxicity(d, labels), lambda d: packing.packing(d, P.path("word_bpe_49k.json")).drop("sequence_id", "offset")):
        a, b = f(clashing), f(docs)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    for f in (quality.keep_good, simhash.keep_one, suffix.remove_repeats, lambda d: toxicity.keep_clean(d, labels)):
        out = f(clashing)
        assert out.columns == clashing.columns
        assert {r[5] for r in out.collect()} <= {"_k"}
        assert sorted(r[0] or -1 for r in out.collect()) == sorted(r[0] or -1 for r in f(docs).collect())


def test_pipeline_of_no_documents(empty, labels, tmp_path):
    import corpus_pipeline as c

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert c.run(empty.sparkSession, str(tmp_path)).count() == 0


def test_pipeline_stages(docs, labels, rows, tmp_path):
    import corpus_pipeline as c

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in c.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    now = docs
    for _, stage in c.STAGES[:-1]:
        out = stage(docs.sparkSession, now, str(tmp_path))
        assert out.columns == docs.columns
        now = docs.sparkSession.createDataFrame(out.collect(), docs.schema)
    n = c.run(docs.sparkSession, str(tmp_path)).collect()
    assert {r["doc_id"] for r in n} == {r[0] for r in now.select("doc_id").collect()}
