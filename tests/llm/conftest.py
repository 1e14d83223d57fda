import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega über straße garçon niño".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def make_documents():
    """(doc_id, text, lang, source, n_chars): nulls, empty and very long texts, copies, near copies, shared passages."""
    rng = random.Random(5)
    shared = prose(rng, 60)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    texts += [None, "", "   \n", "x", texts[0], texts[0], texts[1] + " extra", prose(rng, 80) + shared + prose(rng, 70), prose(rng, 20) + shared, "a" * 700, "spam " * 400, prose(rng, 6000), "<|endoftext|> and <|startoftext|> inside", "İstanbul   ǅ 漢字 🙂🙂 \x85 end", "Tab\tand\x0bvertical\x1cfile"]
    texts.append(rng.choice("bcd") * 1 + "".join(rng.choice("abc") for _ in range(3000)))
    rows = [(i, t, "en", f"host{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[2], None, "host1", 3)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from locusframe.llm.common import prepare

    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    out = docs
    for c in ("_k", "_spans", "fp", "h", "host", "tid", "TEXT", "n_words", "w", "spans"):
        out = out.toDF(*out.columns).select("*", F.lit(c).alias(c))
    return out


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, int(r[0] is not None and r[0] % 5 == 0)) for r in rows], "doc_id long, quality int, toxic int")
