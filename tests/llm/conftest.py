import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, score double"

WORDS = [a + b + c for a in ("", "re", "un", "mo", "ta") for b in ("lin", "gra", "tor", "sel", "vin", "dur") for c in ("", "e", "ing", "ed", "os")]


def prose(rng, n):
    out = []
    while len(out) < n:
        s = [rng.choice(WORDS) for _ in range(rng.randint(4, 12))]
        s[-1] += "."
        out += s
    return " ".join(out[:n])


def corpus(seed=3, n=60):
    """Random texts with exact and near copies, nulls, blanks, a very long text, repeated rows and ties."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(n)]
    for i in range(0, n // 3):
        w = texts[i].split()
        for k in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [None, "", "   \n ", "one", "One", "two words", "TWO words", prose(rng, 6000), "é à ü " * 10]
    rows = [(i * 3 % 997, t, "en", f"src{i % 5}" if i % 7 else None, None, "clash", 0.0) for i, t in enumerate(texts)]
    rows.append((None, texts[0], None, None, None, None, None))
    rows.append(rows[4])
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
