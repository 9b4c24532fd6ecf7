"""Small tables with every awkward case."""

import random

import pytest

EXTRA = "id bigint, n int, score double, bits bigint, length int, kind string, `row` string, word string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def words(rnd, n, stock):
    return " ".join(rnd.choice(stock) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rnd = random.Random(3)
    stock = ["".join(rnd.choice(["ka", "lo", "mi", "ter", "un", "so"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    texts = [words(rnd, rnd.randint(30, 160), stock) for _ in range(40)]
    base = words(rnd, 120, stock).split()
    for k in range(12):  # near copies
        own = base[:]
        own[rnd.randrange(len(own))] = f"edit{k}"
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), "", None, None, " \t\n ", "one two", "ONE  two", "one two three four five six", "a b c d", words(rnd, 20_000, stock), "x" * 30_000, "mail me: jo.e+x@mail.example.org, card 4111 1111 1111 1111, ip 10.0.0.256 and 10.0.0.25, +44 (20) 7946-0958.", "line\nline\nother\nline", "é € 𝄞 ok's it'll 12345 !!! <|endoftext|>  \n\n x"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id has this text at all"), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 7, 1, 0.5, 3, 9, "k", "r", "w") for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
