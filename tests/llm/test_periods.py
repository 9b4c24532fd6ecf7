"""Periodic runs: tree, blocks, squares and runs against plain definitions, and the query against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thicket.llm import periods, queries

SF = "/root/testdata/sf0.001"


def plain_runs(s, many, least):
    """By the definition: each period's maximal stretches, less those with a smaller period."""
    found = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, many * q) and not any(all(s[x] == s[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        n, k = rnd.randint(2, 50), rnd.randint(1, 4)
        s = [rnd.randrange(k) for _ in range(n)]
        if rnd.random() < 0.4:
            a = rnd.randrange(n)
            p = 1 + rnd.randrange((n - a) // 3 + 1)
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        yield s


def test_tree_has_all_suffixes_and_right_links():
    for s in sequences(1, 60):
        t = periods.Tree(s)
        assert sorted(t.starts) == list(range(len(s) + 1))
        spell = lambda v, t=t: tuple(t.s[t.least[v] : t.least[v] + t.depth[v]])
        inner = {spell(v): v for v in range(len(t.first)) if t.kids[v] is not None}
        for label, v in inner.items():
            if v:
                assert t.link[v] == inner[label[1:]]
                assert {i for i in range(len(s) + 1) if tuple(t.s[i : i + len(label)]) == label} == set(t.starts[t.low[v] : t.high[v]])


def test_blocks_are_longest_earlier_copies():
    for s in sequences(2, 60):
        edges = periods.blocks(periods.Tree(s))
        assert edges[0] == 0 and edges[-1] == len(s)
        for a, b in zip(edges, edges[1:], strict=False):
            longest = max((n for n in range(len(s) - a + 1) if any(s[j : j + n] == s[a : a + n] for j in range(a))), default=0)
            assert b - a == max(1, longest)


def test_vocabulary_is_every_square_once():
    for s in sequences(3, 150):
        t = periods.Tree(s)
        marks = periods.vocabulary(t, periods.leftmost(s, periods.blocks(t)))
        got = [tuple(s[t.least[v] : t.least[v] + n]) for v, n in marks]
        want = {tuple(s[i : i + 2 * q]) for q in range(1, len(s) // 2 + 1) for i in range(len(s) - 2 * q + 1) if s[i : i + q] == s[i + q : i + 2 * q]}
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("many", "least"), [(2, 2), (4, 6), (3, 10)])
def test_runs_are_those_of_the_definition(many, least):
    for s in sequences(many, 600):
        assert periods.runs(s, many, least) == plain_runs(s, many, least)
        assert periods.text_runs([b"%d" % x for x in s], many, least) == plain_runs(s, many, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_runs_of_any_sequence(s):
    assert periods.text_runs([b"%d" % x for x in s]) == plain_runs(s, 4, 6)


def test_long_and_extreme_sequences():
    assert periods.runs([0] * 30_000, 4, 6) == [(0, 30_000, 1)]
    block = list(range(700)) + [3, 3, 5]
    assert periods.runs(block * 9 + [9_999], 4, 6) == [(0, len(block) * 9, len(block))]
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert periods.runs(b, 4, 6) == []  # Fibonacci words have no fourth powers
    assert periods.parts([b"w%d" % i for i in range(5_000)]) == []
    assert periods.runs([], 4, 6) == periods.runs([1], 4, 6) == []


def test_a_run_ends_where_the_period_does():
    words = b"x a b a b a b a b a c a c a c a c a y".split()
    assert periods.text_runs(words) == [(1, 9, 2), (9, 9, 2)]
    # the word at 9 is in the first run's repetition and begins the second
    assert periods.collapsed(words, periods.text_runs(words)) == b"x a b c y".split()
    assert periods.text_runs(b"a a a a a".split()) == [] and periods.text_runs(b"a a a a a a".split()) == [(0, 6, 1)]
    assert periods.text_runs(b"A a A a A a".split()) == []  # three periods


def plain_query(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            m = j - i + q
            if m >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + m - p)) for p in range(1, q)):
                found.append((i, m, q))
            i = j + 1
    found.sort(key=lambda r: (r[0], r[2]))
    gone = {x for i, m, q in found for x in range(i + q, i + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{i},{m},{q}\n" for i, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_plain_python(spark):
    rows = {r.doc_id: tuple(r)[1:] for r in queries.op13_tandem_runs(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(rows) == len(docs)
    short = [d for d in docs if len(d["text"] or "") < 6_000]  # the plain way squares with the words
    assert len(short) > 150 and any(rows[d["doc_id"]][0] for d in short)
    for d in short:
        assert rows[d["doc_id"]] == plain_query(d["doc_id"], d["text"]), d["doc_id"]


def test_query_on_awkward_texts(spark, docs, rows, tmp_path):
    """Null and empty texts, null ids, repeated rows, extra columns; ids whose hash makes a text periodic are among them."""
    made = [i for i in range(2_000) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    texts = [None, "", " \t ", "one", "a a a a a a", "a b " * 40, "é è é è é è é è", "x y x y", "w " * 3_000, "q r s t u v w x y z " * 3, None, "p " * 5]
    table = docs.unionByName(spark.createDataFrame([(i, t) for i, t in zip(made, texts, strict=True)], "doc_id long, text string"), allowMissingColumns=True)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, (tuple(r) for r in queries.op13_tandem_runs(spark, str(tmp_path)).collect())))
    whole = [*rows, *zip(made, texts, strict=True)]
    want = sorted(repr((i, *plain_query(i, t))) for i, t in whole if len(t or "") < 7_000 and i is not None)
    want += [r for r in got if r.startswith("(None")]
    long = {repr(i) for i, t in whole if len(t or "") >= 7_000}
    assert sorted(want) == [r for r in got if r[1 : r.index(",")] not in long]
    assert len(got) == len(whole)


def test_operator_returns_texts_and_no_rows_of_none(spark, docs, none):
    assert periods.find_runs(none).count() == 0
    found = periods.find_runs(docs)
    assert found.columns == ["doc_id", "runs", "collapsed"]
    for r in found.collect():
        assert r.collapsed is not None and (not r.runs or all(q.length >= max(6, 4 * q.period) for q in r.runs))
