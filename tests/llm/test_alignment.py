"""Alignment of two tokenizers against plain loops over whole texts, with both ways to look counts up."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from thicket.llm import alignment, queries
from thicket.llm.bpe import byte_to_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(byte_to_char())}
    spell_a = {i: bytes(back[c] for c in t) for t, i in a.get_vocab().items() if all(c in back for c in t)}
    spell_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, spell_a, spell_b


def plain(text, tokenizers):
    """(ids of A, ids of B, links, groups) of a whole text by its byte ranges; None without tokens."""
    a, b, spell_a, spell_b = tokenizers
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not b"".join(spell_a[i] for i in ids_a) == (" " + text).encode() == b"".join(spell_b[i] for i in ids_b):
        return None

    def ranges(ids, spell):
        at = 0
        for i in ids:
            yield i, at, (at := at + len(spell[i]))

    ra, rb = list(ranges(ids_a, spell_a)), list(ranges(ids_b, spell_b))
    links, j = [], 0
    for i, x, y in ra:
        while rb[j][2] <= x:
            j += 1
        k = j
        while k < len(rb) and rb[k][1] < y:
            links.append((i, rb[k][0]))
            k += 1
    both = sorted({e for *_, e in ra} & {e for *_, e in rb})
    groups, i, j = [], 0, 0
    for e in both:
        ga, gb = [], []
        while i < len(ra) and ra[i][2] <= e:
            ga.append(str(ra[i][0]))
            i += 1
        while j < len(rb) and rb[j][2] <= e:
            gb.append(str(rb[j][0]))
            j += 1
        groups.append(f"{','.join(ga)}|{','.join(gb)}")
    return ids_a, ids_b, links, groups


def plain_rows(rows, tokenizers):
    found = [(i, plain(t, tokenizers)) for i, t in rows]
    counts = Counter(pair for _, f in found if f for pair in f[2])
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    for i, f in found:
        if f is None:
            yield (i, 0, 0, 0, 0, 0, 0, "")
        else:
            a, b, links, groups = f
            yield (i, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), ";".join(groups))


AWKWARD = ["<|endoftext|> <s> </s> <unk>", "a▁b", "▁", "▁ x", " lead", "trail ", "trail\n", "two  spaces   three", "\n\n x\n y", "\t tab\tx", "　x　y", "nb\xa0sp \xa0 x", "x\x85y", "été 한국 \U0001d11e\U0001f600", " ", "  ", "\n", "\x00 a\x00", "ﬁ Ｆ Å", "it's they'll 12345 !!! ...", "x" * 5000, "word " * 3000, "\r\n a \r\n", "\x1c a \x1f b", "a ▁ b▁▁ c"]


@pytest.mark.parametrize("most_sent", [alignment.SENT, 0])
def test_awkward_texts(spark, docs, rows, tokenizers, most_sent):
    more = [(1000 + k, t) for k, t in enumerate(AWKWARD)]
    table = docs.select("doc_id", "text", "id", "n", "row").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    found = alignment.align(table, A, B, most_sent=most_sent)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = sorted(map(repr, map(tuple, found.collect())))
    assert got == sorted(map(repr, plain_rows([*rows, *more], tokenizers)))


@pytest.mark.parametrize("most_sent", [alignment.SENT, 0])
def test_no_rows(none, most_sent):
    assert alignment.align(none, A, B, most_sent=most_sent).count() == 0


def test_other_names_of_columns(spark):
    table = spark.createDataFrame([("k", "hello world")], "id string, body string")
    row = alignment.align(table, A, B, "id", "body").first()
    assert row["id"] == "k" and row["n_a"] == 2 and row["n_b"] == 3


def test_query_against_plain_loops(spark, tokenizers):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in plain_rows([(d["doc_id"], d["text"]) for d in docs], tokenizers)]
    got = [tuple(r) for r in queries.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_chunks_and_whole_texts_agree():
    """Over all texts of a larger table, ids from chunks are those of whole texts."""
    own, whole = alignment.Encoders(A, B), alignment.Encoders(A, B)
    assert own.in_chunks
    whole.in_chunks = False
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()] + AWKWARD
    assert list(own.ids(texts)) == list(whole.ids(texts))


def test_task_passes_counts_on_in_parts(spark, docs, monkeypatch):
    rows = alignment.encoded(docs, A, B)
    want = sorted(map(tuple, alignment.pair_counts(rows, A, B).collect()))
    monkeypatch.setattr(alignment, "HELD", 3)
    assert sorted(map(tuple, alignment.pair_counts(rows, A, B).collect())) == want


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "CACHED", 5)
    own = alignment.Encoders(A, B)
    for k in range(9):
        assert next(own.ids([f"w{k} x{k} y{k} z{k}"]))[0]
        assert len(own.known) <= 9
