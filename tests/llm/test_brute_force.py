"""Operators against plain Python on the awkward table, and on empty ones."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import bpe, chat, languages, overlap, packing, pii, quality, simhash, toxicity, warc
from thicket.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard_join(docs, rows):
    want = components(rows)
    found = overlap.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_jaccard_join_of_groups(spark):
    """Stars, chains and passages that many share, with hot keys."""
    import random

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    own = []
    for g in range(4):
        base = [word() for _ in range(80)]
        for k in range(25):
            text = base[:]
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(80)] = word()
            own.append(text)
            if g == 0:
                base = text  # a chain of edits
    own += [[word() for _ in range(60)] + passage for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(own)]
    found = overlap.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    want = components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_count_tree_never_loses_an_overlap():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rnd.random(400) < 0.9], rnd.integers(0, 2**63, rnd.integers(0, 60), dtype=np.uint64)]) for _ in range(80)]
    n = np.array([len(s) for s in sets])
    points = np.stack([overlap.counts(overlap.point(s), len(s), 256) for s in sets])
    tree = overlap.CountTree(n, points)
    for i, s in enumerate(sets):
        near = set(tree.search(int(n[i]), points[i]).tolist())
        assert {j for j, t in enumerate(sets) if len(np.intersect1d(s, t)) >= overlap.needed(len(s), len(t))} <= near


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a bigint, b bigint")
    assert {r.node: r.component for r in overlap.components(e).collect()} == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_without_copies(docs, rows):
    want = components(rows)
    kept = overlap.without_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == sorted(i for i, (_, c) in want.items() if c == i)


def test_quality(docs, rows):
    def measures(t):
        w = WORD.findall(t or "")
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)

    found = quality.apply_policy(quality.ledger(docs)).collect()
    want = collections.Counter((i, *measures(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_policies_and_ablation(docs):
    rows = quality.ledger(docs).cache()
    whole = {r.rule: (r.rejected, r.only) for r in quality.ablation(rows).collect()}
    for name, bit in quality.BIT.items():
        if bit & quality.POLICIES[quality.CURRENT]:
            masked = F.col("failed").bitwiseAND(F.lit(quality.POLICIES[quality.CURRENT]))
            assert whole.get(name, (0, 0)) == (rows.filter(masked.bitwiseAND(F.lit(bit)) != 0).count(), rows.filter(masked == bit).count())
    kept = quality.only_kept(docs)
    assert kept.columns == docs.columns and kept.count() == quality.apply_policy(rows).filter("kept").count()


def tiktoken_of(name):
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows):
    import public_tokenizers as p

    own = tiktoken_of("byte_bpe_multi_50k.tiktoken")
    found = bpe.encode_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), p.PATTERN, keep_ids=True).collect()
    want = collections.Counter((i, ",".join(map(str, own.encode_ordinary(t or ""))), t or "") for i, t in rows)
    assert collections.Counter((r.doc_id, ",".join(map(str, r.ids)), r.decoded) for r in found) == want
    for r in found:
        assert r.n_tokens == len(r.ids) == len(r.offsets)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        if r.offsets:
            assert r.offsets[0].first == 0 and r.offsets[-1].past == len(r.decoded)
            assert all(a.past >= b.first for a, b in zip(r.offsets, r.offsets[1:], strict=False))


def test_chunks_are_exact_on_odd_space():
    import random

    import public_tokenizers as p

    codec, own = bpe.codec(vocabulary("byte_bpe_multi_50k.tiktoken"), p.PATTERN), tiktoken_of("byte_bpe_multi_50k.tiktoken")
    rnd = random.Random(2)
    pieces = ["a", "B", "é", "ł", "²", "1", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'", "!", "𝄞", "́", "word", "_"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    for t, b in zip(texts, codec.packed(texts), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == own.encode_ordinary(t)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    found = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 256).collect()
    lengths = collections.Counter()
    want = collections.Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 256 else len(ids) % 256 or 256
        cuts = [(0, first), *((s, 256) for s in range(first, len(ids), 256))]
        for k, (s, n) in enumerate(cuts):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
            lengths[n] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.05 * sum(k * v for k, v in lengths.items()) / 256 + 1


def test_packing_merges_up_the_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOCAL", 50)
    monkeypatch.setattr(packing, "MEET", 400)
    items = spark.range(2000).select("id", (F.col("id") * 37 % 90 + 5).alias("length"))
    found = packing.pack(items, 100).collect()
    fill = collections.Counter()
    for r in found:
        fill[r.sequence_id] += r.length
    assert len(found) == 2000 and max(fill.values()) <= 100
    assert len(fill) <= 1.08 * sum(fill.values()) / 100 + 2


def test_simhash(spark, rows):
    own = sorted([(i, t or "") for i, t in rows if i is not None and i != 3], key=lambda r: -r[0])
    found = {r.doc_id: r for r in simhash.edited_fingerprints(spark.createDataFrame(own, "doc_id bigint, text string").repartition(4)).collect()}
    by_text = collections.defaultdict(set)
    for k, (i, t) in enumerate(own):
        after = own[(k + 1) % len(own)]
        half = len(t) // 2
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - half] + after[1][:half]).encode()).hexdigest())
        bits = [int(x, 16) for x in (r.fingerprint, r.edited_fingerprint, found[after[0]].fingerprint)]
        assert r.near_edited == 1 - (bits[0] ^ bits[1]).bit_count() / 64 and r.near_next == 1 - (bits[0] ^ bits[2]).bit_count() / 64
        by_text[t].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in found.values() if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in long) > 0.7 * len(long)


def test_simhash_takes_awkward_rows(docs, none):
    assert simhash.edited_fingerprints(docs).count() == docs.count()
    assert simhash.edited_fingerprints(none).count() == 0
    one = simhash.edited_fingerprints(docs.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_near_fingerprints(spark):
    rnd = np.random.default_rng(0)
    bits = [int(x) for x in rnd.integers(-(2**63), 2**63 - 1, 60)]
    bits += [b ^ (1 << int(i)) ^ (1 << int(j)) for b, i, j in zip(bits[:30], rnd.integers(0, 63, 30), rnd.integers(0, 63, 30), strict=True)]
    bits += bits[:5]
    want = {(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in bits for b in bits if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    found = simhash.near_pairs(spark.createDataFrame([(b,) for b in bits], "bits bigint"), 3)
    assert {tuple(r) for r in found.collect()} == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in (int(x) * (2 if i % 2 else 1) for i, x in enumerate(reversed(d)))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def spans(t):
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if holds(k, m[0])] for k, p in PATTERNS.items()}


def test_pii_spans(spark, docs, rows):
    import random

    rnd = random.Random(4)
    bits = ["a", "x@y.z", "@", ".", "..", "-", " ", "  ", "1", "255", "256", "10.1.2.3", ".4", "+", "+1 (23) 456-7890", "4111 1111-1111 1111", "()", "_", "%", "é", "𝄞", "", "\n", "b.c", "007"]
    odd = [(1000 + k, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for k in range(1500)]
    odd.append((9999, " ".join(map(str, range(20_000))) + " a@" + ".".join("b" * 9_000)))
    table = spark.createDataFrame(odd, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    want = collections.Counter()
    for i, t in [*odd, *rows]:
        s = spans(t or "")
        base = ",".join(x for k in PATTERNS for x in s[k])
        want[i, *(len(s[k]) for k in PATTERNS), hashlib.sha256(base.encode()).hexdigest(), base] += 1
    found = pii.report(pii.find(table)).collect()
    assert collections.Counter(tuple(r)[:7] for r in found) == want
    assert all(r.n_spans == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_term for r in found)


def test_pii_telling_terms(spark):
    import random

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    stock = [word() for _ in range(400)]
    text = lambda *more: " ".join([*(rnd.choice(stock) for _ in range(15)), *more, *(rnd.choice(stock) for _ in range(15))])
    rows = [(i, text(rnd.choice(stock), "zorblax", rnd.choice(stock), f"write {word()} to boss@corp.example")) for i in range(12)]
    rows += [(100, text("zorblax"))] + [(200 + i, text()) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find(table)
    terms = {r.doc_id: r.spans for r in pii.report(found).collect()}
    at = dict(rows)[100].index("zorblax")
    assert terms[100] == f"term:{at}:{at + 7}"
    assert all("term:" in terms[i] for i in range(12)) and not any(terms[200 + i] for i in range(300))
    clean = {r.doc_id: r.text for r in pii.redact(table, found).collect()}
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "boss@" not in clean[0] and clean[200] == dict(rows)[200]


def _signed(signature, lone):
    import random

    rnd = random.Random(12)
    text = lambda: " ".join("".join(rnd.choice("bcdfgklm") for _ in range(5)) for _ in range(20))
    return [(i, f"{text()} {signature}") for i in range(20)] + [(100, f"{text()} {lone} {text()}")] + [(200 + i, text()) for i in range(400)]


@pytest.mark.parametrize("name", ["Smithson", "Kim", "金正", "jk77", "40817"])
def test_pii_terms_of_a_constant_signature(spark, name):
    """The same words around the address in otherwise different texts; short names, CJK and digits too."""
    rows = _signed(f"Contact {name} Senior Manager at jsmith@x.org", name)
    found = {r.doc_id: r.spans for r in pii.report(pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    at = dict(rows)[100].index(name)
    assert found[100] == f"term:{at}:{at + len(name)}"
    at = dict(rows)[0].index(name)
    assert f"term:{at}:{at + len(name)}" in found[0].split(",") and not any(found[200 + i] for i in range(400))
    at = dict(rows)[0].index("jsmith@")
    assert f"term:{at}:{at + 6}" not in found[0].split(",")


def test_pii_terms_count_copies_once(spark):
    rows = _signed("", "")[20:]
    copy = rows[1][1] + " Smithson at jsmith@x.org"
    rows += [(900 + i, copy) for i in range(20)]
    found = pii.report(pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    assert not any("term:" in r.spans for r in found)


def test_language_mixtures(spark):
    import random

    rnd = random.Random(8)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "ech"], "cc": ["oua", "éle", "ieu"]}
    make = lambda lang, n: " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, make(x := "abc"[i % 3] * 2, rnd.randint(5, 60)), x) for i in range(300)]
    extra = [(900, make("aa", 60) + " " + make("bb", 30), "aa"), (901, None, "aa"), (902, "123 !!", "bb"), (903, "", None), (None, make("cc", 20), None)]
    table = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in languages.predict(table, languages.fit(table, F.col("doc_id") % 4 != 2)).collect()}
    assert sum(found[i].lang_pred == x for i, _, x in rows) >= 297
    assert set(found[900].mixture) == {"aa", "bb"} and 0.5 < found[900].score < 0.85
    assert [found[i].lang_pred for i in (901, 902, 903, None)] == ["und", "und", "und", "cc"]
    assert {r.lang_pred for r in languages.predict(table, languages.fit(table.filter("false"), F.lit(True))).collect()} == {"und"}


def toxic_rows():
    import random

    rnd = random.Random(9)
    stock = ["".join(rnd.choice(["ka", "lo", "mi", "ter", "un", "so", "ve"]) for _ in range(rnd.randint(1, 4))) for _ in range(600)]
    rows = []
    for i in range(600):
        w = [rnd.choice(stock) for _ in range(rnd.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["worthless", "disgusting", "pathetic"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    table = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (9000, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(table, labels, F.col("doc_id") % 3 != 1)
    found = {r.doc_id: r.score for r in toxicity.scored(table, model).collect()}
    held = [(found[i] >= toxicity.SCORE_AT, y) for i, _, y in rows if i % 3 == 1]
    assert sum(p == bool(y) for p, y in held) >= 0.95 * len(held)
    assert found[9000] == 0.0 and found[None] == 0.0
    kept = toxicity.without_toxic(table, model)
    assert kept.columns == table.columns and kept.count() == sum(v < toxicity.SCORE_AT for v in found.values())
    assert toxicity.fit(table, labels.filter("toxic = 0"), F.lit(True)) is None
    assert {r.score for r in toxicity.scored(table, None).collect()} == {0.0}


def test_set_phrases_tell_and_copies_count_once():
    import random

    rnd = random.Random(3)
    text = lambda *more: " ".join([*("".join(rnd.choice("bcdfgklm") for _ in range(5)) for _ in range(40)), *more])
    copied = text("once").split()
    copies = [" ".join([*copied[:k], f"e{k}", *copied[k + 1 :]]) for k in range(20)]
    found = toxicity.Tells([text("go", "to", "hell") for _ in range(30)] + copies, [text("go", "to") for _ in range(60)]).telling(6)
    assert "hell" in found and "once" not in found and "to" not in found
    assert len(set(toxicity.text_classes(copies))) == 1


def test_chat(spark):
    log = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes?"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes?"), (2, 2, "user", None), (3, 0, "user", "hi"), (4, 0, "user", "other"), (5, 0, "user", "other"), (5, 0, "user", "other"), (6, None, None, "x"), (None, 0, "user", "lost"), (7, 5, "user", "hi"), (7, 9, "assistant", "no")]
    frame = spark.createDataFrame([(*r, 1) for r in log], "conv_id bigint, turn bigint, role string, text string, place int")
    found = {r.conv_id: (r.n_turns, r.n_logged, r.rendered) for r in chat.format_chats(frame).collect()}
    say = lambda *p: "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in p)
    assert found == {2: (3, 1, say(("user", "hi"), ("assistant", "yes?"), ("user", ""))), 4: (1, 2, say(("user", "other"))), 6: (1, 1, say(("", "x"))), 7: (2, 1, say(("user", "hi"), ("assistant", "no")))}
    assert chat.format_chats(frame.filter("false")).count() == 0


def test_warc(spark):
    html = '<html lang="en"><head><title> A  b</title><style>x</style></head><body><nav>n</nav><p>One &lt;two&gt; &amp;amp;</p><script>var a="</p>"</script><!-- c --><div>Three<br>four <a href="/x">link</a></div></body></html>'
    frame = spark.createDataFrame([(1, "http://h/", html, "z"), (2, None, None, "z"), (None, "u", "plain", "z")], "page_id bigint, url string, html string, block string")
    found = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses(frame)).collect()}
    assert len(found) == 6
    text, meta = found[1, "conversion"], found[1, "metadata"]
    assert text.block == "One <two> &amp;\nThree\nfour link"
    assert "title: A b" in meta.block and "language: en" in meta.block and "outlink: /x" in meta.block
    assert meta.refers_to == text.refers_to and meta.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert text.n_bytes == len(text.block.encode()) and text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    assert found[2, "conversion"].block == "" and found[None, "conversion"].block == "plain"
    whole = warc.derive(warc.responses(frame)).select(warc.serialised(None).alias("r")).first().r
    assert whole.startswith("WARC/1.1\r\nWARC-Type: ") and whole.endswith("\r\n\r\n")


@pytest.mark.parametrize("f", [overlap.near_duplicates, quality.ledger, lambda d: pii.report(pii.find(d)), lambda d: packing.pack_documents(d, vocabulary("byte_bpe_50k.json")), overlap.without_copies, quality.only_kept])
def test_empty_tables(none, f):
    assert f(none).count() == 0
