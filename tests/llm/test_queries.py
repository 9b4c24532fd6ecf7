"""The registered queries and the pipeline over the smallest tables, against plain Python; cases that once went wrong."""

import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_brute_force import PATTERNS, WORD, components, holds, spans

import corpus_pipeline
from thicket.llm import chat, common, languages, overlap, pii, queries, quality, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_count_vector_join": ["doc_id", "n_shingles", "component_id"],
    "op2_compression_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_quality_ledger": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op8_simhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op9_pii_disclosure": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op10_language_mixture": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns_and_folds(spark, documents, name):
    found = queries.queries()[name](spark, SF)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = found.collect()
    assert {r.doc_id for r in rows} == {d["doc_id"] for d in documents}
    fold = {"op2_compression_toxicity": (3, 1), "op10_language_mixture": (4, 2)}.get(name)
    for r in rows if fold else ():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1
        assert name != "op2_compression_toxicity" or r.predicted == (r.score >= 0.7)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries.queries()[name](spark, SF).write.parquet(f"{tmp_path}/out")
    got, want = con.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'").df(), con.sql(queries.oracle_sql()[name]).df()
    order = lambda t: sorted(map(repr, t[sorted(t.columns)].astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and order(got) == order(want)


def plain_quality(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
    covered = {j for i, g in enumerate(grams) if g in twice for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    fails = [
        len(words) < 50,
        100 * len(covered) > 50 * len(words),
        10 * sum(c in "#*$%&|<>" for c in text or "") > 3 * len(words),
        10 * (text or "").count("!") > 3 * len(words),
        2 * sum(c.isupper() for c in text or "") > chars,
        2 * (len(lines) - len(set(lines))) > len(lines),
        chars < 3 * len(words) or chars > 12 * len(words),
    ]
    return not any(fails)


def plain_redact(text):
    found = sorted((int(a), -int(b), k) for s in spans(text or "").values() for x in s for k, a, b in [x.split(":")])
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
            at = -b
    return "".join(out) + (text or "")[at:] if found else text


def test_pipeline_is_its_stages_in_plain_python(spark, documents):
    from tokenizers import Tokenizer

    docs, labels = (common.table(spark, SF, t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, F.lit(True))
    distances = toxicity.Distances(model) if model else None
    left = [d for d in documents if not model or toxicity.score(d["text"], model, distances) < toxicity.SCORE_AT]
    left = [d for d in left if plain_quality(d["text"])]
    groups = components([(d["doc_id"], d["text"]) for d in left])
    left = [d for d in left if groups[d["doc_id"]][1] == d["doc_id"]]
    tok = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = {}
    for d in left:
        ids = [*tok.encode(plain_redact(d["text"]) or "", add_special_tokens=False).ids, 0]
        for k, (start, n) in enumerate(((0, len(ids)),) if len(ids) <= 2048 else [(0, len(ids) % 2048 or 2048), *((s, 2048) for s in range(len(ids) % 2048 or 2048, len(ids), 2048))]):
            want[d["doc_id"], k] = (start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))
    found = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want
    assert len(found) == len(want) > 50


def test_pipeline_stages_take_awkward_rows(spark, docs, none):
    """Nulls, empty and long texts, repeated rows, an empty table and extra columns: all stages but the last keep the columns."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, none):
            kept = stage(spark, rows, SF)
            assert kept.columns == rows.columns, name
            assert kept.count() <= rows.count()
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def test_pipeline_stages_take_columns_of_any_name(spark, docs):
    odd = docs.withColumns({"x.y": F.lit(1), "a`b": F.lit("c"), "q r": F.lit(None).cast("int")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name


def test_toxicity_scores_are_those_of_two_dictionaries(spark):
    """By hand: both compressors made anew, every window, the curve."""
    import zstandard
    from test_brute_force import toxic_rows

    rows = toxic_rows()
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    model = toxicity.fit(table, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"), F.lit(True))
    assert not model.toxic.startswith(model.ordinary) and not model.ordinary.startswith(model.toxic)
    size = {}
    for name, raw in (("o", model.ordinary), ("t", model.toxic)):
        how = zstandard.ZstdCompressionParameters.from_level(12, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        size[name] = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress
    found = {r.doc_id: r.score for r in toxicity.scored(table, model).collect()}
    for i, t, _ in rows[:60]:
        words = re.findall(r"[^\W\d_]+", t.lower())
        spelled = [f"  {''.join(c * 3 for c in w)}  ".encode() for w in words]
        saved = sorted((max(0, 1 - len(size["t"](w)) / len(size["o"](w))) for w in spelled), reverse=True)
        f = [1, saved[0], sum(saved[:3]), np.log1p(sum(s >= 0.3 for s in saved)), np.log1p(sum(s >= 0.4 for s in saved)), sum(s >= 0.4 for s in saved) / len(saved)]
        assert found[i] == pytest.approx(1 / (1 + np.exp(-np.clip(np.dot(f, model.weights), -30, 30))))


def test_toxicity_of_empty_and_long_texts(spark):
    table = spark.createDataFrame([(1, None), (2, ""), (3, "ka lo " * 60_000), (None, "x")], "doc_id bigint, text string")
    assert toxicity.scored(table.filter("false"), None).count() == 0
    model = toxicity.learn(["bad awful words here"] * 3 + ["bad awful other", "bad awful third"], ["fine day", "good day now", "nice day then"])
    assert toxicity.scored(table, model).count() == 4 and toxicity.fit(table, spark.createDataFrame([], "doc_id bigint, toxic int"), F.lit(True)) is None


def test_term_spans_count_in_the_text_as_it_is(spark):
    """Lower-casing U+0130 makes two characters of one."""
    rows = [(i, f"İİİ word{i} zorblax writes to boss@corp.example today {i}") for i in range(10)] + [(100 + i, f"other text {i}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    wide = table.withColumns({"id": F.lit(1), "spans": F.lit(2), "doc": F.lit(3), "version": F.lit(4)})
    found = pii.find(wide)
    listed = {r.doc_id: r.spans for r in pii.report(found).collect()}
    at = rows[0][1].index("zorblax")
    assert f"term:{at}:{at + 7}" in listed[0].split(",")
    clean = pii.redact(wide, found)
    assert clean.columns == wide.columns
    assert "[TERM] " in clean.filter("doc_id = 0").first().text and "zorblax" not in clean.filter("doc_id = 0").first().text


def test_groups_of_entities_are_protected(spark):
    """No address occurs twice, but a term gives their domain away."""
    rows = [(i, f"text {chr(97 + i)}{i} fabrikant mailto:p{i}@own.example end") for i in range(12)] + [(100 + i, f"other text {i}") for i in range(400)] + [(999, "only fabrikant here")]
    found = {r.doc_id: r.spans for r in pii.report(pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert found[999] == "term:5:14"


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.example" for i in range(3000))
    r = pii.report(pii.find(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).first()
    assert r.n_email == 3000 and r.spans == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(PATTERNS["email"], text)) and holds("email", "x")


@pytest.mark.parametrize("module, names", [(overlap, ["SENT"]), (pii, ["SENT", "MARKED"])])
def test_joins_without_broadcast_give_the_same(spark, docs, monkeypatch, module, names):
    run = (lambda: overlap.without_copies(docs)) if module is overlap else (lambda: pii.redact(docs, pii.find(docs)))
    order = lambda f: sorted(map(repr, f.select("doc_id", "text").collect()))
    usual = order(run())
    for n in names:
        monkeypatch.setattr(module, n, 0)
    assert order(run()) == usual


def test_jaccard_forgets_what_it_may(spark, docs, rows, monkeypatch):
    for name, value in (("KEPT", 100), ("DIGESTS", 5), ("PAIRS", 1), ("POINTS", 64), ("TOLD", 3), ("PART", 4)):
        monkeypatch.setattr(overlap, name, value)
    want = components(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in overlap.near_duplicates(docs).collect() if r.doc_id is not None)


def test_letters_are_letters(spark):
    table = spark.createDataFrame([(1, "²²²", None), (2, "½ Ⅳ 12", None), (3, "ß", None), (4, "ka lo mi", "aa")], "doc_id bigint, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in languages.predict(table, languages.fit(table, F.lit(True))).collect()}
    assert found == {1: "und", 2: "und", 3: "aa", 4: "aa"}


def test_windows_that_repeat_are_compared_word_by_word(spark):
    t = "a b c d a b c x y z " + " ".join(f"w{i}" for i in range(3000))
    r = quality.ledger(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).first()
    assert r.n_repeat_words == 6


def test_turns_tell_role_from_text(spark):
    log = [(1, 0, "a\nb", "c"), (1, 0, "a", "b\nc")]
    r = chat.format_chats(spark.createDataFrame(log, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(r) == 1 and r[0].n_turns == 2


def test_warc_text_links_and_references(spark):
    html = """<header class=x>top</header>if a < b and c > d &eacute; &#8217; &#x27; &amp;lt; &bogus; &#0; <a href='/s?a=1&amp;b=2'>q</a> <a class=x href=/bare>z</a> <a href="/d">y</a>"""
    long = "<p>word &amp; word</p>" * 20_000
    pages = spark.createDataFrame([(1, "u", f"<html lang=fr><title>T &eacute;</title>{html}"), (2, "u", long)], "page_id bigint, url string, html string")
    found = {(r.page_id, r.record_type): r.block for r in warc.derive(warc.responses(pages)).collect()}
    assert found[1, "conversion"] == "T étopif a < b and c > d é ’ ' &lt; &bogus; &#0; q z y"
    assert found[1, "metadata"].startswith("title: T é\r\nlanguage: fr\r\n") and found[1, "metadata"].endswith("\r\noutlink: /s?a=1&b=2\r\noutlink: /bare\r\noutlink: /d")
    assert found[2, "conversion"] == "\n".join(["word & word"] * 20_000)
    assert warc.derive(warc.responses(pages.filter("false"))).count() == 0


def test_simhash_ids_of_any_type(spark):
    rows = [(f"k{i:03d}", f"text number {i} of many " * (i % 4)) for i in range(60)] + [(None, "no id")]
    found = {r.doc_id: r for r in simhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(found) == 61 and found["k059"].n_chars == len(rows[59][1])
    assert found["k010"].near_next == 1 - (int(found["k010"].fingerprint, 16) ^ int(found["k009"].fingerprint, 16)).bit_count() / 64


def test_simhash_search_finds_all_near(spark, documents):
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.edited_fingerprints(common.table(spark, SF, "documents")).collect()}
    counts = {}
    for b in prints.values():
        counts[b] = counts.get(b, 0) + 1
    want = {(i, c, (prints[i] ^ c).bit_count(), n) for i in prints if i % 50 == 0 for c, n in counts.items() if (prints[i] ^ c).bit_count() <= 3}
    found = queries.queries()["simhash_search"](spark, SF).collect()
    assert {(r.doc_id, int(r.near, 16), r.distance, r.n_docs) for r in found} == want and len(found) == len(want)
    assert simhash.near_pairs(spark.createDataFrame([(1,), (1,), (2,)], "bits bigint"), 0).count() == 0


def test_empty_tables_of_the_others(spark, none):
    import public_tokenizers

    from thicket.llm import bpe

    assert bpe.encode_decode(none, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert languages.predict(none, languages.fit(none, F.lit(True))).count() == 0
    assert simhash.search(none, F.lit(True)).count() == 0
