"""Alignment of two tokenizers over the same bytes, by arrays that give each byte's owner.

Tokenizer A (a tokenizers .json file) encodes a space and the text, tokenizer B
(a sentencepiece model) the text, which it puts a space before itself. With
token numbers repeated over their bytes, each byte has an owner in A and one in
B. Consecutive distinct pairs of owners are the links (tokens that overlap);
where both owners change at once, a cut ends a group of tokens of A and B.

Texts are encoded once; their ids are written to the shared folder, and the
arrays are made from them twice: to count the pairs of ids, and to look the
counts up. A pair counts as often as links hold it in the whole corpus; counts
add up inside tasks, then by pair. If there are at most SENT pairs they go to
every task (13 bytes a pair); beyond that the rows' pairs meet the counts in a
join by pair, rows told apart by a number that is written with their ids.

Texts are read whole, in chunks: both tokenizers always cut before a space or
line feed that follows something else than white space, so each worker encodes
a chunk once and keeps its ids in a cache of bounded size. That holds for a
byte-level A and a B without pieces that go on over a space or hold a line
feed; with others the whole text is one chunk.

A text that is null or empty, or whose bytes are not those that the tokens of A
or of B stand for, has no tokens: zeros and an empty string. Special tokens'
names in a text are plain text. Null ids pass through; repeated rows give
repeated rows and count as often; columns other than those named are left out.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.bpe import CACHED, CHARACTERS, SPACE, byte_to_char, slices
from thicket.llm.common import cut, small_batches

#: Pairs of ids that are broadcast at most.
SENT = 2_000_000
#: Different pairs that a task holds at most before it passes their counts on.
HELD = 500_000
_CUT = re.compile(f"(?<=[^{SPACE}])(?=[ \n])")
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Encoders:
    """Both tokenizers, their tokens' lengths in bytes, and the cache of chunks; one lives in each worker process."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in enumerate(byte_to_char())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in own], np.int32) for own in (self.bytes_a, self.bytes_b))
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.space = self.b.piece_to_id("▁")
        with open(path_a, encoding="utf-8") as file:
            before = json.load(file).get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        probe = "ﬁ  Å Ｆ"
        self.in_chunks = plain and not any(re.search("[^▁]▁|\n", p) for p in pieces) and self.b.normalize(probe) == "▁" + probe.replace(" ", "▁")
        #: An id's name and what follows it, by 4 * id + mark.
        self.names = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in (",", "|", ";", "")]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0
        self.wrong = False

    def chunks(self, text: str) -> list[str]:
        return _CUT.split(" " + text) if self.in_chunks else [" " + text]

    def _ids_b(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of chunks that start with a space, which B adds itself, or with a line feed, to which it adds one more."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [ids[1:] if c[0] != " " else ids or [self.space] for c, ids in zip(chunks, found, strict=True)]

    def ids(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Each text's ids of A and of B, as 16-bit numbers; none if a text has no tokens."""
        if len(self.known) > CACHED or self.held > CHARACTERS:
            self.forget()
        cut_up = [self.chunks(t) if t else [] for t in texts]
        new = list({c for chunks in cut_up for c in chunks if c not in self.known})
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.held += sum(map(len, part))
            raws = [c.encode() for c in part]
            a = self._packed([e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)], self.bytes_a, self.sizes_a, raws)
            b = self._packed(self._ids_b(part), self.bytes_b, self.sizes_b, raws)
            self.known.update(zip(part, zip(a, b, strict=True), strict=True))
        for text, chunks in zip(texts, cut_up, strict=True):
            found = [self.known[c] for c in chunks]
            a, b = b"".join([f[0] for f in found]), b"".join([f[1] for f in found])
            if self.wrong:  # some chunk's bytes differ, or else none
                raw = (" " + text).encode() if text else b""
                a, b = (a, b) if self._spell(self.bytes_a, a) == raw == self._spell(self.bytes_b, b) else (b"", b"")
            yield a, b

    def _packed(self, ids: list[list[int]], table: list[bytes], sizes: np.ndarray, raws: list[bytes]) -> list[bytes]:
        """Each chunk's ids as bytes; ``wrong`` is set if one of them doesn't spell its chunk."""
        flat = np.fromiter(chain.from_iterable(ids), "<u2")
        ends = list(accumulate(map(len, ids), initial=0))
        spelled_sizes = np.diff(np.r_[0, np.cumsum(sizes[flat])][ends])
        packed = flat.tobytes()
        if not np.array_equal(spelled_sizes, list(map(len, raws))) or self._spell(table, packed) != b"".join(raws):
            self.wrong = True
        return [packed[2 * x : 2 * y] for x, y in zip(ends, ends[1:], strict=False)]

    @staticmethod
    def _spell(table: list[bytes], ids: bytes) -> bytes:
        return b"".join(map(table.__getitem__, memoryview(ids).cast("H")))


@dataclass
class Links:
    """What the owner arrays of texts in a row show: tokens, links and groups of all, and each text's bounds."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    bounds: dict[str, np.ndarray]

    def pairs(self) -> np.ndarray:
        return (self.a[self.link_a].astype(np.uint32) << np.uint32(16)) | self.b[self.link_b]


def linked(ids_a: list[bytes], ids_b: list[bytes], own: Encoders) -> Links:
    """Aligns texts by their ids; their bytes stand one text after the other, so nothing links two of them."""
    a, b = np.frombuffer(b"".join(ids_a), "<u2"), np.frombuffer(b"".join(ids_b), "<u2")
    owner_a = np.repeat(np.arange(len(a), dtype=np.int32), own.sizes_a[a])
    owner_b = np.repeat(np.arange(len(b), dtype=np.int32), own.sizes_b[b])
    new_a, new_b = np.ones(len(owner_a), bool), np.ones(len(owner_b), bool)
    np.not_equal(owner_a[1:], owner_a[:-1], out=new_a[1:])
    np.not_equal(owner_b[1:], owner_b[:-1], out=new_b[1:])
    first = np.flatnonzero(new_a | new_b)
    link_a, link_b = owner_a[first], owner_b[first]
    opens = new_a[first] & new_b[first]
    group = np.cumsum(opens) - 1
    group_a, group_b = group[new_a[first]], group[new_b[first]]
    ends_a = np.cumsum([0, *(len(x) // 2 for x in ids_a)])
    ends_b = np.cumsum([0, *(len(x) // 2 for x in ids_b)])
    at = np.searchsorted(link_a, ends_a)
    return Links(a, b, link_a, link_b, group_a, group_b, {"a": ends_a, "b": ends_b, "links": at, "groups": np.r_[0, np.cumsum(opens)][at]})


def spelled(found: Links, names: list[str]) -> list[str]:
    """Each text's groups: ids of A, a bar, ids of B, and semicolons between groups."""
    total = len(found.a) + len(found.b)
    groups = int(found.bounds["groups"][-1])
    count_a, count_b = np.bincount(found.group_a, minlength=groups), np.bincount(found.group_b, minlength=groups)
    # tokens in the order of the spelling: a group's of A, then its of B
    place_a = np.arange(len(found.a)) + np.r_[0, np.cumsum(count_b)][found.group_a]
    place_b = np.arange(len(found.b)) + np.cumsum(count_a)[found.group_b]
    ids, after = np.zeros(total, np.int64), np.zeros(total, np.int8)
    ids[place_a], ids[place_b] = found.a, found.b
    after[np.cumsum(count_a + count_b) - count_b - 1] = 1
    after[np.cumsum(count_a + count_b) - 1] = 2
    edges = (found.bounds["a"] + found.bounds["b"]).tolist()
    after[[e - 1 for e in edges[1:] if e]] = 3
    words = list(map(names.__getitem__, (4 * ids + after).tolist()))
    return ["".join(words[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


_encoders: dict[tuple[str, str], Encoders] = {}


def encoders(path_a: str, path_b: str) -> Encoders:
    """This process's tokenizers."""
    if (path_a, path_b) not in _encoders:
        _encoders[path_a, path_b] = Encoders(path_a, path_b)
    return _encoders[path_a, path_b]


def _sums(whose: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of integers by owner."""
    total = np.zeros(n, np.int64)
    np.add.at(total, whose, values)
    return total


def encoded(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, a, b): the ids of each text as binary columns, written to the shared folder; ``row`` numbers the rows."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = encoders(path_a, path_b)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = list(own.ids(texts))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["id", "a", "b"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, a binary, b binary")
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def _linked_parts(batch: pa.RecordBatch, own: Encoders) -> Iterator[tuple[pa.RecordBatch, Links]]:
    """A batch's rows aligned in runs of a bounded number of ids."""
    sizes = np.cumsum(pc.binary_length(batch["a"]).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 400_000)))
        part = batch.slice(at, to - at)
        yield part, linked(part["a"].to_pylist(), part["b"].to_pylist(), own)
        at = to


def pair_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): in how many links of all texts an id of A (times 65,536) and an id of B (added) meet; ``rows`` come from ``encoded``."""

    def told(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["pair", "n"])

    def run(batches):
        own = encoders(path_a, path_b)
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for _, found in _linked_parts(batch, own):
                at, n = np.unique(found.pairs(), return_counts=True)
                merged, where = np.unique(np.concatenate([keys, at]), return_inverse=True)
                keys, counts = merged, _sums(where, np.concatenate([counts, n]), len(merged))
                if len(keys) > HELD:
                    yield told(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield told(keys, counts)

    return rows.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_sent: int = SENT) -> DataFrame:
    """Per row: n_a, n_b, n_groups, n_links, n_best (links whose pair is its B id's most frequent), count_sum (of the links' counts), and groups.

    ``groups`` spells each text's groups as ids of A, a bar, ids of B, and
    separates them by semicolons.
    """
    spark = docs.sparkSession
    rows = encoded(docs, path_a, path_b, id_col, text_col)
    kind = dict(rows.dtypes)["id"]
    counts = cut(pair_counts(rows, path_a, path_b))
    top = counts.groupBy((F.col("pair") % 65536).alias("b")).agg(F.max("n").alias("top"))
    marked = counts.withColumn("b", F.col("pair") % 65536).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    out = f"{', '.join(f'{c} long' for c in _NUMBERS)}, `groups` string"
    few = counts.count() <= most_sent
    table = marked.toPandas().sort_values("pair") if few else None
    told = spark.sparkContext.broadcast((table["pair"].to_numpy().astype(np.uint32), table["n"].to_numpy(), table["best"].to_numpy()) if few else None)

    def run(batches):
        own = encoders(path_a, path_b)
        for batch in batches:
            for part, found in _linked_parts(batch, own):
                n = part.num_rows
                best = total = np.zeros(n, np.int64)
                if told.value is not None:
                    keys, counted, is_best = told.value
                    at = np.searchsorted(keys, found.pairs())
                    whose = np.repeat(np.arange(n), np.diff(found.bounds["links"]))
                    best, total = np.bincount(whose, is_best[at], n).astype(np.int64), _sums(whose, counted[at], n)
                numbers = [np.diff(found.bounds[x]) for x in ("a", "b", "groups", "links")]
                yield pa.RecordBatch.from_arrays([part["row"], part["id"], *[pa.array(x.astype(np.int64)) for x in (*numbers, best, total)], pa.array(spelled(found, own.names), pa.string())], ["row", "id", *_NUMBERS, "groups"])

    def pairs(batches):
        own = encoders(path_a, path_b)
        for batch in batches:
            for part, found in _linked_parts(batch, own):
                whose = np.repeat(part["row"].to_numpy(), np.diff(found.bounds["links"]))
                yield pa.RecordBatch.from_arrays([pa.array(whose), pa.array(found.pairs().astype(np.int64))], ["row", "pair"])

    aligned = rows.mapInArrow(run, f"row long, id {kind}, {out}")
    if not few:
        each = rows.mapInArrow(pairs, "row long, pair long").groupBy("row", "pair").agg(F.count("*").alias("times"))
        sums = each.join(marked, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("own_best"), F.sum(F.col("times") * F.col("n")).alias("own_sum"))
        zero = F.lit(0).cast("long")
        aligned = aligned.join(sums, "row", "left").withColumns({"n_best": F.coalesce("own_best", zero), "count_sum": F.coalesce("own_sum", zero)})
    return aligned.select(F.col("id").alias(id_col), *_NUMBERS, "groups")
