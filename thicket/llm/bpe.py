"""Byte-level BPE over Arrow batches: encoding with offsets, and decoding.

A text is first cut at places where the tokenizer's own pattern always cuts,
so each chunk has the same ids alone as in its text. Chunks repeat a lot; each
worker process encodes a chunk once with the tokenizers library and keeps the
answer in a cache of bounded size. Texts are always encoded whole.

Null texts count as empty ones. An empty text has no ids.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from thicket.llm.common import small_batches

#: What the tokenizers' pattern holds for white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: A word and the space before it, if an ASCII character that is no letter (or
#: nothing) follows; else everything up to the next white space; white space.
CHUNK = re.compile(f"[ \\n]?[{LETTERS}]+(?=[\\x00-@\\[-`{{-\\x7f]|\\Z)|[ \\n]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: A worker's cache holds so many chunks, and so many characters of them, at most.
CACHED, CHARACTERS = 400_000, 8_000_000


def byte_to_char() -> list[str]:
    """The 256 printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def from_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that merges by the ranks of a .tiktoken file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    chars = byte_to_char()
    spell = {token: "".join([chars[b] for b in token]) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
        merges += [(spell[a], spell[b]) for a, b in sorted((c for c in cuts if c[0] in ranks and c[1] in ranks), key=lambda c: (ranks[c[0]], ranks[c[1]]))]
    tokenizer = Tokenizer(models.BPE({spell[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def from_json(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Codec:
    """Encodes and decodes with one tokenizer; one lives in each worker process."""

    def __init__(self, tokenizer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizer
        back = {c: b for b, c in enumerate(byte_to_char())}
        self.table = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            self.table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.cache: dict[str, object] = {}
        self.held = 0

    def ids_of(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def look_up(self, texts: list[str], value) -> Iterator[list]:
        """For each text its chunks' cached values; value(ids) makes one."""
        cut = [CHUNK.findall(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHED or self.held > CHARACTERS:
            cache.clear()
            self.held = 0
        new = list({c for chunks in cut for c in chunks if c not in cache})
        self.held += sum(map(len, new))
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            cache.update(zip(part, map(value, self.ids_of(part)), strict=True))
        for chunks in cut:
            yield [cache[c] for c in chunks]

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        for found in self.look_up(texts, lambda ids: np.array(ids, "<u4").tobytes()):
            yield b"".join(found)

    def written(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Each text's ids as decimal numbers joined by commas, and the bytes they decode to."""
        for found in self.look_up(texts, lambda ids: (",".join(map(str, ids)).encode(), self.decode(ids))):
            yield b",".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def decode(self, ids) -> bytes:
        """The bytes of ids; a character that several ids share comes whole from their bytes in a row."""
        return b"".join([self.table[i] for i in ids])

    def offsets(self, text: str, ids) -> list[tuple[int, int]]:
        """From which to which character of ``text`` each id reaches.

        An id that holds a part of a character's bytes reaches over the whole
        character, so such neighbours overlap.
        """
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.table[i]) for i in ids], dtype=np.int64)
        starts = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else ends
        return [(int(char[s]), int(char[e - 1]) + 1) for s, e in zip(starts, ends, strict=True)]


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str | None = None) -> Codec:
    """This process's codec for a .tiktoken file (with its pattern) or a tokenizers .json file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(from_ranks(path, pattern) if pattern else from_json(path))
    return _codecs[path, pattern]


def slices(batch: pa.RecordBatch, column: str, chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in runs of rows of about so many characters, with their texts (null: empty)."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars)))
        part = batch.slice(at, to - at)
        yield part, [t or "" for t in part[column].to_pylist()]
        at = to


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids, their character offsets and the decoded text.

    Null ids pass through; repeated rows give repeated rows; other columns are
    left out, so their names can't clash.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids array<int>, offsets array<struct<first:int,past:int>>, decoded string" if keep_ids else ""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for part, texts in slices(batch, text_col):
                n, ids, back, kept = [], [], [], []
                for text, (written, decoded) in zip(texts, own.written(texts), strict=True):
                    n.append(written.count(b",") + 1 if written else 0)
                    ids.append(hashlib.sha256(written).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if keep_ids:
                        numbers = [int(i) for i in written.split(b",")] if written else []
                        kept.append((numbers, [{"first": a, "past": b} for a, b in own.offsets(text, numbers)], decoded.decode(errors="replace")))
                arrays = [part[id_col], pa.array(n, pa.int64()), pa.array(ids), pa.array(back)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays += [pa.array([k[0] for k in kept], pa.list_(pa.int32())), pa.array([k[1] for k in kept], pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))), pa.array([k[2] for k in kept])]
                    names += ["ids", "offsets", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
