"""Word shingles of whole texts as sorted sets of 64-bit hashes, by numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of texts hashed at a time; keeps the arrays inside the CPU's caches.
AT_ONCE = 1 << 19
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, kept: list = [np.ones(1, U)]) -> np.ndarray:  # noqa: B006  kept between calls
    if len(kept[0]) < n:
        kept[0] = np.cumprod(np.r_[U(1), np.full(2 * n, _BASE, U)])
    return kept[0]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes starts, and its hash (A-Z as a-z)."""
    gap = _SPACES[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, U)
    lengths = ends - starts
    inside = np.flatnonzero(~gap)
    firsts = np.cumsum(np.r_[0, lengths[:-1]])
    place = np.arange(len(inside)) - np.repeat(firsts, lengths)
    terms = mix(_LOWER[raw[inside]].astype(U) + U(1)) * _powers(int(lengths.max()) + 1)[place]
    return starts, mix(np.add.reduceat(terms, firsts) + lengths.astype(U) * _BASE)


def shingle_sets(texts: list[str | None], words: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer words has one shingle, the whole sequence; a text without
    words (or a null) has none.
    """
    factors = mix(np.arange(1, words + 1, dtype=U)) | U(1)
    raws = [t.encode() if t else b"" for t in texts]
    at = 0
    while at < len(raws):
        to, size = at, 0
        while to < len(raws) and (to == at or size + len(raws[to]) <= AT_ONCE):
            size += len(raws[to]) + 1
            to += 1
        starts, hashes = word_hashes(np.frombuffer(b"\n".join(raws[at:to]), np.uint8))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws[at:to])]))
        grams = mix(sum(hashes[i : max(i, len(hashes) - words + 1 + i)] * factors[i] for i in range(words))) if len(hashes) >= words else None
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield mix((hashes[a:b] * factors[: b - a]).sum(dtype=U, keepdims=True) + U(b - a))
            else:
                yield np.zeros(0, U)
        at = to


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers: equal for equal sets."""
    whole = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def batches_of(batches, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """(ids, texts) of Arrow batches in runs of a few hundred rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part: pa.RecordBatch = batch.slice(i, 512)
            yield part[id_col].to_pylist(), part[text_col].to_pylist()
