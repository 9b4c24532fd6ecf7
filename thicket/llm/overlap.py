"""N-gram Jaccard join by trees over count vectors, exact and spread over Spark.

Each document's word shingles are hashed, and hashed again into groups; how
many fall into each group is the document's point. Two sets share at most the
sum over groups of the smaller count, which rules most pairs out.

1. One pass takes each document's set size, set digest and point, and counts
   shingles that several sets hold. Equal sets form a class at once.
2. The same bound on the finest groups, single shingles, deals documents to
   blocks: with frequent shingles last and the rest by hash, two sets of the
   asked similarity must share one of their first n - ceil(t n) + 1 shingles.
   Which are called frequent only moves work, never the result.
3. In every block the documents meet a leader of about their size first, the one
   most of whose shingles others share: a text that others were made from.
   Bounds are tried, then sets are compared; the links give components.
4. Blocks in which several components are left get an R-tree each of those
   documents that another component has a similar size to: documents of
   different components whose points don't rule it out are compared too. Each
   tries its most promising partners first; those of a block that have others
   left come again, with the components that these made, until none has any.
   So no link between components is missed, and nobody lists all pairs of a block.
   A block too large for one task is dealt to many as pairs of its parts.

Documents that share an id are one document. Null ids link with nothing. Empty
texts have no shingles and link with nothing. Columns other than id and text
are left out, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import cut, every, small_batches
from thicket.llm.shingles import batches_of, digest, shingle_sets

U = np.uint64
#: The similarity asked for, as a fraction.
NUM, DEN = 75, 100
#: A shingle in so many sets counts as frequent.
FREQUENT = 16
#: At most so many frequent shingles are told to all tasks (8 bytes each).
TOLD = 1_000_000
#: A point counts so many shingles in a group at most.
MOST = 3
#: Documents meet leaders of their own class of sizes and the next smaller one; classes are wider than similar sizes can differ.
CLASS = 1.35
#: So many partners, those of the highest bounds, a document tries first in a block; later rounds try MORE times as many, until all are tried.
FEW, MORE = 4, 8
#: A block's part for one task of step 4.
PART = 2_048
#: So many of a document's smallest keys go with it, so that pairs meet once or little more.
FIRSTS = 4
#: Numbers that a block's points take in memory at most; larger blocks fold theirs to fewer groups, whose bound is weaker but holds.
POINTS = 1 << 26
#: Shingles, digests and pairs that a task keeps to spare later work; beyond that it forgets them, which changes no result.
KEPT, DIGESTS, PAIRS = 1 << 22, 1 << 19, 1 << 17
#: Ids of so many documents are sent to all tasks at most, else joined (8 bytes each).
SENT = 1_000_000
#: What is written of pairs, labels and blocks' rows is read in parts of about so many rows: a small table is one part and isn't shuffled.
ROWS = 50_000


def needed(a, b):
    """The least overlap of sets of a and b elements that are similar enough: t / (1 + t) of a + b."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_length(n: int) -> int:
    """Of the larger set of a pair, so many first shingles hold a common one; any other is too far back."""
    return n - -(-NUM * n // DEN) + 1


def index_length(n: int) -> int:
    """The same for the smaller set, which must share more of its own."""
    return n - -(-2 * NUM * n // (NUM + DEN)) + 1


def point(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each group, up to MOST, four groups to a byte; larger sets have more groups, always a power of two."""
    groups = 1 << min(15, max(4, len(shingles).bit_length() + 1))
    c = np.bincount((shingles & U(groups - 1)).astype(np.int64), minlength=groups).clip(max=MOST).astype(np.uint8)
    return (c[::4] | c[1::4] << 2 | c[2::4] << 4 | c[3::4] << 6).tobytes()


def n_groups(raw: bytes) -> int:
    return 4 * len(raw)


def counts(raw: bytes, n: int, groups: int | None = None) -> np.ndarray:
    """A point's counts, folded to so many groups, and how many of the set's ``n`` shingles they leave out.

    Of two points in the same groups, the sum of the smaller counts, with what
    both leave out as one more, bounds the overlap.
    """
    b = np.frombuffer(raw, np.uint8)
    v = np.stack([b >> s & 3 for s in (0, 2, 4, 6)], 1).ravel()
    if groups and len(v) > groups:
        v = v.reshape(-1, groups).sum(0, dtype=np.int64).clip(max=MOST)
    return np.r_[v.astype(np.int32), np.int32(n - v.sum(dtype=np.int64))]


def _steps(points: np.ndarray) -> np.ndarray:
    """Whether each count is at least 1, 2, ...: products of two such rows sum the smaller counts."""
    return np.concatenate([points[:, :-1] >= k for k in range(1, MOST + 1)], 1).astype(np.float32)


class CountTree:
    """An R-tree over points: each node has its points' largest counts and their sizes' range."""

    FAN = 16
    #: About so many numbers of points are unfolded at a time.
    CELLS = 1 << 22

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        half = points.shape[1] // 2
        self.order = np.lexsort((points[:, :half].sum(1), sizes))
        self.levels = [(sizes[self.order], sizes[self.order], points[self.order])]
        while len(self.levels[-1][0]) > self.FAN:
            low, high, top = self.levels[-1]
            edges = np.arange(0, len(low), self.FAN)
            self.levels.append((np.minimum.reduceat(low, edges), np.maximum.reduceat(high, edges), np.maximum.reduceat(top, edges)))

    def search(self, size: int, p: np.ndarray) -> np.ndarray:
        """Which points may overlap enough with ``p``, a set of ``size`` elements."""
        return next(self.search_many(np.array([size]), p[None]))[0]

    def search_many(self, sizes: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each asking point in turn which points may overlap enough with it, and the bounds; best if neighbours have similar sizes."""
        rows = max(1, self.CELLS // (MOST * points.shape[1]))
        for i in range(0, len(sizes), min(rows, 256)):
            yield from self._descend(sizes[i : i + min(rows, 256), None], points[i : i + min(rows, 256)], rows)

    def _descend(self, sizes: np.ndarray, points: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        asked = _steps(points)
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high, top = (x[nodes] for x in self.levels[depth])
            bound = np.minimum(top[:, -1], points[:, -1:]).astype(np.float32)
            for k in range(0, len(nodes), rows):
                bound[:, k : k + rows] += asked @ _steps(top[k : k + rows]).T
            fits = (DEN * high >= NUM * sizes) & (NUM * low <= DEN * sizes) & (bound >= needed(sizes, np.maximum(low, -(-NUM * sizes // DEN))))
            if depth:
                nodes = nodes[fits.any(0)]
                nodes = (nodes[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        for i in range(len(sizes)):
            yield self.order[nodes[fits[i]]], bound[i, fits[i]]


def _near(sizes: np.ndarray, v: np.ndarray, asks: np.ndarray, few: int = 24) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each point that asks those that its bound doesn't rule out, and their bounds: all at once for a few points, by a tree for many."""
    if len(sizes) > few:
        asks = asks[np.argsort(sizes[asks], kind="stable")]
        for i, (others, bounds) in zip(asks.tolist(), CountTree(sizes, v).search_many(sizes[asks], v[asks]), strict=True):
            yield i, others, bounds
        return
    for i in asks.tolist():
        bound = np.minimum(v, v[i]).sum(1, dtype=np.int64)
        fits = np.flatnonzero((bound >= needed(sizes, sizes[i])) & _sizes_fit(sizes, sizes[i]))
        yield i, fits, bound[fits]


def block_pairs(key: int, ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, points: list[bytes], sides: np.ndarray, firsts: np.ndarray, few: int | None = None) -> tuple[set[tuple[int, int]], set[int]]:
    """Pairs of a block, with other labels, whose points allow the overlap; between both sides, or in one where there's only one.

    With ``few`` a document gives its partners of the highest bounds, so many;
    the second value has both ends of all pairs that are left. Every pair has an
    end outside the block's largest label, so only such documents search.

    Sizes that may match differ by less than two to one, so their numbers of
    groups do by two to one at most: a turn for each number takes the points of
    that many and twice as many groups. ``firsts`` has each document's smallest
    keys: a pair with one of them in common, under this one, meets there.
    """
    found: set[tuple[int, int]] = set()
    left: set[int] = set()
    if firsts[0, 0] < key and (firsts[:, 0] == firsts[0, 0]).all():
        return found, left
    one = (sides == sides[0]).all()
    groups = np.array([n_groups(p) for p in points])
    names, many = np.unique(labels, return_counts=True)
    asks = labels != names[many.argmax()]
    for g in np.unique(groups).tolist():
        near = np.flatnonzero((groups == g) | (groups == 2 * g))
        if len(near) < 2 or (labels[near] == labels[near[0]]).all():
            continue
        fewer = g
        while fewer > 16 and len(near) * fewer > POINTS // 4:
            fewer //= 2
        v = np.stack([counts(points[i], int(sizes[i]), fewer) for i in near])
        for k, others, bounds in _near(sizes[near], v, np.flatnonzero(asks[near])):
            i, js = near[k], near[others]
            fit = (labels[js] != labels[i]) & (ids[js] != ids[i]) & (one | (sides[js] != sides[i])) & ((groups[i] == g) | (groups[js] == g))
            js, bounds = js[fit], bounds[fit]
            if not len(js):
                continue
            own = firsts[i][firsts[i] < key]
            fit = ~(firsts[js][:, :, None] == own).any((1, 2))
            js, bounds = js[fit], bounds[fit]
            if few and len(js) > few:
                js = js[np.argsort(-bounds, kind="stable")]
                left.update((int(ids[i]), *ids[js[few:]].tolist()))
                js = js[:few]
            found.update((min(ids[i], ids[j]), max(ids[i], ids[j])) for j in js.tolist())
    return found, left


def _describe(docs: DataFrame) -> DataFrame:
    """kind 0: a row for each document; kind 1: shingles that a task saw in several sets, of those that may matter for prefixes."""
    most = U(int(2**64 * (1.2 * (DEN - NUM) / DEN)))

    def run(batches):
        seen: set[tuple[int, int]] = set()
        kept: list[np.ndarray] = []
        held = 0
        for ids, texts in batches_of(batches, "doc", "text"):
            rows = []
            for i, s in zip(ids, shingle_sets(texts), strict=True):
                key = digest(s)
                rows.append((0, i, len(s), *key, point(s), None))
                if key not in seen:
                    seen.add(key)
                    kept.append(s[: np.searchsorted(s, most)].copy())
                    held += len(kept[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            if held > KEPT:
                yield from several(kept)
                kept, held = [], 0
            if len(seen) > DIGESTS:
                seen.clear()
        yield from several(kept)

    def several(kept):
        keys, n = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, U), np.zeros(0, np.int64))
        keys, n = keys[n > 1].view(np.int64), n[n > 1]
        for i in range(0, len(keys), 100_000):
            k, m = keys[i : i + 100_000], n[i : i + 100_000]
            none = [pa.nulls(len(k), t) for t in (pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int32)), none[0], pa.array(m.astype(np.int64)), pa.array(k), none[0], none[1], none[0]], names)

    names, types = ["kind", "doc", "n", "hi", "lo", "vec", "pad"], [pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.int64()]
    return docs.mapInArrow(run, "kind int, doc long, n long, hi long, lo long, vec binary, pad long").drop("pad")


def _deal(docs: DataFrame, frequent) -> DataFrame:
    """(key, probe, lo, doc): a row for each prefix shingle of each set that is new to its task; probe is 1 beyond the index prefix."""

    def run(batches):
        last = np.sort(frequent.value).view(U)
        last.sort()
        seen: set[tuple[int, int]] = set()
        for ids, texts in batches_of(batches, "doc", "text"):
            keys, rows = [], []
            for i, s in zip(ids, shingle_sets(texts), strict=True):
                n = len(s)
                if not n or i is None or (key := digest(s)) in seen:
                    continue
                seen.add(key)
                hot = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(n, bool)
                keys.append(np.r_[s[~hot], s[hot]][: prefix_length(n)] if hot.any() else s[: prefix_length(n)])
                rows.append((key[1], i, n, len(keys[-1])))
            if rows:
                lo, doc, n, many = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                if len(seen) > DIGESTS:
                    seen.clear()
                probe = np.concatenate([np.arange(k) >= index_length(m) for k, m in zip(many.tolist(), n.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(probe.astype(np.int8)), *(pa.array(np.repeat(c, many)) for c in (lo, doc))], ["key", "probe", "lo", "doc"])

    return docs.mapInArrow(run, "key long, probe byte, lo long, doc long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, probe and lo the first of each set, if other sets have the key too and one of them in its index prefix.

    A key's index rows come first, so its first row tells. Only the last row of
    what came is held back, so any length of run will do.
    """
    names = ["key", "doc"]
    state = None
    for batch in batches:
        key, probe, lo, doc = (batch[c].to_numpy() for c in ("key", "probe", "lo", "doc"))
        if not len(key):
            continue
        before, useful = np.zeros(len(key), bool), probe == 0
        if state:
            key, lo, doc, before, useful = (np.r_[np.array([s], x.dtype), x] for s, x in zip(state, (key, lo, doc, before, useful), strict=True))
        new = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1])]
        key, lo, doc, before, useful = (x[new] for x in (key, lo, doc, before, useful))
        first = np.r_[True, key[1:] != key[:-1]]
        useful = useful[np.flatnonzero(first)[np.cumsum(first) - 1]]
        before = np.where(first, before, True)
        out = np.flatnonzero(((before | np.r_[~first[1:], False]) & useful)[:-1])
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, doc)], names)
        state = tuple(x[-1] for x in (key, lo, doc, before, useful))
    if state and state[3] and state[4]:
        yield pa.RecordBatch.from_arrays([pa.array([int(state[i])], pa.int64()) for i in (0, 2)], names)


def _trees(batches: Iterator[pa.RecordBatch], few: int) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks, of rows sorted by key and part; a part of a block has a bounded number of rows.

    A row with a key stands for a document, a, of that block that has pairs left.
    """
    held: list[pa.RecordBatch] = []
    told: set[tuple[int, int]] = set()

    def flush(tables) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables)
        ids, sizes, labels, side, key, part = (t[c].to_numpy() for c in ("doc", "n", "label", "side", "key", "part"))
        points = t["vec"].to_pylist()
        firsts = np.full((len(ids), FIRSTS), np.iinfo(np.int64).max)
        for i, f in enumerate(t["firsts"].to_pylist()):
            firsts[i, : len(f)] = f
        edges = np.r_[np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]), len(key)]
        fresh: set[tuple[int, int]] = set()
        unfinished = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            pairs, left = block_pairs(int(key[a]), ids[a:b], sizes[a:b], labels[a:b], points[a:b], side[a:b], firsts[a:b], few)
            fresh |= pairs
            unfinished += [(i, None, int(key[a])) for i in left]
        fresh -= told
        if len(told) < PAIRS:
            told.update(fresh)
        rows = [*((int(i), int(j), None) for i, j in fresh), *unfinished]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in rows], pa.int64()) for i in (0, 1, 2)], ["a", "b", "key"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch["key"].to_numpy(), batch["part"].to_numpy()
        change = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        if held and (held[-1]["key"][-1].as_py(), held[-1]["part"][-1].as_py()) != (key[0], part[0]):
            yield flush(held)
            held = []
        if len(change):
            cut_at = int(change[-1]) + 1
            yield flush([*held, batch.slice(0, cut_at)])
            held = []
            batch = batch.slice(cut_at)
        held.append(batch)
    if held:
        yield flush(held)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose points allow the overlap."""
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("n_a", "n_b", "vec_a", "vec_b")), strict=True)
        keep = []
        for n, m, p, q in rows:
            groups = min(n_groups(p), n_groups(q))
            keep.append(int(np.minimum(counts(p, n, groups), counts(q, m, groups)).sum()) >= needed(n, m))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets overlap enough."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            keep = []
            for p, q in zip(part["set_a"].to_pylist(), part["set_b"].to_pylist(), strict=True):
                p, q = np.frombuffer(p, U), np.frombuffer(q, U)
                keep.append(len(np.intersect1d(p, q, assume_unique=True)) >= needed(len(p), len(q)))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in batches_of(batches, "doc", "text"):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["doc", "set"])


def _few(written: DataFrame) -> tuple[DataFrame, int]:
    """The same rows in parts of about ROWS, and how many there are."""
    n = written.coalesce(written.sparkSession.sparkContext.defaultParallelism).count()
    return written.coalesce(max(1, -(-n // ROWS))), n


def _small(rows: DataFrame, n: int) -> DataFrame:
    """For a join: ``rows``, of which there are ``n`` at most, are sent to all tasks if they are one part."""
    return F.broadcast(rows) if n <= ROWS else rows


def _verify(pairs: DataFrame, n: int, docs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of the ``n`` pairs (a, b) that are links; of documents that share an id perhaps many times."""

    def with_both(pairs: DataFrame, n: int, of: DataFrame) -> DataFrame:
        a, b = (of.select(*(F.col(c).alias(name if c == "doc" else f"{c}_{name}") for c in of.columns)) for name in ("a", "b"))
        return a.join(_small(pairs, n), "a").join(b, "b")

    left, n = _few(cut(with_both(pairs, n, points).mapInArrow(_bounded, "a long, b long")))
    asked = left.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    if n > ROWS:
        asked = cut(asked)
    asked_for = F.broadcast(asked) if n <= min(ROWS, SENT // 2) or asked.count() <= SENT else asked
    sets = cut(docs.join(asked_for, "doc", "left_semi").mapInArrow(_sets, "doc long, set binary"))
    return with_both(left, n, sets).mapInArrow(_verified, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach; by turns of large and small stars.

    Each turn hangs every node's neighbours on the smallest, so chains shorten
    by a constant factor; it ends when a turn changes nothing.
    """
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    edges, n = _few(cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    was, now = None, (n, edges.agg(mark).first()[0])
    while was != now:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(_small(low, 2 * n), "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(_small(low, 2 * n), "b").select("m", F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges, n = _few(cut(small.select(F.least("m", "b").alias("a"), F.greatest("m", "b").alias("b")).filter("a <> b").distinct()))
        was, now = now, (n, edges.agg(mark).first()[0])
    # now every edge is of a component's smallest node
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a").distinct().select("a", "a"))


def _level(n) -> Column:
    """A set's class of sizes; similar sizes are of one class or of neighbours."""
    return F.floor(F.log(n) / F.lit(math.log(CLASS))).cast("int")


def _led(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each block's documents with a leader of their class of sizes, or of the class below.

    A class's leader is its document most of whose prefix others share, so a
    block of two is done here. Leaders are found by partial maxima: a key that
    a third of all documents share meets in no single task.
    """
    own = rows.withColumn("level", _level(F.col("n")))
    best = own.groupBy("key", "level").agg(F.max(F.struct("known", (-F.col("doc")).alias("back"), "n")).alias("best"))
    leaders = best.select("key", "level", (-F.col("best.back")).alias("leader"), F.col("best.n").alias("size"))
    asks = own.select("key", "doc", "n", F.explode(F.array(F.col("level"), F.col("level") - 1)).alias("level"))
    met = asks.join(leaders, ["key", "level"]).filter((F.col("leader") != F.col("doc")) & _sizes_fit(F.col("n"), F.col("size")))
    return met.select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()


def _sizes_fit(n, m):
    return (NUM * n <= DEN * m) & (NUM * m <= DEN * n)


def _open(rows: DataFrame, done: int) -> DataFrame:
    """key, doc, label and m (the block's rows) of those with a document of another label in their or a neighbouring class of sizes.

    Blocks of so many rows are ``done``. If two documents may match, both are
    there, so a later round can do with rows of an earlier one. Counted by partial aggregates of each block's classes, whose number has a
    bound, so a block of any size is dealt to many tasks.
    """
    own = rows.withColumn("level", _level(F.col("n")))
    classes = own.groupBy("key", "level").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("many"))
    block = classes.groupBy("key").agg(F.sum("many").cast("int").alias("m"), F.min("least").alias("first"), F.max("most").alias("last"), F.collect_list(F.struct("level", "least", "most", "low", "high")).alias("classes")).filter(F.col("m") > done).filter("first < last").select("key", "m", "classes")
    met = own.join(block, "key").select("key", "doc", "n", "label", "level", "m", "classes")
    other = F.exists("classes", lambda c: (F.abs(c["level"] - F.col("level")) <= 1) & ((c["least"] != F.col("label")) | (c["most"] != F.col("label"))) & (NUM * c["low"] <= DEN * F.col("n")) & (NUM * F.col("n") <= DEN * c["high"]))
    return met.filter(other).select("key", "doc", "label", "m")


def links(docs: DataFrame, described: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar documents of different sets; docs has (doc, text)."""
    spark = docs.sparkSession
    totals = described.filter("kind = 1").groupBy(F.col("hi").alias("key")).agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    told = totals.orderBy(F.desc("n"), "key").limit(TOLD).select("key").toPandas()["key"].to_numpy(np.int64)
    frequent = spark.sparkContext.broadcast(told)
    points = described.filter("kind = 0 and n > 0 and doc is not null").select("doc", "n", "vec")
    rows, _ = _few(cut(_deal(docs, frequent).repartition("key").sortWithinPartitions("key", "probe", "lo", "doc").mapInArrow(_shared, "key long, doc long")))
    prefix = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    known, many = _few(cut(rows.groupBy("doc").agg(F.count("*").alias("shared")).join(points.select("doc", "n"), "doc").select("doc", F.col("n").cast("int").alias("n"), (F.col("shared") / prefix).cast("float").alias("known"))))
    few = many <= SENT // 2
    tested, n_tested = _few(cut(_led(rows.join(F.broadcast(known) if few else known, "doc"))))
    # a block of two has met its leader
    linked, labels, tries, done = _verify(tested, n_tested, docs, points), None, FEW, 2
    while True:
        if labels is None:
            labels, n_labels = _few(cut(components(linked).withColumnRenamed("node", "doc")))
            linked = labels.select(F.col("component").alias("a"), F.col("doc").alias("b"))
        labelled = known.join(_small(labels, n_labels), "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("label"))
        in_open, n = _few(cut(_open(rows.join(F.broadcast(labelled) if few else labelled, "doc"), done)))
        met, _ = _few(cut(_met(in_open, n, points, tries)))
        pairs, n = _few(cut(met.filter("key is null").select("a", "b").distinct().join(_small(tested, n_tested), ["a", "b"], "left_anti")))
        tested, n_tested = tested.union(pairs), n_tested + n
        between = _verify(pairs, n, docs, points)
        # a component and what links to it are one edge, however many of its documents do
        for side in ("a", "b"):
            between = between.join(_small(labels.select(F.col("doc").alias(side), F.col("component").alias(f"label_{side}")), n_labels), side, "left").withColumn(side, F.coalesce(f"label_{side}", side)).select("a", "b")
        between, n = _few(cut(between.distinct()))
        if n:
            linked, labels = linked.union(between), None
        rows, n = _few(cut(met.filter("key is not null").select("key", F.col("a").alias("doc")).distinct()))
        if not n:
            return linked
        tries, done = tries * MORE, 1


def _met(in_open: DataFrame, n: int, points: DataFrame, few: int) -> DataFrame:
    """Pairs (a, b) of the open blocks' trees, and (a, null, key) for their documents with pairs left."""
    firsts = in_open.groupBy("doc").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRSTS).alias("firsts"))
    open_rows = points.join(F.broadcast(in_open.join(F.broadcast(firsts), "doc")), "doc") if n <= ROWS else in_open.join(points.join(firsts, "doc"), "doc")
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / PART)).cast("int")
    own = F.pmod(F.xxhash64("doc"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = open_rows.withColumns({"parts": parts, "side": own}).select("*", other.alias("other"))
    dealt = dealt.withColumn("part", F.least("side", "other") * F.col("parts") + F.greatest("side", "other"))
    placed = dealt.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "side", "doc", "n", "label", "vec", "firsts")
    return placed.mapInArrow(lambda batches: _trees(batches, few), "a long, b long, key long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest id that links reach (itself included)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    described = cut(_describe(texts))
    rows = described.filter("kind = 0").select("doc", "n", "hi", "lo")
    classes = cut(rows.filter("n > 0 and doc is not null").groupBy("hi", "lo").agg(F.min("doc").alias("rep")))
    copies = rows.filter("n > 0 and doc is not null").join(classes, ["hi", "lo"]).select("doc", "rep")
    found = cut(links(texts, described))
    ends = found.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(copies, "doc").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    labels = components(found.union(ends)).withColumnRenamed("node", "rep")
    placed = rows.join(classes.join(labels, "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component")), ["hi", "lo"], "left")
    return placed.select(F.col("doc").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")).cast(kind).alias("component_id"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, and all that have none; of rows with one id one stays."""
    found = near_duplicates(docs, id_col, text_col)
    dropped = cut(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct())
    kept = docs.join(F.broadcast(dropped) if dropped.count() <= SENT else dropped, id_col, "left_anti").select(*every(docs))
    if docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").take(1):
        kept = kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.filter(F.col(id_col).isNull()))
    return kept


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5) x
  UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT a AS root, a AS node FROM l UNION SELECT r.root, l.b FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(root) AS m FROM r GROUP BY 1) c ON c.node = d.doc_id
"""
