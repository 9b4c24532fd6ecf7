"""Periodic runs of words, by the linear method of Gusfield and Stoye for tandem repeats.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends keeping q; those of at least MANY periods and LEAST
words count. A suffix tree of the words is built with its suffix links. From
it come the Lempel-Ziv blocks, and from each block and the next the squares
(two equal halves) whose leftmost occurrence has its middle in the block: a set
that covers, up to rotations, every square's leftmost occurrence. Their ends
are marked in the tree, each at the first leaf below; walks along suffix links
mark the rotations that the text holds too, so at last all kinds of squares
are marked. The leaves below a mark are the places where its square stands;
squares whose half is itself a repetition are left out; places of one period
in a row merge into a run.

A word can be in a run only if it occurs MANY times in it. So a text is first
cut at words that are too rare, its parts again at those too rare in the part,
and so on; every run lies whole in a part that is left, and no word beside such
a part can extend it. Only these parts get a tree, whose cost per word is in
proportion to their length; most texts have none.

Texts are read whole. Null and empty texts have no words and no runs. Null ids
pass through; repeated rows give repeated rows; columns other than those named
are left out. Runs of a text come by start, then period.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import small_batches

MANY, LEAST = 4, 6
#: How often parts are cut again; what is left then gets a tree as it is.
CUTS = 12


class Tree:
    """The suffix tree of a sequence and an end mark; node 0 is the root.

    ``first`` and ``past`` bound the label of the edge into a node, ``depth``
    counts the symbols from the root, ``least`` is the smallest start of the
    suffixes below, which are ``starts[low:high]``.
    """

    def __init__(self, s: list[int]):
        self.s = s = [*s, -1]
        self._build()
        self._number()

    def _build(self) -> None:
        """Ukkonen's construction."""
        s, n = self.s, len(self.s)
        first, past, link, kids, suffix = [0], [0], [0], [{}], [-1]
        node = at = length = waiting = leaves = 0
        for i, c in enumerate(s):
            waiting += 1
            made = 0
            while waiting:
                if not length:
                    at = i
                k = kids[node].get(s[at])
                if k is None:
                    kids[node][s[at]] = len(first)
                    first.append(i)
                    past.append(n)
                    link.append(0)
                    kids.append(None)
                    suffix.append(leaves)
                    leaves += 1
                    if made:
                        link[made] = node
                        made = 0
                else:
                    a = first[k]
                    span = (past[k] if past[k] <= i else i + 1) - a
                    if length >= span:
                        at += span
                        length -= span
                        node = k
                        continue
                    if s[a + length] == c:
                        if made and node:
                            link[made] = node
                        length += 1
                        break
                    split = len(first)
                    first += [a, i]
                    past += [a + length, n]
                    link += [0, 0]
                    kids += [{s[a + length]: k, c: split + 1}, None]
                    suffix += [-1, leaves]
                    leaves += 1
                    kids[node][s[a]] = split
                    first[k] = a + length
                    if made:
                        link[made] = split
                    made = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - waiting + 1
        self.first, self.past, self.link, self.kids, self.suffix = first, past, link, kids, suffix

    def _number(self) -> None:
        first, past, kids, suffix = self.first, self.past, self.kids, self.suffix
        n = len(first)
        parent, depth, low, high, least = [0] * n, [0] * n, [0] * n, [0] * n, [len(self.s)] * n
        starts: list[int] = []
        order, stack = [], [0]
        while stack:
            v = stack.pop()
            order.append(v)
            low[v] = len(starts)
            if kids[v] is None:
                starts.append(suffix[v])
                least[v] = suffix[v]
                high[v] = len(starts)
                continue
            for k in kids[v].values():
                parent[k] = v
                depth[k] = depth[v] + past[k] - first[k]
                stack.append(k)
        for v in reversed(order):
            if v:
                u = parent[v]
                if least[v] < least[u]:
                    least[u] = least[v]
                if high[v] > high[u]:
                    high[u] = high[v]
        self.parent, self.depth, self.low, self.high, self.least, self.starts = parent, depth, low, high, least, starts
        self.leaf = {suffix[v]: v for v in order if kids[v] is None}


def blocks(tree: Tree) -> list[int]:
    """Where the Lempel-Ziv blocks start, and the end: each is the longest that also starts before, or one new symbol."""
    s, kids, least, depth = tree.s, tree.kids, tree.least, tree.depth
    n = len(s) - 1
    at, found = 0, []
    while at < n:
        found.append(at)
        node = 0
        while True:
            k = kids[node][s[at + depth[node]]]
            if least[k] >= at:
                break
            node = k
        at += max(1, depth[node])
    return [*found, n]


def overlaps(s: list[int]) -> list[int]:
    """For each place how many symbols from it equal those from the beginning (the Z function)."""
    n = len(s)
    z = [0] * n
    if not n:
        return z
    z[0] = n
    a = b = 0
    head = s[0]
    for i in range(1, n):
        if i < b:
            k = z[i - a]
            if k < b - i:
                z[i] = k
                continue
            k = b - i
        elif s[i] == head:
            k = 1
        else:
            continue
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        a, b = i, i + k
    return z


def leftmost(s: list[int], edges: list[int]) -> dict[int, list[int]]:
    """By start the lengths of squares that cover the leftmost ones, each with its middle in some block, longest first."""
    n = len(s)
    found: defaultdict[int, set[int]] = defaultdict(set)
    for j in range(len(edges) - 1):
        h, h1 = edges[j], edges[j + 1]
        h2 = edges[j + 2] if j + 2 < len(edges) else h1
        size, both = h1 - h, h2 - h
        if h1 < n and s[h1] in s[h:h1]:
            # squares that reach past the block: the next block's first symbol is in their right half
            ahead = overlaps([*s[h1 : h1 + size], -2, *s[h : h1 + size]])
            back = overlaps(s[max(0, h - size) : h1][::-1])
            off = min(size, n - h1) + 1
            for k in range(1, size + 1):
                k1 = ahead[off + size - k]
                if k1:
                    k2 = back[k] if k < len(back) else 0
                    if k1 + k2 >= k:
                        q = h1 - k
                        found[max(q - k2, q - k + 1)].add(2 * k)
        if h and both > 1 and s[h - 1] in s[h:h2]:
            # squares that start before the block and hold its first symbol in their left half
            ahead = overlaps(s[h : h + 2 * both])
            before = s[max(0, h - both) : h][::-1]
            back = overlaps([*before, -2, *s[max(0, h - both) : h2][::-1]])
            off = len(before) + 1
            for k in range(1, both + 1):
                k1 = ahead[k] if k < len(ahead) else 0
                k2 = back[off + both - k]
                if k1 and k2 and k1 + k2 >= k:
                    start = max(h - k2, h - k + 1)
                    if start + k <= h1:
                        found[start].add(2 * k)
    return {i: sorted(lengths, reverse=True) for i, lengths in found.items()}


def vocabulary(tree: Tree, covering: dict[int, list[int]]) -> set[tuple[int, int]]:
    """All squares, as (node at or under whose upper edge it ends, length): the covering ones and what suffix links lead to."""
    s, kids, link, parent, depth, least, first = tree.s, tree.kids, tree.link, tree.parent, tree.depth, tree.least, tree.first
    marks: set[tuple[int, int]] = set()
    for i, lengths in covering.items():
        v = tree.leaf[i]
        for length in lengths:
            while depth[parent[v]] >= length and least[v] == i:
                v = parent[v]
            if least[v] != i:
                break
            marks.add((v, length))
    for v, length in list(marks):
        while True:
            i = least[v]
            u = parent[v]
            at = link[u] if u else 0
            inside = i + 1  # the string from here, less its end, is looked for
            k = at
            while depth[k] < length - 1:
                k = kids[k][s[inside + depth[k]]]
            if depth[k] == length - 1:
                k = kids[k].get(s[i]) if kids[k] is not None else None
                if k is None:
                    break
            elif s[first[k] + length - 1 - depth[parent[k]]] != s[i]:
                break
            if (k, length) in marks:
                break
            marks.add((k, length))
            v = k
    return marks


def runs(s: list[int], many: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``many`` periods and ``least`` symbols or more, by start, then period."""
    if len(s) < 2:
        return []
    tree = Tree(s)
    by_period: defaultdict[int, list[int]] = defaultdict(list)
    for v, length in vocabulary(tree, leftmost(s, blocks(tree))):
        by_period[length // 2].append(v)
    known: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts and ends of runs
    found = []
    for q in sorted(by_period):
        smaller = [known[d] for d in _divisors(q) if d in known]
        places: list[int] = []
        for v in by_period[q]:
            i = tree.least[v]
            if not any((k := bisect_right(a, i)) and b[k - 1] >= i + 2 * q for a, b in smaller):
                places += tree.starts[tree.low[v] : tree.high[v]]
        if not places:
            continue
        places.sort()
        starts, ends = [places[0]], []
        for a, b in zip(places, places[1:], strict=False):
            if b > a + 1:
                ends.append(a + 2 * q)
                starts.append(b)
        ends.append(places[-1] + 2 * q)
        known[q] = starts, ends
        found += [(a, b - a, q) for a, b in zip(starts, ends, strict=True) if b - a >= max(least, many * q)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _divisors(q: int) -> list[int]:
    """Those below ``q``."""
    low = [d for d in range(1, int(q**0.5) + 1) if q % d == 0]
    return sorted({*low, *(q // d for d in low)} - {q})


def parts(words: list, many: int = MANY, least: int = LEAST) -> list[tuple[int, int]]:
    """(from, to) of the stretches in which every word occurs often enough for a run; each run lies in one."""
    todo, done = [(0, len(words), CUTS)], []
    while todo:
        a, b, left = todo.pop()
        if b - a < least:
            continue
        own = words[a:b]
        often = Counter(own)
        if not left or min(often.values()) >= many:
            done.append((a, b))
            continue
        at = a
        for i in [i for i, w in enumerate(own, a) if often[w] < many]:
            if i - at >= least:
                todo.append((at, i, left - 1))
            at = i + 1
        if b - at >= least:
            todo.append((at, b, left - 1))
    return sorted(done)


def text_runs(words: list[bytes], many: int = MANY, least: int = LEAST) -> list[tuple[int, int, int]]:
    found = []
    for a, b in parts(words, many, least):
        number: dict[bytes, int] = {}
        found += [(a + i, n, q) for i, n, q in runs([number.setdefault(w, len(number)) for w in words[a:b]], many, least)]
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that a run repeats: all that stand in it after its first period."""
    gone = bytearray(len(words))
    for start, length, q in found:
        gone[start + q : start + length] = b"\1" * (length - q)
    return [w for w, g in zip(words, gone, strict=True) if not g] if found else words


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of every row, its runs (start, length, period), and its words without repetitions, joined by single spaces."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def of(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, kept = [], []
            for text in batch["text"].to_pylist():
                words = (text or "").encode().split()
                own = text_runs(words)
                told.append([{"start": i, "length": n, "period": q} for i, n, q in own])
                kept.append(b" ".join(collapsed(words, own)).decode())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(told, run_type), pa.array(kept, pa.string())], [id_col, "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(of, f"{id_col} {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
