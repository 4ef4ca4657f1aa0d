"""Operator 12: periodic runs of words by suffix trees and Lyndon roots.

A run is a stretch of consecutive words with smallest period q, of ``MIN_EXPONENT`` periods and
``MIN_LENGTH`` words at least, that neither neighbour extends keeping the period. Ukkonen's suffix trees
of the words and of their reversal are flattened by Euler tours; the length that two suffixes (prefixes) have in
common is the least depth on the tour between their leaves, found in constant time by doubling
minima. By the runs theorem every run holds, in the alphabet's order or in the inverse one, a Lyndon root: the longest
Lyndon word that starts at some position, which ends where the next smaller suffix starts (the trees' leaf orders
tell). Each candidate root is extended in both directions by such lengths and kept if it is long enough.

Trees are built over the stretches of a document that can hold a run, with the words around them, and
over nothing else: in a run of period q each three words but the first ones occurred q words before, so at least
max(MIN_LENGTH, MIN_EXPONENT * q) - q - 2 consecutive word triples repeat one within q words. Stretches
where this holds for some class of periods [2^(k-1) + 1, 2^k] are found for many texts at once by sorting triples; runs
and their neighbours lie wholly inside (``test_stretches_hold_every_run``). No text is shortened for that.

Defined results: words are those of ``[^\\x20\\x09-\\x0D]+``, compared byte by byte; a null or empty text has no
words, no runs and collapses to the empty text; null ids and repeated rows are rows of their own; of a column
with a name of the result's, the result's stays; an empty table gives no rows. Memory is linear in the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_batches, whole_row

MIN_LENGTH, MIN_EXPONENT = 6, 4
GROUP_WORDS = 1 << 19  # words of the texts whose triples are sorted together, but for a longer text alone
OWN = ("n_runs", "top", "runs", "collapsed")


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols`` (1 and up) and an end marker 0, flattened by its Euler tour.

    ``tour`` holds the depth in symbols of each node visited, ``first`` the place of each suffix's leaf on it.
    """

    def __init__(self, symbols: list[int]):
        x = [*symbols, 0]
        n, base = len(x), max(x) + 1
        self.n = n
        # the edge into node v is x[start[v]:stop[v]]; kids: node * base + first symbol of the edge -> node
        start, stop, link, kids = [0], [0], [0], {}
        node = edge = length = pending = 0
        for i, c in enumerate(x):
            pending += 1
            unlinked = 0
            while pending:
                if not length:
                    edge = i
                slot = node * base + x[edge]
                child = kids.get(slot)
                if child is None:
                    kids[slot] = len(start)
                    start.append(i), stop.append(n), link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    span = stop[child] - start[child]
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    at = start[child] + length
                    if x[at] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    inner = len(start)  # the edge is split, a leaf hangs from the split
                    start.append(start[child]), stop.append(at), link.append(0)
                    kids[slot] = inner
                    start[child] = at
                    kids[inner * base + x[at]] = child
                    kids[inner * base + c] = inner + 1
                    start.append(i), stop.append(n), link.append(0)
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                pending -= 1
                if not node and length:
                    length, edge = length - 1, i - pending + 1
                elif node:
                    node = link[node]
        del link
        slots = np.fromiter(kids.keys(), np.int64, len(kids))
        order = np.argsort(slots)
        self._children = np.fromiter(kids.values(), np.int64, len(kids))[order].tolist()
        del kids
        slots = slots[order]
        self._from = np.searchsorted(slots, np.arange(len(start) + 1, dtype=np.int64) * base).tolist()
        self._marked = np.zeros(len(start), bool)  # nodes below which the end marker's edge comes first
        self._marked[slots[slots % base == 0] // base] = True
        self._walk(start, stop)

    def _walk(self, start: list[int], stop: list[int]) -> None:
        children, lo = self._children, self._from
        depth, tour, first, stack = [0] * len(start), [], [0] * self.n, [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            d = depth[v]
            if lo[v] == lo[v + 1]:
                first[self.n - d] = len(tour)
            else:
                back = ~v
                for k in range(lo[v + 1] - 1, lo[v] - 1, -1):
                    c = children[k]
                    depth[c] = d + stop[c] - start[c]
                    stack.append(back)
                    stack.append(c)
            tour.append(d)
        self.tour, self.first = np.array(tour, np.int32), np.array(first, np.int64)
        self._depth = depth

    def ranks(self, inverse: bool) -> list[int]:
        """Rank of each suffix in the order of the symbols, or in the inverse one (the end first in both)."""
        if not inverse:
            order = np.argsort(self.first)
        else:
            children, lo, depth, marked = self._children, self._from, self._depth, self._marked.tolist()
            leaves, stack = [], [0]
            while stack:
                v = stack.pop()
                a, b = lo[v], lo[v + 1]
                if a == b:
                    leaves.append(self.n - depth[v])
                elif marked[v]:
                    stack += children[a + 1:b]
                    stack.append(children[a])
                else:
                    stack += children[a:b]
            order = np.array(leaves, np.int64)
        out = np.empty(self.n, np.int64)
        out[order] = np.arange(self.n)
        return out.tolist()

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes i and j (never equal), for many pairs."""
        a, b = self.first[i], self.first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1  # 2^level entries, twice, cover the way from a to b
        out, least = np.zeros(len(a), np.int64), self.tour
        for k in range(int(level.max(initial=0)) + 1):
            if k:
                least = np.minimum(least[:-(1 << k - 1)], least[1 << k - 1:])
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(least[a[here]], least[b[here] - (1 << k) + 1])
        return out


def lyndon_roots(ranks: list[int]) -> np.ndarray:
    """For each position but the end, the end of the longest Lyndon word from there: the next smaller suffix."""
    out, stack = [0] * (len(ranks) - 1), []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, sorted by start, then period. Symbols are numbered from 1."""
    n = len(symbols)
    if n < MIN_LENGTH:
        return []
    tree = SuffixTree(symbols)
    starts, ends = [], []
    for inverse in (False, True):
        end = lyndon_roots(tree.ranks(inverse))
        start = np.flatnonzero((end - np.arange(n)) * MIN_EXPONENT <= n)
        starts.append(start)
        ends.append(end[start])
    i, j = np.concatenate(starts), np.concatenate(ends)
    right = tree.common(i, j)
    del tree
    left = SuffixTree(symbols[::-1]).common(n - i, n - j)
    period, start, length = j - i, i - left, j - i + left + right
    long_enough = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * period)
    found = np.unique(np.stack([start, period, length])[:, long_enough], axis=1)
    return [(s, k, q) for s, q, k in found.T.tolist()]


def stretches(ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint (from, to) places of ``ids`` that hold every run with its neighbours, in order.

    ``ids`` are the words of texts one after another, each followed by a word that occurs nowhere else;
    ``starts`` says where each text starts (and where the last ends).
    """
    if len(ids) < MIN_LENGTH:
        return []
    wide = int(ids.max()) + 1
    pair = ids[:-1] * wide + ids[1:]
    if wide >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * wide + ids[2:]
    order = np.argsort(triple, kind="stable")
    same = np.flatnonzero(triple[order[1:]] == triple[order[:-1]])
    back = np.full(len(triple), len(ids) + 1, np.int64)  # how far back the triple occurred before
    back[order[same + 1]] = order[same + 1] - order[same]
    text = np.searchsorted(starts, np.arange(len(triple)), side="right") - 1
    back[np.arange(len(triple)) - back < starts[text]] = len(ids) + 1  # in another text
    found, longest, k = [], int(np.diff(starts).max()), 0
    while k == 0 or ((1 << k - 1) + 1) * MIN_EXPONENT <= longest:
        least_period = 1 if k == 0 else (1 << k - 1) + 1
        needed = max(MIN_LENGTH, MIN_EXPONENT * least_period) - least_period - 2
        near = np.concatenate([[False], back <= 1 << k, [False]])
        edges = np.flatnonzero(near[1:] != near[:-1]).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= needed].tolist():
            t = text[a]
            found.append((max(int(starts[t]), a - (1 << k) - 1), min(int(starts[t + 1]) - 1, b + 3)))
        k += 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text's words."""
    number: dict[bytes, int] = {}
    flat, starts = [], [0]
    for words in texts:
        flat += [number.setdefault(w, len(number)) for w in words]
        flat.append(-1)
        starts.append(len(flat))
    ids, begins = np.array(flat, np.int64), np.array(starts, np.int64)
    ends = np.flatnonzero(ids < 0)
    ids[ends] = len(number) + np.arange(len(ends))
    out: list[list] = [[] for _ in texts]
    for a, b in stretches(ids, begins):
        t = int(np.searchsorted(begins, a, side="right")) - 1
        symbols = (np.unique(ids[a:b], return_inverse=True)[1] + 1).tolist()
        out[t] += [(a - starts[t] + s, k, q) for s, k, q in runs_of(symbols)]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(w for w, g in zip(words, np.cumsum(gone).tolist()) if not g)


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_runs, top (the run of greatest exponent), runs and collapsed (the text without repeats)."""

    def rows(texts: list[list[bytes]]) -> Iterator[tuple]:
        for words, runs in zip(texts, runs_of_texts(texts)):
            top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
            yield len(runs), top, runs, collapse(words, runs)

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, group, size = [], [], 0
            for text in batch.column(0):
                words = text.as_py().encode("utf-8").split() if text.is_valid else []
                if group and size + len(words) > GROUP_WORDS:
                    out += rows(group)
                    group, size = [], 0
                group.append(words)
                size += len(words)
            out += rows(group)
            named = [dict(zip(("start", "length", "period"), top)) if top else None for _, top, _, _ in out]
            listed = [[dict(zip(("start", "length", "period"), r)) for r in runs] for _, _, runs, _ in out]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r[0] for r in out], pa.int64()), pa.array(named, run),
                                              pa.array(listed, pa.list_(run)), pa.array([r[3] for r in out], pa.binary()).cast(pa.string())],
                                             ["_doc", *OWN])

    row_batches(docs.sparkSession)
    rest = docs.select(F.col(text_col).alias("_text"), whole_row(docs, (text_col, *OWN)))
    one = "struct<start: long, length: long, period: long>"
    out = rest.mapInArrow(find, f"_doc {dict(rest.dtypes)['_doc']}, n_runs long, top {one}, runs array<{one}>, collapsed string")
    return out.select("_doc.*", *OWN)
