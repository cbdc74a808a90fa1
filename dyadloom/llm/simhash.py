"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints are made in Arrow batches. Equal ones meet first (one row a
fingerprint), so a third of the corpus being one text costs nothing further.
The trie over the distinct fingerprints is cut at a depth of a few bits: pairs of
cut nodes whose prefixes differ in at most the budget become groups, and in each
group the two subtrees are walked together, adding differing bits and leaving a
pair as soon as the budget is passed. Each group reports a spanning forest of the
links it found, never the pairs, and forests are joined by rounds of hooking.

Two bits of 64 hold texts together that differ in a word or so. For a lower similarity
``alike`` joins many tries, each over other bits of a wide fingerprint: two texts that
share most shingles are within the budget in some of them.
"""

from __future__ import annotations

from itertools import combinations, repeat
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, mix64, settle

_SEED = 42
_BLOCK = 1 << 16
#: Fingerprints that one cut node holds on average, from which depth follows.
NODE = 1 << 16
LEAST_DEPTH = 4
_LEAF = 32
_FRONTIER = 1 << 15
#: Pairs of members that are compared at once.
_AT_ONCE = 1 << 18

#: A wide fingerprint's words; tries over it, the bits in which all of a trie agree, the
#: bits that it walks, and those that may differ in the 128 that begin with them.
WORDS, TABLES = 27, 72
_KEY, _WALKED, _MOST = 4, 20, 32
#: Shingles up to which a text has a second wide fingerprint, as votes of few are rough.
FEW = 32
#: Neighbours in a trie's order that are compared before the walk.
_AHEAD = 4
#: Members that one cut node of these tries holds on average.
WIDE_NODE = 1 << 20
_LANES = np.uint64(0x0101010101010101)
_WIDE_KEYS = np.random.default_rng(_SEED).integers(0, 1 << 63, (2, WORDS), np.uint64) * np.uint64(2) + np.uint64(1)
_WINDOWS = ((_KEY + _WALKED) * np.arange(TABLES)[:, None] + np.arange(128)) % (64 * WORDS)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 of each shingle; no words: zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(_SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), _BLOCK):
        bits = np.unpackbits(h[k : k + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for ids, texts in arrow_rows(batches, "doc_id", "text"):
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])


def _order(sums: list[int], n: int) -> list[int]:
    """Bits from the most to the least balanced, so that cut nodes are alike in size."""
    return sorted(range(64), key=lambda j: (abs(2 * sums[j] - n), j))


def _permuted(x: np.ndarray, order: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for place, bit in enumerate(order):
        out |= ((x >> np.uint64(bit)) & np.uint64(1)) << np.uint64(63 - place)
    return out


class _Forest:
    """Components over 0..n-1, kept as the smallest member of each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(root, np.maximum(a, b), low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        self.root = root

    def joined(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Whether all members from a0 to a1 and from b0 to b1 are of one component."""
        run = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])
        return (run[a0] == run[a1 - 1]) & (run[b0] == run[b1 - 1]) & (self.root[a0] == self.root[b0])


def _halves(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where, in each node x[lo:hi], the elements with bit ``depth`` set begin."""
    low = np.uint64(64 - depth)
    top = x[lo] >> low << low if depth else np.zeros(len(lo), np.uint64)
    return np.clip(np.searchsorted(x, top | np.uint64(1 << (63 - depth))), lo, hi)


def _pairs(a0, a1, b0, b1):
    """All (i, j) of each leaf pair, a bounded number at a time."""
    size = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + _AT_ONCE, side="right")))
        s = size[start:stop]
        which = np.repeat(np.arange(start, stop), s)
        k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        wide = (b1 - b0)[which]
        yield a0[which] + k // wide, b0[which] + k % wide
        start = stop


def trie_links(a: np.ndarray, b: np.ndarray | None, depth: int, err: int, budget: int, end: int = 64, done=None):
    """Walk the tries of sorted ``a`` and ``b`` (None: ``a`` with itself) together.

    Both are equal in their ``depth`` leading bits but for ``err`` of them, and have no
    bits after the first ``end``; equal members beyond that are halved by place. Yields
    arrays (i, j) of members within ``budget``; memory is bounded by ``_FRONTIER`` node
    pairs a level and ``_AT_ONCE`` pairs of members.
    ``done(a0, a1, b0, b1)`` says which pairs of nodes need no walk any more.
    """
    own = b is None
    b = a if own else b
    one = lambda v: np.array([v], np.int64)
    if not len(a) or not len(b):
        return
    stack = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(err), np.array([own]))]
    while stack:
        depth, a0, a1, b0, b1, e, same = stack.pop()
        while len(a0):
            if done is not None:
                left = ~done(a0, a1, b0, b1)
                a0, a1, b0, b1, e, same = (v[left] for v in (a0, a1, b0, b1, e, same))
            leaf = (a1 - a0) * (b1 - b0) <= _LEAF
            for i, j in _pairs(a0[leaf], a1[leaf], b0[leaf], b1[leaf]):
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                if own:
                    near &= i < j
                yield i[near], j[near]
            a0, a1, b0, b1, e, same = (v[~leaf] for v in (a0, a1, b0, b1, e, same))
            if not len(a0):
                break
            if depth < end:
                am, bm, far = _halves(a, a0, a1, depth), _halves(b, b0, b1, depth), e + 1
            else:
                am, bm, far = (a0 + a1) // 2, (b0 + b1) // 2, e
            parts = (
                (a0, am, b0, bm, e, same),
                (am, a1, bm, b1, e, same),
                (a0, am, bm, b1, far, np.zeros_like(same)),
                (am, a1, b0, bm, far, same),  # of a node with itself: the mirror of the third
            )
            a0, a1, b0, b1, e, same = (np.concatenate(v) for v in zip(*parts))
            mirror = np.zeros(len(a0), bool)
            mirror[3 * len(am) :] = same[3 * len(am) :]
            go = (a0 < a1) & (b0 < b1) & (e <= budget) & ~mirror
            a0, a1, b0, b1, e, same = (v[go] for v in (a0, a1, b0, b1, e, same))
            depth = min(depth + 1, end)
            while len(a0) > _FRONTIER:
                stack.append((depth, *(v[_FRONTIER:] for v in (a0, a1, b0, b1, e, same))))
                a0, a1, b0, b1, e, same = (v[:_FRONTIER] for v in (a0, a1, b0, b1, e, same))


def _cut_links(x: np.ndarray, p: int, q: int, depth: int, budget: int, end: int = 64, done=None):
    """Links among sorted ``x``: of the cut node ``p`` if ``q`` is the same, else between the two."""
    if p == q:
        yield from trie_links(x, None, depth, 0, budget, end, done)
    else:
        shift = int(np.searchsorted(x, np.uint64(max(p, q) << (64 - depth))))
        of_both = done and (lambda a0, a1, b0, b1: done(a0, a1, b0 + shift, b1 + shift))
        for i, j in trie_links(x[:shift], x[shift:], depth, (p ^ q).bit_count(), budget, end, of_both):
            yield i, j + shift


def _cut(rows: DataFrame, prefix: Column, depth: int, budget: int) -> DataFrame:
    """Each row once for every pair of cut nodes, ``p`` and ``q``, in which it may have links."""
    masks = [sum(1 << k for k in c) for r in range(budget + 1) for c in combinations(range(depth), r)]
    other = F.col("p").bitwiseXOR(F.col("mask"))
    held = rows.select("*", prefix.alias("p")).withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))))
    return held.select(*rows.columns, F.least("p", other).alias("p"), F.greatest("p", other).alias("q"))


def _group_forest(order: list[int], depth: int, budget: int):
    def forest(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        p, q = int(key[0]), int(key[1])
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        x = _permuted(fps, order)
        by = np.argsort(x)
        x, fps = x[by], fps[by]
        out = _Forest(len(x))
        for i, j in _cut_links(x, p, q, depth, budget):
            if len(i):
                out.link(i, j)
        child = np.flatnonzero(out.root != np.arange(len(x)))
        return pd.DataFrame({"u": fps[child].view(np.int64), "v": fps[out.root[child]].view(np.int64)})

    return forest


def _components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v), by rounds of hooking to the
    smallest neighbour and contracting; the driver sees one flag a round. Nodes are
    hashes, so a chain's order is a random one and rounds are logarithmic in its length."""
    label = None
    while True:
        edges = settle(edges, "links")
        if edges.isEmpty():
            return label if label is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.union(edges.select("v", "u"))
        hook = settle(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("up")), "hooks")
        high = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = settle(hook.join(high, "up").select("node", F.col("top").alias("up")), "jumps")
        if label is None:
            label = jump.select("node", F.col("up").alias("root"))
        else:
            to = jump.select(F.col("node").alias("root"), "up")
            label = label.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        label = settle(label, "labels")
        end = lambda c: jump.select(F.col("node").alias(c), F.col("up").alias(f"{c}2"))
        edges = (
            edges.join(end("u"), "u").join(end("v"), "v")
            .select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
            .filter("u <> v").distinct()
        )


def near_duplicates(docs: DataFrame, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, group_key) for every row of ``docs``.

    Null text counts as empty; rows without words share fingerprint zero and are
    linked by it like any others. Rows with a null doc_id are classed too, but no
    component takes its name from one (component_id is null if it has no other).
    Repeated doc_ids give a row each. Other columns of ``docs`` are not read.
    """
    schema = "doc_id long, fp long"
    marks = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, schema), "marks")
    nodes = settle(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    bit = lambda j: F.shiftrightunsigned("fp", j).bitwiseAND(F.lit(1).cast("long"))
    seen = nodes.agg(F.count(F.lit(1)).alias("n"), *(F.sum(bit(j)).alias(f"b{j}") for j in range(64))).first()
    n = seen["n"]
    order = _order([seen[f"b{j}"] or 0 for j in range(64)], n)
    depth = max(LEAST_DEPTH, (max(1, n) // NODE).bit_length())
    prefix = sum((F.shiftleft(bit(j), depth - 1 - k) for k, j in enumerate(order[:depth])), F.lit(0).cast("long"))
    held = _cut(nodes.select("fp"), prefix, depth, budget)
    edges = held.groupBy("p", "q").applyInPandas(_group_forest(order, depth, budget), "u long, v long")
    root = _components(edges.distinct())
    grouped = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("group_key"))
    names = grouped.groupBy("group_key").agg(F.min("least").alias("component_id"))
    named = settle(grouped.join(names, "group_key").select("fp", "group_key", "component_id"), "classes")
    return marks.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_key"
    )


def wide_fingerprint(h: np.ndarray) -> bytes:
    """Majority bits of the distinct hashes ``h`` and of keyed bijections of them, ``WORDS``
    times 64, twice as many for a few hashes. An even number of votes gets one more, of
    another hash in each word, so that every bit is as often 0 as 1. No hashes: empty."""
    if not len(h):
        return b""
    out = []
    for keys in _WIDE_KEYS[: 2 if len(h) <= FEW else 1]:
        ones = np.zeros((WORDS, 8, 8), np.int64)
        least = np.full(WORDS, np.iinfo(np.uint64).max, np.uint64)
        extra = np.zeros(WORDS, np.uint64)
        for k in range(0, len(h), 255):  # a lane of eight bits counts so far
            x = mix64(h[k : k + 255, None] ^ keys)
            for b in range(8):
                ones[:, b] += ((x >> np.uint64(b)) & _LANES).sum(axis=0).astype("<u8").view(np.uint8).reshape(-1, 8)
            if len(h) % 2 == 0:
                by = np.roll(x, 1, axis=1)
                at, word = by.argmin(axis=0), np.arange(WORDS)
                less = by[at, word] < least
                least, extra = np.where(less, by[at, word], least), np.where(less, x[at, word], extra)
        if len(h) % 2 == 0:
            for b in range(8):
                ones[:, b] += ((extra >> np.uint64(b)) & _LANES).astype("<u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(2 * ones.reshape(-1) > len(h) + (len(h) % 2 == 0)).tobytes())
    return b"".join(out)


def _windows(batches):
    """A row for each trie of each wide fingerprint: the trie's cell, and its 128 bits but for the cell's."""
    for ids, prints in arrow_rows(batches, "node", "wide"):
        for k in range(0, len(ids), 1 << 10):
            wide = b"".join(prints[k : k + (1 << 10)])
            n = [len(p) // (8 * WORDS) for p in prints[k : k + (1 << 10)]]
            nth = np.concatenate([np.arange(m) for m in n]) if n else np.zeros(0, np.int64)
            bits = np.unpackbits(np.frombuffer(wide, np.uint8).reshape(-1, 8 * WORDS), axis=1)
            words = np.packbits(bits[:, _WINDOWS], axis=2).view(">u8").astype(np.uint64).reshape(-1, 2)
            table = (nth[:, None] * TABLES + np.arange(TABLES)).reshape(-1).astype(np.uint64)
            cell = table << np.uint64(_KEY) | words[:, 0] >> np.uint64(64 - _KEY)
            node = np.repeat(np.array(ids[k : k + (1 << 10)], np.int64), np.array(n, np.int64) * TABLES)
            cols = [cell.astype(np.int32), (words[:, 0] << np.uint64(_KEY)).view(np.int64), words[:, 1].copy().view(np.int64), node]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["cell", "high", "low", "node"])


def _window_forest(depth: int, budget: int):
    beyond = np.uint64(64 - _WALKED)

    def forest(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        high, low = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low"))
        by = np.argsort(high)
        high, low, nodes = high[by], low[by], rows["node"].to_numpy(np.int64)[by]
        out = _Forest(len(by))

        def link(i, j):
            near = np.bitwise_count(high[i] ^ high[j]) + np.bitwise_count(low[i] ^ low[j]) <= _MOST
            if near.any():
                out.link(i[near], j[near])

        # neighbours in order first: where many texts are alike, that leaves few pairs to walk
        for k in range(1, min(len(by), _AHEAD + 1)):
            link(np.arange(len(by) - k), np.arange(k, len(by)))
        for i, j in _cut_links(high >> beyond << beyond, int(key[1]), int(key[2]), depth, budget, _WALKED, out.joined):
            link(i, j)
        child = np.flatnonzero(out.root != np.arange(len(by)))
        return pd.DataFrame({"u": nodes[child], "v": nodes[out.root[child]]})

    return forest


def alike(nodes: DataFrame, budget: int = 2) -> DataFrame:
    """(node, root) of every node of ``nodes`` (node long, wide) that a trie links to another.

    Two texts of Jaccard similarity 0.8 differ in 0.15 of their bits. In a trie they agree
    in the cell's 4 bits and are within 2 of the next 20 one time in five, so all 72
    miss them once in ten million; those of few shingles, whose bits differ up to 0.19,
    have 144 tries. Texts without a word in common agree so far, and in 128 bits, by
    chance once in ten billion pairs. More alike is for the caller to find out."""
    depth = max(0, (max(1, nodes.count()) >> _KEY) // WIDE_NODE).bit_length()
    held = nodes.mapInArrow(_windows, "cell int, high long, low long, node long")
    prefix = F.shiftrightunsigned("high", 64 - depth) if depth else F.lit(0).cast("long")
    edges = _cut(held, prefix, depth, budget).groupBy("cell", "p", "q").applyInPandas(_window_forest(depth, budget), "u long, v long")
    return _components(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct())
