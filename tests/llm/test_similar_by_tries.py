"""The near-duplicate stage gets its candidates from tries over SimHash bits, and from nowhere else."""

import random

import numpy as np
import pandas as pd

from dyadloom.llm import queries, simhash, similar

DOCS = "doc_id long, text string"


def _pairs(rng, sizes):
    """Texts whose shingles are as far apart as 0.8 allows: of the same length, or one with more."""
    new = lambda n: [f"w{rng.random()}" for _ in range(n)]
    out = []
    for n in sizes:
        for first, more in ((0, n // 4), (n // 9, n // 9)):
            words = new(n + 4)
            out.append((" ".join(words), " ".join(words[first:] + new(more))))
    return out


def _jaccard(a, b):
    a, b = set(similar.shingles(a).tolist()), set(similar.shingles(b).tolist())
    return len(a & b) / len(a | b)


def test_tries_find_all_near_pairs_and_few_others(spark):
    rng = random.Random(5)
    pairs = [p for p in _pairs(rng, [4, 8, 9, 18, 31, 32, 33, 36, 60, 90, 255, 256, 400] * 12) if _jaccard(*p) >= 0.8]
    assert len(pairs) > 250 and min(_jaccard(*p) for p in pairs) == 0.8
    rows = [(k, simhash.wide_fingerprint(similar.shingles(t))) for k, t in enumerate(t for p in pairs for t in p)]
    found = simhash.alike(spark.createDataFrame(rows, "node long, wide binary")).collect()
    root = {r.node: r.root for r in found}
    assert all(root.get(2 * k, -1) == root.get(2 * k + 1, -2) for k in range(len(pairs)))
    assert len(set(root.values())) == len(pairs)  # no text is linked to one of another pair


def test_cut_tries_find_the_same(spark, monkeypatch):
    rng = random.Random(6)
    texts = [t for p in _pairs(rng, [9, 40, 90] * 40) for t in p]
    nodes = spark.createDataFrame([(k, simhash.wide_fingerprint(similar.shingles(t))) for k, t in enumerate(texts)], "node long, wide binary")
    whole = {tuple(r) for r in simhash.alike(nodes).collect()}
    monkeypatch.setattr(simhash, "WIDE_NODE", 4)
    assert whole and {tuple(r) for r in simhash.alike(nodes).collect()} == whole


def test_votes_are_majorities():
    h = np.random.default_rng(2).integers(0, 1 << 63, 511, np.uint64)
    x = simhash.mix64(h[:, None] ^ simhash._WIDE_KEYS[0])
    ones = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(511, -1, 8), axis=2, bitorder="little").sum(axis=0).reshape(-1, 8, 8)
    got = np.unpackbits(np.frombuffer(simhash.wide_fingerprint(h), np.uint8)).reshape(-1, 8, 8)
    assert (got.transpose(0, 2, 1) == (2 * ones > 511)).all()
    assert simhash.wide_fingerprint(h[:0]) == b""


def test_stage_links_by_tries_alone(spark, monkeypatch):
    words = [f"w{k}" for k in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words)), (4, "x y z")], DOCS)
    assert sorted(r.doc_id for r in queries.keep_one_of_each(spark, docs, "").collect()) == [1, 4]
    none = spark.createDataFrame([], "node long, root long")
    monkeypatch.setattr(simhash, "alike", lambda nodes: none)
    assert sorted(r.doc_id for r in queries.keep_one_of_each(spark, docs, "").collect()) == [1, 2, 4]


def test_equal_members_are_walked_in_bounded_steps():
    x = np.repeat(np.array([5, 9], np.uint64) << np.uint64(44), [3000, 40])
    sizes, seen = [], 0
    pairs = np.zeros((len(x), len(x)), bool)
    for i, j in simhash.trie_links(x, None, 0, 0, 1, 20):
        sizes.append(len(i))
        pairs[i, j] = True
        seen += len(i)
    assert max(sizes) <= 1 << 21 and seen == pairs.sum() == 3000 * 2999 // 2 + 40 * 39 // 2


def test_cells_of_many_near_copies_lose_no_link():
    rng = np.random.default_rng(4)
    base = rng.random((3, 128)) < 0.5
    near = [base[k] ^ (rng.random((400, 128)) < f) for k, f in enumerate((0.03, 0.08, 0.14))]
    words = np.packbits(np.concatenate([*near, rng.random((800, 128)) < 0.5]), axis=1).view(">u8").astype(np.uint64)
    high, low = words[:, 0], words[:, 1].copy()
    rows = {"high": high.view(np.int64), "low": low.view(np.int64), "node": np.arange(len(high))}
    links = simhash._window_forest(0, 2)((0, 0, 0), pd.DataFrame(rows))
    forest = simhash._Forest(len(high))
    forest.link(links["u"].to_numpy(), links["v"].to_numpy())
    far = np.bitwise_count(high[:, None] ^ high) + np.bitwise_count(low[:, None] ^ low)
    walked = np.bitwise_count((high[:, None] ^ high) >> np.uint64(44))
    i, j = np.nonzero((walked <= 2) & (far <= 32))
    assert len(i) > 50_000 and (forest.root[i] == forest.root[j]).all()
    assert len(links) == len(high) - len(np.unique(forest.root))
    most = simhash._Forest(len(high))
    most.link(*np.nonzero(far <= 32))
    assert (most.root[links["u"]] == most.root[links["v"]]).all()  # nothing further apart is linked
