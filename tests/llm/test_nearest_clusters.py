"""The registered searches: recall at the registered factor, and work that clusters save."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from dyadloom.llm import nearest, queries

SF = "/root/testdata/sf0.1"


def plain(ids, x, k=5, every=50, product=False):
    out = {}
    y = np.floor(x * 256) if product else x / np.sqrt((x * x).sum(axis=1))[:, None]
    for i in np.flatnonzero(ids % every == 0):
        score = y @ y[i]
        score[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -score))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.fixture(scope="module")
def vectors():
    t = pq.read_table(f"{SF}/embeddings.parquet")
    return t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)


def test_registered_factor_finds_nine_of_ten(spark, vectors):
    want, got = plain(*vectors), {}
    for r in queries.op2_vantage_search(spark, SF).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    found = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        exact = dict(want[q])
        found += len({r.vec_id for r in rows} & set(exact))
        assert all(r.score == pytest.approx(exact[r.vec_id], abs=1e-12) for r in rows if r.vec_id in exact)
    assert found >= 0.95 * 5 * len(want)


def test_registered_products_are_exact(spark, vectors):
    want = plain(*vectors, product=True)
    got = {}
    for r in queries.op8_ball_tree(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [(i, int(s)) for i, s in w] for q, w in want.items()} == {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def _scored(n, clusters=40, k=5):
    """Recall, and pairs scored for each query, of a search as the operator routes it."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, 32))
    ids, unit = np.arange(n), x / np.sqrt((x * x).sum(axis=1))[:, None]
    pivots = nearest.choose_pivots(unit[:: max(1, n // nearest.SAMPLE)], max(1, n // nearest.PER_PIVOT))
    d = nearest._distances(unit, pivots)
    own = d.argmin(axis=1)
    far = np.array([d[own == p, p].max() if (own == p).any() else -1 for p in range(len(pivots))])
    shards = {p: nearest.CosineShard(ids[own == p], x[own == p], nearest.FACTOR) for p in range(len(pivots)) if (own == p).any()}
    want, hits = plain(ids, x, k), 0
    for q in want:
        row, none = x[q : q + 1], np.array([-np.inf])
        home = shards[own[q]].search(ids[q : q + 1], row, k, none)
        bar = home.score[0, -1:]
        found = list(zip(-home.score[0], home.id[0]))
        go = nearest._cosine_reach(nearest.FACTOR)(row, pivots, far, bar)[0]
        go[own[q]] = False
        for p in np.flatnonzero(go):
            if p in shards:
                more = shards[p].search(ids[q : q + 1], row, k, bar)
                found += list(zip(-more.score[0], more.id[0]))
        hits += len({int(i) for _, i in sorted(found)[:k]} & {i for i, _ in want[q]})
    return hits / (k * len(want)), sum(s.scored for s in shards.values()) / len(want)


def test_clusters_are_left_out():
    (recall, few), (again, many) = _scored(4000), _scored(32_000)
    assert recall >= 0.95 and again >= 0.95
    assert few < 0.2 * 4000 and many < 4 * few  # eight times the vectors


def test_repeated_rows_and_hard_ones(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (None, [1.0, 0.0]), (50, [1.0, 0.0]), (6, [1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnsRenamed({})
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest.nearest_by_cosine(df).collect())
    assert got == [(0, 1, 50), (0, 2, 1), (0, 3, 1), (50, 1, 0), (50, 2, 1), (50, 3, 1)]
    assert [(r.vec_id, r.score) for r in nearest.top_by_product(df).filter("query_id = 0").orderBy("rank").collect()] == [(1, 65536), (50, 65536), (1, 0), (3, 0)]
    empty = df.limit(0)
    assert nearest.nearest_by_cosine(empty).count() == 0 == nearest.top_by_product(empty).count()
