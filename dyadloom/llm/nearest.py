"""Nearest vectors by cosine (vantage-point trees) and by inner product (ball trees).

Every vector goes to the nearest of a few coarse pivots, chosen from a bounded sample,
and a pivot with too many vectors is dealt to several shards by a hash of their ids. A
query first searches the shards of its own pivot. Its k-th score found there goes with
it: only shards whose vectors could beat it, by their distances from their pivot, are
visited after, and their trees start from that score. A task receives a shard as a
stream: first its vectors, of which it builds a tree, then the queries that come to it,
a batch at a time, so that memory holds one shard and one batch. What the shards find
meets in a top-k by query.

Trees answer a batch of queries together: at each node the queries that cannot gain
are left behind, the others go to the more promising child first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Vectors in a shard at most, on average, and for each pivot; the most pivots, the
#: sample that they are chosen from, and tasks wanted.
SHARD = 1 << 16
PER_PIVOT = 512
PIVOTS = 1024
SAMPLE = 8192
SHARDS = 48
LEAF = 48
#: How far bounds of distances are stretched by default: recall in the README.
FACTOR = 2.0
_QUERIES = 256


# --- trees -------------------------------------------------------------------------


@dataclass
class Node:
    rows: np.ndarray | None  # of a leaf
    left: Node | None = None
    right: Node | None = None
    point: np.ndarray | None = None  # vantage point, or centre of the ball
    left_range: tuple[float, float] = (0.0, 0.0)
    right_range: tuple[float, float] = (0.0, 0.0)
    radius: float = 0.0


def vantage_tree(x: np.ndarray, rows: np.ndarray) -> Node:
    """Rows nearer to the vantage point than the median go left. Halves are cut by
    rank, so equal vectors cannot make it deep."""
    if len(rows) <= LEAF:
        return Node(rows)
    centre = x[rows].mean(axis=0)
    point = x[rows[int(np.argmax(((x[rows] - centre) ** 2).sum(axis=1)))]]
    d = np.sqrt(((x[rows] - point) ** 2).sum(axis=1))
    order = np.argsort(d, kind="stable")
    half = len(rows) // 2
    near, far = order[:half], order[half:]
    return Node(
        None, vantage_tree(x, rows[near]), vantage_tree(x, rows[far]), point,
        (float(d[near].min()), float(d[near].max())), (float(d[far].min()), float(d[far].max())),
    )


def ball_tree(x: np.ndarray, rows: np.ndarray) -> Node:
    """Halves along the line between two far members; every node knows its ball."""
    own = x[rows]
    centre = own.mean(axis=0)
    d = np.sqrt(((own - centre) ** 2).sum(axis=1))
    node = Node(rows, point=centre, radius=float(d.max()) * (1 + 1e-9) + 1e-9)
    if len(rows) > LEAF:
        a = own[int(np.argmax(d))]
        b = own[int(np.argmax(((own - a) ** 2).sum(axis=1)))]
        order = np.argsort((own - a) @ (b - a), kind="stable")
        half = len(rows) // 2
        node.rows, node.left, node.right = None, ball_tree(x, rows[order[:half]]), ball_tree(x, rows[order[half:]])
    return node


class _Best:
    """The best k of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int, lowest):
        self.score = np.full((n, k), lowest)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[q], score], axis=1)
        i = np.concatenate([self.id[q], np.broadcast_to(ids, score.shape)], axis=1)
        i[s == s.dtype.type(_LOWEST[s.dtype.kind])] = np.iinfo(np.int64).max
        by = np.lexsort((i, -s), axis=-1)[:, : self.score.shape[1]]
        self.score[q], self.id[q] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)


_LOWEST = {"f": -np.inf, "i": -(2**62)}


class CosineShard:
    """Exact at factor 1; a larger factor stretches each lower bound before it is held
    against the current k-th distance, and so leaves more subtrees out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, factor: float):
        self.ids, self.factor, self.scored = ids, factor, 0
        self.x, self.norm = self._scaled(x)
        self.unit = self.x / self.norm[:, None]
        self.root = vantage_tree(self.unit, np.arange(len(ids)))

    @staticmethod
    def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By powers of two, which change no ratio, so that squares stay finite."""
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
        return x, np.sqrt((x * x).sum(axis=1))

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> _Best:
        q, norm = self._scaled(q)
        unit, best = q / norm[:, None], _Best(len(ids), k, -np.inf)

        def visit(node: Node, at: np.ndarray) -> None:
            if node.rows is not None:
                r = node.rows
                self.scored += len(at) * len(r)
                # the same sum, in the same order, for each pair: equal vectors tie exactly
                score = (q[at][:, None, :] * self.x[r][None, :, :]).sum(axis=2) / (norm[at][:, None] * self.norm[r][None, :])
                score[ids[at][:, None] == self.ids[r][None, :]] = -np.inf
                best.offer(at, score, self.ids[r])
                return
            d = np.sqrt(((unit[at] - node.point) ** 2).sum(axis=1))
            bounds = [np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi in (node.left_range, node.right_range)]
            children = (node.left, node.right)
            first = bounds[0] > bounds[1]  # right first
            first |= (bounds[0] == bounds[1]) & (np.abs(d - node.left_range[0]) > np.abs(d - node.right_range[1]))
            for child, mine in ((0, ~first), (1, first), (1, ~first), (0, first)):
                bar = np.maximum(best.score[at, -1], floor[at])
                worst = np.sqrt(np.maximum(0, 2 - 2 * np.clip(bar, -1, 1)))
                worst[bar == -np.inf] = np.inf
                go = mine & (bounds[child] * self.factor <= worst + 1e-7)
                if go.any():
                    visit(children[child], at[go])

        visit(self.root, np.arange(len(ids)))
        return best


class ProductShard:
    """Exact integer inner products; a node is left out where even its ball's best
    product is below both the k-th score of this shard and the shared one."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.scored = ids, x, 0
        self.wide = x.astype(np.float64)
        self.top = float(np.abs(self.wide).max(initial=0))
        self.root = ball_tree(self.wide, np.arange(len(ids)))

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> _Best:
        wide = q.astype(np.float64)
        length = np.sqrt((wide * wide).sum(axis=1))
        small = float(np.abs(wide).max(initial=0)) * self.top * q.shape[1] < 2.0**53  # then float products are exact
        best = _Best(len(ids), k, np.int64(_LOWEST["i"]))

        def bound(node: Node, at: np.ndarray) -> np.ndarray:
            top = wide[at] @ node.point + length[at] * node.radius
            return top + 1e-9 * (np.abs(top) + length[at] * (node.radius + 1)) + 1

        def visit(node: Node, at: np.ndarray, upper: np.ndarray) -> None:
            at = at[upper >= np.maximum(best.score[at, -1], floor[at])]
            if not len(at):
                return
            if node.rows is not None:
                r = node.rows
                self.scored += len(at) * len(r)
                score = (wide[at] @ self.wide[r].T).astype(np.int64) if small else q[at] @ self.x[r].T
                score[ids[at][:, None] == self.ids[r][None, :]] = _LOWEST["i"]
                best.offer(at, score, self.ids[r])
                return
            a, b = bound(node.left, at), bound(node.right, at)
            left = a >= b  # the larger bound first
            for child, mine, upper in ((node.left, left, a), (node.right, ~left, b), (node.right, left, b), (node.left, ~left, a)):
                if mine.any():
                    visit(child, at[mine], upper[mine])

        visit(self.root, np.arange(len(ids)), np.full(len(ids), np.inf))
        return best


# --- distribution -------------------------------------------------------------------


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _stream(make, k: int, kind: str):
    """Over rows ordered by (shard, query): yields the best k of each query in its shard."""
    out = pa.float64() if kind == "f" else pa.int64()

    def run(batches):
        shard = tree = None
        ids, parts = [], []
        for batch in batches:
            key, query = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vec_id, floor = batch.column(2).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(key, prepend=key[:1] - 1) != 0) | (np.diff(query, prepend=-1) != 0))
            for lo, hi in zip(cut, [*cut[1:], len(key)]):
                if key[lo] != shard:
                    shard, tree, ids, parts = key[lo], None, [], []
                if not query[lo]:
                    ids.append(vec_id[lo:hi])
                    parts.append(_matrix(batch.column(3).slice(lo, hi - lo)))
                    continue
                if tree is None and not ids:  # no vectors here
                    continue
                if tree is None:
                    tree, ids, parts = make(np.concatenate(ids), np.concatenate(parts)), [], []
                for start in range(lo, hi, _QUERIES):
                    stop = min(hi, start + _QUERIES)
                    q_id, q = vec_id[start:stop], _matrix(batch.column(3).slice(start, stop - start))
                    best = tree.search(q_id, q, k, floor[start:stop])
                    real = best.score > (_LOWEST[kind] if kind == "i" else -np.inf)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(q_id, k)[real.ravel()]), pa.array(best.id[real]), pa.array(best.score[real], out)], ["query_id", "vec_id", "score"]
                    )

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T))


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of a sample: the first ones far apart, then moved to the middle of
    what is nearest to them. Fewer, if the sample has fewer different vectors."""
    picked, far = [0], _distances(x, x[:1])[:, 0]
    while len(picked) < min(n, len(x)) and far.max() > 1e-9:
        picked.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[picked[-1:]])[:, 0])
    p = x[picked].copy()
    for _ in range(4):
        own = _distances(x, p).argmin(axis=1)
        for k in np.unique(own):
            p[k] = x[own == k].mean(axis=0)
    return p


def _placed(valid: DataFrame, n: int, place) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(dim, pivot, far, vec_id, vec) of every vector, and the pivots by dimension.
    ``place`` maps vectors to where distances are taken."""
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow().column(0).to_pylist()
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    share = n / max(1, len(sample))
    pivots = {d: choose_pivots(place(np.array(v, np.float64)), int(np.clip(len(v) * share // PER_PIVOT, 1, PIVOTS))) for d, v in by_dim.items()}

    def run(batches):
        for batch in batches:
            vecs = batch.column(1)
            sizes = vecs.value_lengths().to_numpy()
            pivot, far = np.zeros(len(sizes), np.int64), np.full(len(sizes), np.inf)
            for d in np.unique(sizes):
                if int(d) in pivots:
                    at = np.flatnonzero(sizes == d)
                    x = _matrix(vecs.take(pa.array(at))).astype(np.float64)
                    gap = _distances(place(x), pivots[int(d)])
                    pivot[at] = gap.argmin(axis=1)
                    far[at] = gap.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int64)), pa.array(pivot), pa.array(far), batch.column(0), vecs], ["dim", "pivot", "far", "vec_id", "vec"])

    kind = dict(valid.dtypes)["vec"]
    return settle(valid.mapInArrow(run, f"dim long, pivot long, far double, vec_id long, vec {kind}"), "placed"), pivots


def _searched(valid: DataFrame, k: int, every: int, kind: str, make, place, reach) -> DataFrame:
    """The best k of each query. ``reach(q, pivots, far, bar)`` says which pivots' vectors,
    none farther from it than ``far``, may do as well as ``bar``: [queries, pivots]."""
    placed, pivots = _placed(valid, valid.count(), place)
    seen = placed.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"))
    balls = {(r["dim"], r["pivot"]): (-(-r["n"] // SHARD), r["far"]) for r in seen.collect()}  # a row a pivot
    spark = valid.sparkSession
    dealt = spark.createDataFrame([(d, p, n) for (d, p), (n, _) in balls.items()], "dim long, pivot long, shards long")
    tasks = max(SHARDS, sum(n for n, _ in balls.values()) // 16)
    score = "double" if kind == "f" else "long"
    none = F.lit(float("-inf")) if kind == "f" else F.lit(_LOWEST["i"]).cast("long")
    shard = lambda salt: F.col("dim") * (1 << 40) + F.col("pivot") * (1 << 24) + salt
    vectors = placed.join(dealt, ["dim", "pivot"]).select(shard(F.pmod(F.xxhash64("vec_id"), "shards")).alias("shard"), F.lit(0).alias("query"), "vec_id", "vec", none.alias("floor"))
    asked = placed.filter(F.col("vec_id") % every == 0)
    to_all = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))

    def search(queries: DataFrame) -> DataFrame:
        rows = vectors.unionByName(queries).repartition(tasks, "shard").sortWithinPartitions("shard", "query", "vec_id")
        return rows.mapInArrow(_stream(make, k, kind), f"query_id long, vec_id long, score {score}")

    home = asked.join(dealt, ["dim", "pivot"]).withColumn("salt", to_all)
    near = settle(search(home.select(shard(F.col("salt")).alias("shard"), F.lit(1).alias("query"), "vec_id", "vec", none.alias("floor"))), "home")
    bars = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).filter(F.size("s") >= k).select("query_id", F.element_at("s", k).alias("bar"))

    def route(batches):
        for batch in batches:
            dim, home, vec_id, vecs = (batch.column(c) for c in range(4))
            dim, home, bar = dim.to_numpy(), home.to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            for d in np.unique(dim):
                if int(d) not in pivots:
                    continue  # one pivot, searched already
                at = np.flatnonzero(dim == d)
                far = np.array([balls.get((int(d), p), (0, -1.0))[1] for p in range(len(pivots[int(d)]))])
                own = vecs.take(pa.array(at))
                go = reach(_matrix(own).astype(np.float64), pivots[int(d)], far, bar[at]) & (far >= 0)[None, :]
                go[np.arange(len(at)), home[at]] = False
                q, p = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), d)), pa.array(p), vec_id.take(pa.array(at[q])), own.take(pa.array(q)), pa.array(bar[at[q]])], ["dim", "pivot", "vec_id", "vec", "floor"])

    kind_of = dict(valid.dtypes)["vec"]
    barred = asked.join(bars, asked["vec_id"] == bars["query_id"], "left").select("dim", "pivot", "vec_id", "vec", F.coalesce("bar", none).alias("floor"))
    sent = barred.mapInArrow(route, f"dim long, pivot long, vec_id long, vec {kind_of}, floor {score}").join(dealt, ["dim", "pivot"]).withColumn("salt", to_all)
    more = search(sent.select(shard(F.col("salt")).alias("shard"), F.lit(1).alias("query"), "vec_id", "vec", "floor"))
    return _ranked(near.unionByName(more), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _valid(vectors: DataFrame, kind: str, some: bool) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("x") > 0))
    if some:
        out = out.filter(F.exists("x", lambda v: v != 0))
    return out.select("vec_id", (F.transform("x", lambda v: F.floor(v * 256)) if kind == "i" else F.col("x")).alias("vec"))


def _cosine_reach(factor: float):
    def reach(q, pivots, far, bar):
        # a vector lies in its pivot's ball, and no nearer to another pivot than to its own
        d = _distances(_unit(q), pivots)
        bound = np.maximum(d - far[None, :], (d - d.min(axis=1, keepdims=True)) / 2)
        worst = np.where(np.isneginf(bar), np.inf, np.sqrt(np.maximum(0, 2 - 2 * np.clip(bar, -1, 1))))
        return bound * factor <= worst[:, None] + 1e-7

    return reach


def _product_reach(q, pivots, far, bar):
    length = np.sqrt((q * q).sum(axis=1))[:, None]
    top = q @ pivots.T + length * far[None, :]
    return top + 1e-9 * (np.abs(top) + length * (far[None, :] + 1)) + 1 >= bar[:, None]


def nearest_by_cosine(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` the k
    nearest others, score being the cosine of the original vectors.

    Left out: null ids, and vectors null, empty, zero or with null or non-finite
    components. Only vectors of the query's dimension are candidates. Every row is
    indexed; rows with the query's vec_id are not its candidates, and rows that repeat a
    query's vec_id ask together. Ties go to the smaller vec_id. A factor of 1 makes the
    search exact; above, shards and subtrees are left out sooner. An empty table, or one
    without queries, gives no rows.
    """
    valid = _valid(vectors, "f", True)
    return _searched(valid, k, every, "f", lambda i, x: CosineShard(i, x, factor), _unit, _cosine_reach(factor))


def top_by_product(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` the k
    largest inner products of floor(256 x) with the others, exactly.

    Rows are left out, repeated and tied as in ``nearest_by_cosine``, but zero vectors
    take part. Scores must fit in a long. An empty table gives no rows.
    """
    valid = _valid(vectors, "i", False)
    return _searched(valid, k, every, "i", ProductShard, lambda x: x, _product_reach)
