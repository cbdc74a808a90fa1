"""Graph measures of pathway slices (pathway_name, src, tgt, prob)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def degrees(netp: DataFrame) -> DataFrame:
    """(pathway_name, grp, outdeg_unweighted, indeg_unweighted, outdeg, indeg); a loop
    counts once on either side."""
    live = netp.filter("prob > 0")
    ends = live.select("pathway_name", F.col("src").alias("grp"), F.col("prob").alias("o"), F.lit(None).cast("double").alias("i")).unionAll(live.select("pathway_name", F.col("tgt").alias("grp"), F.lit(None).cast("double"), F.col("prob")))
    return ends.groupBy("pathway_name", "grp").agg(
        F.count("o").alias("outdeg_unweighted"), F.count("i").alias("indeg_unweighted"),
        F.coalesce(F.sum("o"), F.lit(0.0)).alias("outdeg"), F.coalesce(F.sum("i"), F.lit(0.0)).alias("indeg"),
    )


def _matrix(rows: pd.DataFrame) -> tuple[list, np.ndarray]:
    names = sorted({*rows["src"], *rows["tgt"]})
    at = {g: k for k, g in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    m[rows["src"].map(at), rows["tgt"].map(at)] = rows["prob"]
    return names, m


def _shortest_counts(m: np.ndarray, s: int, eps: float = 1e-10):
    """Distances, numbers of shortest paths, predecessors and order, by costs 1 / weight."""
    n = len(m)
    dist, paths, before, order = np.full(n, np.inf), np.zeros(n), [[] for _ in range(n)], []
    dist[s], paths[s], queue, done = 0, 1, [(0.0, s)], set()
    while queue:
        d, v = heapq.heappop(queue)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for w in np.flatnonzero(m[v] > 0):
            if w == v:
                continue
            alt = d + 1 / m[v, w]
            if alt < dist[w] - eps:
                dist[w], paths[w], before[w] = alt, paths[v], [v]
                heapq.heappush(queue, (alt, int(w)))
            elif abs(alt - dist[w]) <= eps and w not in done:
                paths[w] += paths[v]
                before[w].append(v)
    return paths, before, order


def betweenness(m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(m))
    for s in range(len(m)):
        paths, before, order = _shortest_counts(m, s)
        share = np.zeros(len(m))
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    return out


def _power(m: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Leading eigenvector of a non-negative matrix, its largest entry 1."""
    v = np.ones(len(m))
    shifted = m + np.eye(len(m)) * (m.max() if m.size else 0)  # same vectors, no oscillation
    for _ in range(rounds):
        w = shifted @ v
        top = w.max()
        if top <= 0:
            return np.zeros(len(m))
        if np.abs(w / top - v).max() < 1e-13:
            break
        v = w / top
    return v


def page_rank(m: np.ndarray, damping: float = 0.85) -> np.ndarray:
    n, out = len(m), m.sum(axis=1)
    step = np.where(out[:, None] > 0, m / np.where(out > 0, out, 1)[:, None], 1 / n)
    return np.linalg.solve(np.eye(n) - damping * step.T, np.full(n, (1 - damping) / n))


def information(m: np.ndarray) -> np.ndarray:
    """Information centrality of the symmetrised graph; zeros where it falls apart."""
    a = (m + m.T) / 2
    np.fill_diagonal(a, 0)
    n = len(a)
    inverse = np.linalg.pinv(np.diag(a.sum(axis=1)) - a + 1)
    d = np.diag(inverse)
    bottom = n * d + d.sum() - 2 * inverse.sum(axis=1)
    return np.where(bottom > 1e-12, n / np.where(bottom > 1e-12, bottom, 1), 0) if (a.sum(axis=1) > 0).all() else np.zeros(n)


def max_flow(m: np.ndarray, s: int, t: int) -> float:
    left, total = m.copy(), 0.0
    while True:
        back, queue = {s: s}, [s]
        for v in queue:
            for w in np.flatnonzero(left[v] > 1e-12):
                if int(w) not in back:
                    back[int(w)] = v
                    queue.append(int(w))
        if t not in back:
            return total
        path, v = [], t
        while v != s:
            path.append((back[v], v))
            v = back[v]
        most = min(left[a, b] for a, b in path)
        for a, b in path:
            left[a, b] -= most
            left[b, a] += most
        total += most


def flow_betweenness(m: np.ndarray) -> np.ndarray:
    """Flow between all others that is lost without a node."""
    n, m = len(m), m - np.diag(np.diag(m))
    out = np.zeros(n)
    for v in range(n):
        without = m.copy()
        without[v], without[:, v] = 0, 0
        out[v] = sum(max_flow(m, s, t) - max_flow(without, s, t) for s in range(n) for t in range(n) if len({s, t, v}) == 3)
    return out


MEASURES = ("outdeg_unweighted", "indeg_unweighted", "outdeg", "indeg", "hub", "authority", "eigen", "page_rank", "betweenness", "flowbet", "info")


def centrality(netp: DataFrame, thresh: float | None = None) -> DataFrame:
    """(pathway_name, grp, measure, value) of all eleven measures; a slice, groups by
    groups, is one task's matrix. ``thresh`` needs p-values: strengths at or above it go."""
    if thresh is not None:
        netp = netp.withColumn("prob", F.when(F.col("pval") >= thresh, 0.0).otherwise(F.col("prob")))
    schema = f"pathway_name string, grp {dict(netp.dtypes)['src']}, measure string, value double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = _matrix(rows)
        if np.isnan(m).any() or (m < 0).any():
            raise ValueError("a strength is missing or negative")
        live = m > 0
        values = (live.sum(axis=1), live.sum(axis=0), m.sum(axis=1), m.sum(axis=0), _power(m @ m.T), _power(m.T @ m), _power(m.T), page_rank(m), betweenness(m), flow_betweenness(m), information(m))
        return pd.DataFrame([(rows["pathway_name"].iloc[0], g, k, float(v[i])) for k, v in zip(MEASURES, values) for i, g in enumerate(names)], columns=["pathway_name", "grp", "measure", "value"])

    return netp.select("pathway_name", "src", "tgt", "prob").groupBy("pathway_name").applyInPandas(run, schema)


def role_changes(one: DataFrame, two: DataFrame) -> DataFrame:
    """(pathway_name, grp, outgoing, incoming, class): second dataset's strengths minus
    the first's, and what is specific to either or shared by both."""
    sides = [degrees(d).select("pathway_name", "grp", F.col("outdeg").alias(f"o{k}"), F.col("indeg").alias(f"i{k}")) for k, d in enumerate((one, two))]
    both = sides[0].join(sides[1], ["pathway_name", "grp"], "full").na.fill(0.0)
    has = lambda k: (F.col(f"o{k}") + F.col(f"i{k}")) > 0
    kind = F.when(has(0) & has(1), "shared").when(has(1), "second").when(has(0), "first").otherwise("neither")
    return both.select("pathway_name", "grp", (F.col("o1") - F.col("o0")).alias("outgoing"), (F.col("i1") - F.col("i0")).alias("incoming"), kind.alias("class"))


def signaling_roles(netp: DataFrame) -> DataFrame:
    """(pathway_name, grp, outgoing, incoming), each over its pathway's largest."""
    d = degrees(netp)
    by = Window.partitionBy("pathway_name")
    return d.select("pathway_name", "grp", (F.col("outdeg") / F.max("outdeg").over(by)).alias("outgoing"), (F.col("indeg") / F.max("indeg").over(by)).alias("incoming"))


def role_scatter(netp: DataFrame) -> DataFrame:
    """(grp, x, y, n): strength out and in over all pathways, and links, loops once."""
    live = netp.filter("prob > 0")
    loops = live.filter("src = tgt").groupBy(F.col("src").alias("grp")).agg(F.count(F.lit(1)).alias("loops"))
    d = degrees(netp).groupBy("grp").agg(F.sum("outdeg").alias("x"), F.sum("indeg").alias("y"), F.sum(F.col("outdeg_unweighted") + F.col("indeg_unweighted")).alias("n"))
    return d.join(loops, "grp", "left").select("grp", "x", "y", (F.col("n") - F.coalesce("loops", F.lit(0))).alias("n"))


def _strong(netp: DataFrame, thresh: float | None) -> DataFrame:
    """Strengths, without those below the quantile ``thresh`` of all of them."""
    live = netp.filter("prob > 0")
    if thresh is None:
        return live
    bar = live.agg(F.expr(f"percentile(prob, {float(thresh)})").alias("bar")).first()["bar"]
    return live.filter(F.col("prob") >= bar)


def functional_similarity(netp: DataFrame, k: int | None = None, thresh: float | None = None) -> DataFrame:
    """(a, b, value): shared pairs of two pathways over all pairs of either, times what
    they share of their ``k`` nearest pathways; rows without any are left out."""
    live = _strong(netp, thresh).select("pathway_name", "src", "tgt")
    size = live.groupBy("pathway_name").agg(F.count(F.lit(1)).alias("n"))
    left, right = live.withColumnRenamed("pathway_name", "a"), live.withColumnRenamed("pathway_name", "b")
    common = left.join(right, ["src", "tgt"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    sized = common.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return _shared_neighbours(sized.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("value")), k)


def neighbour_shares(m: np.ndarray, k: int, prune: float = 1 / 15) -> np.ndarray:
    """Shares of common neighbours, a node and its k - 1 nearest rows, ties to the first."""
    n = len(m)
    d = np.round(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2), 9)
    np.fill_diagonal(d, -1)
    near = np.zeros((n, n), int)
    for i in range(n):
        near[i, np.argsort(d[i], kind="stable")[:k]] = 1
    o = near @ near.T
    w = o / np.maximum(2 * k - o, 1)
    w[w < prune] = 0
    np.fill_diagonal(w, 1)
    return w


def _shared_neighbours(similarity: DataFrame, k: int | None) -> DataFrame:
    """``similarity`` (a, b, value) times the shares of common neighbours. The matrix of
    pathways by pathways, a result, is one task's."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["a"], *rows["b"]})
        at = {n: i for i, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        m[rows["a"].map(at), rows["b"].map(at)] = rows["value"]
        np.fill_diagonal(m, 1)
        own = k or math.ceil(math.sqrt(len(names))) + (len(names) > 25)
        m = m * neighbour_shares(m, own)
        return pd.DataFrame([(a, b, float(m[at[a], at[b]])) for a in names for b in names if m[at[a], at[b]] > 0], columns=["a", "b", "value"])

    return similarity.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "a string, b string, value double")


def similarity_between(netp: DataFrame, kind: str = "functional", k: int | None = None) -> DataFrame:
    """(a, b, value) between the pathways of all datasets, named pathway--dataset."""
    named = netp.withColumn("pathway_name", F.concat_ws("--", "pathway_name", F.col("dataset").cast("string")))
    return functional_similarity(named, k) if kind == "functional" else structural_similarity(named, k)


def rank_similarity(places: DataFrame, first=0, second=1) -> DataFrame:
    """(pathway_name, distance) between a pathway's ``dims`` in two datasets."""
    one, two = (places.filter(F.col("dataset") == k).select("pathway_name", F.col("dims").alias(n)) for k, n in ((first, "p"), (second, "q")))
    squares = F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return one.join(two, "pathway_name").select("pathway_name", F.sqrt(squares).alias("distance"))


def snn(neighbours: DataFrame, k: int, prune: float = 1 / 15) -> DataFrame:
    """(i, j, w) of (node, neighbour), k of them a node and itself among them."""
    a, b = neighbours.select(F.col("node").alias("i"), "neighbour"), neighbours.select(F.col("node").alias("j"), "neighbour")
    shared = a.join(b, "neighbour").groupBy("i", "j").agg(F.count(F.lit(1)).alias("o"))
    w = F.col("o") / (2 * k - F.col("o"))
    return shared.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).when(w < prune, 0.0).otherwise(w).alias("w")).filter("w > 0")


def _distance_rows(m: np.ndarray) -> np.ndarray:
    """Share of nodes at each number of steps, unreachable last, a row a node."""
    n = len(m)
    reach, step = np.full((n, n), n), (m > 0).astype(int)
    now, seen = np.eye(n, dtype=bool), np.eye(n, dtype=bool)
    for d in range(1, n):
        now = (now @ step > 0) & ~seen
        reach[now] = d
        seen |= now
    return np.stack([(reach == d).sum(axis=1) for d in range(1, n + 1)], axis=1) / max(1, n - 1)


def _js(p: np.ndarray, q: np.ndarray) -> float:
    h = lambda x: -sum(v * np.log(v) for v in x if v > 0)
    return max(0.0, h((p + q) / 2) - (h(p) + h(q)) / 2)


def structural_distance(a: np.ndarray, b: np.ndarray, w=(0.45, 0.45, 0.1)) -> float:
    """Differences of distance distributions, of node dispersion, and of centrality, in
    the graphs and, for the last, their complements."""

    def profile(m):
        p = _distance_rows(m)
        mean = p.mean(axis=0)
        spread = np.mean([_js(r, mean) for r in p])
        return mean, spread / np.log(max(2, (p.sum(axis=0) > 0).sum() + 1))

    def alpha(m):
        n = len(m)
        open_ = m - np.diag(np.diag(m))  # loops do not carry centrality on; with them a whole graph has no solution
        x = np.linalg.solve(np.eye(n) - open_.T / n, (m > 0).sum(axis=1) / max(1, n - 1)) / n**2
        x = np.sort(x)
        return np.append(x, max(0.0, 1 - x.sum()))

    (ma, da), (mb, db) = profile(a), profile(b)
    full = lambda m: (m <= 0).astype(float) - np.eye(len(m)) * (np.diag(m) <= 0)
    third = sum(np.sqrt(_js(alpha((x > 0).astype(float)), alpha((y > 0).astype(float))) / np.log(2)) / 2 for x, y in ((a, b), (full(a), full(b))))
    return float(w[0] * np.sqrt(_js(ma, mb) / np.log(2)) + w[1] * abs(np.sqrt(da) - np.sqrt(db)) + w[2] * third)


def structural_similarity(netp: DataFrame, k: int | None = None, thresh: float | None = None) -> DataFrame:
    """(a, b, value): 1 - structural distance of pairs of pathways, times what they share
    of their ``k`` nearest pathways. A pathway is one row, packed; pairs, as many as
    pathways squared, are dealt out and compared one by one."""
    groups = [r.g for r in netp.select(F.col("src").alias("g")).union(netp.select("tgt")).distinct().orderBy("g").collect()]
    at, n = {g: i for i, g in enumerate(groups)}, len(groups)
    packed = _strong(netp, thresh).groupBy("pathway_name").agg(F.collect_list(F.struct("src", "tgt")).alias("edges"))
    rows = sorted(((r["pathway_name"], [(at[e["src"]], at[e["tgt"]]) for e in r["edges"]]) for r in packed.collect()), key=lambda r: r[0])  # a row a pathway

    def run(batches):
        mats = {}
        for name, edges in rows:
            m = np.zeros((n, n))
            for i, j in edges:
                m[i, j] = 1.0
            mats[name] = m
        for batch in batches:
            a, b = batch["a"], batch["b"]
            yield pd.DataFrame({"a": a, "b": b, "value": [1 - structural_distance(mats[x], mats[y]) for x, y in zip(a, b)]})

    names = [r[0] for r in rows]
    spark = netp.sparkSession
    if not names:
        return spark.createDataFrame([], "a string, b string, value double")
    pairs = spark.createDataFrame([(x,) for x in names], "a string").select("a", F.explode(F.array(*map(F.lit, names))).alias("b")).filter("a < b")
    half = pairs.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "a string, b string, value double")
    whole = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).unionByName(spark.createDataFrame([(x, x, 1.0) for x in names], "a string, b string, value double"))
    return _shared_neighbours(whole, k)
