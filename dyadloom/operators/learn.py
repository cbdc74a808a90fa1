"""Patterns, clusters, smoothing and components of small result matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import written

#: Genes of a network whose inverse is made at once (32 MB).
NETWORK = 2000
#: Rows up to which a matrix is collected: groups times pathways of a result, not of cells.
MATRIX_ROWS = 1_000_000


def role_matrix(netp: DataFrame, side: str = "src") -> DataFrame:
    """(grp, pathway_name, value): strength out (src) or in (tgt), over each pathway's
    largest; groups without any are left out."""
    sums = netp.groupBy(F.col(side).alias("grp"), "pathway_name").agg(F.sum("prob").alias("value"))
    scaled = sums.withColumn("value", F.col("value") / F.max("value").over(Window.partitionBy("pathway_name")))
    return scaled.withColumn("s", F.sum("value").over(Window.partitionBy("grp"))).filter("s > 0").drop("s")


def _collected(df: DataFrame) -> pd.DataFrame:
    n = df.count()
    if n > MATRIX_ROWS:
        raise ValueError(f"a matrix of {n} rows is too large for the driver")
    return df.toPandas()


def start_of(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative starting factors from the singular vectors: of each pair of vectors
    the positive or the negative parts, whichever have the larger product of lengths."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((x.shape[0], k)), np.zeros((k, x.shape[1]))
    for p in range(min(k, len(s))):
        best = (0.0, np.abs(u[:, 0]) * 0, np.abs(vt[0]) * 0)
        for sign in (1, -1):
            a, b = np.maximum(sign * u[:, p], 0), np.maximum(sign * vt[p], 0)
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            if na * nb > best[0] + 1e-12:
                best = (na * nb, a / na, b / nb)
        w[:, p], h[p] = np.sqrt(s[p] * best[0]) * best[1], np.sqrt(s[p] * best[0]) * best[2]
    return w, h


def factorize(x: np.ndarray, k: int, rounds: int = 2000, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors by multiplicative updates of the Euclidean distance, from the
    singular vectors, or from a random start if ``rng`` is given."""
    w, h = start_of(x, k) if rng is None else (rng.random((x.shape[0], k)) + 0.1, rng.random((k, x.shape[1])) + 0.1)
    w, h = np.maximum(w, 1e-9), np.maximum(h, 1e-9)
    for _ in range(rounds):
        h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (x @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
    return w, h


def _dendrogram(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At which distance two items first share a cluster, by mean linkage, and the clusters
    when there are ``k``."""
    n = len(d)
    out, groups, own = np.zeros((n, n)), [[i] for i in range(n)], np.arange(n)
    while len(groups) > 1:
        if len(groups) == k:
            for g, members in enumerate(groups):
                own[members] = g
        h, i, j = min((float(d[np.ix_(a, b)].mean()), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q)
        for a in groups[i]:
            out[a, groups[j]] = out[groups[j], a] = h
        groups[i] += groups.pop(j)
    return out, own


def _silhouette(d: np.ndarray, own: np.ndarray) -> float:
    out = []
    for i in range(len(d)):
        mine = (own == own[i]) & (np.arange(len(d)) != i)
        if not mine.any() or len(set(own)) < 2:
            out.append(0.0)
            continue
        a, b = d[i, mine].mean(), min(d[i, own == g].mean() for g in set(own) if g != own[i])
        out.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(out))


def select_k(netp: DataFrame, ks=range(2, 11), side: str = "src", runs: int = 30, seed: int = 10) -> DataFrame:
    """(k, cophenetic, silhouette): how stable patterns are for each number of them, from
    ``runs`` random starts; numbers a matrix is too small for are left out."""
    x = _wide(netp, side).to_numpy()
    rows, rng = [], np.random.default_rng(seed)
    for k in ks:
        if k > min(x.shape):
            continue
        together = np.zeros((len(x), len(x)))
        for _ in range(runs):
            own = factorize(x, k, 200, rng)[0].argmax(axis=1)
            together += own[:, None] == own[None, :]
        d = 1 - together / runs
        (heights, own), upper = _dendrogram(d, k), np.triu_indices(len(x), 1)
        a, b = d[upper], heights[upper]
        same = np.ptp(a) < 1e-12 or np.ptp(b) < 1e-12
        rows.append((int(k), 1.0 if same else float(np.corrcoef(a, b)[0, 1]), _silhouette(d, own)))
    return netp.sparkSession.createDataFrame(rows, "k int, cophenetic double, silhouette double")


def _wide(netp: DataFrame, side: str) -> pd.DataFrame:
    return _collected(role_matrix(netp, side)).pivot(index="grp", columns="pathway_name", values="value").fillna(0.0).sort_index(axis=0).sort_index(axis=1)


def patterns(netp: DataFrame, k: int, side: str = "src") -> DataFrame:
    """(kind, name, pattern, contribution): of groups by rows, of pathways by columns."""
    wide = _wide(netp, side)
    w, h = factorize(wide.to_numpy(), min(k, *wide.shape))
    k = w.shape[1]
    w, h = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12), h / np.maximum(h.sum(axis=0, keepdims=True), 1e-12)
    rows = [("group", str(g), p + 1, float(w[i, p])) for i, g in enumerate(wide.index) for p in range(k)]
    rows += [("pathway", str(c), p + 1, float(h[p, j])) for j, c in enumerate(wide.columns) for p in range(k)]
    return netp.sparkSession.createDataFrame(rows, "kind string, name string, pattern int, contribution double")


def clusters(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster) of (id, features array<double>)."""
    data = vectors.select("id", array_to_vector("features").alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def components(vectors: DataFrame, k: int) -> DataFrame:
    data = vectors.select("id", array_to_vector("features").alias("features"))
    return PCA(k=k, inputCol="features", outputCol="pc").fit(data).transform(data).select("id", vector_to_array("pc").alias("pc"))


def laplacian_embedding(similarity: DataFrame, k: int = 2) -> DataFrame:
    """(node, dims): eigenvectors of the normalised Laplacian of (a, b, value)."""
    rows = _collected(similarity)
    names = sorted({*rows["a"], *rows["b"]})
    at = {n: i for i, n in enumerate(names)}
    m = np.eye(len(names))
    for a, b, v in zip(rows["a"], rows["b"], rows["value"]):
        m[at[a], at[b]] = m[at[b], at[a]] = v
    d = 1 / np.sqrt(m.sum(axis=1))
    _, vec = np.linalg.eigh(np.eye(len(m)) - d[:, None] * m * d[None, :])
    vec = vec[:, 1 : k + 1] * np.sign(vec[np.abs(vec).argmax(axis=0), range(vec.shape[1])])[1 : k + 1]
    return similarity.sparkSession.createDataFrame([(str(n), [float(x) for x in vec[i]]) for n, i in at.items()], "node string, dims array<double>")


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 10) -> np.ndarray:
    """Clusters of a small matrix: the best of ``starts`` runs from random rows."""
    best = (np.inf, np.zeros(len(x), int))
    for _ in range(starts):
        c = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(100):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[own == g].mean(axis=0) if (own == g).any() else c[g] for g in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = float(((x - c[own]) ** 2).sum())
        if cost < best[0] - 1e-12:
            best = (cost, own)
    return best[1]


def laplacian_values(m: np.ndarray) -> np.ndarray:
    """Sizes of the smallest hundred eigenvalues of the normalised Laplacian, ascending."""
    root = np.sqrt(np.maximum(m.sum(axis=0), 1e-300))
    out = -(m / root[:, None]) / root[None, :]
    np.fill_diagonal(out, out.diagonal() + 1)
    return np.sort(np.abs(np.linalg.eigvalsh((out + out.T) / 2)))[:100]


def eigengap(together: np.ndarray, tol: float = 0.01) -> tuple[int, int]:
    """(number at the largest gap, number of zeros) of a matrix of how often items meet,
    what is at or below a tolerance that grows with the number of parts left out."""
    zeros = int((laplacian_values(together) <= tol).sum())
    tau = 0.3 if zeros <= 5 else 0.4 if zeros <= 10 else 0.5
    m = np.where(together <= tau, 0, together)
    values = laplacian_values((m + m.T) / 2)
    gaps = np.diff(values)
    return (int(gaps.argmax()) + 1 if len(gaps) else 1), int((values <= tol).sum())


def cluster_pathways(places: DataFrame, k: int | None = None, seed: int = 1) -> DataFrame:
    """(node, cluster) of (node, dims), pathways of a result. Without ``k`` it is the
    largest eigengap of how often 2 to 10 clusters put two pathways together."""
    rows = sorted(_collected(places.select("node", "dims")).itertuples(index=False), key=lambda r: r[0])
    x, rng = np.array([list(r[1]) for r in rows], float), np.random.default_rng(seed)
    if k is None and len(x) > 2:
        tried = [_kmeans(x, n, rng) for n in range(2, min(len(x) - 1, 10) + 1)]
        k = eigengap(np.mean([own[:, None] == own[None, :] for own in tried], axis=0))[0]
    own = _kmeans(x, min(k or 1, len(x)), rng) if len(x) else []
    return places.sparkSession.createDataFrame([(str(r[0]), int(c)) for r, c in zip(rows, own)], "node string, cluster int")


def cluster_similarity(similarity: DataFrame, k: int, vectors: int | None = None, seed: int = 1) -> DataFrame:
    """(node, cluster) by the smallest eigenvectors of a similarity (a, b, value)."""
    return cluster_pathways(laplacian_embedding(similarity, vectors or k), k, seed)


def smooth(expr: DataFrame, edges: DataFrame, alpha: float = 0.5, by: str = "rows") -> DataFrame:
    """(cell, gene, value) after a walk with restart on the gene network (g1, g2): the
    solution of (I - alpha A) E = (1 - alpha) E0, A being the network's links with rows,
    or columns, that add up to 1. Genes outside the network keep their values; genes of
    the network that are not measured start from 0 and are not returned.

    The inverse, genes by genes, is made once and sent to the tasks up to ``NETWORK``
    genes; a larger network is walked until what is left is below 1e-12 of the values."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    both = written(edges.select("g1", "g2").union(edges.select("g2", "g1")).distinct(), "network")
    inside = both.select(F.col("g1").alias("gene")).distinct()
    measured = expr.select("gene").distinct()
    outside = expr.join(inside, "gene", "left_anti").select("cell", "gene", "value")
    linked = expr.join(inside, "gene", "left_semi").select("cell", "gene", "value")
    total = Window.partitionBy("g1" if by == "rows" else "g2")
    step = both.withColumn("w", 1 / F.count(F.lit(1)).over(total))
    names = [r.gene for r in inside.orderBy("gene").limit(NETWORK + 1).collect()]
    if len(names) <= NETWORK:
        at, a = {g: k for k, g in enumerate(names)}, np.eye(len(names))
        for r in step.collect():
            a[at[r.g1], at[r.g2]] -= alpha * r.w
        inverse = np.linalg.inv(a) * (1 - alpha)
        some = sorted(at[r.gene] for r in measured.join(inside, "gene", "left_semi").collect())
        kinds = dict(expr.dtypes)

        def solve(batches):
            cell, row = None, np.zeros(len(names))

            def out():
                y = inverse[some] @ row
                keep = np.flatnonzero(y)
                return [cell] * len(keep), [names[some[k]] for k in keep], y[keep].tolist()

            for batch in batches:
                cells, genes, values = [], [], []
                for c, g, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if c != cell:
                        if cell is not None:
                            for have, more in zip((cells, genes, values), out()):
                                have += more
                        cell, row = c, np.zeros(len(names))
                    row[at[g]] += v
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(cells, batch.schema.field(0).type), pa.array(genes), pa.array(values)], ["cell", "gene", "value"])
                kind = batch.schema.field(0).type
            if cell is not None:
                cells, genes, values = out()
                yield pa.RecordBatch.from_arrays([pa.array(cells, kind), pa.array(genes, pa.string()), pa.array(values, pa.float64())], ["cell", "gene", "value"])

        inner = linked.repartition("cell").sortWithinPartitions("cell").mapInArrow(solve, f"cell {kinds['cell']}, gene string, value double")
        return outside.unionByName(inner)
    now = linked
    for k in range(math.ceil(math.log(1e-12) / math.log(alpha))):
        spread = now.join(step, F.col("gene") == F.col("g2")).groupBy("cell", F.col("g1").alias("gene")).agg((F.sum(F.col("value") * F.col("w")) * alpha).alias("value"))
        own = linked.withColumn("value", F.col("value") * (1 - alpha))
        now = own.unionByName(spread).groupBy("cell", "gene").agg(F.sum("value").alias("value"))
        now = written(now, "walk") if k % 5 == 4 else now
    return outside.unionByName(now.join(measured, "gene", "left_semi").select("cell", "gene", "value"))
