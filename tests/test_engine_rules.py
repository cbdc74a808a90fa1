"""Operators against plain versions on small inputs."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from dyadloom import __main__ as cli
from dyadloom.functions import blocks, rng, scalar
from dyadloom.functions.means import group_means
from dyadloom.operators import de, graph, kernel, learn, net, spatial
from dyadloom.sources import adapters, textform


def small_study(spark, n=90, seed=3):
    r = np.random.default_rng(seed)
    dense = np.where(r.random((5, n)) < 0.4, 0, r.integers(1, 9, (5, n)) / 8.0)
    grp = [("a", "b", "c")[k % 3 if k < 60 else 0] for k in range(n)]
    expr = spark.createDataFrame([(c, f"g{g}", float(dense[g, c])) for g in range(5) for c in range(n) if dense[g, c]], "cell long, gene string, value double")
    cells = spark.createDataFrame([(c, grp[c], c % 2) for c in range(n)], "cell long, grp string, sample int")
    lr = spark.createDataFrame([(1, "i1", "p", "g0", "g1", "", "", "", "", "Secreted Signaling"), (2, "i2", "q", "CX", "g2", "AG", "", "", "", "Cell-Cell Contact")], "lr_ix int, " + ", ".join(f"{c} string" for c in adapters.LR_COLUMNS[1:]))
    part = "name string, pos int, member string"
    study = adapters.Study(expr, cells, lr, spark.createDataFrame([("CX", 1, "g3"), ("CX", 2, ""), ("CX", 3, "g4")], part), spark.createDataFrame([("AG", 1, "g1"), ("AG", 2, "absent")], part))
    return study, dense, np.array(grp)


def plain_prob(dense, grp, mean):
    m = np.array([[mean(row[grp == g]) for g in "abc"] for row in dense])
    hill = lambda x: x / (0.5 + x)
    one = hill(m[0][:, None] * m[1][None, :])
    two = hill(np.sqrt(m[3] * m[4])[:, None] * m[2][None, :]) * (1 + hill(m[1]))[:, None] * (1 + hill(m[1]))[None, :]
    return np.array([one, two])


def tri(x):
    q = np.quantile(x, [0.25, 0.5, 0.75])
    return (q[0] + 2 * q[1] + q[2]) / 4


@pytest.mark.parametrize("seed", [None, 7])
@pytest.mark.parametrize("kind", ["triMean", "truncatedMean", "thresholdedMean", "median"])
def test_kernel_and_its_replicates(spark, kind, seed):
    study, dense, grp = small_study(spark)
    mean = {
        "triMean": tri, "median": np.median, "truncatedMean": lambda x: np.sort(x)[len(x) // 10 : len(x) - len(x) // 10].mean(),
        "thresholdedMean": lambda x: 0.0 if np.count_nonzero(x) / len(x) < 0.1 else x.mean(),
    }[kind]
    nboot = 12
    if seed is None:
        order = np.array([int(__import__("hashlib").md5(str(c).encode()).hexdigest()[:15], 16) for c in range(len(grp))])
        h = blocks.hashes(order, nboot)
        labels = [np.sort(grp)[np.argsort(np.argsort(row))] for row in h]
    else:
        labels = [grp[p] for p in rng.replicates(len(grp), nboot, seed)]
    seen = plain_prob(dense, grp, mean)
    above = sum((plain_prob(dense, label, mean) > seen * (1 + 1e-12)).astype(int) for label in labels)
    for r in kernel.communicate(study, kind, nboot=nboot, seed=seed).collect():
        at = r.lr_ix - 1, "abc".index(r.src), "abc".index(r.tgt)
        assert r.prob == pytest.approx(seen[at], rel=1e-10, abs=1e-14)
        assert r.pval == (1.0 if seen[at] == 0 else above[at] / nboot)


def test_missing_parts_and_places(spark):
    study, _, _ = small_study(spark)
    with pytest.raises(kernel.MissingMember):
        kernel.communicate(study.with_(expr=study.expr.filter("gene <> 'g4'")), nboot=0)
    near = spark.createDataFrame([(a, b, 0.5 if a != b else 2.0, int(a == b)) for a in "abc" for b in "abc"], "src string, tgt string, weight double, contact int")
    free = {(r.lr_ix, r.src, r.tgt): r.prob for r in kernel.communicate(study, nboot=0).collect()}
    for r in kernel.communicate(study, nboot=0, spatial=near).collect():
        weight = (2.0 if r.src == r.tgt else 0.5) * (r.src == r.tgt if r.lr_ix == 2 else 1)
        assert r.prob == pytest.approx(free[r.lr_ix, r.src, r.tgt] * weight)


def test_blocks_larger_than_one(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    study, dense, grp = small_study(spark)
    got = {(r.gene, r.grp): r.value for r in group_means(study.expr, study.cells).collect()}
    assert got == {(f"g{k}", g): pytest.approx(tri(dense[k][grp == g])) for k in range(5) for g in "abc"}


def test_seeded_draws():
    own = rng.Generator(1)
    assert [round(own.uniform(), 7) for _ in range(3)] == [0.2655087, 0.3721239, 0.5728534]
    assert rng.Generator(1).permutation(10).tolist() == [9, 4, 7, 1, 2, 5, 3, 10, 6, 8]
    assert sorted(rng.replicates(50, 3, 4)[2].tolist()) == list(range(50))
    with pytest.raises(ValueError):
        own.permutation(3, 4)


def test_nearest_by_squares_is_that_of_all_pairs(spark):
    r = np.random.default_rng(5)
    spots = [*r.normal(0, 1, (40, 2)).round(1).tolist(), *r.normal(400, 30, (15, 2)).tolist(), [9000.0, -4000.0]]
    at = [(k, "xyz"[k % 3 if k < 50 else 0], k % 2, float(a), float(b)) for k, (a, b) in enumerate(spots)]
    cells = spark.createDataFrame([*at, (999, "x", 0, None, 1.0)], "cell long, grp string, sample int, x double, y double")
    want = []
    for a in at:
        for g in {b[1] for b in at if b[2] == a[2]}:
            d, j = min((math.sqrt((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2), b[0]) for b in at if b[2] == a[2] and b[1] == g)
            want.append((a[2], a[0], a[1], g, j, d))
    got = [(r["sample"], r.i, r.a, r.b, r.nn, r.d) for r in spatial.nearest(cells).collect()]
    assert sorted(got) == [(*w[:5], pytest.approx(w[5])) for w in sorted(want)]


@pytest.mark.parametrize("by", ["rows", "columns"])
def test_smoothing_solves(spark, by, monkeypatch):
    study, dense, _ = small_study(spark)
    edges = spark.createDataFrame([("g0", "g1"), ("g1", "g2"), ("g2", "unseen")], "g1 string, g2 string")
    names = ["g0", "g1", "g2", "unseen"]
    a = np.zeros((4, 4))
    for i, j in ((0, 1), (1, 2), (2, 3)):
        a[i, j] = a[j, i] = 1
    a = a / a.sum(axis=1)[:, None] if by == "rows" else a / a.sum(axis=0)
    e = np.linalg.solve(np.eye(4) - 0.5 * a, 0.5 * np.vstack([dense[:3], np.zeros(dense.shape[1])]))
    want = {(c, names[k]): e[k, c] for k in range(3) for c in range(dense.shape[1]) if abs(e[k, c]) > 1e-12}
    want |= {(c, f"g{k}"): dense[k, c] for k in (3, 4) for c in range(dense.shape[1]) if dense[k, c]}
    for limit in (2000, 0):  # the inverse, and the walk
        monkeypatch.setattr(learn, "NETWORK", limit)
        got = {(r.cell, r.gene): r.value for r in learn.smooth(study.expr, edges, by=by).collect() if abs(r.value) > 1e-12}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_exact_p_by_all_arrangements(spark):
    for n1, n2 in ((2, 3), (4, 4), (1, 6)):
        ranks = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        for w in range(n1 * n2 + 1):
            low, high = sum(u <= w for u in ranks) / len(ranks), sum(u >= w for u in ranks) / len(ranks)
            assert de.exact_p(w, n1, n2) == pytest.approx(min(1, 2 * min(low, high)))
    expr = spark.createDataFrame([(k, "g", float(k + 1)) for k in range(9)], "cell long, gene string, value double")
    cells = spark.createDataFrame([(k, "a" if k < 3 else "b", 0) for k in range(9)], "cell long, grp string, sample int")
    got = {r.grp: r.pvalues for r in de.markers(expr, cells, 1, thresh_p=1.1, only_pos=False).collect()}
    assert got == {"a": pytest.approx(2 / 84), "b": pytest.approx(2 / 84)}


def test_comparisons_of_datasets(spark):
    r = np.random.default_rng(2)
    rows = [("p", f"s{i}", f"t{j}", d, float(v)) for d in (0, 1) for i in range(3) for j in range(3) for v in [r.random() + 0.4 * d]]
    netp = spark.createDataFrame(rows, "pathway_name string, src string, tgt string, dataset int, prob double")
    by = {(s, t, d): v for _, s, t, d, v in rows}
    diff = np.array([by[s, t, 1] - by[s, t, 0] for s, t, d in by if d == 0])
    v = sum(k + 1 for k, i in enumerate(np.argsort(np.abs(diff))) if diff[i] > 0)
    sums = [sum((k + 1) * b for k, b in enumerate(bits)) for bits in itertools.product((0, 1), repeat=9)]
    want = min(1, 2 * min(sum(s <= v for s in sums), sum(s >= v for s in sums)) / 512)
    assert net.paired_test(netp).first().pvalue == pytest.approx(want)
    # groups are all that occur: three sources and three targets, so 36 pairs a dataset, mostly zeros
    assert 0 < net.unpaired_test(netp).first().pvalue <= 1
    three = netp.unionByName(netp.filter("dataset = 0").selectExpr("pathway_name", "src", "tgt", "2 AS dataset", "prob / 10 AS prob"))
    assert net.compare_flow(three, (0, 1, 2)).columns == ["pathway_name", "flow_0", "flow_1", "flow_2", "ratio"]


def test_rare_groups_are_kept(spark):
    lines = spark.createDataFrame([(1, "a", "a", 0.5, 0.0), (1, "a", "r", 0.4, 0.0), (1, "b", "a", 0.3, 0.0)], "lr_ix int, src string, tgt string, prob double, pval double")
    support = spark.createDataFrame([(1, "a", "a", 2), (1, "a", "r", 1), (1, "b", "a", 1)], "lr_ix int, src string, tgt string, n int")
    cells = spark.createDataFrame([(k, "a", k % 2) for k in range(40)] + [(100 + k, "r", int(k > 2)) for k in range(15)] + [(200 + k, "z", 0) for k in range(3)], "cell int, grp string, sample int")
    rare = net.rare_groups(cells, 10)
    assert [r.grp for r in rare.collect()] == ["r"]
    got = lambda **more: {(r.src, r.tgt): r.prob for r in net.filter_min_samples(lines, support, 2, **more).collect()}
    assert got() == {("a", "a"): 0.5, ("a", "r"): 0.0, ("b", "a"): 0.0}
    assert got(rare=rare) == {("a", "a"): 0.5, ("a", "r"): 0.4, ("b", "a"): 0.0}


def test_similarities_share_neighbours(spark):
    sets = {"p": "ab bc ca", "q": "ab bc", "r": "aa bb", "s": "aa", "t": "ab bc ca cc"}
    netp = spark.createDataFrame([(n, e[0], e[1], 0.5) for n, es in sets.items() for e in es.split()], "pathway_name string, src string, tgt string, prob double")
    names = sorted(sets)
    jac = np.array([[len(set(sets[a].split()) & set(sets[b].split())) / len(set(sets[a].split()) | set(sets[b].split())) for b in names] for a in names])
    near = []
    for i in range(5):
        order = sorted((j for j in range(5) if j != i), key=lambda j: (round(((jac[i] - jac[j]) ** 2).sum(), 9), j))
        near.append({i, *order[:2]})
    share = np.array([[1.0 if i == j else (lambda o: o / (6 - o) if o / (6 - o) >= 1 / 15 else 0)(len(near[i] & near[j])) for j in range(5)] for i in range(5)])
    want = {(a, b): pytest.approx(jac[i, j] * share[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if jac[i, j] * share[i, j] > 0}
    assert {(r.a, r.b): r.value for r in graph.functional_similarity(netp).collect()} == want
    far = graph.structural_similarity(netp).collect()
    assert {(r.a, r.b): r.value for r in far if r.a == r.b} == {(n, n): 1.0 for n in names}
    assert all(r.value == pytest.approx({(x.b, x.a): x.value for x in far}[r.a, r.b]) for r in far)


def test_all_measures(spark):
    netp = spark.createDataFrame([("p", a, b, w) for a, b, w in (("x", "y", 1.0), ("y", "z", 2.0), ("z", "x", 4.0), ("x", "x", 0.5))], "pathway_name string, src string, tgt string, prob double")
    got = {(r.measure, r.grp): r.value for r in graph.centrality(netp).collect()}
    assert {m for m, _ in got} == set(graph.MEASURES) and len(got) == 33
    assert [got["outdeg", g] for g in "xyz"] == [1.5, 2, 4] and [got["indeg_unweighted", g] for g in "xyz"] == [2, 1, 1]
    m = np.array([[0.5, 1, 0], [0, 0, 2], [4, 0, 0]])
    v = np.full(3, 1 / 3)
    for _ in range(2000):
        v = 0.15 / 3 + 0.85 * (m / m.sum(axis=1)[:, None]).T @ v
    assert [got["page_rank", g] for g in "xyz"] == [pytest.approx(x) for x in v]


def test_patterns_and_clusters(spark):
    x = np.array([[1.0, 1, 0, 0], [0.9, 1, 0, 0], [0, 0, 1, 1], [0, 0, 1, 0.8]])
    rows = [(f"p{j}", f"g{i}", "t", float(x[i, j])) for i in range(4) for j in range(4) if x[i, j]]
    netp = spark.createDataFrame(rows, "pathway_name string, src string, tgt string, prob double")
    got = {(r.kind, r.name, r.pattern): r.contribution for r in learn.patterns(netp, 2).collect()}
    top = {n: max((1, 2), key=lambda p: got["group", n, p]) for n in ("g0", "g1", "g2", "g3")}
    assert top["g0"] == top["g1"] != top["g2"] == top["g3"]
    w, h = learn.start_of(x, 2)
    assert (w >= 0).all() and (h >= 0).all() and np.linalg.norm(x - w @ h) < np.linalg.norm(x)
    scores = {r.k: r for r in learn.select_k(netp, (2, 3, 9), runs=10).collect()}
    assert set(scores) == {2, 3} and scores[2].cophenetic >= 0.99 and scores[2].silhouette >= 0.9
    places = spark.createDataFrame([(f"n{k}", [float(k // 4) * 10 + 0.1 * (k % 4), 0.1 * (k % 3)]) for k in range(12)], "node string, dims array<double>")
    own = {r.node: r.cluster for r in learn.cluster_pathways(places).collect()}
    assert len({own[f"n{k}"] for k in range(4)}) == 1
    fixed = Counter(r.cluster for r in learn.cluster_pathways(places, 3).collect())
    assert sorted(fixed.values()) == [4, 4, 4]


def test_tables_of_diagrams(spark):
    study, _, _ = small_study(spark)
    lines = spark.createDataFrame([(1, "a", "b", 0.5, 0.0), (2, "a", "c", 0.25, 0.0), (2, "b", "c", 0.125, 0.5)], "lr_ix int, src string, tgt string, prob double, pval double")
    chords = {(r.src, r.tgt): (r.name, r.start, r.end, r.prob) for r in net.chord_edges(lines, study.lr).collect()}
    assert chords == {("a", "b"): ("g0 - g1", 0.0, 0.0, 0.5), ("a", "c"): ("CX - g2", 0.5, 0.0, 0.25)}
    parts = spark.createDataFrame([("group", "a", 1, 0.9), ("group", "b", 1, 0.2), ("group", "b", 2, 0.8), ("pathway", "p", 1, 0.6), ("pathway", "q", 2, 0.4)], "kind string, name string, pattern int, contribution double")
    assert [tuple(r) for r in net.river(parts).collect()] == [(1, "a", "p", 0.6)]
    netp = spark.createDataFrame([("p", "a", "b", 2.0), ("p", "b", "b", 1.0)], "pathway_name string, src string, tgt string, prob double")
    assert {(r.grp, r.pattern): r.size for r in net.dots(netp, parts).collect()} == {("a", 1): pytest.approx(0.9), ("b", 2): pytest.approx(0.4)}


def test_sides_take_markers_of_their_parts(spark):
    study, _, _ = small_study(spark)
    marked = spark.createDataFrame([("g0", "a"), ("g3", "b"), ("other", "c")], "gene string, grp string")
    assert sorted((r.name, r.gene) for r in de.side_markers(marked, study.lr, study.complexes).collect()) == [("CX", "g3"), ("g0", "g0")]


def test_short_vectors():
    assert scalar.strict_mean([1e16, 1.0, -1e16]) == pytest.approx(1 / 3, rel=1e-2)
    assert scalar.strict_sum([0.1] * 10) == pytest.approx(1.0, abs=1e-15) and math.isnan(scalar.strict_mean([]))
    assert scalar.quantile([1, 2, 3, 4], 0.25) == 1.75 and scalar.mean_of([0, 0, 1, 3], "triMean") == tri(np.array([0, 0, 1, 3]))
    assert scalar.top_labels([1.0, 2.0, 3.0, 4.0], 0.25) == [False, False, False, True]
    assert scalar.in_order(["b", "x", "a", "b"], ["a", "b"]) == ["b", "a"]
    assert scalar.one_digit([0.123, 1.0]) == ["0.1", "1.0"] and scalar.one_digit([float("nan"), 12.0]) == ["NaN", "12"]
    for x in (0.1, -3.5, 1e-310, 0.0, math.inf):
        assert float.fromhex(textform.hex_float(x)) == x
    assert textform.hex_float(1.5) == "0x1.8p+0"


def test_knowledge_base_goes_out_and_back(spark, tmp_path):
    kb = {**adapters.knowledge_base(spark), "symbols": spark.createDataFrame([("Brand#1",)], "symbol string")}
    adapters.write_knowledge_base(kb, str(tmp_path / "kb"), "retail")
    back = adapters.load_knowledge_base(spark, str(tmp_path / "kb"))
    assert sorted(map(tuple, back["lr"].collect())) == sorted(map(tuple, kb["lr"].select(back["lr"].columns).collect())) and back["manifest"]["nlr1"] == "8"
    member = lambda df: sorted((r.name, r.pos, r.member) for r in df.collect() if r.member)
    assert all(member(back[k]) == member(kb[k]) for k in ("complexes", "cofactors"))
    adapters.register_knowledge_base("mine", str(tmp_path / "kb"))
    assert adapters.named_knowledge_base(spark, "mine")["symbols"].count() == 1
    with pytest.raises(KeyError):
        adapters.named_knowledge_base(spark, "nobody's")
    file = tmp_path / "kb" / "complexes.tsv"
    (tmp_path / "kb" / ".complexes.tsv.crc").unlink()
    file.write_text(file.read_text().replace("Brand#13", "Brand#99"))
    with pytest.raises(ValueError, match="manifest"):
        adapters.load_knowledge_base(spark, str(tmp_path / "kb"))


def test_a_study_of_ones_own(spark):
    values = spark.createDataFrame([(1, "g", 2.0), (2, "g", 1.0)], "cell long, gene string, value double")
    meta = spark.createDataFrame([(1, "a"), (2, "b")], "cell long, kind string")
    study = adapters.study_of(values, meta, group_by="kind")
    assert {(r.cell, r.grp, r["sample"]) for r in study.cells.collect()} == {(1, "a", "sample1"), (2, "b", "sample1")}
    for wrong in (meta.limit(1), meta.union(meta), meta.selectExpr("cell", "'0' AS kind"), meta.selectExpr("cell", "nullif('a', 'a') AS kind")):
        with pytest.raises(ValueError):
            adapters.study_of(values, wrong, group_by="kind")
    with pytest.raises(ValueError):
        adapters.study_of(values.selectExpr("cell", "gene", "-value AS value"), meta, group_by="kind")
    with pytest.raises(ValueError):
        adapters.study_of(values, meta, group_by="kind", coordinates=values.selectExpr("cell", "value AS x", "value AS y"))
    more = adapters.add_meta(study, spark.createDataFrame([(1, 5)], "cell long, age int"))
    assert {r.cell: r.age for r in more.cells.collect()} == {1: 5, 2: None}
    assert "u" in adapters.add_reduction(study, spark.createDataFrame([(1, [0.0])], "cell long, dims array<double>"), "u").parameters["reductions"]
    old = adapters.update_study(adapters.Study(values.withColumnRenamed("cell", "barcode"), meta.withColumnsRenamed({"cell": "barcode", "kind": "labels"})))
    assert old.cells.columns == ["cell", "grp", "sample"] and old.expr.columns == ["cell", "gene", "value"]


TEXT = """version\t1
groups\t2
genes\t2
cells\t4
lr\t1
B
A
g1
g2
values
0x1p+0 0x1p-1 0x0p+0 0x1.8p-1
0x1p-2 0x1p-1 0x1p+0 0x1p+0
c1
c2
c3
c4
cell_group
0 0 1 1
lr_columns\tinteraction_name\tligand\treceptor\tagonist\tantagonist\tco_A_receptor\tco_I_receptor
g1_g2\tg1\tg2\t\t\t\t
type\ttri
trim\t0.1
population_size\tFALSE
raw_use\tTRUE
nboot\t3
seed\t1
Kh\t0.5
n\t1
"""


def test_text_command_line(spark, tmp_path, capsys):
    file = tmp_path / "in.tsv"
    file.write_text(TEXT)
    assert cli.main(["run", "--input", str(file), "--output", str(tmp_path / "out"), "--hex"]) == 0
    lines = (tmp_path / "out").read_text().split("\n")
    assert lines[:7] == ["version\t1", "groups\t2", "lr\t1", "genes\t2", "cells\t4", "type_mean\ttriMean", "dim\t2,2,1"]
    at = lines.index("prob")
    left, right = [tri(np.array([1, 0.5])), tri(np.array([0, 0.75]))], [tri(np.array([0.25, 0.5])), 1.0]
    want = [left[s] * right[t] / (0.5 + left[s] * right[t]) for t in (0, 1) for s in (0, 1)]
    assert [float.fromhex(v) for v in lines[at + 1 : at + 5]] == [pytest.approx(w) for w in want]
    assert lines[lines.index("dimnames_source") + 1] == "B\tA"
    cli.main(["describe", "--input", str(file)])
    cli.main(["mean", "--kind", "tri", "1", "2", "3", "4"])
    cli.main(["version"])
    said = capsys.readouterr().out
    assert "group[0]\tB\t2 cells" in said and "\n2.5\n" in said and "dyadloom" in said
    for old, new in (("cells\t4", "cells\t5"), ("version\t1", "version\t2"), ("0 0 1 1", "0 0 1 2"), ("raw_use\tTRUE", "raw_use\tFALSE"), ("co_A_receptor", "other")):
        with pytest.raises(ValueError):
            textform.parse(TEXT.replace(old, new))
