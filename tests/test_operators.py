import math

import numpy as np
import pytest

from dyadloom.functions.means import group_means, match_kind
from dyadloom.operators import de, graph, kb, kernel, learn, merge, net, spatial
from dyadloom.sources.adapters import Study, knowledge_base


@pytest.fixture(scope="module")
def study(spark):
    expr = spark.createDataFrame([(1, "g", 1.0), (2, "g", 2.0), (3, "g", 4.0), (5, "g", 3.0), (4, "h", 5.0)], "cell long, gene string, value double")
    cells = spark.createDataFrame([(k, "a" if k <= 4 else "b", k % 2) for k in range(1, 7)], "cell long, grp string, sample int")
    return Study(expr, cells, **knowledge_base(spark))


DENSE = {("g", "a"): [1, 2, 4, 0], ("g", "b"): [3, 0], ("h", "a"): [0, 0, 0, 5], ("h", "b"): [0, 0]}


@pytest.mark.parametrize("kind", ["triMean", "truncatedMean", "thresholdedMean", "median", "mean"])
def test_means_count_implicit_zeros(study, kind):
    def want(v):
        v = sorted(v)
        q = np.quantile(v, [0.25, 0.5, 0.75])
        cut = math.floor(len(v) * 0.25)
        return {
            "triMean": (q[0] + 2 * q[1] + q[2]) / 4, "median": q[1], "mean": np.mean(v),
            "truncatedMean": np.mean(v[cut : len(v) - cut]), "thresholdedMean": 0 if np.count_nonzero(v) / len(v) < 0.25 else np.mean(v),
        }[kind]

    got = {(r.gene, r.grp): r.value for r in group_means(study.expr, study.cells, kind, 0.25).collect()}
    assert got == {k: pytest.approx(want(v)) for k, v in DENSE.items()}


def test_kind_by_unique_prefix():
    assert match_kind("tri") == "triMean"
    with pytest.raises(ValueError):
        match_kind("t")


def test_missing_member_is_named(study):
    with pytest.raises(kernel.MissingMember, match="Brand#1"):
        kernel.check_members(study, study.expr.select("gene").distinct())


def test_thresholds_differ_at_the_boundary(spark):
    rows = spark.createDataFrame([(1, "a", "b", 0.5, 0.05), (2, "a", "b", 0.25, 0.01), (3, "a", "b", 0.25, None)], "lr_ix int, src string, tgt string, prob double, pval double")
    assert net.aggregate_net(rows, 0.05).first().asDict() == {"src": "a", "tgt": "b", "count": 1, "weight": 0.25}
    assert net.significant(rows, 0.05, strict=True).filter("prob > 0").count() == 2


def test_flow_of_totals_from_one_on(spark):
    rows = spark.createDataFrame([("p", 0.5), ("q", 1.0), ("r", 3.0), ("s", 0.0)], "pathway_name string, prob double")
    got = {r.pathway_name: r.flow for r in net.information_flow(rows).collect()}
    top = -1 / math.log(0.5)
    assert got == {"p": pytest.approx(top), "q": pytest.approx(1.1 * top), "r": pytest.approx(1.5 * top)}


def test_exact_rank_sum():
    # all 10 ways to choose 2 of 5 ranks: U = 0 has one, so the two-sided value is 2 / 10
    assert de.exact_p(0, 2, 3) == pytest.approx(0.2)
    assert de.exact_p(3, 2, 3) == pytest.approx(1.0)


def test_betweenness_and_rank():
    line = np.zeros((3, 3))
    line[0, 1] = line[1, 2] = 1.0
    assert graph.betweenness(line).tolist() == [0, 1, 0]
    assert graph.page_rank(line).sum() == pytest.approx(1)
    assert graph.max_flow(line, 0, 2) == 1
    assert graph.structural_distance(line, line) == pytest.approx(0)


def test_contact_applies_after_the_last_diffusible(spark):
    lr = spark.createDataFrame([(1, "Cell-Cell Contact"), (2, "ECM-Receptor"), (3, "Cell-Cell Contact")], "lr_ix int, annotation string")
    near = spark.createDataFrame([("a", "b", 0.5, 0), ("a", "a", 2.0, 1)], "src string, tgt string, weight double, contact int")

    def apart(lr, **more):  # weights between groups not in contact
        return [r.weight for r in kernel.contact_weights(lr, near, **more).filter("src <> tgt").orderBy("lr_ix").collect()]

    assert apart(lr) == [0.5, 0.5, 0.0]
    assert apart(lr, forced=True) == [0, 0, 0] and apart(lr, contact_dependent=False) == [0.5] * 3
    assert apart(lr.filter("lr_ix <> 2")) == [0, 0]  # contact only: all of them


def test_comparisons_within_parts(spark):
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 4, 24).astype(float)
    cells = spark.createDataFrame([(k, "ab"[k % 2], k // 2 % 2) for k in range(24)], "cell long, grp string, sample int")
    expr = spark.createDataFrame([(k, "g", float(v)) for k, v in enumerate(dense) if v], "cell long, gene string, value double")
    got = {r.grp: r for r in de.dataset_markers(expr, cells, 1).collect()}
    alone = {g: de.rank_sums(expr, cells.filter(f"grp = '{g}'").select("cell", (cells["sample"] == 1).alias("grp"))).filter("grp").first().z for g in "ab"}
    assert {g: r.z for g, r in got.items()} == {g: pytest.approx(z) for g, z in alone.items()}
    inner = dense[np.arange(24) % 2 == 0].reshape(-1, 2)[:, 1]
    assert got["a"].pct_1 == pytest.approx(round(np.count_nonzero(inner) / len(inner), 3))
    assert de.dataset_markers(expr, cells, 1, combined=True).select("z").distinct().count() == 1


def test_signed_ranks(spark):
    rows = [("p", f"g{k}", "t", ds, v) for k, pair in enumerate([(1.0, 3.0), (2.0, 1.0), (5.0, 5.0), (0.0, 2.0), (1.0, 4.0)]) for ds, v in enumerate(pair)]
    r = net.signed_rank(spark.createDataFrame(rows, "pathway_name string, src string, tgt string, dataset int, prob double")).first()
    # differences 2, -1, 0, 2, 3: ranks 2.5, 1, 2.5, 4
    assert (r.n, r.v, r.zeros, r.tied) == (4, 9.0, 1, True)
    assert r.z == pytest.approx((9 - 5 - 0.5) / math.sqrt(4 * 5 * 9 / 24 - 6 / 48))


def test_gene_subset_goes_by_position(spark, study):
    names = spark.createDataFrame([("CX3", 1), ("Brand#2", 2), ("CX1", 3)], "name string, ord int")
    official = spark.createDataFrame([("Brand#2",)], "symbol string")
    got = [r.gene for r in kb.gene_subset(names, study.complexes, official).orderBy("ord").collect()]
    assert got == ["Brand#2", "Brand#17", "Brand#13", "Brand#18", "Brand#19", "Brand#14"]


def test_distances_by_squares_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    at = [(k, k % 3, k % 2, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(0, 10, (60, 2)).round(2))]
    cells = spark.createDataFrame(at, "cell long, grp int, sample int, x double, y double")
    got = {(r.i, r.j): r.d for r in spatial.cell_distances(cells, 5.0).collect()}
    want = {(a[0], b[0]): math.hypot(a[3] - b[3], a[4] - b[4]) for a in at for b in at if a[0] < b[0] and a[2] == b[2] and math.hypot(a[3] - b[3], a[4] - b[4]) <= 5}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_neighbours_by_widening_squares(spark):
    rng = np.random.default_rng(4)
    spots = [*rng.normal(0, 1, (40, 2)).round(1).tolist(), *rng.normal(500, 30, (15, 2)).tolist(), [9000.0, -4000.0], [0.5, 0.5], [0.5, 0.5]]
    at = [(k, 0, int(k % 7 == 0), float(x), float(y)) for k, (x, y) in enumerate(spots)]
    cells = spark.createDataFrame([*at, (999, 0, 0, None, 1.0)], "cell long, grp int, sample int, x double, y double")
    for k in (1, 4, 12):  # the smaller sample has 9 cells: 8 neighbours at most
        want = []
        for a in at:
            near = sorted((math.sqrt((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2), b[0]) for b in at if b[0] != a[0] and b[2] == a[2])[:k]
            want += [(a[2], a[0], j, n + 1) for n, (_, j) in enumerate(near)]
        got = [(r["sample"], r.node, r.neighbour, r.rnk) for r in spatial.knn(cells, k).collect()]
        assert sorted(got) == sorted(want)
    assert spatial.knn(cells.limit(0), 3).count() == 0


def test_merge_refuses_repeated_cells(study):
    with pytest.raises(ValueError):
        merge.merge({"x": study, "y": study})
    assert merge.merge({"x": study, "y": study}, prefix=True).cells.count() == 12


def test_unknown_key(study):
    with pytest.raises(ValueError):
        kb.subset_db(study.lr, ["x"], "nothing")


def test_factors_reproduce_a_rank_one_matrix():
    x = np.outer([1.0, 2.0, 3.0], [1.0, 0.5])
    w, h = learn.factorize(x, 1)
    assert np.allclose(w @ h, x, atol=1e-6)
