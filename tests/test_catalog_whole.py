"""Registered queries do the whole job: every replicate, every pair, the operators' defaults."""

import duckdb
import pytest

from dyadloom.operators import graph, learn
from dyadloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pvalues():
    """(lr_ix, src, tgt) -> (prob, pval) of 100 replicates, by the query's SQL."""
    con = duckdb.connect()
    for t in "lineitem orders part customer".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = catalog.oracle_sql()["commun_pval"]
    assert sql.count("range(1, 101)") == 1 and sql.count("/ 100 END") == 1
    return {r[:3]: r[3:] for r in con.execute(f"SELECT lr_ix, src, tgt, prob, pval FROM ({sql})").fetchall()}


def test_reads_have_p_values_by_permutation(spark, pvalues):
    got = {(r.lr_ix, r.src, r.tgt): (pytest.approx(r.prob, abs=1e-6), r.pval) for r in catalog._seen(spark, SF).collect()}
    assert {k: p for k, (_, p) in got.items()} == {k: pytest.approx(p) for k, (_, p) in pvalues.items()}
    want = {}
    for (_, src, tgt), (prob, p) in pvalues.items():
        n, w = want.get((src, tgt), (0, 0.0))
        want[src, tgt] = (n + (prob > 0 and p < 0.05), w + (prob if p < 0.05 else 0))
    flagship = {(r.src, r.tgt): (r["count"], r.weight) for r in catalog.queries()["aggregate_net"](spark, SF).collect()}
    assert flagship == {k: (n, pytest.approx(w, abs=1e-4)) for k, (n, w) in want.items()}


def test_graphs_are_of_all_pairs(spark, monkeypatch):
    groups = ["A", "BB", "CCC", "DDDD"]
    rows = [(k, f"p{k}", s, t, (i + 1) * (j + 2) * k / 50) for k in (1, 2) for i, s in enumerate(groups) for j, t in enumerate(groups)]
    netp = spark.createDataFrame(rows, "pathway_ix int, pathway_name string, src string, tgt string, prob double").persist()
    sets = netp.selectExpr("pathway_ix - 1 AS dataset", "'p' AS pathway_name", "src", "tgt", "prob").persist()
    monkeypatch.setattr(catalog, "_netp", lambda *_: netp)
    monkeypatch.setattr(catalog, "_dataset_pathways", lambda *_: sets)
    whole = {
        "centrality": graph.centrality(netp), "similarity_functional": graph.functional_similarity(netp), "similarity_structural": graph.structural_similarity(netp),
        "nmf_patterns": learn.patterns(netp, 2), "similarity_pairwise": graph.similarity_between(sets),
    }
    for name, want in whole.items():
        assert sorted(map(str, catalog.queries()[name](spark, SF).collect())) == sorted(map(str, catalog._rounded(want).collect())), name


def test_all_scores_are_imported(spark, monkeypatch):
    lr = catalog._lr(spark)
    seen = lr.selectExpr("lr_ix", "'BUILDING' AS src", "'MACHINERY' AS tgt", "0.5D AS prob", "0.0D AS pval").persist()
    monkeypatch.setattr(catalog, "_seen", lambda *_: seen)
    assert {r.lr_ix for r in catalog.queries()["score_import"](spark, SF).collect()} == {r.lr_ix for r in lr.collect()}


def test_registered_with_the_operators_defaults(spark, pvalues, monkeypatch):
    got = {(r.lr_ix, r.src, r.tgt): r.pval for r in catalog.queries()["commun_pval"](spark, SF).collect()}
    assert got == {k: pytest.approx(p) for k, (_, p) in pvalues.items()}
    asked = []
    monkeypatch.setattr(learn, "smooth", lambda expr, edges, alpha=0.5, by="rows": asked.append((alpha, by)) or expr)
    catalog.queries()["smooth"](spark, SF)
    assert asked == [(0.5, "rows")]
