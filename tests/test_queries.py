import math

import duckdb
import pytest

from dyadloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["norm_log1p", "avg_tri", "avg_truncated", "kb_extract_genes", "commun_prob", "aggregate_net", "pathway_prob", "subset_comm", "pairwise_rank", "rank_net", "wilcox_w", "knn_topk", "contact_overlap", "commun_prob_contact", "rank_net_test", "de_datasets", "kb_gene_subset", "smooth"])
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert ordered(df.collect(), df.columns) == ordered(want.fetchall(), columns)


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
