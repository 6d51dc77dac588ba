import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
NAMES = ["topk_ip", "topk_jensen_shannon", "batch_topk_ip", "where_contains", "bm25_selective", "hybrid_weighted", "sparse_topk", "sq8_encode", "spann_topk_full_probe", "upsert", "range_deleted", "batch_l2", "batch_cosine", "batch_l1", "packed_jaccard", "bm25_stored", "json_terms", "mass_statistics", "recall_pq_batch", "collection_index", "collection_upsert", "collection_sparse"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
