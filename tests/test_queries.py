"""Registered queries against their SQL on the smallest tables, if they are there."""

import os

import pytest

from spoorline.registry import all_oracles, all_queries
from spoorline.sources.tables import TABLES

FOLDER = os.environ.get("SPOORLINE_TABLES", "/root/testdata/sf0.001")
CHECKED = [
    "e01_access_then_transfer", "p03_statement_facts", "a09_confusion", "a14_tuned_theta",
    "d01_family_disjoint_split", "d09_dimension_predicts_class", "j18_first_statement_leakage", "r08_idle_sessions",
    "s04_label_csv", "w05_prefix_behaviors",
]


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = con.execute(all_oracles()[name])
    columns = [c[0] for c in cur.description]
    df = all_queries()[name](spark, FOLDER)
    assert set(df.columns) == set(columns)

    def plain(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_d09_has_every_dimension(spark):
    from spoorline.plans.quality import DIMENSIONS

    rows = all_queries()["d09_dimension_predicts_class"](spark, FOLDER).collect()
    sessions = 2 * spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    for x in DIMENSIONS:
        assert sum(r.benign + r.malicious for r in rows if r.dimension == x) == sessions, x
