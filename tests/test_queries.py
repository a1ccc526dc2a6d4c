"""Every registered query against its DuckDB oracle on the smallest fixture
(the same comparison the correctness gate makes)."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from pvlens.sources.tables import TABLES
from scripts.check_oracles import digest

SF = "/root/testdata/sf0.001"
QS = queries()
ORACLES = oracle_sql()


# What is known of results that SQL cannot state: the rows they must have, and a
# test of each row.
ROWS = {
    "severity_model_predictions": (
        f"SELECT VAERS_ID FROM ({ORACLES['severity_split']}) WHERE split = 'validation'", "VAERS_ID",
        lambda r: r["prediction"] in (0, 1, 2) and r["label"] in (0, 1, 2)),
    "embedding_clusters": ("SELECT vec_id FROM embeddings", "vec_id", lambda r: 0 <= r["cluster"] < 8),
}


def check(con, columns, rows, sql, key, holds):
    expected = sorted(r[0] for r in con.execute(sql).fetchall())
    rows = [dict(zip(columns, r)) for r in rows]
    assert sorted(r[key] for r in rows) == expected
    assert all(holds(r) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["symptom", "n_docs"]
    assert 0 < df.count() <= 10


@pytest.mark.parametrize("name", sorted(QS))
def test_query_matches_oracle(spark, con, name):
    sdf = QS[name](spark, SF)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLES:
        assert srows and len(scols) == len(set(scols))
        if name in ROWS:
            check(con, scols, srows, *ROWS[name])
        return
    rel = con.execute(ORACLES[name])
    dcols = [d[0] for d in rel.description]
    drows = [tuple(r) for r in rel.fetchall()]
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(srows, scols)[0] == digest(drows, dcols)[0]
