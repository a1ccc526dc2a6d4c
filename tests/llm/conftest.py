import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

# Texts that every operator has to take: nothing, blanks, marks, long runs, repeats.
ODD = [None, "", " ", "\t\n ", "a", "one two", "Word " * 3000, "x" * 70_000, "日本語 テキスト 漢字" * 40,
       "a  b   c\n\nd \n e ", "\U0001F600 emoji é ﬁ", "0 1 2 3 " * 500, "same text here", "same text here"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows: null id, repeated id, extra columns whose names operators use themselves."""
    from pvlens.llm.catalog import ship
    ship(spark)
    rows = [(None if i == 3 else i // 2 * 2, t, "clash", float(i)) for i, t in enumerate(ODD)]
    return spark.createDataFrame(
        rows + rows[:2], "doc_id long, text string, fingerprint string, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(sf):
    """All documents of the smallest fixture by id."""
    return dict(duckdb.sql(
        f"select doc_id, text from read_parquet('{sf}/documents.parquet')").fetchall())


@pytest.fixture(scope="session")
def query(spark, sf):
    """Rows of a registered query by doc_id."""
    from pvlens.llm.queries import QUERIES

    def run(name):
        return {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}
    return run
