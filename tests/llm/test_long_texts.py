"""Texts of several megabytes through the operators that have no such test of their own."""

import numpy as np

from pvlens.llm import pii, quality, repeats, sharding, simhash
from tests.llm.test_simhash import fingerprint

LONG = " ".join(f"{i}" + "x" * 30_000 for i in range(100))
MAIL = "one two " * 400_000 + "mail a.b@example.org now"


def frame(spark):
    return spark.createDataFrame([(1, LONG), (2, LONG), (3, MAIL), (4, "short")], "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sharding(spark, odd):
    rows = by_id(sharding.place_documents(frame(spark), 40))
    assert rows[1]["size"] == rows[2]["size"] == len(LONG) + 16 and rows[1]["text_crc32"] == rows[2]["text_crc32"]


def test_personal_data(spark, odd):
    spans = by_id(pii.find_spans(frame(spark)))[3]["pii"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("email", len(MAIL) - 19, len(MAIL) - 4)]


def test_simhash(spark, odd):
    rows = by_id(simhash.near_duplicates(frame(spark)))
    assert rows[1]["component"] == rows[2]["component"] == 1
    assert rows[1]["fingerprint"] % 2**64 == fingerprint(LONG)


def test_repeats(spark, odd):
    rows = by_id(repeats.remove_repeats(frame(spark)))
    assert (rows[1]["n_removed"], rows[2]["n_removed"], rows[2]["n_words"]) == (0, 100, 100)
    assert rows[3]["n_removed"] == 0 and rows[3]["n_words"] == 800_003


def test_quality(spark, odd):
    machine = quality.fit([], np.zeros(0, np.float32))
    rows = by_id(quality.score_documents(frame(spark), machine))
    assert {r["score"] for r in rows.values()} == {0.5}
