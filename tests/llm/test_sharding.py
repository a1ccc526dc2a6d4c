import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from pvlens.llm.sharding import Shard, place, place_documents, topology


def test_query(query, texts):
    rows = query("op1_sharding")
    assert set(rows) == set(texts)
    slots = {}
    for i, r in rows.items():
        raw = texts[i].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_draws_are_the_hash_of_key_and_name(spark):
    """One level by hand: the least -ln(u) / weight wins."""
    import math
    shards = [Shard(0, 0, s, w) for s, w in enumerate((1.0, 2.0, 5.0))]
    got = [r[0] for r in spark.range(200).select(place(F.col("id"), shards)).collect()]

    def draw(key, s):
        seed = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
        h = xxhash.xxh64_intdigest(f"0/0/0/{s.shard}".encode(), seed)
        return -math.log(((h >> 11) + 0.5) / 2 ** 53) / s.weight
    assert got == [min(shards, key=lambda s: draw(k, s)).shard for k in range(200)]


def test_weights_and_growth(spark):
    keys = spark.range(40_000)
    before = [Shard(0, 0, 0, 1.0), Shard(0, 1, 1, 3.0), Shard(1, 0, 2, 4.0)]
    counts = {r["s"]: r["n"] for r in keys.groupBy(place(F.col("id"), before).alias("s")).agg(
        F.count("*").alias("n")).collect()}
    assert [round(counts[s] / 5000) for s in range(3)] == [1, 3, 4]
    # more weight for a shard: rows move only into its subtree
    after = before + [Shard(0, 1, 1, 3.0, epoch=1)]
    moves = keys.select(place(F.col("id"), before).alias("a"), place(F.col("id"), after).alias("b")).where("a != b")
    assert {r["b"] for r in moves.distinct().collect()} == {1}
    for n in (1, 7, 40, 43):
        base = min(n, 40)
        moved = keys.select(place(F.col("id"), topology(n, base)).alias("a"),
                            place(F.col("id"), topology(n + 1, base)).alias("b"))
        assert {r["b"] for r in moved.where("a != b").distinct().collect()} == {n}


def test_odd_rows(odd, empty):
    rows = place_documents(odd, 5).collect()
    assert len(rows) == odd.count()
    for s in {r["shard"] for r in rows}:
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    null = [r for r in rows if r["size"] == 16]
    assert null and all(r["text_crc32"] == 0 for r in null)
    assert place_documents(empty, 5).collect() == []
    assert place_documents(odd, 5).columns == ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]


@pytest.mark.parametrize("name", ["op1_sharding", "op8_pii"])
def test_no_python_in_native_plans(spark, sf, name):
    from pvlens.llm.queries import QUERIES
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
