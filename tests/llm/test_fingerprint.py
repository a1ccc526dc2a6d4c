import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from pvlens.llm import fingerprint as fp


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query(query, texts):
    rows, order = query("op2_fingerprints"), sorted(texts, reverse=True)
    assert set(rows) == set(texts)
    errors = []
    for i, following in zip(order, order[1:] + order[:1]):
        text, n = texts[i], len(texts[i]) // 3
        edited = text[:len(text) - n] + texts[following][:n]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r["near_edited"] - jaccard(shingles(text), shingles(edited)),
                   r["near_next"] - jaccard(shingles(text), shingles(texts[following]))]
        if len(shingles(text) | shingles(edited)) <= fp.K:
            assert abs(errors[-2]) < 1e-12  # exact below K
        assert r["fingerprint"] == fp.as_text(fp.sketches([text.encode()])[0])
    assert np.abs(errors).max() < 0.15 and np.abs(errors).mean() < 0.02


def test_sketches_merge_and_estimate():
    random = np.random.default_rng(1)
    words = [str(w) for w in random.integers(0, 10**6, 9000)]
    a, b = " ".join(words[:6000]), " ".join(words[3000:])
    one, two = fp.sketches([a.encode(), b.encode()])
    parts = fp.sketches([" ".join(words[s:s + 1004]).encode() for s in range(0, 6000, 1000)])
    merged = parts[0]
    for p in parts[1:]:
        merged = fp.merge(merged, p)
    true_a, true_b = shingles(a), shingles(b)
    assert abs(fp.distinct_count(merged) / len(true_a) - 1) < 0.2
    assert abs(fp.resemblance(one, two) - jaccard(true_a, true_b)) < 0.1
    assert abs(fp.containment(one, two) - len(true_a & true_b) / len(true_a)) < 0.15


def test_merged_groups(spark, odd):
    docs = spark.createDataFrame([(i % 3 or None, f"a b c d e f {i // 4} g h") for i in range(90)], "g int, text string")
    got = {r["g"]: r["sketch"] for r in fp.merge_sketches(fp.with_sketch(docs), "g").collect()}
    for g in (None, 1, 2):
        own = [f"a b c d e f {i // 4} g h" for i in range(90) if (i % 3 or None) == g]
        expected = np.zeros(0, np.uint64)
        for s in fp.sketches([t.encode() for t in own]):
            expected = fp.merge(expected, s)
        assert got[g] == expected.tolist()


def test_odd_rows(spark, odd, empty):
    rows = fp.compare_neighbours(odd).collect()
    assert len(rows) == odd.count() and fp.compare_neighbours(empty).count() == 0
    blank = [r for r in rows if r["n_chars"] == 0]
    assert blank and all(r["near_edited"] == 1.0 and r["fingerprint"] == "" for r in blank)
    alone = fp.compare_neighbours(spark.createDataFrame([(7, "a b c")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"a b ca"[:4] + b"a").hexdigest()
    for parts in (1, 3, 50):
        dealt = fp.with_next(odd.selectExpr("doc_id as key", "text"), parts).where("guest = 0")
        assert dealt.agg({"n": "sum"}).first()[0] == odd.count()


def test_a_key_on_a_third_of_all_rows(spark, odd):
    """Null on a third of the rows with as many texts, an id on another with one."""
    rows = [(None, f"hot words of text number {i} and more of it") for i in range(2000)]
    rows += [(5, "the same words in each of these")] * 2000 + [(i, f"cold words of text {i} here") for i in range(10, 2010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    dealt = fp.with_next(docs.selectExpr("doc_id as key", "text"), 8)
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count("*").alias("rows"), F.sum("guest").alias("guests")).collect()
    assert len(sizes) >= 6 and max(r["rows"] for r in sizes) <= 2 * 4000 / 6
    assert all(r["guests"] <= 6 for r in sizes)  # of copies, one from each batch
    order = docs.withColumn("h", F.xxhash64("text")).orderBy(
        F.desc_nulls_last("doc_id"), F.desc("h")).collect()
    wanted = []
    for r, following in zip(order, order[1:] + order[:1]):
        n = len(r["text"]) // 3
        wanted.append((r["doc_id"] or 0, hashlib.sha256((r["text"][:len(r["text"]) - n] + following["text"][:n]).encode()).hexdigest()))
    got = [(r["doc_id"] or 0, r["edited_sha256"]) for r in fp.compare_neighbours(docs).collect()]
    assert sorted(got) == sorted(wanted)


def test_a_text_of_several_megabytes(spark, odd):
    long = " ".join(f"word{i % 5000}" for i in range(400_000))
    docs = spark.createDataFrame([(2, long), (1, "a b c d e f"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fp.compare_neighbours(docs).collect()}
    assert rows[2]["n_chars"] == len(long) and abs(rows[2]["distinct_shingles"] / 5000 - 1) < 0.25
    assert rows[3]["near_next"] == 0.0 and rows[1]["n_chars"] == 11
