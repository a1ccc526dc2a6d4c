import zlib

import numpy as np

from pvlens.llm import quality as q


def test_query(spark, sf, query, texts):
    rows = query("op10_quality")
    assert set(rows) == set(texts)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i in labels if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) >= 0.9


def test_larger_fixture():
    """Held-out accuracy and ranking where there are enough labels to tell."""
    import duckdb
    path = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select text, quality, doc_id from read_parquet('{path}/documents.parquet') d join "
                      f"read_parquet('{path}/labels.parquet') l using (doc_id) order by doc_id").fetchall()
    held = np.array([zlib.crc32(str(r[2]).encode()) % 5 == 0 for r in rows])
    texts, labels = [r[0].encode() for r in rows], np.array([r[1] for r in rows], np.float32)
    text, at, value = q.inputs(texts)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    pairs = [(at[a:b], value[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    machine = q.fit([p for p, h in zip(pairs, held) if not h], labels[~held])
    scores = machine.score(texts)[held]
    good, bad = scores[labels[held] == 1], scores[labels[held] == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert ((scores >= q.THRESHOLD) == (labels[held] == 1)).mean() > 0.95


def test_linear_time_interactions():
    random = np.random.default_rng(0)
    machine = q.Machine(0.1, random.normal(size=q.INPUTS), random.normal(size=(q.INPUTS, 3)) / 4)
    texts = [b"", b"a b a c", b"Upper LOWER 12 !!! $$$\nline", b"w " * 40]
    text, at, value = q.inputs(texts)
    for i, score in enumerate(machine.score(texts)):
        a, v = at[text == i], value[text == i]
        raw = 0.1 + sum(machine.linear[x] * y for x, y in zip(a, v))
        raw += sum(machine.factors[a[m]] @ machine.factors[a[n]] * v[m] * v[n]
                   for m in range(len(a)) for n in range(m))
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-6


def test_few_labels_and_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in q.score_documents(odd, q.train(odd, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (4, None), (4, 7)], "doc_id long, quality int")
    scored = q.score_documents(odd, q.train(odd, one))  # replaces the column "score"
    assert sorted(scored.columns) == sorted(odd.columns) and scored.count() == odd.count()
    assert all(0.5 < r["score"] < 1 for r in scored.collect())
    assert q.score_documents(empty, q.train(empty, one)).count() == 0


def test_sample_is_bounded_and_leaves_out_held_rows(spark, odd):
    from pyspark.sql import functions as F
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    original, q.fit = q.fit, lambda rows, labels: seen.append(len(rows)) or original(rows, labels)
    try:
        q.train(docs, labels, rows=50)
        q.train(docs, labels)
    finally:
        q.fit = original
    kept = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400))
    assert seen == [50, kept]


def test_repeated_ids_count_once(spark, monkeypatch):
    seen = []
    fit = q.fit
    monkeypatch.setattr(q, "fit", lambda pairs, labels: seen.append((len(pairs), sorted(labels.tolist()))) or fit(pairs, labels))
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:10]
    hot = free[0]
    docs = [(i, f"text {i}") for i in free] + [(hot, f"other {n}") for n in range(500)]
    labels = [(i, n % 2) for n, i in enumerate(free)] + [(hot, 0)] * 50 + [(hot, 1)] * 50
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    machine = q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    again = q.train(docs.orderBy(docs.text.desc()), spark.createDataFrame(labels[::-1], "doc_id long, quality int"))
    q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), rows=10)
    assert seen == [(10, [0.0] * 5 + [1.0] * 5)] * 3
    assert machine.bias == again.bias and np.array_equal(machine.linear, again.linear)
