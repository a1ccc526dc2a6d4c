import numpy as np
import pytest

from pvlens.llm import decontamination as dc


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def holds(text, item):
    return f" {' '.join(dc.terms(item))} " in f" {' '.join(dc.terms(text))} "


def test_query(spark, sf, texts, benchmark):
    from pvlens.llm.queries import QUERIES
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    whole = {(d, i) for i, item in items.items() for d, t in texts.items() if holds(t, item)}
    rows = QUERIES["op4_decontamination"](spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == whole and whole
    assert all(r["score"] >= dc.THRESHOLD for r in rows)


def test_wand_finds_all_above_threshold(benchmark):
    index = dc.unpack(dc.index_table(benchmark).first()["index"])
    items = [r["text"] for r in benchmark.collect()]
    random, found = np.random.default_rng(0), 0
    for _ in range(200):
        query = set(random.integers(0, len(index.number), random.integers(1, 120)).tolist())
        query |= {index.number[t] for t in dc.terms(items[random.integers(len(items))])[:random.integers(1, 40)]}
        scores = np.zeros(len(index.item))
        for t in query:
            rows = slice(index.bounds[t], index.bounds[t + 1])
            scores[index.pieces[rows]] += index.impacts[rows]
        for threshold in (0.1, 0.5, 0.9):
            expected = np.flatnonzero(scores >= threshold - 1e-9).tolist()
            got = dict(dc.block_max_wand(sorted(query), index, threshold))
            assert sorted(got) == expected
            assert np.allclose([got[p] for p in expected], scores[expected])
            found += len(expected)
    assert found > 200


def test_edited_and_partial_passages(spark, benchmark):
    items = [r["text"] for r in benchmark.orderBy("item_id").collect()]
    noise = " ".join(f"zz{i}" for i in range(400))
    long = items[0].split()
    edited = " ".join("changed" if i % 12 == 5 else w.upper() for i, w in enumerate(long))
    docs = [(0, f"{noise} {items[0]} {noise}"), (1, f"{noise} {edited}"), (2, noise), (3, " ".join(long[:len(long) // 4])),
            (4, f"{items[1]} {noise} {items[2]}"), (5, None), (6, "")]
    rows = dc.with_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in rows}
    assert got == {0: [0], 1: [0], 2: [], 3: [], 4: [1, 2], 5: [], 6: []}


def test_shards_find_the_same(spark, sf, benchmark, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in dc.with_leaks(docs, benchmark).collect()}
    monkeypatch.setattr(dc, "SHARD_ROWS", 16)
    assert dc.index_table(benchmark).count() > 2
    parts = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in dc.with_leaks(docs, benchmark).collect()}
    assert whole == parts


def test_rounds_find_the_same(spark, sf, odd, empty, benchmark, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = {r["doc_id"]: r["leaks"] for r in dc.with_leaks(docs, benchmark).collect()}
    monkeypatch.setattr(dc, "SHARD_ROWS", 8)
    shards = dc.index_table(benchmark)
    sizes = {r["shard"]: len(r["index"]) for r in shards.collect()}
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 2 * max(sizes.values()))
    dealt = dc.rounds(shards)
    assert len(dealt) > 1 and [s for mine in dealt for s in mine] == sorted(sizes)
    assert all(sum(sizes[s] for s in mine) <= dc.BROADCAST_BYTES for mine in dealt)
    parts = {r["doc_id"]: r["leaks"] for r in dc.with_leaks(docs, benchmark).collect()}
    assert any(whole.values()) and whole.keys() == parts.keys()
    for doc, leaks in whole.items():
        assert [x["item_id"] for x in leaks] == [x["item_id"] for x in parts[doc]]
        assert np.allclose([x[1:] for x in leaks], [x[1:] for x in parts[doc]])
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 1)  # a shard is never cut
    assert dc.rounds(shards) == [[s] for s in sorted(sizes)]
    assert dc.with_leaks(odd, benchmark, out="score").count() == odd.count()
    assert dc.with_leaks(empty, benchmark).count() == 0


def test_shards_are_those_of_the_whole(spark, benchmark, monkeypatch):
    """Impacts do not depend on the shard, and no piece is lost."""
    def impacts():
        out = {}
        for r in dc.index_table(benchmark).collect():
            index = dc.unpack(r["index"])
            term_of = np.repeat(np.arange(len(index.number)), np.diff(index.bounds))
            names = sorted(index.number)
            for t, p, w in zip(term_of, index.pieces, index.impacts):
                out.setdefault((index.item[p][1], names[t]), []).append(round(float(w), 12))
        return {k: sorted(v) for k, v in out.items()}
    whole = impacts()
    monkeypatch.setattr(dc, "SHARD_ROWS", 10)
    assert impacts() == whole


def test_long_items_and_odd_rows(spark, odd, empty, benchmark):
    long = " ".join(f"w{i}" for i in range(300)) + ". the answer is here"
    items = spark.createDataFrame([(1, long), (2, None), (None, "some words here"), (3, ""), (4, "a a a")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 500 + long + " y" * 500), (2, "a a a"), (3, "b")], "doc_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in dc.with_leaks(docs, items).collect()}
    assert got == {1: [1], 2: [4], 3: []}
    assert dc.with_leaks(odd, benchmark, out="score").count() == odd.count()
    assert dc.with_leaks(empty, benchmark).count() == 0
    assert all(r["leaks"] == [] for r in dc.with_leaks(odd, benchmark.limit(0)).collect())


@pytest.mark.parametrize("shard_rows", [1024, 2])
def test_repeated_and_missing_ids(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(dc, "SHARD_ROWS", shard_rows)
    texts = [" ".join(f"{a}{i}" for i in range(30)) + f". the {a} answer" for a in "pqrstu"]
    items = spark.createDataFrame(list(zip([1, 1, None, None, 2, 2], texts)), "item_id long, text string")
    docs = [(n, f"noise {t} noise") for n, t in enumerate(texts)] + [(6, " ".join(texts)), (7, "noise")]
    rows = dc.with_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in rows}
    assert got == {0: [1], 1: [1], 2: [None], 3: [None], 4: [2], 5: [2], 6: [1, 1, 2, 2, None, None], 7: []}


def test_parts_of_items(spark):
    words = [f"w{i}" for i in range(330)]
    long = " ".join(words) + ". the answer is here"
    question = " ".join(f"q{i}" for i in range(20))
    short = f"{question}. first second third fourth"
    noise = " ".join(f"zz{i}" for i in range(150))
    far = f"{question.replace('q9', 'other')} {noise} {noise} first second third fourth"
    docs = [(0, f"{noise} {' '.join(words[128:192])} {noise}"), (1, f"{noise} {question} {noise}"), (2, far),
            (3, f"{noise} the answer is here {noise}"), (4, f"{noise} {' '.join(words[135:165])} {noise}"),
            (5, f"{noise} {' '.join(words[-60:])} the answer is here {noise}"), (6, short), (7, long)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")

    def found(*items):
        rows = dc.with_leaks(docs, spark.createDataFrame(list(items), "item_id long, text string")).collect()
        return {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in rows}
    both = found((1, long), (2, short))
    assert both == {0: [1], 1: [2], 2: [], 3: [], 4: [], 5: [1], 6: [2], 7: [1]}
    alone = found((2, short))
    assert {d: [i for i in x if i == 2] for d, x in both.items()} == alone


def test_many_items_are_one_python_stage(spark, odd, monkeypatch):
    monkeypatch.setattr(dc, "SHARD_ROWS", 20)
    texts = [f"what is the {i} of {i * 7} and {i * 13} in question {i}? it is {i * 3} of {i}" for i in range(100)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"noise {t} noise", "clash") for i, t in enumerate(texts[:30])],
                                 "doc_id long, text string, leaks string")
    found = dc.with_leaks(docs, items)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert all(r["doc_id"] in [x["item_id"] for x in r["leaks"]] for r in found.collect())


def test_equal_scores_and_a_long_text(spark, odd):
    item = "which river runs through the old town? the green river runs there"
    noise = " ".join(f"zz{i}" for i in range(400_000))
    items = spark.createDataFrame([(1, item), (2, item), (3, "lonely")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{item} {noise} {item}"), (2, "lonely"), (3, "lone ly")], "doc_id long, text string")
    got = {r["doc_id"]: [(x["item_id"], round(x["score"], 6)) for x in r["leaks"]] for r in dc.with_leaks(docs, items).collect()}
    assert got == {1: [(1, 1.0), (2, 1.0)], 2: [(3, 1.0)], 3: []}
