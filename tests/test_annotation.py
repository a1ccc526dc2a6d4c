import pytest
from pyspark.sql import functions as F

from pvlens.functions.lexicons import ANNOTATION_RULES
from pvlens.operators import annotation as A
from pvlens.operators.entities import all_mentions

DEMO = "Patient experienced severe headache and nausea after taking 50mg of ibuprofen twice daily for 3 days."


def test_all_mentions_repeats(spark):
    df = spark.createDataFrame([("fever, headache, then fever again",)], "text string")
    got = df.select(all_mentions(F.col("text"), [("SYMPTOM", "fever"), ("SYMPTOM", "headache")]).alias("m")).first()["m"]
    assert [(m["text"], m["start"], m["end"]) for m in got] == [
        ("fever", 0, 5), ("fever", 22, 27), ("headache", 7, 15)]


def test_pattern_mentions_demo(spark):
    df = spark.createDataFrame([(DEMO,)], "text string")
    got = df.select(A.pattern_mentions(F.col("text")).alias("m")).first()["m"]
    spans = [(m["type"], m["text"], m["start"], m["end"]) for m in got]
    assert spans == [("DOSAGE", "50mg", 60, 64), ("DURATION", "for 3 days", 90, 100),
                     ("FREQUENCY", "twice daily", 78, 89)]
    for _, text, s, e in spans:
        assert DEMO.lower()[s:e] == text


def test_bio_tags_overwrite_and_length(spark):
    df = spark.createDataFrame([("abcdefgh", [("X", 1, 4, ""), ("Y", 3, 20, "")])],
                               "text string, spans array<struct<label:string,start:int,end:int,text:string>>")
    tags = df.select(A.bio_tags(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert tags == ["O", "B-X", "I-X", "B-Y", "I-Y", "I-Y", "I-Y", "I-Y"]
    assert len(tags) == len("abcdefgh")


def test_export_round_trip_skips_empty(spark):
    df = spark.createDataFrame(
        [(1, "fever here", [("SYMPTOM", 0, 5, "fever")]), (2, "", [("SYMPTOM", 0, 1, "x")]), (3, "none", [])],
        "id long, text string, spans array<struct<label:string,start:int,end:int,text:string>>")
    back = A.from_export(A.to_export(df, "text", "spans", keys=["id"]), ["id"])
    assert [r["id"] for r in back.collect()] == [1]


def test_qa_checks(spark):
    text = "Pt reported severe headache for 2 days and nausea and vomiting."
    spans = [("SYMPTOM", 19, 27, "headache"), ("SYMPTOM", 19, 38, "headache for 2 days"),
             ("SYMPTOM", 43, 62, "nausea and vomiting"), ("SYMPTOM", 0, 16, "not feeling well")]
    df = spark.createDataFrame([(1, text, spans)],
                               "id long, text string, spans array<struct<label:string,start:int,end:int,text:string>>")
    rows = A.explode_spans(df, ["id"])
    assert [r["ann_idx"] for r in rows.filter(A.slice_mismatch(rows)).collect()] == [3]
    assert [r["ann_idx"] for r in rows.filter(A.time_in_span()).collect()] == [1]
    assert sorted(r["ann_idx"] for r in rows.filter(A.modifier_left_out()).collect()) == [0, 1]
    assert [r["ann_idx"] for r in rows.filter(A.compound_span()).collect()] == []
    assert [r["reason"] for r in A.skip_list_hits(rows).collect()] == ["vague"]
    assert [r["ann_idx"] for r in A.overlapping_spans(rows, ["id"]).collect()] == [1]


@pytest.mark.parametrize("text,expected", [
    ("COVID-19 infection after vaccination", "infection"),
    ("tested positive for COVID-19", "infection"),
    ("Moderna COVID-19 vaccine given", "vaccine name"),
    ("History of COVID-19 last year", "history"),
    ("Exposed to COVID-19 positive person", "exposure"),
    ("Tested negative for COVID-19", "negative test"),
    ("headache only", None),
])
def test_covid_disposition(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(A.covid_disposition(F.col("t")).alias("d")).first()["d"] == expected


def test_metrics(spark):
    df = spark.createDataFrame([("mild", "mild"), ("severe", "mild"), ("severe", "severe"), ("moderate", "severe")],
                               "g string, p string")
    m = A.classification_metrics(df, "g", "p").first()
    assert m["accuracy"] == 0.5
    # per class P: mild 1/2, moderate 0, severe 1/2; R: mild 1, moderate 0, severe 1/2
    assert m["macro_precision"] == pytest.approx((0.5 + 0 + 0.5) / 3)
    assert m["macro_recall"] == pytest.approx((1 + 0 + 0.5) / 3)


def test_gold_mentions_cover_rules(spark, sf):
    from pvlens.plans.q_annotation import annotated_reports
    a = annotated_reports(spark, sf)
    gold = a.select(F.explode("gold").alias("s")).select("s.label").distinct().collect()
    assert {r["label"] for r in gold} <= {t for t, _ in ANNOTATION_RULES}


def tags_by_hand(text, spans):
    tags = ["O"] * len(text)
    for label, start, end in spans:
        if start is None or end is None:
            continue
        for i in range(max(start, 0), min(max(end, start + 1), len(text))):
            if i == start or i < min(end, len(text)):
                tags[i] = ("B-" if i == start else "I-") + label
    return tags


def test_bio_tags_of_random_spans(spark):
    """Overlapping, empty, late and unbounded spans against a loop over them."""
    import random
    rng = random.Random(4)
    rows = []
    for n in range(60):
        text = "x" * rng.randint(0, 40)
        spans = [(rng.choice("AB"), rng.choice([None, *range(-2, 45)]), rng.choice([None, *range(0, 60)]))
                 for _ in range(rng.randint(0, 8))]
        rows.append((n, text, spans))
    df = spark.createDataFrame(rows, "n int, text string, spans array<struct<label:string,start:int,end:int>>")
    got = {r["n"]: r["tags"] for r in df.select("n", A.bio_tags(F.col("text"), F.col("spans")).alias("tags")).collect()}
    assert got == {n: tags_by_hand(t, s) for n, t, s in rows}


def test_bio_tags_of_many_spans_are_quick(spark):
    import time
    spans = [("S", 10 * i, 10 * i + 7) for i in range(4000)]
    df = spark.createDataFrame([("y" * 40_000, spans)], "text string, spans array<struct<label:string,start:int,end:int>>")
    out = df.select(F.size(A.bio_tags(F.col("text"), F.col("spans"))).alias("n"))
    out.collect()
    began = time.time()
    assert out.collect()[0]["n"] == 40_000
    assert time.time() - began < 5


def test_span_text_where_lower_case_is_longer(spark):
    df = spark.createDataFrame([("\u0130\u0130 Fever",)], "t string")
    got = df.select(A.mention_spans(F.col("t"), [("SYMPTOM", "fever")]).alias("s")).first()["s"]
    assert [(x["start"], x["end"], x["text"]) for x in got] == [(3, 8, "Fever")]


def test_ner_dataset_finds_annotations_once(spark):
    """The search for the cut reads written documents; it does not annotate again."""
    from pvlens.operators import annotation as A
    df = spark.createDataFrame([(i, "rash " * (i % 3)) for i in range(30)], "id long, text string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text
    one = F.struct(F.lit("S").alias("label"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("rash").alias("text"))
    annotated = df.select("id", seen("text").alias("text"), F.array(one).alias("spans"))
    rows = A.ner_dataset(annotated, ["id"], limit=4).collect()
    assert sorted(r["id"] for r in rows) == [i for i in range(30) if i % 3]
    assert [r["split"] for r in sorted(rows)] == ["train"] * 16 + ["validation"] * 4
    assert calls.value <= 60
