"""Hand-derived goldens for the rule models."""

import pytest
from pyspark.sql import functions as F

from pvlens.operators.batch import analyze, result_table
from pvlens.operators.entities import extract_entities, highlight
from pvlens.operators.explain import word_weights
from pvlens.operators.severity import classify_severity, severity_label
from pvlens.operators.symptoms import cluster_groups, cluster_list

T1 = "Patient experienced severe headache and nausea after taking ibuprofen."
T2 = "The patient developed a severe rash and difficulty breathing after taking amoxicillin."
T3 = "Two days after receiving the vaccine, the patient reported mild fever and fatigue."


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("x")).first()["x"]


def test_entities_first_sentence(spark):
    ents = one(spark, T1, extract_entities(F.col("text")))
    assert [(e["type"], e["text"], e["start"], e["end"]) for e in ents] == [
        ("DRUG", "ibuprofen", 60, 69), ("SYMPTOM", "headache", 27, 35),
        ("SYMPTOM", "nausea", 40, 46), ("SEVERITY", "severe", 20, 26)]


def test_entities_second_and_third(spark):
    ents = one(spark, T2, extract_entities(F.col("text")))
    assert [(e["type"], e["text"], e["start"], e["end"]) for e in ents] == [("SEVERITY", "severe", 24, 30)]
    ents = one(spark, T3, extract_entities(F.col("text")))
    assert [(e["type"], e["text"]) for e in ents] == [("SYMPTOM", "fever"), ("SEVERITY", "mild")]


def test_classifier(spark):
    r = one(spark, T1, classify_severity(F.col("text")))
    assert r["severity"] == "severe" and r["confidence"] == 0.9
    assert r["probabilities"]["severe"] == 0.9 / (0.1 + 0.1 + 0.9)
    assert sum(r["probabilities"].values()) == pytest.approx(1.0)
    r = one(spark, T3, classify_severity(F.col("text")))
    assert (r["severity"], r["confidence"]) == ("mild", 0.9)
    r = one(spark, "nothing to see", classify_severity(F.col("text")))
    assert (r["severity"], r["confidence"]) == ("mild", 0.7)
    assert r["probabilities"]["mild"] == 0.7 / (0.7 + 0.1 + 0.1)


def test_labeller_and_classifier_disagree_on_precedence(spark):
    t = "following a severe fever"
    assert one(spark, t, severity_label(F.col("text"))) == "mild"  # 'low' in 'following'
    assert one(spark, t, classify_severity(F.col("text"))["severity"]) == "severe"
    assert one(spark, "no keyword here", severity_label(F.col("text"))) == "unknown"


def test_word_weights(spark):
    w = one(spark, T1, word_weights(F.col("text"), F.lit("severe")))
    sev = [(f["feature"], f["weight"]) for f in w["severe"]]
    assert [x for x, _ in sev] == ["Patient", "experienced", "severe", "headache", "and"]
    assert [round(v, 10) for _, v in sev] == [0.5, 0.4, 0.3, 0.2, 0.1]
    assert [round(f["weight"], 10) for f in w["mild"]] == [-0.3, -0.25, -0.2, -0.15, -0.1]


def test_symptom_clusters(spark):
    groups = one(spark, T1, cluster_groups(F.array(F.lit("headache"), F.lit("nausea"))))
    assert groups == {0: ["headache"], 1: ["nausea"]}
    assert one(spark, T1, cluster_groups(F.array().cast("array<string>"))) is None
    pts = one(spark, T1, cluster_list(F.array(*[F.lit(s) for s in "abcd"])))
    assert [p["cluster"] for p in pts] == [0, 1, 2, 0]
    assert pts[0]["x"] == pytest.approx(0.9) and pts[0]["y"] == pytest.approx(0.5)


def test_batch_result_absent_clusters(spark):
    df = spark.createDataFrame([(1, T1), (2, T2), (3, None)], "id long, text string")
    a = analyze(df, "text", keys=["id"])
    got = {r["id"]: r for r in a.collect()}
    assert got[2]["symptom_clusters"] is None
    assert got[1]["symptom_clusters"] == {0: ["headache"], 1: ["nausea"]}
    t = {r["id"]: r for r in result_table(a, keys=["id"]).collect()}
    assert (t[1]["drugs"], t[1]["symptoms"], t[1]["severity_terms"]) == ("ibuprofen", "headache, nausea", "severe")
    assert t[3]["text"] == "" and t[3]["severity"] == "mild"


def test_highlight_strips_back_to_text(spark):
    df = spark.createDataFrame([(T1,)], "text string")
    h = df.select(highlight(F.col("text"), extract_entities(F.col("text"))).alias("h")).first()["h"]
    assert h.count("<span") == 4
    import re
    assert re.sub(r"<[^>]+>", "", h) == T1
