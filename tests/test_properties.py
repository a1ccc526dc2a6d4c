"""Property checks: Spark text functions against Python on
generated strings, and entity offsets against the text they point into."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pvlens.functions.text import clean_text, words
from pvlens.operators.entities import extract_entities
from pvlens.operators.severity import classify_severity

ALPHABET = st.sampled_from(list("abcdefghij ") + ["\t", "\n", " ", " ", "\x1c", "pain", "mild",
                                                    "severe", "ibuprofen", "fever", "É"])
TEXTS = st.lists(ALPHABET, max_size=30).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(TEXTS, min_size=40, max_size=40))
def test_text_functions_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", clean_text(F.col("t")).alias("c"), words(F.col("t")).alias("w"),
                    extract_entities(F.col("t")).alias("e"),
                    classify_severity(F.col("t"))["probabilities"].alias("p")).collect()
    for r in got:
        t = texts[r["i"]]
        assert r["c"] == " ".join(t.split())
        assert r["w"] == t.split()
        low = t.lower()
        for e in r["e"]:
            assert low[e["start"]:e["end"]] == e["text"]
        assert abs(sum(r["p"].values()) - 1.0) < 1e-12
