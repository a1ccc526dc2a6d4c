from pyspark.sql import functions as F

from pvlens.functions.lexicons import STATE_CASE_FIXES, TERRITORY_FIXES
from pvlens.functions.text import (
    capitalize, clean_text, null_tokens_to_null, pct2, position_label, split_list, stringify, words,
)
from pvlens.functions.lexicons import NULL_TOKENS
from pvlens.operators.cleaning import replace_values
from pvlens.operators.symptoms import extract_symptoms


def col1(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r["x"] for r in df.select(expr.alias("x")).collect()]


def test_clean_text_matches_python_split(spark):
    samples = ["  a\tb\n\nc  ", "x y z", "p\x1cq", "", "é  ü"]
    got = col1(spark, samples, clean_text(F.col("v")))
    assert got == [" ".join(s.split()) for s in samples]
    got = col1(spark, samples, words(F.col("v")))
    assert got == [s.split() for s in samples]


def test_small_scalars(spark):
    assert col1(spark, ["hELLO world"], capitalize(F.col("v"))) == ["Hello world"]
    assert col1(spark, ["a, b ,c"], split_list(F.col("v"))) == [["a", "b", "c"]]
    assert col1(spark, [1, None], stringify(F.col("v")), "long") == ["1", "nan"]
    assert col1(spark, [3], position_label(F.col("v"), F.col("v") + 4), "int") == ["3:7"]


def test_null_tokens(spark):
    vals = NULL_TOKENS + ["none", "NONE", " NA", "-", "x"]
    got = col1(spark, vals, null_tokens_to_null(F.col("v"), NULL_TOKENS))
    assert got == [None] * len(NULL_TOKENS) + ["none", "NONE", " NA", "-", "x"]


def test_pct2_half_even(spark):
    df = spark.createDataFrame([(1, 800), (3, 8), (1, 3)], "p long, t long")
    got = [r["x"] for r in df.select(pct2(F.col("p"), F.col("t")).alias("x")).collect()]
    assert got == [0.12, 37.5, 33.33]  # 0.125 -> 0.12 (half-even)


def test_value_maps_exact_match(spark):
    df = spark.createDataFrame([("Ne",), ("ne",), ("QW",), ("XB",), (None,)], "STATE string")
    df = replace_values(replace_values(df, "STATE", STATE_CASE_FIXES), "STATE", TERRITORY_FIXES)
    assert [r["STATE"] for r in df.collect()] == ["NE", "ne", "WI", "TX", None]


def test_symptom_extraction_word_bounds(spark):
    got = col1(spark, ["Severe Chest Pain and painful fever", None, "épain"],
               extract_symptoms(F.col("v")))
    assert got == [["chest pain", "fever"], [], []]


def test_ngram_join_equals_alternation(spark, sf):
    """D4 large-dictionary form against the regex alternation, with a
    dictionary derived from the data holding overlapping one- and two-word
    terms in mixed priority."""
    from pvlens.operators.symptoms import dictionary_frame, extract_symptoms_join
    from pvlens.sources.tables import read_table
    names = read_table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("t"))
    words = sorted({w for r in names.collect() for w in r["t"].split()})
    bigrams = sorted({" ".join(r["t"].split()[1:3]) for r in names.collect()})
    terms = [x for pair in zip(words, bigrams) for x in pair] + words[len(bigrams):]
    alt = names.select("p_partkey", F.explode(extract_symptoms(F.col("t"), terms)).alias("symptom"))
    join = extract_symptoms_join(names, "t", ["p_partkey"], dictionary_frame(spark, terms))
    a = sorted(map(tuple, alt.collect()))
    assert a and a == sorted(map(tuple, join.collect()))


def test_stringify_as_str(spark):
    from pvlens.functions.text import stringify
    values = [0.0, 1.0, -2.5, 1e10, 1.5e15, 1e16, 123456789012345680.0, 0.0001, 0.00012, 1e-5, -3.25e-7, 1e300,
              float("nan"), float("inf"), float("-inf"), 0.1, 12345678.9, 1e7, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(stringify(F.col("v"), "double")).collect()]
    assert got == ["nan" if v is None else str(v) for v in values]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in flags.select(stringify(F.col("b"), "boolean")).collect()] == ["True", "False", "nan"]


def test_dictionary_terms_match_in_any_case(spark):
    from pvlens.operators.symptoms import dictionary_frame, extract_symptoms_join
    terms = ["Rash", "Chest PAIN", "rash"]
    df = spark.createDataFrame([(1, "a RASH and chest pain")], "k int, t string")
    found = extract_symptoms_join(df, "t", ["k"], dictionary_frame(spark, terms))
    assert sorted(r["symptom"] for r in found.collect()) == ["chest pain", "rash"]
    assert df.select(extract_symptoms(F.col("t"), terms)).first()[0] == ["chest pain", "rash"]
