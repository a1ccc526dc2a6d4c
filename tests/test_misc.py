"""Small operators: schema helpers, filters, join variants, union, colours."""

import pytest
from pyspark.sql import functions as F

from pvlens.functions.lexicons import CLEAN_KEEP_COLUMNS
from pvlens.functions.text import placeholder_decode, token_count
from pvlens.operators.blend import blend, rename_overlaps, union_years
from pvlens.operators.cleaning import project_keep
from pvlens.operators.entities import highlight_color, label_color
from pvlens.operators.profile import column_difference, column_presence, column_union, dropped_profile
from pvlens.operators.severity import decode_severity, encode_severity, filter_severities
from pvlens.operators.text import require_columns


def test_schema_helpers(spark):
    a = spark.createDataFrame([(1, "x")], "VAERS_ID long, EXTRA string")
    b = spark.createDataFrame([(1, 2.0)], "VAERS_ID long, AGE_YRS double")
    assert column_difference(a.columns, CLEAN_KEEP_COLUMNS) == ["EXTRA"]
    assert column_union([a, b]) == ["AGE_YRS", "EXTRA", "VAERS_ID"]
    assert project_keep(a).columns == ["VAERS_ID"]
    with pytest.raises(KeyError):
        project_keep(a, strict=True)


def test_columns_with_their_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "VAERS_ID long, `EX.TRA` string")
    b = spark.createDataFrame([], "VAERS_ID long, AGE_YRS double")
    assert [tuple(r) for r in dropped_profile(a, CLEAN_KEEP_COLUMNS).collect()] == [("EX.TRA", 1, 50.0)]
    got = {(r["part"], r["column_name"]): (r["present"], r["n_filled"]) for r in column_presence({"a": a, "b": b}).collect()}
    assert got == {("a", "AGE_YRS"): (False, 0), ("a", "EX.TRA"): (True, 1), ("a", "VAERS_ID"): (True, 2),
                   ("b", "AGE_YRS"): (True, 0), ("b", "EX.TRA"): (False, 0), ("b", "VAERS_ID"): (True, 0)}


def test_required_column(spark):
    df = spark.createDataFrame([("t",)], "text string")
    require_columns(df, ["text"])
    with pytest.raises(ValueError, match="Text column 'missing' not found"):
        require_columns(df, ["missing"])


def test_severity_filter_and_codes(spark):
    df = spark.createDataFrame([("mild",), ("Severe",), ("unknown",), (None,)], "s string")
    assert [r["s"] for r in filter_severities(df, "s", ["mild", "moderate", "severe"]).collect()] == ["mild"]
    got = df.select(encode_severity("s").alias("c")).collect()
    assert [r["c"] for r in got] == [0, 2, None, None]
    assert df.select(decode_severity(F.lit(1)).alias("d")).first()["d"] == "moderate"


def test_join_suffixes_and_null_keys(spark):
    d = spark.createDataFrame([(1, "a", 7), (None, "b", 8)], "VAERS_ID long, STATE string, ORDER int")
    s = spark.createDataFrame([(1, "x"), (None, "y")], "VAERS_ID long, SYMPTOM1 string")
    v = spark.createDataFrame([(1, 3), (1, 4), (None, 5)], "VAERS_ID long, ORDER int")
    inner = blend(d, s, v)
    assert sorted(inner.columns) == sorted(["VAERS_ID", "STATE", "ORDER_x", "SYMPTOM1", "ORDER_y"])
    assert inner.count() == 2  # fan-out kept, null ids dropped
    assert blend(d, s, v, null_safe=True).count() == 3  # null ids match each other
    left, right = rename_overlaps(d, v, "VAERS_ID")
    assert "ORDER_x" in left.columns and "ORDER_y" in right.columns


def test_rows_without_an_id_are_matched_in_many_tasks(spark):
    from collections import Counter

    def part(name, n, nulls):
        return spark.createDataFrame([(i % 2, None if i < nulls else i, f"{name}{i}", i) for i in range(n)],
                                     f"year long, id long, {name} string, same long")
    parts = part("a", 90, 60), part("b", 80, 50), part("c", 70, 40)
    got = blend(*parts, ["year", "id"], null_safe=True)
    rows = [p.collect() for p in parts]
    wanted = Counter((x["year"], x["id"], x["a"], y["b"], z["c"]) for x in rows[0] for y in rows[1] for z in rows[2]
                     if (x["year"], x["id"]) == (y["year"], y["id"]) == (z["year"], z["id"]))
    assert got.columns == ["year", "id", "a", "same_x", "b", "same_y", "c", "same"]
    assert Counter(tuple(r[c] for c in ("year", "id", "a", "b", "c")) for r in got.collect()) == wanted
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= 4 and max(tasks) < sum(tasks) / 3


def test_no_task_makes_a_large_share_of_rows_without_an_id(spark):
    """The product is cut finely enough however few shuffle partitions the session has."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        got = blend(*[spark.range(40).select(F.lit(None).cast("long").alias("VAERS_ID"), F.col("id").alias(c))
                      for c in "abc"], null_safe=True)
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert got.select("a", "b", "c").distinct().count() == sum(tasks) == 40 ** 3
    finally:
        spark.conf.set(name, before)
    assert max(tasks) < sum(tasks) / 10


def test_counted_blend_keeps_hot_reports(spark, monkeypatch):
    """Reports of many rows are joined apart from the others; none is lost or doubled."""
    from collections import Counter
    from pvlens.operators import blend as J

    def part(name, counts):
        return spark.createDataFrame([("2021", i, f"{name}{i}-{n}", n) for i, c in counts.items() for n in range(c)]
                                     + [(None, 1, "no year", 0), ("2021", None, "no id", 0)],
                                     f"year string, id long, {name} string, same long")
    counts = {i: 1 + i % 3 for i in range(12)}
    parts = part("a", counts | {3: 4}), part("b", counts | {3: 9, 5: 30}), part("c", counts | {3: 8, 99: 50})
    wanted = J.blend(*parts, ["year", "id"])
    monkeypatch.setattr(J, "HOT_ROWS", 60)
    assert sorted(r["id"] for r in J.hot_keys(list(parts), ["year", "id"]).collect()) == [3, 5]
    for limit in (60, 10**6):
        monkeypatch.setattr(J, "HOT_ROWS", limit)
        got = J.blend(*parts, ["year", "id"], count_first=True)
        assert got.columns == wanted.columns
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, wanted.collect()))


def test_union_years(spark):
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([(2, 3.0)], "id long, b double")
    u = union_years({"2021": a, "2020": b}).orderBy("id").collect()
    assert [(r["year"], r["a"], r["b"]) for r in u] == [("2021", "x", None), ("2020", None, 3.0)]


def test_colours_and_tokens(spark):
    df = spark.createDataFrame([("DRUG",), ("OTHER",)], "t string")
    assert [r["c"] for r in df.select(label_color("t").alias("c")).collect()] == ["#ff9900", "#999999"]
    assert [r["c"] for r in df.select(highlight_color("t").alias("c")).collect()] == ["#ffcccc", "#cccccc"]
    r = spark.createDataFrame([(" a  b c ",)], "t string").select(
        token_count("t").alias("n"), placeholder_decode(token_count("t")).alias("d")).first()
    assert (r["n"], r["d"]) == (3, "token token token")
