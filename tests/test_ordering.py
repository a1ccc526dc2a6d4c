"""Order-dependent operators: the range-partitioned forms equal the
one-task window forms; splits are exact and partition the input."""

import time

import pytest
from pyspark.sql import functions as F

from pvlens.operators.ordering import forward_fill, forward_fill_then, with_row_index
from pvlens.operators.selection import key_at
from pvlens.operators.splits import complement, fixed_sample, hash_split, positional_split
from pvlens.sources import tables as T


def test_row_index_ranges_equals_window(spark, sf):
    r = T.reports(spark, sf).select("VAERS_ID")
    a = with_row_index(r, ["VAERS_ID"], num_ranges=5).collect()
    b = with_row_index(r, ["VAERS_ID"], method="window").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    idx = sorted(x["row_idx"] for x in a)
    assert idx == list(range(len(idx)))


def test_forward_fill_ranges_equals_window(spark, sf):
    r = T.reports(spark, sf).select("VAERS_ID", "AGE_YRS", "RECOVD", "SYMPTOM_TEXT")
    cols = ["AGE_YRS", "RECOVD", "SYMPTOM_TEXT"]
    a = forward_fill(r, cols, ["VAERS_ID"], num_ranges=7).orderBy("VAERS_ID").collect()
    b = forward_fill(r, cols, ["VAERS_ID"], method="window").orderBy("VAERS_ID").collect()
    assert a == b
    # the first rows' leading nulls stay null; later nulls are filled
    assert sum(x["AGE_YRS"] is None for x in a) <= 1


def test_forward_fill_then_constant(spark):
    df = spark.createDataFrame([(1, None), (2, "Y"), (3, None)], "k long, v string")
    got = forward_fill_then(df, "v", "U", ["k"], num_ranges=2).orderBy("k").collect()
    assert [x["v"] for x in got] == ["U", "Y", "Y"]


def test_hash_split_exact_and_disjoint(spark, sf):
    r = T.reports(spark, sf).select("VAERS_ID")
    n = r.count()
    s = hash_split(r, "VAERS_ID", limit=20)
    train = s.filter(F.col("split") == "train")
    assert train.count() == round(0.8 * n)
    val = complement(r, train, ["VAERS_ID"])
    assert val.count() + train.count() == n
    assert val.join(train, "VAERS_ID").count() == 0


def test_positional_split(spark):
    df = spark.range(0, 11).withColumnRenamed("id", "k")
    s = positional_split(df, ["k"], limit=2).orderBy("k").collect()
    assert [x["split"] for x in s] == ["train"] * 8 + ["validation"] * 3


def test_fixed_sample_is_deterministic(spark, sf):
    r = T.reports(spark, sf).select("VAERS_ID")
    a = [x["VAERS_ID"] for x in fixed_sample(r, "VAERS_ID", 25).collect()]
    b = [x["VAERS_ID"] for x in fixed_sample(r, "VAERS_ID", 25).collect()]
    assert a == b and len(set(a)) == 25


def test_ranges_are_even(spark):
    """One range to a task, and none much larger than the rest."""
    from pvlens.operators.ordering import find_ranges
    df = spark.range(0, 20_000, 1, 4).select((F.col("id") * 7919 % 20_000).alias("k"))
    ranges = find_ranges(df, ["k"], 16)
    dealt = ranges.deal(df).groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = [r["count"] for r in dealt]
    assert sum(sizes) == 20_000 and len(sizes) == ranges.size >= 14
    assert max(sizes) <= 1.5 * 20_000 / len(sizes)
    plan = with_row_index(df, ["k"], num_ranges=16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not [t for t in spark.catalog.listTables() if "pv_" in t.name]


def test_ranges_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, None), (3, 4), (1, 9)] * 1, "a int, b int")
    got = with_row_index(df, ["a", "b"], num_ranges=3).orderBy("row_idx").collect()
    assert [(r["a"], r["b"]) for r in got] == [(None, 1), (None, 2), (1, 9), (3, None), (3, 4)]
    empty = df.where("a > 5")
    assert with_row_index(empty, ["a"]).count() == 0
    assert positional_split(empty, ["a"]).count() == 0
    assert forward_fill(empty, ["b"], ["a"]).count() == 0


def test_sample_has_no_page_limit(spark):
    assert fixed_sample(spark.range(500).withColumnRenamed("id", "k"), "k", 300).count() == 300


def test_four_thousand_ranges(spark):
    """The plan does not grow with the ranges, and takes seconds to make."""
    from pvlens.operators.ordering import BLOCK_RANGES, find_ranges
    df = spark.range(0, 40_000, 1, 4).select(
        (F.col("id") * 7919 % 40_000).alias("k"), F.concat(F.lit("x"), "id").alias("s")).select(
        "k", "s", F.when(F.col("k") % 9_000 == 8_999, F.col("k")).alias("v"))
    start = time.monotonic()
    ranges = find_ranges(df, ["k", "s"], 4_000)
    assert ranges.size > 3_500 > BLOCK_RANGES
    few = find_ranges(df, ["k", "s"], 8)
    plans = [r.numbered(df)._jdf.queryExecution().optimizedPlan().toString() for r in (few, ranges)]
    assert len(plans[1]) < 2 * len(plans[0]) and "Cross" not in plans[1]
    numbers = ranges.numbered(df).groupBy("_pv_range").agg(F.min("k"), F.max("k")).orderBy("_pv_range").collect()
    assert len(numbers) == ranges.size
    assert all(a[2] < b[1] for a, b in zip(numbers, numbers[1:]))
    filled = forward_fill(df, ["v"], ["k", "s"], num_ranges=4_000)
    wanted = F.when(F.col("k") >= 8_999, F.floor((F.col("k") + 1) / 9_000) * 9_000 - 1)
    assert filled.where(~F.col("v").eqNullSafe(wanted)).count() == 0
    assert filled.count() == 40_000
    assert time.monotonic() - start < 120  # some 30 s on eight free cores


def test_a_plan_of_many_ranges_is_made_in_seconds(spark):
    from pvlens.operators.ordering import Ranges
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") % 25_000).alias("k"))
    table = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.struct(i.cast("long").alias("k"))).alias("last"))
    start = time.monotonic()
    got = Ranges(["k"], table, 20_000).numbered(df).where("_pv_range != least(greatest(k - 1, 0), 19999)").count()
    assert got == 0 and time.monotonic() - start < 20


ORDERS = [
    ("k", "long"), ("s", "string"), ("d", "double"), ("t", "timestamp"), ("a", "date"), ("n", "decimal(12,3)"), ("b", "boolean")]


@pytest.mark.parametrize("cols", [["k"], ["s"], ["d", "k"], ["b", "s"], ["t"], ["a", "n"], ["n"], ["b", "d", "k"]])
def test_selection_is_exact(spark, cols):
    """Any type, nulls, hot values, keys beyond 2^53, against a sort."""
    i = F.col("id")
    df = spark.range(0, 3_000, 1, 5).select(
        (F.lit(2 ** 60) + i * 13 % 3_000 - 1_500 * (i % 2)).alias("k"),
        F.when(i % 3 != 0, F.concat(F.lit("common-prefix-"), F.md5((i % 1_100).cast("string")), F.lit("\0é"))).alias("s"),
        F.when(i % 10 == 0, float("nan")).when(i % 3 == 0, -0.5).when(i % 7 != 0, i / 3 - 400).alias("d"),
        F.timestamp_micros(i * 86_400_000_123 % 999_999_937).alias("t"), F.date_add(F.lit("1969-12-01").cast("date"), (i % 90).cast("int")).alias("a"),
        ((i * 37 % 2_003 - 1_000) / 7).cast("decimal(12,3)").alias("n"), (i % 4 == 0).alias("b")).cache()
    keys = [tuple(r) for r in df.orderBy(*[F.col(c).asc_nulls_first() for c in cols]).select(*cols).collect()]
    for at in (0, 1_000, 2_400, 2_999):
        got = key_at(df, cols, at, limit=15)
        assert str(tuple(got)) == str(keys[at])
    assert key_at(df, cols, lambda n: n, limit=15) is None
    df.unpersist()


def test_splits_have_no_range_exchange(spark, sf):
    r = T.reports(spark, sf).select("VAERS_ID", "SYMPTOM_TEXT")
    plan = hash_split(r, "VAERS_ID")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_clean_blend_reads_a_parts_rows_once(spark):
    """Which reports survive is found by ids; the values are computed once, before the fan-out."""
    from pvlens.operators.blend import blend
    from pvlens.operators.cleaning import clean_blend, clean_reports
    calls = {c: spark.sparkContext.accumulator(0) for c in ("SYMPTOM1", "VAX_TYPE")}

    def counted(df, c):
        seen = calls[c]

        @F.udf("string")
        def same(x):
            seen.add(1)
            return x
        return df.withColumn(c, same(c))
    data = spark.createDataFrame([(i, ["Ne", None, "CA"][i % 3], None if i % 4 else i + 0.5, None, "t" if i % 5 else None,
                                   None if i % 2 else "Y", "h", "a") for i in range(60)],
                                 "VAERS_ID long, STATE string, AGE_YRS double, SEX string, SYMPTOM_TEXT string, "
                                 "RECOVD string, HISTORY string, ALLERGIES string")
    symptoms = spark.createDataFrame([(i % 50, f"s{i % 7}") for i in range(200)], "VAERS_ID long, SYMPTOM1 string")
    vax = spark.createDataFrame([(i % 40, f"v{i % 3}") for i in range(160)], "VAERS_ID long, VAX_TYPE string")
    got = clean_blend(data, counted(symptoms, "SYMPTOM1"), counted(vax, "VAX_TYPE"))
    wanted = clean_reports(blend(data, symptoms, vax), ["VAERS_ID", "SYMPTOM1", "VAX_TYPE"])
    assert got.columns == wanted.columns
    assert sorted(got.collect(), key=str) == sorted(wanted.collect(), key=str)
    assert calls["SYMPTOM1"].value <= 200 and calls["VAX_TYPE"].value <= 160


def test_clean_blend_shuffles_each_part_once(spark):
    """What the first join makes is not shuffled, nor a part a second time for its distinct rows."""
    from pvlens.operators.cleaning import clean_blend
    data = spark.createDataFrame([(i, "CA", i + 0.5) for i in range(60)], "VAERS_ID long, STATE string, AGE_YRS double")
    symptoms = spark.createDataFrame([(i % 50, f"s{i % 7}") for i in range(200)], "VAERS_ID long, SYMPTOM1 string")
    vax = spark.createDataFrame([(i % 40, f"v{i % 3}") for i in range(160)], "VAERS_ID long, VAX_TYPE string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = clean_blend(data, symptoms, vax)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert plan.count("Exchange hashpartitioning") == 3
