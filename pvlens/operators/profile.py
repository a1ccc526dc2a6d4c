"""Data profiling: null / zero / unique tables, shape, duplicates, value
counts and the EDA roll-ups (A1-A8, A10-A17, F4, F5, L1-L3).

Every per-column metric is computed in ONE aggregate pass (one scan, partial
aggregation per task) and then unpivoted — never a job per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from pvlens.functions.lexicons import NULL_BANDS
from pvlens.functions.text import pct2


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _long_form(agg: DataFrame, cols: list[str], metric: str) -> DataFrame:
    """Unpivot a one-row aggregate ``m0..mN`` into (column_name, metric)."""
    return (agg.select("_rows", F.explode(F.array(*[
                F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias(metric))
                for i, c in enumerate(cols)])).alias("s"))
               .select(F.col("s.column_name").alias("column_name"),
                       F.col(f"s.{metric}").alias(metric), "_rows"))


def null_profile(df: DataFrame) -> DataFrame:
    """A1/A2: per column null count and % (half-even, 2 places)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(_c(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    out = _long_form(agg, cols, "null_count")
    return out.select("column_name", "null_count",
                      pct2(F.col("null_count"), F.col("_rows")).alias("null_pct"))


def null_bands(nulls: DataFrame, total_rows: Column | None = None) -> DataFrame:
    """A3: null-rate band of each column from an A1 table (exact ratios)."""
    pct = F.col("null_pct")
    band = None
    for name, lo, _hi in NULL_BANDS:
        cond = pct > lo if lo > 1.0 else pct >= lo
        band = F.when(cond, F.lit(name)) if band is None else band.when(cond, F.lit(name))
    return nulls.select("column_name", band.otherwise(F.lit("<1")).alias("band"))


def shape(df: DataFrame) -> DataFrame:
    """A4: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long"))


def _zero_test(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, BooleanType):
        return F.count_if(~_c(c))
    if isinstance(dt, NumericType):
        return F.count_if(_c(c) == 0)
    return F.lit(0).cast("long")


def zero_profile(df: DataFrame) -> DataFrame:
    """A5: ``(data == 0).sum()``: numbers equal to 0 and False booleans;
    strings never match."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[_zero_test(df, c).alias(f"m{i}") for i, c in enumerate(cols)])
    out = _long_form(agg, cols, "zero_count")
    return out.select("column_name", "zero_count",
                      pct2(F.col("zero_count"), F.col("_rows")).alias("zero_pct"))


def unique_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column and % of rows. ``approx`` uses
    HyperLogLog sketches (one pass, no row expansion) for wide, huge tables."""
    cols = df.columns
    if approx:
        agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[
            F.approx_count_distinct(_c(c)).alias(f"m{i}") for i, c in enumerate(cols)])
        out = _long_form(agg, cols, "n_unique")
    else:
        out = _value_totals(df, cols)
    return out.select("column_name", "n_unique",
                      pct2(F.col("n_unique"), F.col("_rows")).alias("unique_pct"))


def _value_totals(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: distinct values, whether a null occurs, and rows. Each column
    is a scan of its own that reads nothing else and shuffles its distinct
    values, pre-aggregated; counting all at once would copy every row for each
    column."""
    def totals(c: str) -> DataFrame:
        return df.groupBy(_c(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(
            F.count("v").alias("n_unique"), F.coalesce(F.max(F.col("v").isNull()), F.lit(False)).alias("has_null"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("_rows")).select(
            F.lit(c).alias("column_name"), "n_unique", "has_null", "_rows")
    return reduce(DataFrame.union, map(totals, cols))


# log2 of a sketch's registers: some 1.6 % standard error in 2 KB.
SKETCH_BITS = 12


def distinct_sketches(df: DataFrame, key: str, cols: list[str] | None = None) -> DataFrame:
    """A6 and A11 that can be added up: one row for each ``key`` (a year) and column
    with a mergeable HyperLogLog sketch of its non-null values, whether a null
    occurs, and the rows. One scan for all columns; sketches combine on the map
    side, so what moves is a sketch a column, key and task."""
    cols = [c for c in cols or df.columns if c != key]
    text = [_c(c).cast("string") for c in cols]
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *[
        F.struct(F.hll_sketch_agg(t, F.lit(SKETCH_BITS)).alias("sketch"),
                 F.max(t.isNull()).alias("has_null")).alias(f"s{i}") for i, t in enumerate(text)])
    return found.select(key, F.col("_rows").alias("n_rows"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}.sketch").alias("sketch"),
                 F.col(f"s{i}.has_null").alias("has_null")) for i, c in enumerate(cols)])).alias("s")).select(
        key, "s.column_name", "s.sketch", "s.has_null", "n_rows")


def distinct_estimates(sketches: DataFrame, key: str, members: list | None = None) -> DataFrame:
    """Distinct values of each column over any set of keys (all by default), from
    the union of their sketches: ``n_unique`` (A6), ``n_distinct`` (A11, null
    counts as one), ``n_rows``."""
    chosen = sketches if members is None else sketches.where(F.col(key).isin(members))
    return chosen.groupBy("column_name").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_unique"),
        F.max("has_null").alias("has_null"), F.sum("n_rows").alias("n_rows")).select(
        "column_name", "n_unique", (F.col("n_unique") + F.col("has_null").cast("int")).alias("n_distinct"), "n_rows")


def distinct_with_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``len(unique())`` — distinct values counting null as one."""
    cols = cols or df.columns
    return _value_totals(df, cols).select("column_name", (
        F.col("n_unique") + F.col("has_null").cast("int")).cast("long").alias("n_distinct"))


def group_summary(df: DataFrame, key: str) -> DataFrame:
    """Per key (year): rows, columns, total nulls / zeros and their % of
    all cells — one ``groupBy`` over every column at once."""
    cols = [c for c in df.columns if c != key]
    null_sum = sum((F.count_if(_c(c).isNull()) for c in cols), F.lit(0).cast("long"))
    zero_sum = sum((_zero_test(df, c) for c in cols), F.lit(0).cast("long"))
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"),
                            null_sum.alias("total_nulls"), zero_sum.alias("total_zeros"))
    cells = F.col("n_rows") * F.lit(len(cols))
    return g.select(key, "n_rows", F.lit(len(cols)).cast("long").alias("n_cols"),
                    "total_nulls", pct2(F.col("total_nulls"), cells).alias("total_null_pct"),
                    "total_zeros", pct2(F.col("total_zeros"), cells).alias("total_zero_pct"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (null equals null): one group-by over
    all columns, partially aggregated before the shuffle."""
    g = df.groupBy(*[_c(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_k"))
    return g.agg(F.sum("_k").cast("long").alias("n_rows"),
                 F.count(F.lit(1)).alias("n_distinct"),
                 F.sum(F.col("_k") - 1).cast("long").alias("n_duplicates"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each fully equal row."""
    return df.dropDuplicates()


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A10: distinct values including null."""
    return df.select(_c(col)).distinct()


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Counts per value, nulls excluded, most frequent first."""
    return (df.filter(_c(col).isNotNull()).groupBy(_c(col))
              .agg(F.count(F.lit(1)).alias(out))
              .orderBy(F.col(out).desc(), _c(col).asc()))


def age_group(age: Column, width: int = 10, cap: int = 100) -> Column:
    """Decade label '0-9' ... '90-99', '100+'; null stays null."""
    lo = F.least(F.floor(age / width) * width, F.lit(cap)).cast("long")
    return F.when(age.isNull(), F.lit(None).cast("string")).when(
        lo >= cap, F.lit(f"{cap}+")).otherwise(
        F.concat(lo.cast("string"), F.lit("-"), (lo + width - 1).cast("string")))


def sex_age_heatmap(df: DataFrame, sex_col: str = "SEX", age_col: str = "AGE_YRS",
                    sexes: tuple[str, ...] = ("F", "M", "U")) -> DataFrame:
    """Age group x sex counts; the pivot values are fixed, so no extra
    pass to discover them."""
    base = df.select(age_group(_c(age_col)).alias("age_group"),
                     F.coalesce(_c(sex_col), F.lit("U")).alias("sex")).filter(
        F.col("age_group").isNotNull())
    p = base.groupBy("age_group").pivot("sex", list(sexes)).count()
    return p.select("age_group", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(f"n_{s.lower()}")
                                   for s in sexes])


def head(df: DataFrame, order_cols: list[str], n: int = 5, tail: bool = False) -> DataFrame:
    """L2: first / last ``n`` rows in a stated order (distributed top-k)."""
    order = [(_c(c).desc_nulls_last() if tail else _c(c).asc_nulls_first()) for c in order_cols]
    return df.orderBy(*order).limit(n)


def transposed_preview(df: DataFrame, key: str, order_cols: list[str], n: int = 5) -> DataFrame:
    """L3: ``head().T`` as (row key, column, value-as-text)."""
    h = head(df, order_cols, n)
    cols = [c for c in df.columns if c != key]
    return h.select(_c(key), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _c(c).cast("string").alias("value")) for c in cols
    ])).alias("s")).select(_c(key), "s.column_name", "s.value")


def column_difference(existing: list[str], keep: list[str]) -> list[str]:
    """existing columns not in the keep list, in existing order
    (schema metadata only — no data is read)."""
    return [c for c in existing if c not in keep]


def column_union(frames: list[DataFrame]) -> list[str]:
    """sorted union of all column names."""
    return sorted({c for f in frames for c in f.columns})


def dropped_profile(df: DataFrame, keep: list[str]) -> DataFrame:
    """F4 with what dropping costs: each column outside ``keep`` with its nulls (A1)."""
    return null_profile(df.select(*[_c(c) for c in column_difference(df.columns, keep)]))


def column_presence(parts: dict[str, DataFrame]) -> DataFrame:
    """F5 over the parts of a report set: for every column of any part, whether each
    part has it and in how many rows it is filled. One pass a part."""
    every = column_union(list(parts.values()))
    found = []
    for part, df in parts.items():
        agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[
            (F.count(_c(c)) if c in df.columns else F.lit(0).cast("long")).alias(f"m{i}")
            for i, c in enumerate(every)])
        found.append(_long_form(agg, every, "n_filled").select(
            F.lit(part).alias("part"), "column_name",
            F.col("column_name").isin([c for c in every if c in df.columns]).alias("present"), "n_filled"))
    return reduce(DataFrame.unionByName, found)
