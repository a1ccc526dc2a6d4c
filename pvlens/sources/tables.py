"""Driver tables (Parquet) and the derived report views built from them.

The report views turn the generic star schema into safety-report shaped data
(``FIXTURES.md`` §2). They are pure projections of ``orders`` / ``lineitem``,
so every scan keeps its column pruning and any filter on a key pushes into
the Parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# FIXED VALUES: value pools of the derived report views (FIXTURES.md §2)
SY = ["headache", "nausea", "fever", "chest pain", "joint pain", "dizziness", "rash",
      "shortness of breath"]
STATES = ["CA", "CA", "NY", "TX", "FL", "Ne", "Mi", "or", "XB", "XL", "QW", "QM", None, "WA"]
SEXES = ["F", "F", "M", "U", None]
RECOVDS = ["Y", "N", "U", None]
OPENERS = ["  Patient", "Pt", "The   patient"]
MODIFIERS = ["severe", "mild", "Moderate", "", "slight", "life-threatening", "some"]
PRODUCTS = ["ibuprofen", "the vaccine", "Ibuprofen 50mg", "amoxicillin"]
VAX_TYPES = ["COVID19", "FLU4", "VARZOS"]
VAX_MANUS = ["MODERNA", "PFIZER", "JANSSEN", None]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _lit(v):
    return F.lit(v).cast("string") if v is None else F.lit(v)


def pick(values: list, key: Column) -> Column:
    """List element at ``key % len`` (0-based)."""
    arr = F.array(*[_lit(v) for v in values])
    return F.element_at(arr, (key % len(values)).cast("int") + 1)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per order; ``VAERS_ID`` unique."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    age = F.when(k % 11 == 0, F.lit(None).cast("double")).otherwise(
        (c % 105).cast("double") + F.when(k % 10 == 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    text = F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.concat(
        pick(OPENERS, k), F.lit(" reported "), pick(MODIFIERS, c), F.lit(" "),
        pick(SY, k), F.lit(" and "), pick(SY, c), F.lit(" after taking "),
        pick(PRODUCTS, k + c), F.lit(". ")))
    return o.select(
        k.alias("VAERS_ID"),
        (F.lit(2020) + k % 6).cast("string").alias("year"),
        pick(STATES, k).alias("STATE"),
        age.alias("AGE_YRS"),
        pick(SEXES, k).alias("SEX"),
        pick(RECOVDS, c).alias("RECOVD"),
        F.when(k % 7 == 0, F.lit(None).cast("long")).otherwise(k % 40).alias("NUMDAYS"),
        F.col("o_orderdate").cast("date").cast("string").alias("VAX_DATE"),
        text.alias("SYMPTOM_TEXT"),
    )


def report_symptoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("VAERS_ID"),
        pick(SY, F.col("l_partkey")).alias("SYMPTOM1"),
        pick(SY + [None, None], F.col("l_suppkey")).alias("SYMPTOM2"),
    )


def report_vax(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("VAERS_ID"),
        F.col("l_linenumber").cast("int").alias("ORDER"),
        pick(VAX_TYPES, F.col("l_partkey")).alias("VAX_TYPE"),
        pick(VAX_MANUS, F.col("l_suppkey")).alias("VAX_MANU"),
    )


# ---------------------------------------------------------------------------
# DuckDB twins of the views, inlined as CTEs by the SQL oracles.

def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def pick_sql(values: list, key: str) -> str:
    items = ", ".join(_sql_lit(v) for v in values)
    return f"list_extract([{items}], CAST(({key}) % {len(values)} AS INTEGER) + 1)"


REPORTS_SQL = f"""reports AS (
  SELECT o_orderkey AS VAERS_ID,
         CAST(2020 + o_orderkey % 6 AS VARCHAR) AS year,
         {pick_sql(STATES, 'o_orderkey')} AS STATE,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL
              ELSE CAST(o_custkey % 105 AS DOUBLE)
                   + CASE WHEN o_orderkey % 10 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS AGE_YRS,
         {pick_sql(SEXES, 'o_orderkey')} AS SEX,
         {pick_sql(RECOVDS, 'o_custkey')} AS RECOVD,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 40 END AS NUMDAYS,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS VAX_DATE,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE
           {pick_sql(OPENERS, 'o_orderkey')} || ' reported ' || {pick_sql(MODIFIERS, 'o_custkey')}
           || ' ' || {pick_sql(SY, 'o_orderkey')} || ' and ' || {pick_sql(SY, 'o_custkey')}
           || ' after taking ' || {pick_sql(PRODUCTS, 'o_orderkey + o_custkey')} || '. ' END AS SYMPTOM_TEXT
  FROM orders)"""

REPORT_SYMPTOMS_SQL = f"""report_symptoms AS (
  SELECT l_orderkey AS VAERS_ID,
         {pick_sql(SY, 'l_partkey')} AS SYMPTOM1,
         {pick_sql(SY + [None, None], 'l_suppkey')} AS SYMPTOM2
  FROM lineitem)"""

REPORT_VAX_SQL = f"""report_vax AS (
  SELECT l_orderkey AS VAERS_ID,
         CAST(l_linenumber AS INTEGER) AS "ORDER",
         {pick_sql(VAX_TYPES, 'l_partkey')} AS VAX_TYPE,
         {pick_sql(VAX_MANUS, 'l_suppkey')} AS VAX_MANU
  FROM lineitem)"""


def with_year(df: DataFrame, key: str = "VAERS_ID") -> DataFrame:
    """Year folder of a report part (the same rule as ``reports.year``)."""
    return df.withColumn("year", (F.lit(2020) + F.col(key) % 6).cast("string"))


# FIXED VALUES: pools of the further report columns, in the order of their parts
EXTRA_DATA = {"ONSET_DATE": ["01/02/2021", None, "03/04/2022"], "V_ADMINBY": ["PVT", "PUB", "UNK", None],
              "HISTORY": ["asthma", None, "none, known", "NA"], "ALLERGIES": ["nuts", None, 'says "milk"'],
              "FORM_VERS": ["1", "2"]}
EXTRA_SYMPTOMS = {"SYMPTOMVERSION1": ["24.1", "25.0", None], "SYMPTOMVERSION2": ["24.1", None],
                  "SYMPTOM3": ["fatigue", None, "chills"], "SYMPTOMVERSION3": ["25.1", None, None]}
EXTRA_VAX = {"VAX_LOT": ["EN6201", None, "039K20A"], "VAX_DOSE_SERIES": ["1", "2", "UNK"],
             "VAX_ROUTE": ["IM", None, "SYR"], "VAX_SITE": ["LA", "RA", None],
             "VAX_NAME": ["COVID19 (MODERNA)", "FLU (FLUZONE)", None]}
EXTRA_TYPES = {"FORM_VERS": "int", "SYMPTOMVERSION1": "double", "SYMPTOMVERSION2": "double",
               "SYMPTOMVERSION3": "double"}
# The year whose VAX part is missing.
INCOMPLETE_YEAR = "2023"


def yearly_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three parts with every column of the clean job and a ``year``. An id
    is ``key div 6`` and a year ``2020 + key % 6``, so ids recur in the years; one
    year has no VAX part."""
    def yearly(df: DataFrame, key: str) -> DataFrame:
        k = F.col(key)
        return df.withColumn("year", (F.lit(2020) + k % 6).cast("string")).withColumn(
            key, F.floor(k / 6).cast("long"))

    def extra(pools: dict[str, list], key: Column) -> list[Column]:
        return [pick(v, key).cast(EXTRA_TYPES.get(c, "string")).alias(c) for c, v in pools.items()]
    data = reports(spark, sf_dir).select("*", *extra(EXTRA_DATA, F.col("VAERS_ID")))
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    k, p, u = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    symptoms = li.select(k.alias("VAERS_ID"), pick(SY, p).alias("SYMPTOM1"),
                         pick(SY + [None, None], u).alias("SYMPTOM2"), *extra(EXTRA_SYMPTOMS, p))
    vax = li.select(k.alias("VAERS_ID"), F.col("l_linenumber").cast("int").alias("ORDER"),
                    pick(VAX_TYPES, p).alias("VAX_TYPE"), pick(VAX_MANUS, u).alias("VAX_MANU"),
                    *extra(EXTRA_VAX, u))
    return {"DATA": yearly(data.drop("year"), "VAERS_ID"), "SYMPTOMS": yearly(symptoms, "VAERS_ID"),
            "VAX": yearly(vax, "VAERS_ID").where(F.col("year") != INCOMPLETE_YEAR)}


def _extra_sql(pools: dict[str, list], key: str) -> str:
    return ", ".join(f"CAST({pick_sql(v, key)} AS {EXTRA_TYPES.get(c, 'varchar')}) AS {c}"
                     for c, v in pools.items())


_YEARLY = "CAST(2020 + {k} % 6 AS VARCHAR) AS year, {k} // 6 AS VAERS_ID"
YEARLY_SQL = f"""y_data AS (
  SELECT {_YEARLY.format(k='r.VAERS_ID')}, STATE, AGE_YRS, SEX, RECOVD, NUMDAYS, VAX_DATE, SYMPTOM_TEXT,
         {_extra_sql(EXTRA_DATA, 'VAERS_ID')} FROM reports r),
y_symptoms AS (
  SELECT {_YEARLY.format(k='l_orderkey')}, {pick_sql(SY, 'l_partkey')} AS SYMPTOM1,
         {pick_sql(SY + [None, None], 'l_suppkey')} AS SYMPTOM2, {_extra_sql(EXTRA_SYMPTOMS, 'l_partkey')}
  FROM lineitem),
y_vax AS (
  SELECT {_YEARLY.format(k='l_orderkey')}, CAST(l_linenumber AS INTEGER) AS "ORDER",
         {pick_sql(VAX_TYPES, 'l_partkey')} AS VAX_TYPE, {pick_sql(VAX_MANUS, 'l_suppkey')} AS VAX_MANU,
         {_extra_sql(EXTRA_VAX, 'l_suppkey')}
  FROM lineitem WHERE 2020 + l_orderkey % 6 <> {INCOMPLETE_YEAR})"""


REPORT_COLUMNS = ["VAERS_ID", "year", "STATE", "AGE_YRS", "SEX", "RECOVD", "NUMDAYS",
                  "VAX_DATE", "SYMPTOM_TEXT"]
NUMERIC_REPORT_COLUMNS = {"VAERS_ID", "AGE_YRS", "NUMDAYS", "ORDER"}
BLEND_COLUMNS = REPORT_COLUMNS + ["SYMPTOM1", "SYMPTOM2", "ORDER", "VAX_TYPE", "VAX_MANU"]
BLEND_SQL = """blend AS (
  SELECT * FROM reports JOIN report_symptoms USING (VAERS_ID) JOIN report_vax USING (VAERS_ID))"""
