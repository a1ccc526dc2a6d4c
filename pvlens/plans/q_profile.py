"""Queries of the blend -> profile -> clean path, each with a DuckDB oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlens.functions.lexicons import CLEAN_KEEP_COLUMNS, STATE_CASE_FIXES, TERRITORY_FIXES
from pvlens.functions.text import pct2_sql
from pvlens.operators import blend as J
from pvlens.operators import cleaning as C
from pvlens.operators import profile as A
from pvlens.operators.batch import share_of_total
from pvlens.operators.ordering import forward_fill, forward_fill_then, with_row_index
from pvlens.plans import sqlparts as P
from pvlens.plans.catalog import register
from pvlens.session import written
from pvlens.sources import tables as T

RC = T.REPORT_COLUMNS
BC = T.BLEND_COLUMNS


def qi(c: str) -> str:
    return f'"{c}"'


def _per_column_sql(view: str, cols: list[str], metric: str, agg_of, pct: str | None) -> str:
    aggs = ", ".join(f"{agg_of(c)} AS m{i}" for i, c in enumerate(cols))
    rows = []
    for i, c in enumerate(cols):
        sel = f"SELECT {P.q(c)} AS column_name, CAST(m{i} AS BIGINT) AS {metric}"
        if pct:
            sel += f", {pct2_sql(f'm{i}', '_rows')} AS {pct}"
        rows.append(sel + " FROM agg")
    return (f", agg AS (SELECT count(*) AS _rows, {aggs} FROM {view})\n"
            + "\nUNION ALL ".join(rows))


def blended(spark: SparkSession, sf: str) -> DataFrame:
    return J.blend(T.reports(spark, sf), T.report_symptoms(spark, sf), T.report_vax(spark, sf))


# ---------------------------------------------------------------- profiling (reports)

def _with(views: list[str], tail: str) -> str:
    # ``tail`` starts with ", name AS (...)" CTEs followed by the final SELECT
    return P.with_views("", *views).rstrip("\n") + tail


register("null_profile", _with(["reports"], _per_column_sql(
    "reports", RC, "null_count", lambda c: f"count(*) FILTER (WHERE {qi(c)} IS NULL)", "null_pct")))(
    lambda spark, sf: A.null_profile(T.reports(spark, sf)))


def _null_bands_sql() -> str:
    inner = _with(["reports"], _per_column_sql(
        "reports", RC, "null_count", lambda c: f"count(*) FILTER (WHERE {qi(c)} IS NULL)", "null_pct"))
    return (f"SELECT column_name, CASE WHEN null_pct > 90 THEN '>90' WHEN null_pct > 50 THEN '50-90' "
            f"WHEN null_pct > 20 THEN '20-50' WHEN null_pct >= 1 THEN '1-20' ELSE '<1' END AS band "
            f"FROM ({inner})")


def _q_null_bands(spark, sf):
    """A3: null-rate band per report column."""
    return A.null_bands(A.null_profile(T.reports(spark, sf)))


_PARTS = {"reports": RC, "report_symptoms": ["VAERS_ID", "SYMPTOM1", "SYMPTOM2"],
          "report_vax": ["VAERS_ID", "ORDER", "VAX_TYPE", "VAX_MANU"]}


def _presence_sql() -> str:
    rows = [f"SELECT {P.q(part)} AS part, {P.q(c)} AS column_name, {str(c in own).lower()} AS present, "
            f"{f'count({qi(c)})' if c in own else 'count(*) * 0'} AS n_filled FROM {part}"
            for part, own in _PARTS.items() for c in sorted({c for cs in _PARTS.values() for c in cs})]
    return P.with_views("\nUNION ALL ".join(rows), *_PARTS)


@register("column_presence", _presence_sql())
def q_column_presence(spark, sf):
    """every column of the three parts, which parts have it and how often filled."""
    return A.column_presence({"reports": T.reports(spark, sf), "report_symptoms": T.report_symptoms(spark, sf),
                              "report_vax": T.report_vax(spark, sf)})


@register("dropped_columns", _with(["reports"], _per_column_sql(
    "reports", [c for c in RC if c not in CLEAN_KEEP_COLUMNS], "null_count",
    lambda c: f"count(*) FILTER (WHERE {qi(c)} IS NULL)", "null_pct")))
def q_dropped_columns(spark, sf):
    """the report columns that the clean job drops, with their nulls."""
    return A.dropped_profile(T.reports(spark, sf), CLEAN_KEEP_COLUMNS)


register("null_bands", _null_bands_sql())(_q_null_bands)


@register("shape", P.with_views(f"SELECT count(*) AS n_rows, CAST({len(RC)} AS BIGINT) AS n_cols FROM reports",
                                "reports"))
def q_shape(spark, sf):
    """A4: rows and columns of the report table."""
    return A.shape(T.reports(spark, sf))


register("zero_profile", _with(["reports"], _per_column_sql(
    "reports", RC, "zero_count",
    lambda c: f"count(*) FILTER (WHERE {qi(c)} = 0)" if c in T.NUMERIC_REPORT_COLUMNS else "0",
    "zero_pct")))(lambda spark, sf: A.zero_profile(T.reports(spark, sf)))


register("unique_profile", _with(["reports"], _per_column_sql(
    "reports", RC, "n_unique", lambda c: f"count(DISTINCT {qi(c)})", "unique_pct")))(
    lambda spark, sf: A.unique_profile(T.reports(spark, sf)))


register("distinct_with_null", _with(["reports"], _per_column_sql(
    "reports", RC, "n_distinct",
    lambda c: f"count(DISTINCT {qi(c)}) + max(CASE WHEN {qi(c)} IS NULL THEN 1 ELSE 0 END)", None)))(
    lambda spark, sf: A.distinct_with_null(T.reports(spark, sf)))


_YEAR_SETS = [["2020"], ["2021", "2023"], None]


def _sketch_sql() -> str:
    parts = []
    for members in _YEAR_SETS:
        name = "+".join(members) if members else "all"
        where = f" WHERE year IN ({', '.join(P.q(m) for m in members)})" if members else ""
        for c in RC:
            if c != "year":
                parts.append(f"SELECT {P.q(name)} AS years, {P.q(c)} AS column_name, count(DISTINCT {qi(c)}) AS exact, "
                             f"count(*) AS n_rows, TRUE AS within FROM reports{where}")
    return P.with_views(" UNION ALL ".join(parts), "reports")


@register("distinct_sketches_by_year", _sketch_sql())
def q_distinct_sketches_by_year(spark, sf):
    """Distinct values of every column for sets of years, from one table of
    sketches by year; the estimates lie within 6 % of the exact counts."""
    reports = T.reports(spark, sf)
    sketches = written(A.distinct_sketches(reports, "year"), "sketches")
    out = []
    for members in _YEAR_SETS:
        rows = reports if members is None else reports.where(F.col("year").isin(members))
        exact = A.unique_profile(rows.drop("year")).select("column_name", F.col("n_unique").alias("exact"))
        near = F.abs(F.col("n_unique") - F.col("exact")) <= F.col("exact") * 0.06
        out.append(A.distinct_estimates(sketches, "year", members).join(exact, "column_name").select(
            F.lit("+".join(members) if members else "all").alias("years"), "column_name", "exact", "n_rows",
            near.alias("within")))
    return reduce(DataFrame.union, out)


@register("duplicate_count", P.with_views(
    "SELECT CAST(sum(k) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(k - 1) AS BIGINT) AS n_duplicates "
    "FROM (SELECT count(*) AS k FROM report_symptoms GROUP BY VAERS_ID, SYMPTOM1, SYMPTOM2)",
    "report_symptoms"))
def q_duplicate_count(spark, sf):
    """Fully equal symptom rows."""
    return A.duplicate_count(T.report_symptoms(spark, sf))


@register("drop_duplicates", P.with_views("SELECT DISTINCT * FROM report_symptoms", "report_symptoms"))
def q_drop_duplicates(spark, sf):
    """Distinct symptom rows."""
    return A.drop_duplicates(T.report_symptoms(spark, sf))


@register("distinct_states", P.with_views("SELECT DISTINCT STATE FROM reports", "reports"))
def q_distinct_states(spark, sf):
    """A10: distinct STATE values, null included."""
    return A.distinct_values(T.reports(spark, sf), "STATE")


@register("sex_value_counts", P.with_views(
    "SELECT SEX, count(*) AS n FROM reports WHERE SEX IS NOT NULL GROUP BY SEX", "reports"))
def q_sex_value_counts(spark, sf):
    """SEX value counts, nulls excluded."""
    return A.value_counts(T.reports(spark, sf), "SEX")


@register("recovd_histogram", P.with_views(
    """SELECT 'before' AS phase, RECOVD, count(*) AS n FROM reports WHERE RECOVD IS NOT NULL GROUP BY RECOVD
UNION ALL
SELECT 'after' AS phase, RECOVD, count(*) AS n FROM (
  SELECT coalesce(last_value(RECOVD IGNORE NULLS) OVER (ORDER BY VAERS_ID
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'U') AS RECOVD FROM reports)
GROUP BY RECOVD""", "reports"))
def q_recovd_histogram(spark, sf):
    """A13 + W2: RECOVD counts before and after forward fill then 'U'."""
    r = T.reports(spark, sf).select("VAERS_ID", "RECOVD")
    before = A.value_counts(r, "RECOVD").withColumn("phase", F.lit("before"))
    after = A.value_counts(forward_fill_then(r, "RECOVD", "U", ["VAERS_ID"]), "RECOVD").withColumn(
        "phase", F.lit("after"))
    return before.unionByName(after).select("phase", "RECOVD", "n")


@register("sex_share", P.with_views(
    f"SELECT SEX, n, n / sum(n) OVER () AS share, {pct2_sql('n', 'sum(n) OVER ()')} AS pct "
    "FROM (SELECT coalesce(SEX, 'U') AS SEX, count(*) AS n FROM reports GROUP BY 1)", "reports"))
def q_sex_share(spark, sf):
    """Share of reports per sex (null -> 'U')."""
    r = C.fill_value(T.reports(spark, sf).select("SEX"), "SEX", "U")
    return share_of_total(r.groupBy("SEX").agg(F.count(F.lit(1)).alias("n")), "n")


_AGE_GROUP_SQL = ("CASE WHEN AGE_YRS IS NULL THEN NULL WHEN floor(AGE_YRS / 10) * 10 >= 100 THEN '100+' "
                  "ELSE CAST(CAST(floor(AGE_YRS / 10) * 10 AS BIGINT) AS VARCHAR) || '-' || "
                  "CAST(CAST(floor(AGE_YRS / 10) * 10 AS BIGINT) + 9 AS VARCHAR) END")


@register("age_histogram", P.with_views(
    f"SELECT age_group, count(*) AS n FROM (SELECT {_AGE_GROUP_SQL} AS age_group FROM reports) "
    "WHERE age_group IS NOT NULL GROUP BY age_group", "reports"))
def q_age_histogram(spark, sf):
    """Reports per age decade (0-9 ... 100+)."""
    r = T.reports(spark, sf).select(A.age_group(F.col("AGE_YRS")).alias("age_group"))
    return r.filter(F.col("age_group").isNotNull()).groupBy("age_group").agg(
        F.count(F.lit(1)).alias("n"))


@register("sex_age_heatmap", P.with_views(
    "SELECT age_group, count(*) FILTER (WHERE sex = 'F') AS n_f, count(*) FILTER (WHERE sex = 'M') AS n_m, "
    "count(*) FILTER (WHERE sex = 'U') AS n_u FROM ("
    f"SELECT {_AGE_GROUP_SQL} AS age_group, coalesce(SEX, 'U') AS sex FROM reports) "
    "WHERE age_group IS NOT NULL GROUP BY age_group", "reports"))
def q_sex_age_heatmap(spark, sf):
    """Age group x sex counts."""
    return A.sex_age_heatmap(T.reports(spark, sf))


@register("state_top5", P.with_views(
    "SELECT STATE, n, share FROM (SELECT STATE, n, n / sum(n) OVER () AS share FROM ("
    "SELECT STATE, count(*) AS n FROM reports WHERE STATE IS NOT NULL GROUP BY STATE)) "
    "ORDER BY n DESC, STATE LIMIT 5", "reports"))
def q_state_top5(spark, sf):
    """The five states with most reports and their share of all."""
    counts = A.value_counts(T.reports(spark, sf), "STATE")
    return (share_of_total(counts, "n").drop("pct")
            .orderBy(F.col("n").desc(), F.col("STATE").asc()).limit(5))


@register("reports_head", P.with_views("SELECT * FROM reports ORDER BY VAERS_ID LIMIT 5", "reports"))
def q_reports_head(spark, sf):
    """L2: first five reports by id."""
    return A.head(T.reports(spark, sf), ["VAERS_ID"])


@register("reports_tail", P.with_views("SELECT * FROM reports ORDER BY VAERS_ID DESC LIMIT 5", "reports"))
def q_reports_tail(spark, sf):
    """L2: last five reports by id."""
    return A.head(T.reports(spark, sf), ["VAERS_ID"], tail=True)


@register("reports_head_transposed", P.with_views(
    "SELECT VAERS_ID, column_name, value FROM (SELECT * FROM reports ORDER BY VAERS_ID LIMIT 5) "
    "UNPIVOT INCLUDE NULLS (value FOR column_name IN (" + ", ".join(
        f"CAST({qi(c)} AS VARCHAR) AS {qi(c)}" for c in RC if c != "VAERS_ID") + "))", "reports"))
def q_reports_head_transposed(spark, sf):
    """L3: ``head().T`` as (id, column, text value)."""
    return A.transposed_preview(T.reports(spark, sf), "VAERS_ID", ["VAERS_ID"])


@register("under_one_count", P.with_views(
    "SELECT count(*) FILTER (WHERE coalesce(AGE_YRS < 1.0, false)) AS n_under_one, "
    "count(*) FILTER (WHERE RECOVD = 'U') AS n_recovd_u, count(*) AS n_rows FROM reports", "reports"))
def q_under_one_count(spark, sf):
    """F9 + F10: infants and unknown recovery, conditional counts."""
    r = T.reports(spark, sf)
    return r.agg(F.count_if(C.under_one(F.col("AGE_YRS"))).alias("n_under_one"),
                 C.count_equal(F.col("RECOVD"), "U").alias("n_recovd_u"),
                 F.count(F.lit(1)).alias("n_rows"))


_STATE_MAP_SQL = ("CASE STATE " + " ".join(f"WHEN {P.q(k)} THEN {P.q(v)}" for k, v in
                                            {**STATE_CASE_FIXES, **TERRITORY_FIXES}.items())
                  + " ELSE STATE END")


@register("state_normalised", P.with_views(
    f"SELECT STATE AS state_raw, coalesce({_STATE_MAP_SQL}, 'Unknown') AS state_clean, count(*) AS n "
    "FROM reports GROUP BY ALL", "reports"))
def q_state_normalised(spark, sf):
    """SC11 + SC12 + SC2: raw -> cleaned state code with counts."""
    r = T.reports(spark, sf).select(F.col("STATE").alias("state_raw"), F.col("STATE"))
    r = C.replace_values(C.replace_values(r, "STATE", STATE_CASE_FIXES), "STATE", TERRITORY_FIXES)
    r = C.fill_value(r, "STATE", "Unknown").withColumnRenamed("STATE", "state_clean")
    return r.groupBy("state_raw", "state_clean").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- order-dependent

_W = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@register("forward_fill_reports", P.with_views(
    f"SELECT VAERS_ID, last_value(AGE_YRS IGNORE NULLS) OVER w AS AGE_YRS, "
    f"last_value(SYMPTOM_TEXT IGNORE NULLS) OVER w AS SYMPTOM_TEXT FROM reports "
    f"WINDOW w AS (ORDER BY VAERS_ID {_W})", "reports"))
def q_forward_fill_reports(spark, sf):
    """Forward fill of age and narrative in report-id order (three-phase
    range form, no single-task window)."""
    r = T.reports(spark, sf).select("VAERS_ID", "AGE_YRS", "SYMPTOM_TEXT")
    return forward_fill(r, ["AGE_YRS", "SYMPTOM_TEXT"], ["VAERS_ID"])


@register("row_index", P.with_views(
    "SELECT VAERS_ID, year, CAST(row_number() OVER (ORDER BY year, VAERS_ID) - 1 AS BIGINT) AS row_idx "
    "FROM reports", "reports"))
def q_row_index(spark, sf):
    """Global 0-based index in (year, id) order."""
    return with_row_index(T.reports(spark, sf).select("VAERS_ID", "year"), ["year", "VAERS_ID"])


# ---------------------------------------------------------------- blend / clean

@register("blend", P.with_views("SELECT * FROM blend", "reports", "report_symptoms", "report_vax", T.BLEND_SQL))
def q_blend(spark, sf):
    """Reports ⋈ symptoms ⋈ vaccines on the report id, fan-out kept."""
    return blended(spark, sf)


@register("blend_year_status", P.with_views(
    """SELECT year, count(*) AS n_roles, bool_or(role = 'DATA') AS has_data,
       bool_or(role = 'SYMPTOMS') AS has_symptoms, bool_or(role = 'VAX') AS has_vax,
       count(*) = 3 AS complete
FROM (SELECT DISTINCT year, 'DATA' AS role FROM reports
      UNION ALL SELECT DISTINCT CAST(2020 + VAERS_ID % 6 AS VARCHAR), 'SYMPTOMS' FROM report_symptoms
      UNION ALL SELECT DISTINCT CAST(2020 + VAERS_ID % 6 AS VARCHAR), 'VAX' FROM report_vax)
GROUP BY year""", "reports", "report_symptoms", "report_vax"))
def q_blend_year_status(spark, sf):
    """Which parts exist per year and whether the year can be blended."""
    parts = {"DATA": T.reports(spark, sf), "SYMPTOMS": T.with_year(T.report_symptoms(spark, sf)),
             "VAX": T.with_year(T.report_vax(spark, sf))}
    return J.year_status(J.role_presence(parts))


def _year_summary_sql() -> str:
    cols = [c for c in BC if c != "year"]
    n = len(cols)
    nulls = " + ".join(f"count(*) FILTER (WHERE {qi(c)} IS NULL)" for c in cols)
    zeros = " + ".join(f"count(*) FILTER (WHERE {qi(c)} = 0)" for c in cols if c in T.NUMERIC_REPORT_COLUMNS)
    return P.with_views(
        f"SELECT year, n_rows, CAST({n} AS BIGINT) AS n_cols, total_nulls, "
        f"{pct2_sql('total_nulls', f'n_rows * {n}')} AS total_null_pct, total_zeros, "
        f"{pct2_sql('total_zeros', f'n_rows * {n}')} AS total_zero_pct FROM ("
        f"SELECT year, count(*) AS n_rows, CAST({nulls} AS BIGINT) AS total_nulls, "
        f"CAST({zeros} AS BIGINT) AS total_zeros FROM blend GROUP BY year)",
        "reports", "report_symptoms", "report_vax", T.BLEND_SQL)


@register("year_summary", _year_summary_sql())
def q_year_summary(spark, sf):
    """Per-year shape, nulls and zeros of the blended table."""
    return A.group_summary(blended(spark, sf), "year")


register("blend_null_profile", _with(["reports", "report_symptoms", "report_vax", T.BLEND_SQL],
                                     _per_column_sql("blend", BC, "null_count",
                                                     lambda c: f"count(*) FILTER (WHERE {qi(c)} IS NULL)",
                                                     "null_pct")))(
    lambda spark, sf: A.null_profile(blended(spark, sf).select(*BC)))


_CLEAN_ORDER = ["VAERS_ID", "ORDER", "SYMPTOM1", "SYMPTOM2", "VAX_TYPE", "VAX_MANU"]


def _clean_sql() -> str:
    order = ", ".join(f"{qi(c)} NULLS FIRST" for c in _CLEAN_ORDER)
    return P.with_views(
        f"""SELECT VAERS_ID, coalesce({_STATE_MAP_SQL}, 'Unknown') AS STATE,
       last_value(AGE_YRS IGNORE NULLS) OVER w AS AGE_YRS, coalesce(SEX, 'U') AS SEX,
       last_value(SYMPTOM_TEXT IGNORE NULLS) OVER w AS SYMPTOM_TEXT,
       coalesce(last_value(RECOVD IGNORE NULLS) OVER w, 'U') AS RECOVD,
       VAX_DATE, NUMDAYS, "ORDER", SYMPTOM1, SYMPTOM2, VAX_TYPE, VAX_MANU
FROM (SELECT DISTINCT * FROM blend)
WINDOW w AS (ORDER BY {order} {_W})""",
        "reports", "report_symptoms", "report_vax", T.BLEND_SQL)


@register("clean_blend", _clean_sql())
def q_clean_blend(spark, sf):
    """R1 + R2: the blended reports through the whole clean job."""
    return C.clean_blend(T.reports(spark, sf), T.report_symptoms(spark, sf), T.report_vax(spark, sf))
