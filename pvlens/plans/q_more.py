"""Queries of operators that only files, options or rare inputs reach: yearly
files with headers of their own, incomplete years, ids that recur, null ids,
sinks read back, dictionaries from files, broken annotations, model checks —
each with a DuckDB oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlens.functions.lexicons import EXTRA_ENTITY_PATTERNS
from pvlens.functions.text import capitalize, split_list, with_evaluated
from pvlens.operators import annotation as A
from pvlens.operators import batch as B
from pvlens.operators import blend as J
from pvlens.operators import severity as V
from pvlens.operators import symptoms as S
from pvlens.plans import jobs
from pvlens.plans import sqlparts as P
from pvlens.plans.catalog import ORACLES, register
from pvlens.plans.q_analysis import analyzed_reports, candidates
from pvlens.plans.q_training import severity_split_df
from pvlens.session import scratch_path
from pvlens.sources import files as IO
from pvlens.sources import tables as T

# ---------------------------------------------------------------- R1, J1, J4: years

_Y_JOIN = """FROM y_data JOIN y_symptoms USING (year, VAERS_ID) JOIN y_vax USING (year, VAERS_ID)"""
_SMALL = ["year", "VAERS_ID", "AGE_YRS", "SEX", "SYMPTOM1", "SYMPTOM2", "ORDER", "VAX_TYPE"]


@register("blend_recurring_ids", P.with_views(
    "SELECT " + ", ".join(f'"{c}"' for c in _SMALL) + " " + _Y_JOIN, "reports", T.YEARLY_SQL))
def q_blend_recurring_ids(spark, sf):
    """R1 + J4: ids recur in other years and are other reports there; the year
    without a VAX part drops out."""
    p = T.yearly_parts(spark, sf)
    return J.blend_complete_years(p["DATA"].select("year", "VAERS_ID", "AGE_YRS", "SEX"),
                                  p["SYMPTOMS"].select("year", "VAERS_ID", "SYMPTOM1", "SYMPTOM2"),
                                  p["VAX"].select("year", "VAERS_ID", "ORDER", "VAX_TYPE")).select(*_SMALL)


def _write_yearly(spark: SparkSession, sf: str) -> str:
    """The parts in the original layout; the columns stand in another order in
    each year, and there are columns that nobody asks for and a stray file."""
    base = scratch_path(spark, "yearly")
    parts = T.yearly_parts(spark, sf)
    for n, year in enumerate(str(y) for y in range(2020, 2026)):
        for role, df in parts.items():
            if (year, role) != (T.INCOMPLETE_YEAR, "VAX"):
                names = [c for c in df.columns if c != "year"]
                turned = names[n % len(names):] + names[:n % len(names)]
                IO.write_yearly_files({role: df.select("year", F.lit("x").alias("UNUSED"), *turned)},
                                      base, [year], compression="gzip")
    T.reports(spark, sf).groupBy("year").count().coalesce(1).write.options(**IO.CSV_OPTIONS).csv(
        os.path.join(base, "2024VAERSData", "notes.csv"))
    return base


def _clean_full_sql() -> str:
    w = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    from pvlens.plans.q_profile import _STATE_MAP_SQL
    extra = ", ".join(c for c in [*T.EXTRA_DATA, *T.EXTRA_SYMPTOMS, *T.EXTRA_VAX]
                      if c not in ("HISTORY", "ALLERGIES"))
    return P.with_views(f"""SELECT VAERS_ID, coalesce({_STATE_MAP_SQL}, 'Unknown') AS STATE, AGE_YRS,
       coalesce(SEX, 'U') AS SEX, SYMPTOM_TEXT, coalesce(RECOVD, 'U') AS RECOVD, VAX_DATE, NUMDAYS,
       "ORDER", SYMPTOM1, SYMPTOM2, VAX_TYPE, VAX_MANU, {extra}
FROM (SELECT * REPLACE (last_value(AGE_YRS IGNORE NULLS) OVER w AS AGE_YRS,
                        last_value(SYMPTOM_TEXT IGNORE NULLS) OVER w AS SYMPTOM_TEXT,
                        last_value(RECOVD IGNORE NULLS) OVER w AS RECOVD)
      FROM y_data SEMI JOIN y_symptoms USING (year, VAERS_ID) SEMI JOIN y_vax USING (year, VAERS_ID)
      WINDOW w AS (ORDER BY year, VAERS_ID {w}))
JOIN (SELECT DISTINCT * FROM y_symptoms) USING (year, VAERS_ID)
JOIN (SELECT DISTINCT * FROM y_vax) USING (year, VAERS_ID)""", "reports", T.YEARLY_SQL)


@register("clean_yearly_files", _clean_full_sql())
def q_clean_yearly_files(spark, sf):
    """S1-S4, J4, R1, R2 over the original layout: 27 columns bound by each
    file's header, ALLERGIES and HISTORY present and dropped."""
    return jobs.clean_job(spark, _write_yearly(spark, sf))


@register("file_problems", P.with_views(
    "SELECT '2024' AS year, 'OTHER' AS role, 'stray' AS problem, count(DISTINCT year) > 0 AS present FROM reports "
    "UNION ALL SELECT '2021', 'VAX', 'doubled', count(*) > 0 FROM y_vax WHERE year = '2021'",
    "reports", T.YEARLY_SQL))
def q_file_problems(spark, sf):
    """S3: a stray file and a second file of one part and year are reported."""
    base = scratch_path(spark, "problems")
    parts = T.yearly_parts(spark, sf)
    IO.write_yearly_files({"VAX": parts["VAX"]}, base, _ALL_YEARS)
    IO.write_csv(parts["VAX"].where("year = '2021'").drop("year"),
                 os.path.join(base, "2021VAERSData", "2021copyVAX.csv"))
    IO.write_csv(T.reports(spark, sf), os.path.join(base, "2024VAERSData", "notes.csv"))
    found = IO.file_report(IO.classify_files(IO.list_files(spark, base)))
    return found.groupBy("year", "role", "problem").agg((F.count(F.lit(1)) > 0).alias("present"))


@register("blend_files_combined", ORACLES["blend"])
def q_blend_files_combined(spark, sf):
    """K1 + K2: the blended years written as one table of yearly folders, then
    as one table of all years, and read back."""
    out, whole = scratch_path(spark, "combined"), scratch_path(spark, "all-years")
    blended = J.blend(T.reports(spark, sf), T.report_symptoms(spark, sf), T.report_vax(spark, sf),
                      count_first=True)
    IO.write_csv(blended, out, partition_by=["year"], compression="gzip")
    columns = [c for c in blended.columns if c != "year"]
    # a folder of yearly folders that names no part
    yearly = IO.read_report_part(spark, out, "OTHER", blended.schema, "UTF-8")
    IO.write_csv(yearly, whole, compression="gzip")
    back = IO.read_csv_raw(spark, whole, [*columns, "year"])
    return IO.apply_schema(back, blended.schema)


# ---------------------------------------------------------------- J2, J3, U1, F11, SC17, SC19, Q6

@register("blend_null_ids", P.with_views(
    """SELECT d.id AS VAERS_ID, d.STATE AS STATE, s.SYMPTOM1 AS SYMPTOM1, v.VAX_TYPE AS VAX_TYPE
FROM (SELECT CASE WHEN VAERS_ID % 500 = 0 THEN NULL ELSE VAERS_ID END AS id, STATE FROM reports) d
JOIN (SELECT CASE WHEN VAERS_ID % 1000 = 0 THEN NULL ELSE VAERS_ID END AS id, SYMPTOM1 FROM report_symptoms) s
  ON d.id IS NOT DISTINCT FROM s.id
JOIN (SELECT CASE WHEN VAERS_ID % 2000 = 0 THEN NULL ELSE VAERS_ID END AS id, VAX_TYPE FROM report_vax) v
  ON d.id IS NOT DISTINCT FROM v.id""", "reports", "report_symptoms", "report_vax"))
def q_blend_null_ids(spark, sf):
    """Null ids match each other, as pandas' merge does."""
    def nulled(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("VAERS_ID", F.when(F.col("VAERS_ID") % n != 0, F.col("VAERS_ID")))
    return J.blend(nulled(T.reports(spark, sf).select("VAERS_ID", "STATE"), 500),
                   nulled(T.report_symptoms(spark, sf).select("VAERS_ID", "SYMPTOM1"), 1000),
                   nulled(T.report_vax(spark, sf).select("VAERS_ID", "VAX_TYPE"), 2000), null_safe=True)


@register("blend_overlapping_columns", P.with_views(
    """SELECT VAERS_ID, d.STATE AS STATE_x, s.STATE AS STATE_y, VAX_TYPE
FROM reports d JOIN (SELECT VAERS_ID, SYMPTOM1 AS STATE FROM report_symptoms) s USING (VAERS_ID)
JOIN (SELECT VAERS_ID, VAX_TYPE FROM report_vax) USING (VAERS_ID)""",
    "reports", "report_symptoms", "report_vax"))
def q_blend_overlapping_columns(spark, sf):
    """A column that both sides have gets a suffix on either side."""
    return J.blend(T.reports(spark, sf).select("VAERS_ID", "STATE"),
                   T.report_symptoms(spark, sf).select("VAERS_ID", F.col("SYMPTOM1").alias("STATE")),
                   T.report_vax(spark, sf).select("VAERS_ID", "VAX_TYPE"))


_ALL_YEARS = [str(y) for y in range(2020, 2026)]


@register("union_years", P.with_views(
    "SELECT VAERS_ID, CASE WHEN CAST(year AS INTEGER) % 2 = 0 THEN STATE END AS STATE, "
    "CASE WHEN CAST(year AS INTEGER) % 2 = 1 THEN SEX END AS SEX, year FROM reports", "reports"))
def q_union_years(spark, sf):
    """All years, whose columns differ from one to the next, under one schema with
    the year as a column."""
    r = T.reports(spark, sf)
    return J.union_years({y: r.where(F.col("year") == y).select("VAERS_ID", "SEX" if int(y) % 2 else "STATE")
                          for y in _ALL_YEARS})


@register("severity_filtered", P.with_views(
    "SELECT VAERS_ID, severity FROM (SELECT VAERS_ID, " + P.labeller_sql("lower(cleaned_text)")
    + " AS severity FROM candidates) WHERE severity IN ('mild', 'severe')", "reports", P.CANDIDATES_CTE))
def q_severity_filtered(spark, sf):
    """only the chosen severities."""
    labelled = V.label_severity(candidates(spark, sf), "cleaned_text", drop_unknown=False)
    return V.filter_severities(labelled, "severity", ["mild", "severe"]).select("VAERS_ID", "severity")


@register("joined_terms_split", (
    "SELECT VAERS_ID, list_aggregate(list_transform(string_split(drugs, ','), lambda x: "
    "upper(trim(x)[1]) || lower(trim(x)[2:])), 'string_agg', ';') AS drugs FROM (" + ORACLES["batch_results"] + ")"))
def q_joined_terms_split(spark, sf):
    """SC16 -> SC17 + SC19: the joined drug list split again, each capitalised."""
    results = B.result_table(analyzed_reports(spark, sf), keys=["VAERS_ID"])
    return results.select("VAERS_ID", F.array_join(
        F.transform(split_list(F.col("drugs")), capitalize), ";").alias("drugs"))


_COVID_TEXT = {"T": ["tested negative for covid-19", "history of covid-19", "after the covid-19 vaccine",
                     "exposed to COVID19 at work", "positive for covid-19", "covid-19 in the area", "no mention"]}


@register("covid_dispositions", P.with_views(
    f"SELECT VAERS_ID, CASE {T.pick_sql(['negative test', 'history', 'vaccine name', 'exposure', 'infection', 'unclear', None], 'VAERS_ID').replace('list_extract', 'WHEN TRUE THEN list_extract', 1)} END AS disposition FROM reports",
    "reports"))
def q_covid_dispositions(spark, sf):
    """Q6: how each report's COVID-19 mention counts (a phrase is appended to
    the narrative, by id)."""
    r = T.reports(spark, sf).select("VAERS_ID", F.concat_ws(
        " ", "SYMPTOM_TEXT", T.pick(_COVID_TEXT["T"], F.col("VAERS_ID"))).alias("text"))
    return r.select("VAERS_ID", A.covid_disposition(F.col("text")).alias("disposition"))


# ---------------------------------------------------------------- sinks read back (K3, K5, K6, K8)

@register("severity_set_file", P.with_views(
    "SELECT cleaned_text, severity FROM (SELECT cleaned_text, " + P.labeller_sql("lower(cleaned_text)")
    + " AS severity FROM candidates) WHERE severity <> 'unknown'", "reports", P.CANDIDATES_CTE))
def q_severity_set_file(spark, sf):
    """K3: the severity set that the preparation job wrote."""
    out = jobs.preparation_job(T.reports(spark, sf), "SYMPTOM_TEXT", scratch_path(spark, "prep"), ["VAERS_ID"])
    return IO.read_csv_raw(spark, out["severity"], ["cleaned_text", "severity"])


@register("annotation_tasks_file", P.with_views(
    "SELECT cleaned_text AS text, CAST(VAERS_ID AS VARCHAR) AS VAERS_ID FROM candidates", "reports", P.CANDIDATES_CTE))
def q_annotation_tasks_file(spark, sf):
    """K5: the annotation tasks that the preparation job wrote."""
    out = jobs.preparation_job(T.reports(spark, sf), "SYMPTOM_TEXT", scratch_path(spark, "prep"), ["VAERS_ID"])
    back = spark.read.schema("data struct<text: string>, meta map<string, string>").json(out["tasks"])
    return back.select("data.text", F.col("meta")["VAERS_ID"].alias("VAERS_ID"))


@register("composite_results_file", ORACLES["composite_results"])
def q_composite_results_file(spark, sf):
    """K6: the composite results as JSON and back."""
    path = scratch_path(spark, "composite")
    IO.write_json(B.inference_view(analyzed_reports(spark, sf)), path)
    back = spark.read.schema(
        "VAERS_ID long, entities array<struct<type: string>>, severity struct<severity: string, confidence: double>, "
        "explanation map<string, array<struct<feature: string>>>, "
        "symptom_clusters map<string, array<string>>").json(path)
    has = F.col("symptom_clusters").isNotNull()
    return back.select("VAERS_ID", F.size("entities").alias("n_entities"), F.col("severity.severity").alias("severity"),
                       F.col("severity.confidence").alias("confidence"),
                       F.size("explanation").alias("n_explained_labels"),
                       F.when(has, F.size("symptom_clusters")).alias("n_clusters"), has.alias("has_clusters"))


_B2 = ["VAERS_ID", "text", "drugs", "symptoms", "severity_terms", "severity", "confidence"]


@register("batch_results_file", "SELECT VAERS_ID, nullif(drugs, '') AS drugs, nullif(symptoms, '') AS symptoms, "
          "severity, confidence FROM (" + ORACLES["batch_results"] + ")")
def q_batch_results_file(spark, sf):
    """K8: the batch result table as CSV and back (empty text reads as missing)."""
    path = scratch_path(spark, "batch")
    IO.write_csv(B.result_table(analyzed_reports(spark, sf), keys=["VAERS_ID"]), path)
    back = IO.read_csv_raw(spark, path, ["VAERS_ID", "drugs", "symptoms", "severity", "confidence"])
    return back.select(F.col("VAERS_ID").cast("long").alias("VAERS_ID"), "drugs", "symptoms", "severity",
                       F.col("confidence").cast("double").alias("confidence"))


# ---------------------------------------------------------------- S7, S8, D4: dictionaries

# FIXED VALUES: terms of a dictionary file, in mixed case
_TERMS = ["And", "der", "QUE", "la", "in the", "en", "Avec"]
# a word ends where no letter, digit or underscore follows, in any script
_EDGE = r"[^\p{L}\p{N}_]"


@register("document_dictionary_file", "SELECT doc_id, term AS symptom FROM documents, (SELECT unnest(["
          + ", ".join(P.q(t.lower()) for t in _TERMS) + "]) AS term) WHERE regexp_matches(lower(text), "
          f"'(^|{_EDGE})' || term || '({_EDGE}|$)')")
def q_document_dictionary_file(spark, sf):
    """S7 + D4: a dictionary file whose terms, in mixed case, are words of the
    documents, found by the n-gram join."""
    path = scratch_path(spark, "terms")
    spark.createDataFrame([(t,) for t in _TERMS], "value string").coalesce(1).write.text(path)
    docs = T.read_table(spark, sf, "documents").select("doc_id", "text")
    return S.extract_symptoms_join(docs, "text", ["doc_id"], IO.load_symptom_dictionary(spark, path))


@register("document_dictionary_regex", ORACLES["document_dictionary_file"])
def q_document_dictionary_regex(spark, sf):
    """D4 in the row: the same terms as one alternation."""
    docs = T.read_table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(S.extract_symptoms(F.col("text"), _TERMS)).alias("symptom"))


# ---------------------------------------------------------------- E7, ML4 over documents

_SPAN_EVERY = 40


def _document_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans over whole documents: one of 30 characters every 40, one of 80 every
    200 over them, and by id one without an end."""
    d = T.read_table(spark, sf, "documents").select("doc_id", "text")
    n = F.length("text")

    def spans(label, every, size):
        starts = F.sequence(F.lit(0), n, F.lit(every))
        return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("int").alias("start"),
                                                      (i + size).cast("int").alias("end")))
    broken = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(
        F.lit("B").alias("label"), F.lit(5).alias("start"), F.lit(None).cast("int").alias("end")))).otherwise(
        F.array().cast("array<struct<label:string,start:int,end:int>>"))
    return d.select("doc_id", "text", F.concat(spans("S", _SPAN_EVERY, 30), spans("L", 200, 80), broken).alias("spans"))


@register("document_bio_tags", """SELECT doc_id, md5(string_agg(CASE
    WHEN p % 200 = 0 THEN 'B-L' WHEN p >= 0 AND p % 200 < 80 THEN 'I-L'
    WHEN p % 40 = 0 THEN 'B-S' WHEN p % 40 < 30 THEN 'I-S' ELSE 'O' END, ' ' ORDER BY p)) AS tags, count(*) AS n
FROM (SELECT doc_id, unnest(range(0, length(text))) AS p FROM documents) GROUP BY doc_id""")
def q_document_bio_tags(spark, sf):
    """E7 over whole documents with overlapping spans; results without bounds
    are left out."""
    tags = with_evaluated(_document_spans(spark, sf), "tags", A.bio_tags(F.col("text"), F.col("spans")))
    return tags.where(F.size("tags") > 0).select(
        "doc_id", F.md5(F.array_join("tags", " ")).alias("tags"), F.size("tags").cast("long").alias("n"))


@register("document_broken_annotations", """SELECT doc_id, CAST(length(text) // 40 + length(text) // 200 + 2 AS INTEGER)
    AS ann_idx, 'B' AS label, 5 AS start, CAST(NULL AS INTEGER) AS "end" FROM documents WHERE doc_id % 3 = 0""")
def q_document_broken_annotations(spark, sf):
    """The rejects table of E7."""
    return A.broken_annotations(_document_spans(spark, sf), ["doc_id"])


_DOSES = ["5 mg twice daily by mouth for 3 days", "2 units every 6 hours", "oral use", "for 10 weeks, 1.5 ml once a day", ""]


def _patterns_sql() -> str:
    parts = [f"SELECT VAERS_ID, {P.q(typ)} AS type, unnest(list_transform(regexp_extract_all(t, {P.q(pat)}, 0), "
             f"lambda x: x)) AS text FROM dosed" for typ, pat in EXTRA_ENTITY_PATTERNS]
    return P.with_views("SELECT type, text, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY type, text",
                        "reports", "dosed AS (SELECT VAERS_ID, lower(concat_ws(' ', SYMPTOM_TEXT, "
                        + T.pick_sql(_DOSES, "VAERS_ID") + ")) AS t FROM reports)")


@register("extended_entity_counts", _patterns_sql())
def q_extended_entity_counts(spark, sf):
    """ML4: all four further entity types occur (a phrase is appended by id)."""
    r = T.reports(spark, sf).select(F.concat_ws(
        " ", "SYMPTOM_TEXT", T.pick(_DOSES, F.col("VAERS_ID"))).alias("text"))
    return r.select(F.explode(A.pattern_mentions(F.col("text"))).alias("m")).groupBy(
        F.col("m.type").alias("type"), F.col("m.text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- ML1 through A24, ML2

# FIXED VALUE: accuracy that the severity model must reach on the validation rows
MODEL_ACCURACY = 0.9


@register("severity_model_check", "SELECT count(*) AS n, TRUE AS in_range, TRUE AS accurate FROM ("
          + ORACLES["severity_split"] + ") WHERE split = 'validation'")
def q_severity_model_check(spark, sf):
    """ML1 -> A24: the model's accuracy on the validation rows reaches the bound
    and its predictions are labels."""
    from pvlens.operators.ml import fit_severity_model, predict_severity
    from pvlens.session import written
    s = written(severity_split_df(spark, sf).select("VAERS_ID", "text", "label", "split"), "severity-split")
    model = fit_severity_model(s.where("split = 'train'"))
    p = predict_severity(model, s.where("split = 'validation'"), ["label"])
    accuracy = A.classification_metrics(p, "label", "prediction", [0, 1, 2]).first()["accuracy"]
    return p.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("prediction").between(0, 2)).alias("in_range")).withColumn(
        "accurate", F.lit(accuracy >= MODEL_ACCURACY))


@register("embedding_cluster_check", "SELECT count(*) AS n, TRUE AS in_range, TRUE AS all_used FROM embeddings")
def q_embedding_cluster_check(spark, sf):
    """ML2: every vector has one of the k clusters and every cluster a vector."""
    from pvlens.operators.ml import cluster_embeddings
    c = cluster_embeddings(T.read_table(spark, sf, "embeddings"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("cluster").between(0, 7)).alias("in_range"),
                 (F.count_distinct("cluster") == 8).alias("all_used"))
