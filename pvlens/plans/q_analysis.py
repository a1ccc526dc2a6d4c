"""Queries of the text-analysis path (candidates, severity, symptoms,
entities, batch results), each with a DuckDB oracle.

Every query reads the driver tables (or the report views Spark derives from
them) in full; the only limits are the ones that are the feature (top-k
reports, the fixed-size sample).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlens.functions.lexicons import DEFAULT_SYMPTOMS
from pvlens.functions.text import pct2_sql
from pvlens.operators import batch as B
from pvlens.operators import entities as E
from pvlens.operators import severity as V
from pvlens.operators import symptoms as S
from pvlens.operators.splits import fixed_sample
from pvlens.operators.text import extract_candidates
from pvlens.plans import sqlparts as P
from pvlens.sources import tables as T

from pvlens.plans.catalog import register


# ---------------------------------------------------------------- shared plans

def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """D1 over the report narratives."""
    return extract_candidates(T.reports(spark, sf), "SYMPTOM_TEXT").select(
        "VAERS_ID", "cleaned_text")


def analyzed_reports(spark: SparkSession, sf: str) -> DataFrame:
    """B1 over every report narrative."""
    return B.analyze(T.reports(spark, sf), "SYMPTOM_TEXT", keys=["VAERS_ID"])


# ---------------------------------------------------------------- symptoms

@register("symptom_top10", P.with_views(
    """SELECT symptom, count(*) AS n_docs
FROM (SELECT unnest(symptoms) AS symptom FROM (SELECT """ + P.symptoms_sql("cleaned_text") + """ AS symptoms FROM candidates))
GROUP BY symptom ORDER BY n_docs DESC, symptom LIMIT 10""", "reports", P.CANDIDATES_CTE))
def symptom_top10(spark, sf):
    """Flagship: report text -> SC1 -> F6 -> D4 -> A18 -> top 10."""
    c = candidates(spark, sf).select(S.extract_symptoms(F.col("cleaned_text")).alias("symptoms"))
    return S.ranked_symptoms(S.symptom_frequency(c)).limit(10)


@register("symptom_frequency", P.with_views(
    """SELECT symptom, count(*) AS n_docs
FROM (SELECT unnest(symptoms) AS symptom FROM (SELECT """ + P.symptoms_sql("cleaned_text") + """ AS symptoms FROM candidates))
GROUP BY symptom""", "reports", P.CANDIDATES_CTE))
def symptom_frequency(spark, sf):
    """Document frequency of every dictionary symptom found."""
    c = candidates(spark, sf).select(S.extract_symptoms(F.col("cleaned_text")).alias("symptoms"))
    return S.symptom_frequency(c)


@register("report_symptoms_extracted", P.with_views(
    """SELECT VAERS_ID, symptom FROM (SELECT VAERS_ID, unnest(""" + P.symptoms_sql("cleaned_text") +
    """) AS symptom FROM candidates)""", "reports", P.CANDIDATES_CTE))
def report_symptoms_extracted(spark, sf):
    """D4 per report, exploded: (VAERS_ID, symptom)."""
    c = candidates(spark, sf)
    return c.select("VAERS_ID", F.explode(S.extract_symptoms(F.col("cleaned_text"))).alias("symptom"))


@register("report_symptoms_ngram", P.with_views(
    """SELECT VAERS_ID, symptom FROM (SELECT VAERS_ID, unnest(""" + P.symptoms_sql("cleaned_text") +
    """) AS symptom FROM candidates)""", "reports", P.CANDIDATES_CTE))
def report_symptoms_ngram(spark, sf):
    """D4 large-dictionary form (token n-grams joined to the dictionary,
    overlaps resolved leftmost-first): the same rows as
    ``report_symptoms_extracted``."""
    c = candidates(spark, sf)
    return S.extract_symptoms_join(c, "cleaned_text", ["VAERS_ID"],
                                   S.dictionary_frame(spark, DEFAULT_SYMPTOMS))


# ---------------------------------------------------------------- candidates / severity

@register("candidates", P.with_views("SELECT VAERS_ID, cleaned_text FROM candidates",
                                     "reports", P.CANDIDATES_CTE))
def q_candidates(spark, sf):
    """Cleaned narratives with 10..500 characters."""
    return candidates(spark, sf)


@register("severity_labels", P.with_views(
    "SELECT VAERS_ID, cleaned_text, severity FROM (SELECT VAERS_ID, cleaned_text, "
    + P.labeller_sql("lower(cleaned_text)") + " AS severity FROM candidates) WHERE severity <> 'unknown'",
    "reports", P.CANDIDATES_CTE))
def severity_labels(spark, sf):
    """D3 + F7: keyword labeller, unknown dropped."""
    return V.label_severity(candidates(spark, sf), "cleaned_text")


@register("severity_label_counts", P.with_views(
    "SELECT severity, count(*) AS n FROM (SELECT " + P.labeller_sql("lower(coalesce(SYMPTOM_TEXT, ''))")
    + " AS severity FROM reports) GROUP BY severity", "reports"))
def severity_label_counts(spark, sf):
    """D3 over every report (unknown kept, null text counts as unknown)."""
    r = T.reports(spark, sf)
    return (r.select(V.severity_label(F.coalesce(F.col("SYMPTOM_TEXT"), F.lit(""))).alias("severity"))
             .groupBy("severity").agg(F.count(F.lit(1)).alias("n")))


_LAB, _CONF = P.classifier_sql("t")


@register("severity_classify", P.with_views(
    "SELECT VAERS_ID, severity, confidence, " + ", ".join(P.probs_sql("severity", "confidence")) +
    f" FROM (SELECT VAERS_ID, {_LAB} AS severity, {_CONF} AS confidence FROM batch_base)",
    "reports", P.BATCH_CTE))
def severity_classify(spark, sf):
    """V1 + V2: rule classifier with normalised probabilities."""
    r = T.reports(spark, sf).select("VAERS_ID", V.classify_severity(F.col("SYMPTOM_TEXT")).alias("r"))
    return r.select("VAERS_ID", *V.severity_columns(F.col("r")))


@register("severity_probability_long", P.with_views(
    """SELECT VAERS_ID, label, probability, label = severity AS is_predicted FROM (
  SELECT VAERS_ID, severity, unnest(['mild', 'moderate', 'severe']) AS label,
         unnest([p_mild, p_moderate, p_severe]) AS probability FROM (
    SELECT VAERS_ID, severity, """ + ", ".join(P.probs_sql("severity", "confidence")) +
    f""" FROM (SELECT VAERS_ID, {_LAB} AS severity, {_CONF} AS confidence FROM batch_base)))""",
    "reports", P.BATCH_CTE))
def severity_probability_long(spark, sf):
    """V3: one row per (report, label) with the predicted flag."""
    r = T.reports(spark, sf).select("VAERS_ID", V.classify_severity(F.col("SYMPTOM_TEXT")).alias("r"))
    return V.probability_long(r, "r", ["VAERS_ID"])


# ---------------------------------------------------------------- entities / batch

@register("entities", P.with_views(
    "SELECT VAERS_ID, ent_idx, ent_type, ent_text, ent_start, ent_end, "
    "CAST(ent_start AS VARCHAR) || ':' || CAST(ent_end AS VARCHAR) AS position FROM ("
    + P.entity_rows_sql("batch_base", "VAERS_ID", "t") + ")", "reports", P.BATCH_CTE))
def q_entities(spark, sf):
    """E1 + E4: lexicon entities of every report, one row each."""
    r = T.reports(spark, sf).select("VAERS_ID", E.extract_entities(F.col("SYMPTOM_TEXT")).alias("entities"))
    return E.explode_entities(r, ["VAERS_ID"])


_B2_SQL = (f"SELECT VAERS_ID, text, {P.joined_type_sql('t', 'DRUG')} AS drugs, "
           f"{P.joined_type_sql('t', 'SYMPTOM')} AS symptoms, "
           f"{P.joined_type_sql('t', 'SEVERITY')} AS severity_terms, "
           f"{_LAB} AS severity, {_CONF} AS confidence FROM batch_base")


@register("batch_results", P.with_views(_B2_SQL, "reports", P.BATCH_CTE))
def batch_results(spark, sf):
    """B1 + B2: the flat batch result table for every report."""
    return B.result_table(analyzed_reports(spark, sf), keys=["VAERS_ID"])


@register("batch_sample", P.with_views(
    _B2_SQL.replace("FROM batch_base", "FROM sampled"), "reports", P.BATCH_CTE,
    "sampled AS (SELECT * FROM batch_base ORDER BY md5('42:' || CAST(VAERS_ID AS VARCHAR)), VAERS_ID LIMIT 100)"))
def batch_sample(spark, sf):
    """Fixed-size seeded sample of 100 reports, then B1 + B2."""
    sample = fixed_sample(T.reports(spark, sf), "VAERS_ID", 100)
    return B.result_table(B.analyze(sample, "SYMPTOM_TEXT", keys=["VAERS_ID"]), keys=["VAERS_ID"])


@register("batch_severity_distribution", P.with_views(
    f"SELECT severity, n, n / sum(n) OVER () AS share, {pct2_sql('n', 'sum(n) OVER ()')} AS pct "
    f"FROM (SELECT severity, count(*) AS n FROM (SELECT {_LAB} AS severity FROM batch_base) GROUP BY severity)",
    "reports", P.BATCH_CTE))
def batch_severity_distribution(spark, sf):
    """B4 + A14: severity counts and shares over the batch results."""
    return B.severity_distribution(batch_results(spark, sf))


@register("batch_top10_symptoms", P.with_views(
    """SELECT symptom, count(*) AS n FROM (
  SELECT trim(unnest(string_split(symptoms, ','))) AS symptom FROM (""" + _B2_SQL + """) WHERE symptoms <> '')
GROUP BY symptom ORDER BY n DESC, symptom LIMIT 10""", "reports", P.BATCH_CTE))
def batch_top10_symptoms(spark, sf):
    """L4: top 10 SYMPTOM entities over the batch (entity array exploded,
    no string round trip)."""
    a = analyzed_reports(spark, sf).select(
        F.transform(E.entities_of_type(F.col("entities"), "SYMPTOM"), lambda e: e["text"]).alias("v"))
    return S.top_values(a, "v", 10, "symptom")


@register("batch_top10_drugs", P.with_views(
    """SELECT drug, count(*) AS n FROM (
  SELECT trim(unnest(string_split(drugs, ','))) AS drug FROM (""" + _B2_SQL + """) WHERE drugs <> '')
GROUP BY drug ORDER BY n DESC, drug LIMIT 10""", "reports", P.BATCH_CTE))
def batch_top10_drugs(spark, sf):
    """Top 10 DRUG entities over the batch."""
    a = analyzed_reports(spark, sf).select(
        F.transform(E.entities_of_type(F.col("entities"), "DRUG"), lambda e: e["text"]).alias("v"))
    return S.top_values(a, "v", 10, "drug")


def _composite_sql() -> str:
    ents = P.e1_list_sql("t")
    n_sym = f"len(list_filter({ents}, lambda e: e.type = 'SYMPTOM'))"
    return P.with_views(
        f"""SELECT VAERS_ID, CAST(len({ents}) AS INTEGER) AS n_entities, {_LAB} AS severity,
       {_CONF} AS confidence, 3 AS n_explained_labels,
       CASE WHEN {n_sym} > 0 THEN CAST(least(3, {n_sym}) AS INTEGER) END AS n_clusters,
       {n_sym} > 0 AS has_clusters
FROM batch_base""", "reports", P.BATCH_CTE)


@register("composite_results", _composite_sql())
def q_composite_results(spark, sf):
    """X2 + X3 + C2: the per-text composite result (entities with
    confidence, severity, explanation map, symptom clusters — absent, not
    empty, without symptoms), summarised to scalars per report."""
    v = B.inference_view(analyzed_reports(spark, sf))
    has = F.col("symptom_clusters").isNotNull()
    return v.select("VAERS_ID", F.size("entities").alias("n_entities"),
                    F.col("severity.severity").alias("severity"),
                    F.col("severity.confidence").alias("confidence"),
                    F.size("explanation").alias("n_explained_labels"),
                    F.when(has, F.size("symptom_clusters")).alias("n_clusters"),
                    has.alias("has_clusters"))
