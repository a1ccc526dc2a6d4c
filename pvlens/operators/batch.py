"""Batch analysis: the per-text composite result and its flat table
(B1-B4, X2, X3, C2). One stateless projection — it serves batch tables and
streams alike (ST1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvlens.operators.entities import (
    entities_of_type, extract_entities, format_entities, joined_texts_of_type,
)
from pvlens.operators.explain import word_weights
from pvlens.operators.severity import classify_severity
from pvlens.operators.symptoms import cluster_groups
from pvlens.functions.text import pct2, with_evaluated
from pvlens.session import checkpoint_dir


def analyze(df: DataFrame, text_col: str, keys: list[str] | None = None,
            with_entities: bool = True, with_severity: bool = True) -> DataFrame:
    """Text, entities, severity struct, explanation map and symptom
    clusters (null = absent when no symptom entity). The classifier runs once
    per text and feeds both the label and the explanation."""
    keys = keys or []
    base = df.select(*keys, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = base
    if with_entities:
        out = out.withColumn("entities", extract_entities(F.col("text")))
    else:
        out = out.withColumn("entities", F.array().cast(
            "array<struct<type:string,text:string,start:int,end:int>>"))
    if with_severity:
        out = out.withColumn("severity", classify_severity(F.col("text")))
        out = out.withColumn("explanation", word_weights(F.col("text"), F.col("severity.severity")))
    else:
        out = (out.withColumn("severity", F.lit(None).cast(
                   "struct<severity:string,confidence:double,probabilities:map<string,double>>"))
                  .withColumn("explanation", F.lit(None).cast(
                      "map<string,array<struct<feature:string,weight:double>>>")))
    symptoms = F.transform(entities_of_type(F.col("entities"), "SYMPTOM"), lambda e: e["text"])
    return out.withColumn("symptom_clusters", cluster_groups(symptoms))


def inference_view(analyzed: DataFrame) -> DataFrame:
    """Entities with confidence, and ``explanation`` = weights or {}."""
    return analyzed.select(
        *[c for c in analyzed.columns if c not in ("entities", "explanation", "symptom_clusters")],
        format_entities(F.col("entities")).alias("entities"),
        F.coalesce(F.col("explanation"), F.create_map().cast(
            "map<string,array<struct<feature:string,weight:double>>>")).alias("explanation"),
        "symptom_clusters")


def result_table(analyzed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """B2: text, drugs, symptoms, severity_terms, severity, confidence with the
    page's defaults ('' and 0)."""
    keys = keys or []
    ents = F.col("entities")
    return analyzed.select(
        *keys, "text",
        joined_texts_of_type(ents, "DRUG").alias("drugs"),
        joined_texts_of_type(ents, "SYMPTOM").alias("symptoms"),
        joined_texts_of_type(ents, "SEVERITY").alias("severity_terms"),
        F.coalesce(F.col("severity.severity"), F.lit("")).alias("severity"),
        F.coalesce(F.col("severity.confidence"), F.lit(0.0)).alias("confidence"))


def severity_distribution(results: DataFrame) -> DataFrame:
    """Count per severity (non-null) with share of the total and the
    percentage rounded half-even to 2 places. The total comes from a
    one-row aggregate broadcast back, not from a global window."""
    counts = (results.filter(F.col("severity").isNotNull())
                     .groupBy("severity").agg(F.count(F.lit(1)).alias("n")))
    return share_of_total(counts, "n")


def share_of_total(counts: DataFrame, n_col: str) -> DataFrame:
    """``n / sum(n)`` next to each group.

    The group counts are written once to the checkpoint folder (one row per
    group), so the total — ONE scalar subquery, pinned as a column — reads
    that small table instead of running the whole scan and aggregation a
    second time; no global window and no join are needed."""
    checkpoint_dir(counts.sparkSession)
    counts = counts.checkpoint(eager=True)
    total = counts.agg(F.sum(F.col(n_col))).scalar()
    pinned = with_evaluated(counts, "_total", total)
    t = F.col("_total")
    return (pinned.withColumn("share", F.col(n_col) / t)
                  .withColumn("pct", pct2(F.col(n_col), t)).drop("_total"))
