"""Queries that go through files: the blend job over CSV part folders (R1,
S1-S4, K1), the preparation job's sinks (R3, K3-K5, K7), the annotation
export round trip (S6, K5), inference from a text file (S5) and the
streaming detector (ST1). Each writes the driver tables' derived data to a
fresh folder under the session's checkpoint folder, runs the job and
returns what it reads back; the oracles are the in-memory twins' SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.operators import annotation as A
from pvlens.plans import jobs
from pvlens.streaming.detector import stream_results
from pvlens.plans import sqlparts as P
from pvlens.plans.catalog import ORACLES, register
from pvlens.plans.q_annotation import KEYS, _ann, annotated_reports
from pvlens.session import scratch_path
from pvlens.sources import files as IO
from pvlens.sources import tables as TB


def _write_parts(spark: SparkSession, sf: str) -> str:
    """K1: the three report parts as CSV, one folder per part, partitioned by
    year."""
    base = scratch_path(spark, "parts")
    IO.write_report_parts({
        "DATA": TB.reports(spark, sf),
        "SYMPTOMS": TB.with_year(TB.report_symptoms(spark, sf)),
        "VAX": TB.with_year(TB.report_vax(spark, sf)),
    }, base, compression="gzip")
    return base


@register("blend_from_files", ORACLES["blend"])
def q_blend_from_files(spark, sf):
    """R1 over files: write the parts, discover and classify them, gate the
    years, read each part with an explicit schema and blend."""
    return jobs.blend_job(spark, _write_parts(spark, sf))


def _prepared(spark: SparkSession, sf: str) -> dict[str, str]:
    out = scratch_path(spark, "prep")
    return jobs.preparation_job(TB.reports(spark, sf), "SYMPTOM_TEXT", out, id_cols=["VAERS_ID", "year", "id"])


@register("preparation_outputs", ORACLES["preparation_summary"])
def q_preparation_outputs(spark, sf):
    """R3 end to end: the summary record (K7) read back from its JSON sink,
    as (metric, value) rows (the list of entity types by its length)."""
    paths = _prepared(spark, sf)
    s = spark.read.schema("total_records long, candidate_descriptions long, "
                          "labeled_severity_examples long, unique_symptoms long, "
                          "entity_types array<string>").json(paths["summary"])
    s = s.withColumn("entity_types", F.size("entity_types").cast("long"))
    return s.unpivot([], ["total_records", "candidate_descriptions", "labeled_severity_examples",
                          "unique_symptoms", "entity_types"], "metric", "value")


@register("ranked_symptoms_file", f"SELECT symptom FROM ({ORACLES['symptom_frequency']})")
def q_ranked_symptoms_file(spark, sf):
    """The ranked symptom list read back from its CSV sink."""
    return IO.read_csv_raw(spark, _prepared(spark, sf)["symptoms"], ["symptom"])


EXPORT_SCHEMA = T.StructType([T.StructField("VAERS_ID", T.LongType())] + IO.ANNOTATION_SCHEMA.fields)


@register("annotation_export_roundtrip", ORACLES["bio_tags"])
def q_annotation_export_roundtrip(spark, sf):
    """K5 -> S6 -> F14 -> E7: the annotation set written as an export (JSON
    lines), read back with an explicit schema and turned into BIO tags."""
    path = scratch_path(spark, "export")
    IO.write_json(A.to_export(annotated_reports(spark, sf), "text", "spans", keys=KEYS), path)
    back = IO.read_annotations(spark, path, multiline=False, schema=EXPORT_SCHEMA)
    ex = A.from_export(back, KEYS)
    tags = ex.select("VAERS_ID", A.bio_tags(F.col("text"), F.col("spans")).alias("tags"))
    return tags.select("VAERS_ID", F.size("tags").alias("n_tags"), F.array_join("tags", " ").alias("tags"))


@register("annotation_array_spans", _ann(
    """SELECT VAERS_ID, ann_idx, label, start, "end" FROM ann_rows WHERE text <> ''"""))
def q_annotation_array_spans(spark, sf):
    """K5 -> S6 -> F14 in array form: the annotation set of all reports as files of one
    JSON array each, read back whole files at a time, one row for each span."""
    export = A.to_export(annotated_reports(spark, sf), "text", "spans", keys=KEYS)
    path = IO.write_annotation_arrays(export, scratch_path(spark, "arrays"), KEYS)
    back = A.from_export(IO.read_annotations(spark, path, multiline=True, schema=EXPORT_SCHEMA), KEYS)
    return back.select(*KEYS, F.posexplode("spans").alias("ann_idx", "s")).select(*KEYS, "ann_idx", "s.*")


_FILE_B2 = (f"SELECT text, {P.joined_type_sql('t', 'DRUG')} AS drugs, "
            f"{P.joined_type_sql('t', 'SYMPTOM')} AS symptoms, "
            f"{P.joined_type_sql('t', 'SEVERITY')} AS severity_terms, "
            "{lab} AS severity, {conf} AS confidence FROM lines")


def _file_b2_sql() -> str:
    lab, conf = P.classifier_sql("t")
    return P.with_views(_FILE_B2.format(lab=lab, conf=conf), "reports",
                        "lines AS (SELECT trim(SYMPTOM_TEXT) AS text, lower(trim(SYMPTOM_TEXT)) AS t "
                        "FROM reports WHERE SYMPTOM_TEXT IS NOT NULL AND trim(SYMPTOM_TEXT) <> '')")


@register("batch_file_results", _file_b2_sql())
def q_batch_file_results(spark, sf):
    """S5 + B1/B2: the narratives written one per line to a text file, read
    back stripped (blank lines dropped) and analysed."""
    path = scratch_path(spark, "texts")
    (TB.reports(spark, sf).filter(F.col("SYMPTOM_TEXT").isNotNull())
       .select("SYMPTOM_TEXT").write.mode("overwrite").text(path))
    return jobs.batch_from_file(spark, path).drop("line_no")


STREAM_SCHEMA = T.StructType([T.StructField("VAERS_ID", T.LongType()),
                              T.StructField("SYMPTOM_TEXT", T.StringType())])


@register("stream_batch_results", ORACLES["batch_results"])
def q_stream_batch_results(spark, sf):
    """ST1: the report narratives as a file stream through the same
    stateless detector; the sink equals the batch result table."""
    src = scratch_path(spark, "stream-src")
    TB.reports(spark, sf).select("VAERS_ID", "SYMPTOM_TEXT").write.mode("overwrite").parquet(src)
    return stream_results(spark, src, STREAM_SCHEMA, "SYMPTOM_TEXT", ["VAERS_ID"],
                               scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt"))
