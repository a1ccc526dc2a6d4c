"""The original pipeline's end-to-end jobs as Spark jobs over files
(R1 blend, R3 preparation, batch inference from a text file). The ST1
streaming detector is in :mod:`pvlens.streaming.detector`.

Every job reads and writes through the DataFrame reader / writer: writes go
through Spark's commit protocol (a lost executor's task is retried, nothing
half-written is visible) and outputs live under the shared checkpoint folder
of the session.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.functions.lexicons import ENTITY_TYPES
from pvlens.operators import batch as B
from pvlens.operators import blend as J
from pvlens.operators import cleaning as C
from pvlens.operators import severity as V
from pvlens.operators import symptoms as S
from pvlens.operators.text import annotation_tasks, extract_candidates
from pvlens.sources import files as IO

_TYPES = {"VAERS_ID": T.LongType(), "AGE_YRS": T.DoubleType(), "NUMDAYS": T.LongType(),
          "ORDER": T.IntegerType(), "FORM_VERS": T.IntegerType(),
          "SYMPTOMVERSION1": T.DoubleType(), "SYMPTOMVERSION2": T.DoubleType(),
          "SYMPTOMVERSION3": T.DoubleType()}


def part_schema(columns: list[str]) -> T.StructType:
    """Types of report columns (text where nothing else is known)."""
    return T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in columns])


PART_SCHEMAS = {
    "DATA": part_schema(["VAERS_ID", "STATE", "AGE_YRS", "SEX", "RECOVD", "NUMDAYS", "VAX_DATE",
                         "SYMPTOM_TEXT"]),
    "SYMPTOMS": part_schema(["VAERS_ID", "SYMPTOM1", "SYMPTOM2"]),
    "VAX": part_schema(["VAERS_ID", "ORDER", "VAX_TYPE", "VAX_MANU"]),
}
# All columns that the clean job keeps, by the part they come from.
CLEAN_SCHEMAS = {
    "DATA": part_schema(["VAERS_ID", "STATE", "AGE_YRS", "SEX", "SYMPTOM_TEXT", "RECOVD", "VAX_DATE",
                         "ONSET_DATE", "NUMDAYS", "V_ADMINBY", "HISTORY", "FORM_VERS", "ALLERGIES"]),
    "SYMPTOMS": part_schema(["VAERS_ID", "SYMPTOM1", "SYMPTOMVERSION1", "SYMPTOM2", "SYMPTOMVERSION2",
                             "SYMPTOM3", "SYMPTOMVERSION3"]),
    "VAX": part_schema(["VAERS_ID", "ORDER", "VAX_TYPE", "VAX_MANU", "VAX_LOT", "VAX_DOSE_SERIES",
                        "VAX_ROUTE", "VAX_SITE", "VAX_NAME"]),
}


# ---------------------------------------------------------------- R1

def read_complete_parts(spark: SparkSession, base: str, schemas: dict[str, T.StructType] = PART_SCHEMAS,
                        encoding: str = "UTF-8") -> dict[str, DataFrame]:
    """R1, first half: S1 discover the files under ``base`` in either layout, S3
    classify them, J4 keep the years that have all parts, S2 read each part of
    those years. Two files for one part and year are an error; stray files are
    left out (``files.file_report`` names them). The listing is collected: a row
    for each file."""
    listed = IO.classify_files(IO.list_files(spark, base))
    doubled = [r["path"] for r in IO.file_report(listed).where("problem = 'doubled'").collect()]
    if doubled:
        raise ValueError(f"more than one file for a part and year: {doubled}")
    files = listed.collect()
    roles: dict[str, set[str]] = {}
    for f in files:
        if f["role"] != "OTHER" and f["year"] != "":
            roles.setdefault(f["year"], set()).add(f["role"])
    years = sorted(y for y, r in roles.items() if r == set(J.ROLES))
    return {role: IO.read_report_part(spark, base, role, schema, encoding, years, files)
            for role, schema in schemas.items()}


def blend_job(spark: SparkSession, base: str, out: str | None = None,
              schemas: dict[str, T.StructType] = PART_SCHEMAS, encoding: str = "UTF-8") -> DataFrame:
    """The complete years' parts, J1 blended within each year, K1 written
    partitioned by year (when ``out`` is given). Returns the blended table."""
    parts = read_complete_parts(spark, base, schemas, encoding)
    blended = J.blend(parts["DATA"], parts["SYMPTOMS"], parts["VAX"], ["year", "VAERS_ID"])
    if out:
        IO.write_csv(blended, out, partition_by=["year"], compression="gzip")
    return blended


def clean_job(spark: SparkSession, base: str, encoding: str = "UTF-8") -> DataFrame:
    """R1 + R2 over files with all columns of the keep list; the order of the
    reports is that of year and id."""
    parts = read_complete_parts(spark, base, CLEAN_SCHEMAS, encoding)
    return C.clean_blend(parts["DATA"], parts["SYMPTOMS"], parts["VAX"], ["year", "VAERS_ID"])


# ---------------------------------------------------------------- R3

def preparation_job(df: DataFrame, text_col: str, out: str, id_cols: list[str] | None = None,
                    dictionary: str | None = None) -> dict[str, str]:
    """D1 candidates (cached once) -> K5 annotation tasks, K3 severity
    set, K4 ranked symptom list, K7 summary. ``dictionary`` is the path of a file
    with a term on each line (S7; default: the built-in terms). Returns the
    sink paths."""
    spark = df.sparkSession
    cand = extract_candidates(df, text_col).withColumn(
        "_row", F.monotonically_increasing_id()).cache()
    try:
        paths = {k: os.path.join(out, k) for k in ("tasks", "severity", "symptoms", "summary")}
        tasks = annotation_tasks(cand.drop("_row"), "cleaned_text", id_cols or ["id"])
        IO.write_json(tasks.select(F.col("task.data").alias("data"), F.col("task.meta").alias("meta")),
                      paths["tasks"])
        labelled = V.label_severity(cand, "cleaned_text")
        IO.write_csv(labelled.select("cleaned_text", "severity"), paths["severity"])
        if dictionary:
            found = S.extract_symptoms_join(cand, "cleaned_text", ["_row"],
                                            IO.load_symptom_dictionary(spark, dictionary))
            freq = found.groupBy("symptom").agg(F.count(F.lit(1)).alias("n_docs"))
        else:
            freq = S.symptom_frequency(cand.select(
                S.extract_symptoms(F.col("cleaned_text")).alias("symptoms")))
        IO.write_ranked(freq, paths["symptoms"],
                        [F.col("n_docs").desc(), F.col("symptom").asc()], ["symptom"])
        # one record; the other counts are scalar subqueries (no join)
        summary = df.agg(F.count(F.lit(1)).alias("total_records")).select(
            "total_records",
            cand.agg(F.count(F.lit(1))).scalar().alias("candidate_descriptions"),
            labelled.agg(F.count(F.lit(1))).scalar().alias("labeled_severity_examples"),
            freq.agg(F.count(F.lit(1))).scalar().alias("unique_symptoms"),
            F.array(*[F.lit(t) for t in ENTITY_TYPES]).alias("entity_types"))
        IO.write_json(summary, paths["summary"])
        return paths
    finally:
        cand.unpersist()


# ---------------------------------------------------------------- inference from a file

def batch_from_file(spark: SparkSession, path: str) -> DataFrame:
    """``inference --file``: S5 stripped non-blank lines -> B1 -> B2."""
    lines = IO.read_lines(spark, path)
    return B.result_table(B.analyze(lines, "text", keys=["line_no"]), keys=["line_no"])
