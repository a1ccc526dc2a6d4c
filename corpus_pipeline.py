"""The corpus pipeline: quality, near-duplicates, decontamination, personal
data, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet in the shared checkpoint folder and rereads it as
the next stage's ``docs``. All stages but the last return the columns of
``documents``. A stage works on whatever its predecessor kept, so each accepts
null ids and texts, empty tables, repeated rows and columns that clash with the
names it uses itself (its own names begin with ``_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlens.llm import bpe, decontamination, pii, quality, simhash
from pvlens.llm.catalog import ship, table
from pvlens.llm.common import written

# No stage of models, hashes by XXH64 and tokens can be put in SQL.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at ``quality.THRESHOLD`` or more."""
    ship(spark)
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, machine, out="_score")
    return scored.where(F.col("_score") >= quality.THRESHOLD).select(*_columns(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the least id.

    Of rows that share the least id one stays. Where no row of a component has
    an id, one row stays."""
    ship(spark)
    marked = docs.withColumn("_row", F.monotonically_increasing_id())
    marked = written(simhash.with_fingerprint(marked, out="_fingerprint"), "rows")  # pins the numbers
    # ordered by id, rows without one last, then by number
    found = simhash.classes(marked.select(
        F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("key"),
        F.col("_fingerprint").alias("fingerprint")))
    chosen = found.where(F.col("key._row") == F.col("component._row")).select("key._row")
    return marked.join(chosen, "_row", "left_semi").select(*_columns(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    ship(spark)
    found = decontamination.with_leaks(docs, table(spark, sf_dir, "benchmark"), out="_leaks")
    return found.where(F.size("_leaks") == 0).select(*_columns(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    cleaned = pii.redact(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(
            F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*_columns(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``ids`` (little-endian unsigned 32-bit), ``n_tokens`` and
    whether the ids decode to the text's bytes."""
    ship(spark)
    coded = bpe.encode_documents(docs, out="ids", decoded="_decoded")
    own = [c for c in _columns(docs.drop("ids", "n_tokens", "round_trip"))]
    return coded.select(
        *own, "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        (F.col("_decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("pii", pii_stage), ("tokens", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
