"""Candidate extraction and annotation-task building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvlens.functions.text import clean_text, stringify, with_evaluated


def require_columns(df: DataFrame, cols: list[str], what: str = "Text") -> None:
    """fail before planning when a needed column is missing."""
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"{what} column '{c}' not found in dataframe")


def extract_candidates(df: DataFrame, text_col: str, min_length: int = 10,
                       max_length: int = 500, out_col: str = "cleaned_text") -> DataFrame:
    """Null -> '' -> SC1 into ``out_col``; keep lengths in [min, max]."""
    require_columns(df, [text_col])
    cleaned = clean_text(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return (with_evaluated(df.drop(out_col), out_col, cleaned)
              .filter(F.length(F.col(out_col)).between(min_length, max_length)))


def length_filter(df: DataFrame, col: str, min_length: int, max_length: int) -> DataFrame:
    """inclusive length window."""
    return df.filter(F.length(F.col(col)).between(min_length, max_length))


def annotation_tasks(df: DataFrame, text_col: str, meta_cols: list[str] | None = None,
                     keys: list[str] | None = None) -> DataFrame:
    """One task per row, ``struct<data:struct<text>, meta:map<string,string>>``.

    Columns of ``meta_cols`` that do not exist are skipped silently; values are
    stringified (null -> 'nan')."""
    present = [c for c in (meta_cols or []) if c in df.columns]
    if present:
        meta = F.map_from_arrays(F.array(*[F.lit(c) for c in present]),
                                 F.array(*[stringify(F.col(c), dict(df.dtypes)[c]) for c in present]))
    else:
        meta = F.create_map().cast("map<string,string>")
    return df.select(*(keys or []), F.struct(F.struct(F.col(text_col).alias("text")).alias("data"),
                              meta.alias("meta")).alias("task"))


def annotation_tasks_long(tasks: DataFrame, id_col: str | None = None) -> DataFrame:
    """Flatten tasks to (text, meta_key, meta_value) rows for reporting."""
    cols = [F.col("task.data.text").alias("text")]
    if id_col:
        cols.insert(0, F.col(id_col))
    return tasks.select(*cols, F.explode_outer("task.meta").alias("meta_key", "meta_value"))
