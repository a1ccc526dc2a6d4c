"""Report cleaning: projection, value maps, fills and the clean job
(A9, F1-F3, F9, F10, SC2, SC11, SC12, W1-W2, R2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlens.functions.lexicons import CLEAN_KEEP_COLUMNS, STATE_CASE_FIXES, TERRITORY_FIXES
from pvlens.operators.blend import blend
from pvlens.operators.ordering import forward_fill
from pvlens.session import written


def project_keep(df: DataFrame, keep: list[str] = CLEAN_KEEP_COLUMNS,
                 strict: bool = False) -> DataFrame:
    """the keep list in its order, each name once. ``strict`` raises on
    a missing column as the original does; otherwise missing ones are skipped."""
    seen: list[str] = []
    for c in keep:
        if c not in seen:
            seen.append(c)
    missing = [c for c in seen if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in seen if c in df.columns])


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """F3."""
    return df.drop(*cols)


def replace_values(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """SC11/SC12: exact-match value map on one column (others untouched)."""
    return df.replace(mapping, subset=[col])


def fill_value(df: DataFrame, col: str, value) -> DataFrame:
    """SC2: constant for nulls."""
    return df.withColumn(col, F.coalesce(F.col(f"`{col}`"), F.lit(value)))


def under_one(age: Column) -> Column:
    """``AGE_YRS < 1``; null -> false."""
    return F.coalesce(age < 1.0, F.lit(False))


def count_equal(col: Column, value) -> Column:
    """conditional count."""
    return F.count_if(col == F.lit(value))


FILLED = ["AGE_YRS", "SYMPTOM_TEXT", "RECOVD"]


def clean_reports(df: DataFrame, order_cols: list[str], method: str = "ranges",
                  num_ranges: int | None = None) -> DataFrame:
    """R2, in the original order: A9 dedup -> F2 keep list -> SC11 state case
    -> SC12 territory codes -> SEX 'U' -> drop ALLERGIES -> forward fill age
    and text -> forward fill RECOVD then 'U' -> STATE 'Unknown' -> drop
    HISTORY. ``order_cols`` must be unique after the dedup. For blended parts
    :func:`clean_blend` fills the reports before they fan out."""
    out = _steps_before_fill(df.dropDuplicates())
    fill = [c for c in FILLED if c in out.columns]
    if fill:
        out = forward_fill(out, fill, order_cols, method=method, num_ranges=num_ranges)
    return _steps_after_fill(out)


def clean_blend(data: DataFrame, symptoms: DataFrame, vax: DataFrame,
                key: str | list[str] = "VAERS_ID", order_cols: list[str] | None = None,
                num_ranges: int | None = None) -> DataFrame:
    """J1 + R2 on the parts: the same rows as ``clean_reports(blend(...))`` when
    the filled columns belong to the report and the order begins with a report's
    unique order columns (``order_cols``, by default the key).

    The distinct rows of a join are the join of the distinct rows. All rows of a
    report share its values, so filling the reports that survive the joins, in
    their order, fills their rows; only narrow reports are ordered. Which reports
    survive is found by the ids of the other parts alone.

    The distinct rows of each part, the surviving reports and the filled ones are
    written: a source is read once, and the shuffle files of a step are gone before
    the next makes its own. Left for the result are one shuffle of each part, whose
    rows come with like ones side by side and compress the better for it."""
    keys = [key] if isinstance(key, str) else list(key)

    def distinct(df: DataFrame, name: str) -> DataFrame:
        values = [F.col(f"`{c}`") for c in df.columns if c not in keys]
        kept = df.dropDuplicates().dropna(subset=keys)
        return written(kept.sortWithinPartitions(*values) if values else kept, name)
    s, v = distinct(symptoms, "symptoms"), distinct(vax, "vax")
    d = data.dropDuplicates().dropna(subset=keys)
    d = written(d.join(s.select(*keys), keys, "left_semi").join(v.select(*keys), keys, "left_semi"), "reports")
    fill = [c for c in FILLED if c in d.columns]
    if fill:  # the ranges, the carried values and the fill read the written reports
        d = written(forward_fill(d, fill, order_cols or keys, num_ranges=num_ranges), "filled")
    return _steps_after_fill(_steps_before_fill(blend(d, s, v, keys, count_first=True)))


def _steps_before_fill(df: DataFrame) -> DataFrame:
    """F2 keep list -> SC11 -> SC12 -> SEX 'U' -> drop ALLERGIES."""
    out = project_keep(df)
    if "STATE" in out.columns:
        out = replace_values(out, "STATE", STATE_CASE_FIXES)
        out = replace_values(out, "STATE", TERRITORY_FIXES)
    if "SEX" in out.columns:
        out = fill_value(out, "SEX", "U")
    return out.drop("ALLERGIES")


def _steps_after_fill(df: DataFrame) -> DataFrame:
    """RECOVD 'U' -> STATE 'Unknown' -> drop HISTORY."""
    for c, value in (("RECOVD", "U"), ("STATE", "Unknown")):
        if c in df.columns:
            df = fill_value(df, c, value)
    return df.drop("HISTORY")
