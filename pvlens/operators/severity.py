"""Severity labelling, the rule classifier and training-set preparation
(D3, V1-V4, SC13, A20, F7, F8, F11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlens.functions.lexicons import (
    CLASSIFIER_BASE_PROB, CLASSIFIER_DEFAULT, CLASSIFIER_RULES, SEVERITY_KEYWORDS,
    SEVERITY_LABEL_IDS, SEVERITY_LABELS,
)
from pvlens.functions.text import col_, contains_ci, with_evaluated
from pvlens.operators.text import require_columns


def severity_label(text, levels=SEVERITY_KEYWORDS) -> Column:
    """D3 per row: first level (in order) with any keyword as a substring of
    the lower-cased text, else 'unknown'. Null text is 'unknown'."""
    t = F.lower(col_(text))
    expr = None
    for level, keywords in levels:
        cond = reduce(lambda a, b: a | b, [contains_ci(t, kw) for kw in keywords])
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr.otherwise(F.lit("unknown"))


def label_severity(df: DataFrame, text_col: str, levels=SEVERITY_KEYWORDS,
                   out_col: str = "severity", drop_unknown: bool = True) -> DataFrame:
    """D3 + F7: add the label and (by default) drop 'unknown'."""
    require_columns(df, [text_col])
    out = with_evaluated(df.drop(out_col), out_col, severity_label(text_col, levels))
    return out.filter(F.col(out_col) != "unknown") if drop_unknown else out


def classify_severity(text) -> Column:
    """V1: ``struct<severity, confidence, probabilities map>``.

    Rules are tried in order; without a hit the label is the default. Each
    label scores the base probability, the chosen one its confidence, and the
    scores are divided by their sum (summed mild, moderate, severe)."""
    t = F.lower(F.coalesce(col_(text), F.lit("")))
    label, conf = None, None
    for term, lab, c in CLASSIFIER_RULES:
        hit = contains_ci(t, term)
        label = F.when(hit, F.lit(lab)) if label is None else label.when(hit, F.lit(lab))
        conf = F.when(hit, F.lit(c)) if conf is None else conf.when(hit, F.lit(c))
    label = label.otherwise(F.lit(CLASSIFIER_DEFAULT[0]))
    conf = conf.otherwise(F.lit(CLASSIFIER_DEFAULT[1]))
    scores = [F.when(label == lab, conf).otherwise(F.lit(CLASSIFIER_BASE_PROB))
              for lab in SEVERITY_LABELS]
    total = reduce(lambda a, b: a + b, scores)
    probs = F.create_map(*[x for lab, s in zip(SEVERITY_LABELS, scores)
                           for x in (F.lit(lab), s / total)])
    return F.struct(label.alias("severity"), conf.alias("confidence"),
                    probs.alias("probabilities"))


def severity_columns(result: Column) -> list[Column]:
    """V2: flatten a classifier struct to named scalar columns."""
    return [result["severity"].alias("severity"),
            result["confidence"].alias("confidence")] + [
        result["probabilities"][lab].alias(f"p_{lab}") for lab in SEVERITY_LABELS]


def probability_long(df: DataFrame, result_col: str, keys: list[str]) -> DataFrame:
    """V3: one row per (label, probability, is_predicted)."""
    return df.select(*keys, F.col(result_col + ".severity").alias("predicted"),
                     F.explode(F.col(result_col + ".probabilities")).alias("label", "probability")
                     ).withColumn("is_predicted", F.col("label") == F.col("predicted")
                                  ).drop("predicted")


def filter_severities(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """keep rows whose severity is one of ``allowed``."""
    return df.filter(F.col(col).isin(allowed))


def encode_severity(c) -> Column:
    """SC13: lower-cased label -> 0/1/2, anything else null."""
    m = F.create_map(*[x for k, v in SEVERITY_LABEL_IDS.items() for x in (F.lit(k), F.lit(v))])
    return m[F.lower(col_(c))]


def decode_severity(c) -> Column:
    m = F.create_map(*[x for k, v in SEVERITY_LABEL_IDS.items() for x in (F.lit(v), F.lit(k))])
    return m[col_(c)]


def unknown_labels(df: DataFrame, severity_col: str) -> DataFrame:
    """Distinct label strings that do not map."""
    return (df.filter(encode_severity(severity_col).isNull())
              .select(F.col(severity_col).alias("unknown_label")).distinct())


def encode_and_drop(df: DataFrame, text_col: str, severity_col: str) -> DataFrame:
    """V4 first half: F13 both columns, SC13 into ``label``, F8 drop nulls."""
    require_columns(df, [text_col], "Text")
    require_columns(df, [severity_col], "Severity")
    return (df.withColumn("label", encode_severity(severity_col))
              .na.drop(subset=["label"]))
