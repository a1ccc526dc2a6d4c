"""Explanations: word weights per label, ranking, colours and
leave-one-word-out importance (X1-X3, W6, L6, L7, SC24, ML3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlens.functions.lexicons import (
    CLASSIFIER_BASE_PROB, CLASSIFIER_DEFAULT, CLASSIFIER_RULES, EXPLAIN_NEG_START,
    EXPLAIN_NEG_STEP, EXPLAIN_POS_START, EXPLAIN_POS_STEP, EXPLAIN_TOP_WORDS,
    IMPORTANCE_NEGATIVE_COLOR, IMPORTANCE_POSITIVE_COLOR, SEVERITY_LABELS,
)
from pvlens.functions.text import col_, let, words

FEATURE_TYPE = "array<struct<feature:string,weight:double>>"


def word_weights(text, predicted) -> Column:
    """``map<label, array<struct<feature, weight>>>`` over the first
    min(5, n) words; the predicted label weighs 0.5 - 0.1*i, the others
    -0.3 + 0.05*i."""
    def build(lead, pred):
        def feats(label):
            return F.transform(lead, lambda w, i: F.struct(
                w.alias("feature"),
                F.when(pred == F.lit(label),
                       F.lit(EXPLAIN_POS_START) - F.lit(-EXPLAIN_POS_STEP) * i)
                 .otherwise(F.lit(EXPLAIN_NEG_START) + F.lit(EXPLAIN_NEG_STEP) * i)
                 .alias("weight")))
        return F.create_map(*[x for lab in SEVERITY_LABELS for x in (F.lit(lab), feats(lab))])
    lead = F.slice(words(F.coalesce(col_(text), F.lit(""))), 1, EXPLAIN_TOP_WORDS)
    return let(build, lead, col_(predicted))


def explode_weights(df: DataFrame, keys: list[str], weights_col: str) -> DataFrame:
    """Long form of X1: (label, rank, feature, weight)."""
    return (df.select(*keys, F.explode(weights_col).alias("label", "feats"))
              .select(*keys, "label", F.posexplode("feats").alias("rank", "f"))
              .select(*keys, "label", "rank", F.col("f.feature").alias("feature"),
                      F.col("f.weight").alias("weight")))


def rank_by_abs_weight(features, n: int = 10) -> Column:
    """W6 + L7: by |weight| descending, stable, first ``n``."""
    idx = F.transform(col_(features), lambda f, i: F.struct(f["feature"].alias("feature"),
                                                          f["weight"].alias("weight"),
                                                          i.alias("i")))

    def cmp(a, b):
        aa, bb = F.abs(a["weight"]), F.abs(b["weight"])
        return (F.when(aa > bb, -1).when(aa < bb, 1)
                 .when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    ranked = F.array_sort(idx, cmp)
    return F.transform(F.slice(ranked, 1, n), lambda f: F.struct(
        f["feature"].alias("feature"), f["weight"].alias("weight")))


def top_predicted_features(weights, predicted, n: int = 5) -> Column:
    """First ``n`` features of the predicted label."""
    return F.slice(col_(weights)[col_(predicted)], 1, n)


def importance_color(weight) -> Column:
    """SC24: positive -> green, else red."""
    return F.when(col_(weight) > 0, F.lit(IMPORTANCE_POSITIVE_COLOR)).otherwise(
        F.lit(IMPORTANCE_NEGATIVE_COLOR))


def _prob_of(target: Column, hits: dict[str, Column]) -> Column:
    """Probability the rule classifier gives ``target`` when each rule term is
    present or not (``hits`` term -> boolean)."""
    label, conf = None, None
    for term, lab, c in CLASSIFIER_RULES:
        h = hits[term]
        label = F.when(h, F.lit(lab)) if label is None else label.when(h, F.lit(lab))
        conf = F.when(h, F.lit(c)) if conf is None else conf.when(h, F.lit(c))
    label = label.otherwise(F.lit(CLASSIFIER_DEFAULT[0]))
    conf = conf.otherwise(F.lit(CLASSIFIER_DEFAULT[1]))
    scores = {lab: F.when(label == lab, conf).otherwise(F.lit(CLASSIFIER_BASE_PROB))
              for lab in SEVERITY_LABELS}
    total = reduce(lambda a, b: a + b, [scores[lab] for lab in SEVERITY_LABELS])
    own = F.when(label == target, conf).otherwise(F.lit(CLASSIFIER_BASE_PROB))
    return own / total


def leave_one_out_importance(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """ML3: for each word, P(predicted | text) - P(predicted | text without
    that word), one row per (keys, idx, word, weight). Not LIME/SHAP.

    A rule term never spans a space, so a term survives removal of word i iff
    some other word holds it. The per-term word counts, the full label and
    its probability are computed once per text *below* the ``posexplode``;
    each word row then needs only scalar arithmetic — linear in the text."""
    terms = [t for t, _, _ in CLASSIFIER_RULES]

    def holds(term):
        return lambda w: F.instr(F.lower(w), term) > 0

    ws = df.select(*keys, words(F.coalesce(F.col(text_col), F.lit(""))).alias("_ws"))
    counted = ws.select(*keys, "_ws", *[F.size(F.filter("_ws", holds(t))).alias(f"_c_{i}")
                                        for i, t in enumerate(terms)])
    full_hits = {t: F.col(f"_c_{i}") > 0 for i, t in enumerate(terms)}
    label_full = None
    for term, lab, _ in CLASSIFIER_RULES:
        label_full = (F.when(full_hits[term], F.lit(lab)) if label_full is None
                      else label_full.when(full_hits[term], F.lit(lab)))
    label_full = label_full.otherwise(F.lit(CLASSIFIER_DEFAULT[0]))
    scored = counted.select(*keys, "_ws", *[f"_c_{i}" for i in range(len(terms))],
                            label_full.alias("_label"))
    scored = scored.withColumn("_p_full", _prob_of(F.col("_label"), full_hits))
    exploded = scored.select(*keys, "_label", "_p_full", *[f"_c_{i}" for i in range(len(terms))],
                             F.posexplode("_ws").alias("idx", "word"))
    lw = F.lower(F.col("word"))
    hits = {t: (F.col(f"_c_{i}") - F.when(F.instr(lw, t) > 0, 1).otherwise(0)) > 0
            for i, t in enumerate(terms)}
    return exploded.select(*keys, F.col("idx").cast("int").alias("idx"), "word",
                           (F.col("_p_full") - _prob_of(F.col("_label"), hits)).alias("weight"))
