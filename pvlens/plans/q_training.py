"""Queries of the training-set and explanation path: splits, annotation
tasks, word weights, leave-one-out importance, symptom clusters, the
preparation summary and document text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pvlens.functions.lexicons import (
    DEFAULT_SYMPTOMS, CLASSIFIER_BASE_PROB, CLASSIFIER_DEFAULT, CLASSIFIER_RULES, ENTITY_RULES,
    ENTITY_TYPES, SEVERITY_LABELS,
)
from pvlens.functions.text import clean_text, token_count, with_evaluated, words
from pvlens.operators import attribution as A
from pvlens.operators import explain as X
from pvlens.operators import severity as V
from pvlens.operators import symptoms as S
from pvlens.operators.entities import entities_of_type, extract_entities
from pvlens.operators.splits import complement, hash_split
from pvlens.operators.text import annotation_tasks, annotation_tasks_long, extract_candidates
from pvlens.plans import sqlparts as P
from pvlens.plans.catalog import register
from pvlens.plans.q_analysis import candidates
from pvlens.session import checkpoint_dir
from pvlens.sources import tables as T

_LAB, _CONF = P.classifier_sql("t")


# ---------------------------------------------------------------- severity training set

def severity_set(spark: SparkSession, sf: str) -> DataFrame:
    """K3 shape: (VAERS_ID, cleaned_text, severity) with the labeller's
    'unknown' kept, so the training step meets an unmapped label."""
    c = candidates(spark, sf)
    return V.label_severity(c, "cleaned_text", drop_unknown=False)


_SEV_SET = ("sevset AS (SELECT VAERS_ID, cleaned_text, " + P.labeller_sql("lower(cleaned_text)")
            + " AS severity FROM candidates)")
_ENCODED = ("encoded AS (SELECT VAERS_ID, cleaned_text, CAST(CASE lower(severity) WHEN 'mild' THEN 0 "
            "WHEN 'moderate' THEN 1 WHEN 'severe' THEN 2 END AS INTEGER) AS label FROM sevset)")
_SPLIT = ("split AS (SELECT VAERS_ID, cleaned_text AS text, label, CASE WHEN "
          "row_number() OVER (ORDER BY md5('42:' || CAST(VAERS_ID AS VARCHAR)), VAERS_ID) - 1 "
          "< round(0.8::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split "
          "FROM encoded WHERE label IS NOT NULL)")


def severity_split_df(spark: SparkSession, sf: str) -> DataFrame:
    enc = V.encode_and_drop(severity_set(spark, sf), "cleaned_text", "severity")
    return hash_split(enc.select("VAERS_ID", F.col("cleaned_text").alias("text"), "label"), "VAERS_ID")


@register("severity_split", P.with_views("SELECT * FROM split", "reports", P.CANDIDATES_CTE,
                                         _SEV_SET, _ENCODED, _SPLIT))
def q_severity_split(spark, sf):
    """V4 + L9: encode labels, drop unmapped, seeded 80/20 split with exactly
    round(0.8 n) training rows."""
    return severity_split_df(spark, sf)


@register("severity_unknown_labels", P.with_views(
    "SELECT DISTINCT severity AS unknown_label FROM sevset WHERE CASE lower(severity) WHEN 'mild' THEN 0 "
    "WHEN 'moderate' THEN 1 WHEN 'severe' THEN 2 END IS NULL", "reports", P.CANDIDATES_CTE, _SEV_SET))
def q_severity_unknown_labels(spark, sf):
    """Label strings the encoder cannot map."""
    return V.unknown_labels(severity_set(spark, sf), "severity")


@register("severity_validation", P.with_views(
    "SELECT VAERS_ID, text, label FROM encoded_text WHERE VAERS_ID NOT IN "
    "(SELECT VAERS_ID FROM split WHERE split = 'train')", "reports", P.CANDIDATES_CTE,
    _SEV_SET, _ENCODED, _SPLIT,
    "encoded_text AS (SELECT VAERS_ID, cleaned_text AS text, label FROM encoded WHERE label IS NOT NULL)"))
def q_severity_validation(spark, sf):
    """validation = labelled rows minus the training sample (left
    anti join on the id)."""
    s = severity_split_df(spark, sf)
    allrows = s.drop("split")
    return complement(allrows, s.filter(F.col("split") == "train"), ["VAERS_ID"])


# ---------------------------------------------------------------- annotation tasks (D2), summary

@register("annotation_tasks", P.with_views(
    "SELECT VAERS_ID, cleaned_text AS text, 'VAERS_ID' AS meta_key, CAST(VAERS_ID AS VARCHAR) AS meta_value "
    "FROM candidates_y UNION ALL SELECT VAERS_ID, cleaned_text, 'year', year FROM candidates_y",
    "reports", P.CANDIDATES_CTE,
    "candidates_y AS (SELECT c.VAERS_ID, c.cleaned_text, r.year FROM candidates c JOIN reports r USING (VAERS_ID))"))
def q_annotation_tasks(spark, sf):
    """One task per candidate, metadata stringified; the absent 'id'
    column is skipped silently."""
    cand = extract_candidates(T.reports(spark, sf), "SYMPTOM_TEXT")
    tasks = annotation_tasks(cand, "cleaned_text", ["VAERS_ID", "year", "id"], keys=["VAERS_ID"])
    return annotation_tasks_long(tasks, "VAERS_ID")


@register("preparation_summary", P.with_views(
    """SELECT 'total_records' AS metric, count(*) AS value FROM reports
UNION ALL SELECT 'candidate_descriptions', count(*) FROM candidates
UNION ALL SELECT 'labeled_severity_examples', count(*) FROM sevset WHERE severity <> 'unknown'
UNION ALL SELECT 'unique_symptoms', count(DISTINCT s) FROM (SELECT unnest(""" + P.symptoms_sql("cleaned_text") +
    f""") AS s FROM candidates)
UNION ALL SELECT 'entity_types', CAST({len(ENTITY_TYPES)} AS BIGINT)""",
    "reports", P.CANDIDATES_CTE, _SEV_SET))
def q_preparation_summary(spark, sf):
    """The preparation job's summary record, as (metric, value) rows.
    The three counts come from ONE aggregate over the reports (candidate and
    label flags per row); the distinct-symptom count is one scalar
    subquery. Two scans in all."""
    r = T.reports(spark, sf).select(F.coalesce(F.col("SYMPTOM_TEXT"), F.lit("")).alias("raw"))
    base = with_evaluated(r, "cleaned", clean_text(F.col("raw")))
    is_cand = F.length("cleaned").between(10, 500)
    counts = base.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(is_cand).alias("candidate_descriptions"),
        F.count_if(is_cand & (V.severity_label(F.col("cleaned")) != "unknown")).alias("labeled_severity_examples"))
    syms = (base.filter(is_cand).select(F.explode(S.extract_symptoms(F.col("cleaned"))).alias("s"))
                .agg(F.count_distinct("s")))
    one = counts.select("*", syms.scalar().alias("unique_symptoms"),
                        F.lit(len(ENTITY_TYPES)).cast("long").alias("entity_types"))
    return one.unpivot([], ["total_records", "candidate_descriptions", "labeled_severity_examples",
                            "unique_symptoms", "entity_types"], "metric", "value")


# ---------------------------------------------------------------- explanations (X1, L6, L7, W6, SC24, ML3)

_WORDS = "batch_words AS (SELECT VAERS_ID, " + P.words_sql("text") + f" AS words, {_LAB} AS severity FROM batch_base)"


@register("word_weights", P.with_views(
    """SELECT VAERS_ID, label, CAST(i AS INTEGER) AS rank, words[i + 1] AS feature,
       CASE WHEN label = severity THEN 0.5::DOUBLE - 0.1::DOUBLE * i ELSE -0.3::DOUBLE + 0.05::DOUBLE * i END AS weight
FROM (SELECT VAERS_ID, words, severity, unnest(['mild', 'moderate', 'severe']) AS label FROM batch_words),
     LATERAL (SELECT unnest(range(0, least(5, len(words)))) AS i)""", "reports", P.BATCH_CTE, _WORDS))
def q_word_weights(spark, sf):
    """Per report and label, the first five words and their weights."""
    r = T.reports(spark, sf).select("VAERS_ID", F.coalesce(F.col("SYMPTOM_TEXT"), F.lit("")).alias("text"))
    r = r.withColumn("sev", V.classify_severity(F.col("text"))["severity"])
    w = r.select("VAERS_ID", X.word_weights(F.col("text"), F.col("sev")).alias("w"))
    return X.explode_weights(w, ["VAERS_ID"], "w")


@register("top_features", P.with_views(
    """SELECT VAERS_ID, CAST(i AS INTEGER) AS rank, words[i + 1] AS feature,
       CASE WHEN severity = 'mild' THEN 0.5::DOUBLE - 0.1::DOUBLE * i ELSE -0.3::DOUBLE + 0.05::DOUBLE * i END AS weight,
       CASE WHEN severity = 'mild' THEN '#99ff99' ELSE '#ff9999' END AS color
FROM batch_words, LATERAL (SELECT unnest(range(0, least(5, len(words)))) AS i)""",
    "reports", P.BATCH_CTE, _WORDS))
def q_top_features(spark, sf):
    """L7 + W6 + SC24: top-10 features of the first label ('mild') by
    |weight| with their bar colour."""
    r = T.reports(spark, sf).select("VAERS_ID", F.coalesce(F.col("SYMPTOM_TEXT"), F.lit("")).alias("text"))
    r = r.withColumn("sev", V.classify_severity(F.col("text"))["severity"])
    w = r.select("VAERS_ID", X.rank_by_abs_weight(
        X.word_weights(F.col("text"), F.col("sev"))[F.lit("mild")], 10).alias("f"))
    return (w.select("VAERS_ID", F.posexplode("f").alias("rank", "x"))
             .select("VAERS_ID", "rank", F.col("x.feature").alias("feature"),
                     F.col("x.weight").alias("weight"), X.importance_color(F.col("x.weight")).alias("color")))


@register("predicted_top5", P.with_views(
    """SELECT VAERS_ID, severity AS label, CAST(i AS INTEGER) AS rank, words[i + 1] AS feature,
       0.5::DOUBLE - 0.1::DOUBLE * i AS weight
FROM batch_words, LATERAL (SELECT unnest(range(0, least(5, len(words)))) AS i)""",
    "reports", P.BATCH_CTE, _WORDS))
def q_predicted_top5(spark, sf):
    """First five features of the predicted label."""
    r = T.reports(spark, sf).select("VAERS_ID", F.coalesce(F.col("SYMPTOM_TEXT"), F.lit("")).alias("text"))
    r = r.withColumn("label", V.classify_severity(F.col("text"))["severity"])
    w = r.select("VAERS_ID", "label", X.top_predicted_features(
        X.word_weights(F.col("text"), F.col("label")), F.col("label"), 5).alias("f"))
    return (w.select("VAERS_ID", "label", F.posexplode("f").alias("rank", "x"))
             .select("VAERS_ID", "label", "rank", F.col("x.feature").alias("feature"),
                     F.col("x.weight").alias("weight")))


def _prob_sql(target: str, hs: str, hm: str, hmi: str) -> str:
    """P(target) of the rule classifier given presence flags of its terms."""
    flags = {"severe": hs, "moderate": hm, "mild": hmi}
    label = "CASE " + " ".join(f"WHEN {flags[t]} THEN {P.q(l)}" for t, l, _ in CLASSIFIER_RULES) + \
        f" ELSE {P.q(CLASSIFIER_DEFAULT[0])} END"
    conf = "CASE " + " ".join(f"WHEN {flags[t]} THEN {c}::DOUBLE" for t, _, c in CLASSIFIER_RULES) + \
        f" ELSE {CLASSIFIER_DEFAULT[1]}::DOUBLE END"
    sc = {l: f"(CASE WHEN ({label}) = {P.q(l)} THEN {conf} ELSE {CLASSIFIER_BASE_PROB}::DOUBLE END)"
          for l in SEVERITY_LABELS}
    own = f"(CASE WHEN ({label}) = {target} THEN {conf} ELSE {CLASSIFIER_BASE_PROB}::DOUBLE END)"
    return f"({own} / (({sc['mild']} + {sc['moderate']}) + {sc['severe']}))"


def _loo_sql() -> str:
    counts = ", ".join(f"len(list_filter(words, lambda x: strpos(lower(x), {P.q(t)}) > 0)) AS c_{t}"
                       for t, _, _ in CLASSIFIER_RULES)
    full_label = ("CASE " + " ".join(f"WHEN c_{t} > 0 THEN {P.q(l)}" for t, l, _ in CLASSIFIER_RULES)
                  + f" ELSE {P.q(CLASSIFIER_DEFAULT[0])} END")
    full = _prob_sql("full_label", "c_severe > 0", "c_moderate > 0", "c_mild > 0")
    wo = {t: f"(c_{t} - CASE WHEN strpos(lower(word), {P.q(t)}) > 0 THEN 1 ELSE 0 END) > 0"
          for t, _, _ in CLASSIFIER_RULES}
    without = _prob_sql("full_label", wo["severe"], wo["moderate"], wo["mild"])
    return P.with_views(
        f"""SELECT VAERS_ID, CAST(idx AS INTEGER) AS idx, word, {full} - {without} AS weight FROM (
  SELECT *, {full_label} AS full_label FROM (
    SELECT VAERS_ID, {counts}, unnest(words) AS word, unnest(range(0, len(words))) AS idx FROM batch_words))""",
        "reports", P.BATCH_CTE, _WORDS)


@register("loo_importance", _loo_sql())
def q_loo_importance(spark, sf):
    """ML3: leave-one-word-out importance of every word for the predicted
    label (a deterministic stand-in for LIME/SHAP, not those methods)."""
    return X.leave_one_out_importance(T.reports(spark, sf), "SYMPTOM_TEXT", ["VAERS_ID"])


def _shapley_sql() -> str:
    """Every coalition of the words that hold a rule's term, by its definition."""
    worth = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in A.rule_probabilities()) + "]"
    rule = "CASE " + " ".join(f"WHEN strpos(lower(w), {P.q(t)}) > 0 THEN {r}"
                              for r, (t, _, _) in enumerate(CLASSIFIER_RULES)) + f" ELSE {A.RULES} END"
    return P.with_views(
        f"""SELECT ws.VAERS_ID, CAST(ws.idx AS INTEGER) AS idx, ws.word, round(coalesce(v.value, 0), 9) AS value
FROM (SELECT VAERS_ID, unnest(words) AS word, unnest(range(0, len(words))) AS idx FROM batch_words) ws
LEFT JOIN (
  SELECT VAERS_ID, places[i + 1] AS idx, sum(
    factorial(bit_count(m)::INTEGER) * factorial((p - bit_count(m) - 1)::INTEGER) / factorial(p::INTEGER)::DOUBLE * (more - less)) AS value
  FROM (
    SELECT VAERS_ID, places, p, i, m,
      worth[list_min(list_concat(list_filter(held, lambda r, k: ((m | (1::BIGINT << i)) >> (k - 1)) & 1 = 1), [{A.RULES}])) + 1] AS more,
      worth[list_min(list_concat(list_filter(held, lambda r, k: (m >> (k - 1)) & 1 = 1), [{A.RULES}])) + 1] AS less
    FROM (
      SELECT *, unnest(range(0, p)) AS i FROM (
        SELECT *, unnest(range(0, 1::BIGINT << p)) AS m FROM (
          SELECT VAERS_ID, list_filter(rules, lambda r: r < {A.RULES}) AS held, len(list_filter(rules, lambda r: r < {A.RULES})) AS p,
            list_filter(range(0, len(rules)), lambda x: rules[x + 1] < {A.RULES}) AS places,
            {worth}[coalesce(list_min(rules), {A.RULES}) + 1] AS worth
          FROM (SELECT VAERS_ID, list_transform(words, lambda w: {rule}) AS rules FROM batch_words))))
    WHERE (m >> i) & 1 = 0)
  GROUP BY VAERS_ID, places[i + 1]) v ON v.VAERS_ID = ws.VAERS_ID AND v.idx = ws.idx""",
        "reports", P.BATCH_CTE, _WORDS)


@register("shapley_importance", _shapley_sql())
def q_shapley_importance(spark, sf):
    """ML3: exact Shapley values of every word for the predicted label (rounded to
    9 places); the oracle goes over all coalitions."""
    return A.shapley_importance(T.reports(spark, sf), "SYMPTOM_TEXT", ["VAERS_ID"]).withColumn(
        "value", F.round("value", 9))


@register("surrogate_importance")
def q_surrogate_importance(spark, sf):
    """ML3: weights of every word in a local surrogate (masked texts, rescored,
    proximity-weighted ridge regression)."""
    return A.surrogate_importance(T.reports(spark, sf), "SYMPTOM_TEXT", ["VAERS_ID"])


# ---------------------------------------------------------------- symptom clusters

_SYM_LIST = ("sym_list AS (SELECT VAERS_ID, list_filter([" + ", ".join(
    f"CASE WHEN {P.has('t', term)} THEN {P.q(term)} END" for typ, term in ENTITY_RULES if typ == "SYMPTOM")
    + "], lambda x: x IS NOT NULL) AS syms FROM batch_base)")


@register("symptom_clusters", P.with_views(
    """SELECT VAERS_ID, CAST(i AS INTEGER) AS id, syms[i + 1] AS label, CAST(i % least(3, len(syms)) AS INTEGER) AS cluster,
       round(0.5::DOUBLE + 0.4::DOUBLE * cos((CAST(i AS DOUBLE) / len(syms)) * 2.0::DOUBLE * 3.14159::DOUBLE), 9) AS x,
       round(0.5::DOUBLE + 0.4::DOUBLE * sin((CAST(i AS DOUBLE) / len(syms)) * 2.0::DOUBLE * 3.14159::DOUBLE), 9) AS y
FROM sym_list, LATERAL (SELECT unnest(range(0, len(syms))) AS i)""", "reports", P.BATCH_CTE, _SYM_LIST))
def q_symptom_clusters(spark, sf):
    """C1 + C2 + C4: each report's SYMPTOM entities clustered round-robin
    (k = min(3, n)) with circle coordinates (rounded to 9 places)."""
    r = T.reports(spark, sf).select("VAERS_ID", F.transform(entities_of_type(
        extract_entities(F.col("SYMPTOM_TEXT")), "SYMPTOM"), lambda e: e["text"]).alias("syms"))
    pts = r.select("VAERS_ID", F.explode(S.cluster_list(F.col("syms"))).alias("p"))
    return pts.select("VAERS_ID", F.col("p.id").alias("id"), F.col("p.label").alias("label"),
                      F.col("p.cluster").alias("cluster"), F.round("p.x", 9).alias("x"),
                      F.round("p.y", 9).alias("y"))


@register("symptom_cluster_groups", P.with_views(
    """SELECT VAERS_ID, CAST(c AS INTEGER) AS cluster,
       array_to_string(list_filter(syms, lambda s, j: (j - 1) % least(3, len(syms)) = c), ', ') AS members
FROM sym_list, LATERAL (SELECT unnest(range(0, least(3, len(syms)))) AS c)
WHERE len(syms) > 0""", "reports", P.BATCH_CTE, _SYM_LIST))
def q_symptom_cluster_groups(spark, sf):
    """Cluster id -> symptoms in list order, per report (reports without
    symptoms have no entry)."""
    r = T.reports(spark, sf).select("VAERS_ID", S.cluster_groups(F.transform(entities_of_type(
        extract_entities(F.col("SYMPTOM_TEXT")), "SYMPTOM"), lambda e: e["text"])).alias("g"))
    return (r.select("VAERS_ID", F.explode("g").alias("cluster", "m"))
             .select("VAERS_ID", "cluster", F.array_join("m", ", ").alias("members")))


_RANKED = ("ranked AS (SELECT symptom, CAST(row_number() OVER (ORDER BY n_docs DESC, symptom) - 1 AS BIGINT) AS i, "
           "count(*) OVER () AS n FROM (SELECT symptom, count(*) AS n_docs FROM (SELECT unnest("
           + P.symptoms_sql("cleaned_text") + ") AS symptom FROM candidates) GROUP BY symptom))")
_CTABLE = ("""SELECT i AS id, symptom AS label, CAST(i % least(3, n) AS INTEGER) AS cluster,
       0.5::DOUBLE + 0.4::DOUBLE * cos((CAST(i AS DOUBLE) / n) * 2.0::DOUBLE * 3.14159::DOUBLE) AS x,
       0.5::DOUBLE + 0.4::DOUBLE * sin((CAST(i AS DOUBLE) / n) * 2.0::DOUBLE * 3.14159::DOUBLE) AS y FROM ranked""")


def cluster_table_df(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf).select(S.extract_symptoms(F.col("cleaned_text")).alias("symptoms"))
    # at most one row per dictionary term; written once so the ranking and
    # the row count below both read it instead of re-running the extraction
    checkpoint_dir(spark)
    freq = S.symptom_frequency(c).checkpoint(eager=True)
    # the ranked list has at most one row per dictionary term, so the
    # one-task ranking window works on a bounded input
    ranked = freq.withColumn("i", (F.row_number().over(
        Window.orderBy(F.col("n_docs").desc(), F.col("symptom").asc())) - 1).cast("long"))
    # one scalar subquery, pinned as a column (each reference would rerun it)
    ranked = with_evaluated(ranked, "_n", freq.agg(F.count(F.lit(1))).scalar())
    return S.cluster_table(ranked, "i", F.col("_n"))


@register("cluster_symptom_table", P.with_views(
    "SELECT id, label, cluster, round(x, 9) AS x, round(y, 9) AS y FROM (" + _CTABLE + ")",
    "reports", P.CANDIDATES_CTE, _RANKED))
def q_cluster_symptom_table(spark, sf):
    """C3 + W5: the ranked symptom list clustered round-robin in rank order."""
    t = cluster_table_df(spark, sf)
    return t.select("id", "label", "cluster", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@register("cluster_summary", P.with_views(
    "SELECT cluster, count(*) AS n_points, round(avg(x), 9) AS mean_x, round(avg(y), 9) AS mean_y, "
    "cluster = -1 AS is_noise FROM (" + _CTABLE + ") GROUP BY cluster", "reports", P.CANDIDATES_CTE, _RANKED))
def q_cluster_summary(spark, sf):
    """Points and centroid per cluster (noise id -1 flagged)."""
    return S.cluster_summary(cluster_table_df(spark, sf))


# ---------------------------------------------------------------- documents (SC1, SC3, SC7, SC25, F6)

@register("document_text_stats", """SELECT doc_id, CAST(length(cleaned) AS INTEGER) AS n_chars_clean, CAST(len(""" +
          """list_filter(string_split(cleaned, ' '), lambda w: w <> '')) AS INTEGER) AS n_words,
       length(cleaned) BETWEEN 10 AND 500 AS is_candidate
FROM (SELECT doc_id, """ + P.clean_sql("coalesce(text, '')") + """ AS cleaned FROM documents)""")
def q_document_text_stats(spark, sf):
    """SC1 + SC3 + SC7/SC25 + F6 over whole documents: cleaned length, word
    (placeholder token) count and the candidate flag."""
    d = T.read_table(spark, sf, "documents").select("doc_id", clean_text(
        F.coalesce(F.col("text"), F.lit(""))).alias("cleaned"))
    return d.select("doc_id", F.length("cleaned").alias("n_chars_clean"),
                    token_count(F.col("cleaned")).alias("n_words"),
                    F.length("cleaned").between(10, 500).alias("is_candidate"))


# ---------------------------------------------------------------- models (ML1, ML2): rows-only checks

@register("severity_model_predictions")
def q_severity_model_predictions(spark, sf):
    """ML1: TF-IDF logistic regression fitted on the training split of the
    severity set, predicting the validation split."""
    from pvlens.operators.ml import fit_severity_model, predict_severity
    s = severity_split_df(spark, sf)
    model = fit_severity_model(s.filter(F.col("split") == "train"))
    val = s.filter(F.col("split") == "validation")
    return predict_severity(model, val, ["VAERS_ID", "label"])


@register("embedding_clusters")
def q_embedding_clusters(spark, sf):
    """ML2: k-means clusters of the embedding vectors (not HDBSCAN)."""
    from pvlens.operators.ml import cluster_embeddings
    emb = T.read_table(spark, sf, "embeddings")
    return cluster_embeddings(emb).select("vec_id", "label", "cluster")


@register("density_clusters")
def q_density_clusters(spark, sf):
    """ML2: density clusters of all embedding vectors, -1 for noise."""
    from pvlens.operators.density import density_clusters
    emb = T.read_table(spark, sf, "embeddings")
    return density_clusters(emb, "vec_id", cut=0.62, min_points=4).select("vec_id", "label", "cluster")


# ---------------------------------------------------------------- whole documents (D3, V1, D4 on long texts)

@register("document_severity",
          "SELECT doc_id, " + P.labeller_sql("t") + f" AS label, {_LAB} AS predicted, {_CONF} AS confidence "
          "FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def q_document_severity(spark, sf):
    """D3 + V1 over whole documents (up to 20,000 words each): the keyword
    label and the rule classifier's label and confidence."""
    d = T.read_table(spark, sf, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sev = V.classify_severity(F.col("text"))
    return d.select("doc_id", V.severity_label(F.col("text")).alias("label"),
                    sev["severity"].alias("predicted"), sev["confidence"].alias("confidence"))


# Words of the documents beside the built-in terms, which they do not hold; no term
# of the list occurs inside another's match there.
DOCUMENT_TERMS = DEFAULT_SYMPTOMS + ["and", "der", "que", "la", "in the", "en", "avec"]
_NO_WORD = r"[^\p{L}\p{N}_]"


@register("document_symptoms", "SELECT doc_id, term AS symptom FROM documents, (SELECT unnest(["
          + ", ".join(P.q(t.lower()) for t in dict.fromkeys(DOCUMENT_TERMS)) + "]) AS term) WHERE contains(lower(text), term) "
          f"AND regexp_matches(lower(text), '(^|{_NO_WORD})' || term || '({_NO_WORD}|$)')")
def q_document_symptoms(spark, sf):
    """D4 over whole documents with the large-dictionary (n-gram join) form, terms that
    occur included."""
    d = T.read_table(spark, sf, "documents").select("doc_id", "text")
    return S.extract_symptoms_join(d, "text", ["doc_id"], S.dictionary_frame(spark, DOCUMENT_TERMS))
