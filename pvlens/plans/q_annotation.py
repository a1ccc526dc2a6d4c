"""Queries of the annotation path: mention spans, the annotation set with
its deliberate defects, BIO tags and the NER split, the QA checks, span and
classifier metrics, highlighting and the further entity types — each with
a DuckDB oracle.

The annotation set is built from the report narratives (``FIXTURES.md``
§4): gold spans are all mentions of the annotation rules, and six of every
seven reports get one defect (see :func:`corrupt_annotations`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlens.functions.lexicons import (
    ANNOTATION_RULES, COMPOUND_FIXED_EXPRESSIONS, ENTITY_RULES, EXTRA_ENTITY_PATTERNS,
    HIGHLIGHT_COLOR_DEFAULT, HIGHLIGHT_COLORS,
    QA_MODIFIERS, QA_SKIP_TERMS, QA_TIME_PATTERN, SEVERITY_ENTITY_TERMS,
)
from pvlens.functions.text import let, with_evaluated
from pvlens.operators import annotation as A
from pvlens.operators import severity as V
from pvlens.operators.entities import all_mentions, extract_entities, highlight
from pvlens.plans import sqlparts as P
from pvlens.plans.catalog import register
from pvlens.plans.q_analysis import candidates
from pvlens.sources import tables as T

KEYS = ["VAERS_ID"]
METRIC_TYPES = ["DRUG", "SYMPTOM", "SEVERITY"]


# ---------------------------------------------------------------- the annotation set's defects

def corrupt_annotations(key: Column, text: Column, spans: Column) -> Column:
    """Fixture annotations: gold mention spans with one deliberate defect in
    six of every seven documents, chosen by ``key % 7`` — 1 first span moved
    right by one, 2 time words added to the first SYMPTOM span, 3 last span
    dropped, 4 an overlapping copy of the first span added, 5 a skip-list
    span ('not feeling well') recorded, 6 the first SYMPTOM span stretched
    to the end of the last SYMPTOM span (a compound)."""
    m = key % 7

    def build(sp, t):
        n = F.size(sp)
        first_sym = F.array_position(F.transform(sp, lambda s: s["label"]), F.lit("SYMPTOM")) - 1
        last_sym_end = F.array_max(F.transform(F.filter(sp, lambda s: s["label"] == "SYMPTOM"),
                                               lambda s: s["end"]))

        def span(label, start, end, txt):
            return F.struct(label.alias("label"), start.cast("int").alias("start"),
                            end.cast("int").alias("end"), txt.alias("text"))
        moved = F.transform(sp, lambda s, i: F.when(i == 0, span(
            s["label"], s["start"] + 1, s["end"] + 1, s["text"])).otherwise(s))
        timed = F.transform(sp, lambda s, i: F.when(i == first_sym, span(
            s["label"], s["start"], s["end"] + 11, F.concat(s["text"], F.lit(" for 2 days"))))
            .otherwise(s))
        dropped = F.slice(sp, 1, F.greatest(n - 1, F.lit(0)))
        overlap = F.when(n > 0, F.concat(sp, F.array(span(
            sp[0]["label"], sp[0]["start"] + 1, sp[0]["end"] + 1,
            F.substring(t, sp[0]["start"] + 2, sp[0]["end"] - sp[0]["start"]))))).otherwise(sp)
        skip = F.concat(sp, F.array(span(F.lit("SYMPTOM"), F.lit(0), F.lit(16),
                                         F.lit("not feeling well"))))
        compound = F.transform(sp, lambda s, i: F.when(i == first_sym, span(
            s["label"], s["start"], last_sym_end,
            F.substring(t, s["start"] + 1, last_sym_end - s["start"]))).otherwise(s))
        return (F.when(m == 1, moved).when(m == 2, timed).when(m == 3, dropped)
                 .when(m == 4, overlap).when(m == 5, skip).when(m == 6, compound)
                 .otherwise(sp))
    return let(build, spans, F.coalesce(text, F.lit("")))


# ---------------------------------------------------------------- shared Spark plans

def annotated_reports(spark: SparkSession, sf: str) -> DataFrame:
    """(VAERS_ID, text, gold, spans): gold mention spans and the annotation
    set with its defects, one row per report."""
    r = T.reports(spark, sf).select("VAERS_ID", F.coalesce(F.col("SYMPTOM_TEXT"), F.lit("")).alias("text"))
    r = with_evaluated(r, "gold", A.mention_spans(F.col("text"), ANNOTATION_RULES))
    return r.select("VAERS_ID", "text", "gold",
                    corrupt_annotations(F.col("VAERS_ID"), F.col("text"), F.col("gold")).alias("spans"))


def annotation_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.explode_spans(annotated_reports(spark, sf), KEYS)


def exported_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """The annotation set in export shape and read back through F14."""
    ann = annotated_reports(spark, sf)
    return A.from_export(A.to_export(ann, "text", "spans", keys=KEYS), KEYS)


# ---------------------------------------------------------------- DuckDB twins

def _e2_sql(t_lower: str, t_orig: str, rules) -> str:
    parts = []
    for typ, term in rules:
        L = len(term)
        pieces = f"string_split({t_lower}, {P.q(term)})"
        start = f"CAST(list_sum(list_transform(({pieces})[1:j], lambda p: length(p))) + (j - 1) * {L} AS INTEGER)"
        parts.append(f"list_transform(range(1, len({pieces})), lambda j: {{'label': {P.q(typ)}, "
                     f"'start': {start}, 'end': {start} + {L}, "
                     f"'text': substring({t_orig}, {start} + 1, {L})}})")
    return "flatten([" + ", ".join(parts) + "])"


def _span_sql(label: str, start: str, end: str, text: str) -> str:
    return (f"{{'label': {label}, 'start': CAST({start} AS INTEGER), 'end': CAST({end} AS INTEGER), "
            f"'text': {text}}}")


_FIRST_SYM = "list_position(list_transform(gold, lambda s: s.label), 'SYMPTOM')"
_LAST_SYM_END = "list_max(list_transform(list_filter(gold, lambda s: s.label = 'SYMPTOM'), lambda s: s['end']))"
_CORRUPT_SQL = f"""CASE VAERS_ID % 7
    WHEN 1 THEN list_transform(gold, lambda s, i: CASE WHEN i = 1 THEN {_span_sql("s.label", "s.start + 1", "s['end'] + 1", "s.text")} ELSE s END)
    WHEN 2 THEN list_transform(gold, lambda s, i: CASE WHEN i = {_FIRST_SYM} THEN {_span_sql("s.label", "s.start", "s['end'] + 11", "s.text || ' for 2 days'")} ELSE s END)
    WHEN 3 THEN gold[1:len(gold) - 1]
    WHEN 4 THEN CASE WHEN len(gold) > 0 THEN list_append(gold, {_span_sql("gold[1].label", "gold[1].start + 1", "gold[1]['end'] + 1", "substring(text, gold[1].start + 2, gold[1]['end'] - gold[1].start)")}) ELSE gold END
    WHEN 5 THEN list_append(gold, {_span_sql("'SYMPTOM'", "0", "16", "'not feeling well'")})
    WHEN 6 THEN list_transform(gold, lambda s, i: CASE WHEN i = {_FIRST_SYM} THEN {_span_sql("s.label", "s.start", _LAST_SYM_END, f"substring(text, s.start + 1, {_LAST_SYM_END} - s.start)")} ELSE s END)
    ELSE gold END"""

ANN_CTES = [
    "ann_base AS (SELECT VAERS_ID, coalesce(SYMPTOM_TEXT, '') AS text, lower(coalesce(SYMPTOM_TEXT, '')) AS t FROM reports)",
    f"ann_gold AS (SELECT VAERS_ID, text, t, {_e2_sql('t', 'text', ANNOTATION_RULES)} AS gold FROM ann_base)",
    f"ann AS (SELECT VAERS_ID, text, t, gold, {_CORRUPT_SQL} AS spans FROM ann_gold)",
    """ann_rows AS (SELECT VAERS_ID, text, CAST(ann_idx AS INTEGER) AS ann_idx, s.label AS label,
       s.start AS start, s['end'] AS "end", s.text AS span_text
  FROM (SELECT VAERS_ID, text, unnest(spans) AS s, generate_subscripts(spans, 1) - 1 AS ann_idx FROM ann))""",
]


def _ann(body: str, *extra: str) -> str:
    return P.with_views(body, "reports", *ANN_CTES, *extra)


# ---------------------------------------------------------------- spans (E2) and the annotation set

@register("mention_spans", _ann(
    """SELECT VAERS_ID, CAST(ann_idx AS INTEGER) AS ann_idx, s.label AS label, s.start AS start,
       s['end'] AS "end", s.text AS span_text
FROM (SELECT VAERS_ID, unnest(gold) AS s, generate_subscripts(gold, 1) - 1 AS ann_idx FROM ann_gold)"""))
def q_mention_spans(spark, sf):
    """Every mention of every annotation term as its own span."""
    a = annotated_reports(spark, sf).select("VAERS_ID", "text", F.col("gold").alias("spans"))
    return A.explode_spans(a, KEYS).drop("text")


@register("annotation_spans", _ann('SELECT VAERS_ID, ann_idx, label, start, "end", span_text FROM ann_rows'))
def q_annotation_spans(spark, sf):
    """The annotation set, one row per span (defects included)."""
    return annotation_rows(spark, sf).drop("text")


# ---------------------------------------------------------------- BIO tags (E7) and the NER set

_BIO_SQL = """list_reduce(spans, lambda acc, s: list_transform(acc, lambda tag, i:
      CASE WHEN i - 1 = s.start THEN 'B-' || s.label
           WHEN i - 1 > s.start AND i - 1 < least(s['end'], n) THEN 'I-' || s.label ELSE tag END),
    list_transform(range(n), lambda x: 'O'))"""
_BIO_CTE = ("bio AS (SELECT VAERS_ID, " + _BIO_SQL + " AS tags FROM (SELECT VAERS_ID, spans, "
            "CAST(length(text) AS BIGINT) AS n FROM ann WHERE len(spans) > 0 AND text <> ''))")


@register("bio_tags", _ann("SELECT VAERS_ID, CAST(len(tags) AS INTEGER) AS n_tags, "
                           "array_to_string(tags, ' ') AS tags FROM bio", _BIO_CTE))
def q_bio_tags(spark, sf):
    """E7 + F14 over the annotation export: one tag per character, later
    spans overwrite earlier ones; empty annotations are skipped."""
    ex = exported_annotations(spark, sf)
    tags = ex.select("VAERS_ID", A.bio_tags(F.col("text"), F.col("spans")).alias("tags"))
    return tags.select("VAERS_ID", F.size("tags").alias("n_tags"), F.array_join("tags", " ").alias("tags"))


@register("ner_dataset", _ann(
    """SELECT VAERS_ID, CAST(len(tags) AS INTEGER) AS n_tags,
       CASE WHEN row_number() OVER (ORDER BY VAERS_ID) - 1 < floor(0.8::DOUBLE * count(*) OVER ())
            THEN 'train' ELSE 'validation' END AS split FROM bio""", _BIO_CTE))
def q_ner_dataset(spark, sf):
    """The BIO set split by position (first int(0.8 n) documents in id
    order are train) through the range-partitioned global index."""
    ex = exported_annotations(spark, sf)
    ds = A.ner_dataset(ex, KEYS)
    return ds.select("VAERS_ID", F.size("tags").alias("n_tags"), "split")


# ---------------------------------------------------------------- QA (Q1-Q5, Q7)

@register("qa_slice_mismatch", _ann(
    """SELECT VAERS_ID, ann_idx, label, start, "end", span_text,
       substring(text, start + 1, "end" - start) AS source_text
FROM ann_rows WHERE substring(text, start + 1, "end" - start) <> span_text"""))
def q_qa_slice_mismatch(spark, sf):
    """Q1: spans whose recorded text is not the source slice (casing kept)."""
    rows = annotation_rows(spark, sf)
    return rows.filter(A.slice_mismatch(rows)).select(
        "VAERS_ID", "ann_idx", "label", "start", "end", "span_text",
        F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("source_text"))


@register("qa_time_in_span", _ann(
    f"""SELECT VAERS_ID, ann_idx, label, span_text FROM ann_rows
WHERE regexp_matches(lower(span_text), {P.q(QA_TIME_PATTERN)})"""))
def q_qa_time_in_span(spark, sf):
    """Q2: time expressions inside a span."""
    return annotation_rows(spark, sf).filter(A.time_in_span()).select(
        "VAERS_ID", "ann_idx", "label", "span_text")


_MODS = ", ".join(P.q(m) for m in QA_MODIFIERS)


@register("qa_modifier_left_out", _ann(
    f"""SELECT VAERS_ID, ann_idx, span_text, modifier FROM (
  SELECT *, lower(regexp_extract(substring(text, 1, start), '([A-Za-z-]+)\\s+$', 1)) AS modifier FROM ann_rows
  WHERE label = 'SYMPTOM') WHERE modifier IN ({_MODS})"""))
def q_qa_modifier_left_out(spark, sf):
    """Q3: SYMPTOM spans that leave out the severity word right before them."""
    rows = annotation_rows(spark, sf)
    return (rows.filter(A.modifier_left_out())
                .select("VAERS_ID", "ann_idx", "span_text", A.word_before().alias("modifier")))


_SKIP_VALUES = ", ".join(f"({P.q(t)}, {P.q(r)})" for t, r in QA_SKIP_TERMS)


@register("qa_skip_list", _ann(
    f"""SELECT VAERS_ID, ann_idx, span_text, reason FROM ann_rows
JOIN (VALUES {_SKIP_VALUES}) AS lex(term, reason) ON lower(trim(span_text)) = term"""))
def q_qa_skip_list(spark, sf):
    """Q4: spans on the skip list (broadcast anti-lexicon join)."""
    return A.skip_list_hits(annotation_rows(spark, sf)).select("VAERS_ID", "ann_idx", "span_text", "reason")


_FIXED = ", ".join(P.q(x) for x in COMPOUND_FIXED_EXPRESSIONS)


@register("qa_compound_spans", _ann(
    f"""SELECT VAERS_ID, ann_idx, label, span_text FROM ann_rows
WHERE strpos(lower(span_text), ' and ') > 0 AND lower(span_text) NOT IN ({_FIXED})"""))
def q_qa_compound_spans(spark, sf):
    """Q5: spans joining separate findings with 'and'."""
    return annotation_rows(spark, sf).filter(A.compound_span()).select(
        "VAERS_ID", "ann_idx", "label", "span_text")


@register("qa_overlaps", _ann(
    """SELECT VAERS_ID, ann_idx, start, "end", prev_max_end FROM (
  SELECT *, max("end") OVER (PARTITION BY VAERS_ID ORDER BY start, ann_idx
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max_end
  FROM ann_rows) WHERE prev_max_end > start"""))
def q_qa_overlaps(spark, sf):
    """Spans overlapping an earlier span of the same report."""
    return annotated_reports(spark, sf).select("VAERS_ID", F.inline(A.overlaps(F.col("spans"))))


@register("qa_missing_mentions", _ann(
    """SELECT VAERS_ID, k.label AS label, k.start AS start, k['end'] AS "end" FROM (
  SELECT VAERS_ID, unnest(list_filter(gk, lambda x: NOT list_contains(ak, x))) AS k FROM (
    SELECT VAERS_ID,
           list_transform(gold, lambda s: {'label': s.label, 'start': s.start, 'end': s['end']}) AS gk,
           list_transform(spans, lambda s: {'label': s.label, 'start': s.start, 'end': s['end']}) AS ak
    FROM ann))"""))
def q_qa_missing_mentions(spark, sf):
    """Mentions present in the text that no annotation covers
    (row-local set difference, no join)."""
    a = annotated_reports(spark, sf)
    return (a.select("VAERS_ID", F.explode(A.missing_mentions(F.col("gold"), F.col("spans"))).alias("k"))
             .select("VAERS_ID", F.col("k.label").alias("label"), F.col("k.start").alias("start"),
                     F.col("k.end").alias("end")))


# ---------------------------------------------------------------- metrics

def _prf_sql(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p = f"(CASE WHEN ({tp} + {fp}) > 0 THEN CAST({tp} AS DOUBLE) / CAST({tp} + {fp} AS DOUBLE) ELSE 0.0::DOUBLE END)"
    r = f"(CASE WHEN ({tp} + {fn}) > 0 THEN CAST({tp} AS DOUBLE) / CAST({tp} + {fn} AS DOUBLE) ELSE 0.0::DOUBLE END)"
    f1 = f"(CASE WHEN {p} + {r} > 0 THEN 2.0::DOUBLE * {p} * {r} / ({p} + {r}) ELSE 0.0::DOUBLE END)"
    return p, r, f1


def _entity_prf_sql() -> str:
    gold = _e2_sql("t", "text", ANNOTATION_RULES)
    rows = []
    for typ in METRIC_TYPES:
        g = f"list_filter(gk, lambda s: s.type = {P.q(typ)})"
        p = f"list_filter(pk, lambda s: s.type = {P.q(typ)})"
        tp = f"len(list_filter({g}, lambda x: list_contains({p}, x)))"
        rows.append(f"SELECT {P.q(typ)} AS type, {tp} AS tp, len({p}) - {tp} AS fp, len({g}) - {tp} AS fn FROM keyed")
    pr, rc, f1 = _prf_sql("tp", "fp", "fn")
    return P.with_views(
        f"""SELECT type, tp, fp, fn, {pr} AS precision, {rc} AS recall, {f1} AS f1 FROM (
  SELECT type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
  FROM ({" UNION ALL ".join(rows)}) GROUP BY type)""",
        "reports", ANN_CTES[0],
        f"""keyed AS (SELECT list_transform({gold}, lambda s: {{'type': s.label, 'start': s.start, 'end': s['end']}}) AS gk,
       {P.e1_list_sql('t')} AS pk FROM ann_base)""")


@register("entity_prf", _entity_prf_sql())
def q_entity_prf(spark, sf):
    """Span-level precision / recall / F1 per entity type — gold = all
    mentions (E2), predicted = the lexicon extractor (E1). Counts are
    row-local set intersections, then one small group-by."""
    r = T.reports(spark, sf).select(F.coalesce(F.col("SYMPTOM_TEXT"), F.lit("")).alias("text"))
    m = r.select(A.span_match_counts(all_mentions(F.col("text"), ANNOTATION_RULES),
                                     extract_entities(F.col("text")), METRIC_TYPES).alias("m"))
    return A.entity_metrics(m)


def _severity_metrics_sql() -> str:
    lab, _ = P.classifier_sql("t")
    aggs = ["CAST(sum(n) AS BIGINT) AS total", "sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS correct"]
    per = []
    for i, l in enumerate(["mild", "moderate", "severe"]):
        aggs += [f"sum(CASE WHEN gold = {P.q(l)} AND pred = {P.q(l)} THEN n ELSE 0 END) AS tp{i}",
                 f"sum(CASE WHEN gold <> {P.q(l)} AND pred = {P.q(l)} THEN n ELSE 0 END) AS fp{i}",
                 f"sum(CASE WHEN gold = {P.q(l)} AND pred <> {P.q(l)} THEN n ELSE 0 END) AS fn{i}"]
        per.append(_prf_sql(f"tp{i}", f"fp{i}", f"fn{i}"))

    def mean(j):
        return "(((" + per[0][j] + " + " + per[1][j] + ") + " + per[2][j] + ") / 3.0::DOUBLE)"
    return P.with_views(
        f"""SELECT total AS n, CASE WHEN total > 0 THEN CAST(correct AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0::DOUBLE END AS accuracy,
       {mean(0)} AS macro_precision, {mean(1)} AS macro_recall, {mean(2)} AS macro_f1
FROM (SELECT {", ".join(aggs)} FROM (
  SELECT gold, pred, count(*) AS n FROM (
    SELECT {P.labeller_sql("lower(cleaned_text)")} AS gold, {lab} AS pred
    FROM (SELECT cleaned_text, lower(cleaned_text) AS t FROM candidates))
  WHERE gold <> 'unknown' GROUP BY gold, pred))""", "reports", P.CANDIDATES_CTE)


@register("severity_metrics", _severity_metrics_sql())
def q_severity_metrics(spark, sf):
    """Accuracy and macro P / R / F1 of the rule classifier (V1)
    against the keyword labeller (D3) on the candidates."""
    lab = V.label_severity(candidates(spark, sf), "cleaned_text", out_col="gold")
    scored = lab.select("gold", V.classify_severity(F.col("cleaned_text"))["severity"].alias("pred"))
    return A.classification_metrics(scored, "gold", "pred")


# ---------------------------------------------------------------- highlight (E6), further types (ML4)

def _highlight_sql() -> str:
    ents = P.e1_list_sql("t")
    colors = ("CASE e.type " + " ".join(f"WHEN {P.q(k)} THEN {P.q(v)}" for k, v in HIGHLIGHT_COLORS.items())
              + f" ELSE {P.q(HIGHLIGHT_COLOR_DEFAULT)} END")
    step = (f"""substring(acc, 1, e.start) || '<span style="background-color: ' || {colors} || ';" title="' || e.type || '">' """
            f"""|| substring(acc, e.start + 1, greatest(e['end'] - e.start, 0)) || '</span>' || substring(acc, e['end'] + 1, 1073741824)""")
    return P.with_views(
        f"""SELECT VAERS_ID, CASE WHEN len(ents) = 0 THEN text ELSE
  list_reduce(list_transform(list_sort(list_transform(ents, lambda e, i: {{'neg_start': -e.start, 'i': i, 'e': e}})),
                             lambda x: x.e), lambda acc, e: {step}, text) END AS html
FROM (SELECT VAERS_ID, text, {ents} AS ents FROM ann_base)""", "reports", ANN_CTES[0])


@register("entity_highlight", _highlight_sql())
def q_entity_highlight(spark, sf):
    """Each report with its E1 entities wrapped in coloured spans,
    inserted from the last start to the first."""
    r = T.reports(spark, sf).select("VAERS_ID", F.coalesce(F.col("SYMPTOM_TEXT"), F.lit("")).alias("text"))
    r = with_evaluated(r, "ents", extract_entities(F.col("text")))
    return r.select("VAERS_ID", highlight(F.col("text"), F.col("ents")).alias("html"))


def _extended_sql() -> str:
    parts = []
    for typ, pat in EXTRA_ENTITY_PATTERNS:
        pieces = f"string_split_regex(t, {P.q(pat)})"
        found = f"regexp_extract_all(t, {P.q(pat)}, 0)"
        start = (f"CAST(list_sum(list_transform(({pieces})[1:j], lambda p: length(p))) + "
                 f"coalesce(list_sum(list_transform(({found})[1:j - 1], lambda p: length(p))), 0) AS INTEGER)")
        parts.append(f"list_transform(range(1, len({found}) + 1), lambda j: {{'type': {P.q(typ)}, "
                     f"'text': ({found})[j], 'start': {start}, 'end': {start} + CAST(length(({found})[j]) AS INTEGER)}})")
    lst = "flatten([" + ", ".join(parts) + "])"
    return P.with_views(
        f"""SELECT VAERS_ID, CAST(ent_idx AS INTEGER) AS ent_idx, e.type AS ent_type, e.text AS ent_text,
       e.start AS ent_start, e['end'] AS ent_end
FROM (SELECT VAERS_ID, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS ent_idx FROM (
  SELECT VAERS_ID, {lst} AS l FROM ann_base))""", "reports", ANN_CTES[0])


@register("extended_entities", _extended_sql())
def q_extended_entities(spark, sf):
    """ML4: DOSAGE / DURATION / FREQUENCY / ROUTE mentions by regex, every
    match its own span (our patterns; the original only names the types)."""
    r = T.reports(spark, sf).select("VAERS_ID", A.pattern_mentions(F.col("SYMPTOM_TEXT")).alias("l"))
    return (r.select("VAERS_ID", F.posexplode("l").alias("ent_idx", "e"))
             .select("VAERS_ID", "ent_idx", F.col("e.type").alias("ent_type"),
                     F.col("e.text").alias("ent_text"), F.col("e.start").alias("ent_start"),
                     F.col("e.end").alias("ent_end")))
