"""DuckDB building blocks for the SQL oracles: the same rules as the Spark
operators, written as ANSI-ish SQL over the pre-registered fixture views."""

from __future__ import annotations

from pvlens.functions.lexicons import (
    CLASSIFIER_BASE_PROB, CLASSIFIER_DEFAULT, CLASSIFIER_RULES, DEFAULT_SYMPTOMS,
    ENTITY_RULES, SEVERITY_ENTITY_TERMS, SEVERITY_KEYWORDS, SEVERITY_LABELS,
)
from pvlens.functions.text import alternation
from pvlens.sources.tables import REPORT_SYMPTOMS_SQL, REPORT_VAX_SQL, REPORTS_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_sql(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


def words_sql(expr: str) -> str:
    return f"list_filter(string_split({clean_sql(expr)}, ' '), lambda w: w <> '')"


def has(t: str, term: str) -> str:
    return f"strpos({t}, {q(term)}) > 0"


def labeller_sql(t: str) -> str:
    """D3 on an already lower-cased text expression."""
    parts = []
    for level, kws in SEVERITY_KEYWORDS:
        cond = " OR ".join(has(t, k.lower()) for k in kws)
        parts.append(f"WHEN {cond} THEN {q(level)}")
    return "CASE " + " ".join(parts) + " ELSE 'unknown' END"


def classifier_sql(t: str) -> tuple[str, str]:
    """V1 (label, confidence) on a lower-cased text expression."""
    lab = "CASE " + " ".join(f"WHEN {has(t, term)} THEN {q(l)}" for term, l, _ in CLASSIFIER_RULES)
    lab += f" ELSE {q(CLASSIFIER_DEFAULT[0])} END"
    conf = "CASE " + " ".join(f"WHEN {has(t, term)} THEN {c}::DOUBLE" for term, _, c in CLASSIFIER_RULES)
    conf += f" ELSE {CLASSIFIER_DEFAULT[1]}::DOUBLE END"
    return lab, conf


def probs_sql(label: str, conf: str) -> list[str]:
    """p_<label> columns from label/confidence column names."""
    scores = {l: f"(CASE WHEN {label} = {q(l)} THEN {conf} ELSE {CLASSIFIER_BASE_PROB}::DOUBLE END)"
              for l in SEVERITY_LABELS}
    total = "((" + f"{scores['mild']} + {scores['moderate']}) + {scores['severe']})"
    return [f"{scores[l]} / {total} AS p_{l}" for l in SEVERITY_LABELS]


def symptoms_sql(t: str) -> str:
    """D4 on a text expression (lower-cased inside)."""
    pat = alternation(DEFAULT_SYMPTOMS)
    return (f"CASE WHEN {t} IS NULL THEN []::VARCHAR[] ELSE "
            f"list_sort(list_distinct(regexp_extract_all(lower({t}), {q(pat)}, 1))) END")


def entity_rows_sql(src: str, id_col: str, t: str) -> str:
    """E1 exploded: one row per entity with its list index. ``t`` is the
    lower-cased text column of ``src``."""
    rows = []
    for r, (typ, term) in enumerate(ENTITY_RULES):
        rows.append(f"SELECT {id_col}, {r} AS r, {q(typ)} AS ent_type, {q(term)} AS ent_text, "
                    f"CAST(strpos({t}, {q(term)}) - 1 AS INTEGER) AS ent_start FROM {src} "
                    f"WHERE {has(t, term)}")
    sev = "CASE " + " ".join(f"WHEN {has(t, s)} THEN {q(s)}" for s in SEVERITY_ENTITY_TERMS) + " END"
    rows.append(f"SELECT {id_col}, {len(ENTITY_RULES)} AS r, 'SEVERITY' AS ent_type, ent_text, "
                f"CAST(strpos({t}, ent_text) - 1 AS INTEGER) AS ent_start FROM "
                f"(SELECT {id_col}, {t}, {sev} AS ent_text FROM {src}) WHERE ent_text IS NOT NULL")
    union = "\n    UNION ALL ".join(rows)
    return (f"SELECT {id_col}, CAST(row_number() OVER (PARTITION BY {id_col} ORDER BY r) - 1 AS INTEGER) "
            f"AS ent_idx, ent_type, ent_text, ent_start, CAST(ent_start + length(ent_text) AS INTEGER) "
            f"AS ent_end FROM (\n    {union})")


def joined_type_sql(t: str, typ: str) -> str:
    """E5 for the lexicon entities of one type, in rule order."""
    if typ == "SEVERITY":
        return "CASE " + " ".join(f"WHEN {has(t, s)} THEN {q(s)}" for s in SEVERITY_ENTITY_TERMS) + " ELSE '' END"
    terms = [term for ty, term in ENTITY_RULES if ty == typ]
    parts = ", ".join(f"CASE WHEN {has(t, term)} THEN {q(term)} END" for term in terms)
    return f"concat_ws(', ', {parts})"


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the CTEs it needs (derived views first)."""
    defs = {"reports": REPORTS_SQL, "report_symptoms": REPORT_SYMPTOMS_SQL,
            "report_vax": REPORT_VAX_SQL}
    ctes = [defs[v] if v in defs else v for v in views]
    return "WITH " + ",\n".join(ctes) + "\n" + body


CANDIDATES_CTE = f"""candidates AS (
  SELECT VAERS_ID, cleaned_text FROM (
    SELECT VAERS_ID, {clean_sql("coalesce(SYMPTOM_TEXT, '')")} AS cleaned_text FROM reports)
  WHERE length(cleaned_text) BETWEEN 10 AND 500)"""

BATCH_CTE = "batch_base AS (SELECT VAERS_ID, coalesce(SYMPTOM_TEXT, '') AS text, lower(coalesce(SYMPTOM_TEXT, '')) AS t FROM reports)"


def e1_list_sql(t: str) -> str:
    """E1 as an in-row list of {type, start, end} (rule order, then one
    SEVERITY)."""
    items = [f"CASE WHEN strpos({t}, {q(term)}) > 0 THEN {{'type': {q(typ)}, "
             f"'start': CAST(strpos({t}, {q(term)}) - 1 AS INTEGER), "
             f"'end': CAST(strpos({t}, {q(term)}) - 1 + {len(term)} AS INTEGER)}} END"
             for typ, term in ENTITY_RULES]
    sev = " ".join(f"WHEN strpos({t}, {q(s)}) > 0 THEN {{'type': 'SEVERITY', "
                   f"'start': CAST(strpos({t}, {q(s)}) - 1 AS INTEGER), "
                   f"'end': CAST(strpos({t}, {q(s)}) - 1 + {len(s)} AS INTEGER)}}"
                   for s in SEVERITY_ENTITY_TERMS)
    items.append(f"CASE {sev} END")
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
