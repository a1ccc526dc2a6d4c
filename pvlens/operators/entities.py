"""Entity extraction, formatting and highlighting (E1-E6, F12, SC14, SC18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlens.functions.lexicons import (
    ENTITY_RULES, HIGHLIGHT_COLOR_DEFAULT, HIGHLIGHT_COLORS, LABEL_COLOR_DEFAULT,
    LABEL_COLORS, SEVERITY_ENTITY_TERMS,
)
from pvlens.functions.text import col_, join_list, position_label, regex_quote, running_sums

ENTITY_TYPE = "struct<type:string,text:string,start:int,end:int>"


def _span(typ: str, term: str, pos: Column) -> Column:
    return F.struct(F.lit(typ).alias("type"), F.lit(term).alias("text"),
                    pos.alias("start"), (pos + F.lit(len(term))).alias("end"))


def extract_entities(text) -> Column:
    """Lexicon rules in order, first occurrence of each term (substring of
    the lower-cased text), then at most one SEVERITY (severe > moderate > mild).
    Offsets are 0-based, half-open, on the lower-cased text."""
    t = F.lower(F.coalesce(col_(text), F.lit("")))
    items = []
    for typ, term in ENTITY_RULES:
        pos = F.instr(t, term) - 1
        items.append(F.when(pos >= 0, _span(typ, term, pos)))
    sev = None
    for term in SEVERITY_ENTITY_TERMS:
        pos = F.instr(t, term) - 1
        sev = (F.when(pos >= 0, _span("SEVERITY", term, pos)) if sev is None
               else sev.when(pos >= 0, _span("SEVERITY", term, pos)))
    items.append(sev)
    return F.filter(F.array(*items), lambda e: e.isNotNull())


def format_entities(entities) -> Column:
    """Add a null ``confidence``."""
    return F.transform(col_(entities), lambda e: F.struct(
        e["text"].alias("text"), e["type"].alias("type"), e["start"].alias("start"),
        e["end"].alias("end"), F.lit(None).cast("double").alias("confidence")))


def entities_of_type(entities, typ: str) -> Column:
    """F12."""
    return F.filter(col_(entities), lambda e: e["type"] == F.lit(typ))


def joined_texts_of_type(entities, typ: str) -> Column:
    """E5: ``', '.join`` of the texts of one type ('' when none)."""
    return join_list(F.transform(entities_of_type(entities, typ), lambda e: e["text"]))


def explode_entities(df: DataFrame, keys: list[str], entities_col: str = "entities") -> DataFrame:
    """One row per entity with its list index and ``start:end`` label."""
    return (df.select(*keys, F.posexplode(entities_col).alias("ent_idx", "e"))
              .select(*keys, "ent_idx", F.col("e.type").alias("ent_type"),
                      F.col("e.text").alias("ent_text"), F.col("e.start").alias("ent_start"),
                      F.col("e.end").alias("ent_end"),
                      position_label(F.col("e.start"), F.col("e.end")).alias("position")))


def _color_map(colors: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in colors.items() for x in (F.lit(k), F.lit(v))])


def label_color(typ) -> Column:
    """SC14, annotation palette."""
    return F.coalesce(_color_map(LABEL_COLORS)[col_(typ)], F.lit(LABEL_COLOR_DEFAULT))


def highlight_color(typ) -> Column:
    """SC14, highlight palette."""
    return F.coalesce(_color_map(HIGHLIGHT_COLORS)[col_(typ)], F.lit(HIGHLIGHT_COLOR_DEFAULT))


def highlight(text, entities) -> Column:
    """Wrap each entity in a coloured ``<span>``, inserting from the last
    start to the first (ties keep list order), on the running string — so
    overlapping spans nest or break exactly like the string surgery."""
    t = col_(text)
    ents = col_(entities)
    indexed = F.transform(ents, lambda e, i: F.struct(e["start"].alias("start"),
                                                        e["end"].alias("end"),
                                                        e["type"].alias("type"),
                                                        i.alias("idx")))

    def cmp(a, b):
        return (F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1)
                 .when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0))
    ordered = F.array_sort(indexed, cmp)

    def step(acc, e):
        return F.concat(
            F.substring(acc, 1, e["start"]),
            F.lit('<span style="background-color: '), highlight_color(e["type"]),
            F.lit(';" title="'), e["type"], F.lit('">'),
            F.substring(acc, e["start"] + 1, F.greatest(e["end"] - e["start"], F.lit(0))),
            F.lit("</span>"),
            F.substr(acc, e["end"] + 1))
    return F.when(F.size(ents) == 0, t).otherwise(F.aggregate(ordered, t, step))


def all_mentions(text, rules: list[tuple[str, str]]) -> Column:
    """Every non-overlapping occurrence of each term in any case, rule order
    then text order: ``array<struct<type,text,start,end>>``. Row-local: split
    the text itself, not its lower case (which may be longer), on the quoted
    term, then running sums over the pieces."""
    t = F.coalesce(col_(text), F.lit(""))
    parts = F.array(*[F.split(t, "(?i)" + regex_quote(term), -1) for _, term in rules])
    named = F.array(*[F.struct(F.lit(typ).alias("type"), F.lit(term).alias("text")) for typ, term in rules])

    def spans(rule, pieces):
        # pieces p0..pk; occurrence j ends at len(p0..pj) + (j + 1) * len(term)
        size = F.length(rule["text"])
        ends = running_sums(F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p) + size))
        return F.transform(ends, lambda e: F.struct(
            rule["type"].alias("type"), rule["text"].alias("text"), (e - size).alias("start"), e.alias("end")))
    return F.flatten(F.zip_with(named, parts, spans))
