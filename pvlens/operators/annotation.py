"""Annotation sets, their quality checks and span metrics
(E7, E8, F14, Q1-Q7, A23, A24, ML4).

An annotated document is one row: its text plus an
``array<struct<label, start, end, text>>`` of spans (the shape of an
annotation export). Everything per document is row-local — BIO tags, slice
checks, missing mentions, per-type match counts — so none of it shuffles;
only the roll-ups (per entity type, per class) aggregate, with map-side
partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pvlens.functions.lexicons import (
    COMPOUND_FIXED_EXPRESSIONS, COVID_DISPOSITION_RULES, EXTRA_ENTITY_PATTERNS,
    QA_MODIFIERS, QA_SKIP_TERMS, QA_TIME_PATTERN, SEVERITY_LABELS,
)
from pvlens.functions.text import CHUNK, col_, let, running, running_sums
from pvlens.operators.entities import all_mentions
from pvlens.session import written

SPAN_TYPE = "array<struct<label:string,start:int,end:int,text:string>>"


# ---------------------------------------------------------------- spans

def mention_spans(text, rules: list[tuple[str, str]]) -> Column:
    """E2 as annotation results: every mention of every rule term, rule order
    then text order, with the span text as written (casing kept)."""
    t = F.coalesce(col_(text), F.lit(""))
    return F.transform(all_mentions(t, rules), lambda s: F.struct(
        s["type"].alias("label"), s["start"].alias("start"), s["end"].alias("end"),
        F.substring(t, s["start"] + 1, s["end"] - s["start"]).alias("text")))


def pattern_mentions(text, patterns: list[tuple[str, str]] = EXTRA_ENTITY_PATTERNS) -> Column:
    """ML4: every match of each type's regex in the lower-cased text, type
    order then text order: ``array<struct<type, text, start, end>>``.
    Offsets come from splitting on the same regex: match j ends after pieces
    0..j and matches 0..j."""
    t = F.lower(F.coalesce(col_(text), F.lit("")))
    found = F.array(*[F.struct(F.lit(typ).alias("type"), F.split(t, pat, -1).alias("pieces"),
                               F.regexp_extract_all(t, F.lit(pat), 0).alias("matches")) for typ, pat in patterns])

    def spans(f):
        ends = running_sums(F.transform(f["matches"], lambda m, j: F.length(F.get(f["pieces"], j)) + F.length(m)))
        return F.zip_with(f["matches"], ends, lambda m, end: F.struct(
            f["type"].alias("type"), m.alias("text"), (end - F.length(m)).alias("start"), end.alias("end")))
    return F.flatten(F.transform(found, spans))


# ---------------------------------------------------------------- export shape

def to_export(df: DataFrame, text_col: str, spans_col: str,
              keys: list[str] | None = None) -> DataFrame:
    """K5 shape of an annotation export: ``data.text`` and
    ``result[].value{labels[], start, end}`` (``keys`` carried alongside)."""
    return df.select(*(keys or []),
        F.struct(F.col(text_col).alias("text")).alias("data"),
        F.transform(spans_col, lambda s: F.struct(F.struct(
            F.array(s["label"]).alias("labels"), s["start"].alias("start"),
            s["end"].alias("end")).alias("value"))).alias("result"))


def from_export(export: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F14 + E7 input: skip annotations with no/empty result or empty text;
    results without labels are ignored; the first label is the type."""
    keys = keys or []
    kept = export.filter(F.coalesce(F.size(F.col("result")) > 0, F.lit(False))
                         & (F.coalesce(F.col("data.text"), F.lit("")) != ""))
    spans = F.transform(F.filter("result", lambda r: F.size(F.coalesce(
        r["value"]["labels"], F.array().cast("array<string>"))) > 0), lambda r: F.struct(
            r["value"]["labels"][0].alias("label"), r["value"]["start"].alias("start"),
            r["value"]["end"].alias("end")))
    return kept.select(*keys, F.col("data.text").alias("text"), spans.alias("spans"))


# ---------------------------------------------------------------- BIO tags and the NER set

def broken_annotations(df: DataFrame, keys: list[str], spans_col: str = "spans") -> DataFrame:
    """The rejects table of E7: results without a start or an end, with their
    index. The original stops at the first one."""
    return (df.select(*keys, F.posexplode(spans_col).alias("ann_idx", "s"))
              .where("s.start is null or s.end is null")
              .select(*keys, "ann_idx", F.col("s.label").alias("label"), F.col("s.start").alias("start"),
                      F.col("s.end").alias("end")))


def whole_annotations(spans) -> Column:
    """The results of a span array that have a start and an end."""
    return F.filter(col_(spans), lambda s: s["start"].isNotNull() & s["end"].isNotNull())


def bio_tags(text, spans) -> Column:
    """One tag per character; for each span in order, ``B-`` at start
    (when inside the text) and ``I-`` up to min(end, len); later spans
    overwrite earlier ones. Results without bounds are left out
    (:func:`broken_annotations` lists them).

    Spans in order that do not overlap are runs of their own, with gaps between.
    Else a sweep goes over the spans' starts and ends, in order, with the set of
    open spans: between two events the open span that comes last in the list names
    the run. Events are folded in chunks, so that the runs are not copied at
    every step; an event costs the number of spans that are open there."""
    def place(n, spans):
        return F.array_sort(F.filter(F.transform(spans, lambda s, i: F.struct(
            F.greatest(s["start"], F.lit(0)).alias("from"), i.alias("i"), s["start"].alias("start"),
            s["label"].alias("label"), F.greatest(F.least(s["end"], n), s["start"] + 1).alias("end"))),
            lambda s: (s["start"] < n) & (s["end"] > 0)))

    def build(n, placed):
        apart = F.size(F.filter(placed, lambda s, i: (i > 0) & (s["from"] < F.get(placed, i - 1)["end"]))) == 0
        return F.when(apart, _apart(n, placed)).otherwise(_swept(n, placed))
    n, spans = F.length(col_(text)), whole_annotations(spans)
    return let(build, n, let(place, n, spans))


def _apart(n, placed) -> Column:
    """Tags of spans in order, of which none overlaps another."""
    def before(i):
        return F.when(i > 0, F.get(placed, i - 1)["end"]).otherwise(0)
    runs = F.transform(placed, lambda s, i: F.concat(
        F.array_repeat(F.lit("O"), s["from"] - before(i)),
        _tags(F.struct(s["label"].alias("label"), (s["from"] == s["start"]).alias("first"),
                       (s["end"] - s["from"]).alias("size")))))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit("O"), n - before(F.size(placed))))


def _swept(n, placed) -> Column:
    """Tags of spans in order, of which some overlap."""
    # at one place spans close before others open
    events = F.array_sort(F.concat(
        F.transform(placed, lambda s: _event(s["end"], False, s)),
        F.transform(placed, lambda s: _event(s["from"], True, s)),
        F.array(_event(n, True, None))))

    def step(acc, e):
        # the run up to this event, of the last open span
        top = F.array_max(acc["open"])
        run = F.struct(top["label"].alias("label"), (top["start"] == acc["at"]).alias("first"),
                       (e["at"] - acc["at"]).alias("size"))
        own = F.struct(e["i"].alias("i"), e["start"].alias("start"), e["label"].alias("label"))
        return F.struct(
            e["at"].alias("at"),
            F.when(e["i"] < 0, acc["open"]).when(e["opens"], F.concat(acc["open"], F.array(own))).otherwise(
                F.filter(acc["open"], lambda o: o["i"] != e["i"])).alias("open"),
            F.when(e["at"] > acc["at"], F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]).alias("runs"))

    def chunk(acc, events):
        def after(done):
            return F.struct(done["at"].alias("at"), done["open"].alias("open"),
                            F.concat(acc["runs"], F.array(done["runs"])).alias("runs"))
        inner = F.struct(acc["at"].alias("at"), acc["open"].alias("open"), F.array().cast(_RUNS).alias("runs"))
        return let(after, F.aggregate(events, inner, step))

    def sweep(events):
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(events) - 1) / CHUNK).cast("int")),
                             lambda c: F.slice(events, c * CHUNK + 1, CHUNK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_OPEN).alias("open"),
                         F.array().cast(f"array<{_RUNS}>").alias("runs"))
        return F.flatten(F.aggregate(chunks, start, chunk, lambda acc: acc["runs"]))
    return F.flatten(F.transform(let(sweep, events), _tags))


_OPEN = "array<struct<i:int,start:int,label:string>>"
_RUNS = "array<struct<label:string,first:boolean,size:int>>"


def _event(at, opens: bool, span) -> Column:
    """An event at a place; without a span (``i`` -1) it only ends the text."""
    return F.struct(at.alias("at"), F.lit(opens).alias("opens"),
                    (F.lit(-1) if span is None else span["i"]).alias("i"),
                    (F.lit(0) if span is None else span["start"]).alias("start"),
                    (F.lit(None).cast("string") if span is None else span["label"]).alias("label"))


def _tags(run) -> Column:
    inside = F.concat(F.lit("I-"), run["label"])
    return F.when(run["label"].isNull(), F.array_repeat(F.lit("O"), run["size"])).otherwise(F.concat(
        F.array(F.when(run["first"], F.concat(F.lit("B-"), run["label"])).otherwise(inside)),
        F.array_repeat(inside, run["size"] - 1)))


def ner_dataset(annotated: DataFrame, order_cols: list[str], fraction: float = 0.8,
                **kw) -> DataFrame:
    """F14-filtered documents with BIO tags and the positional train /
    validation split (first ``int(0.8 n)`` documents in order are train). The kept
    documents are written once: the search for the cut reads their keys several
    times, and would find all their annotations anew each time."""
    from pvlens.operators.splits import positional_split
    kept = annotated.filter((F.size("spans") > 0) & (F.col("text") != ""))
    kept = written(kept.select(*order_cols, "text", "spans"), "ner-documents")
    split = positional_split(kept, order_cols, fraction, **kw)
    return split.select(*order_cols, "text", bio_tags(F.col("text"), F.col("spans")).alias("tags"), "split")


# ---------------------------------------------------------------- QA (Q1-Q7)

def explode_spans(df: DataFrame, keys: list[str], spans_col: str = "spans",
                  text_col: str = "text") -> DataFrame:
    return (df.select(*keys, text_col, F.posexplode(spans_col).alias("ann_idx", "s"))
              .select(*keys, text_col, "ann_idx", F.col("s.label").alias("label"),
                      F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                      F.col("s.text").alias("span_text")))


def slice_mismatch(spans: DataFrame, text_col: str = "text") -> Column:
    """Q1: the recorded span text differs from the source slice."""
    return F.substring(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("span_text")


def time_in_span() -> Column:
    """Q2: a time expression inside the span text."""
    return F.lower(F.col("span_text")).rlike(QA_TIME_PATTERN)


def word_before(text_col: str = "text") -> Column:
    """The word right before a span (lower-cased; '' at the text start)."""
    return F.lower(F.regexp_extract(F.substring(F.col(text_col), 1, F.col("start")),
                                    r"([A-Za-z-]+)\s+$", 1))


def modifier_left_out(text_col: str = "text") -> Column:
    """Q3: a SYMPTOM span directly preceded by a severity modifier that the
    span leaves out."""
    return (F.col("label") == "SYMPTOM") & word_before(text_col).isin(QA_MODIFIERS)


def skip_list_hits(spans: DataFrame) -> DataFrame:
    """Q4: spans whose text is on the skip list (vague, administrative,
    outcome-only, non-medical). The lexicon is a fixed list of a few dozen
    phrases, so broadcasting it is bounded."""
    spark = spans.sparkSession
    lex = spark.createDataFrame(list(QA_SKIP_TERMS), "term string, reason string")
    return spans.join(F.broadcast(lex), F.lower(F.trim(F.col("span_text"))) == F.col("term")).drop("term")


def compound_span() -> Column:
    """Q5: a span joining separate findings with 'and' (fixed expressions
    such as 'nausea and vomiting' stay whole)."""
    t = F.lower(F.col("span_text"))
    return (F.instr(t, " and ") > 0) & ~t.isin(COMPOUND_FIXED_EXPRESSIONS)


def covid_disposition(text) -> Column:
    """Q6: how a COVID-19 mention counts — ordered rules, first hit wins;
    null when the text does not mention COVID-19."""
    t = F.lower(col_(text))
    expr = None
    for pattern, disposition in COVID_DISPOSITION_RULES:
        cond = t.rlike(pattern)
        expr = F.when(cond, F.lit(disposition)) if expr is None else expr.when(cond, F.lit(disposition))
    return F.when(t.rlike("covid-?19"), expr.otherwise(F.lit("unclear")))


def overlapping_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that overlap an earlier span of the same document (by
    start, then list index) — one running max per document, no pairs."""
    w = (Window.partitionBy(*keys).orderBy("start", "ann_idx")
               .rowsBetween(Window.unboundedPreceding, -1))
    with_prev = spans.withColumn("prev_max_end", F.max("end").over(w))
    return with_prev.filter(F.col("prev_max_end") > F.col("start"))


def overlaps(spans) -> Column:
    """Q7a in the row: ``array<struct<ann_idx, start, end, prev_max_end>>`` of the
    spans that begin before an earlier one (by start, then list index) has
    ended. Running maxima of the ends, no shuffle."""
    def build(ordered):
        tops = running(F.transform(ordered, lambda s: s["end"]), F.greatest, F.lit(None).cast("int"))
        return F.filter(F.zip_with(ordered, F.concat(F.array(F.lit(None).cast("int")), tops), lambda s, top: F.struct(
            s["ann_idx"].alias("ann_idx"), s["start"].alias("start"), s["end"].alias("end"), top.alias("prev_max_end"))),
            lambda s: s["prev_max_end"] > s["start"])
    return let(build, F.array_sort(F.transform(col_(spans), lambda s, i: F.struct(
        s["start"].alias("start"), i.alias("ann_idx"), s["end"].alias("end")))))


def missing_mentions(expected, annotated) -> Column:
    """Expected (label, start, end) mentions that no annotation has
    (set difference per row)."""
    def keys(arr):
        return F.transform(arr, lambda s: F.struct(s["label"].alias("label"),
                                                   s["start"].alias("start"), s["end"].alias("end")))
    return F.array_except(keys(col_(expected)), keys(col_(annotated)))


# ---------------------------------------------------------------- metrics

def span_match_counts(gold, predicted, types: list[str]) -> Column:
    """A23 per row: ``array<struct<type, tp, fp, fn>>`` — exact (start, end)
    matches of each type between two span lists (label or type field)."""
    def keyed(arr):
        return F.transform(arr, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"),
                                                   s["end"].alias("end")))

    def build(g, p):
        rows = []
        for typ in types:
            gt = F.filter(g, lambda s: s["type"] == typ)
            pt = F.filter(p, lambda s: s["type"] == typ)
            tp = F.size(F.array_intersect(gt, pt))
            rows.append(F.struct(F.lit(typ).alias("type"), tp.cast("long").alias("tp"),
                                 (F.size(pt) - tp).cast("long").alias("fp"),
                                 (F.size(gt) - tp).cast("long").alias("fn")))
        return F.array(*rows)
    return let(build, keyed(col_(gold)), keyed(col_(predicted)))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = _ratio(tp, tp + fp)
    r = _ratio(tp, tp + fn)
    f1 = F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
    return p, r, f1


def entity_metrics(counts: DataFrame) -> DataFrame:
    """A23 roll-up: per type tp/fp/fn, precision, recall, F1."""
    agg = (counts.select(F.inline("m")).groupBy("type")
                 .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select("type", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"),
                      f1.alias("f1"))


def classification_metrics(df: DataFrame, gold_col: str, pred_col: str,
                           labels: list[str] = SEVERITY_LABELS) -> DataFrame:
    """Accuracy and macro precision / recall / F1 from the confusion
    counts (a groupBy of at most labels^2 rows); a class never predicted
    scores precision 0."""
    conf = df.groupBy(gold_col, pred_col).agg(F.count(F.lit(1)).alias("n"))
    g, p, n = F.col(gold_col), F.col(pred_col), F.col("n")
    aggs = [F.sum(n).alias("total"), F.sum(F.when(g == p, n).otherwise(0)).alias("correct")]
    for i, lab in enumerate(labels):
        aggs += [F.sum(F.when((g == lab) & (p == lab), n).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when((g != lab) & (p == lab), n).otherwise(0)).alias(f"fp{i}"),
                 F.sum(F.when((g == lab) & (p != lab), n).otherwise(0)).alias(f"fn{i}")]
    tot = conf.agg(*aggs)
    per = [prf(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")) for i in range(len(labels))]
    k = F.lit(float(len(labels)))

    def mean(j):
        s = per[0][j]
        for x in per[1:]:
            s = s + x[j]
        return s / k
    return tot.select(F.col("total").alias("n"), _ratio(F.col("correct"), F.col("total")).alias("accuracy"),
                      mean(0).alias("macro_precision"), mean(1).alias("macro_recall"),
                      mean(2).alias("macro_f1"))

