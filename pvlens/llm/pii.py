"""Personal data in texts: patterns propose, checksums confirm, context scores.

Four base kinds follow fixed rules. Two further kinds are the method's own:
``iban`` (mod-97) and ``ssn`` (number ranges), and a further span is kept only
when checksum and nearby context words lift its score to ``KEEP_SCORE``. All of
it is SQL functions inside the row: no shuffle, no Python.

How positions come out of a pattern without a loop: every match is wrapped in a
marker character (one that is first replaced in the text by another character
that no pattern knows, so that lengths stay), the text is split at the marker,
and every second piece is a match. Lengths add up to code-point offsets.

Patterns that begin with a run of characters only try the run's first character
or the end of the last match (``\\G``); a later start in the same run would read
the same rest and fail the same way, so the matches are the leftmost ones while
a long run costs one pass instead of one for each of its characters. Groups
repeat possessively: nothing follows them, and the JVM then loops instead of
recursing through very long matches.

An ``iban`` is no run of its own: the next word may look like its next group.
Its pattern finds heads (country code and check digits) and looks ahead at what
follows; of that, the prefix that has the country's length, ends at a word's edge
and passes mod-97 is the number. Every head is tried, also one behind a head that
failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlens.functions.text import let
from pvlens.llm.catalog import register, table

MARK, STAND_IN = "\ue000", "\ue001"

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}(?s:.{0,93})))[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ["email", "ip", "card", "phone"]
KINDS = list(PATTERNS)
# Cheap tests that a text must pass before its pattern is tried.
NEEDS = {"email": "@", "phone": "+", "ssn": "-", "ip": "."}

# Score before context, and what words near the match add or take.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.5}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|login",
    "card": "card|credit|visa|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security|insurance|taxpayer",
}
AGAINST = "version|order|invoice|isbn|serial|build"
CONTEXT_CHARS = 40
CONTEXT_STEP = 0.3
KEEP_SCORE = 0.7

# Characters of an account number by country (ISO 13616 registry); a country that
# is not listed may have 15 to 34.
IBAN_LENGTH = {c: int(e[:2]) for e in (
    "15 NO,16 BE,18 DK FI FK FO GL NL SD,19 MK SI,20 AT BA EE KZ LT LU MN XK,21 CH HR LI LV,"
    "22 BG BH CR DE GB GE IE ME RS VA,23 AE GI IL IQ OM SO TL,24 AD CZ ES MD PK RO SA SE SK TN VG,"
    "25 LY PT ST,26 IS TR,27 BI DJ FR GR IT MC MR SM,28 AL AZ BY CY DO GT HN HU LB NI PL SV,"
    "29 BR EG PS QA UA,30 JO KW MU YE,31 MT SC,32 LC,33 RU").split(",") for c in e.split()[1:]}
# The longest number with a space between any two characters.
IBAN_SPACED = 67


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""
    backwards = F.split(F.reverse(digits), "(?!$)(?=.)")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)
    total = F.aggregate(F.transform(backwards, value), F.lit(0),
                        lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 modulo 97 (ISO 13616)."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(a: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.split(turned, "(?!$)(?=.)"), F.lit(0), add) == 1


def _iban_length(number: Column) -> Column:
    """Length of the account numbers of a number's country, null if not known."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTH.items() for x in pair])
    return lengths[F.left(number, F.lit(2))]


def iban(ahead: Column) -> Column:
    """The account number that ``ahead`` begins with, null if there is none. Of a
    country without a known length the longest that passes is taken."""
    run = F.length(F.regexp_extract(ahead, "^(?:[A-Z0-9]| (?=[A-Z0-9]))+", 0))

    def passes(n: Column) -> Column:
        plain = F.length(F.regexp_replace(F.left(ahead, n), " ", ""))
        return ((F.substring(ahead, n, F.lit(1)) != " ")
                & ~F.substring(ahead, n + 1, F.lit(1)).rlike("[A-Za-z0-9]")
                & F.coalesce(plain == _iban_length(ahead), plain.between(15, 34))
                & mod97(F.left(ahead, n)))
    ends = F.sequence(F.least(run, F.lit(IBAN_SPACED)), F.lit(15), F.lit(-1))
    return F.left(ahead, F.get(F.filter(ends, passes), F.lit(0)))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda p: (
            F.length(F.regexp_replace(p, "^0+", "")) > 3) | (
            F.coalesce(F.right(F.concat(F.lit("0"), p), F.lit(3)).cast("int"), F.lit(0)) > 255))
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(12, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "ssn":
        return ~(F.substring(match, 1, 3).isin("000", "666") | (F.substring(match, 1, 1) == "9")
                 | (F.substring(match, 5, 2) == "00") | (F.substring(match, 8, 4) == "0000"))
    return F.lit(True)


def _spans_of(kind: str, text: Column) -> Column:
    """Valid spans of one kind as array<struct<kind, start, end, score>>.

    Offsets are sums of piece lengths. They are summed by chunks of the cube
    root of the number of pieces, so a text with m matches costs m^(4/3) steps."""
    split = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK, -1)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, v: a + v)

    def scored(piece: Column, before: Column, after: Column, start: Column, against=True) -> Column:
        near = F.lower(F.concat(F.right(before, F.lit(CONTEXT_CHARS)), F.lit(" "),
                                F.left(after, F.lit(CONTEXT_CHARS))))
        score = (F.lit(PRIOR[kind])
                 + F.when(near.rlike(f"\\b(?:{CONTEXT[kind]})"), CONTEXT_STEP).otherwise(0.0)
                 - F.when(near.rlike(f"\\b(?:{AGAINST})") & against, CONTEXT_STEP).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"),
                        (start + F.length(piece)).alias("end"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    def ibans(pieces: Column, aheads: Column, at) -> Column:
        def before(i: Column) -> Column:  # heads are short: context goes back over several
            first = F.greatest(i - CONTEXT_CHARS // 2, F.lit(0))
            return F.array_join(F.transform(F.slice(pieces, first + 1, i - first),
                                            lambda p: F.right(p, F.lit(CONTEXT_CHARS))), "")
        numbers = F.filter(F.transform(aheads, lambda a, n: F.struct(
            (2 * n + 1).alias("i"), a.alias("ahead"), iban(a).alias("number"))),
            lambda x: x["number"].isNotNull())
        # length and checksum of a known country outweigh words against it
        return F.transform(numbers, lambda x: scored(
            x["number"], before(x["i"]),
            F.substring(x["ahead"], F.length(x["number"]) + 1, F.lit(CONTEXT_CHARS)),
            at(x["i"]), _iban_length(x["number"]).isNull()))

    def spans(pieces: Column, lengths: Column, chunk: Column, sums: Column, *aheads: Column) -> Column:
        def at(i: Column) -> Column:
            k = F.floor(i / chunk).cast("int")
            return total(F.slice(sums, F.lit(1), k)) + total(
                F.slice(lengths, k * chunk + 1, i - k * chunk))
        if aheads:
            return ibans(pieces, *aheads, at)
        matches = F.filter(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)),
                           lambda i: _valid(kind, pieces[i]))
        return F.transform(matches, lambda i: scored(pieces[i], pieces[i - 1], pieces[i + 1], at(i)))

    def with_sums(pieces: Column, lengths: Column, chunk: Column) -> Column:
        sums = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(pieces) / chunk).cast("int")),
            lambda k: total(F.slice(lengths, k * chunk + 1, chunk)))
        aheads = [F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1))] if kind == "iban" else []
        return let(spans, pieces, lengths, chunk, sums, *aheads)

    def located(pieces: Column) -> Column:
        return F.when(F.size(pieces) >= 3, let(
            with_sums, pieces, F.transform(pieces, lambda p: F.length(p)),
            F.ceil(F.cbrt(F.size(pieces))).cast("int"))).otherwise(none)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    found = let(located, split)
    if kind not in BASE:
        found = F.filter(found, lambda s: s["score"] >= KEEP_SCORE)
    worth = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(worth, found).otherwise(none)


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: all spans as array<struct<kind, start, end, score>>
    in code points (end exclusive), ordered by start, then kind as in ``KINDS``.

    Base spans always stay; a span of another kind stays when its score reaches
    ``KEEP_SCORE``. Null and empty texts have no spans; other columns pass
    through (one that is named like ``out`` is replaced); rows are independent,
    so repeated rows get repeated results and an empty table an empty one. A very
    long text is searched whole, in its row."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, STAND_IN)
    spans = F.concat(*[_spans_of(kind, plain) for kind in KINDS])
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"),
        s["kind"].alias("kind"), s["score"].alias("score")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                           s["end"].alias("end"), s["score"].alias("score")))
    # a one-element generator keeps the patterns from being run again for each use
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    return docs.select(*kept, F.explode(F.array(ordered)).alias(out))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by ``[KIND]``; of spans
    that overlap, one label of the first covers all. A null text stays null."""
    columns = docs.columns
    marked = find_spans(docs, text, "_pii_spans")
    spans = F.col("_pii_spans")
    chunk = F.ceil(F.sqrt(F.size(spans))).cast("int")

    def replaced(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.when(fresh, F.concat(
                state["out"], F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"]),
                F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"))

    def chunk_replaced(state: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(spans, k * chunk + 1, chunk),
                            F.struct(F.lit("").alias("out"), state["at"].alias("at")), replaced)
        return let(lambda part: F.struct(F.concat(state["out"], part["out"]).alias("out"),
                                         part["at"].alias("at")), inner)
    # chunks of spans, so that a long text is not copied once for each span
    whole = F.aggregate(
        F.sequence(F.lit(0), chunk), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        chunk_replaced,
        lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))))
    cleaned = F.when(F.size(spans) == 0, F.col(text)).otherwise(whole)
    return marked.withColumn(text, cleaned).select(*[F.col(f"`{c}`") for c in columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@register("op8_pii")
def op8_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs).select("doc_id", "pii")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(BASE))
    return found.select("doc_id", *[count(k) for k in BASE],
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("pii")).alias("spans"))
