"""Column-level text functions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Python's ``\s`` is Unicode-aware and also counts 0x1C-0x1F; Java needs (?U)
# plus the explicit range to agree with it.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_evaluated(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add ``expr`` as column ``name``, evaluated exactly once per row.

    Catalyst pushes a filter below the projection that defines the column and
    substitutes the full expression into every reference; a labeller with 20
    keyword tests on a cleaned text then re-runs the cleaning regex 20 times
    per row. A one-element ``explode`` is a generator, and predicates on its
    output stay above it, so the expression is computed once and later
    filters and projections read the attribute."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def let(body, *exprs: Column) -> Column:
    """``body(v1, v2, ...)`` with each ``exprs[i]`` evaluated once per row.

    An expression referenced inside a higher-order-function lambda is
    re-evaluated for every array element (Catalyst inlines projections into
    the lambda body). Binding it as the lambda variable of a one-element
    ``transform`` computes it once and hands the body a cheap reference."""
    names = [f"v{i}" for i in range(len(exprs))]
    packed = F.array(F.struct(*[e.alias(n) for e, n in zip(exprs, names)]))
    return F.transform(packed, lambda s: body(*[s[n] for n in names]))[0]


# Elements of a chunk, and levels of chunks, in :func:`running`.
CHUNK, LEVELS = 64, 2


def running(values: Column, op, zero: Column, levels: int = LEVELS) -> Column:
    """Running results of the associative ``op`` over an array, the element itself
    included. A fold that appends copies its result at every step; here arrays
    of ``CHUNK`` are folded, and what stands before each chunk comes from the
    running results of the chunks' last values, so the cost is linear."""
    def folded(chunk: Column) -> Column:
        start = F.struct(zero.alias("top"), F.slice(F.array(zero), 2, 0).alias("all"))

        def step(acc: Column, x: Column) -> Column:
            top = op(acc["top"], x)
            return F.struct(top.alias("top"), F.concat(acc["all"], F.array(top)).alias("all"))
        return F.aggregate(chunk, start, step, lambda acc: acc["all"])
    if levels == 1:
        return folded(values)

    def joined(chunks: Column) -> Column:
        def after(chunks: Column, upto: Column) -> Column:
            return F.flatten(F.transform(chunks, lambda c, i: F.transform(c, lambda x: F.when(
                i == 0, x).otherwise(op(F.get(upto, i - 1), x)))))
        return let(after, chunks, running(F.transform(chunks, lambda c: F.element_at(c, -1)), op, zero, levels - 1))

    def cut(values: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / CHUNK).cast("int")),
                             lambda i: folded(F.slice(values, i * CHUNK + 1, CHUNK)))
        return F.when(F.size(values) > 0, let(joined, chunks))
    return F.coalesce(let(cut, values), F.slice(F.array(zero), 2, 0))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def clean_text(c: str | Column) -> Column:
    """SC1: collapse every whitespace run to one space, then strip."""
    return F.trim(F.regexp_replace(col_(c), WHITESPACE_RUN, " "))


def words(c: str | Column) -> Column:
    """SC7: ``str.split()`` — whitespace runs, no empty tokens."""
    return F.filter(F.split(clean_text(c), " "), lambda w: w != F.lit(""))


def token_count(c: str | Column) -> Column:
    """SC25: number of placeholder token ids (one per word)."""
    return F.size(words(c))


def placeholder_decode(n: Column) -> Column:
    """SC25: decode ``n`` placeholder ids back to ``token token ...``."""
    return F.array_join(F.array_repeat(F.lit("token"), n), " ")


def regex_quote(term: str) -> str:
    """SC9: escape a literal term for a Java (and RE2) regex."""
    return re.sub(r"([^0-9A-Za-z _])", r"\\\1", term)


def alternation(terms: list[str]) -> str:
    """``\\b(t1|t2|...)\\b`` with each term quoted; first alternative wins."""
    return r"\b(" + "|".join(regex_quote(t) for t in terms) + r")\b"


def contains_ci(text_lower: Column, term: str) -> Column:
    """SC5: substring test on an already lower-cased text."""
    return F.instr(text_lower, term.lower()) > 0


def capitalize(c: str | Column) -> Column:
    """SC19: first letter upper, rest lower (not per word)."""
    c = col_(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def position_label(start: Column, end: Column) -> Column:
    """SC18: ``start:end`` (a plain concat; ``format_string`` goes through
    java.util.Formatter per row)."""
    return F.concat(start.cast("string"), F.lit(":"), end.cast("string"))


def join_list(arr: Column) -> Column:
    """SC16: ``', '.join``; an empty list gives ''."""
    return F.coalesce(F.array_join(arr, ", "), F.lit(""))


def split_list(c: Column) -> Column:
    """SC17: split a joined list on ',' and trim each piece."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x))


def stringify(c: Column, dtype: str = "string") -> Column:
    """SC23: ``str(v)`` of a column of type ``dtype``; null becomes 'nan' as
    pandas prints it. Booleans are capitalised; a double is written plainly from
    1e-4 up to 1e16 and with a two-digit exponent beyond, as ``str`` does."""
    text = c.cast("string")
    if dtype == "boolean":
        text = F.initcap(text)
    elif dtype in ("double", "float"):
        # digits and exponent of Java's shortest form
        sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        mantissa = F.regexp_extract(text, r"^-?([0-9]+)\.([0-9]+)", 1)
        fraction = F.regexp_extract(text, r"^-?([0-9]+)\.([0-9]+)", 2)
        exponent = F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        digits = F.concat(mantissa, F.regexp_replace(fraction, "0+$", ""))
        shown = F.when(exponent >= 0, F.concat(
            F.rpad(digits, F.greatest(exponent + 1, F.length(digits)), "0")))
        big = F.concat(sign, F.substring(shown, F.lit(1), exponent + 1), F.lit("."),
                       F.when(F.length(shown) > exponent + 1, F.substr(shown, exponent + 2)).otherwise(F.lit("0")))
        small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        tail = F.substr(digits, F.lit(2))
        far = F.concat(sign, F.substring(digits, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(F.lit("")),
                       F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
                       F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), "0"))
        text = (F.when(~text.contains("E"), text).when(exponent >= 16, far).when(exponent >= 0, big)
                 .when(exponent >= -4, small).otherwise(far))
        text = F.when(F.isnan(c), F.lit("nan")).when(F.abs(c) == float("inf"), F.concat(sign_of(c), F.lit("inf"))).otherwise(text)
    return F.coalesce(text, F.lit("nan"))


def sign_of(c: Column) -> Column:
    return F.when(c < 0, F.lit("-")).otherwise(F.lit(""))


def null_tokens_to_null(c: Column, tokens: list[str]) -> Column:
    """SC15: tokens that a CSV reader treats as missing become null. Longer values
    are told by their length, without a look-up."""
    longest = max((len(t.encode()) for t in tokens), default=0)
    return F.when((F.octet_length(c) <= longest) & c.isin(tokens), F.lit(None).cast("string")).otherwise(c)


def pct2(part: Column, total: Column) -> Column:
    """SC20: ``100 * part / total`` rounded half-even to 2 decimals, computed
    in exact integer arithmetic (no binary-float tie artefacts)."""
    num = part.cast("long") * F.lit(10000)
    q = F.floor(num.cast("decimal(38,0)") / total.cast("decimal(38,0)")).cast("long")
    r = num - q * total
    up = F.when(r * 2 > total, 1).when((r * 2 == total) & (q % 2 == 1), 1).otherwise(0)
    return F.when(total > 0, (q + up).cast("double") / F.lit(100.0))


def pct2_sql(part: str, total: str) -> str:
    """DuckDB twin of :func:`pct2` for oracles."""
    num = f"(CAST({part} AS BIGINT) * 10000)"
    q = f"({num} // ({total}))"
    r = f"({num} - {q} * ({total}))"
    return (f"CASE WHEN ({total}) > 0 THEN CAST({q} + CASE WHEN {r} * 2 > ({total}) THEN 1 "
            f"WHEN {r} * 2 = ({total}) AND {q} % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) / 100.0 END")
