"""Exact selection: the key at a position of an order, without sorting it.

A column of the order is read as *digits*: numbers that compare, one after the
other, as the column does (a flag for null, halves of a long, seven bytes of a
string at a time). A mergeable quantile sketch of a digit, folded on the map side,
brackets the position; one more aggregate counts the rows below, at and between the
two ends of the bracket, exactly. The search goes on in the part that holds the
position, some hundred times smaller, with the same digit, or with the next one
where all its rows share the digit. A part of at most ``LIMIT`` rows is sorted to its
position. No key is shuffled before that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that are sorted at the end (each task keeps as many at most).
LIMIT = 100_000
STEPS, ACCURACY = 200, 10_000
PREFIX = 7


def _halves(x: Column) -> list[Column]:
    return [F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))]


def digits(df: DataFrame, name: str, longest: Callable[[], int]) -> Iterator[Column]:
    """Numbers, never null, whose order one after the other is the column's order
    (nulls first). ``longest`` gives the greatest length of a text in bytes."""
    col, kind = F.col(f"`{name}`"), df.schema[name].dataType
    yield F.when(col.isNull(), 0).otherwise(1)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        yield F.when(F.isnan(col), 1).otherwise(0)
        yield F.when(F.isnan(col), 0.0).otherwise(F.coalesce(col.cast("double"), F.lit(0.0)) + 0.0)
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        raw = F.coalesce(col.cast("binary"), F.lit(b""))
        for at in range(0, longest(), PREFIX):
            part = F.rpad(F.hex(F.substring(raw, at + 1, PREFIX)), 2 * PREFIX, "0")
            yield from _halves(F.conv(part, 16, 10).cast("long"))
        yield F.octet_length(raw)
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        unscaled = col * F.lit(10 ** kind.scale).cast(f"decimal({kind.scale + 1},0)")
        yield from _halves(F.coalesce(unscaled.cast("long"), F.lit(0)))
    elif isinstance(kind, T.TimestampType):
        yield from _halves(F.coalesce(F.unix_micros(col), F.lit(0)))
    elif isinstance(kind, T.DateType):
        yield F.coalesce(F.unix_date(col), F.lit(0))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        yield from _halves(F.coalesce(col.cast("long"), F.lit(0)))
    else:
        raise TypeError(f"{name}: no order of {kind.simpleString()} is known")


def key_at(df: DataFrame, order_cols: list[str], position: Callable[[int], int] | int,
           limit: int = LIMIT) -> Row | None:
    """The order key at a 0-based position (or the one that ``position`` gives for
    the number of rows), None beyond the rows. Nulls come first; of equal keys any
    stands for all."""
    rows, start = df.select(*order_cols), None
    order = [F.col(f"`{c}`").asc_nulls_first() for c in order_cols]

    def sorted_at(part: DataFrame, k: int) -> Row | None:
        return part.orderBy(*order).offset(k).limit(1).first()
    for name in order_cols:
        def longest(part=rows, name=name) -> int:
            return part.agg(F.max(F.octet_length(F.col(f"`{name}`")))).first()[0] or 0
        for digit in digits(df, name, longest):
            while True:
                grid = F.percentile_approx(digit, [i / STEPS for i in range(STEPS + 1)], ACCURACY)
                n, least, greatest, marks = rows.agg(F.count(F.lit(1)), F.min(digit), F.max(digit), grid).first()
                if start is None:
                    start = position(n) if callable(position) else position
                k = start
                if not 0 <= k < n:
                    return None
                if n <= limit:
                    return sorted_at(rows, k)
                if least == greatest:
                    break
                step = k * STEPS // n
                # the sketch is off by a hundredth of a step at most
                low = least if step == 0 else marks[step - 1]
                high = greatest if step >= STEPS - 1 else marks[step + 2] if step + 2 <= STEPS else greatest
                counts = rows.agg(F.count_if(digit < low), F.count_if(digit == low),
                                  F.count_if((digit > low) & (digit < high)),
                                  F.count_if((digit == high) & F.lit(low != high))).first()
                parts = [digit < low, digit == low, (digit > low) & (digit < high), digit == high, digit > high]
                sizes = [*counts, n - sum(counts)]
                at = 0
                while k >= sizes[at]:
                    k -= sizes[at]
                    at += 1
                rows, start = rows.where(parts[at]), k
                if sizes[at] <= limit:
                    return sorted_at(rows, k)
                if at in (1, 3):
                    break
    return sorted_at(rows, 0)  # all keys that are left are equal
