"""Order-dependent operators over a whole table: global row index (W3) and
forward fill (W1, W2).

Row order does not exist in Spark, so callers name unique order columns.
A single un-partitioned window would funnel every row through one task; the
scalable form splits the order into ranges instead:

1. the order columns alone are range-partitioned and aggregated to the last
   key and the row count of each range, written as one row of sorted arrays;
2. each row finds its range by bisection over that array (a scalar subquery: the
   plan holds no bound and is as large for any number of ranges), and the rows are dealt to partitions by range (``repartitionById``: one range
   to a task, no hash that could put two ranges together);
3. a window within each range, plus what is carried over from the ranges
   before: the counts, or the last non-null values, combined as a prefix scan
   in two levels (blocks of ranges, then ranges of a block).

The rows are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pvlens.session import written

RANGE, LAST = "_pv_range", "_pv_last"
# Rows of a range where the caller names no number of ranges.
ROWS_PER_RANGE = 1_000_000
# Ranges of a block in the prefix scan of carried values.
BLOCK_RANGES = 1_000


def _order_exprs(order_cols: list[str]):
    return [F.col(c).asc_nulls_first() for c in order_cols]


def order_key(order_cols: list[str]) -> Column:
    """The order columns as one comparable value (nulls first)."""
    return F.struct(*[F.col(c) for c in order_cols])


@dataclass
class Ranges:
    """Ranges of an order: ``table`` is one row with the last key of each range
    (``last``) and the rows before it (``before``), in order."""

    order_cols: list[str]
    table: DataFrame
    size: int

    def numbered(self, df: DataFrame) -> DataFrame:
        """``df`` with the range of each row: how many ranges end before its key.
        Each step of the fold settles one bit of the number."""
        key, last = order_key(self.order_cols), F.col(LAST)
        bits = range(max(0, self.size - 1).bit_length() - 1, -1, -1)
        steps = F.array(*[F.lit(1 << b) for b in bits]) if self.size > 1 else F.array().cast("array<int>")

        def step(low: Column, size: Column) -> Column:
            after = low + size
            return F.when((after < self.size) & (F.get(last, after - 1) < key), after).otherwise(low)
        # a subquery may not be written inside a lambda; the optimizer puts it there
        return df.withColumn(LAST, self.table.select("last").scalar()).withColumn(
            RANGE, F.coalesce(F.aggregate(steps, F.lit(0), step), F.lit(0))).drop(LAST)

    def deal(self, df: DataFrame) -> DataFrame:
        """``df`` with its range, one range to a partition."""
        return self.numbered(df).repartitionById(max(1, self.size), F.col(RANGE))

    def before(self) -> Column:
        """Rows before a row's range."""
        return F.get(self.table.select("before").scalar(), F.col(RANGE))


def find_ranges(df: DataFrame, order_cols: list[str], num_ranges: int | None = None) -> Ranges:
    """Cut the order of ``df`` into even ranges. Only the order columns are
    read; ``num_ranges`` defaults to one for ``ROWS_PER_RANGE`` rows, at least
    one for each shuffle partition of the session."""
    keys = df.select(*order_cols)
    if num_ranges is None:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        num_ranges = max(least, -(-keys.count() // ROWS_PER_RANGE))
    found = (keys.repartitionByRange(num_ranges, *_order_exprs(order_cols))
                 .groupBy(F.spark_partition_id().alias("p"))
                 .agg(F.max(order_key(order_cols)).alias("last"), F.count(F.lit(1)).alias("n")))
    # one row for each range from here on
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    in_order = F.sort_array(F.collect_list(F.struct("p", "last", "before")))
    table = written(found.select("p", "last", before).agg(in_order.alias("r")).select(
        F.col("r.last").alias("last"), F.col("r.before").alias("before")), "ranges")
    return Ranges(order_cols, table, table.select(F.size("last")).first()[0])


def carried(per_range: DataFrame, cols: list[str]) -> DataFrame:
    """For each range the last non-null value of ``cols`` in the ranges before it:
    within its block of ranges, else in the blocks before."""
    block = F.floor(F.col(RANGE) / BLOCK_RANGES).alias("_block")
    ranges = per_range.select(RANGE, block, *cols)
    blocks = ranges.groupBy("_block").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(RANGE))).alias(c) for c in cols])

    def last(w, mark):
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return [F.last(F.col(c), ignorenulls=True).over(w).alias(f"{c}{mark}") for c in cols]
    # one row for each block
    from_blocks = blocks.select("_block", *last(Window.orderBy("_block"), "_block"))
    inside = ranges.select(RANGE, "_block", *last(Window.partitionBy("_block").orderBy(RANGE), ""))
    return inside.join(from_blocks, "_block").select(
        RANGE, *[F.coalesce(F.col(c), F.col(f"{c}_block")).alias(c) for c in cols])


def with_row_index(df: DataFrame, order_cols: list[str], out: str = "row_idx",
                   num_ranges: int | None = None, method: str = "ranges") -> DataFrame:
    """0-based position in ``order_cols`` order (``reset_index``).
    ``method='window'`` is the one-task form for small inputs."""
    if method == "window":
        w = Window.orderBy(*_order_exprs(order_cols))
        return df.withColumn(out, F.row_number().over(w) - 1)
    ranges = find_ranges(df, order_cols, num_ranges)
    w = Window.partitionBy(RANGE).orderBy(*_order_exprs(order_cols))
    return (ranges.deal(df)
                  .withColumn(out, F.row_number().over(w) - 1 + ranges.before())
                  .drop(RANGE))


def forward_fill(df: DataFrame, cols: list[str], order_cols: list[str],
                 num_ranges: int | None = None, method: str = "ranges",
                 partition_by: list[str] | None = None) -> DataFrame:
    """Each null takes the last non-null value above it in ``order_cols``
    order; leading nulls stay null. ``partition_by`` confines the fill to a
    group (then the plain per-group window is already distributed)."""
    def filled(w):
        return [F.last(F.col(c), ignorenulls=True).over(w).alias(c) if c in cols else F.col(c)
                for c in df.columns]
    if partition_by or method == "window":
        w = Window.partitionBy(*partition_by) if partition_by else Window
        return df.select(*filled(w.orderBy(*_order_exprs(order_cols)).rowsBetween(
            Window.unboundedPreceding, 0)))
    ranges = find_ranges(df, order_cols, num_ranges)
    key, names = order_key(order_cols), [f"_carry_{i}" for i in range(len(cols))]
    # last non-null value of each column inside each range
    per_range = ranges.numbered(df.select(*order_cols, *[c for c in cols if c not in order_cols])).groupBy(
        RANGE).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(n) for c, n in zip(cols, names)])
    # one row for each range; Spark chooses the join by its size in bytes
    carry = carried(per_range, names)
    within = (Window.partitionBy(RANGE).orderBy(*_order_exprs(order_cols))
                    .rowsBetween(Window.unboundedPreceding, 0))
    joined = ranges.deal(df).select(*filled(within), RANGE).join(carry, RANGE)
    idx = {c: i for i, c in enumerate(cols)}
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_carry_{idx[c]}")).alias(c) if c in idx
                           else F.col(c) for c in df.columns])


def forward_fill_then(df: DataFrame, col: str, default, order_cols: list[str],
                      **kw) -> DataFrame:
    """Forward fill, then a constant for what is left (leading nulls)."""
    filled = forward_fill(df, [col], order_cols, **kw)
    return filled.withColumn(col, F.coalesce(F.col(col), F.lit(default)))
