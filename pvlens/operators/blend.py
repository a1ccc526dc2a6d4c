"""Blending the report parts: completeness gate, three-way join and the
union of years (J1-J4, U1, R1)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvlens.session import written

ROLES = ["DATA", "SYMPTOMS", "VAX"]
# Least shares of the data rows, and of the symptom rows, that have no id.
LEAST_SIDE = 16
# Blended rows of one key above which its joins must be free to be split over tasks.
HOT_ROWS = 1_000_000


def role_presence(parts: dict[str, DataFrame], year_col: str = "year") -> DataFrame:
    """J4 input: (year, role) for every part that has rows in that year."""
    frames = [df.select(F.col(year_col).alias("year")).distinct().withColumn("role", F.lit(role))
              for role, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def year_status(presence: DataFrame, roles: list[str] = ROLES) -> DataFrame:
    """Per year, which parts exist and whether all of them do."""
    g = presence.groupBy("year").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return g.select("year", F.size("roles").cast("long").alias("n_roles"),
                    *[F.array_contains("roles", r).alias(f"has_{r.lower()}") for r in roles],
                    (F.size("roles") == len(roles)).alias("complete"))


def rename_overlaps(left: DataFrame, right: DataFrame, key: str | list[str],
                    suffixes: tuple[str, str] = ("_x", "_y")) -> tuple[DataFrame, DataFrame]:
    """Give shared non-key columns pandas-style suffixes before a join."""
    keys = [key] if isinstance(key, str) else key
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    for c in shared:
        left = left.withColumnRenamed(c, c + suffixes[0])
        right = right.withColumnRenamed(c, c + suffixes[1])
    return left, right


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    left, right = rename_overlaps(left, right, keys)
    left, right = left.dropna(subset=keys), right.dropna(subset=keys)
    key = F.struct(*keys)
    return left.withColumn("_k", key).join(
        right.withColumn("_k", key).drop(*keys), "_k").drop("_k")


def _matched_nulls(data: DataFrame, symptoms: DataFrame, vax: DataFrame, keys: list[str]) -> DataFrame:
    """The part of a null-safe blend whose key holds a null. All rows without an id
    match each other, and their product is far larger than they are, so it is cut
    into a grid: a cell holds one share of the data rows, one of the symptom rows
    and all vax rows of a key. A cell's rows meet in one task, cells are tasks of
    their own, and nothing but the few input rows is shuffled."""
    null = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])
    side = max(LEAST_SIDE, math.isqrt(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1)

    def shares(df: DataFrame, name: str) -> DataFrame:
        # round robin: even, and the same again when a task is repeated
        return df.where(null).repartition(side).withColumn(name, F.spark_partition_id())

    def copies(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(side - 1))))

    def cells(df: DataFrame, drop: bool) -> DataFrame:
        # a number of partitions that AQE does not merge by their few bytes
        df = df.withColumn("_k", F.struct(*keys))
        return (df.drop(*keys) if drop else df).repartition(side * side, *grid)
    grid = ["_k", "_i", "_j"]
    data, symptoms = rename_overlaps(copies(shares(data, "_i"), "_j"), copies(shares(symptoms, "_j"), "_i"),
                                     [*keys, "_i", "_j"])
    both = cells(data, False).join(cells(symptoms, True), grid)
    both, vax = rename_overlaps(both, copies(copies(vax.where(null), "_i"), "_j"), [*keys, *grid])
    return both.join(cells(vax, True), grid).drop(*grid)


def _together(data: DataFrame, symptoms: DataFrame, vax: DataFrame, keys: list[str]) -> DataFrame:
    """The three parts joined on one partitioning: each part is shuffled once, and
    what the first join makes, wide and already fanned out, is not."""
    out = data
    for right in (symptoms, vax):
        out, right = rename_overlaps(out, right, keys)
        names = [*out.columns, *[c for c in right.columns if c not in keys]]
        out = out.join(right, keys).select(*[F.col(f"`{c}`") for c in names])
    return out


def hot_keys(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys with more than ``HOT_ROWS`` blended rows, by the parts' counts: few, since
    each has that many rows in the result."""
    rows = [df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(f"_n{i}")) for i, df in enumerate(parts)]
    product = reduce(lambda a, b: a * b, [F.col(f"_n{i}") for i in range(len(parts))])
    return reduce(lambda a, b: a.join(b, keys), rows).where(product > HOT_ROWS).select(*keys)


def blend(data: DataFrame, symptoms: DataFrame, vax: DataFrame, key: str | list[str] = "VAERS_ID",
          null_safe: bool = False, count_first: bool = False) -> DataFrame:
    """``data ⋈ symptoms ⋈ vax`` inner on the report key; the many-to-many
    fan-out is kept. ``null_safe`` makes null keys match each other (J3, pandas
    ``merge`` semantics).

    Each join is on the key as one struct value made for that join. Its
    partitioning therefore does not carry over from the first join to the
    second, so AQE may split a hot report in either of them; two joins that
    share a partitioning may not be split. Rows with a null key are matched apart
    from the others (:func:`_matched_nulls`).

    With ``count_first`` the rows of each key are counted at once, a pass over the
    keys of stored parts; only hot reports are then joined that way, the others on
    one partitioning for both joins (:func:`_together`)."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = [data, symptoms, vax]
    if count_first:
        hot = written(hot_keys(parts, keys), "hot-keys")
        if hot.isEmpty():
            whole = _together(*parts, keys)
        else:
            few = F.broadcast(hot)
            whole = _together(*[df.join(few, keys, "left_anti") for df in parts], keys).unionByName(
                blend(*[df.join(few, keys, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
                        for df in parts], keys))
    else:
        whole = _matched(_matched(data, symptoms, keys), vax, keys)
    if not null_safe:
        return whole
    return whole.unionByName(_matched_nulls(data, symptoms, vax, keys))


def blend_complete_years(data: DataFrame, symptoms: DataFrame, vax: DataFrame,
                         key: str = "VAERS_ID", year_col: str = "year") -> DataFrame:
    """Keep years with all three parts (left-semi on the J4 table, a
    row for each year), then J1 within each year: a report id may recur in
    another year and is another report there."""
    status = year_status(role_presence({"DATA": data, "SYMPTOMS": symptoms, "VAX": vax}, year_col))
    ok = status.filter("complete").select(F.col("year").alias(year_col))
    return blend(data.join(ok, year_col, "left_semi"), symptoms, vax, [year_col, key])


def union_years(frames: dict[str, DataFrame], year_col: str = "year") -> DataFrame:
    """Union by name (missing columns null) with the year as a column."""
    tagged = [df.withColumn(year_col, F.lit(y)) for y, df in sorted(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
