"""Samples and train/validation splits.

Random choices are replaced by a fixed hash order — ``md5('42:' || key)``
then the key — which is the same in every engine and on every run. numpy's
exact row choice is not reproduced.

A split compares each row's key with the key at the cut, which is selected from
the order columns alone: neither the rows nor their keys are moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlens.functions.lexicons import SAMPLE_SEED, TRAIN_FRACTION
from pvlens.operators.ordering import order_key
from pvlens.operators.selection import LIMIT, key_at


def seeded_hash(key_col: str, seed: int = SAMPLE_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string")))


def fixed_sample(df: DataFrame, key_col: str, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the first in seeded hash order.
    Planned as a distributed top-k (``TakeOrderedAndProject``): each task keeps
    n rows, the driver merges at most n x tasks rows."""
    return df.orderBy(seeded_hash(key_col, seed), F.col(key_col)).limit(n)


def _split_at(df: DataFrame, order_cols: list[str], rows_of, out: str, limit: int) -> DataFrame:
    cut = key_at(df, order_cols, rows_of, limit)
    # the key's values, with the columns' types
    train = F.lit(True) if cut is None else order_key(order_cols) < F.struct(*[
        F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order_cols, cut)])
    return df.withColumn(out, F.when(train, F.lit("train")).otherwise(F.lit("validation")))


def hash_split(df: DataFrame, key_col: str, fraction: float = TRAIN_FRACTION,
               seed: int = SAMPLE_SEED, out: str = "split", limit: int = LIMIT) -> DataFrame:
    """Exactly ``round(fraction * n)`` rows are 'train' (the first in
    seeded hash order), the rest 'validation'. ``key_col`` is unique; ``limit``
    is the number of keys that the selection sorts at the end."""
    hashed = df.withColumn("_h", seeded_hash(key_col, seed))
    return _split_at(hashed, ["_h", key_col], lambda n: round(n * fraction), out, limit).drop("_h")


def positional_split(df: DataFrame, order_cols: list[str], fraction: float = TRAIN_FRACTION,
                     out: str = "split", limit: int = LIMIT) -> DataFrame:
    """The first ``int(fraction * n)`` rows in (unique) order are 'train'."""
    return _split_at(df, order_cols, lambda n: math.floor(n * fraction), out, limit)


def complement(df: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are not in ``sample`` (left anti)."""
    return df.join(sample.select(*keys), keys, "left_anti")
