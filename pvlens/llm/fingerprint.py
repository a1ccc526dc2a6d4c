"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``K`` least distinct hashes (48 bits) of a text's shingles of
five words. It stands for the whole set: the sketch of a union is the ``K`` least
of two sketches together, so parts are sketched apart and merged in any order;
the share of the merged sketch that both have estimates resemblance, the ``K``-th
least value estimates the number of distinct shingles, and both together
containment. A text of one to four words has one shingle; one without words has
an empty sketch.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.llm.catalog import register, table
from pvlens.llm.common import cut_words, hashed, mixed, schema_with, text_blocks, utf8, with_column

K, SHINGLE_WORDS, SEED = 256, 5, 7
BITS = 48
FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Groups whose sketches a task merges at once, and parts that a hot group's are dealt to.
MERGE_GROUPS, MERGE_SALT = 10_000, 64
# Quantiles of the keys of this many partitions.
QUANTILES, SKETCH_FAN_IN = 1000, 64


def sketches(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    """The sketch of each text: sorted distinct values."""
    words = cut_words(texts)
    word_hash = hashed(words.vocabulary, SEED)[words.codes] if words.vocabulary else np.zeros(0, np.uint64)
    counts = np.diff(words.first)
    shingles = np.where(counts == 0, 0, np.maximum(counts - SHINGLE_WORDS + 1, 1))
    ends = np.cumsum(shingles)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(words.first[:-1] - (ends - shingles), shingles)
    stop = np.repeat(words.first[1:], shingles)
    value = np.zeros(total, np.uint64)
    for j in range(SHINGLE_WORDS):
        inside = at + j < stop
        value[inside] = value[inside] * FACTOR + word_hash[at[inside] + j] + np.uint64(1)
    value = mixed(value) >> np.uint64(64 - BITS)
    out = []
    for start, end in zip((ends - shingles).tolist(), ends.tolist()):
        own = value[start:end]
        if len(own) > 4 * k:  # most values cannot be among the least
            limit = np.partition(own, 2 * k)[2 * k]
            low = np.unique(own[own <= limit])
            own = low if len(low) >= k else own
        out.append(np.unique(own)[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles (Jaccard); 1 for two empty sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[:-1][both[1:] == both[:-1]]
    size = min(k, len(both) - len(twice))
    # the k-th least distinct value bounds the sketch of the union
    union = both[np.append(True, both[1:] != both[:-1])]
    return float(np.searchsorted(twice, union[size - 1], "right") / size)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0 ** BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has (1 if there are none)."""
    if not len(a):
        return 1.0
    j, n = resemblance(a, b, k), distinct_count(a, k)
    return min(1.0, j * (n + distinct_count(b, k)) / ((1 + j) * n))


def as_text(sketch: np.ndarray) -> str:
    """A sketch as base64, six bytes for each value."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def _list_array(rows: list[np.ndarray]) -> pa.Array:
    bounds = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=bounds[1:])
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).astype(np.int64)
    return pa.ListArray.from_arrays(bounds, pa.array(flat))


def with_sketch(docs: DataFrame, text: str = "text", out: str = "sketch") -> DataFrame:
    """``docs`` with ``out``: the text's sketch as array<long>, empty for a null
    or wordless text. Other columns pass through; one named like ``out`` is replaced."""
    def run(batches):
        for block in text_blocks(batches, text):
            yield with_column(block, out, _list_array(sketches(utf8(block.column(text)))))
    return docs.mapInArrow(run, schema_with(docs, out, T.ArrayType(T.LongType())))


def merge_sketches(parts: DataFrame, by: str, sketch: str = "sketch") -> DataFrame:
    """One sketch for each value of ``by`` (null is a value).

    Merged within tasks, then over ``MERGE_SALT`` parts of each group, then
    whole, so no task holds more of a group than a sketch at a time."""
    frame = parts.select(F.col(by).alias("by"), F.col(sketch).alias("sketch"))
    schema = frame.schema

    def run(batches):
        held: dict = {}

        def flush():
            keys, rows = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), _list_array(rows)], names=["by", "sketch"])
        kind = None
        for batch in batches:
            kind = batch.schema.field("by").type
            for key, values in zip(batch.column("by").to_pylist(), batch.column("sketch")):
                own = np.array(values.as_py() or [], np.uint64)
                held[key] = merge(held[key], own) if key in held else np.unique(own)[:K]
                if len(held) >= MERGE_GROUPS:
                    yield flush()
        if held:
            yield flush()
    once = frame.mapInArrow(run, schema)
    salted = once.repartition("by", F.pmod(F.xxhash64("sketch"), F.lit(MERGE_SALT))).mapInArrow(run, schema)
    # each group's partial sketches meet in one task; flushes of one task never part a group
    whole = salted.repartition("by").sortWithinPartitions("by").mapInArrow(_merge_runs, schema)
    return whole.select(F.col("by").alias(by), F.col("sketch").alias(sketch))


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours of one key in sorted rows."""
    key, held, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field("by").type
        keys, rows = [], []
        for k, values in zip(batch.column("by").to_pylist(), batch.column("sketch")):
            own = np.array(values.as_py() or [], np.uint64)
            if held is not None and k == key:
                held = merge(held, own)
                continue
            if held is not None:
                keys.append(key)
                rows.append(held)
            key, held = k, np.unique(own)[:K]
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), _list_array(rows)], names=["by", "sketch"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), _list_array([held])], names=["by", "sketch"])


def _alike_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that are alike become one with their number, before anything moves."""
    for batch in batches:
        names = batch.schema.names
        counted = pa.Table.from_batches([batch]).group_by([n for n in names if n != "n"]).aggregate([("n", "sum")])
        yield from counted.rename_columns(["n" if n == "n_sum" else n for n in counted.column_names]).select(
            names).to_batches()


class Bounds:
    """Cuts of the order (key, hash): a key that fills several even parts is cut
    along its hashes, which are spread evenly."""

    def __init__(self, quantiles: list[int]):
        top = (1 << 63) - 1
        self.orders = np.array(sorted(quantiles), np.int64)
        values, counts = np.unique(self.orders, return_counts=True)
        self.hashes = np.array([top if j == m else (j << 64) // m - (1 << 63)
                                for m in counts.tolist() for j in range(1, m + 1)], np.int64)

    def bucket(self, order: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The part of each row, in descending order."""
        low = np.searchsorted(self.orders, order, "left")
        high = np.searchsorted(self.orders, order, "right")
        for at in np.unique(low[low < high]).tolist():
            rows = np.flatnonzero((low == at) & (high > at))
            stop = int(high[rows[0]])
            low[rows] = at + np.searchsorted(self.hashes[at:stop], hashes[rows], "left")
        return len(self.orders) - low


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (``key``, ``text``, their number ``n``, ``guest``) so dealt that each
    partition holds neighbours in descending ``key`` order, followed by the first
    row of the next partition (the last one by the first row of all) as a ``guest``.

    Bounds come from a quantile sketch of the keys and the first row of each
    partition from one count over the keys, so the texts are shuffled once and
    only one row for each partition (of copies, one a batch) is sent twice. Rows that repeat a key stand
    together, by a hash of the text, over as many partitions as they fill; rows that
    are alike in both become one on the map side. A null key is the least of all."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce(F.col("key").cast("long"), F.lit(-(1 << 63))).alias("order"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "key",
                        F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("n"))
    # quantiles of the quantiles of some partitions each: sketches of bounded size,
    # of which no task merges many. They only cut the order into even parts.
    near = keyed.groupBy((F.spark_partition_id() / SKETCH_FAN_IN).cast("int").alias("part")).agg(
        F.percentile_approx("order", [i / QUANTILES for i in range(1, QUANTILES)], 10 * QUANTILES).alias("q"))
    shares = [i / parts for i in range(1, parts)]
    found = near.select(F.explode("q").alias("order")).agg(
        F.percentile_approx("order", shares or [0.5], 10 * QUANTILES)).first()[0]
    bounds = Bounds(found or [])

    def bucket_of(order: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(bounds.bucket(order.to_numpy(), hashes.to_numpy()))
    bucket = F.pandas_udf(bucket_of, "int")
    firsts = keyed.select("order", "hash", bucket("order", "hash").alias("bucket")).groupBy("bucket").agg(
        F.max(F.struct("order", "hash")).alias("first")).orderBy("bucket").collect()  # one row for each partition
    before = {tuple(r["first"]): firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}

    def places(order: pd.Series, hashes: pd.Series) -> pd.Series:
        own = bounds.bucket(order.to_numpy(), hashes.to_numpy())
        return pd.Series([[b] if (g := before.get(k)) is None else [b, g]
                          for k, b in zip(zip(order.tolist(), hashes.tolist()), own.tolist())])
    counted = keyed.mapInArrow(_alike_together, keyed.schema)
    dealt = counted.select("*", F.posexplode(F.pandas_udf(places, "array<int>")("order", "hash")).alias(
        "guest", "bucket"))
    return (dealt.repartitionById(len(bounds.orders) + 1, "bucket")
            .sortWithinPartitions("guest", F.desc("order"), F.desc("hash"), F.desc("text"))
            .drop("order", "hash", "bucket"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row: key, text, sketch

    def rows_of(keys, texts, own, following, near_sketch):
        edited = [t[:len(t) - len(t) // 3] + n[:len(t) // 3] for t, n in zip(texts, following)]
        raw = [e.encode() for e in edited]
        changed = sketches(raw)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
             pa.array([as_text(s) for s in own]), pa.array([as_text(s) for s in changed]),
             pa.array([resemblance(a, b) for a, b in zip(own, changed)]),
             pa.array([resemblance(a, b) for a, b in zip(own, near_sketch)]),
             pa.array([distinct_count(s) for s in own])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                   "near_edited", "near_next", "distinct_shingles"])

    def repeated(keys, texts, own, counts):
        """All but the last of rows that are alike are followed by themselves."""
        at = [i for i, n in enumerate(counts) if n > 1]
        if at:
            some = [[x[i] for i in at] for x in (keys, texts, own)]
            rows = rows_of(*some, some[1], some[2])
            for i, row in zip(at, range(len(at))):
                for low in range(0, counts[i] - 1, 1 << 12):
                    yield rows.take(pa.array([row] * min(1 << 12, counts[i] - 1 - low)))
    for block in text_blocks(batches):
        # of the guests at the end only the first is a neighbour
        native = int((block.column("guest").to_numpy() == 0).sum())
        counts = block.column("n").to_pylist()[:native]
        block = block.slice(0, min(native + 1, block.num_rows))
        keys = block.column("key").to_pylist()
        texts = [t or "" for t in block.column("text").to_pylist()]
        own = sketches([t.encode() for t in texts])
        yield from repeated(keys, texts, own, counts)
        if held is not None:
            keys, texts, own = [held[0], *keys], [held[1], *texts], [held[2], *own]
        if len(keys) > 1:
            yield rows_of(keys[:-1], texts[:-1], own[:-1], texts[1:], own[1:])
        if block.num_rows > native:
            held = None
            break
        held = (keys[-1], texts[-1], own[-1])
    for _ in batches:  # rows that repeat the guest's key
        pass


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form, in which the last third of the
    code points (rounded down) gives way to the first as many of the next
    document in descending key order, or all it has.

    A null text is an empty one. Equal texts have equal fingerprints; two texts
    without words resemble each other fully. Rows that repeat a key follow each
    other in descending order of a hash of the text; a very long text is a block of
    its own. A single row is its own neighbour; an empty table gives an
    empty one. Further columns are not read."""
    rows = with_next(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.mapInArrow(_edited, (
        f"{key} long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double, distinct_shingles double"))


@register("op2_fingerprints")
def op2_fingerprints(spark, sf_dir):
    return compare_neighbours(table(spark, sf_dir, "documents"))
