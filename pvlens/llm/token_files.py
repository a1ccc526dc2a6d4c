"""Token ids in files: blocks of ids cut into planes, compressed, with an index.

Documents are range-partitioned by ``doc_id`` and encoded in that order. A task
packs whole documents into segments. A segment's ids are cut into chunks of
``CHUNK_IDS``; a chunk is transposed into planes (all lowest bytes, then all
second bytes and so on, or the same with bits), so that alike values stand
together and the empty high planes vanish, and every plane is compressed with
zstandard. The chunk index holds, for each chunk, its number of ids and the size
of each plane, so one chunk can be read by itself; the document index holds the
ids and lengths of the segment's documents.

A segment is a row of a Parquet file: Spark's commit protocol writes it, any
store can hold it, and any split of the files can be read by itself. Positions
over all files come from the parts' totals, one row for each part.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.llm.bpe import binary_array
from pvlens.llm.catalog import register, table
from pvlens.llm.common import PLAIN, PieceTable, back_in_order, byte_level, raw_bytes, text_blocks
from pvlens.session import scratch_path

VOCABULARY_FILE = "byte_bpe_50k.json"
END_ID = 2
CHUNK_IDS = 65_536
# Ids after which a segment is closed (4 bytes each before compression).
SEGMENT_IDS = 1 << 20
LEVEL = 3
# Memory of a Python worker: pieces that are kept in each of two generations, and
# rows that Spark sends to it at once (by default 10,000, 35 MB of usual texts, which
# the executor and the worker both hold beside their own).
KEPT_PIECES = 120_000
ROWS_AT_ONCE = 2_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

SEGMENT = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()),
    T.StructField("first_in_part", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("plane_kind", T.StringType()),
    T.StructField("chunk_index", T.ArrayType(T.StructType([
        T.StructField("n", T.IntegerType()),
        T.StructField("plane_bytes", T.ArrayType(T.IntegerType()))]))),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_lengths", T.ArrayType(T.LongType())),
    T.StructField("planes", T.BinaryType())])


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a chunk, lowest first; a plane of zeros is empty."""
    parts = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "bit":
        bits = np.unpackbits(np.ascontiguousarray(parts)[:, :, None], axis=2, bitorder="little")
        parts = np.packbits(bits.transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in parts]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids of a chunk."""
    if kind == "byte":
        rows = np.zeros((4, n), np.uint8)
        for row, plane in zip(rows, planes):
            if plane:
                row[:] = np.frombuffer(plane, np.uint8)
        return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)
    ids = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        if plane:
            bits = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
            ids |= bits.astype(np.uint32) << np.uint32(b)
    return ids


def pack(ids: np.ndarray, kind: str) -> tuple[list[dict], bytes]:
    """Chunk index and compressed planes of a segment's ids."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    index, out = [], []
    for at in range(0, len(ids), CHUNK_IDS):
        chunk = ids[at:at + CHUNK_IDS]
        planes = [squeeze(p) if p else b"" for p in to_planes(chunk, kind)]
        index.append({"n": len(chunk), "plane_bytes": [len(p) for p in planes]})
        out += planes
    return index, b"".join(out)


def unpack(index: list[dict], data: bytes, kind: str) -> np.ndarray:
    """All ids of a segment."""
    expand, at, out = zstandard.ZstdDecompressor().decompress, 0, [np.zeros(0, np.uint32)]
    for chunk in index:
        planes = []
        for size in chunk["plane_bytes"]:
            planes.append(expand(data[at:at + size]) if size else b"")
            at += size
        out.append(from_planes(planes, chunk["n"], kind))
    return np.concatenate(out)


class LibraryEncoder(PieceTable):
    """Ids by the tokenizers library. Pieces between safe cuts are encoded once:
    letters, with or without a space before them, are one pre-token, and all new
    ones go to the library's model in one call; any other piece is first cut by
    the library's pre-tokenizer, or goes to the library whole if it holds an added
    token (with ``plain`` added tokens inside texts are plain text)."""

    def __init__(self, path: str, plain: bool = False, kept: int = KEPT_PIECES):
        super().__init__(kept, self._tokens)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.model = Tokenizer(self.tokenizer.model)  # nothing but the model
        added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added)) or r"(?!)")
        words = self.model.get_vocab(with_added_tokens=False)
        self.length = np.zeros(max(words.values()) + 1, np.int64)
        self.length[list(words.values())] = list(map(len, words))

    def _tokens(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        simple = pc.match_substring_regex(pieces, PLAIN)
        words = pieces.filter(simple)
        ids = [np.array(self.model.encode_batch_fast(
            [byte_level(words)], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)]
        # a character of the vocabulary is a byte of the text
        ends = np.cumsum(self.length[ids[0]])
        counts = [np.diff(np.searchsorted(ends, raw_bytes(words)[1], "right"))]
        cut, model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        rest = [self.tokenizer.encode(p, add_special_tokens=False).ids if self.added.search(p)
                else [t.id for token, _ in cut(p) for t in model(token)]
                for p in pieces.filter(pc.invert(simple)).to_pylist()]
        ids.append(np.fromiter(chain.from_iterable(rest), np.uint32))
        counts.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        return back_in_order(np.concatenate(ids), np.concatenate(counts), simple)


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _segments(batches: Iterator[pa.RecordBatch], path: str, kind: str,
              end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, schema = worker_encoder(path), None
    part, segment, first = TaskContext.get().partitionId(), 0, 0
    ids: list[np.ndarray] = []
    docs: list[int | None] = []
    lengths: list[int] = []

    def close() -> pa.RecordBatch:
        nonlocal segment, first
        index, planes = pack(np.concatenate(ids), kind)
        row = {"part": part, "segment": segment, "first_in_part": first, "n_ids": sum(lengths),
               "plane_kind": kind, "chunk_index": index, "doc_ids": list(docs),
               "doc_lengths": list(lengths), "planes": planes}
        segment, first = segment + 1, first + row["n_ids"]
        ids.clear(), docs.clear(), lengths.clear()
        return pa.RecordBatch.from_pylist([row], schema=schema)
    schema = pa.schema([
        ("part", pa.int32()), ("segment", pa.int32()), ("first_in_part", pa.int64()),
        ("n_ids", pa.int64()), ("plane_kind", pa.string()),
        ("chunk_index", pa.list_(pa.struct([("n", pa.int32()), ("plane_bytes", pa.list_(pa.int32()))]))),
        ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
        ("planes", pa.binary())])
    held = 0
    for block in text_blocks(batches, "text"):
        found, bounds = encoder.encode(block.column("text").fill_null("").cast(pa.string()))
        for i, doc in enumerate(block.column("doc_id").to_pylist()):
            one = np.append(found[bounds[i]:bounds[i + 1]], np.uint32(end_id))
            ids.append(one), docs.append(doc), lengths.append(len(one))
            held += len(one)
            if held >= SEGMENT_IDS:
                held = 0
                yield close()
    if docs:
        yield close()


def write_token_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                      vocabulary: str | None = None, end_id: int = END_ID,
                      kind: str = "byte") -> None:
    """Write the ids of all texts to ``path`` in ascending ``key`` order, each
    document ended by ``end_id``.

    A null text is an empty one (its end id alone), null keys come first, rows
    that repeat a key stand side by side by a hash of their texts, a very long text
    is a block and a segment of its own, further columns are not written, and an
    empty table writes files without segments. The order is cut on key, hash and
    number of the row, so a key that holds a third of all rows, with one text or
    with many, spreads over as many ranges."""
    model = vocabulary or public_tokenizers.path(VOCABULARY_FILE)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = (rows.repartitionByRange(parts, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash")
               .select("doc_id", "text"))
    conf = docs.sparkSession.conf
    before = conf.get(_ROWS)
    conf.set(_ROWS, str(ROWS_AT_ONCE))
    try:
        ordered.mapInArrow(lambda b: _segments(b, model, kind, end_id), SEGMENT).write.option(
            "compression", "none").parquet(path)
    finally:
        conf.set(_ROWS, before)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files at ``path``: ``doc_id``, ``start`` (ids before it
    in all files) and ``ids`` (little-endian unsigned 32-bit integers)."""
    files = spark.read.schema(SEGMENT).parquet(path)
    # one row for each part that was written
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["chunk_index"], row["planes"], row["plane_kind"])
                bounds = np.zeros(len(row["doc_ids"]) + 1, np.int64)
                np.cumsum(row["doc_lengths"], out=bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()),
                     pa.array(row["before"] + row["first_in_part"] + bounds[:-1]),
                     binary_array(ids, bounds)], names=["doc_id", "start", "ids"])
    return files.join(F.broadcast(parts), "part").mapInArrow(
        run, "doc_id long, start long, ids binary")


@register("op5_token_files")
def op5_token_files(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
