"""Document quality by a factorisation machine.

Inputs of a score are the text's words (hashed into ``BUCKETS``) and structure
statistics of text and length, each as one of ``BINS`` steps; never labels,
language, source or id. The machine adds to a linear model the interaction
``<v_i, v_j> x_i x_j`` of all pairs of inputs with vectors of ``RANK`` numbers,
computed in linear time as half of (square of the sum minus sum of the squares).

It is fitted on a bounded sample: at most ``TRAIN_ROWS`` labelled rows, the ones
whose id hashes lowest, so the sample is the same in every run. Their inputs are
made by Spark tasks; only those are collected. The model is a table of fixed size
that goes to the tasks with their code, and every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.llm.catalog import register, table
from pvlens.llm.common import cut_words, hashed, text_blocks, utf8, with_column

BUCKETS, BINS, RANK = 4096, 16, 8
TRAIN_ROWS = 8000
THRESHOLD = 0.3
SEED = 11

_KINDS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b".,;:'\"()-",
                                b"#$%&*+/<=>@[\\]^_`{|}~", b"\n"), 1):
    _KINDS[list(_bytes)] = _kind
_KINDS[128:] = 7
N_KINDS = 8
STATS = ["upper", "digit", "shout", "mark", "symbol", "line", "wide", "length", "word_length",
         "distinct", "top_word", "repeated", "alone"]
INPUTS = BUCKETS + BINS * len(STATS)


def statistics(texts: list[bytes], words) -> np.ndarray:
    """One row of structure statistics between 0 and 1 for each text, as ``STATS``."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    kinds = _KINDS[np.frombuffer(b"".join(texts), np.uint8)]
    text_of = np.repeat(np.arange(n), sizes)
    counts = np.bincount(text_of * N_KINDS + kinds, minlength=n * N_KINDS).reshape(n, N_KINDS)
    shares = counts[:, 1:] / np.maximum(sizes, 1)[:, None]
    n_words = np.diff(words.first)
    held = np.maximum(n_words, 1)
    of = np.repeat(np.arange(n), n_words)
    letters = np.bincount(of, np.diff(words.bounds), n) / held
    vocabulary = max(1, len(words.vocabulary))
    pairs, times = np.unique(of * vocabulary + words.codes, return_counts=True)
    distinct = np.bincount(pairs // vocabulary, minlength=n)
    top, once = np.zeros(n, np.int64), np.bincount(pairs[times == 1] // vocabulary, minlength=n)
    np.maximum.at(top, pairs // vocabulary, times)
    same = (words.codes[1:] == words.codes[:-1]) & (of[1:] == of[:-1])
    repeated = np.bincount(of[1:][same], minlength=n)
    return np.column_stack([
        shares, np.log1p(sizes) / 20, np.minimum(letters / 30, 1), distinct / held, top / held,
        repeated / held, once / held])


def inputs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of all texts as (text, input, value), ordered by text and input."""
    words = cut_words(texts, lower=True)
    n, n_words = len(texts), np.diff(words.first)
    bucket = (hashed(words.vocabulary, SEED) % np.uint64(BUCKETS)).astype(np.int64)
    of = np.repeat(np.arange(n), n_words)
    keys, times = np.unique(of * BUCKETS + (bucket[words.codes] if len(of) else 0), return_counts=True)
    text, at = keys // BUCKETS, keys % BUCKETS
    value = np.sqrt(times / n_words[text])  # unit length over the words of a text
    stats = statistics(texts, words)
    step = np.minimum((np.sqrt(stats) * BINS).astype(np.int64), BINS - 1)
    more = BUCKETS + np.arange(len(STATS)) * BINS + step
    text = np.concatenate([text, np.repeat(np.arange(n), len(STATS))])
    at = np.concatenate([at, more.ravel()])
    value = np.concatenate([value, np.ones(n * len(STATS))])
    order = np.argsort(text, kind="stable")
    return text[order], at[order], value[order].astype(np.float32)


@dataclass
class Machine:
    """A fitted factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        text, at, value = inputs(texts)
        n = len(texts)
        raw = self.bias + np.bincount(text, self.linear[at] * value, n)
        for f in range(self.factors.shape[1]):
            x = self.factors[at, f] * value
            raw += 0.5 * (np.bincount(text, x, n) ** 2 - np.bincount(text, x * x, n))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 20,
        batch: int = 256, rate: float = 0.02, decay: float = 1e-3) -> Machine:
    """Fit on (inputs, values) rows by Adam; without rows of both labels the
    machine scores the labels' mean (none: one half)."""
    mean = (labels.sum() + 1) / (len(labels) + 2)
    random = np.random.default_rng(SEED)
    params = [np.array([np.log(mean / (1 - mean))], np.float32), np.zeros(INPUTS, np.float32),
              random.normal(0, 0.05, (INPUTS, RANK)).astype(np.float32)]
    if len(set(labels.tolist())) < 2:
        return Machine(float(params[0][0]), params[1], 0 * params[2])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(rows), batch):
            chosen = order[start:start + batch]
            x = np.zeros((len(chosen), INPUTS), np.float32)
            for i, r in enumerate(chosen):
                x[i, rows[r][0]] = rows[r][1]
            bias, linear, v = params
            sums, squares = x @ v, x * x
            raw = bias[0] + x @ linear + 0.5 * ((sums ** 2) - squares @ (v * v)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
            error = error.astype(np.float32)
            grads = [error.sum(keepdims=True), x.T @ error + decay / 10 * linear,
                     x.T @ (error[:, None] * sums) - (squares.T @ error)[:, None] * v + decay * v]
            step += 1
            for p, g, (m, s) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)
    return Machine(float(params[0][0]), params[1], params[2])


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: CRC-32 of its id as text divides by
    five (a null id is not held out)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents that are not held out. Rows
    without a label and labels without a document are left aside. An id counts
    once, with its least label and of its documents the one whose text's hash is
    least, so that no more than ``rows`` rows come to the driver."""
    chosen = (labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key")))
              .groupBy("key").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("key"), "key").limit(rows))
    # at most ``rows`` rows of two numbers
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "key")
    # partial minima leave each task one text an id before anything moves
    sample = sample.groupBy("key", "label").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("key", "least.text", "label")

    def made(batches):
        for block in text_blocks(batches):
            of, at, value = inputs(utf8(block.column("text")))
            cuts = np.searchsorted(of, np.arange(block.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), block.column("label"),
                 pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32))),
                 pa.ListArray.from_arrays(cuts, pa.array(value))],
                names=["key", "label", "at", "value"])
    kind = dict(sample.dtypes)["key"]
    found = sample.mapInArrow(made, f"key {kind}, label int, at array<int>, value array<float>")
    found = found.toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    pairs = [(at.values.to_numpy(), value.values.to_numpy())
             for at, value in zip(found["at"], found["value"])]
    return fit(pairs, found["label"].to_numpy().astype(np.float32))


def score_documents(docs: DataFrame, machine: Machine, text: str = "text",
                    out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability of label 1.

    Null and empty texts are scored from their statistics alone. Other columns
    pass through; one named like ``out`` is replaced; rows stand alone; an empty
    table gives an empty one; a very long text is a block of its own, scored whole."""
    def run(batches):
        for block in text_blocks(batches, text):
            yield with_column(block, out, pa.array(machine.score(utf8(block.column(text)))))
    fields = [f for f in docs.schema.fields if f.name != out]
    return docs.mapInArrow(run, T.StructType(fields + [T.StructField(out, T.DoubleType())]))


@register("op10_quality")
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
