"""Token counts of texts by a two-tier lookup on the map side.

The vocabulary joins a word-begin mark only to what follows it, never to what
stands before, so a text's pre-tokens (a mark and the characters up to the next
one) are tokenised independently and their counts add up. (This is checked
against the model file; a model of another kind gets its texts whole.)

Tier one: the corpus' frequent pre-tokens come from Spark's mergeable
frequent-items sketch over all documents, a bounded state per task instead of a
shuffle of pre-tokens. Their token counts are a table of at most
``FREQUENT`` entries of at most ``FREQUENT_CHARS`` characters, which is broadcast.
Tier two: what the table lacks is looked up in a bounded cache of the worker and
encoded by the library on a miss. The sketch only decides what is fast; every
count is the library's.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.llm.catalog import register, table
from pvlens.llm.common import schema_with, text_blocks, with_column

MODEL_FILE = "piece_bpe_32k.model"
FREQUENT, FREQUENT_CHARS = 4096, 48
# Items that a sketch tracks (some 200 KB), and sketches that a task merges at
# least: partitions / FAN_IN^2 are left for the last merge.
TRACKED, FAN_IN = 16384, 64
KEPT_PIECES = 400_000
MARK = "▁"


class Counter:
    """Counts tokens with one model; ``frequent`` is the broadcast tier."""

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.separable = not any(MARK in p.lstrip(MARK) for p in pieces) and (
            self.model.encode(" a  b", out_type=str)[0][0] == MARK)
        self.kept: dict[str, int] = {}

    def library(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def count(self, texts: pa.Array, frequent: dict[str, int]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        whole = pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, "  "))
        whole = pc.or_(whole, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        whole = whole.to_numpy(zero_copy_only=False) | (not self.separable)
        if whole.any():
            out[whole] = self.library(texts.filter(pa.array(whole)).to_pylist())
        plain = np.flatnonzero(~whole)
        if len(plain):
            split = pc.split_pattern(texts.take(pa.array(plain)), " ")
            ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
            parts = split.flatten().dictionary_encode()
            counts = self._lookup(parts.dictionary.to_pylist(), frequent)
            sums = np.append(0, np.cumsum(counts[parts.indices.to_numpy()]))[np.append(0, ends)]
            out[plain] = np.diff(sums)
        return out

    def _lookup(self, pieces: list[str], frequent: dict[str, int]) -> np.ndarray:
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        missing = [p for p in pieces if p not in frequent and p not in self.kept]
        fresh = dict(zip(missing, self.library(missing)))
        self.kept |= {p: n for p, n in fresh.items() if len(p) <= FREQUENT_CHARS}
        known = [frequent, self.kept, fresh]
        return np.fromiter((next(t[p] for t in known if p in t) for p in pieces),
                           np.int64, len(pieces))


@lru_cache(maxsize=2)
def worker_counter(model_path: str) -> Counter:
    return Counter(model_path)


def frequent_pieces(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent short pre-tokens of all documents (at most ``FREQUENT``).

    A sketch tracks ``TRACKED`` items however large its part. The sketches of
    ``FAN_IN`` neighbouring partitions are merged, then those of as many groups,
    so a task reads a bounded number of them. An empty table has none."""
    words = docs.select(F.spark_partition_id().alias("part"),
                        F.explode(F.split(F.col(text), " ")).alias("w")).where(
        F.length("w").between(1, FREQUENT_CHARS))
    group = (F.col("part") / FAN_IN).cast("int").alias("part")
    combine = F.expr(f"approx_top_k_combine(state, {TRACKED})").alias("state")
    states = words.groupBy(group).agg(
        F.expr(f"approx_top_k_accumulate(w, {TRACKED})").alias("state"))
    states = states.groupBy(group).agg(combine).groupBy(F.lit("all")).agg(combine)
    top = states.select(F.expr(f"approx_top_k_estimate(state, {FREQUENT})").alias("top")).first()
    return [r["item"] for r in (top and top["top"] or [])]


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens",
                 model_path: str | None = None) -> DataFrame:
    """``docs`` with ``out``: the number of tokens the library gives the whole
    text, without begin and end tokens.

    Null and empty texts have none. Other columns pass through; one named like
    ``out`` is replaced. Repeated rows repeat; an empty table stays empty; a very
    long text is a block of its own, counted whole."""
    path = model_path or public_tokenizers.path(MODEL_FILE)
    pieces = frequent_pieces(docs, text)
    lengths = dict(zip(pieces, Counter(path).library(pieces)))
    shared = docs.sparkSession.sparkContext.broadcast(lengths)

    def run(batches):
        counter = worker_counter(path)
        for block in text_blocks(batches, text):
            texts = block.column(text).fill_null("").cast(pa.string())
            yield with_column(block, out, pa.array(counter.count(texts, shared.value)))
    return docs.mapInArrow(run, schema_with(docs, out, T.LongType()))


@register("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
