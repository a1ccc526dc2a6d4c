"""Byte-level BPE by corpus-level merge replay, and decoding.

A Spark task takes its documents in blocks. The block's distinct pre-tokens (the
matches of the split pattern) that its worker has not met yet form a corpus: one
array of symbols with links to the neighbours. An inverted index leads from the
rank of a token pair to the positions where the pair stands. Ranks are taken in
rising order; all positions of a rank are merged at once, and only the pairs
with the touched neighbours are looked up and entered into the index again. A
merge thus costs what it changes, however many documents hold the pre-token, and
a very long pre-token costs no more than many short ones.

Merging by rank over the corpus gives each pre-token the same merges as merging
it alone, lowest rank first and leftmost first, unless a merge makes a pair of a
*lower* rank than its own. The replay notices that, and such a pre-token is done
again alone. Positions that overlap (``aaa``) are taken leftmost first.

Nothing is shuffled; what a worker keeps between blocks is bounded.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.llm.catalog import register, table
from pvlens.llm.common import PLAIN, PieceTable, back_in_order, gathered, raw_bytes, schema_with, text_blocks, whole_texts, with_column

RANKS_FILE = "byte_bpe_50k.tiktoken"
# Pieces whose ids a worker keeps between blocks.
KEPT_PIECES = 150_000
# Large enough that a block holds many new pre-tokens for each rank it replays.
BLOCK_BYTES = 6 << 20
NONE = np.int32(2**31 - 1)


class Ranks:
    """A rank file as arrays. ``pair_keys`` are all pairs of tokens whose bytes
    together are a token, ``pair_ranks`` its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {r: t for t, r in self.of.items()}
        self.byte = np.array([self.of[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.of[t[:i]] << 32 | self.of[t[i:]], r) for t, r in self.of.items()
                 for i in range(1, len(t)) if t[:i] in self.of and t[i:] in self.of]
        keys, ranks = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order].astype(np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_alone(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one pre-token: a heap of (rank, position) over linked symbols."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))

    def rank(i: int) -> int | None:
        j = after[i]
        return ranks.of.get(parts[i] + parts[j]) if j < len(parts) else None
    heap = [(r, i) for i in range(len(parts)) if (r := rank(i)) is not None]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        if parts[i] is None or rank(i) != r:
            continue
        j = after[i]
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (new := rank(k)) is not None:
                heappush(heap, (new, k))
    return [ranks.of[p] for p in parts if p is not None]


def replay(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pre-tokens, one after the other, and the bounds of each."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(pieces) else 0
    symbol = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    word = np.repeat(np.arange(len(pieces)), lengths)
    # position n stands for "no neighbour"
    after = np.arange(1, n + 2)
    before = np.arange(-1, n)
    last, head = ends[lengths > 0] - 1, (ends - lengths)[lengths > 0]
    after[last], before[head] = n, n
    symbol = np.append(symbol, np.int32(-1))
    rank = np.full(n + 1, NONE, np.int32)
    pairs = np.flatnonzero(after[:-1] != n)
    rank[pairs] = ranks.pair(symbol[pairs], symbol[pairs + 1])

    index: dict[int, list[np.ndarray]] = defaultdict(list)
    waiting: list[int] = []

    def enter(positions: np.ndarray) -> None:
        found = rank[positions]
        order = np.argsort(found, kind="stable")
        found, positions = found[order], positions[order]
        stop = int(np.searchsorted(found, NONE))
        cuts = np.flatnonzero(np.diff(found[:stop])) + 1
        start = 0
        for end in [*cuts.tolist(), stop]:
            if end > start:
                r = int(found[start])
                if r not in index:
                    heappush(waiting, r)
                index[r].append(positions[start:end])
            start = end

    enter(pairs)
    alone: list[np.ndarray] = []
    while waiting:
        r = heappop(waiting)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not len(at):
            continue
        chained = np.append(False, after[at[:-1]] == at[1:])
        if chained.any():  # of overlapping pairs every second one, from the left
            place = np.arange(len(at))
            place -= np.maximum.accumulate(np.where(chained, 0, place))
            at = at[place % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        # where the next pair waits too, the merged symbol meets its first symbol
        meets = rank[beyond] == r
        lower = meets.copy()
        lower[meets] = ranks.pair(np.full(int(meets.sum()), r), symbol[beyond[meets]]) < r
        if lower.any():
            alone.append(np.unique(word[at[lower]]))
        symbol[at] = r
        after[at] = beyond
        before[beyond] = at
        before[n], after[n] = n, n
        rank[gone] = NONE
        behind = before[at]
        rank[at] = np.where(beyond == n, NONE, ranks.pair(symbol[at], symbol[beyond]))
        behind = behind[behind != n]
        rank[behind] = ranks.pair(symbol[behind], symbol[after[behind]])
        rank[n] = NONE
        touched = np.concatenate([at, behind])
        lower = rank[touched] < r
        if lower.any():
            alone.append(np.unique(word[touched[lower]]))
        symbol[gone] = -1
        enter(touched)
    ids = symbol[:n]
    kept = ids >= 0
    counts = np.bincount(word[kept], minlength=len(pieces))
    bounds = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    ids = ids[kept].astype(np.uint32)
    if alone:
        again = np.unique(np.concatenate(alone))
        parts = np.split(ids, bounds[1:-1])
        for w in again.tolist():
            parts[w] = np.array(merge_alone(pieces[w], ranks), np.uint32)
        np.cumsum([len(p) for p in parts], out=bounds[1:])
        ids = np.concatenate(parts)
    return ids, bounds


class Encoder(PieceTable):
    """Encodes blocks of texts by replaying the merges of their new pre-tokens. Texts
    are cut into pieces as :data:`public_tokenizers.PATTERN` cuts; by any other
    pattern they are matched whole."""

    def __init__(self, path: str, pattern: str):
        known = pattern == public_tokenizers.PATTERN
        super().__init__(KEPT_PIECES, self._tokens, *(() if known else (whole_texts, whole_texts)))
        self.ranks = load_ranks(path)
        self.pattern, self.known = regex.compile(pattern), known

    def _tokens(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and the bounds of each."""
        # letters, with or without a space before them, are one match
        simple = pc.match_substring_regex(pieces, PLAIN) if self.known else pa.array([False] * len(pieces))
        rest = [self.pattern.findall(p) for p in pieces.filter(pc.invert(simple)).to_pylist()]
        tokens = pa.concat_arrays([pieces.filter(simple), pa.array(list(chain.from_iterable(rest)), pa.string())])
        counts = np.append(np.ones(len(pieces) - len(rest), np.int64), np.fromiter(map(len, rest), np.int64, len(rest)))
        distinct = tokens.dictionary_encode()
        raw, ends = raw_bytes(distinct.dictionary)
        data, ends = raw.tobytes(), ends.tolist()
        words = [data[a:b] for a, b in zip(ends, ends[1:])]
        whole = np.fromiter((self.ranks.of.get(w, -1) for w in words), np.int64, len(words))
        ids, bounds = replay([w for w, r in zip(words, whole.tolist()) if r < 0], self.ranks)
        # a token that is whole is one id; put those behind the replayed ones
        place = np.where(whole < 0, np.cumsum(whole < 0) - 1,
                         len(bounds) - 1 + np.cumsum(whole >= 0) - 1)
        ids = np.concatenate([ids, whole[whole >= 0].astype(np.uint32)])
        bounds = np.concatenate([bounds, bounds[-1] + 1 + np.arange(int((whole >= 0).sum()))])
        codes = distinct.indices.to_numpy().astype(np.int64)
        ids, ends = gathered(ids, bounds, place[codes] if len(codes) else codes)
        firsts = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(counts, out=firsts[1:])
        return back_in_order(ids, np.diff(ends[firsts]), simple)


@lru_cache(maxsize=2)
def worker_encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows ``data[bounds[i]:bounds[i + 1]]`` as a binary column."""
    width = data.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1,
        [None, pa.py_buffer((bounds * width).astype(np.int64)),
         pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode_documents(docs: DataFrame, text: str = "text", out: str = "ids",
                     decoded: str | None = None, ranks_path: str | None = None,
                     pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with ``out``: the text's token ids as little-endian unsigned
    32-bit integers. With ``decoded``, the ids are also decoded again, in the same
    task, into a column of that name (see :func:`decode_documents`).

    A null or empty text has no ids. Other columns pass through; ones named like
    the results are replaced. Each row stands alone, so repeated rows repeat
    their ids and an empty table gives an empty one. A very long text is a block of
    its own."""
    path = ranks_path or public_tokenizers.path(RANKS_FILE)

    def run(batches):
        encoder = worker_encoder(path, pattern)
        for block in text_blocks(batches, text, BLOCK_BYTES):
            ids, bounds = encoder.encode(block.column(text).fill_null("").cast(pa.string()))
            block = with_column(block, out, binary_array(ids, bounds))
            yield with_column(block, decoded, _decoded(ids, bounds, encoder.ranks)) if decoded else block
    fields = [f for f in docs.schema.fields if f.name not in (out, decoded)]
    fields += [T.StructField(n, T.BinaryType()) for n in (out, decoded) if n]
    return docs.mapInArrow(run, T.StructType(fields))


def _decoded(ids: np.ndarray, bounds: np.ndarray, ranks: Ranks) -> pa.Array:
    token = ranks.bytes.__getitem__
    return pa.array([b"".join(map(token, ids[a:b].tolist()))
                     for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())


def decode_documents(docs: DataFrame, ids: str = "ids", out: str = "decoded",
                     ranks_path: str | None = None) -> DataFrame:
    """``docs`` with ``out``: the bytes that the ids stand for (null ids: none)."""
    path = ranks_path or public_tokenizers.path(RANKS_FILE)

    def run(batches):
        ranks = load_ranks(path)
        for block in text_blocks(batches, ids, BLOCK_BYTES):
            rows = block.column(ids).fill_null(b"").to_pylist()
            bounds = np.cumsum([0, *(len(r) // 4 for r in rows)])
            yield with_column(block, out, _decoded(np.frombuffer(b"".join(rows), "<u4"), bounds, ranks))
    return docs.mapInArrow(run, schema_with(docs, out, T.BinaryType()))


@register("op6_byte_bpe")
def op6_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, decoded="decoded")
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
