"""Cross-tokenizer alignment by lockstep vectorised merging.

Two tokenizers cut the same bytes: A (byte-level) a space and the text, B
(sentencepiece) the text, before which it puts the space itself. A *link* is a
token of A and a token of B whose byte ranges overlap; bytes where tokens of both
end *cut* the text into groups.

A Spark task takes documents in blocks. One numpy state vector holds a pointer into
A and one into B for every document of the block (a long document has one for each
strip of ``STRIP`` tokens of A, whose pointer into B is found by bisection). Each
step emits the link under every pointer pair and a cut where both tokens end, moves
the pointer whose token ends first, or both, and drops what is finished. A step
costs some array operations for the whole block, and no strip takes many more steps
than another.

Counts of id pairs over the corpus: a task keeps the distinct pairs of its blocks,
up to ``GROUP_PAIRS`` or ``GROUP_BLOCKS``, with their counts (a *group*), and stores links, compressed, as
numbers of pairs in the group. Only distinct pairs of groups move: they are summed, compared
with their B id's greatest count, and brought back to their groups.

Defined results: a null or empty text, or one that the tokens of A or B do not spell
byte by byte (such as one with U+2581), has no tokens. Rows stand alone, so rows
that repeat count twice; a very long text is a block of its own, cut into strips;
null keys pass through; columns but key and text are not read; an empty table gives
an empty one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.llm.catalog import register, table
from pvlens.llm.common import BYTE_CHARACTERS, PieceTable, Pieces, gathered, raw_bytes, text_blocks, written
from pvlens.llm.token_files import LibraryEncoder

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
STRIP = 128
BLOCK_BYTES = 1 << 20
# Distinct pairs (16 bytes each) or blocks after which a task closes a group.
GROUP_PAIRS, GROUP_BLOCKS = 1 << 17, 32
KEPT_PIECES = 60_000
MARK = "▁"


class PieceEncoder(PieceTable):
    """Ids by sentencepiece. A model whose pieces hold the word mark only at their
    begin encodes words apart; texts with marks or spare spaces go to it whole."""

    def __init__(self, path: str):
        super().__init__(KEPT_PIECES, self._tokens, self._cut, _as_they_are)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.names) and (
            self.model.encode(" a  b", out_type=str)[0][0] == MARK)

    def _cut(self, texts: pa.Array) -> Pieces:
        odd = pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, "  "))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = pc.or_(odd, not self.apart)
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), out=first[1:])
        parts = split.flatten().dictionary_encode()
        codes = parts.indices.to_numpy().astype(np.int64)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        codes[first[at]] = len(parts.dictionary) + np.arange(len(at))
        return Pieces(codes, pa.concat_arrays([parts.dictionary, texts.take(pa.array(at))]), first)

    def _tokens(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(pieces.to_pylist(), num_threads=1)
        bounds = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=bounds[1:])
        return np.fromiter(chain.from_iterable(found), np.uint32, bounds[-1]), bounds


def _as_they_are(pieces: pa.Array) -> Pieces:
    n = len(pieces)
    return Pieces(np.arange(n), pieces, np.arange(n + 1))


def _flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(list(map(len, tokens)), out=bounds[1:])
    return np.frombuffer(b"".join(tokens), np.uint8), bounds


def _a_bytes(encoder: LibraryEncoder) -> list[bytes]:
    byte = {chr(c): b for b, c in enumerate(BYTE_CHARACTERS.tolist())}
    words = encoder.tokenizer.get_vocab()
    out = [b""] * (max(words.values()) + 1)
    for word, i in words.items():
        out[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
    return out


def _b_bytes(names: list[str]) -> list[bytes]:
    return [bytes([int(n[3:5], 16)]) if len(n) == 6 and n.startswith("<0x") and n.endswith(">")
            else n.replace(MARK, " ").encode() for n in names]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, strips: np.ndarray,
             stops: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token) and cuts (likewise: the last tokens of each group)
    in the order in which the steps emit them. Strip ``s`` goes from token
    ``strips[s]`` of A, which begins at byte ``begin[s]``, up to ``stops[s]``."""
    i, j, stop = strips, np.searchsorted(end_b, begin, "right"), stops
    links, cuts = [], []
    while len(i):
        links.append((i, j))
        a, b = end_a[i], end_b[j]
        both = a == b
        cuts.append((i[both], j[both]))
        i, j = i + (a <= b), j + (b <= a)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    nothing = [(np.zeros(0, np.int64),) * 2]
    out = [np.concatenate(side) for found in (links, cuts) for side in zip(*(found or nothing))]
    return out[0], out[1], out[2], out[3]


class Aligned:
    """Alignment of a block: per document ``n_a``, ``n_b``, ``n_groups``, ``n_links``
    and ``groups`` (bytes), and the id pairs of all links in order."""


class Aligner:
    """Aligns blocks of texts by two model files."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = LibraryEncoder(a_path, True, KEPT_PIECES), PieceEncoder(b_path)
        a, b = _a_bytes(self.a), _b_bytes(self.b.names)
        self.a_flat, self.b_flat, self.n_b = _flat(a), _flat(b), len(b)
        ids = range(max(len(a), len(b)))
        self.n_ids = len(ids)
        # an id as decimal with what may follow it
        self.shown = [f"{i}{mark}".encode() for mark in (",", "|", ";", "") for i in ids]

    def _spelled(self, texts: pa.Array) -> tuple[list, np.ndarray]:
        """Ids of both sides with their counts, of the texts that both spell."""
        spaced = pc.binary_join_element_wise("", texts, " ")
        raw, bounds = raw_bytes(spaced)
        good = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        sides = []
        for encoder, (flat, ends), given in ((self.a, self.a_flat, spaced), (self.b, self.b_flat, texts)):
            ids, first = encoder.encode(given)
            ids = ids.astype(np.int64)
            data, at = gathered(flat, ends, ids)
            sizes = np.diff(at[first])
            good &= sizes == np.diff(bounds)
            if len(data) == len(raw):
                wrong = np.flatnonzero(data != raw)
                good[np.searchsorted(bounds, wrong, "right") - 1] = False
            else:  # compare text by text
                for t in np.flatnonzero(good).tolist():
                    x, y = at[first[t]], at[first[t + 1]]
                    good[t] = np.array_equal(data[x:y], raw[bounds[t]:bounds[t + 1]])
            sides.append((ids, first))
        out = []
        for ids, first in sides:
            counts = np.where(good, np.diff(first), 0)
            out.append((ids[np.repeat(good, np.diff(first))], counts))
        return out, good

    def align(self, texts: pa.Array) -> Aligned:
        ((a, n_a), (b, n_b)), _ = self._spelled(texts)
        end_a = np.cumsum((self.a_flat[1][1:] - self.a_flat[1][:-1])[a])
        end_b = np.cumsum((self.b_flat[1][1:] - self.b_flat[1][:-1])[b])
        last = np.cumsum(n_a)
        strips_of = -(-n_a // STRIP)
        of = np.repeat(np.arange(len(n_a)), strips_of)
        number = np.arange(len(of)) - np.repeat(np.cumsum(strips_of) - strips_of, strips_of)
        strips = (last - n_a)[of] + number * STRIP
        stops = np.minimum(strips + STRIP, last[of])
        begin = np.append(0, end_a)[strips]
        link_a, link_b, cut_a, cut_b = lockstep(end_a, end_b, strips, stops, begin)
        order = np.argsort(cut_a)
        cut_a, cut_b = cut_a[order] + 1, cut_b[order] + 1
        size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        group = np.repeat(np.arange(len(cut_a)), size_a)
        # a link's place: steps before it, of which each cut moved both pointers
        pairs = np.empty(len(link_a), np.int64)
        pairs[link_a + link_b - group[link_a]] = a[link_a] * self.n_b + b[link_b]
        out = Aligned()
        out.n_a, out.n_b, out.pairs = n_a, n_b, pairs
        groups_before = np.searchsorted(cut_a, np.append(0, last), "right")
        out.n_groups = np.diff(groups_before)
        out.n_links = n_a + n_b - out.n_groups
        # ids in the order of groups, A before B, each with the mark behind it
        a, b = a.copy(), b.copy()
        a[cut_a - 1] += self.n_ids
        b[cut_b - 1] += 2 * self.n_ids
        b[np.cumsum(n_b)[n_b > 0] - 1] += self.n_ids
        all_ids = np.empty(len(a) + len(b), np.int64)
        all_ids[np.arange(len(a)) + np.repeat(cut_b - size_b, size_a)] = a
        all_ids[np.arange(len(b)) + np.repeat(cut_a, size_b)] = b
        ends = np.append(0, np.cumsum(n_a + n_b)).tolist()
        shown = self.shown.__getitem__
        out.groups = [b"".join(map(shown, all_ids[x:y].tolist())) for x, y in zip(ends, ends[1:])]
        return out


@lru_cache(maxsize=2)
def worker_aligner(a_path: str, b_path: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(a_path, b_path)


class Group:
    """Distinct pairs of a task's blocks: numbers in order of their coming."""

    def __init__(self):
        self.pairs = np.zeros(0, np.int64)  # sorted
        self.number = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)  # by number

    def add(self, pairs: np.ndarray) -> np.ndarray:
        """The number of each pair."""
        found = pa.array(pairs).dictionary_encode()
        distinct, codes = found.dictionary.to_numpy(), found.indices.to_numpy()
        at = np.searchsorted(self.pairs, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == distinct[inside]
        numbers = np.empty(len(distinct), np.int64)
        numbers[known] = self.number[at[known]]
        numbers[~known] = len(self.pairs) + np.arange(int((~known).sum()))
        if not known.all():
            merged = np.concatenate([self.pairs, distinct[~known]])
            order = np.argsort(merged, kind="stable")
            self.number = np.concatenate([self.number, numbers[~known]])[order]
            self.pairs = merged[order]
            self.counts = np.append(self.counts, np.zeros(len(order) - len(self.counts), np.int64))
        self.counts[numbers] += np.bincount(codes, minlength=len(distinct))
        return numbers[codes].astype(np.int32)

    def in_order(self) -> np.ndarray:
        out = np.empty_like(self.pairs)
        out[self.number] = self.pairs
        return out


PER_DOC = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
           ("groups_sha256", pa.string())]


def _blocks(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each block with its documents and links, and one for each group
    with its pairs."""
    aligner, task = worker_aligner(*paths), TaskContext.get().partitionId()
    group, n_groups, n_blocks = Group(), 0, 0
    key_type = None

    def row(documents=None, links=None, pairs=None, counts=None) -> pa.RecordBatch:
        def one(values, kind):
            return pa.ListArray.from_arrays([0, len(values)], values) if values is not None else pa.nulls(
                1, pa.list_(kind))
        kinds = [key_type, *(k for _, k in PER_DOC)]
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{task}-{n_groups}"])]
            + [one(documents[i] if documents else None, k) for i, k in enumerate(kinds)]
            + [pa.array([links], pa.binary()), one(pairs, pa.int64()), one(counts, pa.int64())], names=names)

    for block in text_blocks(batches, "text", BLOCK_BYTES):
        key_type = block.column("key").type
        found = aligner.align(block.column("text").fill_null("").cast(pa.string()))
        links = group.add(found.pairs)
        hashes = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups]
        values = [found.n_a, found.n_b, found.n_groups, found.n_links, hashes]
        yield row([block.column("key")] + [pa.array(v, k) for v, (_, k) in zip(values, PER_DOC)],
                  zstandard.compress(links.tobytes(), 1))
        n_blocks += 1
        if len(group.pairs) >= GROUP_PAIRS or n_blocks >= GROUP_BLOCKS:
            yield row(pairs=pa.array(group.in_order()), counts=pa.array(group.counts))
            group, n_groups, n_blocks = Group(), n_groups + 1, 0
    if len(group.pairs):
        yield row(pairs=pa.array(group.in_order()), counts=pa.array(group.counts))


def _aligned(docs: DataFrame, key: str, text: str, paths: tuple[str, str]) -> DataFrame:
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = [("key", rows.schema["key"].dataType), *((n, T.StringType() if n == "groups_sha256" else T.LongType())
                                                      for n, _ in PER_DOC),
             ("pairs", T.LongType()), ("counts", T.LongType())]
    fields = [T.StructField(n, T.ArrayType(k)) for n, k in kinds]
    schema = T.StructType([T.StructField("group", T.StringType()), *fields[:-2],
                           T.StructField("links", T.BinaryType()), *fields[-2:]])
    found = rows.mapInArrow(lambda b: _blocks(b, paths, schema.names), schema)
    return written(found, "alignment")


def _totals(blocks: DataFrame, n_b: int) -> DataFrame:
    """Each pair's count over all links, and whether no pair of its B id has more."""
    pairs = blocks.where(F.col("pairs").isNotNull()).select(
        F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    totals = written(pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")), "pair-counts")
    b = (F.col("pair") % n_b).alias("b")
    # one row for each id of B's vocabulary
    most = totals.groupBy(b).agg(F.max("n").alias("most"))
    return totals.withColumn("b", b).join(F.broadcast(most), "b").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)


def _size_b(path: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def pair_counts(docs: DataFrame, text: str = "text", a_path: str | None = None,
                b_path: str | None = None) -> DataFrame:
    """The alignment of the vocabularies: ``a_id``, ``b_id``, the number ``n`` of
    links that hold them, and whether it is the ``best`` of its B id."""
    paths = _paths(a_path, b_path)
    n_b = _size_b(paths[1])
    totals = _totals(_aligned(docs, text, text, paths), n_b)
    return totals.select((F.col("pair") / n_b).cast("long").alias("a_id"),
                         (F.col("pair") % n_b).alias("b_id"), "n", "best")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None,
          b_path: str | None = None) -> DataFrame:
    """One row for each document: ``key``, tokens of both, groups, links, links with
    the best pair of their B id, the sum of the links' pair counts, and the hash of
    the groups' ids (see the module for odd rows)."""
    paths = _paths(a_path, b_path)
    blocks = _aligned(docs, key, text, paths)
    totals = _totals(blocks, _size_b(paths[1]))
    wanted = blocks.where(F.col("pairs").isNotNull()).select("group", F.posexplode("pairs").alias("at", "pair"))
    # a group's answers: its pairs' counts in its own order, negative for the best
    value = F.when(F.col("best"), -F.col("n")).otherwise(F.col("n"))
    answers = (wanted.join(totals, "pair").groupBy("group")
               .agg(F.sort_array(F.collect_list(F.struct("at", value.alias("value")))).alias("found"))
               .select("group", F.col("found.value").alias("values")))
    of = blocks.where(F.col("links").isNotNull()).drop("pairs", "counts").join(answers, "group", "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = {n: row.column(n).flatten() for n in row.schema.names if n not in ("group", "links")}
                values = get["values"].to_numpy(zero_copy_only=False)
                links = np.frombuffer(zstandard.decompress(row.column("links")[0].as_py()), np.int32)
                counts = values[links] if len(links) else np.zeros(0, np.int64)
                ends = np.append(0, np.cumsum(get["n_links"].to_numpy()))
                best = np.append(0, np.cumsum(counts < 0))[ends]
                total = np.append(0, np.cumsum(np.abs(counts)))[ends]
                yield pa.RecordBatch.from_arrays(
                    [get["key"], *(get[n] for n in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(np.diff(best)), pa.array(np.diff(total)), get["groups_sha256"]], names=out.names)
    long = T.LongType()
    out = T.StructType([T.StructField(key, docs.schema[key].dataType)]
                       + [T.StructField(n, long) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
                       + [T.StructField("groups_sha256", T.StringType())])
    return of.mapInArrow(run, out)


@register("op13_alignment")
def op13_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"))
