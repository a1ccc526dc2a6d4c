"""Benchmark decontamination: BM25 over an inverted index of test items.

The index holds the test items in pieces of at most ``PIECE`` words; every
passage of every document is a query. An impact is the BM25 weight of a term in
a piece divided by the score of the piece against itself, so a passage that
holds a whole piece scores 1 and one threshold fits all pieces. Postings are cut
into blocks of ``BLOCK`` pieces; each term keeps its greatest impact over all
pieces and in each block.

A passage's bound in a block is the sum of its terms' greatest impacts there. It
is computed for all passages of a batch at once, and only passages that reach
the threshold in some block are searched by block-max WAND, which returns *all*
pieces at or above the threshold (there is no top-k). A hit is then verified by
the pairs of neighbouring words of the item's question and of its answer (its
last sentence) that occur around the passage: half of the piece's share of both,
all of the piece's share of the question where that is the larger part of it, or
half of the whole item's both. The
check looks as far around the passage as the item itself is long. Pieces of a
longer item are all ``PIECE`` words, the last one reaches back for them.

Items are a small table, but not one of a known size: the index is built in
shards of about ``SHARD_ROWS // 2`` pieces, which bounds a shard to some
``SHARD_ROWS * PIECE`` postings and a block table of some 20 MB. A Spark task builds
each shard from its pieces, their items' texts and its terms' frequencies among all
pieces, and the shards are one written table. They reach the tasks by broadcast, packed,
in rounds of at most ``BROADCAST_BYTES`` (never less than one shard): the driver and a task hold one round, and a task
unpacks one shard after the other for each block of documents. One round holds some
60,000 pieces (0.55 MB for 512 pieces of random words); a larger benchmark takes a pass over the documents for each
round, whose result is written before the next. No document leaves its row: nothing of
the documents is shuffled.

An item is a pair of ``item_id`` and text, known by a hash of both: ids may
repeat or be null and are only carried to the result.
"""

from __future__ import annotations

import functools
import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.llm.catalog import register, table
from pvlens.llm.common import cut_words, text_blocks, utf8, with_column, written

PIECE, PASSAGE, STRIDE = 64, 128, 64
BLOCK, SHARD_ROWS = 4, 1024
# Neighbouring pieces of one item that go to the same shard.
TOGETHER = 16
# Packed shards that are broadcast at once.
BROADCAST_BYTES = 64 << 20
K1, B = 1.2, 0.75
THRESHOLD = 0.6
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.5, 0.5
# Pairs of passage and term whose bounds are summed at once.
BOUND_ROWS = 1 << 16

_EDGES = re.compile(r"^\W+|\W+$")
# Cut at the white space that ``terms`` cuts at, so that sentences' terms are the text's.
_SENTENCE = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+")
LEAKS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))

_FIELDS = [f.name for f in LEAKS.elementType.fields]
_LEAKS = pa.list_(pa.struct([pa.field(n, pa.int64() if n == "item_id" else pa.float64()) for n in _FIELDS]))
_FOUND = pa.list_(pa.struct([pa.field("key", pa.string()), *_LEAKS.value_type]))  # between rounds
_FOUND_TYPE = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), *LEAKS.elementType.fields]))
_SEARCHED, _BEFORE = "_searched_text", "_found_before"


def term(word: str) -> str:
    """A word as it is indexed: lower case, without marks at its ends."""
    word = word.lower()
    return word if word.isalnum() else _EDGES.sub("", word)


def terms(text: str) -> list[str]:
    return [t for t in map(term, re.split(r"[\x20\x09-\x0D]+", text)) if t]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Terms of an item's question and of its answer: the last sentence is the
    answer; an item of one sentence has none."""
    sentences = [s for s in map(terms, _SENTENCE.split(text)) if s]
    if len(sentences) < 2:
        return (sentences or [[]])[0], []
    return [t for s in sentences[:-1] for t in s], sentences[-1]


def pairs(sequence: list) -> set:
    """Neighbouring pairs; the element itself where there is only one."""
    return set(zip(sequence, sequence[1:])) if len(sequence) != 1 else {(sequence[0],)}


def starts(n: int) -> list[int]:
    """Where the pieces of ``n`` terms begin."""
    return [min(at, max(0, n - PIECE)) for at in range(0, n, PIECE)]


@dataclass
class Index:
    """An inverted index of pieces with block maxima."""

    number: dict[str, int]
    bounds: np.ndarray  # of each term's postings
    pieces: np.ndarray
    impacts: np.ndarray
    greatest: np.ndarray
    in_block: np.ndarray  # term x block
    item: list[tuple[int | None, str]]  # of each piece: id and key
    # pairs of question and answer: of each piece, and of each item by key
    of_piece: list[tuple[set, set]] = field(default_factory=list)
    questions: dict[str, tuple[set, set]] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)


def build(rows: list[tuple[tuple[int | None, str], list[str], int]], texts: dict[str, str],
          frequency: dict[str, int], n_pieces: int, mean_length: float) -> Index:
    """Index of pieces ((item, key), terms, first term's place in the item) and of
    texts by key; ``frequency`` and the two totals are of all pieces."""
    number = {t: i for i, t in enumerate(sorted({t for _, ts, _ in rows for t in ts}))}
    found = []
    for p, (_, ts, _) in enumerate(rows):
        counts: dict[str, int] = {}
        for t in ts:
            counts[t] = counts.get(t, 0) + 1
        weights = {t: np.log(1 + (n_pieces - frequency[t] + 0.5) / (frequency[t] + 0.5))
                   * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ts) / mean_length))
                   for t, n in counts.items()}
        total = sum(weights.values())
        found += [(number[t], p, w / total) for t, w in weights.items()]
    found.sort()
    term_of = np.array([f[0] for f in found], np.int64)
    pieces = np.array([f[1] for f in found], np.int64)
    impacts = np.array([f[2] for f in found])
    in_block = np.zeros((len(number), -(-len(rows) // BLOCK)), np.float32)
    # rounded up, so that a bound stays one
    np.maximum.at(in_block, (term_of, pieces // BLOCK), np.nextafter(impacts.astype(np.float32), np.float32(2)))
    index = Index(number, np.searchsorted(term_of, np.arange(len(number) + 1)), pieces, impacts,
                  in_block.max(1, initial=0).astype(float), in_block, [i for i, _, _ in rows])
    asked: dict[str, int] = {}
    for key, text in texts.items():
        question, answer = question_and_answer(text)
        index.questions[key] = (pairs(question) if question else set(), pairs(answer) if answer else set())
        index.lengths[key] = len(question) + len(answer)
        asked[key] = len(question)
    for (_, key), ts, at in rows:
        cut = max(0, asked[key] - at)
        index.of_piece.append(tuple(pairs(x) if x else set() for x in (ts[:cut], ts[cut:])))
    return index


def block_max_wand(query: list[int], index: Index, threshold: float) -> list[tuple[int, float]]:
    """All pieces whose impacts for the distinct ``query`` terms add up to ``threshold``."""
    least = threshold - 1e-9
    cursors = []  # [piece, term, position, end]
    for t in query:
        start, end = int(index.bounds[t]), int(index.bounds[t + 1])
        if start < end:
            cursors.append([int(index.pieces[start]), t, start, end])
    out = []

    def forward(cursor: list, piece: int) -> None:
        cursor[2] += int(np.searchsorted(index.pieces[cursor[2]:cursor[3]], piece))
        cursor[0] = int(index.pieces[cursor[2]]) if cursor[2] < cursor[3] else -1
    while True:
        cursors = sorted(c for c in cursors if c[0] >= 0)
        bound, last = 0.0, -1
        for last, c in enumerate(cursors):
            bound += index.greatest[c[1]]
            if bound >= least:
                break
        else:
            return out
        pivot = cursors[last][0]
        while last + 1 < len(cursors) and cursors[last + 1][0] == pivot:
            last += 1
        upto = cursors[:last + 1]
        block = pivot // BLOCK
        if sum(float(index.in_block[c[1], block]) for c in upto) >= least:
            if upto[0][0] == pivot:
                score = sum(index.impacts[c[2]] for c in upto)
                if score >= least:
                    out.append((pivot, float(score)))
                target = pivot + 1
            else:
                target = pivot
        else:  # no piece of this block, up to where another term comes in
            target = (block + 1) * BLOCK
            if last + 1 < len(cursors):
                target = min(target, cursors[last + 1][0])
            target = max(target, pivot + 1)
        for c in upto:
            if c[0] < target:
                forward(c, target)


def verified(index: Index, piece: int, present: set) -> list[float] | None:
    """Overlaps of question and answer, of the piece or else of its whole item,
    if the ``present`` pairs confirm a hit."""
    of_piece, of_item = index.of_piece[piece], index.questions[index.item[piece][1]]
    for both in (of_piece, of_item):
        shares = [len(x & present) / len(x) if x else 1.0 for x in both]
        if shares[0] >= QUESTION_OVERLAP and shares[1] >= ANSWER_OVERLAP:
            return shares
        if both is of_piece and shares[0] == 1.0 and len(both[0]) > len(both[1]):
            return shares
    return None


def search(texts: list[bytes], index: Index, threshold: float) -> list[list[dict]]:
    """The verified leaks of each text."""
    words = cut_words(texts)
    vocabulary = [term(w.decode()) for w in words.vocabulary]
    known = np.fromiter((index.number.get(t, -1) if t else -2 for t in vocabulary), np.int64, len(vocabulary))
    ids = known[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    filled = ids != -2
    first = np.append(0, np.cumsum(filled))[words.first]
    ids, codes = ids[filled], words.codes[filled]
    # passages: windows of PASSAGE terms every STRIDE, the last one at the end
    counts = np.diff(first)
    many = np.where(counts == 0, 0, 1 + np.maximum(-(-(counts - PASSAGE) // STRIDE), 0))
    text = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = first[:-1][text] + nth * STRIDE
    stop = np.minimum(start + PASSAGE, first[1:][text])
    size = stop - start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    passage = np.repeat(np.arange(len(start)), size)
    held = ids[at] >= 0
    n_terms = max(1, len(index.number))
    keys = np.unique(passage[held] * n_terms + ids[at][held])
    passage, query = keys // n_terms, keys % n_terms
    edges = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(keys) else np.zeros(0, np.int64)
    edges = np.append(edges, len(keys))
    out: list[list[dict]] = [[] for _ in texts]
    begin = 0
    while begin < len(edges) - 1:
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + BOUND_ROWS, "right")) - 1)
        rows = slice(edges[begin], edges[end])
        sums = np.add.reduceat(index.in_block[query[rows]], edges[begin:end] - edges[begin], axis=0)
        for e in (begin + np.flatnonzero(sums.max(1) >= threshold - 1e-3)).tolist():
            p = int(passage[edges[e]])
            hits = block_max_wand(query[edges[e]:edges[e + 1]].tolist(), index, threshold)
            if hits:
                t = int(text[p])
                within: dict[int, set] = {}
                for piece, score in hits:
                    item, key = index.item[piece]
                    margin = max(PIECE, index.lengths[key])
                    if margin not in within:
                        lo = max(int(first[t]), int(start[p]) - margin)
                        hi = min(int(first[t + 1]), int(stop[p]) + margin)
                        around = [vocabulary[c] for c in codes[lo:hi].tolist()]
                        within[margin] = pairs(around) | {(a,) for a in around}
                    shares = verified(index, piece, within[margin])
                    if shares:
                        out[t].append({"key": key, "item_id": item, "score": score,
                                       "question_overlap": shares[0], "answer_overlap": shares[1]})
        begin = end
    return [_best(found) for found in out]


def _best(found: list[dict]) -> list[dict]:
    """The best hit of each item, by id (null last) and key."""
    best: dict[str, dict] = {}
    for hit in found:
        if hit["key"] not in best or hit["score"] > best[hit["key"]]["score"]:
            best[hit["key"]] = hit
    return sorted(best.values(), key=lambda h: (h["item_id"] is None, h["item_id"] or 0, h["key"]))


def pack(index: Index) -> bytes:
    return zstandard.ZstdCompressor().compress(pickle.dumps(index, protocol=5))


@functools.lru_cache(maxsize=2)
def unpack(packed: bytes) -> Index:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def index_table(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame | None:
    """The shards of the index as a written table (shard, index), one packed index a
    row. Items without words are left out; None if no item has any."""
    def cut(batches):
        for batch in batches:
            rows = [(i, at, ts[at:at + PIECE], k) for i, t, k in zip(
                *(batch.column(c).to_pylist() for c in ("item", "text", "key")))
                for ts in [terms(t)] for at in starts(len(ts))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.list_(pa.string())),
                 pa.array([r[3] for r in rows], pa.string())], names=["item", "at", "terms", "key"])
    items = benchmark.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).where(
        "text is not null").distinct()
    # an id is never empty text, so items without one have keys of their own
    items = items.withColumn("key", F.sha2(F.concat(
        F.coalesce(F.col("item").cast("string"), F.lit("")), F.lit(":"), "text").cast("binary"), 256))
    items = written(items, "items")
    pieces = written(items.mapInArrow(cut, "item long, at int, terms array<string>, key string"), "pieces")
    totals = pieces.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("length")).first()
    n_pieces, mean_length = totals["n"], totals["length"]
    if not n_pieces:
        return None
    shards = -(-n_pieces // max(1, SHARD_ROWS // 2)) if n_pieces > SHARD_ROWS else 1
    frequency = pieces.select(F.explode(F.array_distinct("terms")).alias("name")).groupBy("name").count()
    dealt = pieces.withColumn("shard", F.pmod(
        F.xxhash64("key", F.floor(F.col("at") / (TOGETHER * PIECE))), F.lit(shards)).cast("int"))
    # beside a shard's pieces: its terms with their frequencies, its items with their texts, each once
    counts = dealt.select("shard", F.explode("terms").alias("name")).distinct().join(frequency, "name")
    texts = dealt.select("shard", F.col("key").alias("name")).distinct().join(
        items.select(F.col("key").alias("name"), "text"), "name")
    beside = counts.select(F.col("shard").alias("of"), "name", "count", F.lit(None).cast("string").alias("text")).unionByName(
        texts.select(F.col("shard").alias("of"), "name", F.lit(None).cast("long").alias("count"), "text"))

    def shard_index(group, rows, facts):
        frequencies, held = {}, {}
        for f in facts.to_pylist():
            if f["text"] is None:
                frequencies[f["name"]] = f["count"]
            else:
                held[f["name"]] = f["text"]
        mine = sorted(rows.to_pylist(), key=lambda r: (r["item"] is not None, r["item"] or 0, r["key"], r["at"]))
        index = build([((r["item"], r["key"]), r["terms"], r["at"]) for r in mine],
                      held, frequencies, n_pieces, mean_length)
        return pa.table({"shard": pa.array([group[0].as_py()], pa.int32()),
                         "index": pa.array([pack(index)], pa.binary())})
    built = dealt.groupBy("shard").cogroup(beside.groupBy("of")).applyInArrow(
        shard_index, "shard int, index binary")
    return written(built, "index")


def rounds(shards: DataFrame | None) -> list[list[int]]:
    """Shard numbers dealt to rounds whose packed indexes have ``BROADCAST_BYTES`` together."""
    out: list[list[int]] = []
    room = 0
    if shards is not None:
        for shard, size in shards.select("shard", F.octet_length("index")).orderBy("shard").collect():
            if not out or size > room:
                out.append([])
                room = BROADCAST_BYTES
            out[-1].append(shard)
            room -= size
    return out or [[]]


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks",
               threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``out``: the test items found in the text, best hit of each,
    as array<struct<item_id, score, question_overlap, answer_overlap>>. Texts that
    share an id, or have none, are items of their own, each with its own entry.

    Null, empty and wordless texts and an empty benchmark give empty arrays. A very
    long text is a block of its own, all of whose passages are searched. Of hits with
    one score on an item the first in the text counts. An item of one word is found
    in every text that holds it.
    Other columns pass through; one named like ``out`` is replaced; rows stand alone."""
    shards = index_table(benchmark)
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], F.col(f"`{text}`").alias(_SEARCHED))
    kept = [f for f in rest.schema.fields if f.name != _SEARCHED]
    dealt = rounds(shards)
    for mine in dealt[:-1]:
        shared = _share(shards, mine)
        schema = T.StructType([*kept, T.StructField(_SEARCHED, T.StringType()), T.StructField(_BEFORE, _FOUND_TYPE)])
        rest = written(rest.mapInArrow(_searching(shared, threshold, None), schema), "searched")
        shared.unpersist()  # the table stands without it
    return rest.mapInArrow(_searching(_share(shards, dealt[-1]), threshold, out),
                           T.StructType([*kept, T.StructField(out, LEAKS)]))


def _share(shards: DataFrame | None, mine: list[int]):
    """A broadcast of the packed indexes of one round."""
    if not mine:
        return None
    rows = shards.where(F.col("shard").between(mine[0], mine[-1])).orderBy("shard").collect()
    return shards.sparkSession.sparkContext.broadcast([bytes(r["index"]) for r in rows])


def _searching(shared, threshold: float, out: str | None):
    """Search blocks in the shards of a round, after what earlier rounds found; the
    last round names the result ``out`` and drops what the search needed."""
    def run(batches):
        for block in text_blocks(batches, _SEARCHED):
            texts = utf8(block.column(_SEARCHED))
            found = [[] for _ in texts]
            if _BEFORE in block.schema.names:
                found = block.column(_BEFORE).to_pylist()
                block = block.drop_columns([_BEFORE])
            for packed in shared.value if shared else []:
                for all_hits, hits in zip(found, search(texts, unpack(packed), threshold)):
                    all_hits += hits
            best = [_best(hits) for hits in found]
            if out is None:
                yield with_column(block, _BEFORE, pa.array(best, _FOUND))
            else:
                leaks = [[{n: h[n] for n in _FIELDS} for h in hits] for hits in best]
                yield with_column(block.drop_columns([_SEARCHED]), out, pa.array(leaks, _LEAKS))
    return run


@register("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
