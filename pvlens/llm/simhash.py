"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 23, 23 and 18 bits (the last is
filled with zeros). The binary Golay code [23, 12, 7] is perfect: each 23-bit
word lies within 3 bits of exactly one codeword, whose 12-bit index it decodes
to. A word has the index it decodes to and up to five more, which its 23
neighbours at one bit decode to; a word that differs in at most one bit is such
a neighbour, so its own index is among them.

Pigeonhole, for at most three errors over the three segments: either one
segment has two or more, and of the other two one is clean and one has at most
one error; or every segment has at most one, and one half of the last is clean.
The first case gives, for each ordered pair of segments, the keys (exact bits of
one, every near index of the other). The second gives, for each half of the last
segment, (near indexes of A, index of B, half) and (index of A, near indexes of
B, half): of two words with at most one error in A and in B, the first key of
one equals the second key of the other. All pairs within three bits therefore
share a key of 30 bits or more, and few others do.

The work is done on distinct fingerprints. Members of a key are compared in
blocks of at most ``BLOCK`` by numpy; a larger group is cut into parts and each
pair of parts is a task of its own, so no task grows with a group. A comparison
writes only the links of a spanning forest, never all pairs. Components come
from alternating large-star and small-star rounds over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.llm.catalog import register, table
from pvlens.llm.common import cut_words, schema_with, spaced, text_blocks, utf8, with_column, written

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
# Members of one key that are compared at once (a matrix of BLOCK x BLOCK).
BLOCK = 1024

# The generator polynomial of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text (uint64): a bit is set if it is set in more than half
    of the hashes of the text's shingles."""
    words = cut_words(texts, lower=True, encode=False)
    # words joined by single spaces, so that a shingle is one slice
    joined, begin = spaced(words)
    start, end = begin[:-1], begin[1:] - 1
    counts = np.diff(words.first)
    shingles = np.where(counts == 0, 0, np.maximum(counts - SHINGLE_WORDS + 1, 1))
    ends = np.cumsum(shingles)
    if not len(ends) or not ends[-1]:
        return np.zeros(len(texts), np.uint64)
    at = np.arange(ends[-1]) + np.repeat(words.first[:-1] - (ends - shingles), shingles)
    to = np.minimum(at + SHINGLE_WORDS, np.repeat(words.first[1:], shingles)) - 1
    view, h = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.fromiter((h(view[a:b], SEED) for a, b in zip(start[at].tolist(), end[to].tolist())),
                         np.uint64, len(at))
    out = np.zeros(len(texts), np.uint64)
    held = np.flatnonzero(shingles)
    firsts = (ends - shingles)[held]
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), firsts)
        out[held] |= (2 * ones > shingles[held].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with ``out``: the SimHash as a signed 64-bit integer.

    A-Z are lower-cased; a text of one or two words has one shingle; null and
    empty texts have fingerprint zero, which links like any other. Other columns
    pass through; one named like ``out`` is replaced."""
    def run(batches):
        for block in text_blocks(batches, text):
            values = fingerprints(utf8(block.column(text))).view(np.int64)
            yield with_column(block, out, pa.array(values))
    return docs.mapInArrow(run, schema_with(docs, out, T.LongType()))


def _remainders(count: int, shift: int = 0) -> np.ndarray:
    """Remainders of ``x << shift`` by the generator, for all x below ``count``."""
    x = np.arange(count, dtype=np.int64) << shift
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GOLAY << (bit - 11)), x)
    return x


class Golay:
    """Decodes 23-bit words; the code is systematic, the index is the top 12 bits."""

    def __init__(self):
        self.high, self.low = _remainders(1 << 12, 11), _remainders(1 << 11)
        # the error pattern of at most three bits for each of the 2048 remainders
        bits = [1 << i for i in range(23)]
        patterns = [0] + bits + [a | b for i, a in enumerate(bits) for b in bits[:i]] + [
            a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
        patterns = np.array(patterns, np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        self.error[self.remainder(patterns)] = patterns

    def remainder(self, words: np.ndarray) -> np.ndarray:
        return self.high[words >> 11] ^ self.low[words & 0x7FF]

    def index(self, words: np.ndarray) -> np.ndarray:
        """Index of the codeword next to each word."""
        return (words ^ self.error[self.remainder(words)]) >> 11

    def near(self, words: np.ndarray) -> np.ndarray:
        """Six columns of indexes of each word and its neighbours, repeats as -1."""
        around = words[:, None] ^ np.append(0, 1 << np.arange(23))
        found = np.sort(self.index(around), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found = -np.sort(-found, axis=1)[:, :6]
        return found


def golay_keys(values: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All (row, key) of fingerprints."""
    v = values.view(np.uint64)
    a = (v & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (v >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (v >> np.uint64(46)).astype(np.int64)
    segments = [a, b, c]
    near = [golay.near(s) for s in segments]
    keys, kind = [], 0
    for exact in range(3):
        for other in range(3):
            if exact != other:
                k = kind << 40 | segments[exact][:, None] << 12 | near[other]
                keys.append(np.where(near[other] < 0, -1, k))
                kind += 1
    for half, shift in ((c & 0x1FF, 6), (c >> 9, 7)):
        index_a, index_b = golay.index(a), golay.index(b)
        base = (shift << 40) | (half << 24)
        keys.append(np.where(near[0] < 0, -1, base[:, None] | near[0] << 12 | index_b[:, None]))
        second = (near[1] < 0) | (near[1] == index_b[:, None])
        keys.append(np.where(second, -1, base[:, None] | index_a[:, None] << 12 | near[1]))
    grid = np.concatenate(keys, axis=1)
    rows, columns = np.nonzero(grid >= 0)
    return rows, grid[rows, columns]


def _forest(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of ``left`` under at most ``bits`` differing
    bits, or of the links between ``left`` and ``right``."""
    cross = right is not None
    near = np.bitwise_count(left[:, None] ^ (right if cross else left)[None, :]) <= bits
    nodes = np.concatenate([left, right]) if cross else left
    fresh = np.ones(len(nodes), bool)
    src, dst = [], []
    for first in range(len(left)):
        if not fresh[first]:
            continue
        fresh[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            if not cross:
                found = np.flatnonzero(near[x] & fresh)
            elif x < len(left):
                found = len(left) + np.flatnonzero(near[x] & fresh[len(left):])
            else:
                found = np.flatnonzero(near[:, x - len(left)] & fresh[:len(left)])
            fresh[found] = False
            queue += found.tolist()
            src.append(np.full(len(found), x))
            dst.append(found)
    return nodes[np.concatenate(src)], nodes[np.concatenate(dst)]


def _compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links within groups of (key, part, other_part), whose rows come together
    and in the order of ``side``."""
    rest: np.ndarray | None = None

    def links(rows: np.ndarray, side: np.ndarray, cuts: np.ndarray):
        sizes = np.diff(cuts)
        pairs = cuts[:-1][sizes == 2]  # most groups that matter are pairs
        x, y = rows[pairs], rows[pairs + 1]
        fits = np.bitwise_count(x ^ y) <= bits
        src, dst = [x[fits]], [y[fits]]
        for k in np.flatnonzero(sizes > 2).tolist():
            group, sides = rows[cuts[k]:cuts[k + 1]], side[cuts[k]:cuts[k + 1]]
            split = int(np.searchsorted(sides, 1))
            i, j = _forest(group, None, bits) if split == len(group) or split == 0 else _forest(
                group[:split], group[split:], bits)
            src.append(i)
            dst.append(j)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(src).view(np.int64)), pa.array(np.concatenate(dst).view(np.int64))],
            names=["src", "dst"])
    for batch in batches:
        table_ = np.stack([batch.column(n).to_numpy() for n in ("key", "pair", "side", "fingerprint")])
        if rest is not None:
            table_ = np.concatenate([rest, table_], axis=1)
        n = table_.shape[1]
        if not n:
            continue
        new = np.append(True, (table_[0, 1:] != table_[0, :-1]) | (table_[1, 1:] != table_[1, :-1]))
        cuts = np.flatnonzero(new)
        rest = table_[:, cuts[-1]:]
        yield links(table_[3, :cuts[-1]].view(np.uint64), table_[2, :cuts[-1]], cuts)
    if rest is not None:
        yield links(rest[3].view(np.uint64), rest[2], np.array([0, rest.shape[1]]))


def link_fingerprints(values: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (``src``, ``dst``) that join all distinct ``fingerprint`` values
    within ``bits`` (at most 3) of each other into their components."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys find up to {MAX_BITS} differing bits")

    def keyed(batches):
        golay = Golay()
        for batch in batches:
            v = batch.column("fingerprint").to_numpy()
            for at in range(0, len(v), 4096):
                rows, keys = golay_keys(v[at:at + 4096], golay)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(v[at:at + 4096][rows])], names=["key", "fingerprint"])
    keys = written(values.select("fingerprint").mapInArrow(keyed, "key long, fingerprint long"),
                   "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # only keys with company go on; a large one is dealt into parts
    shared = keys.join(sizes, "key").withColumn(
        "parts", F.ceil(F.col("n") / BLOCK).cast("long")).withColumn(
        "part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")))
    i, j = F.least("part", F.col("other")), F.greatest("part", F.col("other"))
    dealt = shared.select(
        "key", "fingerprint", "part", "parts",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).select(
        "key", "fingerprint", (i * F.col("parts") + j).alias("pair"),
        (F.col("part") > F.col("other")).cast("long").alias("side"))
    placed = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "side")
    return placed.mapInArrow(lambda b: _compare(b, bits), "src long, dst long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (least node reachable) of all nodes of undirected links.

    Large-star and small-star rounds: each node with many neighbours hands them
    to the least one, pre-aggregated, until nothing changes; every round is a
    table in the shared folder. The least neighbours are tables too, so both
    sides of their joins are shuffled for the join and AQE may split the node in
    the middle of a large star."""
    edges = written(links.where("src != dst").distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select("dst", "src"))
        least = written(both.groupBy("src").agg(F.min("dst").alias("m")).select(
            "src", F.least("src", "m").alias("m")), "least")
        # large star: larger neighbours go to the least one
        large = both.where("dst > src").join(least, "src").select(
            F.col("dst").alias("src"), F.col("m").alias("dst")).where("src != dst").distinct()
        large = written(large, "large-star")
        # small star: smaller neighbours and the node itself go to the least one
        low = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = low.where("src != dst")
        best = written(low.groupBy("src").agg(F.min("dst").alias("m")), "best")
        small = (low.join(best, "src").select(F.col("dst").alias("a"), "m")
                 .union(best.select(F.col("src").alias("a"), "m"))
                 .where("a != m").distinct().select(F.col("a").alias("src"), F.col("m").alias("dst")))
        edges = written(small, "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = edges.groupBy("src").agg(F.min("dst").alias("root"))
    return roots.select(F.col("src").alias("node"), "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    bits: int = MAX_BITS) -> DataFrame:
    """``key``, ``fingerprint`` (signed) and ``component`` (least key reachable
    over links of at most ``bits`` differing bits) of every row of ``docs``.

    Null and empty texts share fingerprint zero; a null key is kept and never
    names a component unless its component has no other key; repeated rows are
    repeated; an empty table gives an empty one. A very long text is a block of its
    own, read whole. Further columns are not read."""
    marked = written(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
                     .select("key", "fingerprint"), "fingerprints")
    return classes(marked, bits).withColumnRenamed("key", key)


def classes(marked: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``key``, ``fingerprint`` and ``component`` of rows of ``key`` and ``fingerprint``."""
    distinct = written(marked.groupBy("fingerprint").agg(F.min("key").alias("key")), "distinct")
    roots = components(link_fingerprints(distinct))
    grouped = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "key", F.coalesce("root", "fingerprint").alias("root"))
    # one row for each fingerprint; the least key of each component
    named = written(grouped.groupBy("root").agg(F.min("key").alias("component")), "components")
    of = written(grouped.join(named, "root").select("fingerprint", "component"), "classes")
    return marked.join(of, "fingerprint").select("key", "fingerprint", "component")


@register("op7_simhash")
def op7_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))
