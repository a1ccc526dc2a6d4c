"""Long repeats across documents by recompression.

Rounds of recompression name the symbols of a text, words at first: a run of one
symbol becomes a symbol, then every pair of a left symbol and a right one. Names
are 64-bit hashes of what they are made of and sides are bits of names, so they
are the same in all documents without any exchange, and equal substrings get the
same symbols but for a few at their ends, which may join something outside.

A window of ``WINDOW`` words keeps, in each round, the symbols that do not depend
on what surrounds it: it gives up the run at either end, then a right symbol at
its left end and a left symbol at its right end. Its *core* is the longest (then
least) of the symbols it keeps in the last round that leaves any. Equal windows
have equal cores at equal places, whatever their documents.

Neighbouring windows mostly share a core. Such a group is an *anchor*: the name
of the core and a hash of all the words that its windows cover, its span. Spark
joins the anchors of all documents by name:

* a name that only one document has reveals no repeat;
* of anchors with the same span all but the least document's are covered;
* where a name has several spans, windows are compared one by one, but only
  those of the least document of each span: any other document's window is
  also in that one.

The first two verify nearly all of a repeat; the third verifies its ends. Each
step pre-aggregates before it shuffles, and sends eight-byte names, not words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvlens.llm.catalog import register, table
from pvlens.llm.common import Words, cut_words, hashed, mixed, spaced, text_blocks, utf8, windows, written

WINDOW, ROUNDS, SEED = 50, 4, 3
FACTOR = np.uint64(0x9E3779B97F4A7C15)
LAST = (1 << 63) - 1


def _least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the least key in each range, the leftmost of several."""
    out, at = np.zeros(len(lo), np.int64), np.arange(len(key))
    power, width = np.int64(np.floor(np.log2(np.maximum(hi - lo, 1)))), 1
    for k in range(int(power.max(initial=0)) + 1):
        mine = power == k
        a, b = at[lo[mine]], at[hi[mine] - width]
        out[mine] = np.where(key[b] < key[a], b, a)
        a, b = at[:-width], at[width:]
        at = np.where(key[b] < key[a], b, a)
        width *= 2
    return out


def cores(words: Words, size: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """The first word, text, core name and core place of every window of the
    texts (a place tells apart symbols of one block)."""
    first_word, text = windows(words.codes, words.first, size)
    name = hashed(words.vocabulary, SEED)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    length = np.ones(len(name), np.int64)
    core = np.zeros(len(first_word), np.uint64)
    place = np.zeros(len(first_word), np.int64)
    live = np.arange(len(first_word))
    lo, hi, base = first_word.copy(), first_word + size, 0

    def choose(which: np.ndarray) -> None:
        if len(which):
            key = (np.uint64(63) - np.minimum(length, 63).astype(np.uint64)) << np.uint64(58) | (
                name >> np.uint64(6))
            at = _least(key, lo[which], hi[which])
            core[live[which]], place[live[which]] = name[at], base + at
    for turn in range(rounds):
        if not len(live):
            break
        # runs
        head = np.append(True, (name[1:] != name[:-1]) | (of[1:] != of[:-1]))
        start = np.flatnonzero(head)
        run = np.cumsum(head) - 1
        times = np.diff(np.append(start, len(name)))
        run_name, run_of = name[start], of[start]
        run_length = np.add.reduceat(length, start)
        many = times > 1
        run_name[many] = mixed(run_name[many] * FACTOR + times[many].astype(np.uint64))
        new_lo, new_hi = run[lo] + 1, run[hi - 1]
        # pairs of a left and a right symbol
        right = (mixed(run_name + np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
        pair = np.append(~right[:-1] & right[1:] & (run_of[1:] == run_of[:-1]), False)
        head = ~np.append(False, pair[:-1])
        ok = new_lo < new_hi
        new_lo[ok] += right[new_lo[ok]]
        ok &= new_lo < new_hi
        new_hi[ok] -= ~right[new_hi[ok] - 1]
        ok &= new_lo < new_hi
        choose(np.flatnonzero(~ok))
        live, new_lo, new_hi = live[ok], new_lo[ok], new_hi[ok]
        base += len(name)
        to = np.cumsum(head) - 1
        lo, hi = to[new_lo], to[new_hi - 1] + 1
        follower = np.append(run_name[1:], np.uint64(0))
        joined = mixed(run_name * FACTOR + mixed(follower + np.uint64(1)))
        name = np.where(pair, joined, run_name)[head]
        length = np.where(pair, run_length + np.append(run_length[1:], 0), run_length)[head]
        of = run_of[head]
    choose(np.arange(len(live)))
    return first_word, text, core, place


def _slices(joined: np.ndarray, begin: np.ndarray, start: np.ndarray, stop: np.ndarray, digest) -> list:
    view = memoryview(joined.tobytes())
    return [digest(view[a:b]) for a, b in zip(begin[start].tolist(), (begin[stop] - 1).tolist())]


def _anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        words = cut_words(utf8(block.column("text")))
        first, text, core, place = cores(words, size)
        new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))[:len(first)]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(first)))
        joined, begin = spaced(words)
        span = np.array(_slices(joined, begin, first[start], first[start] + count + size - 1,
                                xxhash.xxh3_64_intdigest), np.uint64)
        rows = pa.array(text[start])
        yield pa.RecordBatch.from_arrays(
            [pa.array(core[start].view(np.int64)), pa.array(span.view(np.int64)),
             block.column("ord").take(rows), block.column("hash").take(rows),
             pa.array((first[start] - words.first[text[start]]).astype(np.int32)),
             pa.array(count.astype(np.int32))],
            names=["name", "span", "ord", "hash", "start", "count"])


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows that ``ranges`` of each text name."""
    for block in text_blocks(batches):
        words = cut_words(utf8(block.column("text")), encode=False)
        joined, begin = spaced(words)
        row, start = [], []
        for i, ranges in enumerate(block.column("ranges").to_pylist()):
            for r in ranges:
                start.append(np.arange(r["start"], r["start"] + r["count"]))
                row.append(np.full(r["count"], i))
        row, start = np.concatenate([*row, []]).astype(np.int64), np.concatenate([*start, []]).astype(np.int64)
        first = words.first[row] + start
        found = _slices(joined, begin, first, first + size, xxhash.xxh3_128_digest)
        halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        rows = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
             block.column("ord").take(rows), block.column("hash").take(rows),
             pa.array(start.astype(np.int32))],
            names=["h1", "h2", "ord", "hash", "start"])


def _keep(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        words = cut_words(utf8(block.column("text")), encode=False)
        joined, begin = spaced(words)
        n = np.diff(words.first)
        edge = np.zeros(len(begin), np.int64)
        for i, ranges in enumerate(block.column("ranges").to_pylist()):
            for r in ranges or []:
                edge[words.first[i] + r["start"]] += 1
                edge[words.first[i] + r["start"] + r["count"] + size - 1] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        removed = np.append(0, np.cumsum(gone))[words.first]
        kept = joined[np.repeat(~gone, np.diff(begin))]
        sizes = np.append(0, np.cumsum(np.where(gone, 0, np.diff(begin))))[words.first]
        texts = [kept[a:max(a, b - 1)].tobytes() for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [block.column("key"), pa.array(n), pa.array(np.diff(removed)),
             pa.array(texts, pa.binary()).cast(pa.string())],
            names=["key", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   size: int = WINDOW) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept`` of every row of ``docs``:
    words in a window of ``size`` words that also starts in a row with a smaller
    ``key`` are removed, the rest is joined by single spaces. Windows are those
    of the input, not of what is left.

    Null, empty and short texts keep their words. Equal rows and rows with equal
    keys do not remove each other. A null key counts as the greatest. An empty
    table gives an empty one. A very long text is a block of its own, read whole.
    Further columns are not read."""
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("ord"),
        F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    place = "ord long, hash long, start int, count int"
    anchors = written(rows.select("ord", "hash", "text").mapInArrow(
        lambda b: _anchors(b, size), f"name long, span long, {place}"), "anchors")
    # what is joined back is a table of its own: both sides of the join are then
    # shuffled for it, and AQE may split a name that a third of all anchors have
    names = written(anchors.groupBy("name").agg(
        F.min("ord").alias("least"), F.max("ord").alias("greatest"),
        (F.min("span") == F.max("span")).alias("one_span"))
        .where("least < greatest").select("name", "least", "one_span"), "shared-names")
    shared = written(anchors.join(names, "name"), "shared-anchors")
    spans = written(shared.where("not one_span").groupBy("name", "span").agg(
        F.min("ord").alias("first")), "spans")
    several = written(shared.where("not one_span").drop("least", "one_span").join(
        spans, ["name", "span"]).drop("name", "span"), "span-anchors")
    open_ = several.where("first = ord").groupBy("ord", "hash").agg(
        F.collect_set(F.struct("start", "count")).alias("ranges"))
    found = written(rows.select("ord", "hash", "text").join(open_, ["ord", "hash"]).mapInArrow(
        lambda b: _windows(b, size), "h1 long, h2 long, ord long, hash long, start int"), "windows")
    least = written(found.groupBy("h1", "h2").agg(
        F.min("ord").alias("first"), F.max("ord").alias("greatest"))
        .where("first < greatest").select("h1", "h2", "first"), "repeated-windows")
    repeated = found.join(least, ["h1", "h2"])
    columns = ["ord", "hash", "start", "count"]
    covered = (shared.where("one_span and least < ord").select(*columns)
               .union(several.where("first < ord").select(*columns))
               .union(repeated.where("first < ord").select("ord", "hash", "start", F.lit(1))))
    ranges = written(covered.groupBy("ord", "hash").agg(
        F.collect_set(F.struct("start", "count")).alias("ranges")), "covered")
    kind = dict(docs.dtypes)[key]
    return rows.join(ranges, ["ord", "hash"], "left").select("key", "text", "ranges").mapInArrow(
        lambda b: _keep(b, size), f"key {kind}, n_words long, n_removed long, kept string").withColumnRenamed(
        "key", key)


@register("op9_repeats")
def op9_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
