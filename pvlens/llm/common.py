"""What several operators share: tables in the shared folder, and the words of
a block of texts as numpy arrays.

A *word* is a run of bytes other than space and the controls 9-13, so a text's
words are cut in its UTF-8 bytes; a null text is an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pvlens.session import written  # noqa: F401  (general helper that the operators share)

# Text bytes that a Python task looks at together.
BLOCK_BYTES = 4 << 20
_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
                block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one hold about ``block_bytes``
    (a longer text is a block of its own)."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        if batch.num_rows:
            lengths = pc.binary_length(batch.column(column))
            sizes = lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        row = 0
        while row < batch.num_rows:
            before = ends[row] - sizes[row]
            stop = max(row + 1, int(np.searchsorted(ends, before + block_bytes, "right")))
            yield batch.slice(row, stop - row)
            row = stop
            give_back()


def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # a C library without it
        return None


_TRIM = _trim()


def give_back() -> None:
    """Return freed memory to the system. Python workers live on after a task and
    would keep their largest block's worth beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, null as empty."""
    return column.fill_null("").cast(pa.binary()).to_pylist()


@dataclass
class Words:
    """Words of many texts: word ``w`` is ``vocabulary[codes[w]]``; text ``t``
    owns words ``first[t]`` up to ``first[t + 1]``; ``data`` holds the words'
    bytes one after the other, word ``w`` at ``bounds[w]:bounds[w + 1]``."""

    codes: np.ndarray
    vocabulary: list[bytes]
    first: np.ndarray
    data: np.ndarray
    bounds: np.ndarray


def cut_words(texts: list[bytes], lower: bool = False, encode: bool = True) -> Words:
    """Words of ``texts``; ``lower`` lower-cases A-Z first. ``encode=False``
    leaves the vocabulary out."""
    joined = b"\n".join(texts).translate(_SPACES)
    if lower:
        joined = joined.lower()  # bytes: A-Z only
    raw = np.frombuffer(joined, np.uint8)
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(raw, 32, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=bounds[1:])
    data = raw[inside[1:-1]]
    text_start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=text_start[1:])
    first = np.searchsorted(start, text_start)
    codes, vocabulary = np.zeros(0, np.int32), []
    if encode and len(start):
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        found = words.dictionary_encode()
        codes = found.indices.to_numpy()
        vocabulary = found.dictionary.to_pylist()
    return Words(codes, vocabulary, first, data, bounds)


def spaced(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words with a space after each, and where each word begins
    (word ``w`` is ``out[begin[w]:begin[w + 1] - 1]``)."""
    n = len(words.bounds) - 1
    out = np.full(len(words.data) + n, 32, np.uint8)
    lengths = np.diff(words.bounds)
    out[np.arange(len(words.data)) + np.repeat(np.arange(n), lengths)] = words.data
    return out, words.bounds + np.arange(n + 1)


def hashed(values: list[bytes], seed: int) -> np.ndarray:
    """XXH64 of each value."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(v, seed) for v in values), np.uint64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``size`` neighbours within one text, and the text of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    start = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    return start + first[:-1][text], text


# White space as byte-level pre-tokenizers know it (for RE2, whose own class is smaller).
_WHITE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# A space that stands inside a run of white space, or ends one at the end of a text.
_INSIDE_RUN = _WHITE + " (?:" + _WHITE + r"|\z)"
# Letters below U+0250, which every version of Unicode takes for letters, and marks
# that form one pre-token with their like (the apostrophe may begin a contraction).
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-&(-/:-@\[-`{-~]*"
PLAIN = f"^ ?{_LETTERS}\\z"
_LINES = (f"^(?P<a> ?{_LETTERS})(?P<b>{_MARKS})(?:(?P<c>\n)(?P<d>{_LETTERS})(?P<e>{_MARKS})"
          f"(?:(?P<f>\n)(?P<g>{_LETTERS})(?P<h>{_MARKS}))?)?\\z")


@dataclass
class Pieces:
    """Texts cut before single spaces: piece ``p`` is ``pieces[codes[p]]`` and text
    ``t`` owns pieces ``first[t]`` up to ``first[t + 1]``."""

    codes: np.ndarray
    pieces: pa.Array
    first: np.ndarray

    @property
    def vocabulary(self) -> list[str]:
        return self.pieces.to_pylist()


def whole_texts(texts: pa.Array) -> Pieces:
    """Texts as one piece each."""
    found = texts.dictionary_encode()
    return Pieces(found.indices.to_numpy().astype(np.int64), found.dictionary, np.arange(len(texts) + 1))


def cut_before_spaces(texts: pa.Array) -> Pieces:
    """Cut texts where byte-level pre-tokenizers always cut as well.

    Their patterns take a run of white space but for its last character as one
    match, or the whole run at the end of a text, so they cut before a space
    unless that space stands inside such a run. A text with a space of that kind
    stays one piece. Every other piece but the first begins with its space;
    pieces are matched separately with the same result as the text."""
    odd = pc.match_substring_regex(texts, _INSIDE_RUN)
    any_odd = pc.any(odd).as_py()
    split = pc.split_pattern(pc.if_else(odd, "", texts) if any_odd else texts, " ")
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), out=first[1:])
    parts = split.flatten().dictionary_encode()
    codes, words = parts.indices.to_numpy().astype(np.int64), parts.dictionary
    # the first piece of a text has no space before it
    heads, of = np.unique(codes[first[:-1]], return_inverse=True)
    codes[first[:-1]] = len(words) + of
    pieces = [pc.binary_join_element_wise(" ", words, ""), words.take(pa.array(heads))]
    if any_odd:
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        codes[first[at]] = len(words) + len(heads) + np.arange(len(at))
        pieces.append(texts.take(pa.array(at)))
    return Pieces(codes, pa.concat_arrays(pieces), first)


def gathered(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``values[bounds[c]:bounds[c + 1]]`` for all ``codes``, one after
    the other, and the bounds of each in the result."""
    lengths = (bounds[1:] - bounds[:-1])[codes]
    out = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1][codes] - out[:-1], lengths)
    return values[at], out


def sub_pieces(piece: str) -> list[str]:
    """Cut a piece further where byte-level pre-tokenizers cut as well: round a
    line feed between two characters that are no white space, and before a comma
    or full stop that ends a line behind a letter or digit."""
    out: list[str] = []
    for i, line in enumerate(piece.split("\n")):
        if i:
            out.append("\n")
        if not line or line[-1].isspace() or (i and line[0].isspace()):
            return [piece] if i or "\n" in piece else [line]
        if line[-1] in ",." and len(line) > 1 and (line[-2].isalpha() or "0" <= line[-2] <= "9"):
            out += [line[:-1], line[-1]]
        else:
            out.append(line)
    return out


def cut_pieces(pieces: pa.Array) -> Pieces:
    """Cut pieces further. Most are letters alone, or letters and marks in up to
    three lines; those are told apart and cut by Arrow, the rest by :func:`sub_pieces`."""
    plain = pc.match_substring_regex(pieces, PLAIN)
    others = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    lined = pc.extract_regex(pieces.take(pa.array(others)), _LINES)
    found = lined.is_valid().to_numpy(zero_copy_only=False)
    columns = lined.filter(pa.array(found)).flatten()
    n = int(found.sum())
    # part j of piece i at i * 8 + j, empty parts left out
    parts = pa.concat_arrays(columns) if n else pa.array([], pa.string())
    order = np.arange(n * len(columns)).reshape(len(columns), n).T.ravel()
    held = (pc.binary_length(parts).to_numpy(zero_copy_only=False)[order] > 0) if n else order > 0
    rest = [sub_pieces(p) for p in pieces.take(pa.array(others[~found])).to_pylist()]
    alike = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
    coded = pa.concat_arrays([pieces.take(pa.array(alike)), parts.take(pa.array(order[held])),
                              pa.array([s for r in rest for s in r], pa.string())]).dictionary_encode()
    counts = np.concatenate([np.ones(len(alike), np.int64), held.reshape(-1, len(columns)).sum(1),
                             np.fromiter(map(len, rest), np.int64, len(rest))])
    bounds = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    back = np.empty(len(pieces), np.int64)
    back[np.concatenate([alike, others[found], others[~found]])] = np.arange(len(pieces))
    codes, first = gathered(coded.indices.to_numpy().astype(np.int64), bounds, back)
    return Pieces(codes, coded.dictionary, first)


def back_in_order(values: np.ndarray, counts: np.ndarray, chosen: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of ``counts`` values, first of all ``chosen`` rows and then of the
    others, in the order of the rows, and the bounds of each."""
    chosen = chosen.to_numpy(zero_copy_only=False)
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    place = np.where(chosen, np.cumsum(chosen) - 1, chosen.sum() + np.cumsum(~chosen) - 1)
    return gathered(values, bounds, place)


def raw_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after the other, and the bounds of each."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    offsets = offsets.astype(np.int64)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


# Byte-level vocabularies write a byte as the character of its number if that is
# printable, and the others, in order, as the characters from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARACTERS = np.arange(256, dtype="<u2")
BYTE_CHARACTERS[[b for b in range(256) if b not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))


def byte_level(pieces: pa.Array) -> list[str]:
    """Pieces as byte-level vocabularies write them: one character for each byte."""
    raw, bounds = raw_bytes(pieces)
    shown = BYTE_CHARACTERS[raw].tobytes().decode("utf-16-le")
    ends = bounds.tolist()
    return [shown[a:b] for a, b in zip(ends, ends[1:])]


class PieceTable:
    """Encodes texts piece by piece. Pieces that were met have a slot: their ids
    stand in ``ids[bounds[slot]:bounds[slot + 1]]``. Slots are kept between blocks in
    two generations: with more than ``limit`` the younger becomes the elder, and
    pieces that are met again come back from there. ``encode_new`` gives the ids of
    an array of pieces, one after the other, and the bounds of each. ``cut`` cuts
    texts into pieces, and ``cut_more`` new pieces into the ones that are kept."""

    def __init__(self, limit: int, encode_new, cut=cut_before_spaces, cut_more=cut_pieces):
        self.limit, self.encode_new, self.cut, self.cut_more = limit, encode_new, cut, cut_more
        self.elder: tuple[dict[str, int], np.ndarray, np.ndarray] = ({}, np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self._young()

    def _young(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, keys: list[str], ids: np.ndarray, bounds: np.ndarray) -> None:
        at = len(self.bounds) - 1
        self.slot.update(zip(keys, range(at, at + len(keys))))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the bounds of each."""
        if len(self.slot) > self.limit or len(self.ids) > 8 * self.limit:
            self.elder = (self.slot, self.ids, self.bounds)
            self._young()
        cut = self.cut(texts)
        more = self.cut_more(cut.pieces)
        keys = byte_level(more.pieces)
        known, ids, bounds = self.elder
        again = [k for k in keys if k not in self.slot and k in known] if known else []
        if again:
            self._add(again, *gathered(ids, bounds, np.fromiter(map(known.__getitem__, again), np.int64, len(again))))
        slots = np.fromiter((self.slot.get(k, -1) for k in keys), np.int64, len(keys))
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            slots[fresh] = len(self.bounds) - 1 + np.arange(len(fresh))
            self._add([keys[i] for i in fresh.tolist()], *self.encode_new(more.pieces.take(pa.array(fresh))))
        # ids of the kept pieces, of the pieces, of the texts
        at, ends = gathered(slots[more.codes], more.first, cut.codes)
        ids, bounds = gathered(self.ids, self.bounds, at)
        return ids, bounds[ends[cut.first]]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with ``values`` as its last column; one of that name is replaced."""
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in keep] + [values],
        names=[batch.schema.names[i] for i in keep] + [name])


def schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])
