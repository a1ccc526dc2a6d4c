import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pvlens.llm import bpe, token_counts, token_files
from pvlens.llm.common import cut_before_spaces
from pvlens.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                            mergeable_ranks=bpe.load_ranks(RANKS).of, special_tokens={})
FAST = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", "a", " ", "  ", "   ", "a  b", "a   b", "a \n b", "a\n \nb", "a\n ", "\n", "a" * 9000, "日本語 テキスト" * 50,
       "x" * 50_001, "<|endoftext|> hi <|endoftext|>", "<s> </s> <unk>", "it's we'll 'S", "\t\ta b 　 c",
       "᠎ ᠎a", "é ffi ½ ² ٣", " \x1c \x1d a", "-" * 3000 + " " + "=-" * 2000, "a\x00b ▁ c▁d", " lead", "trail "]
TEXT = st.text("ab c\n  '.,1é日\t-sS▁<|>", max_size=40)


def rows(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_byte_bpe_query(query, texts):
    found = query("op6_byte_bpe")
    assert set(found) == set(texts)
    for i, r in found.items():
        ids = np.array(LIBRARY.encode_ordinary(texts[i]), "<u4")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_byte_bpe_odd_texts():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for _ in range(2):  # new pieces, then kept ones
        assert rows(*encoder.encode(pa.array(ODD))) == [LIBRARY.encode_ordinary(t) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_byte_bpe_random_texts(texts):
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    assert rows(*encoder.encode(pa.array(texts))) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_replay_of_merges_below_their_own_rank():
    """A rank file in which a merge makes a pair of a lower rank, and overlapping pairs."""
    class Small(bpe.Ranks):
        def __init__(self, of):
            self.of = of
            self.byte = np.array([of.get(bytes([b]), 0) for b in range(256)], np.int32)
            pairs = sorted((of[t[:i]] << 32 | of[t[i:]], r) for t, r in of.items()
                           for i in range(1, len(t)) if t[:i] in of and t[i:] in of)
            self.pair_keys = np.array([p[0] for p in pairs], np.int64)
            self.pair_ranks = np.array([p[1] for p in pairs], np.int32)
    ranks = Small({b"a": 0, b"b": 1, b"c": 2, b"aba": 3, b"ab": 4, b"aa": 5, b"aaa": 6, b"bc": 7, b"cab": 8})
    random = np.random.default_rng(0)
    pieces = [bytes(random.choice(list(b"abc"), random.integers(1, 12)).tolist()) for _ in range(500)]
    own = tiktoken.Encoding("small", pat_str=r"[\s\S]+", mergeable_ranks=ranks.of | {
        bytes([b]): 100 + b for b in range(256) if bytes([b]) not in ranks.of}, special_tokens={})
    expected = [own.encode_ordinary(p.decode()) for p in pieces]
    assert [bpe.merge_alone(p, ranks) for p in pieces if p not in ranks.of] == [
        e for p, e in zip(pieces, expected) if p not in ranks.of]
    got = rows(*bpe.replay(pieces, ranks))
    assert [g for p, g in zip(pieces, got) if p not in ranks.of] == [
        e for p, e in zip(pieces, expected) if p not in ranks.of]


def test_cuts_keep_the_text():
    cut = cut_before_spaces(pa.array(ODD))
    joined = ["".join(cut.vocabulary[c] for c in cut.codes[a:b]) for a, b in zip(cut.first[:-1], cut.first[1:])]
    assert joined == ODD


def test_token_counts_query(query, texts):
    found = query("op3_token_counts")
    assert set(found) == set(texts)
    for i, r in found.items():
        n = len(PIECES.encode(texts[i]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[i].encode()), n, n > 4096)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_token_counts_random_texts(texts):
    counter = token_counts.worker_counter(public_tokenizers.path("piece_bpe_32k.model"))
    for some in (texts, ODD):
        got = counter.count(pa.array(some), {"a": len(PIECES.encode("a"))})
        assert got.tolist() == [len(PIECES.encode(t)) for t in some]


def test_token_files_query(query, texts):
    found, start = query("op5_token_files"), 0
    assert set(found) == set(texts)
    for i in sorted(texts):
        ids = np.array([*FAST.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        r = found[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_library_encoder_odd_texts():
    encoder = token_files.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert rows(*encoder.encode(pa.array(ODD))) == [FAST.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_library_encoder_random_texts(texts):
    encoder = token_files.worker_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows(*encoder.encode(pa.array(texts))) == [FAST.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from(["byte", "bit"]))
def test_planes_round_trip(values, kind):
    ids = np.array(values, np.uint32)
    assert token_files.from_planes(token_files.to_planes(ids, kind), len(ids), kind).tolist() == values


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_segments_round_trip(kind):
    ids = np.random.default_rng(0).integers(0, 50_257, 150_000).astype(np.uint32)
    index, data = token_files.pack(ids, kind)
    assert [c["n"] for c in index] == [65_536, 65_536, 18_928]
    assert (token_files.unpack(index, data, kind) == ids).all()
    assert len(data) < 2.1 * len(ids)  # the high planes take no room


def test_odd_rows(spark, odd, empty):
    coded = bpe.decode_documents(bpe.encode_documents(odd, out="score"), "score", "fingerprint")
    assert sorted(coded.columns) == sorted(odd.columns)
    for r in coded.collect():
        assert bytes(r["fingerprint"]) == (r["text"] or "").encode()
    counts = token_counts.count_tokens(odd, out="score").collect()
    assert len(counts) == odd.count()
    assert all(r["score"] == len(PIECES.encode(r["text"] or "")) for r in counts)
    path = scratch_path(spark, "odd")
    token_files.write_token_files(odd, path)
    back = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert len(back) == odd.count() and back[0]["doc_id"] is None
    keys = [r["doc_id"] for r in back[1:]]
    assert keys == sorted(keys)
    assert sorted(bytes(r["ids"]) for r in back) == sorted(
        np.array([*FAST.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        for r in odd.collect())
    assert bpe.encode_documents(empty).count() == token_counts.count_tokens(empty).count() == 0
    path = scratch_path(spark, "empty")
    token_files.write_token_files(empty, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_a_key_on_a_third_of_all_rows(spark, odd):
    """Null with as many texts, one id with the same text: no part gets twice its share."""
    rows = [(None, f"hot text {i}") for i in range(2000)] + [(5, "the same text")] * 2000
    rows += [(i, f"cold text {i}") for i in range(10, 2010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = scratch_path(spark, "hot")
    token_files.write_token_files(docs, path)
    sizes = [len(r["doc_ids"]) for r in spark.read.parquet(path).groupBy("part").agg(
        F.flatten(F.collect_list("doc_ids")).alias("doc_ids")).collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 2 * 6000 / 8
    back = token_files.read_token_files(spark, path).orderBy("start").collect()
    keys = [r["doc_id"] for r in back]
    assert keys == [None] * 2000 + [5] * 2000 + list(range(10, 2010))
    assert sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in back) == sorted(
        (i or 0, np.array([*FAST.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows)


def test_texts_of_several_megabytes(spark, odd):
    texts = ["word, and " * 300_000, "é" * 1_500_000, "0123456789abcdef" * 100_000 + "\n  x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(docs, decoded="back").collect():
        assert bytes(r["back"]).decode() == texts[r["doc_id"]]
        if r["doc_id"] == 0:  # the library itself is slow on the others
            assert np.frombuffer(r["ids"], "<u4").tolist() == LIBRARY.encode_ordinary(texts[0])
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs.where("doc_id = 0")).collect()}
    assert counts == {0: len(PIECES.encode(texts[0]))}
    encoder = token_files.worker_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows(*encoder.encode(pa.array(texts[:1]))) == [FAST.encode(texts[0], add_special_tokens=False).ids]


def test_any_other_pattern_matches_texts_whole():
    pattern = r"[^ ]+| +"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(RANKS).of, special_tokens={})
    encoder = bpe.Encoder(RANKS, pattern)
    for _ in range(2):
        assert rows(*encoder.encode(pa.array(ODD[:8]))) == [own.encode_ordinary(t) for t in ODD[:8]]


def test_a_worker_gets_few_rows_at_once(spark, odd, monkeypatch):
    from pvlens.llm import token_files as tf
    from pvlens.session import scratch_path
    real, most, name = tf._segments, tf.ROWS_AT_ONCE, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def watched(batches, *rest):
        def small():
            for b in batches:
                assert b.num_rows <= most
                yield b
        return real(small(), *rest)
    monkeypatch.setattr(tf, "_segments", watched)
    before, path = spark.conf.get(name), scratch_path(spark, "few-rows")
    tf.write_token_files(spark.range(0, 40_000, 1, 4).selectExpr("id doc_id", "concat('text ', id) text"), path)
    assert spark.conf.get(name) == before
    assert tf.read_token_files(spark, path).count() == 40_000
