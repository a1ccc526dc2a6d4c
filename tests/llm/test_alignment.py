import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pvlens.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
SHOWN = [b for b in range(256) if b in range(33, 127) or b in range(161, 173) or b in range(174, 256)]
BYTE = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
TEXTS = ["", "a", " ", "  a  b ", "it's <|endoftext|> and </s> <s>", "x" * 5000, "日本語 テキスト" * 30, "a▁b", "é\x00\t\n  ",
         "hello world, hello.", "\U0001F600 ok", "tab\tline\n\nline", "lead ", " trail"]


def tokens(text):
    """Ids and bytes of both sides, nothing where they do not spell the text."""
    if not text:
        return [], []
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in a]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode())
         for i in b for p in [B.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(t for _, t in side) == whole for side in (a, b)) else ([], [])


def aligned(text):
    """Links and groups from the sets of bytes that tokens cover."""
    spans = []
    for side in tokens(text):
        at, out = 0, []
        for i, t in side:
            out.append((i, at, at + len(t)))
            at += len(t)
        spans.append(out)
    a, b = spans
    links, j = [], 0
    for i, x, y in a:
        while j and b[j - 1][2] > x:
            j -= 1
        while j < len(b) and b[j][1] < y:
            if b[j][2] > x:
                links.append((i, b[j][0]))
            j += 1
    ends = sorted({s[2] for s in a} & {s[2] for s in b})
    groups, low = [], 0
    for e in ends:
        groups.append(tuple([i for i, x, y in side if low < y <= e] for side in (a, b)) if len(ends) < 300 else None)
        low = e
    if len(ends) >= 300:  # the same in one walk
        groups, at = [], [0, 0]
        for e in ends:
            group = []
            for s, side in enumerate((a, b)):
                ids = []
                while at[s] < len(side) and side[at[s]][2] <= e:
                    ids.append(side[at[s]][0])
                    at[s] += 1
                group.append(ids)
            groups.append(tuple(group))
    return len(a), len(b), links, groups


def expected(texts):
    found = [aligned(t or "") for t in texts]
    counts = Counter(link for f in found for link in f[2])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for n_a, n_b, links, groups in found:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out, counts


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(query, texts):
    found = query("op13_alignment")
    ids = sorted(texts)
    rows, _ = expected([texts[i] for i in ids])
    assert len(found) == len(ids)
    for i, row in zip(ids, rows):
        assert tuple(found[i][n] for n in NAMES) == row


def block(texts):
    found = alignment.worker_aligner(*PATHS).align(pa.array(texts))
    ends = np.append(0, np.cumsum(found.n_links))
    size = B.get_piece_size()
    return [(a, b, [(p // size, p % size) for p in found.pairs[x:y].tolist()], g.decode())
            for a, b, x, y, g in zip(found.n_a, found.n_b, ends, ends[1:], found.groups)]


def as_text(row):
    n_a, n_b, links, groups = row
    return n_a, n_b, links, ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_odd_texts():
    for _ in range(2):
        assert block(TEXTS) == [as_text(aligned(t)) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab theX\n  '.,1é日\t-<|>▁", max_size=60), min_size=1, max_size=20))
def test_random_texts(texts):
    assert block(texts) == [as_text(aligned(t)) for t in texts]


def test_odd_rows(spark, odd, empty):
    found = alignment.align(odd).collect()
    rows, counts = expected([r["text"] for r in odd.collect()])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[n] for n in NAMES)) for r in found) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, *row) for r, row in zip(odd.collect(), rows))
    pairs = {(r["a_id"], r["b_id"]): r["n"] for r in alignment.pair_counts(odd).collect()}
    assert pairs == dict(counts)
    assert alignment.align(empty).count() == alignment.pair_counts(empty).count() == 0


@pytest.mark.parametrize("copies", [1, 400])
def test_hot_key_long_text_and_parts(spark, odd, copies):
    """One key and text on a third of all rows; a text of several MB; several parts."""
    long = "Hello wörld, 日本 12345 " * (120_000 if copies == 1 else 10)
    rows = [(None, "hot text here.")] * copies + [(i, f"other text {i} of {i * 7}") for i in range(2 * copies)] + [(-1, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r["doc_id"], r["groups_sha256"]): tuple(r[n] for n in NAMES) for r in alignment.align(df).collect()}
    wanted, _ = expected([t for _, t in rows])
    assert {found[i, w[-1]] == w for (i, _), w in zip(rows, wanted)} == {True}
