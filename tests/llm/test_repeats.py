import hashlib
import re

import numpy as np
import pytest

from pvlens.llm.common import cut_words
from pvlens.llm.repeats import cores, remove_repeats


def brute(rows, size):
    cut = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first = {}
    for k, words in cut:
        for i in range(len(words) - size + 1):
            window = tuple(words[i:i + size])
            first[window] = min(first.get(window, k), k)
    out = []
    for k, words in cut:
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if first[tuple(words[i:i + size])] < k:
                gone[i:i + size] = [True] * size
        out.append((k, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out)


def test_query(query, texts):
    rows = query("op9_repeats")
    expected = brute(list(texts.items()), 50)
    assert {i: tuple(r) for i, r in rows.items()} == {
        k: (k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in expected}


@pytest.mark.parametrize("seed, size", [(0, 5), (1, 8), (2, 20), (3, 2)])
def test_texts_of_shared_parts(spark, odd, seed, size):
    random = np.random.default_rng(seed)
    base = [" ".join(random.choice(list("abc"), 60)) for _ in range(4)] + ["x " * 50, "a b " * 40]
    rows = []
    for k in range(100):
        parts = []
        for _ in range(random.integers(0, 5)):
            words = base[random.integers(len(base))].split()
            a = random.integers(0, len(words))
            parts += words[a:random.integers(a, len(words) + 1)] + list(random.choice(list("abcdxy"), random.integers(0, 6)))
        rows.append((k, " \t".join(parts)))
    rows += [(500, None), (501, ""), (502, rows[7][1])]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, size)


def test_equal_windows_have_equal_cores():
    random = np.random.default_rng(5)
    shared = random.choice(list("abcdefgh"), 200).tolist()
    texts = [" ".join(random.choice(list("abcdefgh"), n).tolist() + shared + random.choice(list("abcdefgh"), m).tolist())
             for n, m in ((0, 30), (17, 5), (90, 90))]
    words = cut_words([t.encode() for t in texts])
    first, text, core, place = cores(words, 50)
    names = []
    for t, skip in enumerate((0, 17, 90)):
        mine = np.flatnonzero(text == t)[skip:skip + 151]
        names.append(core[mine].tolist())
    assert names[0] == names[1] == names[2]
    assert len(set(names[0])) < 60  # neighbours share a core


def test_odd_rows(odd, empty):
    got = remove_repeats(odd).collect()
    assert len(got) == odd.count() and remove_repeats(empty).count() == 0
    assert all(r["n_words"] == 0 and r["kept"] == "" for r in got if r["n_words"] == 0)
    assert sum(r["n_removed"] for r in got) == 0  # nothing of a smaller id recurs
    again = remove_repeats(odd.union(odd.selectExpr("doc_id + 100", "text", "fingerprint", "score"))).collect()
    assert {r["n_removed"] for r in again if (r["doc_id"] or 0) > 99 and r["n_words"] >= 50} == {
        r["n_words"] for r in got if r["doc_id"] is not None and r["n_words"] >= 50}
