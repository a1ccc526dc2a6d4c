import re

import numpy as np
import xxhash
import pytest

from pvlens.llm import simhash as sh


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, bits=3):
    """Least index reachable over links of at most ``bits`` bits."""
    values = np.array(values, np.uint64)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= bits).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_query(query, texts):
    rows, ids = query("op7_simhash"), sorted(texts)
    expected = [fingerprint(texts[i]) for i in ids]
    assert [int(rows[i]["fingerprint"], 16) for i in ids] == expected
    assert all(len(rows[i]["fingerprint"]) == 16 for i in ids)
    assert [rows[i]["component_id"] for i in ids] == [ids[r] for r in linked(expected)]


def test_golay_code():
    golay = sh.Golay()
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    codeword = words ^ golay.error[golay.remainder(words)]
    assert (golay.remainder(codeword) == 0).all() and (np.bitwise_count(words ^ codeword) <= 3).all()
    assert sorted(set(np.bitwise_count(golay.error).tolist())) == [0, 1, 2, 3]
    near = golay.near(words)
    assert set((near >= 0).sum(1).tolist()) <= {1, 6}


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_every_near_pair_shares_a_key(bits):
    random, golay = np.random.default_rng(bits), sh.Golay()
    left = random.integers(0, 1 << 64, 4000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in random.choice(64, bits, replace=False)) for _ in left], np.uint64)
    keys = [set(zip(*map(np.ndarray.tolist, sh.golay_keys(v.view(np.int64), golay)))) for v in (left, left ^ flips)]
    assert len({row for row, _ in keys[0] & keys[1]}) == len(left)


def test_links_of_many_near_values(spark, odd, monkeypatch):
    """A large group within few bits, in blocks far smaller than the group."""
    random = np.random.default_rng(3)
    centre = int(random.integers(1 << 62))
    values = {centre}
    while len(values) < 250:
        values.add(centre ^ sum(1 << int(b) for b in random.choice(64, random.integers(1, 4), replace=False)))
    values |= {int(v) for v in random.integers(0, 1 << 62, 100)} | {0, 7}
    values = sorted(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "key long, fingerprint long")
    monkeypatch.setattr(sh, "BLOCK", 16)
    rows = {r["key"]: r["component"] for r in sh.classes(frame).collect()}
    assert [rows[i] for i in range(len(values))] == linked(values)
    links = sh.link_fingerprints(frame).collect()
    assert all(((r["src"] ^ r["dst"]) & (2**64 - 1)).bit_count() <= 3 for r in links)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (201, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in sh.components(
        spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[200] == got[201] == 100


def test_odd_rows(odd, empty):
    rows = sh.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and sh.near_duplicates(empty).count() == 0
    blank = [r for r in rows if r["fingerprint"] == 0]
    assert len(blank) >= 4 and {r["component"] for r in blank} == {0}
    with pytest.raises(ValueError):
        sh.link_fingerprints(odd, 4)
