"""Density clusters against all pairs in numpy."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvlens.operators import density
from pvlens.sources import tables as T


def exact(vectors, cut, min_points, least):
    """Clusters by all pairs: mutual reachability, edges up to ``cut``, sizes."""
    v = np.array(vectors, float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.maximum(0, 1 - u @ u.T)
    core = np.sort(d, 1)[:, min_points - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    comp = np.arange(len(v))
    for i in range(len(v)):  # spread the least number over each component
        seen, todo = {i}, [i]
        if comp[i] != i:
            continue
        while todo:
            x = todo.pop()
            for y in np.flatnonzero((reach[x] <= cut) & (np.arange(len(v)) != x)).tolist():
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        for x in seen:
            comp[x] = i
    return [frozenset(np.flatnonzero(comp == c).tolist()) for c in np.unique(comp) if (comp == c).sum() >= least]


def planted(random, copies=0):
    centres = random.normal(size=(6, 32))
    rows = [c + random.normal(size=32) * 0.12 for c in centres for _ in range(30)]
    rows += [random.normal(size=32) for _ in range(60)]
    return [r.tolist() for r in rows] + [rows[0].tolist()] * copies


@pytest.mark.parametrize("copies", [0, 120])
def test_planted_clusters_and_noise(spark, copies):
    """Clusters, noise, and one vector on a third of all rows."""
    vectors = planted(np.random.default_rng(3), copies)
    rows = [(i, v, 7) for i, v in enumerate(vectors)]
    odd = [(1_000, None, 7), (1_001, [0.0] * 32, 7), (1_002, [float("nan")] * 32, 7), (None, vectors[3], 7)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>, cluster int").repartition(4)
    got = {r["id"]: r["cluster"] for r in density.density_clusters(
        df, "id", "v", cut=0.2, tables=8, window=12).collect()}
    assert len(got) == len(rows) + 4 and got[1_000] == got[1_001] == got[1_002] == -1
    assert got[None] == got[3]
    wanted = exact(vectors + [vectors[3]], 0.2, 5, 5)
    wanted = sorted((sorted(i for i in c if i < len(vectors)) for c in wanted), key=min)
    assert len(wanted) == 6
    assert [sorted(i for i in range(len(vectors)) if got[i] == c) for c in range(6)] == wanted
    assert all(got[i] == -1 for i in range(180, 240))


def test_neighbour_recall_on_the_given_vectors(spark, sf):
    """The given vectors have no structure at all, the hardest case for a search."""
    pts = density.points(T.read_table(spark, sf, "embeddings"), "vec_id", "embedding")
    rows = pts.collect()
    units = np.array([r["unit"] for r in rows])
    ids = np.array([r["pid"] for r in rows])
    d = 1 - units @ units.T
    np.fill_diagonal(d, 9)
    found = {r["a"]: [x["b"] for x in r["near"]] for r in density.neighbours(pts).collect()}
    k, hits = 8, 0
    queries = [i for i, r in enumerate(rows) if r["key"] % 20 == 0]
    for i in queries:
        hits += len(set(ids[np.argsort(d[i])[:k]]) & set(found[ids[i]]))
    assert hits / (k * len(queries)) >= 0.9


def test_a_round_looks_at_all_neighbours_of_neighbours(spark):
    """A list after a round: the nearest of those listed and all two steps away, either way."""
    random = np.random.default_rng(5)
    vectors = random.normal(size=(90, 16))
    vectors[:9] = vectors[0] + random.normal(size=(9, 16)) * 0.01
    pts = density.points(spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<float>"), "id", "v")
    rows = {r["pid"]: np.array(r["unit"]) for r in pts.collect()}
    ids = sorted(rows)
    d = {(a, b): max(0.0, 1 - float(np.cumsum(rows[a] * rows[b])[-1])) for a in ids for b in ids}  # summed in order, as there
    # lists of any length, one point (the hub) on each of them, some points without a list
    lists = {a: sorted({(d[a, b], b) for b in [ids[0], *random.choice(ids, random.integers(0, 6)).tolist()] if b != a})
             for a in ids[:80]}
    df = spark.createDataFrame([(a, [tuple(x) for x in near]) for a, near in lists.items() if near],
                               "a long, near array<struct<dist:double,b:long>>")
    got = density._nearest(density._bettered(pts, df, 5).unionByName(density._listed(df)), 5).collect()
    steps = {(a, b) for a, near in lists.items() for _, b in near}
    wanted = {a: {b for x, b in steps if x == a} for a in ids}
    for a, b in steps:
        for c in (c for x, c in steps if x == b and c != a):
            wanted[a].add(c)
            wanted[c].add(a)
    assert {r["a"]: [x["b"] for x in r["near"]] for r in got} == {
        a: [b for _, b in sorted((d[a, b], b) for b in found)[:5]] for a, found in wanted.items() if found}


SEARCH = """
import sys
from pvlens.operators import density
from pvlens.session import get_spark
from pvlens.sources import tables as T
folder, sf = sys.argv[1:]
spark = get_spark("local[4]", "shuffled", 64, **{
    "spark.checkpoint.dir": folder + "/shared", "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + folder + "/events",
    "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
density.neighbours(density.points(T.read_table(spark, sf, "embeddings"), "vec_id", "embedding"))
spark.stop()
"""


def test_vectors_are_not_shuffled_with_each_pair(sf, tmp_path):
    """Bytes that the search shuffles: a vector travels along the lists (24 entries), not with
    each of the hundreds of pairs that a round looks at."""
    (tmp_path / "events").mkdir()
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", SEARCH, str(tmp_path), sf], check=True, timeout=300,
                   env=os.environ | {"PYTHONPATH": repo})
    (log,) = (tmp_path / "events").iterdir()
    ends = [e for e in map(json.loads, log.read_text().splitlines()) if e["Event"] == "SparkListenerTaskEnd"]
    shuffled = sum(e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"] for e in ends)
    assert 0 < shuffled / 500 < 60_000


def test_forest_is_minimal(spark):
    random = np.random.default_rng(9)
    n = 60
    edges = {(int(min(a, b)), int(max(a, b))): float(random.integers(1, 12))
             for a, b in random.integers(0, n, (150, 2)) if a != b}
    forest, comps = density.boruvka(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w double"))
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    wanted = []
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):  # ties by (w, a, b) as there
        if find(a) != find(b):
            root[find(a)] = find(b)
            wanted.append((a, b, w))
    assert sorted(map(tuple, forest.collect())) == sorted(wanted)
    labels = {r["node"]: r["comp"] for r in comps.collect()}
    assert set(labels) == {x for e in edges for x in e}
    assert all((labels[a] == labels[b]) == (find(a) == find(b)) for a in labels for b in labels)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, v array<float>")
    assert density.density_clusters(df, "id", "v").count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<float>")
    assert [r["cluster"] for r in density.density_clusters(one, "id", "v").collect()] == [-1]
