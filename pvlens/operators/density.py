"""Density clusters of vectors with noise (ML2).

1. Equal vectors become one point with a weight, so a vector that is copied many
   times costs one point.
2. *Neighbours* by cosine: in each of ``TABLES`` tables points are ordered by the
   signs of sparse random projections; a point meets its ``WINDOW`` followers in
   that order, so a crowded place gives no more pairs than a sparse one. Lists of the
   nearest found are improved by rounds that look at the neighbours' neighbours. Vectors
   travel along the lists, not with each pair: the points that list ``b`` meet those that
   ``b`` lists where ``b`` is, and only a pair that betters a list leaves from there.
3. *Mutual reachability*: a point's core distance reaches ``min_points`` rows (its own
   included); an edge weighs the greatest of its length and both core distances.
4. *Minimum spanning forest* by Borůvka rounds over tables: every component takes its
   least edge, components are merged by pointer jumping, edges inside one go.
5. The forest is *cut* at a distance: components of at least ``least`` rows are
   clusters, the rest is noise, -1.

The order of 2 is dealt in even ranges; aggregates combine on the map side; no group
is collected but a point's list, whose length is a parameter. Rows whose vector is
null, zero or not finite are noise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pvlens.operators.ordering import RANGE, find_ranges, with_row_index
from pvlens.session import written

TABLES, WINDOW, BITS, TERMS = 16, 24, 24, 8
NEAREST, ROUNDS = 24, 2
NOISE = -1


def _norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def distance(u: Column, v: Column) -> Column:
    """Cosine distance of unit vectors."""
    dot = F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), 1 - dot)


def _unit(vec: Column, norm: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double") / norm)


def points(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Distinct vectors: ``pid``, the vector, its ``norm`` and ``unit`` vector, the number
    ``n`` of its rows and their least key."""
    norm = _norm(F.col("vec"))
    rows = df.select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    found = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).select(
        "vec", "n", "key", norm.alias("norm")).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return written(found.select(
        F.monotonically_increasing_id().alias("pid"), "vec", "norm", "n", "key",
        _unit(F.col("vec"), F.col("norm")).alias("unit")), "points")


def _code(unit: Column, table: Column) -> Column:
    """Signs of ``BITS`` projections, each on ``TERMS`` hashed coordinates."""
    def side(bit: Column) -> Column:
        def term(total: Column, m: Column) -> Column:
            h = F.xxhash64(table, bit, m)
            sign = 1 - 2 * F.pmod(F.shiftright(h, 40), F.lit(2))
            return total + F.get(unit, F.pmod(h, F.size(unit)).cast("int")) * sign
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.lit(0.0), term)
    return F.aggregate(F.sequence(F.lit(1), F.lit(BITS)), F.lit(0).cast("long"),
                       lambda code, bit: code * 2 + F.when(side(bit) >= 0, 1).otherwise(0))


def _nearest(pairs: DataFrame, nearest: int) -> DataFrame:
    """Lists of the nearest of (a, b, dist): at most ``nearest`` for each point."""
    found = F.array_sort(F.collect_set(F.struct("dist", "b")))
    return pairs.groupBy("a").agg(F.slice(found, 1, nearest).alias("near"))


def _listed(lists: DataFrame) -> DataFrame:
    return lists.select("a", F.explode("near").alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.dist").alias("dist"))


def _met(coded: DataFrame, nearest: int, window: int) -> DataFrame:
    """Pairs (a, b, dist) of the order by table and code: the nearest of each point among
    its ``window`` followers and as many before it, which hold the distances to it."""
    order = Window.partitionBy(RANGE, "t").orderBy("code", "pid")
    dealt = find_ranges(coded, ["t", "code", "pid"]).deal(coded).select(
        RANGE, "t", "code", "pid", _unit(F.col("vec"), F.col("norm")).alias("unit"))
    after = dealt.select(RANGE, "t", "code", "pid", "unit", F.collect_list(F.struct("pid", "unit")).over(
        order.rowsBetween(1, window)).alias("after")).select(
        RANGE, "t", "code", "pid", F.transform("after", lambda o: F.struct(
            distance(F.col("unit"), o["unit"]).alias("dist"), o["pid"].alias("b"))).alias("after"))
    both = after.select("pid", "after", F.collect_list(F.struct("pid", "after")).over(
        order.rowsBetween(-window, -1)).alias("before"))
    steps = F.size("before") - 1
    back = F.transform("before", lambda o, i: F.struct(
        F.get(o["after"], steps - i)["dist"].alias("dist"), o["pid"].alias("b")))
    return both.select(F.col("pid").alias("a"), F.explode(
        F.slice(F.array_sort(F.concat("after", back)), 1, nearest)).alias("x")).select("a", "x.b", "x.dist")


def _bettered(pts: DataFrame, lists: DataFrame, nearest: int) -> DataFrame:
    """Pairs (a, b, dist) of points and their neighbours' neighbours, for both ends, that
    come before the last of a's list; all for a list with room."""
    held = pts.select(F.col("pid").alias("a"), "vec", "norm").join(lists, "a", "left").select(
        "a", "near", "vec", "norm", F.when(F.size("near") >= nearest, F.get("near", F.lit(nearest - 1))).alias("last"))
    # the vectors are dealt as they are given; unit vectors are made where they meet
    starts = held.select("a", "vec", "norm", "last", F.explode("near.b").alias("b")).repartition("b").select(
        "a", "b", "last", _unit(F.col("vec"), F.col("norm")).alias("unit"))
    ends = _listed(lists).select(F.col("a").alias("b"), F.col("b").alias("c")).join(
        held.select(F.col("a").alias("c"), "vec", "norm", "last"), "c").repartition("b").groupBy("b").agg(
        F.collect_list(F.struct("c", "last", "vec", "norm")).alias("ends")).select("b", F.transform("ends", lambda e: F.struct(
            e["c"].alias("c"), e["last"].alias("last"), _unit(e["vec"], e["norm"]).alias("unit"))).alias("ends"))
    met = starts.join(ends, "b").select("a", "last", F.transform(
        F.filter("ends", lambda e: e["c"] != F.col("a")), lambda e: F.struct(
            e["c"].alias("c"), e["last"].alias("last"), distance(F.col("unit"), e["unit"]).alias("dist"))).alias("met"))

    def betters(last: Column, dist: Column, b: Column) -> Column:
        return last.isNull() | (F.struct(dist.alias("dist"), b.alias("b")) < last)
    one = F.transform(F.filter("met", lambda m: betters(F.col("last"), m["dist"], m["c"])), lambda m: F.struct(
        F.col("a").alias("a"), m["c"].alias("b"), m["dist"].alias("dist")))
    other = F.transform(F.filter("met", lambda m: betters(m["last"], m["dist"], F.col("a"))), lambda m: F.struct(
        m["c"].alias("a"), F.col("a").alias("b"), m["dist"].alias("dist")))
    return met.select(F.explode(F.concat(one, other)).alias("x")).select("x.a", "x.b", "x.dist")


def neighbours(pts: DataFrame, nearest: int = NEAREST, tables: int = TABLES, window: int = WINDOW,
               rounds: int = ROUNDS) -> DataFrame:
    """``a`` and its list ``near`` of (``dist``, ``b``), nearest first."""
    codes = F.transform(F.sequence(F.lit(1), F.lit(tables)), lambda t: _code(F.col("unit"), t))
    coded = written(pts.select("pid", "vec", "norm", codes.alias("codes")), "codes").select(
        F.posexplode("codes").alias("t", "code"), "pid", "vec", "norm")
    lists = written(_nearest(_met(coded, nearest, window), nearest), "near")
    for _ in range(rounds):
        lists = written(_nearest(_bettered(pts, lists, nearest).unionByName(_listed(lists)), nearest), "near")
    return lists


def reachability(pts: DataFrame, lists: DataFrame, min_points: int) -> DataFrame:
    """Edges (a, b, w) with a < b. A point whose list does not reach ``min_points``
    rows has no edge."""
    known = _listed(lists)
    counted = known.join(pts.select(F.col("pid").alias("b"), "n"), "b").groupBy("a").agg(
        F.array_sort(F.collect_list(F.struct("dist", "n"))).alias("near"))
    own = pts.select(F.col("pid").alias("a"), F.col("n").alias("own")).join(counted, "a", "left")
    start = F.struct(F.col("own").alias("n"), F.when(F.col("own") >= min_points, F.lit(0.0)).alias("core"))
    core = F.aggregate(F.coalesce("near", F.array().cast("array<struct<dist:double,n:bigint>>")), start, lambda s, x: F.struct(
        (s["n"] + x["n"]).alias("n"),
        F.coalesce(s["core"], F.when(s["n"] + x["n"] >= min_points, x["dist"])).alias("core")))
    cores = written(own.select("a", core["core"].alias("core")).where(F.col("core").isNotNull()), "cores")
    return known.join(cores, "a").join(cores.toDF("b", "core_b"), "b").groupBy(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min(F.greatest("dist", "core", "core_b")).alias("w"))


def _jumped(parents: DataFrame) -> DataFrame:
    """(c, root) of (c, root): each takes its root's root until nothing moves."""
    while True:
        up = parents.select(F.col("c").alias("root"), F.col("root").alias("above"))
        over = up.toDF("above", "top")
        moved = written(parents.join(up, "root").join(over, "above").select(
            "c", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "roots")
        parents = moved.select("c", "root")
        if moved.where("moved").isEmpty():
            return parents


def boruvka(edges: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Minimum spanning forest of edges (a, b, w) with a < b, ties by (w, a, b), and the
    component of each end (``node``, ``comp``). The number of rounds is at most the
    logarithm of the number of nodes."""
    edges = written(edges, "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    comps = nodes.select("node", F.col("node").alias("comp"))
    current = edges.select(F.col("a").alias("c"), F.col("b").alias("d"), "w", "a", "b")
    forest = None
    while not current.isEmpty():
        turned = current.select(F.col("d").alias("c"), F.col("c").alias("d"), "w", "a", "b")
        best = written(current.unionByName(turned).groupBy("c").agg(
            F.min(F.struct("w", "a", "b", "d")).alias("m")).select("c", "m.*"), "least")
        taken = best.select("a", "b", "w").distinct()
        forest = taken if forest is None else forest.unionByName(taken)
        # two components that take the same edge: the lesser is the root
        other = best.select(F.col("c").alias("d"), F.col("d").alias("back"))
        parents = best.join(other, "d").select("c", F.when(
            (F.col("back") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("root"))
        roots = _jumped(parents)
        comps = written(comps.join(roots, comps["comp"] == roots["c"], "left").select(
            "node", F.coalesce("root", "comp").alias("comp")), "components")
        ends = current.join(roots, "c").withColumnRenamed("root", "x").join(roots.toDF("d", "y"), "d")
        current = written(ends.where("x != y").groupBy(F.least("x", "y").alias("c"), F.greatest("x", "y").alias("d")).agg(
            F.min(F.struct("w", "a", "b")).alias("m")).select("c", "d", "m.*"), "edges")
    return forest, comps


def density_clusters(df: DataFrame, key: str, vec: str = "embedding", cut: float = 0.5, min_points: int = 5,
                     least: int = 5, out: str = "cluster", **search) -> DataFrame:
    """ML2: ``df`` with ``out``: clusters are numbered by their least key; noise is -1."""
    pts = points(df, key, vec)
    forest, _ = boruvka(reachability(pts, neighbours(pts, **search), min_points))
    labels = pts.select("pid", "n", "key", F.col("pid").alias("comp"))
    if forest is not None:
        _, comps = boruvka(forest.where(F.col("w") <= cut))
        labels = pts.select("pid", "n", "key").join(comps.withColumnRenamed("node", "pid"), "pid", "left").select(
            "pid", "n", "key", F.coalesce("comp", "pid").alias("comp"))
    large = labels.groupBy("comp").agg(F.sum("n").alias("rows"), F.min("key").alias("first")).where(F.col("rows") >= least)
    numbered = with_row_index(written(large, "clusters"), ["first", "comp"], "_number")
    of = pts.select("pid", F.col("vec").alias("_vec")).join(labels.select("pid", "comp"), "pid").join(
        numbered.select("comp", "_number"), "comp").select("_vec", "_number")
    return df.drop(out).join(of, df[vec] == of["_vec"], "left").select(
        *[c for c in df.columns if c != out], F.coalesce("_number", F.lit(NOISE)).cast("int").alias(out))

