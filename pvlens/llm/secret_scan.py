"""Secrets in texts by patterns and a character convolutional network.

Patterns propose: base spans (an assignment to a telling name, an access key, a long
run of hex digits) always count; every other run of ``LEAST`` or more key characters
that holds a letter and a digit is a candidate. The network reads each candidate
whole, with ``CONTEXT`` bytes on both sides: bytes are classes (apart inside and
outside the candidate), ``FILTERS`` filters of ``WIDTH`` bytes slide over them, the
greatest value of each and three statistics of the candidate give a logit. It is
numpy from end to end: a filter tap is a table row for each class.

Labelled findings are the windows of the base spans' secrets (of an assignment: its
value) (1) and of other candidates (0), each
also with its context blanked and with another window's context, so that the shape
alone has to tell as well. All distinct windows are fitted, dealt by hash
to shards: in an epoch each shard is a task that goes over its own windows, and the
parameters that the shards come to are averaged. Every fifth window by hash is held
out: on those, logits are calibrated to probabilities (Platt's sigmoid, its sums
over all shards), and each shape of candidate gets the highest threshold at which
``RECALL`` of the held-out secrets are found (a shape without any: that of all).
Candidates at or above their threshold become spans of kind ``model``.

Texts are read once: a table in the shared folder holds, for each row, base spans
and candidates with their windows; training and scoring read that.

Defined results: null and empty texts have no spans; rows stand alone, so repeated
rows repeat; a very long text or candidate is read whole; without labelled findings
of both labels the network adds nothing; an empty table gives an empty one. Columns
but key and text are not read. Positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.llm.catalog import register, table
from pvlens.llm.common import text_blocks, utf8, written
from pvlens.operators.selection import key_at

KINDS = ["assign", "access", "hex", "model"]
NAMES = [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"]
ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST = 8, 16, 32, 12
CONTEXT, WIDTH, FILTERS = 32, 5, 32
RECALL = 0.95
# Windows, and bytes of them, that a task fits together.
SHARD_ROWS, SHARD_BYTES = 4000, 4 << 20
SEED = 3


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


DIGITS, UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()
_HEX, _KEY = _class(DIGITS + b"abcdef"), _class(LETTERS + DIGITS + b"+/_=-")
_DIGIT, _LETTER, _UPPER = _class(DIGITS), _class(LETTERS), _class(UPPER)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all runs of true values."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]


def base_spans(data: bytes, raw: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(begin, end, kind, begin of the secret itself) of the base spans of texts
    joined by line feeds, ordered."""
    lower = data.lower()
    places = []
    for name in NAMES:
        at = lower.find(name)
        while at >= 0:
            places.append(at)
            at = lower.find(name, at + 1)
    out, end = [], 0
    for at in sorted(places):
        found = ASSIGN.match(data, at) if at >= end else None
        if found:
            end = found.end()
            if len(found[1]) >= LEAST_VALUE:
                out.append((at, end, 0, found.start(1)))
    out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST_ACCESS]
    begins, ends = runs(_HEX[raw])
    long = ends - begins >= LEAST_HEX
    out += [(b, e, 2, b) for b, e in zip(begins[long].tolist(), ends[long].tolist())]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(raw: np.ndarray, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(begin, end, label) of what the network reads: the secrets of base spans (label
    1) and key-like runs that touch no base span (label 0)."""
    begins, ends = runs(_KEY[raw])
    long = ends - begins >= LEAST
    begins, ends = begins[long], ends[long]
    digits, letters = np.append(0, np.cumsum(_DIGIT[raw])), np.append(0, np.cumsum(_LETTER[raw]))
    both = (digits[ends] > digits[begins]) & (letters[ends] > letters[begins])
    begins, ends = begins[both], ends[both]
    free = np.ones(len(begins), bool)
    for b, e, _, _ in base:
        free[np.searchsorted(ends, b, "right"):np.searchsorted(begins, e)] = False
    found = [(b, e, 0) for b, e in zip(begins[free].tolist(), ends[free].tolist())]
    return sorted({*found, *((core, e, 1) for _, e, _, core in base)})


FOUND = T.StructType([
    T.StructField("base", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType())
                                                    for n in ("kind", "begin", "end", "core")]))),
    T.StructField("candidates", T.ArrayType(T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("label", "begin", "end", "lead", "size")]
        + [T.StructField("window", T.BinaryType())])))])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and candidates of each row, positions in code points."""
    base_type = pa.struct([(n, pa.int32()) for n in ("kind", "begin", "end", "core")])
    found_type = pa.struct([(n, pa.int32()) for n in ("label", "begin", "end", "lead", "size")]
                           + [("window", pa.binary())])
    for block in text_blocks(batches):
        texts = utf8(block.column("text"))
        data = b"\n".join(texts)
        raw = np.frombuffer(data, np.uint8)
        starts = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        base = base_spans(data, raw)
        chosen = candidates(raw, base)

        def rows(spans):
            owner = np.searchsorted(starts, [s[0] for s in spans], "right") - 1
            out = [[] for _ in texts]
            for t, (b, e, kind, *core) in zip(owner.tolist(), spans):
                zero = points[starts[t]]
                out[t].append((kind, *(int(points[p] - zero) for p in (b, e, *core)), t, b, e))
            return out
        base_rows = [[{"kind": k, "begin": b, "end": e, "core": c} for k, b, e, c, *_ in r] for r in rows(base)]
        chosen_rows = []
        for r in rows(chosen):
            chosen_rows.append([])
            for label, begin, end, t, b, e in r:
                low, high = max(b - CONTEXT, int(starts[t])), min(e + CONTEXT, int(starts[t + 1]) - 1)
                chosen_rows[-1].append({"label": label, "begin": begin, "end": end, "lead": b - low,
                                        "size": e - b, "window": data[low:high]})
        yield pa.RecordBatch.from_arrays(
            [block.column("key"), pa.array(base_rows, pa.list_(base_type)),
             pa.array(chosen_rows, pa.list_(found_type))], names=["key", "base", "candidates"])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, base spans and candidates of each row, as a table in the shared folder."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *FOUND.fields])
    return written(rows.mapInArrow(_find, schema), "secret-candidates")


# Byte classes: printable ASCII, other ASCII, the rest; 0 is no byte.
_BYTE = np.full(256, 96, np.int16)
_BYTE[32:127] = np.arange(1, 96)
_BYTE[128:] = 97
CLASSES = 98  # twice that: outside and inside the candidate
STATISTICS = 3


def classes(window: bytes, lead: int, size: int, blank: bool = False) -> np.ndarray:
    """Classes of a window's bytes with half a filter of nothing on both sides."""
    x = _BYTE[np.frombuffer(window, np.uint8)]
    if blank:
        x = x.copy()
        x[:lead], x[lead + size:] = 0, 0
    x[lead:lead + size] += CLASSES
    return np.pad(x, WIDTH // 2)


def foreign(window: tuple[bytes, int, int], other: tuple[bytes, int, int]) -> tuple[bytes, int, int]:
    """A window's candidate in another window's context."""
    (data, lead, size), (around, before, gone) = window, other
    return around[:before] + data[lead:lead + size] + around[before + gone:], before, size


def statistics(window: bytes, lead: int, size: int) -> list[float]:
    raw = np.frombuffer(window, np.uint8)[lead:lead + size]
    return [np.log1p(size) / 8, _DIGIT[raw].mean(), np.count_nonzero(np.bincount(raw)) / min(size, 64)]


def shape(window: bytes, lead: int, size: int) -> int:
    """0: hex digits, 1: capitals and digits, 2: else."""
    raw = np.frombuffer(window, np.uint8)[lead:lead + size]
    return 0 if _HEX[raw].all() else 1 if (_UPPER | _DIGIT)[raw].all() else 2


@dataclass
class Detector:
    """A fitted network with its calibration and thresholds."""

    taps: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 2 * CLASSES, FILTERS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS + STATISTICS + 1, np.float32))
    scale: float = 1.0
    shift: float = 0.0
    # nothing reaches these: a detector that was not fitted adds no span
    thresholds: tuple = (2.0, 2.0, 2.0)
    recall: float = 0.0

    def pooled(self, rows: list[np.ndarray], chunk: int = 1 << 16) -> np.ndarray:
        """The greatest value of each filter over each row of classes, whatever its
        length: positions are taken ``chunk`` at a time."""
        out = np.zeros((len(rows), FILTERS), np.float32)  # values below zero count as zero
        if not rows:
            return out
        x, edge = np.concatenate(rows), WIDTH - 1
        owner = np.repeat(np.arange(len(rows)), [len(r) - edge for r in rows])
        ends = np.cumsum([len(r) for r in rows])
        at = np.arange(len(owner)) + edge * owner
        assert ends[-1] == len(x)
        for low in range(0, len(at), chunk):
            here, of = at[low:low + chunk], owner[low:low + chunk]
            z = self.taps[0][x[here]]
            for k in range(1, WIDTH):
                z += self.taps[k][x[here + k]]
            firsts = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.maximum.reduceat(z, firsts, 0) + self.bias
            np.maximum(out[of[firsts]], best, out=best)
            out[of[firsts]] = best
        return out

    def logits(self, rows: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        h = np.column_stack([self.pooled(rows), stats.reshape(len(rows), STATISTICS), np.ones(len(rows))])
        return h @ self.out

    def probabilities(self, rows: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.logits(rows, stats) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def peaks(taps: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of each filter over each row of classes, zero at least, and the
    classes that it was read from (``WIDTH`` for each row and filter). A row may have any
    length: positions are taken ``chunk`` at a time."""
    x, edge = np.concatenate(rows), WIDTH - 1
    owner = np.repeat(np.arange(len(rows)), [len(r) - edge for r in rows])
    at = np.arange(len(owner)) + edge * owner
    best = np.full((len(rows), FILTERS), -np.inf, np.float32)
    top = np.zeros((len(rows), FILTERS), np.int64)
    for low in range(0, len(at), chunk):
        here, of = at[low:low + chunk], owner[low:low + chunk]
        z = taps[0][x[here]]
        for k in range(1, WIDTH):
            z += taps[k][x[here + k]]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        most = np.maximum.reduceat(z, first, 0)
        place = np.where(z == np.repeat(most, np.diff(np.append(first, len(of))), 0), here[:, None], len(x))
        place, some = np.minimum.reduceat(place, first, 0), of[first]
        higher = most > best[some]
        top[some] = np.where(higher, place, top[some])
        best[some] = np.where(higher, most, best[some])
    return np.maximum(best + bias, 0), x[top[:, None, :] + np.arange(WIDTH)[None, :, None]]


@dataclass
class Shard:
    """Findings of a shard, each three times: as it is, its context blanked, and in
    another finding's context. ``y`` are their labels, ``held`` those held out."""

    rows: list[np.ndarray]
    stats: np.ndarray
    y: np.ndarray
    held: np.ndarray
    shapes: np.ndarray

    @staticmethod
    def of(row: dict) -> Shard:
        windows = [(f["window"], f["lead"], f["size"]) for f in row["findings"]]
        random = np.random.default_rng([SEED, row["shard"]])
        strange = [foreign(w, windows[i]) for w, i in zip(windows, random.integers(0, len(windows), len(windows)))]
        return Shard(
            [classes(*w) for w in windows] + [classes(*w, True) for w in windows] + [classes(*w) for w in strange],
            np.array([statistics(*w) for w in windows] * 3, np.float32),
            np.tile(np.array([f["label"] for f in row["findings"]], np.float32), 3),
            np.tile(np.array([f["hash"] % 5 == 0 for f in row["findings"]], bool), 3),
            np.tile(np.array([shape(*w) for w in windows], np.int8), 3))


def _flat(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params]).astype(np.float64)


def _parts(flat: np.ndarray) -> list[np.ndarray]:
    """Taps, bias and output weights, and the two moments of each, from one vector."""
    shapes = [(WIDTH, 2 * CLASSES, FILTERS), (FILTERS,), (FILTERS + STATISTICS + 1,)] * 3
    ends = np.cumsum([int(np.prod(x)) for x in shapes])
    return [p.reshape(x).astype(np.float32) for p, x in zip(np.split(flat, ends[:-1]), shapes)]


def descend(shard: Shard, flat: np.ndarray, share: float, epoch: int, batch: int = 64, rate: float = 0.01) -> np.ndarray:
    """One epoch of Adam over the findings of a shard that are not held out, from the
    parameters and moments in ``flat``. ``share`` is the share of secrets among all."""
    taps, bias, out, *moments = _parts(flat)
    params, y = [taps, bias, out], shard.y
    weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    train = np.flatnonzero(~shard.held)
    order = np.random.default_rng([SEED, len(y), epoch]).permutation(train)
    step = epoch * -(-len(train) // batch)
    for low in range(0, len(order), batch):
        some = order[low:low + batch]
        best, read = peaks(taps, bias, [shard.rows[i] for i in some])
        h = np.column_stack([best, shard.stats[some], np.ones(len(some), np.float32)])
        error = ((_sigmoid(h @ out) - y[some]) * weight[some] / len(some)).astype(np.float32)
        back = error[:, None] * out[:FILTERS] * (best > 0)
        change = np.zeros_like(taps)
        filters = np.broadcast_to(np.arange(FILTERS), back.shape)
        for k in range(WIDTH):
            np.add.at(change[k], (read[:, k], filters), back)
        step += 1
        for p, g, m, s in zip(params, [change, back.sum(0), h.T @ error + 1e-4 * out], moments[:3], moments[3:]):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(np.maximum(s, 0) / (1 - 0.99 ** step)) + 1e-6)
    return _flat(params + moments)


def _sums(w: np.ndarray, logits: np.ndarray, labels: np.ndarray, targets: tuple[float, float]) -> np.ndarray:
    """Gradient and curvature of Platt's sigmoid over some logits."""
    x = np.column_stack([logits, np.ones(len(logits))]).astype(float)
    p = _sigmoid(x @ w)
    gradient = x.T @ (p - np.where(labels == 1, targets[1], targets[0]))
    return np.concatenate([gradient, ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def _newton(sums, rounds: int = 50) -> tuple[float, float]:
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        total = sums(w)
        step = np.linalg.solve(total[2:].reshape(2, 2) + 1e-6 * np.eye(2), total[:2])
        w = w - step * min(1, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _targets(n: int, ones: int) -> tuple[float, float]:
    return 1 / (n - ones + 2), (ones + 1) / (ones + 2)


def platt(logits: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift of logits whose sigmoid fits the labels best (Newton's steps;
    targets are drawn in, so separable logits stay finite)."""
    targets = _targets(len(labels), labels.sum())
    return _newton(lambda w: _sums(w, logits, labels, targets), rounds)


def _place(n: int, recall: float = RECALL) -> int:
    """Position, from the highest, that at least ``recall`` of ``n`` values reach."""
    return min(n - 1, int(np.ceil(recall * n)) - 1)


def threshold(secret: np.ndarray, recall: float = RECALL) -> float:
    """The highest threshold that at least ``recall`` of the secrets' probabilities reach."""
    return float(np.sort(secret)[::-1][_place(len(secret), recall)])


FINDING = T.ArrayType(T.StructType([
    T.StructField("hash", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("lead", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("window", T.BinaryType())]))


def _sum_by_shard(rows: DataFrame, shards: int, fan: int = 16) -> np.ndarray:
    """The sum of the vectors ``v`` (doubles as bytes) in the order of ``shard``: sums
    of ``fan`` in tasks until few are left."""
    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = sum(np.frombuffer(v, np.float64) for v in table.column("v").to_pylist())
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py() // fan], pa.int64()),
                         "v": pa.array([total.tobytes()], pa.binary())})
    rows = rows.select("shard", "v")
    while shards > fan:
        rows, shards = rows.groupBy(F.floor(F.col("shard") / fan)).applyInArrow(add, "shard long, v binary"), -(-shards // fan)
    found = sorted((r["shard"], r["v"]) for r in rows.collect())
    return sum(np.frombuffer(v, np.float64) for _, v in found)


def _per_shard(table: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on each row of a table of shards, which gives a tuple of a row."""
    kinds = [(n, pa.int64() if t == "long" else pa.binary()) for n, t in (c.split() for c in schema.split(", "))]

    def batches(rows):
        for batch in rows:
            for i in range(batch.num_rows):  # a shard at a time
                values = run(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, kinds)],
                                                 names=[n for n, _ in kinds])
    return table.mapInArrow(batches, schema)


def findings(found: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """All distinct windows of a table by :func:`find` (with ``rows``, that many a label,
    least hash first), dealt by hash to shards of about ``SHARD_ROWS`` windows and
    ``SHARD_BYTES`` bytes: a table of one row a shard, and their number."""
    windows = written(found.select(F.explode("candidates").alias("c")).select(
        "c.label", "c.lead", "c.size", "c.window", F.xxhash64("c.lead", "c.size", "c.window").alias("hash")).distinct(),
        "secret-windows")
    if rows is not None:
        order = [F.xxhash64("hash"), F.col("hash")]
        windows = reduce(DataFrame.unionByName, [
            windows.where(F.col("label") == x).orderBy(*order).limit(rows) for x in (0, 1)])
    n, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    finding = F.struct("hash", "label", "lead", "size", "window")
    dealt = windows.withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)))
    return written(dealt.groupBy("shard").agg(F.array_sort(F.collect_list(finding)).alias("findings")),
                   "secret-shards"), shards


def train(found: DataFrame, rows: int | None = None, epochs: int = 8) -> Detector:
    """Fit on all distinct windows of a table by :func:`find`, or on ``rows`` a label.

    In each epoch every shard goes once over its own windows, from the same
    parameters, in a task of its own; the parameters and moments that the shards come
    to are averaged. Windows of both labels are needed among those held out and the
    others."""
    table, shards = findings(found, rows)
    detector = Detector()
    sides = table.select(F.explode("findings").alias("f")).groupBy(
        (F.pmod("f.hash", F.lit(5)) == 0).alias("held"), F.col("f.label").alias("label")).count().collect()
    counts = {(r["held"], r["label"]): r["count"] for r in sides}
    if len(counts) < 4:
        return detector
    random = np.random.default_rng(SEED)
    params = [detector.taps, detector.bias, detector.out]
    params[0] = random.normal(0, 0.1, params[0].shape)
    params[2][:FILTERS] = random.normal(0, 0.1, FILTERS)
    flat = np.concatenate([_flat(params), np.zeros(2 * sum(p.size for p in params))])
    share = counts[False, 1] / (counts[False, 0] + counts[False, 1])
    for epoch in range(epochs):
        def run(row, flat=flat, epoch=epoch):
            shard = Shard.of(row)
            n = int((~shard.held).sum())
            v = descend(shard, flat, share, epoch) if n else flat
            return row["shard"], np.append(v * n, n).tobytes()
        total = _sum_by_shard(_per_shard(table, run, "shard long, v binary"), shards)
        flat = total[:-1] / total[-1]
    detector.taps, detector.bias, detector.out = _parts(flat)[:3]
    return calibrated(detector, table, shards, 3 * sum(n for (held, _), n in counts.items() if held), 3 * counts[True, 1])


def calibrated(detector: Detector, table: DataFrame, shards: int, n: int, ones: int) -> Detector:
    """``detector`` with its calibration and thresholds by the ``n`` held-out windows
    of all shards, of which ``ones`` are secrets."""
    def logits(row):
        shard = Shard.of(row)
        test = np.flatnonzero(shard.held)
        raw = detector.logits([shard.rows[i] for i in test], shard.stats[test]).astype(np.float64)
        return row["shard"], raw.tobytes(), shard.y[test].astype(np.int8).tobytes(), shard.shapes[test].tobytes()
    held = written(_per_shard(table, logits, "shard long, logits binary, labels binary, shapes binary"), "secret-held")
    targets = _targets(n, ones)

    def sums(w):
        return _sum_by_shard(_per_shard(held, lambda r: (r["shard"], _sums(
            w, np.frombuffer(r["logits"]), np.frombuffer(r["labels"], np.int8), targets).tobytes()),
            "shard long, v binary"), shards)
    detector.scale, detector.shift = _newton(sums)

    def secrets(batches):
        for batch in batches:
            for r in batch.to_pylist():
                of = np.frombuffer(r["labels"], np.int8) == 1
                p = _sigmoid(detector.scale * np.frombuffer(r["logits"])[of] + detector.shift)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["shapes"], np.int8)[of].astype(np.int32)),
                                                  pa.array(-p)], names=["shape", "q"])
    found = written(held.mapInArrow(secrets, "shape int, q double"), "secret-scores")

    def highest(of: DataFrame) -> float | None:
        at = key_at(of, ["q"], _place)
        return None if at is None else -at["q"]
    all_of = highest(found)
    own = [highest(found.where(F.col("shape") == k)) for k in range(3)]
    detector.thresholds = tuple(all_of if t is None else t for t in own)
    least = F.array(*[F.lit(t) for t in detector.thresholds])
    detector.recall = found.agg(F.avg((-F.col("q") >= F.get(least, F.col("shape"))).cast("double"))).first()[0]
    return detector


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def scan(found: DataFrame, detector: Detector) -> DataFrame:
    """``key`` and ``spans`` of a table by :func:`find`: kind, begin, end (code points,
    end exclusive) and calibrated probability, ordered by begin and kind. Every
    candidate is scored; base spans stay whatever their score."""
    span = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            base, chosen = batch.column("base").to_pylist(), batch.column("candidates").to_pylist()
            distinct = {(c["window"], c["lead"], c["size"]): 0.0 for r in chosen for c in r or ()}
            if distinct:
                keys = list(distinct)
                p = detector.probabilities([classes(*k) for k in keys], np.array([statistics(*k) for k in keys]))
                distinct = dict(zip(keys, p.tolist()))
            rows = []
            for spans, cs in zip(base, chosen):
                score, out = {}, []
                for c in cs or ():
                    key = (c["window"], c["lead"], c["size"])
                    score[c["begin"], c["end"]] = distinct[key]
                    if not c["label"] and distinct[key] >= detector.thresholds[shape(*key)]:
                        out.append((c["begin"], len(KINDS) - 1, c["end"]))
                out = [(b, k, e, b) for b, k, e in out]
                out = sorted(out + [(s["begin"], s["kind"], s["end"], s["core"]) for s in spans or ()])
                rows.append([{"kind": KINDS[k], "begin": b, "end": e, "score": score[c, e]} for b, k, e, c in out])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, pa.list_(span))],
                                             names=["key", "spans"])
    return found.mapInArrow(run, T.StructType([found.schema["key"], T.StructField("spans", SPANS)]))


@register("op11_secrets")
def op11_secrets(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"))
    spans = scan(found, train(found)).select(F.col("key").alias("doc_id"), "spans")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return spans.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        count("model"))
