"""Repair of conversation structure by a square-root checkpointed DP.

A conversation is to have role initials ``(s?(ua)+)?``: four states (nothing yet,
behind ``s``, behind ``u``, behind ``a``) and, for each row and state, the edits
Keep, Rerole, Delete and Insert. The backward pass gives the cost of the rest for
every state; only the vectors at checkpoints, some square root of the rows apart,
are kept. The forward walk computes the vectors of one block at a time anew and
takes in each state the ASCII-least edit that is *tight* (costs what the vectors
promise). The walk has no choice but the edit's letter, so the letters are the
ASCII-least cheapest edits.

Rows are range-partitioned by conversation, turn and a hash of role and text, so
one conversation may spread over many tasks. A task cuts each conversation into
pieces of bounded size. A conversation that lies in one piece is done there. The
pieces of the others are checkpoints as well: a piece's costs from state to state
are a 4 x 4 matrix, a backward pass over a conversation's matrices gives the vector
at each piece's end, each piece maps its start state to its end state, a forward
pass over the maps gives each piece's start state, and every piece is walked in a
task of its own. The final hash of a conversation reads its pieces as a stream.

Defined results: a null role or text is one space; a null conversation id is a
conversation; rows of one turn (null turns first) stand by hash of role and text;
rows alike in all four columns stand side by side, so all but the first are
duplicates. Equal texts are told by two 64-bit hashes. An empty text is blank.
A very long text passes whole, as one row. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvlens.llm.catalog import register, table
from pvlens.llm.common import text_blocks, written

# A piece holds at most so many rows and (but for one longer row) characters.
PIECE_ROWS, PIECE_CHARS = 1 << 16, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 40
SPACES = " \t\n\x0b\x0c\r"
HAS_TEXT = r"[^\x20\x09-\x0D]"

# Classes of rows by role initial and faults, together one code.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
CLASS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
GOOD, BLANK, REPEATED, CUT = range(4)
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP_TO = {(START, SYSTEM): AFTER_S, (START, USER): AFTER_U, (AFTER_S, USER): AFTER_U,
           (AFTER_U, ASSISTANT): AFTER_A, (AFTER_A, USER): AFTER_U}
# The state that a rerole or insert leads to, and the role it writes.
WRITE_TO = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
WRITES = ("user", "user", "assistant", "user")
END = (0, 2 * INSERT, INSERT, 0)  # cost behind the last row


def code(role: str, fault: int) -> int:
    return CLASS.get(role[:1], OTHER) | fault << 2


def _edits(of: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits (letter, cost, next state) of a row, letters ascending."""
    role, fault = of & 3, of >> 2
    more = TRUNCATED if fault == CUT else 0
    out = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if fault not in (BLANK, REPEATED):
            if (state, role) in KEEP_TO:
                edits.append(("K", more, KEEP_TO[state, role]))
            edits.append(("R", REROLE + more, WRITE_TO[state]))
        out.append(edits)
    return out


EDITS = [_edits(c) for c in range(16)]


def back(of: int, rest: tuple) -> tuple:
    """Costs before a row, inserts before it included, from the costs behind it."""
    a, b, c, d = (min(cost + rest[to] for _, cost, to in edits) for edits in EDITS[of])
    c, d = min(c, INSERT + d), min(d, INSERT + c)
    return min(a, INSERT + c), min(b, INSERT + c), c, d


def walk(codes: bytes, state: int, end: tuple = END, last: bool = True) -> tuple[str, list, int, int]:
    """The edits of a piece from ``state``, with cost vector ``end`` behind it:
    their letters, (row, role written or None for the row's own) of each edit that
    leaves a row (row -1: inserted), the state behind the piece, and their cost.
    ``last``: rows may be inserted behind the piece."""
    n = len(codes)
    step = isqrt(n) + 1
    marks = {n: end}
    vector = end
    for i in range(n - 1, -1, -1):
        vector = back(codes[i], vector)
        if i % step == 0:
            marks[i] = vector
    cost, letters, left = marks[0][state], [], []
    for start in range(0, n, step):
        stop = min(start + step, n)
        vectors = [marks[stop]]
        for i in range(stop - 1, start - 1, -1):
            vectors.append(back(codes[i], vectors[-1]))
        for i in range(start, stop):
            here, rest = vectors[stop - i], vectors[stop - i - 1]
            while True:
                due = here[state]
                letter, to = next(((e, q) for e, c, q in EDITS[codes[i]][state]
                                   if c + rest[q] == due and e == "D"), (None, None))
                if letter is None and INSERT + here[WRITE_TO[state]] == due:
                    letters.append("I")
                    left.append((-1, WRITES[state]))
                    state = WRITE_TO[state]
                    continue
                if letter is None:
                    letter, to = next((e, q) for e, c, q in EDITS[codes[i]][state] if c + rest[q] == due)
                letters.append(letter)
                if letter != "D":
                    left.append((i, WRITES[state] if letter == "R" else None))
                state = to
                break
    while last and end[state]:
        letters.append("I")
        left.append((-1, WRITES[state]))
        state = WRITE_TO[state]
    return "".join(letters), left, state, cost


_ROW_COSTS = np.array([np.transpose([back(c, tuple(0 if q == to else FAR for q in range(4)))
                                     for to in range(4)]) for c in range(16)], np.int64)


def costs(codes: bytes) -> list[int]:
    """Costs of a piece from each state before it to each state behind it (16 numbers)."""
    m = _ROW_COSTS[np.frombuffer(codes, np.uint8)]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        left, right = m[0:len(m) - len(odd):2], m[1::2]
        m = np.concatenate([np.minimum((left[:, :, :, None] + right[:, None]).min(2), FAR), odd])
    return m[0].ravel().tolist()


def lines(left: list, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """Role and text of the rows that the edits leave."""
    return [(role or roles[i], texts[i] if i >= 0 else "") for i, role in left]


def joined(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


LINES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
RESULT = ["gaps", *COUNTS, "cost", "audit", "repaired_sha256"]


def _result(conv: T.DataType) -> T.StructType:
    long = T.LongType()
    return T.StructType([T.StructField("conv_id", conv)]
                        + [T.StructField(c, T.StringType() if c in RESULT[-2:] else long) for c in RESULT])


def _piece(conv: T.DataType) -> T.StructType:
    """A piece: a finished conversation (``audit`` is set), or a part of one."""
    long = T.LongType()
    return T.StructType(_result(conv).fields + [
        T.StructField("part", T.IntegerType()), T.StructField("seq", long),
        T.StructField("low", long), T.StructField("high", long), T.StructField("turns", long),
        T.StructField("first_role", T.IntegerType()), T.StructField("last_role", T.IntegerType()),
        T.StructField("codes", T.BinaryType()), T.StructField("costs", T.ArrayType(long)),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("left", LINES)])


class Piece:
    """Rows of one conversation as they come in order, and what is counted of them."""

    def __init__(self, conv):
        self.conv, self.codes, self.roles, self.texts, self.chars = conv, bytearray(), [], [], 0
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = None
        self.turns = 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        bare = text.rstrip(SPACES)
        fault = (BLANK if not bare else REPEATED if repeated
                 else GOOD if bare[-1] in ".!?" else CUT)
        if fault:
            self.count[COUNTS[fault - 1]] += 1
        of = code(role, fault)
        self.codes.append(of)
        kept = fault in (GOOD, CUT)  # the others are deleted
        self.roles.append(role if kept else "")
        self.texts.append(text if kept else "")
        self.chars += len(self.texts[-1])
        if self.last is not None and (self.last, of & 3) not in LEGAL:
            self.count["illegal"] += 1
        self.first = of & 3 if self.first is None else self.first
        self.last = of & 3
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def full(self, most: int) -> bool:
        return len(self.codes) >= most or self.chars >= PIECE_CHARS


LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _gaps(low, high, turns) -> int:
    return high - low + 1 - turns if low is not None else 0


def _pieces(batches: Iterator[pa.RecordBatch], keep: bool, most: int) -> Iterator[dict]:
    """Rows in order to pieces. A conversation that begins and ends inside the
    partition and fits into one piece comes finished."""
    part, seq = TaskContext.get().partitionId(), 0
    piece, marked, before, alone = None, None, None, False

    def closed(whole: bool) -> dict:
        nonlocal seq
        row = {"conv_id": piece.conv, "part": part, "seq": seq, **piece.count}
        seq += 1
        codes = bytes(piece.codes)
        if whole:
            audit, left, _, cost = walk(codes, START)
            rows = lines(left, piece.roles, piece.texts)
            return row | {"gaps": _gaps(piece.low, piece.high, piece.turns), "cost": cost, "audit": audit,
                          "repaired_sha256": hashlib.sha256(joined(rows).encode()).hexdigest(),
                          "left": [{"role": r, "text": t} for r, t in rows] if keep else None}
        return row | {"low": piece.low, "high": piece.high, "turns": piece.turns, "codes": codes,
                      "first_role": piece.first, "last_role": piece.last,
                      "costs": costs(codes) if codes else None, "roles": piece.roles, "texts": piece.texts}
    first = True
    for block in text_blocks(batches, "text"):
        columns = [block.column(c).to_pylist() for c in ("conv_id", "turn", "h1", "h2", "kind", "role", "text", "n")]
        for conv, turn, h1, h2, kind, role, text, n in zip(*columns):
            if piece is None or conv != piece.conv:
                if piece is not None:
                    yield closed(alone)
                    first = False
                piece, alone = Piece(conv), not first
            key = (conv, turn, h1, h2)
            if kind == MARKER:
                marked = key
            elif kind == ROW:
                for i in range(n):
                    piece.add(turn, role, text, key in (marked, before))
                    before = key
                    if piece.full(most):
                        yield closed(False)
                        piece, alone = Piece(conv), False
    if piece is not None:
        yield closed(False)  # the next partition may go on with it


MARKER, ROW, GONE = 0, 1, 2


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row.get("audit") or "") + sum(map(len, row.get("texts") or ())) + sum(
            len(x["text"]) for x in row.get("left") or ())
        if len(held) >= size or chars >= PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _mapped(df: DataFrame, fn, kind: T.StructType) -> DataFrame:
    """``fn`` from record batches to dicts as a table of type ``kind``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(kind)
    return df.mapInArrow(lambda batches: _batches(fn(batches), schema), kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _alike_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that are alike become one with their number, before anything moves."""
    for batch in batches:
        names = [n for n in batch.schema.names if n != "n"]
        counted = pa.Table.from_batches([batch]).group_by(names).aggregate([([], "count_all")])
        counted = counted.rename_columns(["n" if n == "count_all" else n for n in counted.column_names])
        yield from counted.select(batch.schema.names).to_batches()


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation, turn and hash, behind markers of the rows whose role
    and text stood in an earlier turn."""
    slim = rows.where((F.col("kind") == ROW) & F.col("text").rlike(HAS_TEXT)).select(
        "conv_id", "turn", "h1", "h2")
    seen = (slim.groupBy("conv_id", "h1", "h2")
            .agg(F.min("turn").alias("low"), F.max("turn").alias("high"),
                 F.max(F.col("turn").isNull()).alias("without"))
            .where((F.col("without") & F.col("high").isNotNull()) | (F.col("high") > F.col("low"))))
    s, l = slim.alias("s"), seen.alias("l")
    later = s.join(l, F.col("s.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("s.h1") == F.col("l.h1"))
                   & (F.col("s.h2") == F.col("l.h2"))).where(
        F.col("turn").isNotNull() & (F.col("without") | (F.col("turn") > F.col("low"))))
    markers = later.select("s.conv_id", "s.turn", "s.h1", "s.h2", F.lit(MARKER).alias("kind"),
                           F.lit("").alias("role"), F.lit("").alias("text"), F.lit(1).cast("long").alias("n"))
    counted = rows.mapInArrow(_alike_together, rows.schema)
    keys = ["conv_id", "turn", "h1", "h2"]
    return counted.unionByName(markers).repartitionByRange(*keys).sortWithinPartitions(*keys, "kind")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pieces of conversations from the last to the first: the cost vector behind each."""
    conv, vector, begun = None, END, False
    for r in _rows(batches):
        if not begun or r["conv_id"] != conv:
            conv, vector, begun = r["conv_id"], END, True
            last = True
        yield {"part": r["part"], "seq": r["seq"], "end": list(vector), "last": last}
        last = False
        if r["costs"]:
            m = r["costs"]
            vector = tuple(min(m[4 * p + q] + vector[q] for q in range(4)) for p in range(4))


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The state behind a piece for each state before it, and the cost."""
    for r in _rows(batches):
        found = [walk(r["codes"], s, tuple(r["end"]), r["last"]) for s in range(4)]
        yield {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "last": r["last"], "end": r["end"],
               "to": [f[2] for f in found]}


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pieces from the first to the last: the state before each."""
    conv, state, begun = None, START, False
    for r in _rows(batches):
        if not begun or r["conv_id"] != conv:
            conv, state, begun = r["conv_id"], START, True
        yield {"part": r["part"], "seq": r["seq"], "last": r["last"], "end": r["end"], "start": state}
        state = r["to"][state]


def _walked(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[dict]:
    for r in _rows(batches):
        audit, left, _, cost = walk(r["codes"], r["start"], tuple(r["end"]), r["last"])
        rows = lines(left, r["roles"], r["texts"])
        r = {k: v for k, v in r.items() if k not in ("codes", "roles", "texts", "costs", "end", "last")}
        # the vector before the first piece holds the whole conversation's cost
        yield r | {"audit": audit, "cost": cost, "joined": joined(rows),
                   "left": [{"role": a, "text": t} for a, t in rows] if keep else None}


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pieces of conversations in order, as a stream, to one result each."""
    row, hash_, audits, any_line = None, None, [], False
    role = low = high = None
    turns = 0

    def closed() -> dict:
        return row | {"gaps": _gaps(low, high, turns), "audit": "".join(audits),
                      "repaired_sha256": hash_.hexdigest()}
    for r in _rows(batches):
        if row is None or r["conv_id"] != row["conv_id"]:
            if row is not None:
                yield closed()
            row = {"conv_id": r["conv_id"], "cost": r["cost"], **dict.fromkeys(COUNTS, 0)}
            hash_, audits, any_line, role, low, high, turns = hashlib.sha256(), [], False, None, None, None, 0
        for c in COUNTS:
            row[c] += r[c]
        if r["first_role"] is not None:
            row["illegal"] += role is not None and (role, r["first_role"]) not in LEGAL
            role = r["last_role"]
        if r["low"] is not None:
            turns += r["turns"] - (high == r["low"])
            low, high = r["low"] if low is None else low, r["high"]
        audits.append(r["audit"])
        if r["joined"]:
            hash_.update((("\n" if any_line else "") + r["joined"]).encode())
            any_line = True
    if row is not None:
        yield closed()


def _solved(df: DataFrame, present: Column | None, names: tuple, keep: bool,
            piece_rows: int) -> tuple[DataFrame, DataFrame]:
    """Finished conversations and the walked pieces of the others."""
    conv, turn, role, text = (F.col(n) for n in names)
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = df.select(conv.alias("conv_id"), turn.cast("long").alias("turn"),
                     F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
                     F.when(here, ROW).otherwise(GONE).alias("kind"))
    a_row = F.col("kind") == ROW
    rows = rows.select(
        "conv_id", F.when(a_row, F.col("turn")).alias("turn"),
        F.when(a_row, F.xxhash64("role", "text")).alias("h1"),
        F.when(a_row, F.xxhash64("text", F.lit(7), "role")).alias("h2"), "kind",
        F.when(a_row, F.col("role")).otherwise("").alias("role"),
        F.when(a_row, F.col("text")).otherwise("").alias("text"), F.lit(1).cast("long").alias("n"))
    kind = rows.schema["conv_id"].dataType
    pieces = written(_mapped(_ordered(rows), lambda b: _pieces(b, keep, piece_rows), _piece(kind)), "conversations")
    done, parts = pieces.where(F.col("audit").isNotNull()), pieces.where(F.col("audit").isNull())
    order, back_order = ["conv_id", "part", "seq"], [F.desc("conv_id"), F.desc("part"), F.desc("seq")]
    field, long = T.StructField, T.LongType()
    at = [field("part", T.IntegerType()), field("seq", long)]
    ends = [field("end", T.ArrayType(long)), field("last", T.BooleanType())]
    vectors = _mapped(parts.select(*order, "costs").repartition("conv_id").sortWithinPartitions(*back_order),
                      _vectors, T.StructType(at + ends))
    maps = _mapped(parts.select(*order, "codes").join(vectors, ["part", "seq"]), _maps,
                   T.StructType([field("conv_id", kind)] + at + ends + [field("to", T.ArrayType(T.IntegerType()))]))
    maps = written(maps, "states")
    starts = _mapped(maps.repartition("conv_id").sortWithinPartitions(*order), _starts,
                     T.StructType(at + ends + [field("start", T.IntegerType())]))
    walked = _mapped(
        parts.drop("end", "audit", "cost", "gaps", "repaired_sha256", "left").join(starts, ["part", "seq"]),
        lambda b: _walked(b, keep),
        T.StructType([f for f in _piece(kind).fields
                      if f.name not in ("codes", "roles", "texts", "costs", "gaps", "repaired_sha256")]
                     + [field("joined", T.StringType())]))
    return done, walked


def repair(df: DataFrame, present: Column | None = None,
           names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"),
           piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row for each conversation: its faults, the cheapest edits and the hash
    of the repaired rows (``role:text``, newline-joined).

    Rows for which ``present`` is not true only name their conversation. Columns
    other than the four ``names`` are not read; see the module for odd rows. The
    result's ``audit`` has a letter for each edit, so that of a very long
    conversation is as long; its rows are hashed as a stream."""
    done, walked = _solved(df, present, names, False, piece_rows)
    kind = done.schema["conv_id"].dataType
    rest = _mapped(walked.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"),
                   _hashed, _result(kind))
    return done.select(*rest.columns).unionByName(rest)


def repaired_rows(df: DataFrame, present: Column | None = None,
                  names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"),
                  piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The rows that the edits leave: ``conv_id``, ``role``, ``text``, and
    ``part``, ``seq``, ``at``, whose order is that of the rows."""
    done, walked = _solved(df, present, names, True, piece_rows)
    cols = ["conv_id", "part", "seq", "left"]
    rows = done.select(*cols).unionByName(walked.select(*cols))
    return rows.select("conv_id", "part", "seq", F.posexplode("left").alias("at", "row")).select(
        "conv_id", "part", "seq", "at", "row.role", "row.text")


def damage(df: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults by CRC-32 of ``conv_id:turn`` modulo 20 (nulls are
    one space): 0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3
    repeats the row, 4 makes it the user's. Dropped rows stay, marked: the column
    tells which rows are there."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % 20
    rows = df.select("conv_id", "turn", text[2].alias("role"), text[3].alias("text"), fault.alias("fault"))
    is_ = F.col("fault").__eq__
    return rows.select(
        "conv_id", "turn", F.when(is_(4), "user").otherwise(F.col("role")).alias("role"),
        F.when(is_(1), "").when(is_(2), F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        "fault", F.explode(F.array_repeat(F.lit(0), F.when(is_(3), 2).otherwise(1))).alias("copy"),
    ), F.col("fault") != 0


@register("op12_conversations")
def op12_conversations(spark, sf_dir):
    rows, present = damage(table(spark, sf_dir, "conversations"))
    return repair(rows, present)
