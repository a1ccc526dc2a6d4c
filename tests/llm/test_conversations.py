import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest

from pvlens.llm import conversations as conv

GOOD_ROLES = re.compile("(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def edited(rows, found, audit):
    """Cost and rows of an audit, None where it breaks a rule."""
    cost, at, out = 0, 0, []
    for e in audit:
        due = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e == "I":
            cost, out = cost + 3, out + [(due, "")]
            continue
        _, role, text = rows[at]
        fault, at = found[at], at + 1
        if e == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 3 * (e == "R") + 3 * (fault == "truncated")
        out.append((role if e == "K" else due, text))
    return (cost, out) if at == len(rows) and GOOD_ROLES.fullmatch("".join(r[:1] or "?" for r, _ in out)) else None


def every_audit(n, inserts=3):
    for edits in itertools.product("DKR", repeat=n):
        for places in itertools.product(range(inserts), repeat=n + 1):
            yield "".join("I" * p + e for p, e in zip(places, [*edits, ""]))


def cheapest(rows):
    """Cheapest, then ASCII-least edits by (cost, letters) of every state and row."""
    found, n = faults(rows), len(rows)
    states = {"": "", "s": "s", "u": "u", "a": "a"}
    best = {(n, q): (c, "I" * (c // 3)) for q, c in zip(states, (0, 6, 3, 0))}
    for i in range(n - 1, -1, -1):
        _, role, _ = rows[i]
        step = {}
        for q in states:
            due = "a" if q == "u" else "u"
            options = [(4 + best[i + 1, q][0], "D" + best[i + 1, q][1])]
            if found[i] not in ("blank", "duplicate"):
                more = 3 * (found[i] == "truncated")
                if role[:1] == due or (role[:1] == "s" and q == ""):
                    c, a = best[i + 1, role[:1]]
                    options.append((more + c, "K" + a))
                c, a = best[i + 1, due]
                options.append((3 + more + c, "R" + a))
            step[q] = min(options)
        for _ in range(4):  # inserts before the row
            for q in states:
                c, a = step["a" if q == "u" else "u"]
                step[q] = min(step[q], (3 + c, "I" + a))
        best |= {(i, q): v for q, v in step.items()}
    return best[0, ""]


def expected(rows):
    found = faults(rows)
    cost, audit = cheapest(rows)
    check, out = edited(rows, found, audit)
    assert check == cost
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "blank": found.count("blank"), "duplicate": found.count("duplicate"),
            "truncated": found.count("truncated"), "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def damaged(rows):
    out = []
    for cid, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if cid is None else cid}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def collected(df):
    return {r["conv_id"]: {k: r[k] for k in conv.RESULT} for r in df.collect()}


def test_cheapest_edits_against_all_edits():
    random = np.random.default_rng(5)
    texts, roles = ["hi.", "cut", "", "yes!"], ["user", "assistant", "system", "tool"]
    for _ in range(40):
        rows = [(i, roles[random.integers(4)], texts[random.integers(4)]) for i in range(random.integers(0, 4))]
        found = faults(rows)
        options = [(edited(rows, found, a)[0], a) for a in every_audit(len(rows)) if edited(rows, found, a)]
        codes = bytes(conv.code(r, ["", "blank", "duplicate", "truncated"].index(f))
                      for (_, r, _), f in zip(rows, found))
        audit, _, _, cost = conv.walk(codes, conv.START)
        assert (cost, audit) == min(options) == cheapest(rows)


def test_checkpoints_and_pieces_agree():
    random = np.random.default_rng(6)
    for n in (1, 2, 5, 40, 333):
        codes = bytes(random.integers(0, 16, n).tolist())
        audit, left, _, cost = conv.walk(codes, conv.START)
        cut = int(random.integers(0, n + 1))
        a, b = codes[:cut], codes[cut:]
        vector = conv.END
        for c in reversed(b):
            vector = conv.back(c, vector)
        first = conv.walk(a, conv.START, vector, False)
        second = conv.walk(b, first[2])
        assert (first[0] + second[0], first[3]) == (audit, cost)
        m = np.array(conv.costs(codes)).reshape(4, 4)
        assert min(m[0] + np.array(conv.END)) == cost


def test_query(query, spark, sf):
    from pvlens.llm.queries import QUERIES
    source = duckdb.sql(f"select conv_id, turn, role, text from read_parquet('{sf}/conversations.parquet')").fetchall()
    found = collected(QUERIES["op12_conversations"](spark, sf))
    ids = {r[0] for r in source}
    assert set(found) == ids
    for i in ids:
        assert found[i] == expected(in_order(damaged([r for r in source if r[0] == i])))


ROWS = [(1, 0, "user", "hi."), (1, 1, "assistant", "yes."), (1, 5, "user", "hi."), (1, 6, "user", "cut"),
        (None, None, None, None), (None, 2, "user", "a" * 3_000_000), (None, 3, "assistant", "b!"),
        (2, 1, "system", "be kind."), (2, None, "User", "."), (2, 1, "system", "be kind."),
        (3, 4, "tool", "\t"), (4, 0, "uber", "x. \n"), (4, 7, "a", "?")]


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, n int")


def plain(rows):
    return [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows]


def test_odd_rows(spark, odd):
    found = collected(conv.repair(frame(spark, ROWS)))
    assert set(found) == {None, 1, 2, 3, 4}
    for i in found:
        assert found[i] == expected(in_order(plain([r for r in ROWS if r[0] == i])))
    gone = collected(conv.repair(frame(spark, ROWS), conv.F.lit(False)))
    assert set(gone) == set(found)
    assert all(g == expected([]) for g in gone.values())
    assert conv.repair(frame(spark, ROWS).limit(0)).count() == 0
    left = conv.repaired_rows(frame(spark, ROWS)).orderBy("part", "seq", "at").collect()
    for i in found:
        text = "\n".join(f"{r['role']}:{r['text']}" for r in left if r["conv_id"] == i)
        assert hashlib.sha256(text.encode()).hexdigest() == found[i]["repaired_sha256"]


@pytest.mark.parametrize("size", [7, 1 << 16])
def test_a_conversation_of_a_third_of_all_rows(spark, odd, size):
    """One conversation over several tasks and pieces, one row of it many times."""
    random = np.random.default_rng(8)
    texts, roles = ["hi.", "cut", " ", "yes!", "so?"], ["user", "assistant", "system", "tool"]
    rows = [(9, int(random.integers(0, 900)), roles[random.integers(4)],
             f"{random.integers(40)} {texts[random.integers(5)]}") for _ in range(700)]
    rows = list({r[1]: r for r in rows}.values())  # one row a turn, so the order is given
    rows += [rows[3]] * 300
    others = [(c, t, roles[t % 4], texts[(c + t) % 5]) for c in range(10, 60) for t in range(20)]
    df = frame(spark, rows + others).repartition(5)
    found = collected(conv.repair(df, piece_rows=size))
    assert len(found) == 51
    for i in found:
        assert found[i] == expected(in_order(plain([r for r in rows + others if r[0] == i])))
