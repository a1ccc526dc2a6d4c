"""Shapley values and surrogates against their definitions."""

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import functions as F

from pvlens.functions.lexicons import CLASSIFIER_RULES
from pvlens.operators import attribution as A

TEXTS = ["severe pain and MILD rash", "mild", "nothing here", "", None, "Severely severe mildly moderate severemild",
         "moderate moderate mild x y z severe", "one two three four five six seven eight nine ten moderate mild"]


def rules(words):
    return [min([r for r, (t, _, _) in enumerate(CLASSIFIER_RULES) if t in w.lower()], default=A.RULES) for w in words]


def frame(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] * 2, "id long, t string, word string")


def by_text(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], {}).setdefault(r["idx"], set()).add((r["word"], round(r[value], 9)))
    return out


def test_shapley_against_all_coalitions(spark):
    got = by_text(A.shapley_importance(frame(spark), "t", ["id"]), "value")
    for i, t in enumerate(TEXTS):
        words = (t or "").split()
        held = rules(words)
        worth = A.rule_probabilities()[min(held, default=A.RULES)]

        def score(players):
            return worth[min((held[p] for p in players), default=A.RULES)]
        n, total = len(words), 0.0
        for p in range(n if n < 10 else 0):
            others = [x for x in range(n) if x != p]
            value = sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (score((*c, p)) - score(c))
                        for k in range(n) for c in combinations(others, k))
            assert got[i][p] == {(words[p], round(value, 9))} or abs(
                next(iter(got[i][p]))[1] - value) < 2e-9
            total += value
        if n:
            assert abs(sum(v for x in got[i].values() for _, v in x) - (score(range(n)) - score(()))) < 1e-6
    assert set(got) == {i for i, t in enumerate(TEXTS) if t}


def kept(s, j, seed=A.SEED):
    m = (s * 48_271 + j * 69_621 + s * j * 16_807 + seed) % 65_521
    return 1 if s == 0 else (m * m * 40_692 + m) % 65_521 % 2


def test_masks_are_even_and_independent():
    x = np.array([[kept(s, j) for j in range(30)] for s in range(1, 400)])
    assert abs(x.mean() - 0.5) < 0.03 and (abs(x.mean(0) - 0.5) < 0.12).all()
    c = np.corrcoef(x.T) - np.eye(30)
    assert abs(c).max() < 0.3


def test_surrogate_against_normal_equations(spark):
    got = by_text(A.surrogate_importance(frame(spark), "t", ["id"]), "weight")
    assert set(got) == {i for i, t in enumerate(TEXTS) if t}
    for i, t in enumerate(TEXTS):
        words = (t or "").split()
        if not words:
            continue
        n, held = len(words), rules(words)
        worth = A.rule_probabilities()[min(held)]
        x = np.array([[kept(s, j) for j in range(n)] for s in range(A.SAMPLES)], float)
        y = np.array([worth[min([held[j] for j in range(n) if row[j]], default=A.RULES)] for row in x])
        p = np.exp(-((1 - np.sqrt(x.mean(1))) / A.WIDTH) ** 2)
        xc = x - (p @ x) / p.sum()
        b = np.linalg.solve(xc.T @ (p[:, None] * xc) + A.RIDGE * np.eye(n), xc.T @ (p * (y - p @ y / p.sum())))
        for j in range(n):
            (word, weight), = got[i][j]
            assert word == words[j] and abs(weight - b[j]) < 1e-7
    assert max(got[0], key=lambda j: next(iter(got[0][j]))[1]) == 0  # "severe" weighs most
    empty = frame(spark).where(F.lit(False))
    assert A.surrogate_importance(empty, "t", ["id"]).count() == A.shapley_importance(empty, "t", ["id"]).count() == 0
