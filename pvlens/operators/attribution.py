"""Word importance by two further methods (ML3): exact Shapley values, and local
surrogate models.

Both explain P(predicted label | words) of the rule classifier (V1) when only some of
a text's words are there. A rule's term never spans a space, and the first rule in
order whose term is present decides, so the probability depends only on the earliest
rule among the words that are there.

* **Shapley values** in closed form. A word counts by its earliest rule; a coalition is
  worth what its earliest rule is worth. A word of rule r changes a coalition's worth
  only if it comes before all words of earlier or the same rules, and then by the
  difference to the earliest rule k among the words before it. Coming before all words
  of the rules up to k has probability 1 / (their number). The values of a text sum to
  the score of its words less the score of no words.
* **Surrogate**: ``samples`` seeded masks leave words out, the classifier scores what is
  left, and a ridge regression, weighted by how near a mask is to the whole text,
  explains the scores by the words. Masks depend on the sample's and the word's number
  alone, so the regression's matrix is the same for all texts of one length: its normal
  equations are solved once a length, in the dual form whose size is the number of
  samples however long the text is, by Gauss-Jordan elimination in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlens.functions.lexicons import CLASSIFIER_BASE_PROB, CLASSIFIER_DEFAULT, CLASSIFIER_RULES, SEVERITY_LABELS
from pvlens.functions.text import with_evaluated, words
from pvlens.session import written

SAMPLES, WIDTH, RIDGE, SEED = 64, 0.25, 1.0, 42
RULES = len(CLASSIFIER_RULES)


def rule_probabilities() -> list[list[float]]:
    """Row t, entry r: the probability, when rule r decides, of the label that rule t
    gives; the last of each stands for no rule."""
    rules = [(label, conf) for _, label, conf in CLASSIFIER_RULES] + [CLASSIFIER_DEFAULT]

    def of(target: str, label: str, conf: float) -> float:
        scores = [conf if x == label else CLASSIFIER_BASE_PROB for x in SEVERITY_LABELS]
        return (conf if target == label else CLASSIFIER_BASE_PROB) / sum(scores)
    return [[of(target, *rule) for rule in rules] for target, _ in rules]


def _matrix(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])


def _ruled(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """``keys``, the words, each word's earliest rule (``RULES``: none), and the worth
    of each rule for the text's own label."""
    def earliest(word: Column) -> Column:
        w, found = F.lower(word), F.lit(RULES)
        for r, (term, _, _) in reversed(list(enumerate(CLASSIFIER_RULES))):
            found = F.when(F.instr(w, term) > 0, F.lit(r)).otherwise(found)
        return found
    rows = df.select(*keys, words(F.coalesce(F.col(text_col), F.lit(""))).alias("_ws"))
    rows = with_evaluated(rows, "_rules", F.transform("_ws", earliest))
    own = F.coalesce(F.array_min("_rules"), F.lit(RULES))
    return with_evaluated(rows, "_worth", F.get(_matrix(rule_probabilities()), own))


def shapley_importance(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """ML3: the exact Shapley value of every word, one row per (keys, idx, word, value)."""
    rows = _ruled(df, text_col, keys)
    upto, number = [], F.lit(0)
    for r in range(RULES):
        number = number + F.size(F.filter("_rules", F.lit(r).__eq__))
        upto.append(number.cast("double"))
    rows = with_evaluated(rows, "_upto", F.array(*upto))

    def worth(r: int) -> Column:
        return F.get("_worth", F.lit(r))

    def first(r: int) -> Column:
        """Probability to come before all other words of the rules up to r."""
        return 1 / F.get("_upto", F.lit(r))

    def value(r: int) -> Column:
        later = [(first(k - 1) - first(k)) * (worth(r) - worth(k)) for k in range(r + 1, RULES)]
        return sum(later, F.lit(0.0)) + first(RULES - 1) * (worth(r) - worth(RULES))
    # a rule without words has no value that is looked up
    held = [F.when(F.array_contains("_rules", r), value(r)) for r in range(RULES)]
    rows = with_evaluated(rows, "_values", F.array(*held, F.lit(0.0)))
    return rows.select(*keys, F.posexplode(F.arrays_zip(F.col("_ws").alias("w"), F.col("_rules").alias("r"))).alias(
        "idx", "x"), "_values").select(*keys, "idx", F.col("x.w").alias("word"),
                                       F.get("_values", F.col("x.r")).alias("value"))


def kept(sample: Column, word: Column, seed: int = SEED) -> Column:
    """Whether a mask keeps a word: 1 or 0. The first mask keeps all."""
    s, j, prime = sample.cast("long"), word.cast("long"), 65_521
    mixed = F.pmod(s * 48_271 + j * 69_621 + s * j * 16_807 + seed, F.lit(prime))
    return F.when(s == 0, 1).otherwise(F.pmod(F.pmod(mixed * mixed * 40_692 + mixed, F.lit(prime)), F.lit(2)).cast("int"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _inverse(matrix: Column, size: int) -> Column:
    """The inverse of a positive definite matrix by Gauss-Jordan elimination."""
    start = F.transform(matrix, lambda row, i: F.concat(row, F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.when(j == i, 1.0).otherwise(0.0))))

    def step(m: Column, p: Column) -> Column:
        pivot = F.transform(F.array(F.get(m, p)), lambda row: F.transform(row, lambda x: x / F.get(row, p)))[0]

        def eliminated(pivot: Column) -> Column:
            return F.transform(m, lambda row, i: F.when(i == p, pivot).otherwise(
                F.zip_with(row, pivot, lambda x, y: x - F.get(row, p) * y)))
        return F.transform(F.array(pivot), eliminated)[0]
    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, step)
    return F.transform(done, lambda row: F.slice(row, size + 1, size))


def surrogate_matrices(lengths: DataFrame, samples: int = SAMPLES, width: float = WIDTH, ridge: float = RIDGE,
                       seed: int = SEED) -> DataFrame:
    """For each length ``n`` the matrix that turns the masks' scores into the words'
    weights: (X' P X + ridge)^-1 X' P with centred masks X and proximities P."""
    masks = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda j: kept(s, j, seed).cast("double")))
    rows = with_evaluated(lengths.select("n"), "x", masks)
    part = F.transform("x", lambda row: F.aggregate(row, F.lit(0.0), lambda s, v: s + v) / F.col("n"))
    near = F.transform(part, lambda share: F.exp(-F.pow((1 - F.sqrt(share)) / width, F.lit(2.0))))
    rows = with_evaluated(rows, "near", near)
    total = F.aggregate("near", F.lit(0.0), lambda s, v: s + v)
    # columns of X, centred by their weighted means, times the roots of the proximities
    column = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.transform("x", lambda row: F.get(row, j)))
    rows = with_evaluated(rows, "columns", column)
    rows = with_evaluated(rows, "total", total)
    means = F.transform("columns", lambda c: _dot(c, F.col("near")) / F.col("total"))
    rows = with_evaluated(rows, "means", means)
    scaled = F.zip_with("columns", "means", lambda c, m: F.zip_with(c, F.col("near"), lambda x, w: (x - m) * F.sqrt(w)))
    rows = with_evaluated(rows, "scaled", scaled)
    turned = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.transform(
        "scaled", lambda c: F.get(c, s)))
    rows = with_evaluated(rows, "turned", turned)
    gram = F.transform("turned", lambda a, i: F.transform("turned", lambda b, j: _dot(a, b) + F.when(
        i == j, F.lit(float(ridge))).otherwise(0.0)))
    rows = with_evaluated(rows, "gram", gram)
    rows = with_evaluated(rows, "inverse", _inverse(F.col("gram"), samples))
    # scaled' times inverse times the roots of the proximities
    matrix = F.transform("scaled", lambda c: F.zip_with(F.transform("inverse", lambda row: _dot(c, row)), F.col("near"),
                                                        lambda x, w: x * F.sqrt(w)))
    return rows.select("n", matrix.alias("matrix"))


def surrogate_importance(df: DataFrame, text_col: str, keys: list[str], samples: int = SAMPLES,
                         width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> DataFrame:
    """ML3: the weight of every word in the local surrogate of its text, one row per
    (keys, idx, word, weight)."""
    rows = _ruled(df, text_col, keys).withColumn("n", F.size("_ws")).where("n > 0")
    # the words that can decide, with their places
    deciding = F.filter(F.transform("_rules", lambda r, i: F.struct(i.alias("i"), r.alias("r"))),
                        lambda p: p["r"] < RULES)
    rows = with_evaluated(rows, "_deciding", deciding)
    scores = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.get(F.col("_worth"), F.coalesce(
        F.array_min(F.transform(F.filter("_deciding", lambda p: kept(s, p["i"], seed) == 1), lambda p: p["r"])),
        F.lit(RULES))))
    rows = with_evaluated(rows, "_scores", scores)
    matrices = written(surrogate_matrices(rows.select("n").distinct(), samples, width, ridge, seed), "surrogates")
    solved = rows.join(matrices, "n").select(*keys, "_ws", F.transform(
        "matrix", lambda row: _dot(row, F.col("_scores"))).alias("_weights"))
    return solved.select(*keys, F.posexplode(F.arrays_zip(F.col("_ws").alias("w"), F.col("_weights").alias("b"))).alias(
        "idx", "x")).select(*keys, "idx", F.col("x.w").alias("word"), F.col("x.b").alias("weight"))
