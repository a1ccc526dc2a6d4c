"""Symptom extraction, frequency ranking and the cluster layout
(D4, D5, A18, L4, L5, C1-C4, W5, SC21, A21, A22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvlens.functions.lexicons import (
    CLUSTER_MAX, DEFAULT_SYMPTOMS, LAYOUT_CENTER, LAYOUT_PI, LAYOUT_RADIUS,
)
from pvlens.functions.text import alternation, col_, let
from pvlens.session import written


def extract_symptoms(text, dictionary: list[str] | None = None) -> Column:
    """D4 per row: distinct lower-case dictionary matches with word bounds,
    leftmost match, first alternative wins; sorted (the original returns a
    set). Terms match in any case. Null text -> []."""
    pattern = alternation(list(dict.fromkeys(t.lower() for t in dictionary or DEFAULT_SYMPTOMS)))
    t = col_(text)
    found = F.regexp_extract_all(F.lower(t), F.lit(pattern), 1)
    return F.when(t.isNull(), F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(found)))


def symptom_frequency(df: DataFrame, symptoms_col: str = "symptoms") -> DataFrame:
    """Number of texts mentioning each symptom (each once per text).
    Map-side partial aggregation keeps a hot symptom from funnelling rows."""
    return (df.select(F.explode(F.array_distinct(F.col(symptoms_col))).alias("symptom"))
              .groupBy("symptom").agg(F.count(F.lit(1)).alias("n_docs")))


def ranked_symptoms(freq: DataFrame) -> DataFrame:
    """Most frequent first; ties by name."""
    return freq.orderBy(F.col("n_docs").desc(), F.col("symptom").asc())


def top_values(df: DataFrame, values_col: str, n: int = 10,
               out: str = "value") -> DataFrame:
    """Explode an array column, count (nulls and '' excluded), top n
    by count then value."""
    counts = (df.select(F.explode(F.col(values_col)).alias(out))
                .filter(F.col(out).isNotNull() & (F.col(out) != ""))
                .groupBy(out).agg(F.count(F.lit(1)).alias("n")))
    return counts.orderBy(F.col("n").desc(), F.col(out).asc()).limit(n)


def _layout(i: Column, n: Column) -> tuple[Column, Column]:
    """SC21: circle layout with the fixed 3.14159 constant."""
    angle = (i.cast("double") / n.cast("double")) * F.lit(2.0) * F.lit(LAYOUT_PI)
    return (F.lit(LAYOUT_CENTER) + F.lit(LAYOUT_RADIUS) * F.cos(angle),
            F.lit(LAYOUT_CENTER) + F.lit(LAYOUT_RADIUS) * F.sin(angle))


def cluster_list(symptoms) -> Column:
    """C1 in-row: ``array<struct<id, label, cluster, x, y>>`` for one list;
    k = min(3, n) and cluster = i % k. Empty list -> []."""
    def build(arr):
        n = F.size(arr)
        k = F.least(F.lit(CLUSTER_MAX), n)

        def point(s, i):
            x, y = _layout(i, n)
            return F.struct(i.alias("id"), s.alias("label"), (i % k).alias("cluster"),
                            x.alias("x"), y.alias("y"))
        return F.transform(arr, point)
    return let(build, col_(symptoms))


def cluster_groups(symptoms) -> Column:
    """Cluster id -> symptoms in list order (``map<int,array<string>>``);
    null for an empty list (the key is absent in that case)."""
    def build(arr):
        n = F.size(arr)
        k = F.least(F.lit(CLUSTER_MAX), n)
        ids = F.sequence(F.lit(0), k - 1)
        groups = F.transform(ids, lambda c: F.filter(arr, lambda s, i: i % k == c))
        return F.when(n > 0, F.map_from_arrays(ids, groups))
    return let(build, col_(symptoms))


def cluster_table(df: DataFrame, index_col: str, n_total: Column,
                  extra: list[str] | None = None) -> DataFrame:
    """C3 table form: rows carry a 0-based global index (W3) and ``n_total``
    is the row count (a literal or a scalar subquery); k = min(3, n)."""
    n = n_total
    i = F.col(index_col)
    k = F.least(F.lit(CLUSTER_MAX).cast("long"), n)
    x, y = _layout(i, n)
    cols = [i.alias("id"), F.col("symptom").alias("label"), (i % k).cast("int").alias("cluster"),
            x.alias("x"), y.alias("y")]
    cols += [F.col(c) for c in (extra or []) if c in df.columns]
    return df.select(*cols)


def cluster_summary(points: DataFrame, digits: int = 9) -> DataFrame:
    """Points per cluster, centroid; cluster -1 is noise."""
    return (points.groupBy("cluster")
                  .agg(F.count(F.lit(1)).alias("n_points"),
                       F.round(F.avg("x"), digits).alias("mean_x"),
                       F.round(F.avg("y"), digits).alias("mean_y"))
                  .withColumn("is_noise", F.col("cluster") == -1))


# ---------------------------------------------------------------- D4, large-dictionary form

# A run of word characters as Java's ``\b`` sees them (letters, digits, '_').
WORD_RUN = r"[\p{L}\p{Nd}_]+"


def dictionary_frame(spark, terms: list[str]) -> DataFrame:
    """(term, priority) in list order — priority is the alternation order.
    Terms match in any case, so they are kept in lower case."""
    return spark.createDataFrame([(t.lower(), i) for i, t in enumerate(terms)],
                                 "term string, priority int")


# Bits of the first-word filter: this many a term, between the two bounds (32 KB, 1 MB).
BITS_A_TERM, FEWEST_BITS, MOST_BITS = 16, 1 << 18, 1 << 23


def first_word_filter(dictionary: DataFrame) -> tuple[DataFrame, int]:
    """A bitmap of the hashes of the terms' first words, as one row of longs in
    ``bits``, and its number of bits. It is built by one aggregate, its size is
    bounded, and it says yes to every first word."""
    n = dictionary.count() * BITS_A_TERM
    size = min(MOST_BITS, max(FEWEST_BITS, 1 << n.bit_length()))
    bit = _bit(F.regexp_extract("term", f"({WORD_RUN})", 1), size)
    words = dictionary.select(F.shiftright(bit, 6).alias("word"), F.expr("1L").alias("one"), F.pmod(bit, F.lit(64)).alias("at"))
    set_ = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", "one", F.col("at").cast("int"))).alias("bits"))
    # at most MOST_BITS / 64 longs
    held = set_.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return held.select(F.transform(F.sequence(F.lit(0), F.lit(size // 64 - 1)), lambda i: F.coalesce(
        F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("bits")), size


def _bit(word: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(size))


def _ngrams(pieces: Column, tokens: Column, max_words: int, bits: Column, size: int) -> Column:
    """Per token k that may begin a term: the strings spanning tokens k..k+n-1
    (n = 1..max_words) exactly as written, separators included."""
    n_tok = F.size(tokens)

    def at(k):
        return F.struct(k.alias("_k"), F.array(*grams(k)).alias("_g"))

    def grams(k):
        out, cur = [], None
        for n in range(max_words):
            last = k + n
            tok = F.try_element_at(tokens, last + 1)
            cur = tok if cur is None else F.concat(cur, F.try_element_at(pieces, last + 1), tok)
            out.append(cur)
        return out
    def may_begin(token):
        return let(lambda b: F.getbit(F.get(bits, F.shiftright(b, 6).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1,
                   _bit(token, size))
    marked = F.transform(tokens, lambda token, k: F.when(may_begin(token), k))
    return F.transform(F.filter(marked, lambda k: k.isNotNull()), at)


def extract_symptoms_join(df: DataFrame, text_col: str, keys: list[str], dictionary: DataFrame,
                          out: str = "symptom") -> DataFrame:
    """D4 for large dictionaries, as a join instead of one huge alternation:
    (keys, symptom) for every distinct dictionary term found, the same set as
    :func:`extract_symptoms` with the dictionary in priority order.

    1. Tokenise the lower-cased text into word runs; every token start is a
       candidate match start (a match needs ``\\b`` before it).
    2. Emit the n-grams of each token that passes a bitmap of the terms' first
       words (:func:`first_word_filter`) (n up to the longest term) exactly as
       written and equi-join them to the dictionary. Spark chooses the join by
       the dictionary's size in bytes; a shuffle join's hot n-grams are split
       by AQE.
    3. Per text, replay the regex scan over the few matched candidates in
       token order: take the first-priority term at the earliest token not
       inside the previous match, skip past it, repeat.
    Terms must begin and end with a word character."""
    d = dictionary.groupBy(F.lower("term").alias("term")).agg(F.min("priority").alias("priority"))
    longest = d.agg(F.max(F.size(F.regexp_extract_all(F.col("term"), F.lit(WORD_RUN), 0)))).first()[0]
    max_words = max(int(longest or 1), 1)
    t = F.lower(F.col(text_col))
    bitmap, size = first_word_filter(d)
    # the bitmap is a scalar subquery, which the optimizer puts into the expression
    toks = df.withColumn("_bits", written(bitmap, "first-words").scalar()).select(*keys, let(
        lambda p, w: _ngrams(p, w, max_words, F.col("_bits"), size),
        F.split(t, WORD_RUN, -1), F.regexp_extract_all(t, F.lit(WORD_RUN), 0)).alias("_at"))
    grams = (toks.select(*keys, F.inline("_at"))
                 .select(*keys, "_k", F.posexplode("_g").alias("_n", "term"))
                 .filter(F.col("term").isNotNull()))
    cands = grams.join(d, "term")
    per_doc = cands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("_k").alias("k"), "priority", (F.col("_n") + 1).alias("n"), "term"))).alias("_c"))
    init = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("found"))

    def step(acc, c):
        take = c["k"] >= acc["next"]
        return F.struct(F.when(take, c["k"] + c["n"]).otherwise(acc["next"]).alias("next"),
                        # a set: each step costs the number of distinct terms found
                        F.when(take, F.array_union(acc["found"], F.array(c["term"])))
                         .otherwise(acc["found"]).alias("found"))
    found = F.aggregate("_c", init, step)["found"]
    return per_doc.select(*keys, F.explode(found).alias(out))
