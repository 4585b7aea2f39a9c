"""Quality rules: base rules plus a hashed n-gram log-likelihood ratio (DSIR-style importance score).

Everything stays in DataFrame expressions. The corpus is read twice: one pass counts hashed word
uni- and bigrams (at most `buckets` rows leave each task), one pass scores each row by itself.
No text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolith.llm.common import BLANKS, fresh, let, words

SYMBOLS = r"[#*$%&|<>]"
BUCKETS = 10_000
#: Rows of labels at most that define the trusted target (their ids are broadcast: 8 bytes each).
MAX_TRUSTED = 20_000
#: A document whose mean log ratio per n-gram lies below this reads unlike the trusted text.
MIN_SCORE = -0.13


def _pairs(hashes: Column) -> Column:
    """Hashes of the two-word windows of an array of word hashes."""
    at = F.sequence(F.lit(0), F.size(hashes) - 2)
    return F.when(F.size(hashes) >= 2, F.transform(at, lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)))).otherwise(F.array().cast("array<bigint>"))


def _fives(hashes: Column, pairs: Column) -> Column:
    """Hashes of the five-word windows, from the word hashes and the pair hashes."""
    at = F.sequence(F.lit(0), F.size(hashes) - 5)
    gram = F.transform(at, lambda i: F.xxhash64(F.get(pairs, i), F.get(pairs, i + 2), F.get(hashes, i + 4)))
    return F.when(F.size(hashes) >= 5, gram).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(grams: Column, n: int) -> Column:
    """Words covered by the n-word windows whose hash occurs twice or more in the row.

    Rows with few repeated hashes look each window up among them; the others sort (hash, position).
    """

    def length(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def by_sort(pairs: Column) -> Column:
        again = F.transform(pairs, lambda p, i: F.struct(
            (F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False))).alias("r"), p["i"].alias("i")))
        return F.array_sort(F.transform(F.filter(again, lambda p: p["r"]), lambda p: p["i"]))

    def by_lookup(found: Column) -> Column:
        return F.filter(F.transform(grams, lambda h, i: F.when(F.array_contains(found, h), i)), lambda i: i.isNotNull())

    def places(ordered: Column) -> Column:
        found = F.array_distinct(F.filter(ordered, lambda h, i: F.get(ordered, i + 1) == h))
        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(found, lambda f: F.when(F.size(f) == 0, F.array().cast("array<int>")).when(F.size(f) <= 48, by_lookup(f)).otherwise(let(pairs, by_sort)))

    return let(let(F.sort_array(grams), places), length).cast("long")


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS) -> list[float]:
    """log(P_target / P_raw) of each bucket, both with add-one smoothing.

    trusted: rows with `key`, whose number is bounded by the caller. The raw counts cover every row of
    docs; the target counts cover the trusted rows among them. Empty inputs give zeros.
    """
    ids = F.broadcast(trusted.select(F.col(key).alias("_trusted")).where(F.col("_trusted").isNotNull()).distinct())
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_x")).join(ids, F.col("_k") == F.col("_trusted"), "left")
    hashes = F.transform(words(F.col("_x")), lambda w: F.xxhash64(w))
    counts = (
        rows.select(F.col("_trusted").isNotNull().cast("int").alias("t"), F.explode(let(hashes, lambda h: F.concat(h, _pairs(h)))).alias("g"))
        .groupBy(F.pmod("g", F.lit(buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect()  # at most `buckets` rows
    )
    raw, target = [1.0] * buckets, [1.0] * buckets
    for b, n, t in counts:
        raw[b] += n
        target[b] += t
    if sum(target) == buckets:  # nothing is trusted: no evidence against any document
        return [0.0] * buckets
    a, z = math.log(sum(raw)), math.log(sum(target))
    return [math.log(t) - z - math.log(n) + a for n, t in zip(raw, target)]


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, min_score: float = MIN_SCORE, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    score is the mean over the row's hashed word uni- and bigrams of log(P_target / P_raw); a row is kept if
    it passes the base rules and score >= min_score. Trusted rows: labels with quality 1 that aren't
    toxic, the `max_trusted` lowest by a hash of their id.

    A null or blank text has no words: zeros, base_failed true, score 0, kept false. Each row is judged
    alone, so repeated rows get equal verdicts; null keys are never trusted. Columns of docs with the
    names of results are replaced. An empty table gives an empty result.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(key).isNotNull())
    trusted = good.select(key).distinct().orderBy(F.xxhash64(key), key).limit(max_trusted)
    ratios = F.split(F.lit(",".join(map(repr, log_ratios(docs, trusted, text, key, buckets)))), ",").cast("array<double>")  # folded to one literal

    h, = fresh(docs, "_measures")
    whole = F.coalesce(F.col(text), F.lit(""))

    def measures(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))

        def of(x: Column, pairs: Column) -> Column:
            def total(grams: Column) -> Column:
                return F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(ratios, F.pmod(g, F.lit(buckets)).cast("int")))

            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                let(_fives(x, pairs), lambda g: _repeated_words(g, 5)).alias("n_repeat_words"),
                ((total(x) + total(pairs)) / F.greatest(F.lit(1), F.size(x) + F.size(pairs))).alias("score"),
            )

        return let(hashes, lambda x: let(_pairs(x), lambda pairs: of(x, pairs)))

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn(h, let(words(F.col(text)), measures))
    m = F.col(h)
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return out.withColumns({
        "n_words": m["n_words"], "word_chars": m["word_chars"],
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": m["n_repeat_words"], "base_failed": failed, "score": m["score"],
        "kept": ~failed & (m["score"] >= min_score),
    }).drop(h)


__all__ = ["quality", "log_ratios", "BLANKS", "SYMBOLS"]
