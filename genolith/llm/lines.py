"""Line dedup by winnowing over line hashes.

Windows are runs of lines just long enough for `min_words` words: from each line the shortest run on, the shortest run back from it, and, where a line of
`min_words` words follows another, the two together (for blank lines between them). The fingerprint of a window is its least line hash, of equal ones the last, so windows that share
it are one row: (hash, position, windows). Equal windows have equal fingerprints, so only fingerprints whose hash stands at two places or more are met at all; text that
occurs once ends there. Around a met position the match is extended both ways over the windows that it is the fingerprint of, and a window whose content stands at any earlier
place is deleted. That deletes every longer repeated run whole: let t be a line of such a run [lo, hi]. If [t, hi] has `min_words` words, the window on from t lies in the run; if
[lo, t] has, the window back from t does; if neither has, the window on from the last line s with `min_words` words in [s, hi] does, and it reaches beyond t. The same holds for
a gap between two lines. All steps are windows, joins and map-side combined aggregates over narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolith.llm.common import fresh, let, stored, words

MIN_WORDS = 50
#: Runs broadcast at most (about 60 bytes each) to rewrite the texts; beyond that the texts are joined by a shuffle.
MAX_BROADCAST = 400_000


def _document(key: str, text: str) -> Column:
    """Identity and rank of a document: keys ascending, nulls last, then a hash of the text."""
    return F.struct(F.col(key).isNull().alias("z"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.xxhash64(text).alias("t"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(d, lo, hi): runs of lines (0-based, blank lines inside counted) of document d that occurred earlier."""
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(F.xxhash64(F.btrim(x, F.lit(" \t\r\x0b\x0c"))).alias("h"), F.size(words(x)).alias("n")))
    each = docs.select(_document(key, text).alias("d"), parts.alias("x")).groupBy("d").agg(F.any_value("x").alias("x"))
    rows = each.select("d", F.posexplode("x").alias("at", "x")).select("d", "at", "x.h", "x.n").where("n > 0")
    order = Window.partitionBy("d").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"s": (F.sum("n").over(so_far) - F.col("n")).cast("long"), "total": F.sum("n").over(Window.partitionBy("d"))})
    rows = rows.withColumn("e", F.col("s") + F.col("n"))
    ahead = Window.partitionBy("d").orderBy("s").rangeBetween(0, min_words - 1)  # lines that start within min_words words
    back = Window.partitionBy("d").orderBy("e").rangeBetween(1 - min_words, 0)  # lines that end within min_words words
    mark = F.struct("h", (-F.col("at")).alias("p"))

    def window(lo: Column, hi: Column, hashes: Column, least: Column) -> Column:
        return F.struct(least.alias("print"), F.struct(lo.alias("lo"), hi.alias("hi"), F.xxhash64(hashes).alias("whole")).alias("w"))

    on = F.when(F.col("total") - F.col("s") >= min_words, window(F.col("at"), F.max("at").over(ahead), F.collect_list("h").over(ahead), F.min(mark).over(ahead)))
    # a window back whose last line is needed for the words of its first is the window on from there
    to = F.when((F.col("e") >= min_words) & (F.col("s") - F.min("s").over(back) >= min_words), window(F.min("at").over(back), F.col("at"), F.collect_list("h").over(back), F.min(mark).over(back)))
    next_ = F.lead(F.struct("at", "h", "n", (-F.col("at")).alias("p"))).over(order)
    two = F.when((F.col("n") >= min_words) & (next_["n"] >= min_words), window(F.col("at"), next_["at"], F.array(F.col("h"), next_["h"]), F.least(mark, F.struct(next_["h"].alias("h"), next_["p"].alias("p")))))
    found = rows.select("d", on.alias("on"), to.alias("to"), two.alias("two")).select("d", F.explode(F.array_compact(F.array("on", "to", "two"))).alias("x")).select("d", "x.print", "x.w")
    prints = stored(found.groupBy("d", "print").agg(F.collect_list("w").alias("windows")).select("d", F.col("print.h").alias("h"), F.col("print.p").alias("p"), "windows"))

    spot = F.struct("d", "p")
    met = prints.groupBy("h").agg(F.min(spot).alias("x"), F.max(spot).alias("y")).where("x <> y").select("h")
    windows = stored(prints.join(met, "h").select("d", F.explode("windows").alias("w")).select("d", "w.*"))

    place = F.struct("d", "lo")
    first = windows.groupBy("whole").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    same = windows.join(first, "whole").where(place > F.col("first")).groupBy("d", "lo").agg(F.max("hi").alias("hi"))
    # overlapping and adjoining windows become one run
    before = F.max("hi").over(Window.partitionBy("d").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    starts = same.withColumn("new", F.coalesce(F.col("lo") > before + 1, F.lit(True)).cast("int"))
    island = F.sum("new").over(Window.partitionBy("d").orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return starts.withColumn("island", island).groupBy("d", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("d", "lo", "hi")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with the text less its later repeated runs, plus n_lines and n_removed (long).

    A run of consecutive lines, blank lines and outer blanks aside, with at least min_words words is deleted where it occurred before: in any document with a smaller
    key (then smaller text hash; null keys last) or higher up in the same one, where the two may overlap: of a line repeated on end one stays. The first occurrence always stays.
    Every other line stays as it is. Rows with equal key and text are one document and get the same result. A null text stays null with no lines;
    an empty text has one blank line. Columns of docs named n_lines or n_removed are replaced. An empty table gives an empty result.
    """
    found = stored(repeated_runs(docs, min_words, text, key))
    of, runs, mine, left = fresh(docs, "_of", "_runs", "_d", "_left")
    cut = found.groupBy(F.col("d").alias(of)).agg(F.collect_list(F.struct("lo", "hi")).alias(runs))
    rows = docs.drop("n_lines", "n_removed").withColumn(mine, _document(key, text))
    met = rows.join(F.broadcast(cut) if found.count() <= max_broadcast else cut, F.col(mine) == F.col(of), "left")
    parts = F.split(F.col(text), "\n")
    gone = F.flatten(F.transform(F.col(runs), lambda r: F.sequence(r["lo"], r["hi"])))
    keep = let(parts, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)))
    count = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(parts))
    out = met.withColumns({left: F.when(F.col(runs).isNull(), parts).otherwise(keep), "n_lines": count.cast("long")})
    return out.withColumns({"n_removed": F.coalesce(F.col("n_lines") - F.size(left), F.lit(0)).cast("long"), text: F.when(F.col(runs).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))}).drop(mine, of, runs, left)
