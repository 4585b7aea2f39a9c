"""Feature ingestion and normalisation (fit on statistics, transform by expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolith.operators.intervals import map_intervals, overlap_join

MAX_CLASSES = 255


class FeatureError(ValueError):
    """A feature track that can't be used."""


def continuous_feature(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, name: str = "value", width: int | None = None) -> DataFrame:
    """Mean of b's value over overlapping records, each counted once; null without one. Raises for fewer than two values or no variance."""
    out = map_intervals(a, b, key, {name: F.avg(F.col(value + "_b"))}, width)
    n, spread = out.agg(F.count(name), F.coalesce(F.var_pop(name), F.lit(0.0))).first()
    if n <= 1 or spread == 0:
        raise FeatureError("a continuous feature needs at least two different values")
    return out


def discrete_feature(a: DataFrame, b: DataFrame, key: Sequence[str], label: str, priority: Sequence[str] | None = None, null: str = ".", width: int | None = None) -> DataFrame:
    """value: the label of highest priority among overlapping records, null without one. priority defaults to the sorted labels and must name all of them."""
    classes = sorted(r[0] for r in b.select(label).where(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect())
    if len(classes) > MAX_CLASSES:
        raise FeatureError(f"more than {MAX_CLASSES} classes")
    order = list(priority or classes)
    if set(order) != set(classes):
        raise FeatureError(f"the priority list must name exactly the classes {classes}")
    ranks = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)]) if order else F.create_map().cast("map<string,int>")
    names = F.array(*[F.lit(c) for c in order])
    got = overlap_join(a, b.select("chrom", "start", "end", label), width).groupBy(*key).agg(F.min(F.element_at(ranks, F.col(label + "_b"))).alias("rank_"))
    return a.join(got, list(key), "left").withColumn("value", F.coalesce(F.get(names, F.col("rank_")), F.lit(null))).drop("rank_")


def class_order(priority: Sequence[str], null: str = ".") -> list[str]:
    """Stored class list: the null class first, then priorities from low to high."""
    return [null, *reversed(list(priority))]


def strand_feature(a: DataFrame, b: DataFrame, key: Sequence[str], strand: str = "strand", width: int | None = None) -> DataFrame:
    """strand in {-1, 0, 1}; minus wins over plus. Raises when nothing overlaps."""
    s = F.col(strand + "_b")
    got = map_intervals(a, b, key, {"lowest_": F.min(F.when(s == "-", -1).when(s == "+", 1))}, width)
    out = got.withColumn("strand", F.coalesce("lowest_", F.lit(0)).cast("int")).drop("lowest_")
    if out.where("strand <> 0").isEmpty():
        raise FeatureError("no strand overlaps any region")
    return out


def length_report(df: DataFrame, length: str = "length") -> DataFrame:
    """Count, extremes and quantiles of region lengths, one row."""
    q = {f"q{int(100 * p)}": F.round(F.percentile(length, F.lit(p)), 6) for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("shortest"), F.max(length).alias("longest"), *[c.alias(n) for n, c in q.items()])


def _joined(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics of each group back to its rows; one row per group."""
    return df.join(F.broadcast(stats)) if not by else df.join(stats, list(by))


def _finite(c: str) -> Column:
    return F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))


def standardize(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "norm", fit: Column | None = None) -> DataFrame:
    """(x - mean) / population deviation; nulls and NaN are left out of the fit and stay null. A constant gives 0."""
    x = F.col("x_")
    rows = df.withColumn("x_", _finite(value)).withColumn("f_", fit if fit is not None else F.col("x_"))
    stats = rows.groupBy(*by).agg(F.avg("f_").alias("m_"), F.stddev_pop("f_").alias("s_"))
    out = _joined(rows, stats, by).withColumn(name, F.when(F.col("s_") > 0, (x - F.col("m_")) / F.col("s_")).when(x.isNotNull(), 0.0))
    return out.drop("x_", "f_", "m_", "s_")


def log1p_cpm(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "norm", fit_mask: Column | None = None) -> DataFrame:
    """log1p of counts per million of the group total, then standardised. fit_mask: rows that count for the statistics."""
    rows = df.withColumn("c_", _finite(value))
    mask = fit_mask if fit_mask is not None else F.lit(True)
    total = rows.withColumn("k_", mask).groupBy(*by).agg(F.sum(F.when(F.col("k_"), F.col("c_"))).alias("t_"))
    rows = _joined(rows, total, by).withColumn("l_", F.log1p(F.col("c_") / F.col("t_") * 1e6))
    return standardize(rows, "l_", by, name, F.when(mask, F.col("l_"))).drop("c_", "t_", "l_")


def gex(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "norm") -> DataFrame:
    """log1p_cpm fitted without values that equal the one before them, applied to all."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("fresh_", ~F.coalesce(F.col(value) == before, F.lit(False)))
    return log1p_cpm(rows, value, by, name, F.col("fresh_")).drop("fresh_")


def minmax(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "norm") -> DataFrame:
    """(x - min) / (max - min); a constant gives 0."""
    rows = df.withColumn("x_", _finite(value))
    stats = rows.groupBy(*by).agg(F.min("x_").alias("lo_"), F.max("x_").alias("hi_"))
    span = F.col("hi_") - F.col("lo_")
    return _joined(rows, stats, by).withColumn(name, F.when(span > 0, (F.col("x_") - F.col("lo_")) / span).when(F.col("x_").isNotNull(), 0.0)).drop("x_", "lo_", "hi_")


def robust(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "norm") -> DataFrame:
    """(x - median) / interquartile range."""
    rows = df.withColumn("x_", _finite(value))
    stats = rows.groupBy(*by).agg(F.percentile("x_", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q_"))
    span = F.col("q_")[2] - F.col("q_")[0]
    return _joined(rows, stats, by).withColumn(name, F.when(span > 0, (F.col("x_") - F.col("q_")[1]) / span).when(F.col("x_").isNotNull(), F.col("x_") - F.col("q_")[1])).drop("x_", "q_")


def _rank(sorted_: Column, x: Column, n: int, inclusive: bool) -> Column:
    """How many of n ascending numbers are below x (inclusive: or equal to it), by halving."""

    def step(at: Column, size: Column) -> Column:
        v = F.get(sorted_, at + size - 1)
        return F.when((v <= x) if inclusive else (v < x), at + size).otherwise(at)

    sizes = [1 << i for i in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, sizes)), F.lit(0), step)


def quantile(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "norm", n: int = 1000) -> DataFrame:
    """Map to [0, 1] by piecewise linear interpolation on n exact quantiles; ties get the middle of their range."""
    rows = df.withColumn("x_", _finite(value))
    grid = [i / (n - 1) for i in range(n)]
    stats = rows.groupBy(*by).agg(F.percentile("x_", F.array(*map(F.lit, grid))).alias("q_"))
    joined = _joined(rows, stats, by)
    x, q = F.col("x_"), F.col("q_")
    joined = joined.withColumn("below_", _rank(q, x, n, False)).withColumn("upto_", _rank(q, x, n, True))
    below, upto = F.col("below_"), F.col("upto_")
    lo, hi = F.get(q, upto - 1), F.get(q, upto)
    inner = (upto - 1 + (x - lo) / (hi - lo)) / (n - 1)
    tied = (below + upto - 1) / 2 / (n - 1)
    p = F.when(x.isNull(), None).when(F.get(q, 0) == F.get(q, n - 1), 0.0).when(below == 0, 0.0).when(upto == n, F.when(below < n - 1, 1.0).otherwise(1.0)).when(upto > below, tied).otherwise(inner)
    return joined.withColumn(name, p).drop("x_", "q_", "below_", "upto_")


NORMALIZERS = {"log1p_cpm": log1p_cpm, "power": log1p_cpm, "gex": gex, "minmax": minmax, "quantile": quantile, "standardize": standardize, "robust": robust}


def ordinal(c: Column, classes: Sequence[str]) -> Column:
    """Position of a class in its declared order; null if undeclared."""
    at = F.array_position(F.array(*map(F.lit, classes)), c)
    return F.when(at > 0, at - 1).cast("long")


def one_hot(df: DataFrame, column: str, classes: Sequence[str], drop_first: bool = True) -> DataFrame:
    """0/1 columns `column=class`; the first class is left out if drop_first."""
    return df.withColumns({f"{column}={c}": (F.coalesce(F.col(column) == c, F.lit(False))).cast("int") for c in list(classes)[int(drop_first):]})


def mesoscale_state(strands: Sequence[Column], labels: Sequence[tuple[Column, Sequence[str]]], minus: bool = False) -> Column:
    """Index of the value tuple in the product of {-1, 0, 1} per strand and the class lists, the last axis fastest; minus turns the strands over."""
    index = F.lit(0)
    for s in strands:
        index = index * 3 + ((1 - s) if minus else (s + 1))
    for c, classes in labels:
        index = index * len(classes) + ordinal(c, classes)
    return index.cast("long")


def interaction_groups(meta: DataFrame) -> DataFrame:
    """(grp, features) of the feature table (name, grp); empty when there is one group only."""
    g = meta.groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("features"))
    n = g.agg(F.count(F.lit(1)).alias("n_"))
    return g.join(F.broadcast(n)).where("n_ > 1").drop("n_")


def shared_features(*metas: DataFrame) -> DataFrame:
    """(name, kind) present in all tables without strand and mesoscale features; categorical ones first, then by name."""
    out = metas[0].select("name", "kind")
    for m in metas[1:]:
        out = out.intersect(m.select("name", "kind"))
    return out.where(~F.col("kind").isin("strand", "mesoscale")).orderBy((F.col("kind") != "categorical").cast("int"), "name")
