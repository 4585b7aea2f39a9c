"""Global order, running sums and neighbour windows that don't funnel a table through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolith.operators.intervals import _names


#: Keys sampled to choose range bounds; they steer balance only.
SAMPLE = 2_048


def _ranges(df: DataFrame, by: Sequence[str], parts: int | None) -> DataFrame:
    """df with a `range` number: greater ranges hold greater keys, and equal keys share one.

    The bounds are literals from a bounded sample, so every evaluation of the plan deals rows alike.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*by).orderBy(F.xxhash64(*by)).limit(SAMPLE).orderBy(*by).collect()
    bounds = list(dict.fromkeys(tuple(keys[i * len(keys) // n]) for i in range(1, n))) if keys else []
    kinds = [df.schema[c].dataType for c in by]
    lows = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(b, kinds, by, strict=True)]) for b in bounds]) if bounds else None
    return df.withColumn("range", F.size(F.filter(lows, lambda b: b <= F.struct(*by))) if bounds else F.lit(0))


def running(df: DataFrame, by: Sequence[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Running sum of value along a total order, the row itself included.

    Rows are dealt into key ranges; per-range totals (one row each) become offsets of the per-range sums.
    The key must order the rows totally for a defined result.
    """
    v, total, before = _names(df, "value_", "total_", "before_")
    ranged = _ranges(df.withColumn(v, value), by, parts)
    totals = ranged.groupBy("range").agg(F.sum(v).alias(total))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    offsets = totals.select("range", F.coalesce(F.sum(total).over(ahead), F.lit(0)).alias(before))
    w = Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn(name, F.sum(v).over(w)).join(F.broadcast(offsets), "range").withColumn(name, F.col(name) + F.col(before)).drop("range", v, before)


def ordered_ids(df: DataFrame, by: Sequence[str], name: str = "id", parts: int | None = None) -> DataFrame:
    """Dense ids from 0 along a total order."""
    return running(df, by, F.lit(1), name, parts).withColumn(name, (F.col(name) - 1).cast("long"))


def equal_size_quantiles(df: DataFrame, value: str, length: str, key: str, n: int = 10, name: str = "bin") -> DataFrame:
    """floor(cumulative length share / (1 / (n - 1))) along (value, key): n - 1 bins of equal length and a last one for the top."""
    total = df.agg(F.sum(length).alias("all_"))
    run = running(df, [value, key], F.col(length).cast("double"), "cum_")
    return run.join(F.broadcast(total)).withColumn(name, F.floor(F.round(F.col("cum_") / F.col("all_") * (n - 1), 9)).cast("int")).drop("cum_", "all_")


def moving_average(df: DataFrame, value: str, width: int, order: Sequence[str], by: Sequence[str] = (), weight: str | None = None, name: str = "smooth") -> DataFrame:
    """Centred mean of `width` rows. Unweighted sums are divided by width even at the edges; with a weight it is a ratio of sums."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width // 2), width - width // 2 - 1)
    if weight is None:
        return df.withColumn(name, F.sum(value).over(w) / width)
    return df.withColumn(name, F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w))


def mask_repeats(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Null where the value equals the one before it."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name or value, F.when(F.coalesce(F.col(value) == before, F.lit(False)), None).otherwise(F.col(value)))


def convolve(df: DataFrame, features: Sequence[str], width: int, order: Sequence[str], by: Sequence[str] = (), group: str | None = None) -> DataFrame:
    """Features of the groups -width..width next to each row's group as `f:-1`, `f:0`, `f:+1`; edges repeat.

    group: dense number of runs of rows inside `by`; without it each row is one group. A neighbour group is represented by its first row.
    """
    g = group or "_group"
    rows = df if group else df.withColumn(g, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    first = rows.groupBy(*by, g).agg(*[F.min_by(f, F.struct(*order)).alias(f) for f in features])
    w = Window.partitionBy(*by).orderBy(g)
    cols = []
    for k in range(-width, width + 1):
        for f in features:
            edge = F.first(f).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if k < 0 else F.last(f).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            inside = F.lag(g, -k).over(w).isNotNull() if k else F.lit(True)
            cols.append(F.when(inside, F.lag(f, -k).over(w) if k else F.col(f)).otherwise(edge).alias(f"{f}:{k:+d}" if k else f"{f}:0"))
    around = first.select(*by, g, *cols)
    out = rows.join(around, [*by, g])
    return out if group else out.drop(g)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, chosen by a hash of the key: the same for the same seed, on any cluster."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def sample_share(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About a share of the rows, by a hash of the key."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def hash_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by a hash of the key, the same in every warm start."""
    low = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(low), df.where(~low)


def repeat_edges(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), steps: int = 1) -> DataFrame:
    """`before` and `after`: the values `steps` rows away; the first and last rows stand in beyond the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({"before": F.coalesce(F.lag(value, steps).over(w), F.first(value).over(every)), "after": F.coalesce(F.lead(value, steps).over(w), F.last(value).over(every))})
