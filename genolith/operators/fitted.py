"""Feature transformers that are fitted once and applied to other data: their statistics are a small table that can be stored.

`fit` makes one row of statistics for each group (a dataset, say); `apply` joins them back. The formulas are those of `features`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.operators.ordered import convolve


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _statistics(kind: str, value: str, grid: int) -> list[Column]:
    x = _number(value)
    if kind in ("standardize", "log1p_cpm", "power", "gex"):
        return [F.avg("x_").alias("a_"), F.stddev_pop("x_").alias("b_")]
    if kind == "minmax":
        return [F.min(x).alias("a_"), (F.max(x) - F.min(x)).alias("b_")]
    if kind == "robust":
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return [q[1].alias("a_"), (q[2] - q[0]).alias("b_")]
    if kind == "quantile":
        return [F.percentile(x, F.array(*[F.lit(i / (grid - 1)) for i in range(grid)])).alias("q_")]
    raise ValueError(f"no normalization {kind}")


@dataclass
class Normalizer:
    """kind: a name in `features.NORMALIZERS`; by: grouping columns; table: statistics by group (a_ centre, b_ scale, t_ total, or q_ quantiles)."""

    kind: str
    value: str
    by: list[str]
    table: DataFrame
    grid: int = 1000

    @classmethod
    def fit(cls, df: DataFrame, kind: str, value: str, by: Sequence[str] = (), grid: int = 1000) -> Normalizer:
        rows = df.select(*by, value)
        if kind in ("log1p_cpm", "power", "gex"):
            total = rows.groupBy(*by).agg(F.sum(_number(value)).alias("t_"))
            rows = cls._join(rows, total, by).withColumn("x_", F.log1p(_number(value) / F.col("t_") * 1e6))
            table = cls._join(rows.groupBy(*by).agg(*_statistics(kind, value, grid)), total, by)
        else:
            table = rows.withColumn("x_", _number(value)).groupBy(*by).agg(*_statistics(kind, value, grid))
        return cls(kind, value, list(by), table, grid)

    @staticmethod
    def _join(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.join(table, list(by), "left") if by else rows.crossJoin(F.broadcast(table))  # one row without groups

    def apply(self, df: DataFrame, name: str = "norm") -> DataFrame:
        """df with the normalised value; groups that were not fitted give null."""
        rows = self._join(df, self.table, self.by)
        x = _number(self.value)
        if self.kind in ("log1p_cpm", "power", "gex"):
            x = F.log1p(x / F.col("t_") * 1e6)
        if self.kind == "quantile":
            q, n = F.col("q_"), self.grid
            below, upto = F.size(F.filter(q, lambda v: v < x)), F.size(F.filter(q, lambda v: v <= x))
            inner = (upto - 1 + (x - F.get(q, upto - 1)) / (F.get(q, upto) - F.get(q, upto - 1))) / (n - 1)
            out = F.when(x.isNull() | q.isNull(), None).when((F.get(q, 0) == F.get(q, n - 1)) | (below == 0), 0.0).when(upto == n, 1.0).when(upto > below, (below + upto - 1) / 2 / (n - 1)).otherwise(inner)
        elif self.kind == "robust":
            out = F.when(F.col("b_") > 0, (x - F.col("a_")) / F.col("b_")).otherwise(x - F.col("a_"))
        else:
            out = F.when(F.col("b_") > 0, (x - F.col("a_")) / F.col("b_")).when(x.isNotNull() & F.col("a_").isNotNull(), 0.0)
        return rows.withColumn(name, out).drop("a_", "b_", "t_", "q_")

    def save(self, path: str) -> None:
        self.table.withColumns({"kind_": F.lit(self.kind), "value_": F.lit(self.value), "by_": F.lit(",".join(self.by)), "grid_": F.lit(self.grid)}).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Normalizer:
        rows = spark.read.parquet(path)
        r = rows.select("kind_", "value_", "by_", "grid_").first()
        return cls(r.kind_, r.value_, [b for b in r.by_.split(",") if b], rows.drop("kind_", "value_", "by_", "grid_"), r.grid_)


@dataclass
class FeatureTransformer:
    """All features of a model: numbers are normalised, classes become 0/1 columns, and each column may be joined by those of `width` neighbours on both sides."""

    normalizers: dict[str, Normalizer]
    classes: dict[str, list[str]]
    width: int = 0

    @classmethod
    def fit(cls, wide: DataFrame, numbers: dict[str, str], classes: dict[str, list[str]], by: Sequence[str] = (), width: int = 0) -> FeatureTransformer:
        """wide: locus, features and the grouping columns; numbers: feature -> normalization; classes: feature -> declared classes."""
        return cls({f: Normalizer.fit(wide, kind, f, by) for f, kind in numbers.items()}, classes, width)

    def _own(self) -> list[str]:
        return [*self.normalizers, *[f"{f}={c}" for f, cs in self.classes.items() for c in cs[1:]]]

    def names(self) -> list[str]:
        """The columns that `apply` makes; with width each once for every neighbour from -width to width."""
        return [f"{n}:{k:+d}" if k else f"{n}:0" for k in range(-self.width, self.width + 1) for n in self._own()] if self.width else self._own()

    def apply(self, wide: DataFrame, order: str = "locus", within: Sequence[str] = ()) -> DataFrame:
        """wide with the transformed columns; nulls of numbers become 0."""
        out = wide
        for f, n in self.normalizers.items():
            out = n.apply(out, "n_").drop(f).withColumnRenamed("n_", f).withColumn(f, F.coalesce(f, F.lit(0.0)))
        for f, cs in self.classes.items():
            out = out.withColumns({f"{f}={c}": F.coalesce(F.col(f) == c, F.lit(False)).cast("double") for c in cs[1:]})
        return convolve(out, self._own(), self.width, [order], within) if self.width else out


def design_matrix(contexts: int, states: np.ndarray, shared: bool = True) -> np.ndarray:
    """Design of state effects on contexts, one row for each (state, context): a shared column for each state column, and a block of columns for each context.

    states: one row of codes for each state. With S states, P codes and C contexts the result is (S * C) x (P * shared + P * C).
    """
    s, p = states.shape
    base = np.repeat(states, contexts, axis=0)
    blocks = np.einsum("sp,cd->scpd", states, np.eye(contexts)).reshape(s * contexts, p * contexts)
    return np.hstack([base, blocks]) if shared else blocks


def logsumexp(df: DataFrame, value: str, by: Sequence[str], name: str = "value") -> DataFrame:
    """by and log(sum(exp(value))) of each group, shifted by the group's largest value so that nothing overflows."""
    top = df.groupBy(*by).agg(F.max(value).alias("m_"))
    return df.join(top, list(by)).groupBy(*by, "m_").agg(F.sum(F.exp(F.col(value) - F.col("m_"))).alias("s_")).select(*by, (F.col("m_") + F.ln("s_")).alias(name))


def feature_matrix(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide table: locus and one column for each named feature of (locus, name, num)."""
    return features.where(F.col("name").isin(list(names))).groupBy("locus").pivot("name", list(names)).agg(F.first("num"))


def genome_size(regions: DataFrame) -> DataFrame:
    return regions.agg(F.sum("length").alias("size"))


def apply_rows(df: DataFrame, keys: Sequence[str], value: str, how: str = "standardize", name: str = "norm") -> DataFrame:
    """A normaliser over each row of a long matrix: a row is a group of keys."""
    return Normalizer.fit(df, how, value, keys).apply(df, name)
