"""Gibbs sampling and annealed marginal likelihoods of the topography model, without gathering a sample.

A step draws each sample's shares from a Dirichlet given the counts of its components, then each observation's component given the shares; the
counts are sums by sample, combined before the shuffle. All randomness is a hash of (seed, step, what is drawn), so a task that is run again, or another
partitioning, gives the same draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolith.plans.topography import CELL, Topography, _cut


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that the keys determine."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / float(1 << 53)


def cells(observed: DataFrame) -> DataFrame:
    """observed (sample, cell, weight, like) with the rows of a cell added up; n: how many units of at most one mutation it has."""
    return observed.groupBy("sample", *CELL).agg(F.sum("weight").alias("weight"), F.first("like").alias("like")).where("weight > 0").withColumn("n", F.ceil("weight").cast("int"))


def _split(rows: DataFrame) -> DataFrame:
    return rows.withColumn("unit", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("weight", F.col("weight") / F.col("n")).drop("n")


def units(observed: DataFrame) -> DataFrame:
    """The cells of observed as units that move by themselves."""
    return _split(cells(observed))


def _shares(alpha: np.ndarray, counts: Column, key: Column) -> Column:
    """Dirichlet(alpha + counts), drawn from a generator that the key starts."""
    prior = alpha.astype(float)

    @F.pandas_udf("array<double>")
    def draw(n: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for counts_, key_ in zip(n, k, strict=True):
            g = np.random.Generator(np.random.Philox(key=int(key_) & (1 << 64) - 1)).gamma(prior + np.asarray(counts_, float))
            total = g.sum()
            out.append(g / total if total > 0 else np.full(len(g), 1 / len(g)))
        return pd.Series(out)

    return draw(counts, key)


def _mixed(k: int, temperature: float) -> list[Column]:
    """Running sums over components of share times likelihood to the temperature."""
    out: list[Column] = []
    for i in range(k):
        like = F.get("like", i)
        part = F.get("theta", i) * (F.lit(1.0) if temperature == 0 else like if temperature == 1 else F.pow(like, F.lit(temperature)))
        out.append(part if not out else out[-1] + part)
    return out


def _step(model: Topography, seen: DataFrame, theta: DataFrame, seed: int, step: int, temperature: float, before: float | None = None) -> DataFrame:
    """(sample, chain, nk ARRAY[K], gain): counts of one draw of all observations given the shares; gain: what the log weight of an annealed chain grows by from the temperature before."""
    k = model.k
    rows = seen.join(theta.select("sample", "chain", "theta"), "sample")
    for i, c in enumerate(_mixed(k, temperature)):
        rows = rows.withColumn(f"c{i}", c)
    rows = _split(rows)  # units pass through a step and are stored nowhere
    u = uniform(F.lit(seed), F.lit(step), "chain", "sample", *CELL, "unit") * F.col(f"c{k - 1}")
    z = sum(((F.col(f"c{i}") <= F.col("u")).cast("int") for i in range(k - 1)), F.lit(0))
    gain = F.lit(0.0) if before is None else F.col("weight") * (F.ln(F.col(f"c{k - 1}")) - F.ln(_mixed(k, before)[-1]))
    rows = rows.withColumn("u", u).withColumn("z", z)
    return rows.groupBy("sample", "chain").agg(F.array(*[F.sum(F.when(F.col("z") == i, F.col("weight")).otherwise(0.0)) for i in range(k)]).alias("nk"), F.sum(gain).alias("gain"))


def _start(model: Topography, seen: DataFrame, seed: int, chains: int) -> DataFrame:
    """Shares of every sample and chain, drawn from the prior."""
    rows = seen.select("sample").distinct().withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    key = F.xxhash64(F.lit(seed), F.lit(-1), "sample", "chain")
    return rows.withColumn("theta", _shares(model.alpha, F.array(*[F.lit(0.0)] * model.k), key))


def _next(model: Topography, counts: DataFrame, seed: int, step: int) -> DataFrame:
    return counts.withColumn("theta", _shares(model.alpha, F.col("nk"), F.xxhash64(F.lit(seed), F.lit(step), F.lit("shares"), "sample", "chain")))


def gibbs_draws(model: Topography, observed: DataFrame, steps: int = 200, warmup: int = 50, seed: int = 0, chains: int = 1) -> DataFrame:
    """(sample, chain, step, nk ARRAY[K], theta ARRAY[K]): counts and shares of each kept step. The likelihood is tempered up over the warm-up.

    A row for each sample, chain and step is kept; a step is one pass over the observations.
    """
    seen = _cut(cells(observed))
    theta, kept = _cut(_start(model, seen, seed, chains)), None
    for t in range(warmup + steps):
        temperature = min(1.0, t / warmup) if warmup else 1.0
        theta = _cut(_next(model, _step(model, seen, theta, seed, t, temperature).drop("gain"), seed, t))
        if t >= warmup:
            one = theta.withColumn("step", F.lit(t - warmup))
            kept = one if kept is None else kept.unionByName(one)
            if t % 20 == 19:
                kept = _cut(kept)
    return kept.select("sample", "chain", "step", "nk", "theta")


def gibbs_contributions(model: Topography, draws: DataFrame) -> DataFrame:
    """(sample, component, value, deviation): mean and standard deviation of the counts over chains and steps."""
    names = F.array(*map(F.lit, model.components))
    rows = draws.select("sample", F.posexplode("nk").alias("at", "n"))
    return rows.groupBy("sample", "at").agg(F.avg("n").alias("value"), F.stddev_pop("n").alias("deviation")).select("sample", F.get(names, F.col("at")).alias("component"), "value", "deviation")


def gibbs_posteriors(model: Topography, observed: DataFrame, draws: DataFrame) -> DataFrame:
    """observed with phi ARRAY[K]: each component's probability, averaged over the draws of the sample's shares.

    A sample's draws are steps x chains x K numbers; they meet its observations in one join.
    """
    k = model.k
    all_ = draws.groupBy("sample").agg(F.collect_list("theta").alias("thetas"))  # steps x chains of them
    p = lambda t, i: F.get(t, i) * F.get(F.col("like"), i)
    total = lambda t: sum((p(t, i) for i in range(k)), F.lit(0.0))
    shares = F.transform("thetas", lambda t: F.transform(F.zip_with(t, F.col("like"), lambda a, b: a * b), lambda x: x / F.greatest(total(t), F.lit(1e-300))))
    mean = F.transform(F.aggregate(shares, F.array(*[F.lit(0.0)] * k), lambda a, s: F.zip_with(a, s, lambda x, y: x + y)), lambda x: x / F.size("thetas"))
    return observed.join(all_, "sample").withColumn("phi", mean).drop("thetas")


def annealed_likelihood(model: Topography, observed: DataFrame, steps: int = 200, seed: int = 0, chains: int = 10) -> DataFrame:
    """(sample, value): estimate of the log marginal likelihood of each sample's observations, by annealed importance sampling.

    A chain goes from the prior to the posterior of the shares over a ladder of temperatures; its weight grows by the ratio of the mixture likelihoods (components
    summed out) of neighbouring temperatures. The estimate is the mean of the chains' weights.
    """
    seen = _cut(cells(observed))
    theta = _cut(_start(model, seen, seed, chains).withColumn("logw", F.lit(0.0)))
    for t in range(1, steps + 1):
        now = _step(model, seen, theta, seed, t, t / steps, (t - 1) / steps)
        joined = now.join(theta.select("sample", "chain", "logw"), ["sample", "chain"]).withColumn("logw", F.col("logw") + F.col("gain")).drop("gain")
        theta = _cut(_next(model, joined, seed, t))
    top = theta.groupBy("sample").agg(F.max("logw").alias("top"))
    return theta.join(top, "sample").groupBy("sample", "top").agg(F.avg(F.exp(F.col("logw") - F.col("top"))).alias("m")).select("sample", (F.col("top") + F.ln("m")).alias("value"))
