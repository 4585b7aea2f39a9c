"""Gibbs draws and annealed likelihoods against enumeration of all assignments of tiny samples."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolith.plans import sampling as sm
from genolith.plans import topography as tp

ALPHA, LIKE = np.array([0.7, 1.6]), np.array([[0.9, 0.1], [0.3, 0.5], [0.2, 0.8], [0.6, 0.6]])


def enumerated():
    """Log marginal likelihood, mean counts and each observation's posterior."""
    total, counts, phi = 0.0, np.zeros(2), np.zeros(LIKE.shape)
    for z in itertools.product((0, 1), repeat=len(LIKE)):
        n = np.bincount(z, minlength=2)
        prior = math.lgamma(ALPHA.sum()) - math.lgamma(ALPHA.sum() + n.sum()) + sum(math.lgamma(a + m) - math.lgamma(a) for a, m in zip(ALPHA, n, strict=True))
        p = math.exp(prior) * np.prod(LIKE[np.arange(len(z)), z])
        total += p
        counts += p * n
        phi[np.arange(len(z)), z] += p
    return math.log(total), counts / total, phi / total


@pytest.fixture(scope="module")
def seen(spark):
    rows = [(s, i, 0, "c", 1.0, [float(x) for x in LIKE[i]]) for s in range(150) for i in range(len(LIKE))]  # equal samples: independent chains
    return spark.createDataFrame(rows, "sample int, locus long, configuration int, context string, weight double, like array<double>").cache()


@pytest.fixture(scope="module")
def model():
    return tp.Topography(["x", "y"], ["c"], np.zeros((2, 1)), [], ALPHA, np.zeros(2))


def test_gibbs_mean_is_the_posterior_mean(model, seen):
    _, counts, phi = enumerated()
    draws = sm.gibbs_draws(model, seen, steps=10, warmup=4).cache()
    got = {r.component: r.v for r in sm.gibbs_contributions(model, draws).groupBy("component").agg(F.avg("value").alias("v")).collect()}
    assert np.allclose([got["x"], got["y"]], counts, atol=0.12) and abs(got["x"] + got["y"] - 4) < 1e-9
    post = sm.gibbs_posteriors(model, seen, draws).groupBy("locus").agg(*[F.avg(F.get("phi", i)).alias(f"p{i}") for i in range(2)]).orderBy("locus").collect()
    assert np.allclose([[r.p0, r.p1] for r in post], phi, atol=0.05)


def test_draws_do_not_depend_on_partitions(model, seen):
    some = seen.where("sample < 5")
    a, b = ({(r.sample, r.chain, r.step): (tuple(r.nk), tuple(r.theta)) for r in sm.gibbs_draws(model, df, steps=2, warmup=1, chains=2).collect()} for df in (some.coalesce(1), some.repartition(7, "locus")))
    assert len(a) == 20 and a == b
    other = {(r.sample, r.chain, r.step): tuple(r.theta) for r in sm.gibbs_draws(model, some, steps=2, warmup=1, chains=2, seed=1).collect()}
    assert other != {k: v[1] for k, v in a.items()}


def test_counts_move_one_by_one(model, spark):
    rows = spark.createDataFrame([("s", 1, 0, "c", 2.0, [0.5, 0.5]), ("s", 1, 0, "c", 0.5, [0.5, 0.5]), ("s", 2, 0, "c", 0.0, [0.5, 0.5])], "sample string, locus long, configuration int, context string, weight double, like array<double>")
    found = sorted((r.locus, r.unit, round(r.weight, 6)) for r in sm.units(rows).collect())
    assert found == [(1, i, round(2.5 / 3, 6)) for i in (1, 2, 3)]


def test_annealed_likelihood_equals_enumeration(model, seen):
    want, _, _ = enumerated()
    got = [r.value for r in sm.annealed_likelihood(model, seen.where("sample < 40"), steps=8, chains=25).collect()]
    assert abs(np.log(np.mean(np.exp(got))) - want) < 0.03 and len(got) == 40
    # one temperature step is importance sampling from the prior: unbiased as well, but wider
    rough = [r.value for r in sm.annealed_likelihood(model, seen.where("sample < 40"), steps=1, chains=25).collect()]
    assert np.std(rough) > np.std(got)


def test_a_row_is_kept_a_cell_not_a_unit(model, seen, monkeypatch):
    kept, plain = [], sm._cut
    monkeypatch.setattr(sm, "_cut", lambda df: kept.append(plain(df)) or kept[-1])
    sm.gibbs_draws(model, seen.withColumn("weight", F.lit(50.0)), steps=1, warmup=0).collect()
    assert kept[0].count() == seen.select("sample", *sm.CELL).distinct().count()
