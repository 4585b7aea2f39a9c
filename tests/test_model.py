import math

import numpy as np
import pytest

from genolith.plans import model as md


def test_special_functions():
    assert abs(md.digamma([1.0])[0] + 0.5772156649015329) < 1e-10
    for x in (0.1, 2.5, 40.0):
        assert abs(md.digamma([x + 1])[0] - md.digamma([x])[0] - 1 / x) < 1e-9
        assert abs(md.trigamma([x])[0] - md.trigamma([x + 1])[0] - 1 / x**2) < 1e-8
    assert abs(md.trigamma([1.0])[0] - math.pi**2 / 6) < 1e-9


def test_estep_splits_all_weight():
    rng = np.random.default_rng(0)
    like, w = rng.random((3, 50)), rng.random(50)
    nk = md.estep(np.ones(3), like, w, 5000, 1e-10)
    phi = md.posterior(np.ones(3), like, w, nk)
    assert np.allclose(phi.sum(axis=0), w) and np.allclose(phi.sum(axis=1), nk, rtol=1e-4)


def test_prior_update_recovers_a_dirichlet():
    rng = np.random.default_rng(1)
    true = np.array([2.0, 0.5, 5.0])
    gamma = rng.dirichlet(true, 4000) * 1e12 + 1e-9
    assert np.allclose(md.update_alpha(np.ones(3), gamma), true, rtol=0.1)


def test_fit_finds_two_sources(spark, tmp_path):
    rows = [(f"s{i}", c, float(w)) for i in range(12) for c, w in zip("ABCD", ((90, 80, 5, 5) if i % 2 else (5, 5, 70, 90)), strict=True)]
    obs = spark.createDataFrame(rows, "sample string, context string, weight double")
    m = md.fit(obs, 2, epochs=4, seed=2)
    assert m.scores[-1] > 0.3
    m.save(spark, str(tmp_path / "m"))
    again = md.FactorModel.load(spark, str(tmp_path / "m"))
    assert np.allclose(again.spectra, m.spectra) and np.allclose(again.alpha, m.alpha)
    got = {(r.sample, r.component): r.value for r in again.predict(obs).collect()}
    tops = [max(again.components, key=lambda c: got[f"s{i}", c]) for i in range(12)]
    assert len(set(tops[::2])) == len(set(tops[1::2])) == 1 and tops[0] != tops[1]


def test_boosting_and_stop_rule(spark):
    rows = [(float(i), 20.0 if i > 50 else 2.0, 1.0) for i in range(100)]
    m = md.boosted_locus_model(spark.createDataFrame(rows, "x double, y double, w double"), ["x"], "y", "w", rounds=15)
    low, high = (spark.createDataFrame([(v,)], "x double").select(m.log_rate()).first()[0] for v in (10.0, 90.0))
    assert abs(math.exp(low) - 2) < 1 and abs(math.exp(high) - 20) < 3
    assert md.should_stop([1, 3, 2, 2, 2], 3) and not md.should_stop([1, 2, 3], 2)
    assert sorted(md.row_order(np.array([[0.0], [9.0], [0.1], [9.1]]))) == [0, 1, 2, 3]


def locus_rows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 2)).round(2)
    y = rng.poisson(np.exp(0.4 * x[:, 0] - 0.7 * x[:, 1] + 0.5)).astype(float)
    w = rng.uniform(0.5, 2, 80).round(2)
    return x, y, w


def test_linear_locus_model_against_newton(spark):
    x, y, w = locus_rows()
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], "a double, b double, y double, w double")
    m = md.linear_locus_model(df, ["a", "b"], "y", "w", reg=0.0)
    z, beta = np.column_stack([np.ones(80), x]), np.zeros(3)
    for _ in range(50):
        mu = np.exp(z @ beta)
        beta = beta + np.linalg.solve(z.T @ (z * (w * mu)[:, None]), z.T @ (w * (y - mu)))
    assert np.allclose(np.array(m.coefficients), beta[1:], atol=1e-5)


def test_boosted_locus_model_against_brute_force(spark):
    x, y, w = locus_rows()
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], "a double, b double, y double, w double")
    m = md.boosted_locus_model(df, ["a", "b"], "y", "w", rounds=3, bins=8)
    rate = np.full(80, np.log((y * w).sum() / w.sum()))
    assert m.base == pytest.approx(rate[0])
    for feature, bound, left, right in m.stumps:
        g, h = w * (y - np.exp(rate)), w * np.exp(rate)
        best = -1.0
        for f in range(2):
            for cut in {c for n, c, *_ in m.stumps if n == "ab"[f]} | set(np.quantile(x[:, f], [i / 8 for i in range(1, 8)], method="inverted_cdf")):
                i = x[:, f] <= cut
                best = max(best, g[i].sum() ** 2 / (h[i].sum() + 1) + g[~i].sum() ** 2 / (h[~i].sum() + 1) - g.sum() ** 2 / (h.sum() + 1))
        i = x[:, "ab".index(feature)] <= bound
        gain = g[i].sum() ** 2 / (h[i].sum() + 1) + g[~i].sum() ** 2 / (h[~i].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
        assert gain == pytest.approx(best, rel=0.05) and left == pytest.approx(0.3 * g[i].sum() / (h[i].sum() + 1)) and right == pytest.approx(0.3 * g[~i].sum() / (h[~i].sum() + 1))
        rate = rate + np.where(i, left, right)
    got = [r[0] for r in df.select(m.log_rate()).collect()]
    assert np.allclose(got, rate)


def test_simulation_is_repeatable_and_has_the_right_mean(spark):
    c = spark.createDataFrame([(f"s{i}", k, 400.0 + 100 * (k == "b")) for i in range(40) for k in "ab"], "sample string, component string, value double")
    spectra = np.array([[0.5, 0.5, 0.0], [0.0, 0.25, 0.75]])
    one, two = (sorted(map(tuple, md.simulate(c.repartition(n), spectra, ["a", "b"], ["x", "y", "z"], seed=9).collect())) for n in (2, 5))
    assert one == two and len(one) == 120
    mean = {k: np.mean([r[2] for r in one if r[1] == k]) for k in "xyz"}
    assert all(abs(mean[k] - v) < 5 * np.sqrt(v / 40) for k, v in (("x", 200), ("y", 325), ("z", 375)))
