"""Grown trees against a plain best-first grower in numpy, early stops, and Shapley values against all subsets of features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolith.plans import trees as tr

NAMES = ["a", "b", "c"]


def frame(spark, x, y, mu, valid=None):
    valid = np.zeros(len(x), bool) if valid is None else valid
    rows = [(*(None if np.isnan(v) else float(v) for v in r), [float(v) for v in p], [float(v) for v in m], bool(t)) for r, p, m, t in zip(x, y, mu, valid, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y array<double>, mu array<double>, valid boolean").repartition(3)


def plain_tree(x, y, mu, cuts, s):
    """Leaves by their rows, grown best first with direct sums; returns each row's value."""
    bias = y.sum() / mu.sum()
    h = bias * mu
    g = y - h

    def split(rows, depth):
        best = None
        if depth >= s.depth:
            return None
        for f in range(x.shape[1]):
            v = x[rows, f]
            lost = np.isnan(v)
            for b, cut in enumerate(cuts[f]):
                for missing_left in (True, False) if lost.any() else (True,):
                    left = np.where(lost, missing_left, v <= cut)
                    l, r = rows[left], rows[~left]
                    if min(len(l), len(r)) < s.least_rows:
                        continue
                    gain = sum(g[q].sum() ** 2 / (h[q].sum() + s.l2) for q in (l, r)) - g[rows].sum() ** 2 / (h[rows].sum() + s.l2)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, l, r)
        return best

    leaves = [(np.arange(len(x)), 0)]
    while len(leaves) < s.leaves:
        found = [(split(*leaf), i) for i, leaf in enumerate(leaves)]
        found = [(f, i) for f, i in found if f]
        if not found:
            break
        (_, l, r), i = max(found, key=lambda z: z[0][0])
        _, depth = leaves.pop(i)
        leaves += [(l, depth + 1), (r, depth + 1)]
    out = np.zeros(len(x))
    for rows, _ in leaves:
        out[rows] = s.shrink * g[rows].sum() / (h[rows].sum() + s.l2)
    return out


def data(seed, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[rng.random((n, 3)) < 0.1] = np.nan
    mu = rng.uniform(1, 3, size=(n, 2))
    rate = np.column_stack([np.exp(np.where(np.nan_to_num(x[:, 0]) > 0, 1.0, 0) * np.where(np.nan_to_num(x[:, 1]) > 0, 1.5, -0.5)), np.exp(0.8 * np.nan_to_num(x[:, 2]))])
    return x, rng.poisson(mu * rate).astype(float), mu, rate


@pytest.mark.parametrize("leaves", [2, 5, 12])
def test_a_tree_is_grown_best_leaf_first(spark, leaves):
    x, y, mu, _ = data(leaves)
    s = tr.Settings(trees=1, leaves=leaves, depth=4, least_rows=10)
    df = frame(spark, x, y, mu)
    cuts = tr.quantile_cuts(df, NAMES, 12)
    table = tr.binned(df, NAMES, cuts, valid=F.col("valid")).persist()
    found = tr.grow(table, NAMES, cuts, 2, s)
    for k in range(2):
        assert len(found[k]) == 1 and (found[k][0].feature < 0).sum() <= leaves
        assert np.allclose(found[k][0].predict(x), plain_tree(x, y[:, k], mu[:, k], cuts, s))
    rows = df.withColumn("p", tr.log_rates([tr.TreeRate(NAMES, t) for t in found])).collect()
    at = np.array([[np.nan if r[c] is None else r[c] for c in NAMES] for r in rows])
    assert np.allclose([r.p for r in rows], np.column_stack([t[0].predict(at) for t in found]))
    again = tr.TreeRate.from_json(tr.TreeRate(NAMES, found[0]).to_json())
    assert np.array_equal(again.predict(x), found[0][0].predict(x))


def test_interactions_early_stop_and_groups(spark):
    x, y, mu, rate = data(3, 3000)
    valid = np.arange(len(x)) % 5 == 0
    df = frame(spark, x, y, mu, valid)
    cuts = tr.quantile_cuts(df, NAMES, 32)
    table = tr.binned(df, NAMES, cuts, valid=F.col("valid")).persist()
    found = tr.grow(table, NAMES, cuts, 2, tr.Settings(trees=12, shrink=0.5, leaves=8, depth=3, least_rows=20))
    assert 1 <= len(found[0]) <= 12
    for k in range(2):
        p = np.exp(sum(t.predict(x) for t in found[k]))
        assert np.corrcoef(p[valid], rate[valid, k])[0, 1] > 0.9
    p = np.exp(sum(t.predict(np.array([[a, b, 0.0] for a in (-1, 1) for b in (-1, 1)])) for t in found[0]))
    assert p[3] / p[2] > 3 and 0.8 < p[1] / p[0] < 1.25  # b matters only where a is high
    apart = tr.grow(table, NAMES, cuts, 1, tr.Settings(trees=2, leaves=8, depth=3, groups=[[0], [1], [2]]))
    assert all(len({f for f, *_ in path}) == 1 for t in apart[0] for _, path in t.paths())
    noise = frame(spark, x, np.random.default_rng(1).poisson(mu).astype(float), mu, valid)
    few = tr.grow(tr.binned(noise, NAMES, cuts, valid=F.col("valid")).persist(), NAMES, cuts, 2, tr.Settings(trees=30, shrink=1.0, leaves=31, least_rows=5))
    assert max(map(len, few)) < 5
    assert tr.grow(table.where("false"), NAMES, cuts, 2) == [[], []]


def some_trees(n, seed):
    """Random trees of uneven depth that use features more than once."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        nodes, todo = [], [(0, 100.0)]
        nodes.append(None)
        while todo:
            i, cover = todo.pop()
            if cover < 8 or (i and rng.random() < 0.2):
                nodes[i] = [-1, 0.0, True, -1, -1, rng.normal(), cover]
                continue
            share = rng.uniform(0.2, 0.8)
            nodes[i] = [int(rng.integers(4)), rng.normal() * 0.7, bool(rng.random() < 0.5), len(nodes), len(nodes) + 1, 0.0, cover]
            todo += [(len(nodes), cover * share), (len(nodes) + 1, cover * (1 - share))]
            nodes += [None, None]
        out.append(tr.Tree.of(nodes))
    return out


def test_shapley_values(spark):
    found = some_trees(3, 8)
    rng = np.random.default_rng(9)
    x, back = rng.normal(size=(12, 4)), rng.normal(size=(7, 4))
    x[0, 1] = back[2, 3] = np.nan
    a, b = tr.path_dependent(found, x, 4), tr.interventional(found, x, back, 4)
    for i in range(len(x)):
        assert np.allclose(a[i], tr.by_subsets(found, x[i], None, 4))
        assert np.allclose(b[i], tr.by_subsets(found, x[i], back, 4))
    whole = sum(t.predict(x) for t in found)
    assert np.allclose(b.sum(axis=1), whole - np.mean(sum(t.predict(back) for t in found)))
    loci = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[1:])], "locus long, p double, q double, r double, s double")
    rows = tr.attributions(loci, ["m"], [tr.TreeRate(list("pqrs"), found)], background=5).collect()
    assert len(rows) == 4 * 11
    some = [r.locus for r in loci.orderBy(F.xxhash64("locus"), "locus").limit(5).collect()]
    want = tr.interventional(found, x[1:], x[1:][some], 4)
    assert all(abs(r.effect - want[r.locus, "pqrs".index(r.feature)]) < 1e-9 for r in rows)


def test_training_with_trees(spark):
    """Loci whose rate depends on two features together: trees find it, a linear effect can't."""
    from genolith.plans import topography as tp

    rng = np.random.default_rng(6)
    n = 400
    x = rng.normal(size=(n, 2))
    high = (x[:, 0] > 0) ^ (x[:, 1] > 0)
    spectra = {"p": [0.8, 0.1, 0.1], "q": [0.1, 0.1, 0.8]}
    theta = {"p": np.where(high, 1.5, 0.0), "q": np.zeros(n)}
    seen = []
    for s in range(6):
        for i in range(n):
            for c, name in enumerate("ABC"):
                rate = sum(w * spectra[k][c] * np.exp(theta[k][i]) for k, w in (("p", 1 + s % 3), ("q", 3 - s % 3)))
                m = rng.poisson(rate)
                if m:
                    seen.append((s, i, 0, name, float(m)))
    loci = spark.createDataFrame([(i, 1.0, float(a), float(b)) for i, (a, b) in enumerate(x)], "locus long, exposure double, f double, g double").cache()
    freq = spark.createDataFrame([(i, 0, c, 1.0) for i in range(n) for c in "ABC"], "locus long, configuration int, context string, freq double").cache()
    obs = spark.createDataFrame(seen, "sample int, locus long, configuration int, context string, weight double").cache()
    fixed = {k: dict(zip("ABC", v, strict=True)) for k, v in spectra.items()}
    m = tp.fit(obs, freq, loci, ["f", "g"], 2, epochs=2, locus_model="boosted", fixed=fixed, rounds=4, tree_settings=tr.Settings(trees=8, shrink=0.5, leaves=6, depth=3, least_rows=10))
    p = m.rates[0].predict(x)
    assert p[high].mean() - p[~high].mean() > 1.0 and len(m.rates[0].trees) > 1
    phi = m.attributions(loci, background=50).where("component = 'p'").groupBy("locus").agg(F.sum("effect").alias("e")).collect()
    some = [r.locus for r in loci.orderBy(F.xxhash64("locus"), "locus").limit(50).collect()]
    assert np.allclose([r.e for r in phi], p[[r.locus for r in phi]] - p[some].mean())
