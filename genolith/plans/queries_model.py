"""Registered queries of the factor model, the locus models and the sampler. A single tree has SQL; what iterates has none, tests compare it with numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from genolith.operators.tensor import dealt_join
from genolith.plans import model as md
from genolith.plans import sampling, trees
from genolith.plans import topography as tp
from genolith.plans.queries_tensor import _q, regions, tensor
from genolith.plans.queries_topography import _seen, estep_contributions, freq, observations, state_model

NAMES = ["c0", "c1", "c2"]


CONTEXTS = ["AF", "AO", "NF", "NO", "RF", "RO"]


def factor_model(spark, d):
    return md.fit(tensor(spark, d), 2, seed=3).spectra_table(spark)


def _loci(spark, d):
    w = tensor(spark, d).groupBy("locus").agg(F.sum("weight").alias("y"))
    return dealt_join(regions(spark, d), w, "locus").withColumns({"w": F.lit(1.0), "a": F.col("length") / 50, "b": F.col("value") / 1000})


def linear_locus_model(spark, d):
    m = md.linear_locus_model(_loci(spark, d), ["a", "b"], "y", "w")
    return spark.createDataFrame([(n, float(c)) for n, c in zip(["a", "b"], m.coefficients, strict=True)], "feature string, coefficient double")


def boosted_locus_model(spark, d):
    m = md.boosted_locus_model(_loci(spark, d), ["a", "b"], "y", "w")
    return _loci(spark, d).select("locus", m.log_rate().alias("log_rate"))


CUTS = {"a": [0.2, 0.4, 0.6, 0.8], "b": [1.1, 1.3, 1.5, 1.7]}


def grown_tree(spark, d):
    """One tree of three leaves, grown best leaf first on fixed cuts."""
    rows = _loci(spark, d).withColumns({"y_": F.array(F.col("y").cast("double")), "mu_": F.array(F.lit(1.0))})
    cuts = list(CUTS.values())
    table = tp._cut(trees.binned(rows, list(CUTS), cuts, "y_", "mu_"))
    found = trees.grow(table, list(CUTS), cuts, 1, trees.Settings(trees=1, shrink=1.0, leaves=3, depth=2, least_rows=30, l2=1.0))
    rate = trees.TreeRate(list(CUTS), found[0])
    return _loci(spark, d).select("locus", F.round(rate.log_rate(), 9).alias("log_rate"))


def gibbs_contributions(spark, d):
    """Means of draws of the topography model's counts: repeatable, since all randomness is hashed; tests compare the sampler with enumeration."""
    m, seen = _seen(spark, d)
    return sampling.gibbs_contributions(m, sampling.gibbs_draws(m, seen, steps=6, warmup=4))


def state_spectra(spark, d):
    """Elastic-net effects of genome states on spectra after one round of training; tests check the regression's optimality."""
    m, wide = state_model(spark, d)
    return tp.fit(observations(spark, d), freq(spark, d), wide, ["f", "g"], 3, epochs=1, seed=2, states=m.states).state_summary(spark)


def simulate(spark, d):
    spectra = np.array([[(1.0 + (i * 7 + j * 3) % 5) for j in range(len(CONTEXTS))] for i in range(3)])
    return md.simulate(estep_contributions(spark, d), spectra / spectra.sum(axis=1, keepdims=True), NAMES, CONTEXTS, seed=5)


QUERIES = {f.__name__: f for f in (factor_model, linear_locus_model, boosted_locus_model, grown_tree, gibbs_contributions, state_spectra, simulate)}


def _splits(rows: str, keys: str) -> str:
    """The gain of every allowed split of each node, from rows (locus, node, f, x, g, h)."""
    both = "gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1)"
    return f"SELECT *, round({both}, 9) AS gain FROM (SELECT {keys}, f, cut, sum(CASE WHEN x <= cut THEN g ELSE 0 END) AS gl, sum(CASE WHEN x <= cut THEN h ELSE 0 END) AS hl, count(*) FILTER (x <= cut) AS nl, sum(g) AS tg, sum(h) AS th, count(*) AS n FROM {rows} JOIN ct USING (f) GROUP BY {keys}, f, cut) WHERE nl >= 30 AND n - nl >= 30"


_CUTS = ", ".join(f"('{f}', {c})" for f, cuts in CUTS.items() for c in cuts)
ORACLE: dict[str, str] = {
    "grown_tree": _q(f"""lw AS (SELECT locus, sum(weight) AS y FROM tn GROUP BY locus), ba AS (SELECT rg.locus, length / 50 AS a, value / 1000 AS b, y FROM rg JOIN lw USING (locus)),
gh AS (SELECT *, y - avg(y) OVER () AS g, avg(y) OVER () AS h FROM ba), ct(f, cut) AS (VALUES {_CUTS}),
e AS (SELECT locus, 'a' AS f, a AS x, g, h, 0 AS node FROM gh UNION ALL SELECT locus, 'b', b, g, h, 0 FROM gh),
s1 AS ({_splits('e', 'node')}), b1 AS (SELECT f, cut FROM s1 WHERE gain > 0 ORDER BY gain DESC, f, cut LIMIT 1),
n1 AS (SELECT locus, CASE WHEN x <= cut THEN 1 ELSE 2 END AS node FROM e JOIN b1 USING (f)),
e1 AS (SELECT e.locus, f, x, g, h, n1.node FROM e JOIN n1 USING (locus)),
s2 AS ({_splits('e1', 'node')}), b2 AS (SELECT node, f, cut FROM s2 WHERE gain > 0 ORDER BY gain DESC, node, f, cut LIMIT 1),
n2 AS (SELECT e1.locus, CASE WHEN e1.node <> b2.node THEN e1.node WHEN x <= cut THEN 3 ELSE 4 END AS leaf, g, h FROM e1 JOIN b2 USING (f))""",
        "SELECT locus, round(sum(g) OVER w / (sum(h) OVER w + 1), 9) AS log_rate FROM n2 WINDOW w AS (PARTITION BY leaf)"),
}
