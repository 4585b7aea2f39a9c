"""Registered queries of the topography model with fixed parameters, each with its SQL: the tensor view over lineitem, loci from part.

Frequencies: p_size + 2 * configuration + rank of the context; exposure p_retailprice / 1000; features f = p_size / 50 and g = (p_partkey % 7) / 7.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolith.operators.tensor import kept
from genolith.plans import states as st
from genolith.plans import topography as tp
from genolith.plans.queries_tensor import regions, tensor

NAMES = ["c0", "c1", "c2"]
CONTEXTS = ["AF", "AO", "NF", "NO", "RF", "RO"]
EFFECTS = np.array([[((i * 7 + j * 3) % 5) / 4 for j in range(6)] for i in range(3)])
COEFFICIENTS = [{"f": 0.3 * i - 0.2, "g": 0.5 - 0.4 * i} for i in range(3)]
ALPHA = np.array([1.0, 1.5, 2.0])
ROUNDS = 3


def loci(spark, d) -> DataFrame:
    return regions(spark, d).select("locus", (F.col("value") / 1000).alias("exposure"), (F.col("length") / 50).alias("f"), (F.col("locus") % 7 / 7).alias("g"))


def freq(spark, d) -> DataFrame:
    grid = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(c).alias("c"), F.lit(i).alias("i")) for o in (0, 1) for i, c in enumerate(CONTEXTS)])
    rows = regions(spark, d).select("locus", "length", F.explode(grid).alias("x"))
    return rows.select("locus", F.col("x.o").alias("configuration"), F.col("x.c").alias("context"), (F.col("length") + 2 * F.col("x.o") + F.col("x.i")).cast("double").alias("freq"))


def observations(spark, d) -> DataFrame:
    return tensor(spark, d).groupBy("sample", *tp.CELL).agg(F.sum("weight").alias("weight"))


def model(spark, d, rates: bool = True) -> tp.Topography:
    m = tp.Topography(NAMES, CONTEXTS, EFFECTS, [tp.LinearRate(c) for c in COEFFICIENTS] if rates else [], ALPHA, np.zeros(3))
    m.log_norm = m.normalizers(freq(spark, d), loci(spark, d))
    return m


def _out(m, rows, column, keys):
    return m.named(rows, column, keys).withColumn("value", F.round("value", 9))


def topography_normalizers(spark, d):
    return spark.createDataFrame([(n, round(float(z), 9)) for n, z in zip(NAMES, model(spark, d).log_norm, strict=True)], "component string, value double")


def context_only_normalizers(spark, d):
    return spark.createDataFrame([(n, round(float(z), 9)) for n, z in zip(NAMES, model(spark, d, False).log_norm, strict=True)], "component string, value double")


def exposure_offsets_context(spark, d):
    m = model(spark, d)
    return _out(m, m.context_offsets(freq(spark, d), loci(spark, d)), "offset", ["context"])


def exposure_offsets_locus(spark, d):
    m = model(spark, d)
    return _out(m, m.locus_offsets(freq(spark, d), loci(spark, d)), "offset", ["locus"])


def _seen(spark, d):
    m = model(spark, d)
    return m, m.observed(observations(spark, d), freq(spark, d), loci(spark, d))


def _kept(spark, d):
    """The same for what goes over the observations again and again: they are joined once, and no pass shuffles them by sample."""
    m, seen = _seen(spark, d)
    seen = kept(seen)
    return m, seen, m.few(seen)


def observation_likelihood(spark, d):
    m, seen = _seen(spark, d)
    return _out(m, seen.withColumn("like", F.transform("like", lambda x: F.ln(x))), "like", ["sample", *tp.CELL])


def estep_contributions(spark, d):
    m, seen, few = _kept(spark, d)
    return _out(m, m.estep(seen, rounds=ROUNDS, few=few), "nk", ["sample"])


def _phi(spark, d):
    m, seen, few = _kept(spark, d)
    return m, m.posteriors(seen, m.estep(seen, rounds=ROUNDS, few=few), few)


def component_posteriors(spark, d):
    m, phi = _phi(spark, d)
    return _out(m, phi, "phi", ["sample", *tp.CELL])


def context_statistics(spark, d):
    m, phi = _phi(spark, d)
    return _out(m, m.context_stats(phi), "value", ["context"])


def locus_statistics(spark, d):
    m, phi = _phi(spark, d)
    return _out(m, m.locus_stats(phi), "value", ["locus"])


def marginal_prediction(spark, d):
    m, seen, few = _kept(spark, d)
    return m.marginal_prediction(freq(spark, d), loci(spark, d), m.estep(seen, rounds=ROUNDS, few=few)).withColumn("value", F.round("value", 9))


def component_distributions(spark, d):
    m = model(spark, d)
    return m.component_distributions(freq(spark, d), loci(spark, d))[0].withColumn("value", F.round("value", 9))


def component_locus_rates(spark, d):
    m = model(spark, d)
    return m.component_distributions(freq(spark, d), loci(spark, d))[1].withColumn("value", F.round("value", 9))


def shap_values(spark, d):
    m = model(spark, d)
    return m.attributions(loci(spark, d)).withColumns({"value": F.round("value", 9), "effect": F.round("effect", 9)})


def component_spectra(spark, d):
    m = model(spark, d)
    have = freq(spark, d).groupBy("context").agg(F.sum("freq").alias("value"))
    return m.spectra(spark, "global", have).withColumn("value", F.round("value", 9))


def deviance_score(spark, d):
    m, seen, few = _kept(spark, d)
    return spark.createDataFrame([(round(m.deviance(seen, m.estep(seen, rounds=ROUNDS, few=few), freq(spark, d), loci(spark, d), few), 9),)], "score double")


def mixture_estep(spark, d):
    both = {"p": model(spark, d), "q": model(spark, d, False)}
    seen = tp.source_like(both, {s: (freq(spark, d), loci(spark, d)) for s in both}, observations(spark, d))
    mixture = tp.Mixture(["p", "q"], NAMES, ALPHA, np.array([1.0, 2.0]))
    return mixture.named(mixture.estep(seen, rounds=2)).withColumn("value", F.round("value", 9))


STATES = st.States(["strand"], {"arm": [".", "p", "q"]})


def state_model(spark, d, stranded: bool = True) -> tuple[tp.Topography, DataFrame]:
    """The model with states of a strand feature (p_partkey % 3 - 1) and an arm (by p_partkey % 5), and its loci."""
    wide = loci(spark, d).withColumns({"strand": F.col("locus") % 3 - 1, "arm": F.when(F.col("locus") % 5 == 0, "p").when(F.col("locus") % 5 == 1, "q").otherwise(".")})
    r = len(STATES.names())
    shared = np.array([[0.1 * ((i + j) % 3) for j in range(r)] for i in range(3)])
    interactions = np.array([[[0.2 * ((i + 2 * c + j) % 3 == 0) for j in range(r)] for c in range(6)] for i in range(3)])
    m = tp.Topography(NAMES, CONTEXTS, EFFECTS, [tp.LinearRate(c) for c in COEFFICIENTS], ALPHA, np.zeros(3), states=STATES, shared=shared, interactions=interactions, stranded=stranded)
    m.log_norm = m.normalizers(freq(spark, d), wide)
    return m, wide


def state_offsets(spark, d):
    m, wide = state_model(spark, d)
    return _out(m, m.context_offsets(freq(spark, d), wide), "offset", ["context", "state"]).withColumns({"state": F.col("state").cast("long"), "value": F.round("value", 5)})  # sums of thousands: the order of adding shows in the ninth digit


def state_likelihood(spark, d):
    m, wide = state_model(spark, d)
    seen = m.observed(observations(spark, d), freq(spark, d), wide)
    return _out(m, seen.withColumn("like", F.transform("like", lambda x: F.ln(x))), "like", ["sample", *tp.CELL])


def unstranded_state_statistics(spark, d):
    m, wide = state_model(spark, d, False)
    seen = kept(m.observed(observations(spark, d), freq(spark, d), wide))
    few = m.few(seen)
    return _out(m, m.context_stats(m.posteriors(seen, m.estep(seen, rounds=1, few=few), few)), "value", ["context", "state"]).withColumns({"state": F.col("state").cast("long"), "value": F.round("value", 5)})


def topography_model(spark, d):
    """Trained with the production defaults; no SQL, tests recover a simulated model."""
    m = tp.fit(observations(spark, d), freq(spark, d), loci(spark, d), ["f", "g"], 3, seed=2)
    return m.spectra(spark)


_ALL = (topography_normalizers, context_only_normalizers, exposure_offsets_context, exposure_offsets_locus, observation_likelihood, estep_contributions, component_posteriors, context_statistics, locus_statistics, marginal_prediction, component_distributions, component_locus_rates, shap_values, component_spectra, deviance_score, mixture_estep, state_offsets, state_likelihood, unstranded_state_statistics, topography_model)
QUERIES = {f.__name__: f for f in _ALL}


def _digamma(x: str) -> str:
    y = f"({x} + 6)"
    return f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - " + " - ".join(f"1 / ({x} + {i})" for i in range(6)) + ")"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" for x in r) + ")" for r in rows)


_BASE = f"""WITH ef(component, context, effect) AS (VALUES {_values((n, c, float(EFFECTS[i, j])) for i, n in enumerate(NAMES) for j, c in enumerate(CONTEXTS))}),
co(component, cf, cg, a) AS (VALUES {_values((n, COEFFICIENTS[i]['f'], COEFFICIENTS[i]['g'], float(ALPHA[i])) for i, n in enumerate(NAMES))}),
cx(context, i) AS (VALUES {_values((c, float(i)) for i, c in enumerate(CONTEXTS))}),
fr AS (SELECT p_partkey AS locus, configuration, context, (p_size + 2 * configuration + i)::DOUBLE AS freq FROM part, (VALUES (0), (1)) o(configuration), cx),
lo AS (SELECT p_partkey AS locus, p_retailprice / 1000 AS exposure, p_size / 50 AS f, p_partkey % 7 / 7 AS g FROM part),
ra AS (SELECT fr.*, exposure, component, cf * f + cg * g AS theta, effect, freq * exposure * exp(effect + cf * f + cg * g) AS rate FROM fr JOIN lo USING (locus) JOIN ef USING (context) JOIN co USING (component)),
nz AS (SELECT component, ln(sum(rate)) AS z FROM ra GROUP BY ALL),
ob AS (SELECT l_suppkey % 20 AS sample, l_partkey AS locus, l_linenumber % 2 AS configuration, l_returnflag || l_linestatus AS context, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL),
ol AS (SELECT ob.*, component, exp(ln(rate) - z) AS l FROM ob JOIN ra USING (locus, configuration, context) JOIN nz USING (component)),
n0 AS (SELECT sample, component, sum(weight) / 3 AS n FROM ol GROUP BY ALL)"""


def _round(r: int) -> str:
    e = f"e{r} AS (SELECT sample, component, exp({_digamma('(n + a)')}) AS e FROM n{r - 1} JOIN co USING (component))"
    t = f"t{r} AS (SELECT sample, locus, configuration, context, sum(e * l) AS total FROM ol JOIN e{r} USING (sample, component) GROUP BY ALL)"
    p = f"p{r} AS (SELECT ol.*, total, e * l * weight / total AS phi FROM ol JOIN e{r} USING (sample, component) JOIN t{r} USING (sample, locus, configuration, context))"
    return f"{e}, {t}, {p}, n{r} AS (SELECT sample, component, sum(phi) AS n FROM p{r} GROUP BY ALL)"


_STEPS = ", ".join(_round(r) for r in range(1, ROUNDS + 2))  # the last round gives the posteriors
_AFTER = f"{_BASE}, {_STEPS}"
_CELLS = "sample, locus, configuration, context"
_MIX = f"""nq AS (SELECT component, ln(sum(freq * exposure * exp(effect))) AS z FROM ra GROUP BY ALL),
ml AS (SELECT ob.*, source, component, CASE WHEN source = 'p' THEN exp(ln(rate) - nz.z) ELSE exp(ln(freq * exposure * exp(effect)) - nq.z) END AS l FROM ob JOIN ra USING (locus, configuration, context) JOIN nz USING (component) JOIN nq USING (component), (VALUES ('p'), ('q')) s(source)),
ta(source, tau) AS (VALUES ('p', 1.0::DOUBLE), ('q', 2.0::DOUBLE)),
m0 AS (SELECT sample, source, component, sum(weight) / 6 AS n FROM ml GROUP BY ALL)"""


def _mix_round(r: int) -> str:
    s = f"s{r} AS (SELECT *, sum(n) OVER (PARTITION BY sample, component) AS nc, sum(n) OVER (PARTITION BY sample, source) AS nd FROM m{r - 1})"
    e = f"f{r} AS (SELECT sample, source, component, exp({_digamma('(nc + a)')} + {_digamma('(nd + tau)')}) AS e FROM s{r} JOIN co USING (component) JOIN ta USING (source))"
    t = f"u{r} AS (SELECT {_CELLS}, sum(e * l) AS total FROM ml JOIN f{r} USING (sample, source, component) GROUP BY ALL)"
    return f"{s}, {e}, {t}, m{r} AS (SELECT sample, source, component, sum(e * l * weight / total) AS n FROM ml JOIN f{r} USING (sample, source, component) JOIN u{r} USING ({_CELLS}) GROUP BY ALL)"


# states: strand and arm of a locus, features strand:-1, strand:1, arm:p, arm:q in this order
_STATES = f"""{_BASE}, fe(j, name) AS (VALUES (0, 'strand:-1'), (1, 'strand:1'), (2, 'arm:p'), (3, 'arm:q')),
ck(component, k) AS (VALUES ('c0', 0), ('c1', 1), ('c2', 2)),
cs AS (SELECT fr.locus, configuration, context, cx.i AS i, freq, exposure, CASE WHEN configuration = 1 THEN 1 - fr.locus % 3 ELSE fr.locus % 3 - 1 END AS strand, CASE fr.locus % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS arm FROM fr JOIN lo USING (locus) JOIN cx USING (context)),
se AS (SELECT cs.locus, configuration, context, component, (strand + 1) * 3 + arm AS state, ra.theta, freq * cs.exposure AS base, ra.effect
    + CASE strand WHEN -1 THEN 0.1 * (k % 3) + 0.2 * (CASE WHEN (k + 2 * i) % 3 = 0 THEN 1 ELSE 0 END) WHEN 1 THEN 0.1 * ((k + 1) % 3) + 0.2 * (CASE WHEN (k + 2 * i + 1) % 3 = 0 THEN 1 ELSE 0 END) ELSE 0 END
    + CASE arm WHEN 1 THEN 0.1 * ((k + 2) % 3) + 0.2 * (CASE WHEN (k + 2 * i + 2) % 3 = 0 THEN 1 ELSE 0 END) WHEN 2 THEN 0.1 * ((k + 3) % 3) + 0.2 * (CASE WHEN (k + 2 * i + 3) % 3 = 0 THEN 1 ELSE 0 END) ELSE 0 END AS full_effect
    FROM cs JOIN ra USING (locus, configuration, context, freq) JOIN ck USING (component))"""


ORACLE = {
    "state_offsets": f"{_STATES} SELECT context, state::BIGINT AS state, component, round(sum(base * exp(theta)), 5) AS value FROM se GROUP BY ALL",
    "state_likelihood": f"""{_STATES}, sz AS (SELECT component, ln(sum(base * exp(theta + full_effect))) AS z FROM se GROUP BY ALL)
SELECT sample, locus, configuration, context, component, round(ln(base) + theta + full_effect - z, 9) AS value FROM ob JOIN se USING (locus, configuration, context) JOIN sz USING (component)""",
    "unstranded_state_statistics": f"""{_STATES}, su AS (SELECT locus, context, component, state, theta, full_effect, sum(base) OVER (PARTITION BY locus, context, component) AS base, configuration FROM se QUALIFY configuration = 0),
sz AS (SELECT component, ln(sum(base * exp(theta + full_effect))) AS z FROM su GROUP BY ALL),
so AS (SELECT sample, locus, context, sum(weight) AS weight FROM ob GROUP BY ALL),
sl AS (SELECT so.*, component, state, exp(ln(base) + theta + full_effect - z) AS l FROM so JOIN su USING (locus, context) JOIN sz USING (component)),
s0 AS (SELECT sample, component, sum(weight) / 3 AS n FROM sl GROUP BY ALL), s1 AS (SELECT sample, component, exp({_digamma('(n + a)')}) AS e FROM s0 JOIN co USING (component)),
s2 AS (SELECT *, e * l AS p, sum(e * l) OVER (PARTITION BY sample, locus, context) AS t FROM sl JOIN s1 USING (sample, component)),
s3 AS (SELECT sample, component, sum(p * weight / t) AS n FROM s2 GROUP BY ALL), s4 AS (SELECT sample, component, exp({_digamma('(n + a)')}) AS e FROM s3 JOIN co USING (component)),
s5 AS (SELECT sl.*, e * l AS p, sum(e * l) OVER (PARTITION BY sample, locus, context) AS t FROM sl JOIN s4 USING (sample, component))
SELECT context, state::BIGINT AS state, component, round(sum(p * weight / t), 5) AS value FROM s5 GROUP BY ALL""",
    "topography_normalizers": f"{_BASE} SELECT component, round(z, 9) AS value FROM nz",
    "context_only_normalizers": f"{_BASE} SELECT component, round(ln(sum(freq * exposure * exp(effect))), 9) AS value FROM ra GROUP BY component",
    "exposure_offsets_context": f"{_BASE} SELECT context, component, round(sum(freq * exposure * exp(theta)), 9) AS value FROM ra GROUP BY ALL",
    "exposure_offsets_locus": f"{_BASE} SELECT locus, component, round(exposure * sum(freq * exp(effect)), 9) AS value FROM ra GROUP BY locus, component, exposure",
    "observation_likelihood": f"{_BASE} SELECT {_CELLS}, component, round(ln(l), 9) AS value FROM ol",
    "estep_contributions": f"{_AFTER} SELECT sample, component, round(n, 9) AS value FROM n{ROUNDS}",
    "component_posteriors": f"{_AFTER} SELECT {_CELLS}, component, round(phi, 9) AS value FROM p{ROUNDS + 1}",
    "context_statistics": f"{_AFTER} SELECT context, component, round(sum(phi), 9) AS value FROM p{ROUNDS + 1} GROUP BY ALL",
    "locus_statistics": f"{_AFTER} SELECT locus, component, round(sum(phi), 9) AS value FROM p{ROUNDS + 1} GROUP BY ALL",
    "marginal_prediction": f"{_AFTER}, tw AS (SELECT component, sum(n + a) AS w FROM n{ROUNDS} JOIN co USING (component) GROUP BY ALL) SELECT locus, configuration, context, round(sum(exp(ln(rate) + ln(w) - z)), 9) AS value FROM ra JOIN tw USING (component) JOIN nz USING (component) GROUP BY ALL",
    "component_distributions": f"{_BASE} SELECT locus, configuration, context, component, round(rate / freq / max(rate / freq) OVER (PARTITION BY component), 9) AS value FROM ra",
    "component_locus_rates": f"{_BASE} SELECT locus, component, round(sum(rate) / sum(freq), 9) AS value FROM ra GROUP BY ALL",
    "shap_values": f"{_BASE} SELECT locus, component, 'f' AS feature, round(f, 9) AS value, round(cf * (f - avg(f) OVER (PARTITION BY component)), 9) AS effect FROM lo, co UNION ALL SELECT locus, component, 'g', round(g, 9), round(cg * (g - avg(g) OVER (PARTITION BY component)), 9) FROM lo, co",
    "component_spectra": f"{_BASE}, x AS (SELECT component, context, exp(effect) * s AS p FROM ef JOIN (SELECT context, sum(freq) AS s FROM fr GROUP BY ALL) USING (context)) SELECT component, context, round(p / sum(p) OVER (PARTITION BY component), 9) AS value FROM x",
    "deviance_score": f"""{_AFTER}, sh AS (SELECT sample, component, (n + a) / sum(n + a) OVER (PARTITION BY sample) AS v FROM n{ROUNDS} JOIN co USING (component)),
ba AS (SELECT locus, configuration, context, freq * exposure / sum(freq * exposure) OVER () AS b FROM fr JOIN lo USING (locus)),
fi AS (SELECT {_CELLS}, weight AS w, sum(v * l) AS fit FROM ol JOIN sh USING (sample, component) GROUP BY {_CELLS}, weight),
pe AS (SELECT sample, sum(w * ln(w)) - sum(w) * ln(sum(w)) AS sat, sum(w * ln(fit)) AS fit, sum(w * ln(b)) AS nul FROM fi JOIN ba USING (locus, configuration, context) GROUP BY sample)
SELECT round(1 - sum(sat - fit) / sum(sat - nul), 9) AS score FROM pe""",
    "mixture_estep": f"{_BASE}, {_MIX}, {_mix_round(1)}, {_mix_round(2)} SELECT sample, source, component, round(n, 9) AS value FROM m2",
}
