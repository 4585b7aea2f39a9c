"""The topography model: components with a context spectrum and a locus rate, trained by stochastic variational inference.

A cell is (locus, configuration, context). Component k gives it the rate exposure * freq * exp(context effect + locus effect) / normalizer, so each component is a
distribution over cells. Per-sample variables are arrays of K numbers in a table (sample, nk); everything that touches cells is joins and
map-side combined sums of K columns, so no sample and no locus is ever gathered in one task. The driver holds K x contexts and K x features numbers only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.operators.tensor import cut as _cut
from genolith.operators.tensor import dealt_join, kept
from genolith.plans import states as st
from genolith.plans import trees
from genolith.plans.model import BoostedModel, alpha_from_target, convex_update, init_from_signatures, learning_rate, should_stop
from genolith.plans.model import digamma as _digamma
from genolith.plans.trees import TreeRate

CELL = ("locus", "configuration", "context")
#: Up to so many samples their variables go to every task; beyond, they meet the cells in a shuffle.
FEW_SAMPLES = 20_000
#: Up to so many numbers in the groups that training goes over, epochs run on the driver; beyond, Spark takes the same steps.
FEW_NUMBERS = 4_000_000


def digamma(x: Column) -> Column:
    """Digamma of a positive column: six steps of the recurrence, then the asymptotic series (error below 1e-9)."""
    y = x + 6
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y**4) - 1 / (252 * y**6)
    return series - reduce(add, [1 / (x + i) for i in range(6)])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _sums(values: Column, k: int) -> Column:
    """Element-wise sum of arrays of k numbers over a group; one plain sum for each element, so it is combined before the shuffle."""
    return F.array(*[F.sum(F.get(values, i)) for i in range(k)])


def _each(k: int, value: Callable[[int], Column]) -> Column:
    """Array of k numbers; plain arithmetic for each, which Spark compiles where lambdas over arrays are interpreted."""
    return F.array(*[value(i) for i in range(k)])


@dataclass
class LinearRate:
    """Locus effect: sum of coefficient times feature."""

    coefficients: dict[str, float]

    def log_rate(self) -> Column:
        return reduce(add, [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * c for f, c in self.coefficients.items()], F.lit(0.0))

    def blend(self, new: LinearRate, rate: float) -> LinearRate:
        old = np.array([self.coefficients.get(f, 0.0) for f in new.coefficients])
        mixed = convex_update(old, np.array(list(new.coefficients.values())), rate)
        return LinearRate(dict(zip(new.coefficients, map(float, mixed), strict=True)))

    def features(self) -> list[str]:
        return list(self.coefficients)

    def attributions(self, means: dict[str, float]) -> dict[str, Column]:
        """Exact Shapley values of a linear effect: coefficient times the distance from the mean."""
        return {f: (F.col(f) - means[f]) * c for f, c in self.coefficients.items()}


@dataclass
class Topography:
    """A fitted model. effects: K x contexts log effects; rates: one locus model for each component, or none (context-only model)."""

    components: list[str]
    contexts: list[str]
    effects: np.ndarray
    rates: list[LinearRate | BoostedModel | TreeRate]
    alpha: np.ndarray
    log_norm: np.ndarray
    scores: list[float] = field(default_factory=list)
    #: Genome states with their effects (K x features, K x contexts x features), and whether the two configurations of a locus are told apart.
    states: st.States | None = None
    shared: np.ndarray | None = None
    interactions: np.ndarray | None = None
    stranded: bool = True

    @property
    def k(self) -> int:
        return len(self.components)

    @property
    def _strata(self) -> list[str]:
        """Columns that context effects depend on."""
        return ["context", "state"] if self.states else ["context"]

    def _effect(self) -> Column:
        """Context effects of a cell: a literal map from context to an array of K numbers, or to one such array for each state."""
        if not self.states:
            pairs = [x for j, c in enumerate(self.contexts) for x in (F.lit(c), F.array(*[F.lit(float(v)) for v in self.effects[:, j]]))]
            return F.try_element_at(F.create_map(*pairs), F.col("context"))
        table = self.state_effects()
        pairs = [x for j, c in enumerate(self.contexts) for x in (F.lit(c), F.array(*[F.array(*[F.lit(float(v)) for v in table[:, j, z]]) for z in range(table.shape[2])]))]
        return F.get(F.try_element_at(F.create_map(*pairs), F.col("context")), F.col("state"))

    def to_json(self) -> str:
        kinds = {LinearRate: ("linear", lambda m: m.coefficients), TreeRate: ("trees", lambda m: m.to_json()), BoostedModel: ("stumps", lambda m: [m.base, m.stumps])}
        rates = [(kinds[type(m)][0], kinds[type(m)][1](m)) for m in self.rates]
        arrays = {n: None if (v := getattr(self, n)) is None else v.tolist() for n in ("effects", "alpha", "log_norm", "shared", "interactions")}
        states = [self.states.strands, self.states.labels] if self.states else None
        return json.dumps(arrays | {"components": self.components, "contexts": self.contexts, "rates": rates, "scores": self.scores, "states": states, "stranded": self.stranded})

    @classmethod
    def from_json(cls, text: str) -> Topography:
        d = json.loads(text)
        make = {"linear": LinearRate, "trees": TreeRate.from_json, "stumps": lambda x: BoostedModel(x[0], [tuple(y) for y in x[1]])}
        arrays = {n: None if d[n] is None else np.array(d[n], float) for n in ("effects", "alpha", "log_norm", "shared", "interactions")}
        states = st.States(*d["states"]) if d["states"] else None
        return cls(d["components"], d["contexts"], arrays["effects"], [make[kind](x) for kind, x in d["rates"]], arrays["alpha"], arrays["log_norm"], d["scores"], states, arrays["shared"], arrays["interactions"], d["stranded"])

    def save(self, spark: SparkSession, path: str) -> None:
        """One row with everything; its size is K x (contexts x states + what the locus effects have)."""
        spark.createDataFrame([(self.to_json(),)], "topography string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Topography:
        return cls.from_json(spark.read.parquet(path).first().topography)

    def state_effects(self) -> np.ndarray:
        """K x contexts x states."""
        design = self.states.design()
        return np.array([st.log_effects(self.effects[i], self.shared[i], self.interactions[i], design) for i in range(self.k)])

    def state_summary(self, spark: SparkSession) -> DataFrame:
        """(component, context, state, value): log effects of the baseline and of each state feature by itself."""
        names = self.states.names() if self.states else []
        none = np.zeros((self.k, len(self.contexts), 0))
        shared, interactions = (self.shared, self.interactions) if self.states else (none[:, 0], none)
        rows = [(n, *r) for i, n in enumerate(self.components) for r in st.state_summary(self.contexts, self.effects[i], shared[i], interactions[i], names)]
        return spark.createDataFrame(rows, "component string, context string, state string, value double")

    def fold(self, rows: DataFrame, value: str) -> DataFrame:
        """Rows of freq or observations as the model sees them: an unstranded model adds up the configurations of a locus."""
        if self.stranded:
            return rows
        keys = [c for c in rows.columns if c not in (value, "configuration")]
        return rows.groupBy(*keys).agg(F.sum(value).alias(value)).withColumn("configuration", F.lit(0))

    @property
    def _grown(self) -> bool:
        return bool(self.rates) and all(isinstance(m, TreeRate) for m in self.rates)

    def _theta(self) -> Column:
        """Locus effects, for rows with the features' columns."""
        return trees.log_rates(self.rates) if self._grown else F.array(*([m.log_rate() for m in self.rates] or [F.lit(0.0)] * self.k))

    def _views(self) -> list[Column]:
        return [self.states.index().alias("plus"), self.states.index(minus=True).alias("minus")] if self.states else []

    def _state(self, rows: DataFrame) -> DataFrame:
        """Rows with the state seen from the configuration."""
        return rows.withColumn("state", F.when(F.col("configuration") == 1, F.col("minus")).otherwise(F.col("plus"))) if self.states else rows

    def locus_rates(self, loci: DataFrame) -> DataFrame:
        """(locus, exposure, theta ARRAY[K]) from loci (locus, exposure, features)."""
        return loci.select("locus", F.col("exposure").cast("double").alias("exposure"), self._theta().alias("theta"), *self._views())

    def _placed(self, freq: DataFrame, loci: DataFrame) -> DataFrame:
        """Rows of freq with a rate, their locus' exposure and theta, and the state seen from the configuration."""
        return self._state(dealt_join(self.fold(freq, "freq").where("freq > 0"), self.locus_rates(loci).where("exposure > 0"), "locus"))

    def cells(self, freq: DataFrame, loci: DataFrame) -> DataFrame:
        """Unnormalised rates of all cells of freq (locus, configuration, context, freq): rate ARRAY[K]. Cells without frequency or exposure have none."""
        rows = self._placed(freq, loci).withColumn("effect", self._effect())
        base = F.col("freq").cast("double") * F.col("exposure")
        return rows.select(*CELL, *self._strata[1:], _each(self.k, lambda i: base * F.exp(F.get("effect", i) + F.get("theta", i))).alias("rate"))

    def normalizers(self, freq: DataFrame, loci: DataFrame) -> np.ndarray:
        """log of each component's sum over all cells."""
        return np.log(np.array(self.cells(freq, loci).agg(_sums(F.col("rate"), self.k)).first()[0], float))

    def context_offsets(self, freq: DataFrame, loci: DataFrame) -> DataFrame:
        """(context, state if there are any, offset ARRAY[K]): exposure-weighted rates without the context effect, summed over loci."""
        return self._placed(freq, loci).groupBy(*self._strata).agg(_sums(_each(self.k, lambda i: F.col("freq") * F.col("exposure") * F.exp(F.get("theta", i))), self.k).alias("offset"))

    def locus_offsets(self, freq: DataFrame, loci: DataFrame) -> DataFrame:
        """(locus, offset ARRAY[K]): exposure-weighted rates without the locus effect, summed over contexts."""
        if self.states:
            rows = self._placed(freq, loci).withColumn("effect", self._effect()).groupBy("locus", "exposure").agg(_sums(_each(self.k, lambda i: F.col("freq") * F.exp(F.get("effect", i))), self.k).alias("o"))
            return rows.select("locus", F.transform("o", lambda o: o * F.col("exposure")).alias("offset"))
        rows = self.fold(freq, "freq").where("freq > 0").withColumn("effect", self._effect()).groupBy("locus").agg(_sums(_each(self.k, lambda i: F.col("freq") * F.exp(F.get("effect", i))), self.k).alias("o"))
        return dealt_join(rows, loci.where("exposure > 0").select("locus", "exposure"), "locus").select("locus", F.transform("o", lambda o: o * F.col("exposure")).alias("offset"))

    def observed(self, observations: DataFrame, freq: DataFrame, loci: DataFrame) -> DataFrame:
        """observations that fall into a cell with a rate, with like ARRAY[K]: each component's probability of the cell."""
        rates = self.cells(freq, loci).withColumn("like", _each(self.k, lambda i: F.exp(F.ln(F.get("rate", i)) - float(self.log_norm[i])))).drop("rate")
        return dealt_join(self.fold(observations, "weight"), rates, list(CELL))

    @staticmethod
    def few(observed: DataFrame) -> bool:
        """Whether the samples' variables may go to every task: then no round shuffles the cells by sample."""
        return observed.select("sample").distinct().count() <= FEW_SAMPLES

    def start(self, observed: DataFrame) -> DataFrame:
        """(sample, nk): the weight of a sample spread evenly over the components."""
        return observed.groupBy("sample").agg(F.array_repeat(F.sum("weight") / self.k, self.k).alias("nk"))

    def _weighted(self, observed: DataFrame, nk: DataFrame, few: bool = False) -> DataFrame:
        e = nk.select("sample", _each(self.k, lambda i: F.exp(digamma(F.get("nk", i) + float(self.alpha[i])))).alias("e"))
        rows = observed.join(F.broadcast(e) if few else e, "sample").withColumn("p", _each(self.k, lambda i: F.get("e", i) * F.get("like", i))).withColumn("total", reduce(add, [F.get("p", i) for i in range(self.k)]))
        return rows.withColumn("phi", _each(self.k, lambda i: F.when(F.col("total") > 0, F.get("p", i) * F.col("weight") / F.col("total")).otherwise(0.0))).drop("e", "p")

    def estep(self, observed: DataFrame, nk: DataFrame | None = None, rounds: int = 20, few: bool = False) -> DataFrame:
        """(sample, nk ARRAY[K]) after so many rounds of the fixed point nk = e * (L (w / (e L))), e = exp(digamma(alpha + nk)). few: there are at most FEW_SAMPLES samples."""
        nk = self.start(observed) if nk is None else nk
        for i in range(rounds):
            nk = self._weighted(observed, nk, few).groupBy("sample").agg(_sums(F.col("phi"), self.k).alias("nk"))
            if i % 5 == 4 and i + 1 < rounds:
                nk = _cut(nk)
        return nk

    def posteriors(self, observed: DataFrame, nk: DataFrame, few: bool = False) -> DataFrame:
        """observed with phi ARRAY[K], the weight that each component explains, and total, the cell's mixture weight."""
        return self._weighted(observed, nk, few)

    def context_stats(self, phi: DataFrame) -> DataFrame:
        return phi.groupBy(*self._strata).agg(_sums(F.col("phi"), self.k).alias("value"))

    def locus_stats(self, phi: DataFrame) -> DataFrame:
        return phi.groupBy("locus").agg(_sums(F.col("phi"), self.k).alias("value"))

    def predict(self, observations: DataFrame, freq: DataFrame, loci: DataFrame, rounds: int = 50) -> DataFrame:
        """(sample, component, value): contributions of each sample."""
        seen = kept(self.observed(observations, freq, loci))
        nk = self.estep(seen, rounds=rounds, few=self.few(seen))
        return self.named(nk, "nk", ["sample"])

    def named(self, rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
        """keys, component and value: one row for each element of an array of K numbers."""
        names = F.array(*map(F.lit, self.components))
        return rows.select(*keys, F.posexplode(column).alias("at", "value")).select(*keys, F.get(names, F.col("at")).alias("component"), "value")

    def deviance(self, observed: DataFrame, nk: DataFrame, freq: DataFrame, loci: DataFrame, few: bool = False) -> float:
        """Explained deviance against a model whose cells have the rate exposure * freq alone. few: there are at most FEW_SAMPLES samples."""
        base = dealt_join(self.fold(freq, "freq").where("freq > 0"), loci.select("locus", "exposure").where("exposure > 0"), "locus").select(*CELL, (F.col("freq") * F.col("exposure")).cast("double").alias("base"))
        total = base.agg(F.sum("base")).first()[0]
        cells = observed.groupBy("sample", *CELL).agg(F.sum("weight").alias("weight"), F.first("like").alias("like"))
        return self._explained(dealt_join(cells, base, list(CELL)), nk, total, few)

    def _explained(self, cells: DataFrame, nk: DataFrame, total: float, few: bool = False) -> float:
        """The same of cells (sample, weight, like, base), one row each, or of groups of them that have `own`; total: the base of all cells."""
        prior = F.array(*[F.lit(float(a)) for a in self.alpha])
        share = nk.withColumn("v", F.zip_with("nk", prior, lambda n, a: n + a)).select("sample", F.transform("v", lambda x: x / _total(F.col("v"))).alias("share"))
        rows = cells.join(F.broadcast(share) if few else share, "sample").withColumn("fit", reduce(add, [F.get("share", i) * F.get("like", i) for i in range(self.k)])).withColumnRenamed("weight", "w")
        own = F.col("own") if "own" in rows.columns else F.col("w") * F.ln("w")
        per = rows.groupBy("sample").agg(F.sum("w").alias("n"), F.sum(own).alias("own"), F.sum(F.col("w") * F.ln("fit")).alias("fit"), F.sum(F.col("w") * F.ln(F.col("base") / total)).alias("null"))
        sat = F.col("own") - F.col("n") * F.ln("n")
        a, b = per.agg(F.sum(sat - F.col("fit")), F.sum(sat - F.col("null"))).first()
        return 1 - a / b if b else 0.0

    # annotations
    def component_distributions(self, freq: DataFrame, loci: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each component's expected share of every cell's rate per base, relative to its largest: (locus, configuration, context, component, value); and the same summed over a locus per unit of length."""
        shares = dealt_join(self.cells(freq, loci), self.fold(freq, "freq"), list(CELL)).withColumn("per", F.transform("rate", lambda r: r / F.col("freq")))
        most = shares.agg(F.array(*[F.max(F.get("per", i)) for i in range(self.k)])).first()[0]
        scale = F.array(*[F.lit(float(m)) for m in most])
        by_cell = self.named(shares.withColumn("x", F.zip_with("per", scale, lambda a, b: a / b)), "x", CELL)
        locus = shares.groupBy("locus").agg(_sums(F.col("rate"), self.k).alias("s"), F.sum("freq").alias("length")).withColumn("x", F.transform("s", lambda s: s / F.col("length")))
        return by_cell, self.named(locus, "x", ["locus"])

    def marginal_prediction(self, freq: DataFrame, loci: DataFrame, nk: DataFrame) -> DataFrame:
        """(locus, configuration, context, value): the expected weight of every cell over all samples, priors included."""
        total = nk.agg(_sums(F.zip_with("nk", F.array(*[F.lit(float(a)) for a in self.alpha]), lambda n, a: n + a), self.k)).first()[0]
        weight = F.array(*[F.lit(math.log(max(t, 1e-300)) - z) for t, z in zip(total, self.log_norm, strict=True)])
        logs = F.zip_with("rate", weight, lambda r, w: F.ln(r) + w)
        rows = self.cells(freq, loci).withColumn("x", logs).withColumn("top", F.array_max("x"))  # shifted by the largest term, so nothing overflows
        return rows.select(*CELL, (F.exp("top") * _total(F.transform("x", lambda x: F.exp(x - F.col("top"))))).alias("value"))

    def attributions(self, loci: DataFrame, background: int = 1_000) -> DataFrame:
        """(locus, component, feature, value, effect): Shapley values of every feature in a component's locus effect.

        Linear effects take the feature's mean over all loci as background. Boosted effects are sums of functions of one feature each, so their exact values are the
        feature's own terms less their mean over at most `background` loci (those with the least hashes of their key). Trees of any depth: see trees.attributions.
        """
        if self.rates and all(isinstance(m, TreeRate) for m in self.rates):
            return trees.attributions(loci, self.components, self.rates, background)
        features = sorted({f for m in self.rates for f in m.features()})
        some = loci.orderBy(F.xxhash64("locus"), "locus").limit(background)
        parts = []
        for name, m in zip(self.components, self.rates, strict=True):
            if isinstance(m, LinearRate):
                means = loci.agg(*[F.avg(f).alias(f) for f in m.coefficients]).first().asDict()
                effects = m.attributions(means)
            else:
                terms = m.terms()
                means = some.agg(*[F.avg(t).alias(f) for f, t in terms.items()]).first().asDict() if terms else {}
                effects = {f: t - F.lit(means[f]) for f, t in terms.items()}
            parts += [F.struct(F.lit(name).alias("component"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), effects.get(f, F.lit(0.0)).cast("double").alias("effect")) for f in features]
        return loci.select("locus", F.explode(F.array(*parts)).alias("x")).select("locus", "x.*") if parts else loci.select("locus", F.lit("").alias("component"), F.lit("").alias("feature"), F.lit(0.0).alias("value"), F.lit(0.0).alias("effect")).where("false")

    def mutation_posteriors(self, mutations: DataFrame, freq: DataFrame, loci: DataFrame, rounds: int = 50) -> DataFrame:
        """mutations (id, sample, locus, configuration, context, weight) with each component's log posterior: (id, sample, component, logp)."""
        seen = kept(self.observed(mutations, freq, loci))
        few = self.few(seen)
        phi = self.posteriors(seen, self.estep(seen, rounds=rounds, few=few), few)
        rows = phi.withColumn("x", F.transform("phi", lambda p: F.when(p > 0, F.ln(p / F.col("weight")))))
        return self.named(rows, "x", ["id", "sample"]).withColumnRenamed("value", "logp")

    def annotate(self, observations: DataFrame, freq: DataFrame, loci: DataFrame, shap: bool = True) -> dict[str, DataFrame]:
        """All annotations of a dataset by name: contributions, spectra, distributions, locus_rates, marginal, empirical and, if asked for, shap."""
        seen = kept(self.observed(observations, freq, loci))
        nk = _cut(self.estep(seen, few=self.few(seen)))
        cells, locus = self.component_distributions(freq, loci)
        out = {"contributions": self.named(nk, "nk", ["sample"]), "spectra": self.spectra(observations.sparkSession), "distributions": cells, "locus_rates": locus, "marginal": self.marginal_prediction(freq, loci, nk)}
        out["empirical"] = observations.groupBy(*CELL).agg(F.sum("weight").alias("value"))
        return out | ({"shap": self.attributions(loci)} if shap and self.rates else {})

    def spectra(self, spark: SparkSession, normalization: str = "none", contexts: DataFrame | None = None) -> DataFrame:
        """(component, context, value): exp of the effects, summing to 1 for each component.

        normalization `global` first multiplies by the genome's context frequencies (contexts: context, value); `none` leaves the effects as they are.
        """
        p = np.exp(self.effects - self.effects.max(axis=1, keepdims=True))
        if normalization == "global":
            have = {r.context: r.value for r in contexts.collect()}  # one row for each context
            p = p * np.array([have.get(c, 0.0) for c in self.contexts])
        p = p / p.sum(axis=1, keepdims=True)
        return spark.createDataFrame([(n, c, float(p[i, j])) for i, n in enumerate(self.components) for j, c in enumerate(self.contexts)], "component string, context string, value double")


def newton_rates(seen: np.ndarray, curve: np.ndarray, features: Sequence[str], old: Sequence[LinearRate], ridge: float = 1.0) -> list[LinearRate]:
    """One Newton step for every component's Poisson regression on features, with an intercept that isn't kept (the normalizer has it).

    With x = (1, features): seen has the sums of x * weight (K x (P + 1)), curve those of x * x' * rate over all cells (K x (P + 1) x (P + 1)).
    """
    out = []
    for y, h, was in zip(seen, curve, old, strict=True):
        h = h * (y[0] / h[0, 0] if h[0, 0] else 0.0)  # the intercept's best value, in closed form
        g = y - h[0]
        now = np.array([0.0, *[was.coefficients.get(f, 0.0) for f in features]])
        penalty = np.diag([1e-9, *[ridge] * len(features)])
        step = np.linalg.solve(h + penalty, g - penalty @ now)
        new = now + step / max(1.0, np.abs(step).max() / 2)  # no coefficient moves by more than 2
        out.append(LinearRate(dict(zip(features, map(float, new[1:]), strict=True))))
    return out


def fit(
    observations: DataFrame, freq: DataFrame, loci: DataFrame, features: Sequence[str], k: int, epochs: int = 30, locus_model: str = "linear", subsample: float = 1.0, rounds: int = 5, seed: int = 0,
    fixed: dict[str, dict[str, float]] | None = None, test: DataFrame | None = None, patience: int = 5, prior: float = 1.0, tau: float = 1.0, kappa: float = 0.5, callback: Callable[[int, float], None] | None = None,
    tree_settings: trees.Settings | None = None, states: st.States | None = None, stranded: bool = True, alpha: float = 1e-4, l1: float = 0.5,
) -> Topography:
    """Train on observations (sample, locus, configuration, context, weight), freq (locus, configuration, context, freq) and loci (locus, exposure, features).

    locus_model: linear, boosted (trees, grown by tree_settings) or none (context-only). subsample: the share of loci that an epoch uses, drawn by a hash of locus and epoch; statistics are scaled up and
    parameters then move by the learning rate (tau + epoch)**-kappa. fixed: spectra by component name that stay as they are. Ends early when the score on `test` (else on the
    training data) hasn't risen for `patience` epochs; callback(epoch, score) follows each epoch. states: strand and label columns of loci whose effects on the spectra are
    learned, with an elastic net of strength alpha and L1 share l1; stranded: whether the configurations of a locus have spectra of their own states, or are added up.
    """
    contexts = sorted(r[0] for r in freq.select("context").distinct().collect())  # the context vocabulary is fixed and small
    fixed = fixed or {}
    names = [*fixed, *[f"M{i}" for i in range(k - len(fixed))]]
    effects = np.random.default_rng(seed).normal(0, 0.3, (len(names), len(contexts)))
    if fixed:
        effects[: len(fixed)] = init_from_signatures(np.array([[v.get(c, 0.0) for c in contexts] for v in fixed.values()]))
    rates: list = [] if locus_model == "none" else [LinearRate(dict.fromkeys(features, 0.0)) for _ in names] if locus_model == "linear" else [TreeRate(list(features)) for _ in names]
    cuts = trees.quantile_cuts(loci, features) if locus_model == "boosted" else []
    model = Topography(names, contexts, effects, rates, np.ones(len(names)), np.zeros(len(names)), states=states, stranded=stranded)
    if states:
        r = len(states.names())
        model.shared, model.interactions = np.zeros((len(names), r)), np.zeros((len(names), len(contexts), r))
    # what no epoch changes is joined once: a cell's base rate, features and state, and the same of each observation
    by_locus = subsample < 1 or locus_model == "boosted"
    store = kept if by_locus else lambda rows: kept(_alike(rows, model))
    cells = kept(_laid(model, freq, loci, features if rates else []))
    laid, data = cells if by_locus else store(cells), store(_met(model, observations, cells))
    held = data if test is None else store(_met(model, test, cells))
    total = laid.agg(F.sum("base")).first()[0]
    numbers = (data.count() + laid.count() + (0 if test is None else held.count())) * (model.k + len(features) + 4)
    if not (by_locus or states) and numbers <= FEW_NUMBERS:
        return _fit_gathered(model, *[_gathered(model, t, features if rates else []) for t in (laid, data)], None if test is None else _gathered(model, held, features if rates else []), total, epochs, rounds, len(fixed), patience, prior, callback)
    few = model.few(data.select("sample").union(held.select("sample")))
    offset = _offsets(model, laid, loci)
    nk = now = None
    for epoch in range(epochs):
        part, scale = (None, 1.0) if subsample >= 1 else (F.pmod(F.xxhash64("locus", F.lit(seed), F.lit(epoch)), F.lit(1 << 20)) < int(subsample * (1 << 20)), 1 / subsample)
        inside = lambda rows, part=part: rows if part is None else rows.where(part)
        seen = now if now is not None and part is None and test is None else _likely(model, inside(data).withColumn("weight", F.col("weight") * scale), loci)
        known = model.start(seen)
        if nk is not None:  # samples without a mutation in this part start anew when they return
            known = known.join(nk.select("sample", F.col("nk").alias("was")), "sample", "left").select("sample", F.coalesce("was", "nk").alias("nk"))
        nk = _cut(model.estep(seen, known, rounds, few))
        phi = model.posteriors(seen, nk, few)
        rate = 1.0 if subsample >= 1 else learning_rate(epoch, tau, kappa)
        linear = features if rates and locus_model == "linear" else []
        stats = _moments(model, phi, linear).collect()  # a row for each stratum
        if states:
            _state_step(model, stats, offset, len(fixed), rate, alpha, l1, prior)
        else:
            _context_step(model, {r.context: r.value for r in stats}, {r.context: r.offset for r in offset}, len(fixed), rate, prior)
        if rates and locus_model == "linear":
            sums = np.sum([r.moments for r in stats], axis=0).reshape(model.k, -1) if stats else np.zeros((model.k, 1 + len(features)))
            fresh = newton_rates(sums, _curves(model, inside(laid), features), features, model.rates)
            model.rates = [a.blend(b, rate) for a, b in zip(model.rates, fresh, strict=True)]
        elif rates:
            effect = _each(model.k, lambda i: F.col("base") * F.exp(F.get("effect", i)))
            offsets = inside(laid).withColumn("effect", model._effect()).groupBy("locus").agg(_sums(effect, model.k).alias("offset"))
            model.rates = more_trees(model.rates, model.locus_stats(phi), offsets, inside(loci), features, cuts, tree_settings, rate)
        prior_row = nk.select(F.zip_with("nk", F.array(*[F.lit(float(a)) for a in model.alpha]), lambda n, a: n + a).alias("g")).withColumn("t", digamma(_total(F.col("g"))))
        means = prior_row.agg(*[F.avg(digamma(F.get("g", i)) - F.col("t")) for i in range(model.k)], F.avg(F.get("g", 0)), F.avg(_total(F.col("g")))).first()
        model.alpha = alpha_from_target(model.alpha, np.array(means[: model.k], float), float(means[model.k] / means[model.k + 1]))
        offset = _offsets(model, laid, loci)
        now = _likely(model, held, loci)
        model.scores.append(model._explained(now, model.estep(now, rounds=rounds, few=few), total, few))
        seen.unpersist()  # nk and now stay: the next epoch starts from them
        if callback:
            callback(epoch, model.scores[-1])
        if should_stop(model.scores, patience):
            break
    for done in (cells, laid, data, held):
        done.unpersist()
    return model


def _context_step(model: Topography, seen: dict, offset: dict, fixed: int, rate: float, prior: float) -> None:
    """Closed-form Poisson estimate given the locus rates, smoothed towards an even spectrum. seen, offset: K sums by context."""
    none = [0.0] * model.k
    s = np.array([seen.get(c, none) for c in model.contexts]).T + prior / len(model.contexts)
    o = np.array([offset.get(c, none) for c in model.contexts]).T
    new = np.log(s / np.maximum(o, 1e-300) + 1e-12)
    new -= new.mean(axis=1, keepdims=True)
    new[:fixed] = model.effects[:fixed]
    model.effects = convex_update(model.effects, new, rate)


def _alike(rows: DataFrame, model: Topography) -> DataFrame:
    """Rows of `_laid` or `_met` with those that no linear model can tell apart as one: same context, state and features (and sample).

    Such cells share their posteriors, and steps and score are sums over them. base is summed; that of observations is their geometric mean by weight, so that
    weight * ln(base), which the score has, is their sum. own: the sum of weight * ln(weight).
    """
    if "weight" not in rows.columns:
        return rows.groupBy(*model._strata, "features").agg(F.sum("base").alias("base"))
    sums = [F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.ln("weight")).alias("own"), F.sum(F.col("weight") * F.ln("base")).alias("logs")]
    found = rows.groupBy("sample", *model._strata, "features").agg(*sums)
    return found.withColumn("base", F.coalesce(F.exp(F.try_divide("logs", "weight")), F.lit(1.0))).drop("logs")


@dataclass
class _Gathered:
    """Groups of `_alike` on the driver: context by number, x = (1, features); of observations sample by number, weight and own as well."""

    context: np.ndarray
    x: np.ndarray
    base: np.ndarray
    sample: np.ndarray | None = None
    samples: list = field(default_factory=list)
    weight: np.ndarray | None = None
    own: np.ndarray | None = None

    def by(self, codes: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
        """n x K sums of rows x K values."""
        return np.array([np.bincount(codes, v, n) for v in values.T]).T

    def logs(self, model: Topography, effects: np.ndarray) -> np.ndarray:
        """Rows x K logs of base times context and locus effect."""
        out = np.log(self.base)[:, None] + effects[:, self.context].T
        return out + self.x[:, 1:] @ np.array([list(m.coefficients.values()) for m in model.rates]).T if model.rates and self.x.shape[1] > 1 else out

    def phi(self, model: Topography, like: np.ndarray, nk: np.ndarray) -> np.ndarray:
        p = np.exp(_digamma(nk + model.alpha))[self.sample] * like
        total = p.sum(axis=1)
        return p * np.divide(self.weight, total, out=np.zeros_like(total), where=total > 0)[:, None]

    def start(self, k: int) -> np.ndarray:
        return np.repeat(np.bincount(self.sample, self.weight, len(self.samples))[:, None] / k, k, axis=1)

    def estep(self, model: Topography, like: np.ndarray, nk: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            nk = self.by(self.sample, len(self.samples), self.phi(model, like, nk))
        return nk

    def explained(self, model: Topography, like: np.ndarray, nk: np.ndarray, total: float) -> float:
        share = nk + model.alpha
        fit = ((share / share.sum(axis=1, keepdims=True))[self.sample] * like).sum(axis=1)
        fit = self.weight * np.log(fit, out=np.zeros_like(fit), where=fit > 0)
        n, own, fit, null = (np.bincount(self.sample, v, len(self.samples)) for v in (self.weight, self.own, fit, self.weight * np.log(self.base / total)))
        some = n > 0
        sat = own[some] - n[some] * np.log(n[some])
        a, b = (sat - fit[some]).sum(), (sat - null[some]).sum()
        return float(1 - a / b) if b else 0.0


def _gathered(model: Topography, rows: DataFrame, features: Sequence[str]) -> _Gathered:
    extra = ["sample", "weight", "own"] if "weight" in rows.columns else []
    columns = [F.coalesce(F.col("features").getField(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)]
    if extra:
        rows = rows.where("sample is not null")  # as the joins by sample do
    table = rows.select("context", F.col("base").cast("double").alias("base"), *extra, *columns).toArrow()
    place = {c: i for i, c in enumerate(model.contexts)}
    numbers = lambda name: table[name].to_numpy().astype(float)
    out = _Gathered(np.array([place[c] for c in table["context"].to_pylist()], np.int64), np.column_stack([np.ones(len(table)), *[numbers(f"x{i}") for i in range(len(features))]]), numbers("base"))
    if extra:
        codes = pa.concat_arrays(table["sample"].chunks).dictionary_encode() if len(table) else pa.array([], table.schema.field("sample").type).dictionary_encode()
        out.sample, out.samples = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary.to_pylist()
        out.weight, out.own = numbers("weight"), np.nan_to_num(numbers("own"))
    return out


def _fit_gathered(model: Topography, laid: _Gathered, data: _Gathered, test: _Gathered | None, total: float, epochs: int, rounds: int, fixed: int, patience: int, prior: float, callback: Callable[[int, float], None] | None) -> Topography:
    """The epochs of `fit` over groups that the driver holds."""
    features, c = list(model.rates[0].coefficients) if model.rates else [], len(model.contexts)
    held = data if test is None else test

    def offsets() -> dict:
        found = laid.by(laid.context, c, np.exp(laid.logs(model, np.zeros_like(model.effects))))
        model.log_norm = np.log((found.T * np.exp(model.effects)).sum(axis=1))
        return dict(zip(model.contexts, found, strict=True))

    offset, nk = offsets(), data.start(model.k)
    for epoch in range(epochs):
        like = np.exp(data.logs(model, model.effects) - model.log_norm)
        nk = data.estep(model, like, nk, rounds)
        phi = data.phi(model, like, nk)
        _context_step(model, dict(zip(model.contexts, data.by(data.context, c, phi), strict=True)), offset, fixed, 1.0, prior)
        if model.rates:
            mu = np.exp(laid.logs(model, model.effects))
            curve = np.array([laid.x.T @ (laid.x * m[:, None]) for m in mu.T])
            model.rates = newton_rates(phi.T @ data.x, curve, features, model.rates)
        g = nk + model.alpha
        means = (_digamma(g) - _digamma(g.sum(axis=1))[:, None]).mean(axis=0)
        model.alpha = alpha_from_target(model.alpha, means, float(g[:, 0].mean() / g.sum(axis=1).mean()))
        offset = offsets()
        like = np.exp(held.logs(model, model.effects) - model.log_norm)
        model.scores.append(held.explained(model, like, held.estep(model, like, held.start(model.k), rounds), total))
        if callback:
            callback(epoch, model.scores[-1])
        if should_stop(model.scores, patience):
            break
    return model


def _laid(model: Topography, freq: DataFrame, loci: DataFrame, features: Sequence[str]) -> DataFrame:
    """Cells with a rate: (cell, state if there are any, base, features STRUCT); base: freq * exposure."""
    have = loci.where("exposure > 0").select("locus", F.col("exposure").cast("double").alias("exposure"), F.struct(F.lit(0).alias("none_"), *features).alias("features"), *model._views())
    rows = model._state(dealt_join(model.fold(freq, "freq").where("freq > 0"), have, "locus"))
    return rows.select(*CELL, *model._strata[1:], (F.col("freq").cast("double") * F.col("exposure")).alias("base"), "features")


def _met(model: Topography, observations: DataFrame, laid: DataFrame) -> DataFrame:
    """A row for each sample and cell of laid that it has: sample, weight and the cell's columns."""
    rows = model.fold(observations.select("sample", *CELL, "weight"), "weight").groupBy("sample", *CELL).agg(F.sum("weight").cast("double").alias("weight"))
    return dealt_join(rows, laid, list(CELL))


def _rated(model: Topography, rows: DataFrame, loci: DataFrame | None) -> DataFrame:
    """Rows with theta ARRAY[K]; trees are walked once for a locus, not for each of its rows."""
    if model._grown:
        return dealt_join(rows.drop("features"), loci.select("locus", model._theta().alias("theta")), "locus")
    core = F.struct(*rows.columns).alias("core_")  # in a struct, where no feature's name can hide one
    return rows.select(core, "features.*").select("core_.*", model._theta().alias("theta"))


def _likely(model: Topography, rows: DataFrame, loci: DataFrame) -> DataFrame:
    """Rows of `_met` with like ARRAY[K] by the model as it stands, kept: what reads them has no parameters of the model in its code, so it is compiled once for all epochs."""
    like = lambda i: F.exp(F.ln(F.col("base") * F.exp(F.get("effect", i) + F.get("theta", i))) - float(model.log_norm[i]))
    out = _rated(model, rows, loci).withColumn("effect", model._effect()).select(*[c for c in rows.columns if c not in ("features", "weight", "base")], "weight", "base", *[] if model._grown else ["features"], _each(model.k, like).alias("like"))
    return _cut(out)


def _x(features: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.coalesce(F.col("features").getField(f).cast("double"), F.lit(0.0)) for f in features]]


def _moments(model: Topography, phi: DataFrame, features: Sequence[str]) -> DataFrame:
    """By stratum: value ARRAY[K], the sums of phi, and moments ARRAY[K * (P + 1)], those of phi * (1, features)."""
    moments = [F.sum(F.get("phi", i) * x) for i in range(model.k) for x in _x(features)]
    return phi.groupBy(*model._strata).agg(_sums(F.col("phi"), model.k).alias("value"), F.array(*moments).alias("moments"))


def _curves(model: Topography, laid: DataFrame, features: Sequence[str]) -> np.ndarray:
    """K x (P + 1) x (P + 1) sums of x * x' * rate over cells, x = (1, features); no row but the result leaves Spark."""
    x, n = _x(features), 1 + len(features)
    rows = _rated(model, laid, None).withColumn("effect", model._effect())
    rows = rows.withColumn("mu", _each(model.k, lambda i: F.col("base") * F.exp(F.get("effect", i) + F.get("theta", i))))
    places = [(c, i, j) for c in range(model.k) for i in range(n) for j in range(i, n)]
    found = rows.agg(F.array(*[F.sum(x[i] * x[j] * F.get("mu", c)) for c, i, j in places])).first()[0]
    out = np.zeros((model.k, n, n))
    for (c, i, j), v in zip(places, found, strict=True):
        out[c, i, j] = out[c, j, i] = v or 0.0
    return out


def _offsets(model: Topography, laid: DataFrame, loci: DataFrame) -> list:
    """Rows of context_offsets, a row for each stratum; sets the model's normalizers, which are their sums times the context effects."""
    rows = _rated(model, laid, loci).groupBy(*model._strata).agg(_sums(_each(model.k, lambda i: F.col("base") * F.exp(F.get("theta", i))), model.k).alias("offset"))
    found = rows.withColumn("rate", F.zip_with("offset", model._effect(), lambda o, e: o * F.exp(e))).collect()
    model.log_norm = np.log(np.sum([r.rate for r in found if r.rate is not None], axis=0))
    return found


def _state_step(model: Topography, stats: list, offsets: list, fixed: int, rate: float, alpha: float, l1: float, prior: float) -> None:
    """Move the context and state effects towards the elastic-net regression of the sums by (context, state); contexts x states x K numbers reach the driver."""
    design, c = model.states.design(), len(model.contexts)
    place = {x: i for i, x in enumerate(model.contexts)}
    tables = np.zeros((2, model.k, c, len(design)))
    for z, (rows, column) in enumerate(((stats, "value"), (offsets, "offset"))):
        for r in rows:
            if r.state is not None:
                tables[z, :, place[r.context], r.state] = r[column]
    for i in range(model.k):
        offset = tables[1, i]
        share = offset / np.maximum(offset.sum(axis=1, keepdims=True), 1e-300)
        seen = tables[0, i] + prior / c * share  # smoothed towards an even spectrum, evenly over the states
        start = model.effects[i], model.shared[i], model.interactions[i]
        own, shared, interactions = st.elastic_net(seen, offset, design, start, alpha, l1, keep_own=i < fixed)
        own = own - own.mean() if i >= fixed else model.effects[i]
        model.effects[i], model.shared[i], model.interactions[i] = (convex_update(a, b, rate) for a, b in zip(start, (own, shared, interactions), strict=True))


def more_trees(old: Sequence[TreeRate], stats: DataFrame, offsets: DataFrame, loci: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]], settings: trees.Settings | None, rate: float, valid: float = 0.2) -> list[TreeRate]:
    """Every component's trees and some more, fitted to what its locus effect leaves over and shrunk by the learning rate.

    A fixed part `valid` of the loci (by a hash of the key) takes no part in growing and ends it.
    """
    k = len(old)
    rows = dealt_join(dealt_join(offsets, loci, "locus"), stats.select("locus", F.col("value").alias("seen")), "locus", "left").withColumn("theta", trees.log_rates(old))
    rows = rows.withColumn("mu", F.zip_with("offset", "theta", lambda o, t: o * F.exp(t))).withColumn("y", F.coalesce("seen", F.array(*[F.lit(0.0)] * k)))
    held = F.pmod(F.xxhash64("locus", F.lit("valid")), F.lit(1 << 20)) < int(valid * (1 << 20))
    table = _cut(trees.binned(rows, features, cuts, valid=held))
    more = trees.grow(table, features, cuts, k, settings, rate)
    table.unpersist()
    return [TreeRate(list(features), [*m.trees, *new]) for m, new in zip(old, more, strict=True)]


def polyak_predict(model: Topography, observations: DataFrame, freq: DataFrame, loci: DataFrame, subsample: float = 1 / 128, least: int = 30, most: int = 500, tolerance: float = 0.01, rounds: int = 20, seed: int = 0) -> DataFrame:
    """(sample, component, value): contributions averaged over E-steps on subsamples of loci, until the relative standard error is small.

    The sums and sums of squares of each (sample, component) over all steps stay in a table; the error of every sample has to be small.
    """
    named = F.array(*map(F.lit, model.components))
    state = _cut(observations.select("sample").distinct().select("sample", F.explode(named).alias("component"), F.lit(0.0).alias("value"), F.lit(0.0).alias("square")))
    last = None
    for step in range(most):
        part = loci.where(F.pmod(F.xxhash64("locus", F.lit(seed), F.lit(step)), F.lit(1 << 20)) < max(1, int(subsample * (1 << 20)))) if subsample < 1 else loci
        seen = _cut(model.observed(observations.withColumn("weight", F.col("weight") * (1 / min(subsample, 1.0))), freq, part))
        start = model.start(seen)
        if last is not None:  # go on from what the sample had when it last occurred
            start = start.join(last.select("sample", F.col("nk").alias("was")), "sample", "left").select("sample", F.coalesce("was", "nk").alias("nk"))
        nk = _cut(model.estep(seen, start, rounds))
        before = last, state
        last = nk if last is None else _cut(nk.unionByName(last.join(nk, "sample", "left_anti")))
        one = model.named(nk, "nk", ["sample"]).withColumnRenamed("value", "now")
        # a sample without a mutation in this part counts with zeros: the mean over all steps has the sample's weight
        state = _cut(state.join(one, ["sample", "component"], "left").select("sample", "component", (F.col("value") + F.coalesce("now", F.lit(0.0))).alias("value"), (F.col("square") + F.coalesce(F.col("now") * F.col("now"), F.lit(0.0))).alias("square")))
        n = step + 1
        last.count(), state.count()  # made before what they come from is let go
        for done in (seen, *(b for b in before if b is not None)):
            done.unpersist()
        if n >= least:
            mean = F.col("value") / n
            error = F.sqrt(F.greatest(F.lit(0.0), F.col("square") / n - mean * mean) / n)
            worst = state.groupBy("sample").agg((F.sum(error) / F.sum(mean)).alias("e")).agg(F.max("e")).first()[0]
            if worst is None or worst < tolerance:
                break
    return state.select("sample", "component", (F.col("value") / n).alias("value"))


@dataclass
class Mixture:
    """Several source datasets whose components may be shared: samples mix sources and components at once.

    like holds D x K probabilities of a cell (source-major). The prior weight of (d, k) in a sample is exp(digamma(alpha_k + its weight over all sources) + digamma(tau_d + its
    weight over all components)).
    """

    sources: list[str]
    components: list[str]
    alpha: np.ndarray
    tau: np.ndarray

    def _prior(self, nk: DataFrame) -> DataFrame:
        d, k = len(self.sources), len(self.components)
        by_k = [reduce(add, [F.get("nk", s * k + c) for s in range(d)]) + float(self.alpha[c]) for c in range(k)]
        by_d = [reduce(add, [F.get("nk", s * k + c) for c in range(k)]) + float(self.tau[s]) for s in range(d)]
        return nk.select("sample", F.array(*by_k).alias("a"), F.array(*by_d).alias("t")).select("sample", F.transform("a", digamma).alias("a"), F.transform("t", digamma).alias("t")).select(
            "sample", F.flatten(F.transform("t", lambda t: F.transform("a", lambda a: F.exp(a + t)))).alias("e"))

    def estep(self, observed: DataFrame, rounds: int = 20) -> DataFrame:
        """(sample, nk ARRAY[D * K]) after so many rounds from an even start."""
        n = len(self.sources) * len(self.components)
        nk = observed.groupBy("sample").agg(F.array_repeat(F.sum("weight") / n, n).alias("nk"))
        for i in range(rounds):
            rows = observed.join(self._prior(nk), "sample").withColumn("p", F.zip_with("e", "like", lambda a, b: a * b)).withColumn("total", _total(F.col("p")))
            nk = rows.groupBy("sample").agg(_sums(F.transform("p", lambda p: F.when(F.col("total") > 0, p * F.col("weight") / F.col("total")).otherwise(0.0)), n).alias("nk"))
            if i % 5 == 4:
                nk = _cut(nk)
        return nk

    def mstep(self, nk: DataFrame) -> Mixture:
        """alpha from the sums over sources, tau from the sums over components; only their mean expected logs leave Spark."""
        d, k = len(self.sources), len(self.components)

        def fitted(old: np.ndarray, sums: list[Column]) -> np.ndarray:
            g = F.array(*[s + float(a) for s, a in zip(sums, old, strict=True)])
            rows = nk.select(g.alias("g")).withColumn("s", _total(F.col("g")))
            m = rows.agg(*[F.avg(digamma(F.get("g", i)) - digamma(F.col("s"))) for i in range(len(old))], F.avg(F.col("s"))).first()
            return alpha_from_target(old, np.array(m[: len(old)], float), 1 / len(old))

        alpha = fitted(self.alpha, [reduce(add, [F.get("nk", s * k + c) for s in range(d)]) for c in range(k)])
        tau = fitted(self.tau, [reduce(add, [F.get("nk", s * k + c) for c in range(k)]) for s in range(d)])
        return Mixture(self.sources, self.components, alpha, tau)

    def fit(self, observed: DataFrame, epochs: int = 10, rounds: int = 20) -> tuple[Mixture, DataFrame]:
        model, nk = self, None
        for _ in range(epochs):
            nk = _cut(model.estep(observed, rounds))
            model = model.mstep(nk)
        return model, nk

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.sources, self.components, [float(a) for a in self.alpha], [float(t) for t in self.tau])], "sources array<string>, components array<string>, alpha array<double>, tau array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Mixture:
        r = spark.read.parquet(path).first()
        return cls(list(r.sources), list(r.components), np.array(r.alpha), np.array(r.tau))

    def named(self, nk: DataFrame) -> DataFrame:
        """(sample, source, component, value)."""
        k = len(self.components)
        rows = nk.select("sample", F.posexplode("nk").alias("at", "value"))
        s, c = F.array(*map(F.lit, self.sources)), F.array(*map(F.lit, self.components))
        return rows.select("sample", F.get(s, F.floor(F.col("at") / k).cast("int")).alias("source"), F.get(c, F.pmod("at", F.lit(k))).alias("component"), "value")


def source_like(models: dict[str, Topography], cells: dict[str, tuple[DataFrame, DataFrame]], observations: DataFrame) -> DataFrame:
    """observations with like ARRAY[D * K]: every source's component probabilities of the cell. cells: (freq, loci) of each source; a cell that a source lacks has none there."""
    out = observations
    for i, (source, model) in enumerate(models.items()):
        seen = model.observed(observations.select(*CELL).distinct(), *cells[source]).select(*CELL, F.col("like").alias(f"like_{i}"))
        out = dealt_join(out, seen, list(CELL), "left")
    none = F.array(*[F.lit(0.0)] * next(iter(models.values())).k)
    return out.withColumn("like", F.concat(*[F.coalesce(f"like_{i}", none) for i in range(len(models))])).drop(*[f"like_{i}" for i in range(len(models))])
