"""The factor model: E-step per sample in Arrow groups, statistics and M-steps as grouped sums and small driver arrays.

A sample's observations are rows (sample, cell, weight) and the likelihood of a cell under each of K components is an array column;
components, contexts and samples are few, loci and observations are many, so only K-sized and context-sized tables reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.operators.tensor import cut

TRAIN, PREDICT = (1_000, 5e-5), (100_000, 1e-5)


def digamma(x):
    """psi(x) for x > 0: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float, copy=True)
    out = np.zeros_like(x)
    low = x < 6
    while low.any():
        out[low] -= 1 / x[low]
        x[low] += 1
        low = x < 6
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x):
    x = np.array(x, float, copy=True)
    out = np.zeros_like(x)
    low = x < 6
    while low.any():
        out[low] += 1 / x[low] ** 2
        x[low] += 1
        low = x < 6
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def gammaln(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def estep(alpha: np.ndarray, like: np.ndarray, w: np.ndarray, iters: int = TRAIN[0], tol: float = TRAIN[1], start: np.ndarray | None = None) -> np.ndarray:
    """Fixed point of Nk = e * (L (w / (e L))), e = exp(psi(alpha + Nk)); like is K x I."""
    nk = np.full(len(alpha), w.sum() / len(alpha)) if start is None else start.astype(float)
    live = w > 0
    like, w = like[:, live], w[live]
    for _ in range(iters):
        e = np.exp(digamma(alpha + nk))
        new = e * (like @ (w / np.maximum(e @ like, 1e-300)))
        moved = np.abs(new - nk).sum() / max(nk.sum(), 1e-300)
        nk = new
        if moved < tol:
            break
    return nk


def posterior(alpha: np.ndarray, like: np.ndarray, w: np.ndarray, nk: np.ndarray) -> np.ndarray:
    """phi[k, i]: the weight of observation i that component k explains."""
    e = np.exp(digamma(alpha + nk))
    return e[:, None] * like * (w / np.maximum(e @ like, 1e-300))


def update_alpha(alpha: np.ndarray, gamma: np.ndarray, iters: int = 100, tol: float = 1e-3, floor: float = 1e-5) -> np.ndarray:
    """The prior that fits the samples' variational parameters gamma (N x K)."""
    target = (digamma(gamma) - digamma(gamma.sum(axis=1))[:, None]).mean(axis=0)
    return alpha_from_target(alpha, target, gamma.mean() / max(gamma.sum(axis=1).mean(), 1e-9), iters, tol, floor)


def alpha_from_target(alpha: np.ndarray, target: np.ndarray, share: float, iters: int = 100, tol: float = 1e-3, floor: float = 1e-5) -> np.ndarray:
    """Newton steps with halving on the Dirichlet likelihood of the samples' mean expected log shares (target), from alpha and from an even start; the old prior if it fails."""
    value = lambda a: math.lgamma(a.sum()) - gammaln(a).sum() + ((a - 1) * target).sum()
    best = None
    for a in (alpha.copy(), np.full_like(alpha, max(share, floor))):
        for _ in range(iters):
            g = digamma(a.sum(keepdims=True)) - digamma(a) + target
            q, z = -trigamma(a), trigamma(a.sum(keepdims=True))
            step = (g - (g / q).sum() / (1 / z + (1 / q).sum())) / q
            size = 1.0
            while size > 1e-6 and ((a - size * step) <= floor / 10).any() or value(np.maximum(a - size * step, floor)) < value(a) - 1e-12 and size > 1e-6:
                size /= 2
            new = np.maximum(a - size * step, floor)
            moved, a = np.abs(new - a).sum(), new
            if moved < tol:
                break
        if np.isfinite(a).all() and (best is None or value(a) > value(best)):
            best = a
    return alpha if best is None else best


def convex_update(old: np.ndarray, new: np.ndarray, rate: float) -> np.ndarray:
    return old if np.isnan(new).any() else (1 - rate) * old + rate * new


def learning_rate(epoch: int, tau: float = 1.0, kappa: float = 0.5) -> float:
    return (tau + epoch) ** -kappa


def should_stop(scores: Sequence[float], patience: int) -> bool:
    """Whether the best score is older than the last `patience` evaluations."""
    return len(scores) > patience and int(np.argmax(scores)) < len(scores) - patience


def with_likelihood(observations: DataFrame, spectra: DataFrame, components: Sequence[str], locus: DataFrame | None = None) -> DataFrame:
    """observations plus like ARRAY<DOUBLE>[K] = spectra value of the context (times the locus rate). spectra: component, context, value.

    The wide spectra table has one row per context and is broadcast; locus: (locus, rate ARRAY[K]) is joined by its key.
    """
    wide = spectra.groupBy("context").pivot("component", list(components)).agg(F.first("value"))
    wide = wide.select("context", F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in components]).alias("like"))
    out = observations.join(F.broadcast(wide), "context")
    if locus is None:
        return out
    return out.join(locus, "locus").withColumn("like", F.zip_with("like", "rate", lambda a, b: a * b)).drop("rate")


def _groups(observed: DataFrame) -> DataFrame:
    """Equal likelihood rows of a sample summed first: a sample's group holds its distinct cells, not its mutations."""
    return observed.groupBy("sample", "like").agg(F.sum("weight").alias("weight"))


def contributions(observed: DataFrame, alpha: np.ndarray, components: Sequence[str], iters: int = PREDICT[0], tol: float = PREDICT[1]) -> DataFrame:
    """(sample, component, value): E-step of each sample."""
    kind = observed.schema["sample"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nk = estep(alpha, np.stack(pdf["like"]).T.astype(float), pdf["weight"].to_numpy(float), iters, tol)
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "component": list(components), "value": nk})

    return _groups(observed).groupBy("sample").applyInPandas(run, f"sample {kind}, component string, value double")


def component_posteriors(observed: DataFrame, contribution: DataFrame, alpha: np.ndarray, components: Sequence[str]) -> DataFrame:
    """observed rows exploded over components with the log posterior of each, given the samples' contributions (one row per sample)."""
    wide = contribution.groupBy("sample").pivot("component", list(components)).agg(F.first("value"))
    wide = wide.select("sample", F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in components]).alias("nk"))

    def weights(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(e=[np.exp(digamma(alpha + np.array(n))) for n in p["nk"]])[["sample", "e"]]

    kind = observed.schema["sample"].dataType.simpleString()
    e = wide.mapInPandas(weights, f"sample {kind}, e array<double>")
    joint = observed.join(e, "sample").withColumn("p", F.zip_with("like", "e", lambda a, b: a * b))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    names = F.array(*map(F.lit, components))
    rows = joint.withColumn("total", total).select(*[c for c in observed.columns if c != "like"], "total", F.posexplode("p").alias("k", "p"))
    return rows.withColumn("component", F.get(names, F.col("k"))).withColumn("logp", F.when(F.col("p") > 0, F.ln(F.col("p") / F.col("total")))).drop("k", "p", "total")


def deviance_score(observed: DataFrame, contribution: DataFrame, alpha: np.ndarray, components: Sequence[str], n_types: int) -> float:
    """1 - sum(saturated - fit) / sum(saturated - null) over samples."""
    prior = dict(zip(components, map(float, alpha), strict=True))
    share = contribution.withColumn("v", F.col("value") + F.element_at(F.create_map(*[F.lit(x) for kv in prior.items() for x in kv]), F.col("component")))
    wide = share.groupBy("sample").pivot("component", list(components)).agg(F.first("v"))
    wide = wide.select("sample", F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in components]).alias("v"))
    s = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    rows = _groups(observed).join(wide, "sample").withColumn("mix", F.aggregate(F.zip_with("v", "like", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / s)
    w = F.col("weight")
    per = rows.groupBy("sample").agg(F.sum(w * F.ln("mix")).alias("fit"), F.sum(w * F.ln(w)).alias("self"), F.sum(w).alias("n"))
    r = per.select((F.col("self") - F.col("n") * F.ln("n")).alias("sat"), "fit", (-F.col("n") * math.log(n_types)).alias("null")).agg(F.sum(F.col("sat") - F.col("fit")), F.sum(F.col("sat") - F.col("null"))).first()
    return 1 - r[0] / r[1]


@dataclass
class FactorModel:
    """Spectra and prior fitted by variational EM; `callback(epoch, score)` is called after each evaluation."""

    components: list[str]
    spectra: np.ndarray  # K x contexts
    contexts: list[str]
    alpha: np.ndarray
    scores: list[float] = field(default_factory=list)

    def spectra_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, x, float(self.spectra[i, j])) for i, c in enumerate(self.components) for j, x in enumerate(self.contexts)]
        return spark.createDataFrame(rows, "component string, context string, value double")

    def observed(self, observations: DataFrame) -> DataFrame:
        return with_likelihood(observations, self.spectra_table(observations.sparkSession), self.components)

    def predict(self, observations: DataFrame) -> DataFrame:
        return contributions(self.observed(observations), self.alpha, self.components)

    def score(self, observations: DataFrame) -> float:
        return deviance_score(self.observed(observations), self.predict(observations), self.alpha, self.components, len(self.contexts))

    def save(self, spark: SparkSession, path: str) -> None:
        self.spectra_table(spark).write.mode("overwrite").parquet(f"{path}/spectra")
        spark.createDataFrame([(c, float(a), i) for i, (c, a) in enumerate(zip(self.components, self.alpha, strict=True))], "component string, alpha double, rank int").write.mode("overwrite").parquet(f"{path}/prior")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FactorModel:
        prior = spark.read.parquet(f"{path}/prior").orderBy("rank").collect()
        table = {(r.component, r.context): r.value for r in spark.read.parquet(f"{path}/spectra").collect()}
        names, contexts = [r.component for r in prior], sorted({c for _, c in table})
        return cls(names, np.array([[table[n, c] for c in contexts] for n in names]), contexts, np.array([r.alpha for r in prior]))


def init_from_signatures(spectra: np.ndarray) -> np.ndarray:
    """log(p + 0.005), centred per component."""
    x = np.log(spectra + 5e-3)
    return x - x.mean(axis=1, keepdims=True)


def fit(observations: DataFrame, k: int, epochs: int = 20, seed: int = 0, fixed: dict[str, dict[str, float]] | None = None, patience: int = 5, eval_every: int = 1, test: DataFrame | None = None, callback: Callable[[int, float], None] | None = None) -> FactorModel:
    """Batch EM on context spectra: distributed E-step and statistics (component, context), M-step on the driver."""
    contexts = sorted(r[0] for r in observations.select("context").distinct().collect())  # the context vocabulary is fixed and small
    names = [*(fixed or {}), *[f"M{i}" for i in range(k - len(fixed or {}))]]
    rng = np.random.default_rng(seed)
    spectra = rng.dirichlet(np.ones(len(contexts)), len(names))
    for i, values in enumerate((fixed or {}).values()):
        p = np.array([values.get(c, 0.0) for c in contexts]) + 5e-3
        spectra[i] = p / p.sum()
    model = FactorModel(names, spectra, contexts, np.full(len(names), 1.0))
    kind = observations.schema["sample"].dataType.simpleString()
    cells = observations.groupBy("sample", "context").agg(F.sum("weight").alias("weight")).persist()
    for epoch in range(epochs):
        alpha = model.alpha

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            like, w = np.stack(pdf["like"]).T.astype(float), pdf["weight"].to_numpy(float)
            nk = estep(alpha, like, w)
            phi = posterior(alpha, like, w, nk)
            rows = [(pdf["sample"].iloc[0], names[i], c, float(phi[i, j])) for i in range(len(names)) for j, c in enumerate(pdf["context"])]
            rows += [(pdf["sample"].iloc[0], names[i], None, float(nk[i])) for i in range(len(names))]
            return pd.DataFrame(rows, columns=["sample", "component", "context", "value"])

        parts = model.observed(cells).groupBy("sample").applyInPandas(run, f"sample {kind}, component string, context string, value double").persist()
        stats = parts.where("context is not null").groupBy("component", "context").agg(F.sum("value").alias("value")).collect()  # K x contexts rows
        gamma_rows = parts.where("context is null").groupBy("sample").pivot("component", names).agg(F.first("value")).collect()  # one row per sample
        parts.unpersist()
        new = np.full_like(spectra, 1e-6)
        for r in stats:
            new[names.index(r.component), contexts.index(r.context)] += r.value
        for i in range(len(fixed or {}), len(names)):
            model.spectra[i] = new[i] / new[i].sum()
        model.alpha = update_alpha(alpha, np.array([[r[n] or 0.0 for n in names] for r in gamma_rows]) + alpha)
        if (epoch + 1) % eval_every == 0:
            model.scores.append(model.score(test if test is not None else cells))
            if callback:
                callback(epoch, model.scores[-1])
            if should_stop(model.scores, patience):
                break
    cells.unpersist()
    return model


def linear_locus_model(rows: DataFrame, features: Sequence[str], target: str, weight: str, reg: float = 1e-3):
    """Poisson regression with L2 on locus features (no intercept beyond the features)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    data = VectorAssembler(inputCols=list(features), outputCol="x_").transform(rows)
    return GeneralizedLinearRegression(family="poisson", link="log", featuresCol="x_", labelCol=target, weightCol=weight, regParam=reg, maxIter=50).fit(data)


@dataclass
class BoostedModel:
    """Depth-one Poisson boosting on binned features: base log rate and (feature, bound, left, right) stumps."""

    base: float
    stumps: list[tuple[str, float, float, float]]

    def log_rate(self):
        out = F.lit(self.base)
        for f, bound, left, right in self.stumps:
            out = out + F.when(F.coalesce(F.col(f) <= bound, F.lit(True)), left).otherwise(right)
        return out

    def features(self) -> list[str]:
        return sorted({f for f, *_ in self.stumps})

    def terms(self) -> dict:
        """The part of the log rate that each feature has: a stump belongs to one feature, so the parts add up."""
        return {f: sum((F.when(F.coalesce(F.col(f) <= b, F.lit(True)), x).otherwise(y) for g, b, x, y in self.stumps if g == f), F.lit(0.0)) for f in self.features()}


def _place(feature: str, cuts: Sequence[float]):
    """(feature, bin): the number of cuts below the value."""
    below = F.filter(F.array(*map(F.lit, cuts)), lambda b: b < F.col(feature))
    return F.struct(F.lit(feature).alias("f"), F.size(below).alias("b"))


def boosted_locus_model(rows: DataFrame, features: Sequence[str], target: str, weight: str, rounds: int = 10, bins: int = 32, shrink: float = 0.3, l2: float = 1.0) -> BoostedModel:
    """Each round sums gradients and hessians by (feature, bin) in Spark; the best split of those few sums is picked on the driver."""
    rows = cut(rows.select(*dict.fromkeys([*features, target, weight])))  # made once, not for every round
    total = rows.agg(F.sum(F.col(target) * F.col(weight)), F.sum(weight)).first()
    model = BoostedModel(math.log(total[0] / total[1]), [])
    cuts = {f: sorted(set(rows.agg(F.percentile_approx(f, [(i + 1) / bins for i in range(bins - 1)], 10_000)).first()[0] or [])) for f in features}
    for _ in range(rounds):
        mu = F.exp(model.log_rate())
        g = rows.withColumn("g", F.col(weight) * (F.col(target) - mu)).withColumn("h", F.col(weight) * mu)
        places = [_place(f, cuts[f]) for f in features if cuts[f]]
        sums = g.select("g", "h", F.explode(F.array(*places)).alias("p")).groupBy("p.f", "p.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        best = None
        for f in features:
            hist = sorted((r.b, r.g, r.h) for r in sums if r.f == f)
            tg, th = sum(x[1] for x in hist), sum(x[2] for x in hist)
            lg = lh = 0.0
            for b, x, h in hist[:-1]:
                lg, lh = lg + x, lh + h
                gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
                if b < len(cuts[f]) and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, cuts[f][b], shrink * lg / (lh + l2), shrink * (tg - lg) / (th - lh + l2))
        if best is None or best[0] <= 1e-9:
            break
        model.stumps.append(best[1:])
    return model


def simulate(contribution: DataFrame, spectra: np.ndarray, components: Sequence[str], contexts: Sequence[str], seed: int = 0) -> DataFrame:
    """(sample, context, weight): Poisson counts around each sample's mixture; the seed and the sample name fix the draw."""
    kind = contribution.schema["sample"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        name = str(pdf["sample"].iloc[0])
        v = pdf.set_index("component")["value"].reindex(components).fillna(0.0).to_numpy()
        n = np.random.default_rng([seed, zlib.crc32(name.encode())]).poisson(v @ spectra)
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "context": list(contexts), "weight": n.astype(float)})

    return contribution.groupBy("sample").applyInPandas(run, f"sample {kind}, context string, weight double")


def row_order(matrix: np.ndarray) -> list[int]:
    """Rows in the leaf order of average-linkage clustering; values that aren't finite count as 0. For small report matrices."""
    x = np.nan_to_num(matrix, nan=0.0, posinf=0.0, neginf=0.0)
    groups = {i: [i] for i in range(len(x))}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    while len(groups) > 1:
        ids = sorted(groups)
        _, a, b = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for n, i in enumerate(ids) for j in ids[n + 1 :])
        p, q = groups[a], groups.pop(b)
        groups[a] = min((u + v for u in (p, p[::-1]) for v in (q, q[::-1])), key=lambda o: d[o[len(p) - 1], o[len(p)]])
    return next(iter(groups.values()), [])


def mixture_estep(alpha: np.ndarray, tau: np.ndarray, like: np.ndarray, w: np.ndarray, iters: int = TRAIN[0], tol: float = TRAIN[1]) -> np.ndarray:
    """Shared-exposure fixed point over D sources and K components; like is D x K x I, the result D x K.

    The prior weight of (d, k) is exp(psi(alpha_k + sum over d) + psi(tau_d + sum over k)).
    """
    d, k, _ = like.shape
    nk = np.full((d, k), w.sum() / (d * k))
    for _ in range(iters):
        e = np.exp(digamma(alpha + nk.sum(axis=0))[None, :] + digamma(tau + nk.sum(axis=1))[:, None])
        new = e * np.einsum("dki,i->dk", like, w / np.maximum(np.einsum("dk,dki->i", e, like), 1e-300))
        moved = np.abs(new - nk).sum() / max(nk.sum(), 1e-300)
        nk = new
        if moved < tol:
            break
    return nk
