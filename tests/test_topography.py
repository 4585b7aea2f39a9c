"""The topography model against numpy: E-step, offsets, predictions, attributions, and recovery from simulated data."""

import numpy as np
import pytest

from genolith.plans import model as md
from genolith.plans import topography as tp

CONTEXTS = ["A", "B", "C", "D"]
NAMES = ["x", "y"]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(4)
    loci = [(i, float(rng.uniform(0.5, 1)), float(rng.normal()), float(rng.normal())) for i in range(60)]
    freq = [(i, o, c, float(rng.integers(1, 6))) for i in range(60) for o in (0, 1) for c in CONTEXTS]
    effects = np.log(np.array([[0.7, 0.1, 0.1, 0.1], [0.05, 0.15, 0.2, 0.6]]))
    theta = np.array([[1.2, 0.0], [0.0, -1.0]])
    f = {(i, o, c): v for i, o, c, v in freq}
    rate = {(i, o, c): [v * loci[i][1] * np.exp(effects[k, CONTEXTS.index(c)] + theta[k] @ loci[i][2:]) for k in range(2)] for (i, o, c), v in f.items()}
    norm = np.sum(list(rate.values()), axis=0)
    mix = np.array([[900, 100], [200, 800], [500, 500], [50, 950], [700, 300], [990, 10]]) * 2
    seen = []
    for s, m in enumerate(mix):
        for cell, r in rate.items():
            n = rng.poisson((np.array(r) / norm) @ m)
            if n:
                seen.append((f"s{s}", *cell, float(n)))
    model = tp.Topography(NAMES, CONTEXTS, effects, [tp.LinearRate({"f": 1.2, "g": 0.0}), tp.LinearRate({"f": 0.0, "g": -1.0})], np.array([1.0, 1.0]), np.log(norm))
    return {
        "loci": spark.createDataFrame(loci, "locus long, exposure double, f double, g double").cache(), "freq": spark.createDataFrame(freq, "locus long, configuration int, context string, freq double").cache(),
        "obs": spark.createDataFrame(seen, "sample string, locus long, configuration int, context string, weight double").cache(),
        "rate": rate, "norm": norm, "model": model, "seen": seen, "effects": effects, "mix": mix, "rows": loci,
    }


def test_digamma(spark):
    x = [0.001, 0.3, 1.0, 7.5, 1000.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(tp.digamma(tp.F.col("x"))).collect()]
    assert np.allclose(got, md.digamma(np.array(x)), atol=1e-8)


def test_normalizers_and_offsets(world):
    m = world["model"]
    assert np.allclose(np.exp(m.normalizers(world["freq"], world["loci"])), world["norm"])
    for table, key, effect in ((m.context_offsets(world["freq"], world["loci"]), "context", 2), (m.locus_offsets(world["freq"], world["loci"]), "locus", 0)):
        theta = {i: np.array([1.2 * f, -1.0 * g]) for i, _, f, g in world["rows"]}
        for r in table.collect():
            own = [np.array(v) / np.exp(world["effects"][:, CONTEXTS.index(c[2])] if effect == 2 else theta[c[0]]) for c, v in world["rate"].items() if c[effect] == r[0]]
            assert np.allclose(r.offset, np.sum(own, axis=0))


def test_estep_is_the_fixed_point(world):
    m = world["model"]
    seen = m.observed(world["obs"], world["freq"], world["loci"])
    got = {r.sample: np.array(r.nk) for r in m.estep(seen, rounds=60).collect()}
    for s in got:
        own = [x for x in world["seen"] if x[0] == s]
        like = np.array([np.array(world["rate"][x[1:4]]) / world["norm"] for x in own]).T
        want = md.estep(m.alpha, like, np.array([x[4] for x in own]), iters=60, tol=0)
        assert np.allclose(got[s], want, rtol=1e-6)
    phi = m.posteriors(seen, m.estep(seen, rounds=20))
    total = phi.agg(*[tp.F.sum(tp.F.get("phi", i)) for i in range(2)], tp.F.sum("weight")).first()
    assert abs(total[0] + total[1] - total[2]) < 1e-6
    logp = m.mutation_posteriors(world["obs"].withColumn("id", tp.F.monotonically_increasing_id()).limit(5), world["freq"], world["loci"]).collect()
    assert len(logp) == 10 and all(r.logp is None or r.logp <= 1e-9 for r in logp)
    own = [x for x in world["seen"] if x[0] == "s0"]
    some = m.mutation_posteriors(world["obs"].where("sample = 's0'").withColumn("id", tp.F.concat_ws(":", *tp.CELL)), world["freq"], world["loci"], rounds=30).collect()
    like = np.array([np.array(world["rate"][x[1:4]]) / world["norm"] for x in own]).T
    w = np.array([x[4] for x in own])
    want = np.log(md.posterior(m.alpha, like, w, md.estep(m.alpha, like, w, iters=30, tol=0)) / w)
    place = {":".join(map(str, x[1:4])): i for i, x in enumerate(own)}
    assert len(some) == 2 * len(own) and all(abs(r.logp - want[m.components.index(r.component), place[r.id]]) < 1e-6 for r in some)


def test_annotations(spark, world):
    m, total = world["model"], sum(x[4] for x in world["seen"])
    out = m.annotate(world["obs"], world["freq"], world["loci"])
    assert set(out) == {"contributions", "spectra", "distributions", "locus_rates", "marginal", "empirical", "shap"}
    marginal = {tuple(r)[:3]: r.value for r in out["marginal"].collect()}
    assert len(marginal) == len(world["rate"]) and abs(sum(marginal.values()) - total - 12) < 1e-3 * total
    assert max(r.value for r in out["distributions"].collect()) == pytest.approx(1.0)
    shap = out["shap"].collect()
    mean = np.mean([x[2] for x in world["rows"]])
    assert all(abs(r.effect - (1.2 * (r.value - mean) if (r.component, r.feature) == ("x", "f") else 0)) < 1e-9 for r in shap if r.feature == "f")
    boosted = tp.Topography(NAMES, CONTEXTS, world["effects"], [md.BoostedModel(0.1, [("f", 0.0, 1.0, 2.0), ("g", 0.5, 0.0, 3.0), ("f", 1.0, 0.0, 1.0)])] * 2, m.alpha, m.log_norm)
    rows = boosted.attributions(world["loci"]).where("component = 'x'").collect()
    whole = {r.locus: r.v for r in world["loci"].select("locus", boosted.rates[0].log_rate().alias("v")).collect()}
    for i in (0, 30, 59):
        assert sum(r.effect for r in rows if r.locus == i) == pytest.approx(whole[i] - np.mean(list(whole.values())))


@pytest.mark.parametrize(("kind", "least"), [("linear", 0.5)])
def test_fit_recovers(world, kind, least):
    heard = []
    m = tp.fit(world["obs"], world["freq"], world["loci"], ["f", "g"], 2, epochs=5, locus_model=kind, seed=1, rounds=5, callback=lambda e, s: heard.append((e, s)))
    assert len(heard) == len(m.scores) and m.scores[-1] > m.scores[0] and m.scores[-1] > least * tp.Topography.deviance(world["model"], world["model"].observed(world["obs"], world["freq"], world["loci"]), world["model"].estep(world["model"].observed(world["obs"], world["freq"], world["loci"])), world["freq"], world["loci"])
    if kind == "linear":
        p = np.exp(m.effects)
        p /= p.sum(axis=1, keepdims=True)
        true = np.exp(world["effects"])
        order = [int(np.argmin(np.abs(p - t).sum(axis=1))) for t in true / true.sum(axis=1, keepdims=True)]
        assert sorted(order) == [0, 1]
        assert m.rates[order[0]].coefficients["f"] > 0.7 and m.rates[order[1]].coefficients["g"] < -0.6


def test_subsampled_training_and_prediction(world):
    m = tp.fit(world["obs"], world["freq"], world["loci"], ["f", "g"], 2, epochs=2, locus_model="boosted", subsample=0.5, rounds=2, fixed={"known": {"A": 0.7, "B": 0.1, "C": 0.1, "D": 0.1}})
    assert m.components == ["known", "M0"] and len(m.scores) == 2
    got = {(r.sample, r.component): r.value for r in tp.polyak_predict(world["model"], world["obs"], world["freq"], world["loci"], subsample=0.5, least=2, most=2, rounds=5).collect()}
    for s, mix in enumerate(world["mix"]):
        assert abs(got[f"s{s}", "x"] / mix.sum() - mix[0] / mix.sum()) < 0.2


def test_mixture(world):
    m = world["model"]
    seen = tp.source_like({"p": m, "q": m}, {"p": (world["freq"], world["loci"]), "q": (world["freq"], world["loci"])}, world["obs"])
    mixture = tp.Mixture(["p", "q"], NAMES, np.ones(2), np.ones(2))
    got = {(r.sample, r.source, r.component): r.value for r in mixture.named(mixture.estep(seen, rounds=10)).collect()}
    own = [x for x in world["seen"] if x[0] == "s1"]
    like = np.array([np.array(world["rate"][x[1:4]]) / world["norm"] for x in own]).T
    want = md.mixture_estep(np.ones(2), np.ones(2), np.array([like, like]), np.array([x[4] for x in own]), iters=10, tol=0)
    assert np.allclose([[got["s1", d, k] for k in NAMES] for d in "pq"], want, rtol=1e-6)
    fitted, nk = mixture.fit(seen, epochs=1, rounds=2)
    g = np.array([r.nk for r in nk.collect()]).reshape(-1, 2, 2)  # samples, sources, components
    for axis, found in ((1, fitted.alpha), (2, fitted.tau)):
        gamma = g.sum(axis=axis) + 1.0
        target = (md.digamma(gamma) - md.digamma(gamma.sum(axis=1))[:, None]).mean(axis=0)
        want = md.alpha_from_target(np.ones(2), target, 0.5)
        assert np.allclose(found, want, rtol=1e-4)  # Newton steps from sums that agree to nine digits


def test_epochs_do_not_join_cells_again(world, monkeypatch):
    keys, plain = [], tp.dealt_join
    monkeypatch.setattr(tp, "dealt_join", lambda a, b, on, how="inner": keys.append(on) or plain(a, b, on, how))
    m = tp.fit(world["obs"], world["freq"], world["loci"], ["f", "g"], 2, epochs=2, seed=1, rounds=2)
    assert keys.count(list(tp.CELL)) == 1 and len(m.scores) == 2  # observations met the cells several times an epoch before
    seen = m.observed(world["obs"], world["freq"], world["loci"])
    assert "lambdafunction" not in m.locus_stats(m.posteriors(seen, m.start(seen)))._jdf.queryExecution().optimizedPlan().toString()


def test_epochs_go_over_alike_cells_as_one(spark, world, monkeypatch):
    loci = world["loci"].select("locus", "exposure", tp.F.round("f").alias("f"), tp.F.when(tp.F.col("locus") % 7 > 0, tp.F.round("g")).alias("g"))
    obs, test = world["obs"].where("locus % 3 > 0"), world["obs"].where("locus % 3 = 0")

    def fit(few, **options):
        monkeypatch.setattr(tp, "FEW_NUMBERS", few, raising=False)
        group = f"fit {few} {options}"
        spark.sparkContext.setJobGroup(group, group)
        m = tp.fit(obs, world["freq"], loci, ["f", "g"], 2, seed=1, rounds=3, **options)
        return m, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    one, jobs = fit(4_000_000, epochs=1, test=test)
    more, same = fit(4_000_000, epochs=3, test=test)
    assert jobs == same  # an epoch was a dozen jobs over all observations
    by_spark, many = fit(0, epochs=3, test=test)
    assert many > same
    for a, b in ((more.effects, by_spark.effects), (more.scores, by_spark.scores), (more.alpha, by_spark.alpha), (more.log_norm, by_spark.log_norm), *((list(x.coefficients.values()), list(y.coefficients.values())) for x, y in zip(more.rates, by_spark.rates, strict=True))):
        assert np.allclose(a, b, rtol=1e-6)
    by_locus, _ = fit(0, epochs=1, test=test, subsample=1 - 1e-9)  # rows of single cells, all of them
    assert np.allclose(one.effects, by_locus.effects, rtol=1e-5) and np.allclose(one.scores, by_locus.scores, rtol=1e-5)
    assert np.allclose([list(r.coefficients.values()) for r in one.rates], [list(r.coefficients.values()) for r in by_locus.rates], rtol=1e-5)
