"""The elastic-net regression of state effects against its optimality conditions and descent in numpy, and training with states and without strands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolith.plans import states as st
from genolith.plans import topography as tp

STATES = st.States(["s"], {"arm": ["none", "p", "q"]})
DESIGN = STATES.design()


def table(seed, contexts=8, effect=1.0):
    rng = np.random.default_rng(seed)
    own, shared, inter = rng.normal(size=contexts), np.array([0.5, 0, 0, -0.4]) * effect, np.zeros((contexts, 4))
    inter[3, 1], inter[5, 3] = effect, -effect
    offset = rng.uniform(50, 400, size=(contexts, len(DESIGN)))
    offset[2, 4] = 0
    return rng.poisson(offset * np.exp(st.log_effects(own, shared, inter, DESIGN))).astype(float), offset


def test_states():
    assert STATES.names() == ["s:-1", "s:1", "arm:p", "arm:q"] and DESIGN.shape == (9, 4)
    assert DESIGN[STATES.combinations().index((0, "none"))].sum() == 0 and DESIGN[STATES.combinations().index((1, "q"))].tolist() == [0, 1, 0, 1]


@pytest.mark.parametrize(("alpha", "l1"), [(1e-3, 0.5), (1e-4, 0.9), (3e-3, 1.0), (1e-2, 0.0)])
def test_elastic_net_is_optimal(alpha, l1):
    seen, offset = table(1)
    own, shared, inter = st.elastic_net(seen, offset, DESIGN, alpha=alpha, l1=l1)
    residual = (offset * np.exp(st.log_effects(own, shared, inter, DESIGN)) - np.where(offset > 0, seen, 0)) / seen.sum()
    assert np.abs(residual.sum(axis=1) + 1e-9 * own).max() < 1e-8
    for gradient, x in (((residual @ DESIGN).sum(axis=0) + alpha * (1 - l1) * shared, shared), (residual @ DESIGN + alpha * (1 - l1) * inter, inter)):
        assert np.abs(gradient + alpha * l1 * np.sign(x))[x != 0].max(initial=0) < 1e-7
        assert np.abs(gradient)[x == 0].max(initial=0) <= alpha * l1 + 1e-9
    # descent with soft thresholds from elsewhere doesn't get below it
    rng, best = np.random.default_rng(2), st.objective(seen, offset, own, shared, inter, DESIGN, alpha, l1)
    for _ in range(200):
        moved = (x + rng.normal(size=x.shape) * 10 ** rng.uniform(-4, -1) for x in (own, shared, inter))
        assert st.objective(seen, offset, *moved, DESIGN, alpha, l1) >= best - 1e-12


def test_no_dependence_gives_zero_blocks():
    _, offset = table(3)
    seen = offset * np.exp(np.linspace(-1, 1, len(offset)))[:, None]  # no noise either
    own, shared, inter = st.elastic_net(seen, offset, DESIGN, alpha=5e-3, l1=1.0)
    assert not inter.any() and not shared.any() and np.abs(own).max() > 0.5
    kept, _, _ = st.elastic_net(seen, offset, DESIGN, (own - 3, shared, inter), alpha=5e-3, keep_own=True)
    assert np.ptp(kept - own) < 1e-9 and np.allclose(kept, own, atol=0.01)
    nothing = st.elastic_net(np.zeros((2, 9)), np.ones((2, 9)), DESIGN)
    assert not nothing[1].any() and not nothing[2].any()


@pytest.fixture(scope="module")
def world(spark):
    """Component p has twice the rate of context A where the strand is 1 as seen from the configuration; q has no states."""
    rng, n = np.random.default_rng(5), 150
    strand = rng.integers(-1, 2, size=n)
    spectra = {"p": np.array([0.7, 0.2, 0.1]), "q": np.array([0.1, 0.2, 0.7])}
    seen = []
    for s in range(4):
        for i in range(n):
            for o in (0, 1):
                sign = strand[i] if o == 0 else -strand[i]
                for c, name in enumerate("ABC"):
                    m = rng.poisson((1 + s) * spectra["p"][c] * (3.0 if sign == 1 and c == 0 else 1.0) + (4 - s) * spectra["q"][c])
                    if m:
                        seen.append((s, i, o, name, float(m)))
    return {
        "loci": spark.createDataFrame([(i, 1.0, int(v)) for i, v in enumerate(strand)], "locus long, exposure double, strand int").cache(), "freq": spark.createDataFrame([(i, o, c, 1.0) for i in range(n) for o in (0, 1) for c in "ABC"], "locus long, configuration int, context string, freq double").cache(),
        "obs": spark.createDataFrame(seen, "sample int, locus long, configuration int, context string, weight double").cache(), "fixed": {k: dict(zip("ABC", map(float, v), strict=True)) for k, v in spectra.items()}, "strand": strand, "seen": seen,
    }


def test_training_recovers_strand_effects(spark, world):
    m = tp.fit(world["obs"], world["freq"], world["loci"], [], 2, epochs=2, locus_model="none", fixed=world["fixed"], rounds=4, states=st.States(["strand"]), alpha=1e-4)
    plus = m.states.names().index("strand:1")
    effect = m.shared[0] + m.interactions[0]  # contexts x features
    assert abs(effect[0, plus] - effect[1:, plus].mean() - np.log(3)) < 0.35
    assert effect[0, plus] - (m.shared[1] + m.interactions[1])[0, plus] > 0.3 and np.abs(effect[1:, plus]).max() < 0.5
    found = {(r.component, r.context, r.state): r.value for r in m.state_summary(spark).collect()}
    assert found["p", "A", "strand:1"] - found["p", "A", "Baseline"] == pytest.approx(effect[0, plus])
    plain = tp.fit(world["obs"], world["freq"], world["loci"], [], 2, epochs=1, locus_model="none", fixed=world["fixed"], rounds=4)
    assert m.scores[-1] > plain.scores[-1] + 0.01


def test_unstranded_models_add_up_configurations(world):
    m = tp.fit(world["obs"], world["freq"], world["loci"], [], 2, epochs=1, locus_model="none", fixed=world["fixed"], rounds=3, stranded=False)
    by_hand = world["obs"].groupBy("sample", "locus", "context").agg(F.sum("weight").alias("weight")).withColumn("configuration", F.lit(0))
    freq = world["freq"].groupBy("locus", "context").agg(F.sum("freq").alias("freq")).withColumn("configuration", F.lit(0))
    same = tp.fit(by_hand, freq, world["loci"], [], 2, epochs=1, locus_model="none", fixed=world["fixed"], rounds=3)
    assert np.allclose(m.effects, same.effects) and np.allclose(m.log_norm, same.log_norm) and m.scores == pytest.approx(same.scores)
    got, want = ({(r.sample, r.component): r.value for r in x.predict(world["obs"] if x is m else by_hand, world["freq"] if x is m else freq, world["loci"], rounds=5).collect()} for x in (m, same))
    assert got == pytest.approx(want)
