"""Fitted transformers against the one-step normalisers, the tuning study, and contigs read by lines."""

import math
import random

import numpy as np
import pytest

from genolith.operators import features as ft
from genolith.operators import fitted
from genolith.plans.tuning import Pruned, Study
from genolith.sources import text as tx


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(2)
    rows = [(i, "ab"[i % 2], None if i == 3 else float("nan") if i == 4 else float(rng.randrange(1, 40)), "xyz"[i % 3]) for i in range(60)]
    return spark.createDataFrame(rows, "locus long, source string, v double, kind string").cache()


@pytest.mark.parametrize("kind", ["standardize", "minmax", "robust", "log1p_cpm", "quantile"])
def test_fit_and_apply_equal_the_one_step(spark, values, kind, tmp_path):
    want = {r.locus: r.norm for r in ft.NORMALIZERS[kind](values, "v", ["source"]).collect()}
    n = fitted.Normalizer.fit(values, kind, "v", ["source"])
    n.save(str(tmp_path / "n"))
    for m in (n, fitted.Normalizer.load(spark, str(tmp_path / "n"))):
        got = {r.locus: r.norm for r in m.apply(values).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) if want[k] is not None else got[k] is None for k in want)
    other = spark.createDataFrame([(1, "c", 3.0)], "locus long, source string, v double")
    assert n.apply(other).first().norm is None  # a source that was not fitted


def test_feature_transformer(spark, values):
    t = fitted.FeatureTransformer.fit(values, {"v": "standardize"}, {"kind": ["x", "y", "z"]}, width=1)
    out = t.apply(values).orderBy("locus").collect()
    assert len(t.names()) == 9 and all(n in out[0].asDict() for n in t.names())
    assert out[5]["kind=y:0"] == float(5 % 3 == 1) and out[5]["v:+1"] == out[6]["v:0"] and out[0]["v:-1"] == out[0]["v:0"]
    assert fitted.FeatureTransformer.fit(values, {"v": "minmax"}, {}).names() == ["v"]


def test_small_helpers(spark, values):
    d = fitted.design_matrix(3, np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert d.shape == (6, 2 + 6) and (d[:3, :2] == [[1, 0]] * 3).all() and d[1, 2 + 1] == 1 and d.sum() == 12
    df = spark.createDataFrame([("a", 1000.0), ("a", 1001.0), ("b", -5.0)], "k string, value double")
    got = dict(map(tuple, fitted.logsumexp(df, "value", ["k"]).collect()))
    assert got["a"] == pytest.approx(1001 + math.log(1 + math.exp(-1))) and got["b"] == -5
    f = spark.createDataFrame([(1, "p", 2.0), (1, "q", 3.0), (2, "p", 4.0)], "locus long, name string, num double")
    assert {tuple(r) for r in fitted.feature_matrix(f, ["p", "q"]).collect()} == {(1, 2.0, 3.0), (2, 4.0, None)}
    assert {r.norm for r in fitted.apply_rows(f, ["locus"], "num", "minmax").collect()} == {0.0, 1.0}


def test_study(spark, tmp_path):
    def train(params, heard):
        for e in range(20):
            heard(e, -((params["x"] - 7) ** 2) - 1 / (e + 1))
        if params["kind"] == "bad":
            raise ValueError("no")
        return -((params["x"] - 7) ** 2)

    study = Study({"x": (0, 10), "rate": (1e-3, 1.0, "log"), "kind": ["good", "good", "bad"]}, seed=3, least=5)
    best = study.run(train, 30)
    states = {t.state for t in study.trials}
    assert best.value == max(t.value for t in study.trials if t.state == "complete") and "pruned" in states and any(s.startswith("failed") for s in states)
    assert all(1e-3 <= t.params["rate"] <= 1 for t in study.trials) and study.retrain(train) == best.value
    study.save(spark, str(tmp_path / "s"))
    again = Study.load(spark, str(tmp_path / "s"), study.space)
    assert again.best().params == best.params and again.summary(spark).first().number == study.summary(spark).first().number
    with pytest.raises(ValueError, match="no trial"):
        Study({}).run(lambda p, h: (_ for _ in ()).throw(Pruned) if h(0, 1.0) is None else 0, 0)


def test_fasta_by_lines_over_splits(spark, tmp_path):
    rng = random.Random(5)
    contigs = {f"c{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate((1, 7, 8, 9, 333, 0, 64))}
    lines = []
    for name, seq in contigs.items():
        lines += [f">{name} about"] + [seq[i : i + 10].lower() for i in range(0, len(seq), 10)]
    (tmp_path / "g.fa").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {(r.chrom, r.chunk): r.seq for r in tx.read_fasta(spark, str(tmp_path / "g.fa"), chunk=8).collect()}
            want = {(c, k): s[max(0, 8 * k - 1) : 8 * k + 9] for c, s in contigs.items() for k in range((len(s) + 7) // 8)}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
