"""From files to an annotated VCF: compose, train, save, load, predict, annotate, posteriors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolith import cli
from genolith.plans import topography as tp
from genolith.plans.compose import Config, compose
from genolith.plans.trained import Trained
from genolith.sources import text as tx


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("trained")
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    (at / "a.sizes").write_text("c1\t3000\n")
    (at / "a.fa").write_text(f">c1\n{seq}\n")
    (at / "r.bedgraph").write_text("".join(f"c1\t{i}\t{i + 100}\t{1 + (i // 100) % 3}\n" for i in range(0, 3000, 100)))
    (at / "strand.bed").write_text("c1\t0\t1000\t+\nc1\t1500\t2500\t-\n")
    (at / "white.bed").write_text("c1\t0\t2000\tx\n")
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    for name, alt in (("one", "A"), ("two", "T")):
        places = sorted(rng.sample([p for p in range(1, 2999) if seq[p] != alt], 150))
        (at / f"{name}.vcf").write_text(head + "".join(f"c1\t{p + 1}\t.\t{seq[p]}\t{alt}\t.\tPASS\t.\tGT\t1\n" for p in places))
    config = {"name": "toy", "sizes": str(at / "a.sizes"), "fasta": str(at / "a.fa"), "region_size": 100, "features": {"rate": {"path": str(at / "r.bedgraph"), "normalization": "standardize"}, "side": {"path": str(at / "strand.bed"), "normalization": "strand"}}, "samples": {n: {"path": str(at / f"{n}.vcf")} for n in ("one", "two")}}
    return at, compose(spark, Config.parse(config), str(at / "d"))


def test_commands_from_dataset_to_annotated_vcf(spark, made):
    at, ds = made
    out = cli.run(spark, ["train", ds.path, str(at / "m"), "--components", "2", "--epochs", "1"])
    assert out[0].startswith("score\t")
    model = Trained.load(spark, str(at / "m"))
    assert model.topography.states.strands == ["side"] and model.transformer.names() == ["rate"]
    cli.run(spark, ["predict", ds.path, str(at / "m"), str(at / "p"), "--rounds", "5"])
    got = {(r.sample, r.component): r.value for r in spark.read.parquet(str(at / "p")).collect()}
    total = {r.sample: r.w for r in ds.observations().groupBy("sample").agg(F.sum("weight").alias("w")).collect()}
    assert all(sum(got[s, c] for c in model.topography.components) == pytest.approx(w, rel=1e-6) for s, w in total.items())
    for extra in ([], ["--whitelist", str(at / "white.bed")]):
        path = str(at / f"v{len(extra)}")
        cli.run(spark, ["mutation-posteriors", ds.path, str(at / "m"), str(at / "one.vcf"), path, "--rounds", "5", *extra])
        lines = [r.value for r in spark.read.text(path).collect()]
        assert sum(x.startswith("##INFO=<ID=logp_M") for x in lines) == 2
        body = [x.split("\t") for x in lines if not x.startswith("#")]
        assert len(body) == 150
        noted = 0
        for f in body:
            info = dict(x.split("=") for x in f[7].split(";") if "=" in x)
            if info:
                noted += 1
                assert sum(np.exp(float(v)) for v in info.values()) == pytest.approx(1, abs=1e-3) and (not extra or int(f[1]) <= 2000)
        assert 80 < noted <= 150
    cli.run(spark, ["annotate", ds.path, str(at / "m"), str(at / "notes")])
    assert spark.read.parquet(str(at / "notes" / "shap")).count() == 2 * ds.table("regions").count()


def test_saved_models_are_the_same(spark, tmp_path):
    from genolith.plans import model as md
    from genolith.plans import states as st
    from genolith.plans import trees as tr

    tree = tr.Tree.of([[0, 0.5, True, 1, 2, 0.0, 9.0], [-1, 0.0, True, -1, -1, 0.25, 4.0], [-1, 0.0, True, -1, -1, -0.5, 5.0]])
    for rates in ([], [tp.LinearRate({"f": 0.5})], [tr.TreeRate(["f"], [tree])], [md.BoostedModel(0.1, [("f", 0.0, 1.0, 2.0)])]):
        m = tp.Topography(["x"], ["A", "B"], np.array([[0.1, -0.1]]), rates, np.ones(1), np.array([3.0]), [0.5], st.States(["s"], {"a": [0.0, 1.0]}), np.zeros((1, 3)), np.ones((1, 2, 3)), False)
        m.save(spark, str(tmp_path / "m"))
        assert tp.Topography.load(spark, str(tmp_path / "m")).to_json() == m.to_json()
    mixture = tp.Mixture(["p", "q"], ["x"], np.array([1.5]), np.array([0.5, 2.0]))
    mixture.save(spark, str(tmp_path / "mix"))
    again = tp.Mixture.load(spark, str(tmp_path / "mix"))
    assert (again.sources, again.components, again.alpha.tolist(), again.tau.tolist()) == (["p", "q"], ["x"], [1.5], [0.5, 2.0])


def test_polyak_prediction_keeps_each_samples_weight(spark):
    """A sample of few mutations is absent from most steps; its mean over all steps has its weight nonetheless."""
    rng, n = np.random.default_rng(7), 120
    loci = spark.createDataFrame([(i, 1.0) for i in range(n)], "locus long, exposure double").cache()
    freq = spark.createDataFrame([(i, 0, c, 1.0) for i in range(n) for c in "AB"], "locus long, configuration int, context string, freq double").cache()
    rows = [("small", int(i), 0, "A", 1.0) for i in rng.choice(n, 5, replace=False)] + [("large", i, 0, "AB"[i % 2], 2.0) for i in range(n)]
    obs = spark.createDataFrame(rows, "sample string, locus long, configuration int, context string, weight double").cache()
    m = tp.Topography(["x", "y"], ["A", "B"], np.log([[0.9, 0.1], [0.2, 0.8]]), [], np.ones(2), np.zeros(2))
    m.log_norm = m.normalizers(freq, loci)
    got = {(r.sample, r.component): r.value for r in tp.polyak_predict(m, obs, freq, loci, subsample=0.25, least=8, most=8, rounds=2).collect()}
    assert sum(got["large", c] for c in "xy") == pytest.approx(240, rel=0.25)
    assert sum(got["small", c] for c in "xy") == pytest.approx(5, rel=0.9)
    assert got["small", "x"] > got["small", "y"]
    steps = [loci.where(F.pmod(F.xxhash64("locus", F.lit(0), F.lit(t)), F.lit(1 << 20)) < int(0.25 * (1 << 20))).select("locus") for t in range(8)]
    drawn = sum(4 * obs.where("sample = 'small'").join(s, "locus", "left_semi").count() for s in steps) / 8
    assert sum(got["small", c] for c in "xy") == pytest.approx(drawn)
