import numpy as np
import pytest

from genolith import cli
from genolith.functions.modality import modality
from genolith.plans import model as md
from genolith.plans.compose import Config, compose


def test_compose_and_cli(spark, tmp_path):
    seq = "ACGTTGCACCGGATCTTAGC" * 5
    (tmp_path / "a.sizes").write_text("c1\t100\n")
    (tmp_path / "a.fa").write_text(f">c1\n{seq}\n")
    (tmp_path / "g.bed").write_text("c1\t0\t30\tx\nc1\t50\t70\ty\n")
    (tmp_path / "r.bedgraph").write_text("c1\t0\t40\t1.5\nc1\t40\t100\t3.0\n")
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    (tmp_path / "a.vcf").write_text(head + "".join(f"c1\t{p + 1}\t.\t{seq[p]}\t{'A' if seq[p] != 'A' else 'C'}\t.\tPASS\t.\tGT\t1\n" for p in (5, 6, 20, 55, 80)))
    base = {"name": "toy", "sizes": str(tmp_path / "a.sizes"), "fasta": str(tmp_path / "a.fa"), "region_size": 40}
    more = {"features": {"cls": {"path": str(tmp_path / "g.bed"), "normalization": "categorical"}, "rate": {"path": str(tmp_path / "r.bedgraph"), "normalization": "standardize"}}, "samples": {"s1": {"path": str(tmp_path / "a.vcf")}}}
    ds = compose(spark, Config.parse(base, more), str(tmp_path / "d"))
    assert ds.problems() == []
    regions = ds.table("regions").orderBy("start").collect()
    assert sum(r.bp_length for r in regions) == 100
    assert sum(r.length for r in regions) == pytest.approx(3 * 98)  # two contig edges have no 3-mer
    assert ds.observations().agg({"weight": "sum"}).first()[0] == 5.0
    modality("sbs").check(ds.observations())
    assert cli.run(spark, ["sample-ls", ds.path]) == ["s1"]
    cli.run(spark, ["set-attr", ds.path, "note", "x"])
    assert "note\tx" in cli.run(spark, ["info", ds.path])
    cli.run(spark, ["slice-samples", ds.path, str(tmp_path / "one"), "s1"])
    assert cli.run(spark, ["sample-ls", str(tmp_path / "one")]) == ["s1"]
    with pytest.raises(ValueError, match="no sample"):
        cli.run(spark, ["slice-samples", ds.path, str(tmp_path / "none"), "zz"])
    with pytest.raises(ValueError):
        cli.run(spark, ["split", ds.path, str(tmp_path / "p"), str(tmp_path / "q"), "c9"])
    cli.run(spark, ["background-rate", str(tmp_path / "a.vcf"), str(tmp_path / "a.sizes"), str(tmp_path / "rate"), "--window", "50"])
    rates = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "rate")).collect()]
    assert sorted((r[1], float(r[3])) for r in rates) == [("0", pytest.approx(4 / 7)), ("50", pytest.approx(3 / 7))]
    cli.run(spark, ["cluster", str(tmp_path / "a.vcf"), str(tmp_path / "rate"), str(tmp_path / "clustered")])
    lines = [r.value for r in spark.read.text(str(tmp_path / "clustered")).collect()]
    assert len([x for x in lines if not x.startswith("#")]) == 5 and any("clusterSize=" in x for x in lines)
    spark.createDataFrame([("c1", 5, 0.5)], "chrom string, pos0 long, logp double").write.parquet(str(tmp_path / "notes"))
    cli.run(spark, ["annotate-vcf", str(tmp_path / "a.vcf"), str(tmp_path / "notes"), str(tmp_path / "noted"), "--fields", "logp:Float"])
    assert [x for x in spark.read.text(str(tmp_path / "noted")).collect() if "logp=0.5" in x.value][0].value.startswith("c1\t6\t")
    with pytest.raises(ValueError):
        Config.parse(base, {"samples": {"a/b": {"path": "x"}}})
    with pytest.raises(KeyError):
        modality("zz")


def test_mixture_estep_keeps_all_weight():
    rng = np.random.default_rng(0)
    w = rng.random(40)
    nk = md.mixture_estep(np.ones(3), np.ones(2), rng.random((2, 3, 40)), w)
    assert nk.shape == (2, 3) and nk.sum() == pytest.approx(w.sum())


def test_a_second_compose_makes_only_what_changed(spark, tmp_path):
    from genolith.plans.compose import steps

    seq = "ACGTTGCACCGGATCTTAGC" * 5
    (tmp_path / "a.sizes").write_text("c1\t100\n")
    (tmp_path / "a.fa").write_text(f">c1\n{seq}\n")
    for name in "rq":
        (tmp_path / f"{name}.bedgraph").write_text("c1\t0\t40\t1.5\nc1\t40\t100\t3.0\n")
    (tmp_path / "a.vcf").write_text(f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nc1\t6\t.\t{seq[5]}\t{'A' if seq[5] != 'A' else 'C'}\t.\tPASS\t.\tGT\t1\n")
    config = {"name": "toy", "sizes": str(tmp_path / "a.sizes"), "fasta": str(tmp_path / "a.fa"), "region_size": 40, "features": {n: {"path": str(tmp_path / f"{n}.bedgraph"), "normalization": "standardize"} for n in "rq"}, "samples": {"s": {"path": str(tmp_path / "a.vcf")}}}
    path = str(tmp_path / "d")
    stale = lambda c: sorted(s.name for s in steps(spark, Config.parse(c), path) if s.stale)
    assert stale(config) == ["feature.q", "feature.r", "regions", "sample.s"]
    ds = compose(spark, Config.parse(config), path)
    assert stale(config) == []
    age = lambda *names: {n: sorted((f.name, f.stat().st_mtime_ns) for f in (tmp_path / "d" / n).rglob("*.parquet")) for n in names}
    kept = ("regions", "context_freq", "features/source=_shared/name=q", "observations")
    before = age(*kept)
    (tmp_path / "r.bedgraph").write_text("c1\t0\t100\t7.25\n")
    assert stale(config) == ["feature.r"]
    compose(spark, Config.parse(config), path)
    assert age(*kept) == before and stale(config) == []
    assert {r.num for r in ds.features().where("name = 'r'").collect()} == {7.25} and ds.features().where("name = 'r'").count() == ds.table("regions").count()
    less = config | {"features": {"q": config["features"]["q"]}}
    compose(spark, Config.parse(less), path)
    assert [r.name for r in ds.list_features().collect()] == ["q"] and age(*kept) == before
    compose(spark, Config.parse(config), path)  # back again
    assert [r.name for r in ds.list_features().collect()] == ["q", "r"]
    wider = config | {"region_size": 50}
    assert stale(wider) == ["feature.q", "feature.r", "regions", "sample.s"]
    compose(spark, Config.parse(wider), path)
    assert ds.table("regions").count() == 2 and ds.features().count() == 4 and ds.problems() == []
