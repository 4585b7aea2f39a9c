"""Command line: build and edit datasets, train and apply models."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from genolith.operators import intervals as iv
from genolith.operators import mutations as mu
from genolith.operators.tensor import split_by_group
from genolith.plans.compose import Config, compose
from genolith.plans.trained import Trained
from genolith.plans.tuning import SharedStudy, topography_trial
from genolith.sources import text as tx
from genolith.sources.store import Dataset


def _load(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="genolith", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for o, kw in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", **kw)
        return c

    add("compose", "out").add_argument("configs", nargs="+")
    add("info", "dataset")
    add("set-attr", "dataset", "key", "value")
    add("slice-regions", "dataset", "out").add_argument("regions", nargs="+")
    add("feature-ls", "dataset")
    add("feature-rm", "dataset", "name", source={})
    add("feature-edit", "dataset", "name", source={}, group={}, normalization={})
    add("sample-ls", "dataset")
    add("sample-rm", "dataset", "name")
    add("query-gtf", "gtf", "template", type={}, has={"nargs": "*", "default": []}, zero_based={"action": "store_true"})
    add("fill-template", "template").add_argument("values", nargs="*", help="name=value")
    add("train", "dataset", "model", components={"type": int, "default": 5}, epochs={"type": int, "default": 20}, seed={"type": int, "default": 0}, locus_model={"choices": ["linear", "boosted", "none"], "default": "linear"}, subsample={"type": float, "default": 1.0},
        unstranded={"action": "store_true"}, fixed={"help": "JSON file of components that stay as they are"}, test={"help": "dataset that decides when to stop"}, source={})
    rounds = {"type": int, "default": 50, "help": "rounds of a sample's fixed point"}
    add("predict", "dataset", "model", "out", rounds=rounds)
    add("annotate", "dataset", "model", "out")
    add("mutation-posteriors", "dataset", "model", "vcf", "out", sample={}, all={"action": "store_true"}, whitelist={"help": "BED file of the parts that were assayed"}, rounds=rounds)
    add("study-create", "study", "train", min_components={"type": int, "default": 2}, max_components={"type": int, "default": 20}, test={}, epochs={"type": int, "default": 20}, seed={"type": int, "default": 0}, locus_models={"nargs": "+", "default": ["linear"]})
    add("study-run", "study", trials={"type": int, "default": 20, "help": "stop when the study has so many"})
    add("study-summary", "study")
    add("study-retrain", "study", "model")
    add("split", "dataset", "train", "test").add_argument("chroms", nargs="+")
    add("slice-samples", "dataset", "out").add_argument("samples", nargs="+")
    add("background-rate", "vcf", "sizes", "out", window={"type": int, "default": 50_000}, sample={}, all={"action": "store_true", "help": "not only PASS"})
    add("cluster", "vcf", "rates", "out", alpha={"type": float, "default": mu.ALPHA}, max_gap={"type": int, "default": mu.MAX_GAP}, sample={}, all={"action": "store_true"})
    add("annotate-vcf", "vcf", "notes", "out", fields={"nargs": "+", "default": [], "help": "name:type, columns of the notes table"})
    return p


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """Do one command; returns the lines to print."""
    a = parser().parse_args(argv)
    ds = Dataset(spark, a.dataset) if hasattr(a, "dataset") else None
    if a.command == "compose":
        return compose(spark, Config.parse(*map(_load, a.configs)), a.out).problems()
    if a.command == "info":
        return [f"{k}\t{v}" for k, v in sorted(ds.attrs().items())] + [f"regions\t{ds.table('regions').count()}", f"features\t{ds.list_features().count()}", f"samples\t{len(ds.list_samples())}"]
    if a.command == "set-attr":
        ds.set_attrs(**{a.key: a.value})
    elif a.command == "slice-regions":
        ds.slice(a.out, a.regions)
    elif a.command == "feature-ls":
        return ["\t".join(str(x) for x in (r.source, r.name, r.kind, r.normalization, r.grp)) for r in ds.list_features().collect()]
    elif a.command == "feature-rm":
        ds.remove_feature(a.name, a.source)
    elif a.command == "feature-edit":
        ds.edit_feature(a.name, a.source, **{k: v for k, v in (("grp", a.group), ("normalization", a.normalization)) if v})
    elif a.command == "sample-ls":
        return ds.list_samples()
    elif a.command == "sample-rm":
        return [] if ds.remove_sample(a.name) else [f"no sample {a.name}"]
    elif a.command == "query-gtf":
        records = tx.filter_records(tx.read_gtf(spark, a.gtf), a.type, a.has)
        return [r.value for r in tx.format_records(records, a.template, a.zero_based).toLocalIterator()]
    elif a.command == "fill-template":
        return [tx.fill_template(Path(a.template).read_text(), **dict(v.split("=", 1) for v in a.values))]
    elif a.command == "train":
        fixed = {}
        for r in tx.read_components(spark, a.fixed).collect() if a.fixed else ():
            fixed.setdefault(r.component, {})[r.context] = r.value
        m = Trained.fit(ds, a.components, test=Dataset(spark, a.test) if a.test else None, source=a.source, epochs=a.epochs, seed=a.seed, locus_model=a.locus_model, subsample=a.subsample, stranded=not a.unstranded, fixed=fixed)
        m.save(a.model)
        return [f"score\t{m.topography.scores[-1]:.6f}"]
    elif a.command == "study-create":
        space = {"components": (a.min_components, a.max_components), "locus_model": a.locus_models, "seed": [a.seed]}
        SharedStudy.create(spark, a.study, space, a.seed, train=a.train, test=a.test, epochs=a.epochs)
    elif a.command in ("study-run", "study-retrain"):
        study = SharedStudy(spark, a.study)
        train = topography_trial(spark, study.about)
        return [f"ran {n}" for n in study.run(train, a.trials)] if a.command == "study-run" else [f"score\t{study.retrain(train, a.model):.6f}"]
    elif a.command == "study-summary":
        return ["\t".join(map(str, r)) for r in SharedStudy(spark, a.study).study().summary(spark).collect()]
    elif a.command == "split":
        regions = ds.table("regions")
        train, test = split_by_group(regions, a.chroms, "chrom")
        ds.subset(a.train, train)
        ds.subset(a.test, test)
    elif a.command == "slice-samples":
        ds.subset(a.out, ds.table("regions"), a.samples)
    elif a.command == "background-rate":
        points = tx.read_vcf(spark, a.vcf, a.sample, not a.all).select("chrom", F.col("pos0").alias("start"))
        rates = iv.background_rate(points, iv.fixed_windows(tx.read_sizes(spark, a.sizes), a.window), a.window)
        rates.select(F.concat_ws("\t", "chrom", "start", "end", "rate").alias("value")).write.text(a.out)
    elif a.command == "cluster":
        points = tx.read_vcf(spark, a.vcf, a.sample, not a.all).select("id", "chrom", F.col("pos0").alias("pos"))
        rain = mu.rainfall(points, tx.read_bedgraph(spark, a.rates))
        found = mu.cluster_mutations(rain, a.alpha, a.max_gap).select("chrom", F.col("pos").alias("pos0"), F.col("cluster").alias("cluster"), F.col("cluster_size").alias("clusterSize"), F.col("distance").alias("rainfallDistance"))
        lines = tx.annotate_vcf(spark, a.vcf, found, {"cluster": "String", "clusterSize": "Integer", "rainfallDistance": "Float"})
        lines.orderBy("rank").select("value").write.text(a.out)
    elif a.command == "annotate-vcf":
        fields = dict(f.split(":", 1) for f in a.fields)
        tx.annotate_vcf(spark, a.vcf, spark.read.parquet(a.notes), fields).orderBy("rank").select("value").write.text(a.out)
    elif a.command == "predict":
        Trained.load(spark, a.model).predict(ds, a.rounds).write.parquet(a.out)
    elif a.command == "annotate":
        for name, table in Trained.load(spark, a.model).annotate(ds).items():
            table.write.parquet(f"{a.out}/{name}")
    elif a.command == "mutation-posteriors":
        m = Trained.load(spark, a.model)
        notes, fields = m.notes(ds, tx.read_vcf(spark, a.vcf, a.sample, not a.all), tx.read_bed(spark, a.whitelist) if a.whitelist else None, a.rounds)
        tx.annotate_vcf(spark, a.vcf, notes, fields).orderBy("rank").select("value").write.text(a.out)
    return []


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("genolith").getOrCreate()
    print(*run(spark, sys.argv[1:]), sep="\n")


if __name__ == "__main__":
    main()
