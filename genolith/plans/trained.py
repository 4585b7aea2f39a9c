"""A topography model with what it needs to meet a dataset: fitted feature transformers, saved and loaded with it."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.functions import sequence as sq
from genolith.operators import intervals as iv
from genolith.operators import mutations as mu
from genolith.operators.fitted import FeatureTransformer, Normalizer, feature_matrix
from genolith.plans import states as st
from genolith.plans import topography as tp
from genolith.sources import text as tx
from genolith.sources.store import Dataset


def frequencies(ds: Dataset) -> DataFrame:
    """(locus, configuration, context, freq) of the 96 contexts; the three mutations of a trinucleotide have the same frequency."""
    names = sq.dim_context(ds.spark).select("trinucleotide", F.col("label").alias("context"))
    return ds.table("context_freq").join(F.broadcast(names), "trinucleotide").select("locus", "configuration", "context", F.col("freq").cast("double").alias("freq"))  # 96 names


def wide_features(ds: Dataset, source: str | None = None) -> tuple[DataFrame, list]:
    """(locus, exposure, a column for each active feature that is shared or of the source), and the features' records."""
    meta = [r for r in ds.list_features().collect() if r.source is None or r.source == source]
    loci = ds.table("regions").select("locus", F.col("exposure").cast("double").alias("exposure"))
    if not meta:
        return loci, meta
    rows = ds.features().where(F.col("source").isNull() | F.col("source").eqNullSafe(F.lit(source)))
    return loci.join(feature_matrix(rows, [r.name for r in meta]), "locus", "left"), meta


@dataclass
class Trained:
    """source: whose features a dataset of several sources is seen with."""

    topography: tp.Topography
    transformer: FeatureTransformer
    source: str | None = None

    @classmethod
    def fit(cls, ds: Dataset, k: int, test: Dataset | None = None, source: str | None = None, **options) -> Trained:
        """Fit the transformers on the dataset's loci, then the model; options: those of `topography.fit`.

        Strand and mesoscale features become genome states, continuous ones are normalised as declared, categorical ones are 0/1 columns.
        """
        wide, meta = wide_features(ds, source)
        numbers = {r.name: r.normalization for r in meta if r.kind == "continuous"}
        coded = [r.name for r in meta if r.kind in ("categorical", "mesoscale")]
        found = wide.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in coded]).first().asDict() if coded else {}  # declared classes, few
        classes = {r.name: found[r.name] for r in meta if r.kind == "categorical"}
        strands = [r.name for r in meta if r.kind == "strand"]
        labels = {r.name: found[r.name] for r in meta if r.kind == "mesoscale"}
        transformer = FeatureTransformer.fit(wide, numbers, classes)
        states = st.States(strands, labels) if strands or labels else None
        model = cls(tp.Topography([], [], None, [], None, None, states=states), transformer, source)
        freq, loci = model.inputs(ds)
        held = None
        if test is not None:
            held = test.observations()
            loci = loci.unionByName(model.inputs(test)[1].join(loci, "locus", "left_anti"))
            freq = freq.unionByName(frequencies(test).join(freq.select("locus").distinct(), "locus", "left_anti"))
        model.topography = tp.fit(ds.observations(), freq, loci, transformer.names(), k, test=held, states=states, **options)
        return model

    def inputs(self, ds: Dataset) -> tuple[DataFrame, DataFrame]:
        """freq, and loci with the transformed features."""
        wide, _ = wide_features(ds, self.source)
        return frequencies(ds), self.transformer.apply(wide)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.topography.save(spark, f"{path}/topography")
        for name, n in self.transformer.normalizers.items():
            n.save(f"{path}/normalizers/{name}")
        about = json.dumps({"normalizers": list(self.transformer.normalizers), "classes": self.transformer.classes, "width": self.transformer.width, "source": self.source})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trained:
        about = json.loads(spark.read.parquet(f"{path}/about").first().about)
        normalizers = {n: Normalizer.load(spark, f"{path}/normalizers/{n}") for n in about["normalizers"]}
        return cls(tp.Topography.load(spark, f"{path}/topography"), FeatureTransformer(normalizers, about["classes"], about["width"]), about["source"])

    def predict(self, ds: Dataset, rounds: int = 50) -> DataFrame:
        """(sample, component, value)."""
        return self.topography.predict(ds.observations(), *self.inputs(ds), rounds)

    def annotate(self, ds: Dataset, shap: bool = True) -> dict[str, DataFrame]:
        return self.topography.annotate(ds.observations(), *self.inputs(ds), shap)

    def notes(self, ds: Dataset, variants: DataFrame, whitelist: DataFrame | None = None, rounds: int = 50) -> tuple[DataFrame, dict[str, str]]:
        """(chrom, pos0, logp_<component> ...) of the variants that fall into the dataset's regions, and the fields' types.

        whitelist (chrom, start, end): only what was assayed counts, and a region's exposure is scaled by its assayed part.
        """
        freq, loci = self.inputs(ds)
        blocks = iv.unstack(ds.table("regions").select("locus", "chrom", "start", "end", "blocks")).where(F.col("end") > F.col("start"))
        width = int(ds.attrs().get("region_size", 10_000))
        if whitelist is not None:
            parts = iv.overlap_join(blocks, iv.merge(whitelist.select("chrom", "start", "end")), width).groupBy("locus").agg(F.sum(F.least("end", "end_b") - F.greatest("start", "start_b")).alias("covered"))
            whole = blocks.groupBy("locus").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
            share = whole.join(parts, "locus", "left").select("locus", (F.coalesce("covered", F.lit(0)) / F.col("bases")).alias("share"))
            loci = loci.join(share, "locus").withColumn("exposure", F.col("exposure") * F.col("share")).drop("share")
        rows = tp._cut(mu.ingest_rows(variants, tx.read_fasta(ds.spark, ds.attrs()["fasta_file"]), blocks, whitelist, width=width))
        model = self.topography
        if whitelist is not None:  # the cells have other exposures now
            model = tp.Topography.from_json(model.to_json())
            model.log_norm = model.normalizers(freq, loci)
        posterior = model.mutation_posteriors(rows, freq, loci, rounds)
        place = variants.groupBy("id").agg(F.first("chrom").alias("chrom"), F.first("pos0").alias("pos0"))
        columns = {c: "logp_" + "".join(x if x.isalnum() else "_" for x in c) for c in model.components}
        wide = posterior.groupBy("id").agg(*[F.max(F.when(F.col("component") == c, F.col("logp"))).alias(n) for c, n in columns.items()])
        return wide.join(place, "id").drop("id"), dict.fromkeys(columns.values(), "Float")
