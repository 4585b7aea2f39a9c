"""Build a dataset from a configuration: regions, features and samples, step by step and repeatable."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.functions.modality import modality
from genolith.operators import features as ft
from genolith.operators import intervals as iv
from genolith.sources import text as tx
from genolith.sources.bigwig import read_bigwig
from genolith.sources.store import Dataset

#: Kinds of feature files by extension and the normalizations that fit them.
BED, GRAPH, BIGWIG = (".bed", ".bed.gz"), (".bedgraph", ".bedgraph.gz", ".bg"), (".bw", ".bigwig")


@dataclass
class Feature:
    path: str
    normalization: str
    group: str = "all"
    source: str | None = None
    priority: list[str] | None = None

    def kind(self) -> str:
        return self.normalization if self.normalization in ("categorical", "mesoscale", "strand") else "continuous"


@dataclass
class Sample:
    path: str
    weight: str | None = None
    name_in_file: str | None = None
    pass_only: bool = True


@dataclass
class Config:
    name: str
    sizes: str
    fasta: str
    region_size: int
    min_region_size: int = 0
    blacklist: str | None = None
    dtype: str = "sbs"
    features: dict[str, Feature] = field(default_factory=dict)
    samples: dict[str, Sample] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if bad := [s for s in self.samples if "/" in s]:
            raise ValueError(f"sample names must not hold a slash: {bad}")
        if self.region_size <= 0:
            raise ValueError("region_size must be positive")

    @classmethod
    def parse(cls, *parts: dict) -> Config:
        """Nested dictionaries (for example from YAML files), later ones win."""
        d = tx.merge_configs(*parts)
        return cls(**d | {"features": {k: Feature(**v) for k, v in d.get("features", {}).items()}, "samples": {k: Sample(**v) for k, v in d.get("samples", {}).items()}})

    def cutouts(self) -> list[str]:
        """Feature names whose BED files cut the regions."""
        return [n for n, f in self.features.items() if f.path.lower().endswith(BED)]


def region_sequences(blocks: DataFrame, chunks: DataFrame, chunk: int = tx.CHUNK) -> DataFrame:
    """(locus, start, seq) of each block with one base on both sides, cut at chunk borders so no k-mer is lost or counted twice.

    A piece covers the block's centres that lie in one chunk; chunks overlap by one base on both sides.
    """
    each = blocks.withColumn("chunk", F.explode(F.sequence(F.expr(f"start div {chunk}"), F.expr(f"(end - 1) div {chunk}"))))
    joined = each.join(chunks, ["chrom", "chunk"])
    low, high = F.greatest("start", F.col("chunk") * chunk), F.least("end", (F.col("chunk") + 1) * chunk)
    shift = F.col("chunk") * chunk - F.when(F.col("chunk") > 0, 1).otherwise(0)  # position of the piece's first letter
    begin = F.greatest(low - 1 - shift, F.lit(0))
    return joined.select("locus", "start", F.substring(F.col("seq"), (begin + 1).cast("int"), (high + 1 - shift - begin).cast("int")).alias("seq"))


@dataclass
class Step:
    """One output of a build. key: a digest of the settings and files that it comes from, kept with the dataset once the output is whole."""

    name: str
    key: str
    stale: bool


def _print_of(spark: SparkSession, path: str | None) -> list:
    """Path, length and time of change of a file, in any file system that Spark knows."""
    if not path:
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(at)
    return [path, status.getLen(), status.getModificationTime()]


def steps(spark: SparkSession, config: Config, path: str) -> list[Step]:
    """What a build consists of, and which of it the dataset at path doesn't have as the configuration asks."""

    def digest(*parts) -> str:
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()

    try:
        known = Dataset(spark, path).attrs()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = {}
    base = digest(config.region_size, config.min_region_size, config.dtype, *[_print_of(spark, f) for f in (config.sizes, config.fasta, config.blacklist)], sorted([n, _print_of(spark, config.features[n].path)] for n in config.cutouts()))
    wanted = {"regions": base} | {f"feature.{n}": digest(base, asdict(f), _print_of(spark, f.path)) for n, f in config.features.items()} | {f"sample.{n}": digest(base, asdict(s), _print_of(spark, s.path)) for n, s in config.samples.items()}
    return [Step(n, k, known.get(f"key.{n}") != k) for n, k in wanted.items()]


def compose(spark: SparkSession, config: Config, path: str) -> Dataset:
    """Regions from windows cut by the BED features, context frequencies, then each feature and sample.

    Done again, only what has changed is made anew: a step whose settings and files are the same is left out, other regions mean a new dataset.
    A step's key is written after its output, so a build that was broken off goes on where it stopped. Features and samples that the configuration has no more are removed.
    """
    todo = {s.name: s for s in steps(spark, config, path)}
    ds = Dataset(spark, path)
    chunks = tx.read_fasta(spark, config.fasta)
    if todo["regions"].stale:
        _regions(spark, config, ds, chunks)
        todo = {n: Step(n, s.key, True) for n, s in todo.items()}
        ds.set_attrs(**{"key.regions": todo["regions"].key})
    mode = modality(config.dtype)
    stored = iv.unstack(ds.table("regions").select("locus", "chrom", "start", "end", "blocks"))
    for name, f in config.features.items():
        if (step := todo[f"feature.{name}"]).stale:
            ds.add_feature(name, feature_values(spark, stored, f, config.region_size), f.kind(), f.normalization, f.source, f.group, ft.class_order(f.priority) if f.priority else None)
            ds.set_attrs(**{f"key.{step.name}": step.key})
    for name, s in config.samples.items():
        if (step := todo[f"sample.{name}"]).stale:
            v = tx.read_vcf(spark, s.path, s.name_in_file, s.pass_only, s.weight)
            ds.add_sample(name, mode.ingest(v, chunks, stored, width=config.region_size).drop("sample"))
            ds.set_attrs(**{f"key.{step.name}": step.key})
    for r in ds.list_features().collect():
        if f"key.feature.{r.name}" in ds.attrs() and f"feature.{r.name}" not in todo:
            ds.remove_feature(r.name, r.source)
            ds.set_attrs(**{f"key.feature.{r.name}": ""})
    for name in ds.list_samples():
        if f"key.sample.{name}" in ds.attrs() and f"sample.{name}" not in todo:
            ds.remove_sample(name)
            ds.set_attrs(**{f"key.sample.{name}": ""})
    return ds


def _regions(spark: SparkSession, config: Config, ds: Dataset, chunks: DataFrame) -> None:
    """The dataset with its regions and context frequencies, and nothing else; an older one made from other regions is written over."""
    sizes = tx.read_sizes(spark, config.sizes)
    windows = iv.fixed_windows(sizes, config.region_size)
    beds = {n: tx.read_bed(spark, config.features[n].path) for n in config.cutouts()}
    black = tx.read_bed(spark, config.blacklist).select("chrom", "start", "end") if config.blacklist else None
    tracks = None
    for n, b in beds.items():
        t = b.select("chrom", "start", "end", F.lit(n).alias("track"), "feature")
        tracks = t if tracks is None else tracks.unionByName(t)
    if tracks is None:
        tracks = spark.createDataFrame([], "chrom string, start long, end long, track string, feature string")
    regions = iv.multi_block_regions(tracks, windows, black, config.min_region_size, config.region_size)
    blocks = iv.unstack(regions.select("locus", "chrom", "start", "end", "blocks"))
    sequences = region_sequences(blocks, chunks)
    freq = modality(config.dtype).context_frequencies(sequences.withColumn("piece", F.monotonically_increasing_id()), "locus", "seq")
    length = regions.select("*", F.col("length").alias("bp_length")).drop("length")
    total = freq.groupBy("locus").agg((F.sum("freq") * 3).alias("length"))
    Dataset.create(spark, ds.path, config.name, length.join(total, "locus", "left").na.fill(0.0, ["length"]), freq, config.dtype, mode="overwrite", region_size=str(config.region_size), fasta_file=config.fasta)


def feature_values(spark: SparkSession, blocks: DataFrame, f: Feature, width: int) -> DataFrame:
    """(locus, num): mean of a numeric track (of a bigWig file over the covered bases), or the ordinal of a class or strand."""
    loci = blocks.select("locus").distinct()
    if f.kind() == "continuous" and f.path.lower().endswith(BIGWIG):
        overlap = F.least("end", "end_b") - F.greatest("start", "start_b")
        got = iv.overlap_join(blocks, read_bigwig(spark, f.path), width).groupBy("locus").agg((F.sum(F.col("score_b") * overlap) / F.sum(overlap)).alias("num"))
        return loci.join(got, "locus", "left")
    if f.kind() == "continuous":
        track = tx.read_bedgraph(spark, f.path)
        got = iv.overlap_join(blocks, track, width).groupBy("locus").agg(F.avg("score_b").alias("num"))
        return loci.join(got, "locus", "left")
    track = tx.read_bed(spark, f.path)
    order = ["-", "+"] if f.kind() == "strand" else f.priority or sorted(r[0] for r in track.select("feature").distinct().limit(ft.MAX_CLASSES + 1).collect())
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    got = iv.overlap_join(blocks, track.select("chrom", "start", "end", "feature"), width).groupBy("locus").agg(F.min(F.element_at(rank, F.col("feature_b"))).alias("r"))
    code = F.when(F.col("r") == 0, -1.0).when(F.col("r") == 1, 1.0).otherwise(0.0) if f.kind() == "strand" else F.coalesce((F.lit(len(order)) - F.col("r")).cast("double"), F.lit(0.0))
    return loci.join(got, "locus", "left").select("locus", code.alias("num"))
