"""Mutation ingestion and clustering as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genolith.functions import sequence as sq
from genolith.operators.intervals import band_rate, nearest_neighbor, overlap_filter, overlap_join, running

MAX_GAP, ALPHA, REACH = 10_000, 0.005, 25_000


def with_context(variants: DataFrame, chunks: DataFrame, chunk: int = 65_536) -> DataFrame:
    """variants (chrom, pos0, ref, alt, ...) plus the trinucleotide around each; chunks (chrom, chunk, seq) overlap by one base on both sides.

    An equi-join on (chrom, chunk); rows at contig edges or whose ref differs from the sequence get a null trinucleotide.
    """
    keyed = variants.withColumn("chunk", F.expr(f"pos0 div {chunk}"))
    at = F.col("pos0") - F.col("chunk") * chunk + F.when(F.col("chunk") > 0, 1).otherwise(0)
    tri = F.when(F.col("pos0") > 0, F.upper(F.substring(F.col("seq"), at.cast("int"), F.lit(3))))
    joined = keyed.join(chunks, ["chrom", "chunk"], "left").withColumn("trinucleotide", tri)
    good = (F.length("trinucleotide") == 3) & (F.substring("trinucleotide", 2, 1) == F.upper("ref"))
    return joined.withColumn("trinucleotide", F.when(good, F.col("trinucleotide"))).drop("chunk", "seq")


def to_cells(variants: DataFrame) -> DataFrame:
    """configuration, context (label) and ok; rows that aren't plain substitutions in ACGT are marked not ok instead of raising."""
    conf, tri, alt = sq.canonical(F.col("trinucleotide"), F.upper("alt"))
    plain = F.coalesce(sq.is_base(F.upper("ref")) & sq.is_base(F.upper("alt")) & F.col("trinucleotide").rlike("^[ACGT]{3}$") & (F.upper("ref") != F.upper("alt")), F.lit(False))
    return variants.withColumns({"configuration": conf, "context": F.when(plain, sq.format_cosmic(tri, alt)), "ok": plain})


def assign_loci(variants: DataFrame, blocks: DataFrame, width: int | None = None) -> DataFrame:
    """variants joined with the block (chrom, start, end, locus) that holds each."""
    points = variants.withColumns({"start": F.col("pos0"), "end": F.col("pos0") + 1})
    return overlap_join(points, blocks.select("chrom", "start", "end", "locus"), width).drop("start", "end", "chrom_b", "start_b", "end_b").withColumnRenamed("locus_b", "locus")


def ingest_rows(variants: DataFrame, chunks: DataFrame, blocks: DataFrame, whitelist: DataFrame | None = None, sample_weight: float = 1.0, width: int | None = None) -> DataFrame:
    """One row per usable variant: id, sample, configuration, context, locus, weight."""
    if whitelist is not None:
        spans = variants.withColumns({"start": F.col("pos0"), "end": F.col("pos0") + 1})
        variants = overlap_filter(spans, whitelist, width=width).drop("start", "end")
    cells = to_cells(with_context(variants, chunks)).where("ok")
    weight = sq.mutation_weight(F.col("raw_weight"), F.col("cluster_size")) * sample_weight
    return assign_loci(cells.withColumn("weight", weight).where("weight is not null"), blocks, width).select("id", "sample", "configuration", "context", "locus", "weight")


def ingest_observations(rows: DataFrame, loci: DataFrame | None = None) -> DataFrame:
    """Cells (sample, configuration, context, locus) with summed weight, optionally for some loci only; raises when empty."""
    if loci is not None:
        rows = rows.join(loci.select("locus").distinct(), "locus", "left_semi")
    out = rows.groupBy("sample", "configuration", "context", "locus").agg(F.sum("weight").alias("weight"))
    if out.isEmpty():
        raise ValueError("no mutation fell into a region")
    return out


def rainfall(points: DataFrame, rates: DataFrame, reach: int = REACH, value: str = "score", own_rate: bool = True) -> DataFrame:
    """id, chrom, pos, distance to the nearest other position, local rate. own_rate False: the neighbour's rate instead."""
    near = nearest_neighbor(points, "pos")
    rate = band_rate(points, rates, ["id"], reach, "pos", value)
    if own_rate:
        return near.join(rate, "id", "left")
    at = points.join(rate, "id").groupBy("chrom", F.col("pos").alias("neighbor")).agg(F.min("local_rate").alias("local_rate"))
    return near.join(at, ["chrom", "neighbor"], "left")


def cluster_mutations(rain: DataFrame, alpha: float = ALPHA, max_gap: int = MAX_GAP) -> DataFrame:
    """Clusters along each chrom: a gap above min(max_gap, the previous row's critical distance) starts a new one.

    Rows without a neighbour or with a rate <= 0 go first. Adds critical, cluster (per chrom, with the chrom in front), cluster_size and
    ratio = -log10(distance / critical).
    """
    rows = rain.where("distance is not null and local_rate > 0").withColumn("critical", sq.exponential_quantile(alpha, F.col("local_rate")))
    along = [F.col("pos"), F.col("id")]
    rows = running(rows, ["chrom"], "pos", along, F.struct("pos", "id", "critical"), "before_")
    gap, limit = F.col("pos") - F.col("before_.pos"), F.least(F.lit(float(max_gap)), F.col("before_.critical"))
    rows = rows.withColumn("new_", F.when(gap.isNull() | (gap > limit), 1).otherwise(0))
    rows = running(rows, ["chrom"], "pos", along, "new_", "n_", "sum", inclusive=True).drop("before_")
    rows = rows.withColumn("cluster", F.concat_ws(":", "chrom", "n_")).withColumn("ratio", -F.log10(F.col("distance") / F.col("critical")))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return rows.join(sizes, "cluster").drop("new_", "n_")


def quantification(annotation: DataFrame, table: DataFrame, key: str = "gene_id") -> DataFrame:
    """annotation (first row per key) with the mean estimate of its key, 0 where there is none; raises when no key is shared."""
    first = annotation.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy("chrom", "start", "end"))).where("r_ = 1").drop("r_")
    mean = table.groupBy("key").agg(F.avg("estimate").alias("estimate"))
    mean = mean.groupBy(sq.strip_version(F.col("key")).alias(key)).agg(F.avg("estimate").alias("estimate")) if key == "gene_id" else mean.withColumnRenamed("key", key)
    if first.join(mean, key, "left_semi").isEmpty():
        raise ValueError(f"the tables share no {key}")
    return first.join(mean, key, "left").withColumn("estimate", F.coalesce("estimate", F.lit(0.0)))
