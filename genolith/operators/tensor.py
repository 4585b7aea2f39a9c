"""The labelled dataset as relations: selection, splits, marginals, mixtures, explanations."""

from __future__ import annotations

import atexit
import fnmatch
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolith.operators.intervals import unstack


def dealt_join(a: DataFrame, b: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """a.join(b) with both sides dealt by key, for tables that grow with the loci.

    Spark sizes a side by the bytes of its files, compressed and before rows are exploded or get arrays; a side of millions of rows that looks small
    would pass through the driver to every task.
    """
    return a.join(b.hint("merge"), on, how)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the checkpoint folder.

    Where none is set, a session on one machine gets a temporary one: kept rows alone let the lineage of steps that build on each other grow, and every
    task carries it. Other sessions keep the rows in memory or on disk.
    """
    context = df.sparkSession.sparkContext
    if not (context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            return df.persist()
        folder = tempfile.mkdtemp(prefix="genolith-")
        atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _remove(jvm, conf, path: str) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the session may be gone at interpreter exit
        pass


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, for what several passes read: a pass reads only the columns it needs, and they are compressed.

    The table is removed when the driver's interpreter ends. Where no folder is set, as `cut`.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return cut(df)
    path = f"{folder.rstrip('/')}/genolith-{uuid.uuid4().hex}"
    atexit.register(_remove, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parse_region(text: str) -> tuple[str, int, int | None]:
    """`chr:start-end`, `chr:start` (open end) or `chr`; commas and underscores in numbers are fine."""
    m = re.fullmatch(r"([^:]+)(?::([\d,_]+)(?:-([\d,_]+))?)?", text.strip())
    if not m:
        raise ValueError(f"not a region: {text!r}")
    number = lambda x: int(re.sub("[,_]", "", x))
    start = number(m[2]) if m[2] else 0
    end = number(m[3]) if m[3] else None
    if end is not None and end < start:
        raise ValueError(f"the region ends before it starts: {text!r}")
    return m[1], start, end


def region_predicate(regions: Sequence[str]) -> Column:
    """Loci that overlap any of the regions; both sides strict."""

    def one(r: str) -> Column:
        chrom, start, end = parse_region(r)
        p = F.col("chrom") == chrom
        if end is not None:
            p = p & (F.col("start") < end)
        return p & (F.col("end") > start) if start or end is not None else p

    return reduce(lambda a, b: a | b, map(one, regions), F.lit(False))


def slice_regions(regions: DataFrame, wanted: Sequence[str], require: bool = True) -> DataFrame:
    """Rows that overlap any wanted region; raises when none does."""
    out = regions.where(region_predicate(wanted))
    if require and out.isEmpty():
        raise ValueError(f"no region overlaps {list(wanted)}")
    return out


def slice_samples(observations: DataFrame, samples: Sequence[str] | None) -> DataFrame:
    """Rows of the samples; an empty or missing list changes nothing."""
    return observations.where(F.col("sample").isin(list(samples))) if samples else observations


def split_by_group(regions: DataFrame, test: Sequence[str], column: str = "chrom") -> tuple[DataFrame, DataFrame]:
    """(train, test): test takes the listed groups; raises when none is present."""
    inside = F.col(column).isin(list(test))
    part = regions.where(inside)
    if part.isEmpty():
        raise ValueError(f"no row has {column} in {list(test)}")
    return regions.where(~inside | F.col(column).isNull()), part


def split_with_thresholds(regions: DataFrame, observations: DataFrame, test: Sequence[str], min_length: float = 5, min_total: float = 800, column: str = "chrom") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, observations) of regions of at least min_length and samples with at least min_total weight; neither part may be empty."""
    good = observations.groupBy("sample").agg(F.sum("weight").alias("total_")).where(F.col("total_") >= min_total).select("sample")
    train, held = split_by_group(regions.where(F.col("length") >= min_length), test, column)
    if train.isEmpty():
        raise ValueError("no region is left for training")
    return train, held, observations.join(good, "sample", "left_semi")


def glob_regex(pattern: str) -> str:
    return fnmatch.translate(pattern).replace(r"\z", r"\Z").replace(r"\Z", "$")


def fetch_features(meta: DataFrame, values: DataFrame, patterns: Sequence[str], source: str | None = None) -> DataFrame:
    """(rank, source, name, locus, num) of active features whose name or `source/name` fits a glob; rank is the first pattern that fits."""
    path = F.concat_ws("/", "source", "name")
    fits = [F.col("name").rlike(glob_regex(p)) | path.rlike(glob_regex(p)) for p in patterns]
    rank = F.coalesce(*[F.when(f, i) for i, f in enumerate(fits)])
    chosen = meta.where("active").withColumn("rank", rank).where("rank is not null")
    if source is not None:
        chosen = chosen.where(F.coalesce(F.col("source"), F.lit("")).rlike(glob_regex(source)))
    kinds = [r[0] for r in chosen.select("kind").distinct().limit(2).collect()]
    if not kinds:
        raise KeyError(f"no feature fits {list(patterns)}")
    if len(kinds) > 1:
        raise TypeError("the features are of different kinds")
    wanted = chosen.select("rank", F.col("source").alias("source_"), F.col("name").alias("name_"))
    same = F.col("source_").eqNullSafe(F.col("source")) & (F.col("name_") == F.col("name"))
    return wanted.join(values, same).select("rank", "source", "name", "locus", "num")


def fetch_source(features: DataFrame, source: str) -> DataFrame:
    """Features of one source and the shared ones; its own win over shared ones of the same name."""
    own = features.where((F.col("source") == source) | F.col("source").isNull())
    names = features.where(F.col("source") == source).select("name").distinct()
    shared = own.where("source is null").join(names, "name", "left_anti").select(features.columns)
    return own.where("source is not null").select(features.columns).unionByName(shared)


def list_sources(features: DataFrame) -> DataFrame:
    return features.where("source is not null").select("source").distinct()


def infer_sources(meta: DataFrame) -> DataFrame:
    """Source = all of the feature path before its last slash."""
    return meta.where(F.col("name").contains("/")).select(F.regexp_replace("name", "/[^/]*$", "").alias("source")).distinct()


def mixture(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """One feature table of several datasets, each under its source name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.drop("source").withColumn("source", F.lit(s)) for s, d in datasets.items()))


def rename_components(spectra: DataFrame, names: Sequence[str], old: Sequence[str]) -> DataFrame:
    """Components renamed by position; both lists must have equal length."""
    if len(names) != len(old):
        raise ValueError(f"{len(old)} components, {len(names)} names")
    pairs = F.create_map(*[F.lit(x) for o, n in zip(old, names, strict=True) for x in (o, n)])
    return spectra.withColumn("component", F.element_at(pairs, F.col("component")))


def select_states(spectra: DataFrame, query: str) -> DataFrame:
    """Rows whose genome_state is the query, or the query followed by one more `:part`."""
    return spectra.where((F.col("genome_state") == query) | (F.regexp_replace("genome_state", ":[^:]*$", "") == query))


def empirical_marginal(observations: DataFrame, freq: DataFrame) -> DataFrame:
    """Weight over all samples per (configuration, context, locus) divided by the frequency; 0/0 is 0, x/0 is null."""
    keys = ["configuration", "context", "locus"]
    total = observations.groupBy(*keys).agg(F.sum("weight").alias("weight"))
    w = F.coalesce("weight", F.lit(0.0))
    return freq.join(total, keys, "left").withColumn("rate", F.when(F.col("freq") > 0, w / F.col("freq")).when(w == 0, 0.0))


def empirical_marginal_locus(observations: DataFrame, regions: DataFrame) -> DataFrame:
    """Weight of each locus divided by its length."""
    total = observations.groupBy("locus").agg(F.sum("weight").alias("weight"))
    return regions.join(total, "locus", "left").withColumn("rate", F.coalesce("weight", F.lit(0.0)) / F.col("length"))


def relative_contributions(contributions: DataFrame) -> DataFrame:
    return contributions.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy("sample")))


def occurrence_quantiles(contributions: DataFrame, q: float = 0.9, thresholds: Sequence[float] = (0.1, 0.025)) -> DataFrame:
    """The q-quantile of each component's share over samples, and whether it exceeds the thresholds."""
    r = relative_contributions(contributions).groupBy("component").agg(F.percentile("share", F.lit(q)).alias("quantile"))
    return r.withColumns({f"above_{i}": (F.col("quantile") > t).cast("int") for i, t in enumerate(thresholds)})


def top_component(posterior: DataFrame, by: Sequence[str]) -> DataFrame:
    """Component with the greatest value per group; ties take the smaller name."""
    return posterior.groupBy(*by).agg(F.min_by("component", F.struct(-F.col("value"), "component")).alias("component"), F.max("value").alias("value"))


def effect_summary(rows: DataFrame, by: Sequence[str], effect: str, value: str, q: float = 0.97) -> DataFrame:
    """q-quantile of the absolute effect and its Pearson correlation with the value over finite pairs (null below two)."""
    e, v = F.col(effect), F.col(value)
    both = e.isNotNull() & v.isNotNull() & ~F.isnan(e) & ~F.isnan(v)
    n = F.count(F.when(both, 1))
    return rows.groupBy(*by).agg(F.percentile(F.abs(e), F.lit(q)).alias("effect"), F.when(n > 1, F.corr(F.when(both, e), F.when(both, v))).alias("corr"))


def fold_windows(rows: DataFrame, by: Sequence[str], name: str = "feature", effect: str = "effect", value: str = "value") -> DataFrame:
    """`feature:window` rows folded to the feature: effects summed, values averaged."""
    return rows.withColumn(name, F.split_part(name, F.lit(":"), F.lit(1))).groupBy(*by, name).agg(F.sum(effect).alias(effect), F.avg(value).alias(value))


def explanation_pivot(rows: DataFrame, features: Sequence[str], by: str = "locus", name: str = "feature", effect: str = "effect") -> DataFrame:
    """One row per locus with the summed effect of each feature; 0 where it has none."""
    folded = rows.withColumn(name, F.split_part(name, F.lit(":"), F.lit(1)))
    return folded.groupBy(by).pivot(name, list(features)).agg(F.sum(effect)).na.fill(0.0, list(features))


def locus_offsets(track: DataFrame, value: str = "value") -> DataFrame:
    """Null, NaN and infinite values become 0, 1e-6 is added, and the mean becomes 1."""
    x = F.col(value).cast("double")
    clean = track.withColumn("offset", F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x) + 1e-6)
    mean = clean.agg(F.avg("offset").alias("mean_"))
    return clean.join(F.broadcast(mean)).withColumn("offset", F.col("offset") / F.col("mean_")).drop("mean_")


def ploidy(copies: Column, null: float = 2.0) -> Column:
    """Copy number as a deviation from diploid: cn / 2 - 1."""
    return F.coalesce(copies.cast("double"), F.lit(null)) / 2 - 1


def poisson_targets(rows: DataFrame, target: str, eta: str) -> DataFrame:
    """m = mean(target / eta), sw = eta * m, y = target / sw, weight = sw / mean(sw > 0)."""
    r = F.when(F.col(eta) != 0, F.col(target) / F.col(eta))
    m = rows.agg(F.avg(r).alias("m_"))
    out = rows.join(F.broadcast(m)).withColumn("sw", F.col(eta) * F.col("m_"))
    mean = out.agg(F.avg(F.when(F.col("sw") > 0, F.col("sw"))).alias("w_"))
    return out.join(F.broadcast(mean)).withColumn("y", F.when(F.col("sw") != 0, F.col(target) / F.col("sw")).otherwise(0.0)).withColumn("weight", F.col("sw") / F.col("w_")).drop("m_", "w_")


def context_distribution(freq: DataFrame) -> DataFrame:
    """Genome share of each context, with one added to each sum."""
    s = freq.groupBy("context").agg((F.sum("freq") + 1).alias("freq"))
    return s.withColumn("share", F.col("freq") / F.sum("freq").over(Window.partitionBy()))


def sample_totals(observations: DataFrame) -> DataFrame:
    return observations.groupBy("sample").agg(F.sum("weight").alias("total"))


def info(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table."""
    return reduce(DataFrame.unionByName, (t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")).select("name", "rows") for n, t in tables.items()))


def clip_quantiles(df: DataFrame, value: str, lo: float, hi: float, by: Sequence[str] = ()) -> DataFrame:
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(lo), F.lit(hi))).alias("q_"))
    joined = df.join(F.broadcast(q)) if not by else df.join(q, list(by))
    return joined.withColumn(value, F.greatest(F.least(F.col(value), F.col("q_")[1]), F.col("q_")[0])).drop("q_")


def renorm(df: DataFrame, value: str, by: Sequence[str] = (), scale: Column | float = 1.0) -> DataFrame:
    """Values divided by their sum per group, times scale."""
    s = df.groupBy(*by).agg(F.sum(value).alias("s_"))
    joined = df.join(F.broadcast(s)) if not by else df.join(s, list(by))
    return joined.withColumn(value, F.col(value) / F.col("s_") * scale).drop("s_")


def symlog1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def topography(df: DataFrame, value: str, base: str, by: Sequence[str]) -> DataFrame:
    """log ratio to the base and its z-score inside each row (group); non-positive pairs give null."""
    rows = df.withColumn("ratio", F.when((F.col(value) > 0) & (F.col(base) > 0), F.ln(F.col(value) / F.col(base))))
    stats = rows.groupBy(*by).agg(F.avg("ratio").alias("m_"), F.stddev_pop("ratio").alias("s_"))
    return rows.join(stats, list(by)).withColumn("z", F.when(F.col("s_") > 0, (F.col("ratio") - F.col("m_")) / F.col("s_"))).drop("m_", "s_")


def apply_to_samples(observations: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(pandas frame of one sample) -> pandas frame, for each sample; group size is bounded by a sample's cells."""
    return observations.groupBy("sample").applyInPandas(fn, schema)


def sum_except(df: DataFrame, keep: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keep).agg(F.sum(value).alias(value))


def densify(sparse: DataFrame, dims: Sequence[DataFrame], value: str, fill: float = 0.0) -> DataFrame:
    """All combinations of small dimension tables with the fill value where the sparse table has none."""
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dims)
    return grid.join(sparse, [c for d in dims for c in d.columns], "left").na.fill(fill, [value])


def view(regions: DataFrame, region: str) -> DataFrame:
    """Blocks of the regions that overlap one region, with the locus they belong to, in genomic order."""
    out = slice_regions(unstack(regions), [region])
    return out.orderBy("chrom", "start")


def best_trial_values(trials: DataFrame) -> DataFrame:
    """Best value of each trial: the greatest intermediate one, else the final one; best first."""
    best = F.coalesce(F.array_max("intermediate"), F.col("value"))
    return trials.withColumn("best", best).orderBy(F.desc_nulls_last("best"))
