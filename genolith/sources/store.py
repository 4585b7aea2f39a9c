"""A dataset as a folder of Parquet tables: regions, context_freq, features, feature_meta, observations, ploidy, samples, attrs.

One writer at a time per dataset; readers see whole tables, because each write commits or leaves nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.operators.tensor import densify, parse_region, slice_regions

REQUIRED = {"regions": {"chrom", "start", "end", "length", "exposure", "locus"}, "features": {"source", "name", "locus", "num"}, "feature_meta": {"source", "name", "kind", "normalization", "grp", "active"}}
KINDS = {"continuous": {"log1p_cpm", "power", "gex", "minmax", "quantile", "standardize", "robust"}, "categorical": {"categorical"}, "mesoscale": {"mesoscale"}, "strand": {"strand"}}
#: Stands for "no source" in folder names.
SHARED = "_shared"
PARTITIONS = {"observations": ["sample"], "ploidy": ["sample"], "features": ["source", "name"]}


@dataclass
class Dataset:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, name: str, df: DataFrame, mode: str = "errorifexists") -> None:
        df.write.partitionBy(*[c for c in PARTITIONS.get(name, []) if c in df.columns]).mode(mode).parquet(f"{self.path}/{name}")

    def replace(self, name: str, df: DataFrame) -> None:
        """Rewrite a small table that df reads from: its rows are fixed on the driver first (metadata only)."""
        fixed = self.spark.createDataFrame(df.collect(), df.schema)
        fixed.write.mode("overwrite").parquet(f"{self.path}/{name}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str, regions: DataFrame, context_freq: DataFrame | None = None, dtype: str = "sbs", mode: str = "errorifexists", **attrs: str) -> Dataset:
        """A new dataset; exposures default to 1. mode overwrite: instead of the tables that are there; their features and samples are forgotten."""
        ds = cls(spark, path)
        full = regions if "exposure" in regions.columns else regions.withColumn("exposure", F.lit(1.0))
        ds.write("regions", full, mode)
        if context_freq is not None:
            ds.write("context_freq", context_freq, mode)
        pairs = {"name": name, "dtype": dtype} | attrs
        ds.write("attrs", spark.createDataFrame(list(pairs.items()), "key string, value string"), mode)
        ds.write("feature_meta", spark.createDataFrame([], "source string, name string, kind string, normalization string, grp string, active boolean, classes array<string>"), mode)
        ds.write("samples", spark.createDataFrame([], "sample string, active boolean"), mode)
        return ds

    def attrs(self) -> dict[str, str]:
        return {r.key: r.value for r in self.table("attrs").collect()}

    def set_attrs(self, **values: str) -> None:
        self.replace("attrs", self.spark.createDataFrame(list((self.attrs() | values).items()), "key string, value string"))

    def add_feature(self, name: str, values: DataFrame, kind: str, normalization: str, source: str | None = None, grp: str = "all", classes: list[str] | None = None) -> None:
        """values: (locus, num). The normalization must fit the kind. Adding a feature again replaces it (dynamic partition overwrite)."""
        if normalization not in KINDS.get(kind, set()):
            raise ValueError(f"{normalization} does not fit a {kind} feature")
        rows = values.select("locus", "num").withColumns({"source": F.lit(source or SHARED), "name": F.lit(name)})
        rows.write.partitionBy(*PARTITIONS["features"]).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/features")
        row = self.spark.createDataFrame([(source, name, kind, normalization, grp, True, classes)], self.table("feature_meta").schema)
        old = self.table("feature_meta").where(~(F.col("source").eqNullSafe(source) & (F.col("name") == name)))
        self.replace("feature_meta", old.unionByName(row))

    def edit_feature(self, name: str, source: str | None = None, **changes: str) -> None:
        here = F.col("source").eqNullSafe(source) & (F.col("name") == name)
        meta = self.table("feature_meta")
        if meta.where(here).isEmpty():
            raise KeyError(name)
        self.replace("feature_meta", meta.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}))

    def remove_feature(self, name: str, source: str | None = None) -> None:
        """Soft delete."""
        self.edit_feature(name, source, active=False)

    def features(self) -> DataFrame:
        active = self.table("feature_meta").where("active").select(F.coalesce("source", F.lit(SHARED)).alias("source"), "name")
        return self.table("features").join(F.broadcast(active), ["source", "name"], "left_semi").withColumn("source", F.nullif(F.col("source"), F.lit(SHARED)))

    def list_features(self) -> DataFrame:
        return self.table("feature_meta").where("active").orderBy("source", "name")

    def add_sample(self, sample: str, observations: DataFrame, ploidy: DataFrame | None = None) -> None:
        """Weights are stored exactly; adding a sample again replaces it (dynamic partition overwrite)."""
        for name, df in (("observations", observations), ("ploidy", ploidy)):
            if df is not None:
                df.drop("sample").withColumn("sample", F.lit(sample)).write.partitionBy("sample").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{name}")
        others = self.table("samples").where(F.col("sample") != sample)
        self.replace("samples", others.unionByName(self.spark.createDataFrame([(sample, True)], "sample string, active boolean")))

    def remove_sample(self, sample: str) -> bool:
        """Soft delete; False if there is no such sample."""
        s = self.table("samples")
        if s.where(F.col("sample") == sample).isEmpty():
            return False
        self.replace("samples", s.withColumn("active", F.col("active") & (F.col("sample") != sample)))
        return True

    def list_samples(self) -> list[str]:
        return [r.sample for r in self.table("samples").where("active").orderBy("sample").collect()]

    def observations(self, samples: list[str] | None = None) -> DataFrame:
        """Observations of active samples; partitions of others aren't read."""
        names = self.list_samples() if samples is None else samples
        missing = sorted(set(names) - set(self.list_samples()))
        if missing:
            raise ValueError(f"no sample {missing}")
        return self.table("observations").where(F.col("sample").isin(names))

    def ploidy(self, sample: str) -> DataFrame:
        """(locus, value) with 0 where nothing is stored."""
        stored = self.table("ploidy").where(F.col("sample") == sample).select("locus", "value")
        return densify(stored, [self.table("regions").select("locus")], "value")

    def slice(self, path: str, regions: list[str]) -> Dataset:
        """A copy with the regions that overlap the given ones."""
        for r in regions:
            parse_region(r)
        return self.subset(path, slice_regions(self.table("regions"), regions))

    def subset(self, path: str, regions: DataFrame, samples: list[str] | None = None) -> Dataset:
        """A copy with these rows of its regions, what belongs to them, and all samples or the named ones."""
        missing = sorted(set(samples or []) - set(self.list_samples()))
        if missing:
            raise ValueError(f"no sample {missing}")
        out = Dataset(self.spark, path)
        out.write("regions", regions)
        loci = regions.select("locus")
        for name in ("features", "observations", "context_freq", "ploidy"):
            try:
                df = self.table(name)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            if samples is not None and "sample" in df.columns:
                df = df.where(F.col("sample").isin(samples))
            out.write(name, df.join(loci, "locus", "left_semi"))
        for name in ("attrs", "feature_meta"):
            out.write(name, self.table(name))
        known = self.table("samples")
        out.write("samples", known if samples is None else known.where(F.col("sample").isin(samples)))
        return out

    def problems(self) -> list[str]:
        """Broken rules: missing columns, kinds and normalizations that don't fit, id gaps, no name, no features."""
        found = [f"{t} lacks {sorted(need - set(self.table(t).columns))}" for t, need in REQUIRED.items() if t != "features" and need - set(self.table(t).columns)]
        if "name" not in self.attrs():
            found.append("attrs lacks name")
        meta = self.table("feature_meta").where("active")
        if meta.isEmpty():
            found.append("there are no features")
        found += [f"{r.name}: {r.normalization} does not fit {r.kind}" for r in meta.collect() if r.normalization not in KINDS.get(r.kind, set())]
        n, distinct = self.table("regions").agg(F.count(F.lit(1)), F.countDistinct("locus")).first()
        if n != distinct:
            found.append("locus ids repeat")
        return found
