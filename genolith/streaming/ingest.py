"""Append-only ingestion of variant files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def variant_stream(spark: SparkSession, folder: str) -> DataFrame:
    """SNVs (chrom, pos0, ref, alt, sample = file name) of VCF files as they arrive in a folder."""
    f = F.split("value", "\t")
    rows = spark.readStream.text(folder).withColumn("sample", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.vcf", 1)).where(~F.col("value").startswith("#"))
    return rows.select("sample", f[0].alias("chrom"), (f[1].cast("long") - 1).alias("pos0"), f[3].alias("ref"), f[4].alias("alt")).where((F.length("ref") == 1) & (F.length("alt") == 1))


def ingest(stream: DataFrame, to_cells: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch through to_cells into a Parquet table partitioned by sample; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        to_cells(batch).write.partitionBy("sample").mode("overwrite").parquet(f"{path}/batch={n}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_rates(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and mean value per event-time window and type with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
