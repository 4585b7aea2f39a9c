"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body`.

    A plain column expression that a lambda mentions is evaluated again for every element,
    because the optimizer inlines it; binding it as a lambda variable prevents that.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text; null gives an empty array.

    Other blanks become spaces first: splitting at one literal character is several times faster
    than at a regular expression.
    """
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]+", " ")
    return F.array_remove(F.split(spaced, " "), "")


#: Rows and bytes of an Arrow batch: whole texts and shingle sets pass through Python, and a batch of them must stay small.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, so a Python worker never holds thousands of whole texts.

    The setting stays: plans read it when the caller runs them.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(name).rstrip("Bb"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="genolith-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(jvm, conf, path: str) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the session may be gone at interpreter exit
        pass


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark).rstrip('/')}/genolith-{uuid.uuid4().hex}"
    atexit.register(_remove, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


def stored(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation beyond this table. The folder is
    removed when the driver's interpreter ends.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that do not clash with those of `df`."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out
