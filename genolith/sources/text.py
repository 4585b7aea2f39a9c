"""Readers and writers of the text formats: BED, BED12, bedGraph, GTF, GFF, VCF, FASTA, sizes, quantification, components."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from pathlib import Path
from string import Template

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 65_536


class FormatError(ValueError):
    """A file that does not follow its format."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Data lines of a text file (plain or compressed): no comments, no blank ones."""
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.split("value", "\t").alias("f"))


def _check(df: DataFrame, least: int, path: str) -> None:
    r = df.agg(F.count(F.lit(1)), F.min(F.size("f"))).first()
    if not r[0]:
        raise FormatError(f"{path} has no data rows")
    if r[1] < least:
        raise FormatError(f"{path} has a row with fewer than {least} columns")


def read_bed(spark: SparkSession, path: str, feature: int = 3, sort: bool = False) -> DataFrame:
    """(chrom, start, end, feature, fields); a file with three columns has the feature `1`."""
    rows = _fields(_lines(spark, path))
    _check(rows, 3, path)
    f = F.col("f")
    out = rows.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), F.coalesce(F.get(f, feature), F.lit("1")).alias("feature"), f.alias("fields"))
    return out.orderBy("chrom", "start") if sort else out


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, score); also stands in for binary signal tracks."""
    return read_bed(spark, path).select("chrom", "start", "end", F.col("feature").try_cast("double").alias("score"))


def parse_bed12(lines: DataFrame) -> DataFrame:
    """value -> chrom, start, end, name (long), score, strand, blocks (array of start and end)."""
    f = F.split("value", "\t")
    sizes, starts = (F.transform(F.filter(F.split(f[k], ","), lambda x: x != ""), lambda x: x.cast("long")) for k in (10, 11))
    blocks = F.transform(F.arrays_zip(starts.alias("o"), sizes.alias("s")), lambda z: F.struct((f[1].cast("long") + z["o"]).alias("start"), (f[1].cast("long") + z["o"] + z["s"]).alias("end")))
    return lines.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), f[3].cast("long").alias("name"), f[4].alias("score"), f[5].alias("strand"), blocks.alias("blocks"))


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    lines = _lines(spark, path)
    _check(_fields(lines), 12, path)
    return parse_bed12(lines)


def check_region_ids(regions: DataFrame, name: str = "name") -> bool:
    """Whether the ids are 0..n-1 without gaps or repeats."""
    n, distinct, low, high = regions.agg(F.count(F.lit(1)), F.countDistinct(name), F.min(name), F.max(name)).first()
    return bool(n) and n == distinct and low == 0 and high == n - 1


def format_bed12(regions: DataFrame) -> DataFrame:
    """locus, chrom, start, end, blocks -> value: one BED12 line each."""
    sizes = F.array_join(F.transform("blocks", lambda b: (b["end"] - b["start"]).cast("string")), ",")
    starts = F.array_join(F.transform("blocks", lambda b: (b["start"] - F.col("start")).cast("string")), ",")
    return regions.select(F.concat_ws("\t", "chrom", "start", "end", "locus", F.lit("0"), F.lit("+"), "start", "end", F.lit("0,0,0"), F.size("blocks"), sizes, starts).alias("value"))


def format_bed4(segments: DataFrame) -> DataFrame:
    return segments.select(F.concat_ws("\t", "chrom", "start", "end", "labels").alias("value"))


def write_text(lines: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Lines into a folder of text files, in order if asked for (range-partitioned, not one task)."""
    (lines.orderBy(*order) if order else lines).select("value").write.mode("errorifexists").text(path)


def _attributes(pairs: Column) -> Column:
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"] != ""))


def _nine(lines: DataFrame, attributes) -> DataFrame:
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) >= 9)
    return rows.select(f[0].alias("seqname"), f[1].alias("source"), f[2].alias("type"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"), f[5].alias("score"), f[6].alias("strand"), f[7].alias("frame"), attributes(f[8]).alias("attributes"), f[8].alias("all"))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Nine columns; attributes `k "v"; ...` as a map (the first of equal keys), the raw string under `all`."""
    def attributes(a: Column) -> Column:
        items = F.filter(F.regexp_extract_all(a, F.lit('([^;"]+?)\\s+("[^"]*"|[^;"]+)\\s*(?:;|$)'), F.lit(0)), lambda x: F.trim(x) != "")
        pairs = F.transform(items, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*(\S+)", 1)).alias("key"), F.regexp_extract(x, r'^\s*\S+\s+"?([^";]*)"?', 1).alias("value")))
        seen = F.transform(pairs, lambda p: p["key"])
        return _attributes(F.filter(pairs, lambda p, i: F.array_position(seen, p["key"]) == i + 1))

    return _nine(lines, attributes)


def parse_gff(lines: DataFrame) -> DataFrame:
    """Nine columns; attributes `k=v;...` as a map."""
    def attributes(a: Column) -> Column:
        items = F.filter(F.split(a, ";"), lambda x: F.contains(x, F.lit("=")))
        pairs = F.transform(items, lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
        seen = F.transform(pairs, lambda p: p["key"])
        return _attributes(F.filter(pairs, lambda p, i: F.array_position(seen, p["key"]) == i + 1))

    return _nine(lines, attributes)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(_lines(spark, path))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff(_lines(spark, path))


def filter_records(records: DataFrame, kind: str | None = None, has: Iterable[str] = (), values: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """Records of a type that have all attributes named and, where asked, one of the given values."""
    out = records if kind is None else records.where(F.col("type") == kind)
    for name in has:
        out = out.where(F.map_contains_key("attributes", F.lit(name)))
    for name, allowed in (values or {}).items():
        out = out.where(F.col("attributes")[name].isin(list(allowed)))
    return out


def format_records(records: DataFrame, template: str, zero_based: bool = False, shift_end: bool = False) -> DataFrame:
    """Lines from a template such as `{seqname}\\t{start}\\t{gene_id}`: columns by name, else attributes. zero_based moves the start (and the end if shift_end).

    Raises when there is no record or one lacks a named attribute.
    """
    parts, names = [], []
    for literal, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", template.encode().decode("unicode_escape") if "\\" in template else template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            names.append(name)
            c = F.col(name) if name in records.columns else F.col("attributes")[name]
            if zero_based and (name == "start" or (name == "end" and shift_end)):
                c = c - 1
            parts.append(c.cast("string"))
    out = records.select(F.concat(*parts).alias("value"))
    n, good = out.agg(F.count(F.lit(1)), F.count("value")).first()
    if not n:
        raise FormatError("no record passed the filters")
    if good < n:
        raise FormatError(f"{n - good} records lack one of {names}")
    return out


def gene_annotation(gtf: DataFrame) -> DataFrame:
    """(chrom, start, end, gene_name, gene_id, strand) of transcripts with a gene id, zero-based, in genomic order."""
    t = filter_records(gtf, "transcript", ["gene_id"])
    name = F.coalesce(F.col("attributes")["gene_name"], F.col("attributes")["gene_id"])
    return t.select(F.col("seqname").alias("chrom"), (F.col("start") - 1).alias("start"), "end", name.alias("gene_name"), F.col("attributes")["gene_id"].alias("gene_id"), "strand").orderBy("chrom", "start")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", r"\s+")
    return _lines(spark, path).select(f[0].alias("chrom"), f[1].cast("long").alias("size"))


def read_quantification(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema="key string, estimate double")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, gene_name string, gene_id string, strand string")


def read_cytoband(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, band string, stain string")


def read_vector(spark: SparkSession, path: str, n_loci: int) -> DataFrame:
    """(locus, num): one number per line in locus order; the line count must equal n_loci. The file is one small split by nature."""
    rows = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    values = [float(x) for text in rows for x in text.split()]
    if len(values) != n_loci:
        raise FormatError(f"{path} has {len(values)} values for {n_loci} loci")
    return spark.createDataFrame(list(enumerate(values)), "locus long, num double")


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(chrom, chunk, seq): upper-case pieces of chunk bases with one more base on both sides where there is one.

    Read by lines, so a contig is never one record: every line gets its place from running sums inside its file split and from the totals of the splits before it
    (a table of one row for each split and contig), goes to the chunks that it touches, and a chunk is joined from its lines.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S+)", 1))
    line = Window.partitionBy("file", "block").orderBy("at")
    rows = text.withColumn("head", head).withColumn("seq", F.when(F.col("head").isNull(), F.upper(F.regexp_replace("value", r"\s+", ""))).otherwise(""))
    rows = rows.withColumn("part", F.count("head").over(line))  # 0: goes on with the contig of an earlier split
    inside = Window.partitionBy("file", "block", "part").orderBy("at")
    rows = rows.withColumn("before", F.sum(F.length("seq")).over(inside) - F.length("seq"))
    parts = rows.groupBy("file", "block", "part").agg(F.max("head").alias("head"), F.sum(F.length("seq")).alias("bases"))
    along = Window.partitionBy("file").orderBy("block", "part")
    parts = parts.withColumn("chrom", F.last("head", ignorenulls=True).over(along)).where("chrom is not null")
    carried = Window.partitionBy("file", "chrom").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "block", "part", "chrom", F.coalesce(F.sum("bases").over(carried), F.lit(0)).alias("carried"))
    placed = rows.where(F.length("seq") > 0).join(parts, ["file", "block", "part"]).select("chrom", (F.col("carried") + F.col("before")).alias("pos"), "seq")
    last = F.col("pos") + F.length("seq") - 1
    first_chunk, last_chunk = F.floor(F.greatest(F.lit(0), F.col("pos") - 1) / chunk), F.floor((last + 1) / chunk)
    each = placed.withColumn("chunk", F.explode(F.sequence(first_chunk, last_chunk)))
    low, high = F.greatest(F.lit(0), F.col("chunk") * chunk - 1), (F.col("chunk") + 1) * chunk  # bases low to high belong to the chunk, its neighbours included
    start = F.greatest(low, F.col("pos"))
    piece = F.substring(F.col("seq"), (start - F.col("pos") + 1).cast("int"), F.greatest(F.lit(0), F.least(high, last) - start + 1).cast("int"))
    cut = each.withColumn("own", (F.col("pos") < (F.col("chunk") + 1) * chunk) & (last >= F.col("chunk") * chunk)).select("chrom", "chunk", "pos", piece.alias("piece"), "own").where("piece <> ''")
    joined = cut.groupBy("chrom", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("seq"), F.max("own").alias("own"))
    return joined.where("own").select("chrom", F.col("chunk").cast("long").alias("chunk"), "seq")  # a chunk of neighbours alone is none


def read_vcf(spark: SparkSession, path: str, sample: str | None = None, pass_only: bool = True, weight: str | None = None, chr_prefix: str = "") -> DataFrame:
    """SNVs: id, sample, chrom, pos0, ref, alt, filter, cluster_size (1 if absent), raw_weight (1 without a weight field), info.

    Alternative alleles come in rows of their own; only single bases stay.
    """
    head = [r.value for r in spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()]
    if not head:
        raise FormatError(f"{path} has no #CHROM line")
    names = head[0].split("\t")[9:]
    if sample is None and len(names) > 1:
        raise FormatError(f"name one of the samples {names}")
    if sample is not None and sample not in names:
        raise FormatError(f"{sample} is none of the samples {names}")
    f = F.split("value", "\t")
    info = F.str_to_map(f[7], F.lit(";"), F.lit("="))
    rows = _lines(spark, path).select(F.concat(F.lit(chr_prefix), f[0]).alias("chrom"), (f[1].cast("long") - 1).alias("pos0"), f[2].alias("name"), f[3].alias("ref"), F.explode(F.split(f[4], ",")).alias("alt"), f[6].alias("filter"), info.alias("info"))
    if pass_only:
        rows = rows.where(F.col("filter") == "PASS")
    snv = rows.where((F.length("ref") == 1) & F.col("alt").rlike("^[ACGTacgt]$"))
    raw = F.col("info")[weight] if weight else F.lit("1")
    return snv.select(F.concat_ws(":", "chrom", F.col("pos0") + 1, "ref", "alt").alias("id"), F.lit(sample or (names[0] if names else Path(path).stem)).alias("sample"), "chrom", "pos0", "ref", "alt", "filter", F.coalesce(F.col("info")["clusterSize"].try_cast("int"), F.lit(1)).alias("cluster_size"), raw.alias("raw_weight"), "info")


def contig_sizes(spark: SparkSession, path: str, default: int = 1_000_000_000) -> DataFrame:
    """(chrom, size) from the ##contig lines of a VCF."""
    v = F.col("value")
    size = F.regexp_extract(v, r"length=(\d+)", 1)
    return spark.read.text(path).where(v.startswith("##contig=")).select(F.regexp_extract(v, r"ID=([^,>]+)", 1).alias("chrom"), F.when(size != "", size.cast("long")).otherwise(default).alias("size"))


def annotate_vcf(spark: SparkSession, path: str, notes: DataFrame, fields: dict[str, str], chr_prefix: str = "") -> DataFrame:
    """Lines of the VCF with notes (chrom, pos0, one column per field) added to INFO by position; `##INFO` lines are added. Returns (rank, value) to be ordered by rank."""
    text = spark.read.text(path).withColumn("rank", F.monotonically_increasing_id())
    head = text.where(F.col("value").startswith("#"))
    f = F.split("value", "\t")
    key = notes.groupBy("chrom", "pos0").agg(*[F.first(c).alias(c) for c in fields])
    body = text.where(~F.col("value").startswith("#")).select("rank", f.alias("f"), F.concat(F.lit(chr_prefix), f[0]).alias("chrom"), (f[1].cast("long") - 1).alias("pos0")).join(key, ["chrom", "pos0"], "left")
    extra = F.concat_ws(";", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in fields])
    info = F.when(extra == "", F.col("f")[7]).when(F.col("f")[7] == ".", extra).otherwise(F.concat_ws(";", F.col("f")[7], extra))
    line = F.concat_ws("\t", F.slice("f", 1, 7), info, F.slice("f", 9, 1_000_000))
    add = spark.createDataFrame([(f'##INFO=<ID={c},Number=1,Type={t},Description="{c}">',) for c, t in fields.items()], "value string")
    last = head.agg(F.max("rank")).first()[0] or 0
    return head.select(F.when(F.col("rank") == last, last * 1.0).otherwise(F.col("rank") * 1.0).alias("rank"), "value").unionByName(add.select(F.lit(last - 0.5).alias("rank"), "value")).unionByName(body.select((F.col("rank") * 1.0).alias("rank"), line.alias("value")))


def read_components(spark: SparkSession, path: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """(component, context, value) of a JSON object name -> {context: probability}; raises for unknown names."""
    data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    missing = [n for n in wanted or [] if n not in data]
    if missing:
        raise KeyError(f"no component {missing}; there are {sorted(data)}")
    rows = [(n, c, float(v)) for n in (wanted or sorted(data)) for c, v in data[n].items()]
    return spark.createDataFrame(rows, "component string, context string, value double")


def merge_configs(*configs: dict) -> dict:
    """Nested configurations; later ones win."""
    out: dict = {}
    for c in configs:
        for k, v in c.items():
            out[k] = merge_configs(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def fill_template(text: str, **values: str) -> str:
    """`${name}` placeholders; a missing one raises."""
    return Template(text).substitute(values)
