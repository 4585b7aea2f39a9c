"""Registered tensor, feature and sequence queries over lineitem, part, events, orders and documents, with oracle SQL.

Tensor view: sample = l_suppkey % 20, locus = l_partkey, context = l_returnflag || l_linestatus, configuration = l_linenumber % 2,
weight = l_quantity; part is the region table (length p_size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolith.functions import sequence as sq
from genolith.operators import features as ft
from genolith.operators import mutations as mu
from genolith.operators import ordered as od
from genolith.operators import tensor as tn
from genolith.plans.queries_intervals import EV, _ev
from genolith.plans.queries_intervals import view as events_view
from genolith.sources import text as tx

TN = """tn AS (SELECT l_suppkey % 20 AS sample, l_partkey AS locus, l_returnflag || l_linestatus AS context, l_linenumber % 2 AS configuration, l_quantity AS weight FROM lineitem),
rg AS (SELECT p_partkey AS locus, p_size AS length, p_retailprice AS value, p_brand AS class, p_type AS grp FROM part),
daily AS (SELECT epoch_us(l_shipdate) // 86400000000 AS day, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1)"""


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def tensor(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("sample"), F.col("l_partkey").alias("locus"), F.concat("l_returnflag", "l_linestatus").alias("context"), (F.col("l_linenumber") % 2).alias("configuration"), F.col("l_quantity").alias("weight"))


def regions(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("locus"), F.col("p_size").alias("length"), F.col("p_retailprice").alias("value"), F.col("p_brand").alias("class"), F.col("p_type").alias("grp"))


def daily(spark, d) -> DataFrame:
    day = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400000000")
    return _t(spark, d, "lineitem").groupBy(day.alias("day")).agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))


def _r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def slice_samples(spark, d):
    return tn.sample_totals(tn.slice_samples(tensor(spark, d), ["3", "7", "11"]))


def sample_totals(spark, d):
    return tn.sample_totals(tensor(spark, d))


def split_by_group(spark, d):
    train, test = tn.split_by_group(regions(spark, d), ["ECONOMY", "SMALL"], "grp")
    return train.select("locus", F.lit("train").alias("part")).unionByName(test.select("locus", F.lit("test").alias("part")))


def split_with_thresholds(spark, d):
    train, test, obs = tn.split_with_thresholds(regions(spark, d), tensor(spark, d), ["ECONOMY"], 5, 800, "grp")
    return train.agg(F.lit("train").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(test.agg(F.lit("test").alias("part"), F.count(F.lit(1)).alias("n"))).unionByName(obs.agg(F.lit("cells").alias("part"), F.count(F.lit(1)).alias("n")))


def _freq(spark, d):
    cells = tensor(spark, d).select("configuration", "context", "locus").distinct()
    return cells.join(regions(spark, d).select("locus", "length"), "locus").select("configuration", "context", "locus", (F.col("length") - F.col("configuration") * 3).cast("double").alias("freq"))


def empirical_marginal(spark, d):
    return tn.empirical_marginal(tensor(spark, d), _freq(spark, d)).select("configuration", "context", "locus", *_r("rate"))


def empirical_marginal_locus(spark, d):
    return tn.empirical_marginal_locus(tensor(spark, d), regions(spark, d)).select("locus", *_r("rate"))


def equal_size_quantiles(spark, d):
    return od.equal_size_quantiles(regions(spark, d), "value", "length", "locus", 10).select("locus", "bin")


def ordered_ids(spark, d):
    return od.ordered_ids(regions(spark, d), ["grp", "locus"], "id").select("locus", "id")


def moving_average(spark, d):
    return od.moving_average(daily(spark, d), "qty", 7, ["day"]).select("day", *_r("smooth"))


def moving_average_weighted(spark, d):
    return od.moving_average(daily(spark, d), "qty", 5, ["day"], weight="n").select("day", *_r("smooth"))


def convolve_neighbors(spark, d):
    out = od.convolve(daily(spark, d), ["qty"], 1, ["day"])
    return out.select("day", *[F.col(f"`qty:{k}`").alias(f"qty_{n}") for k, n in (("-1", "before"), ("0", "here"), ("+1", "after"))])


def mask_contiguous_duplicates(spark, d):
    return od.mask_repeats(regions(spark, d), "length", ["locus"]).select("locus", "length")


def repeat_edges(spark, d):
    return od.repeat_edges(daily(spark, d), "n", ["day"]).select("day", "before", "after")


def _norm(fn, **kw):
    return lambda spark, d: fn(regions(spark, d), "value", ["grp"], **kw).select("locus", *_r("norm"))


def normalize_gex(spark, d):
    return ft.gex(regions(spark, d), "length", ["locus"], ["grp"]).select("locus", *_r("norm"))


def normalize_quantile(spark, d):
    return ft.quantile(regions(spark, d), "value", ["grp"]).select("locus", F.round("norm", 6).alias("norm"))


def ordinal_encode(spark, d):
    r = regions(spark, d)
    return r.select("locus", ft.ordinal(F.col("grp"), ["SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD", "PROMO"]).alias("code"))


def one_hot(spark, d):
    out = ft.one_hot(regions(spark, d), "grp", ["SMALL", "MEDIUM", "LARGE"])
    return out.select("locus", F.col("`grp=MEDIUM`").alias("medium"), F.col("`grp=LARGE`").alias("large"))


def mesoscale_state(spark, d):
    r = regions(spark, d)
    s = (F.col("length") % 3 - 1).cast("long")
    labels = [(F.col("grp"), ["SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD", "PROMO"])]
    return r.select("locus", ft.mesoscale_state([s], labels).alias("plus"), ft.mesoscale_state([s], labels, minus=True).alias("minus"))


def effect_summary(spark, d):
    rows = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") - 30_000).alias("effect"), F.col("l_discount").alias("value"))
    return tn.effect_summary(rows, ["l_returnflag", "l_linestatus"], "effect", "value").select("l_returnflag", "l_linestatus", *_r("effect", "corr"))


def explanation_pivot(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("locus"), F.concat_ws(":", "l_returnflag", "l_linestatus").alias("feature"), F.col("l_discount").alias("effect"))
    return tn.explanation_pivot(rows, ["A", "N", "R"]).select("locus", *_r("A", "N", "R"))


def fold_windows(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("locus"), F.concat_ws(":", "l_returnflag", "l_linestatus").alias("feature"), F.col("l_discount").alias("effect"), F.col("l_tax").alias("value"))
    return tn.fold_windows(rows, ["locus"]).select("locus", "feature", *_r("effect", "value"))


def _sequence(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "N").alias("seq"))


def kmer_counts(spark, d):
    return sq.kmer_counts(_t(spark, d, "documents"), "doc_id", "text")


def context_frequencies(spark, d):
    return sq.context_frequencies(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "configuration", "trinucleotide", *_r("freq"))


def region_length(spark, d):
    return sq.region_length(sq.context_frequencies(_t(spark, d, "documents"), "doc_id", "text"), "doc_id").select("doc_id", *_r("length"))


def reverse_complement(spark, d):
    return _sequence(spark, d).select("doc_id", F.md5(sq.revcomp(F.col("seq")).cast("binary")).alias("digest"))


def masked_fraction(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.round(sq.masked_fraction(F.regexp_replace("text", "[^a-zA-Z]", "")), 9).alias("masked"))


def context_labels(spark, d):
    return sq.dim_context(spark)


def _variants(spark, d):
    e = _t(spark, d, "events")
    base = lambda k: F.substring(F.lit("ACGT"), (F.expr(f"event_id div {k}") % 4 + 1).cast("int"), F.lit(1))
    return e.select(F.col("event_id").alias("id"), F.concat(base(1), base(4), base(16)).alias("trinucleotide"), base(4).alias("ref"), base(64).alias("alt"), "value", "user_id")


def mutation_contexts(spark, d):
    return mu.to_cells(_variants(spark, d)).where("ok").select("id", "configuration", "context")


def mutation_weights(spark, d):
    v = _variants(spark, d)
    return v.select("id", F.round(sq.mutation_weight(F.col("value") / 50, F.col("user_id") % 6 + 1), 9).alias("weight"))


def rainfall(spark, d):
    a, b = _ev(spark, d)
    return mu.rainfall(a.select("id", "chrom", F.col("start").alias("pos")), b, 900).select("id", "distance", *_r("local_rate", digits=9))


def mutation_clusters(spark, d):
    a, b = _ev(spark, d)
    c = mu.cluster_mutations(mu.rainfall(a.select("id", "chrom", F.col("start").alias("pos")), b, 900), alpha=0.99, max_gap=120)
    return c.select("id", "cluster", "cluster_size")


def _genes(spark, d):
    a = events_view(spark, d)
    return a.select("chrom", "start", "end", F.concat(F.lit("g"), (F.col("id") % 500).cast("string")).alias("gene_id"))


def left_join_quantification(spark, d):
    q = _t(spark, d, "orders").select(F.concat(F.lit("g"), (F.col("o_custkey") % 700).cast("string"), F.lit("."), (F.col("o_orderkey") % 3).cast("string")).alias("key"), F.col("o_totalprice").alias("estimate"))
    return mu.quantification(_genes(spark, d), q).select("gene_id", "chrom", "start", *_r("estimate", digits=3))


def dedupe_first(spark, d):
    return od.top_per_group(_genes(spark, d), ["gene_id"], [F.col("chrom"), F.col("start"), F.col("end")]).select("gene_id", "chrom", "start", "end")


def _contrib(spark, d):
    return tensor(spark, d).groupBy("sample", F.col("context").alias("component")).agg(F.sum("weight").alias("value"))


def relative_contributions(spark, d):
    return tn.relative_contributions(_contrib(spark, d)).select("sample", "component", *_r("share"))


def occurrence_quantiles(spark, d):
    return tn.occurrence_quantiles(_contrib(spark, d), 0.9, (0.25, 0.1)).select("component", "above_0", "above_1", *_r("quantile"))


def top_component(spark, d):
    return tn.top_component(_contrib(spark, d), ["sample"])


def sorted_components(spark, d):
    return _contrib(spark, d).groupBy("component").agg(F.sum("value").alias("value")).orderBy(F.desc("value"), "component")


def locus_offsets(spark, d):
    return tn.locus_offsets(regions(spark, d).withColumn("value", F.when(F.col("length") > 3, F.col("value")))).select("locus", *_r("offset", digits=9))


def ploidy(spark, d):
    return regions(spark, d).select("locus", tn.ploidy(F.when(F.col("length") > 3, F.col("length") % 5)).alias("ploidy"))


def poisson_targets(spark, d):
    return tn.poisson_targets(regions(spark, d), "value", "length").select("locus", *_r("y", "weight"))


def topography_zscore(spark, d):
    return tn.topography(regions(spark, d), "value", "length", ["grp"]).select("locus", *_r("ratio", "z"))


def clip_quantiles(spark, d):
    return tn.clip_quantiles(regions(spark, d), "value", 0.1, 0.9, ["grp"]).select("locus", *_r("value"))


def renorm(spark, d):
    return tn.renorm(regions(spark, d), "value", ["grp"]).select("locus", *_r("value", digits=9))


def symlog(spark, d):
    return regions(spark, d).select("locus", F.round(tn.symlog1p(F.col("value") - 1000), 6).alias("v"))


def context_distribution(spark, d):
    freq = _freq(spark, d)
    return tn.context_distribution(freq).select("context", *_r("share", digits=9))


def dataset_info(spark, d):
    return tn.info(features=regions(spark, d), observations=tensor(spark, d))


def gtf_attributes(spark, d):
    p = _t(spark, d, "part")
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("x"), F.lit("gene"), F.col("p_partkey") + 1, F.col("p_partkey") + F.col("p_size"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit('gene_id "g'), F.col("p_partkey"), F.lit('"; gene_name "'), F.col("p_name"), F.lit('"; kind "'), F.col("p_type"), F.lit('";')))
    g = tx.parse_gtf(p.select(line.alias("value")))
    return g.select("seqname", "start", "end", F.col("attributes")["gene_id"].alias("gene_id"), F.col("attributes")["gene_name"].alias("gene_name"), F.col("attributes")["kind"].alias("kind"))


def gff_attributes(spark, d):
    p = _t(spark, d, "part")
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("x"), F.lit("gene"), F.col("p_partkey") + 1, F.col("p_partkey") + F.col("p_size"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=g"), F.col("p_partkey"), F.lit(";Brand="), F.col("p_brand")))
    g = tx.parse_gff(p.select(line.alias("value")))
    return tx.filter_records(g, kind="gene", has=["ID"]).select("start", F.col("attributes")["ID"].alias("id"), F.col("attributes")["Brand"].alias("brand"))


def json_props(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def _meta(spark, d):
    """A feature table made of part: name = brand/type, source = type, active by size."""
    r = regions(spark, d)
    return r.select(F.col("grp").alias("source"), F.col("class").alias("name"), "locus", F.col("value").alias("num"), F.lit("continuous").alias("kind"), (F.col("length") > 5).alias("active"))


def feature_glob(spark, d):
    m = _meta(spark, d)
    meta = m.groupBy("source", "name").agg(F.max("kind").alias("kind"), F.max("active").alias("active"))
    out = tn.fetch_features(meta, m.select("source", "name", "locus", "num"), ["Brand#1*", "SMALL/Brand#2"])
    return out.select("rank", "source", "name", "locus", *_r("num"))


def source_fetch(spark, d):
    m = _meta(spark, d).withColumn("source", F.when(F.col("source") != "PROMO", F.col("source")))
    return tn.fetch_source(m, "ECONOMY").groupBy("source", "name").agg(F.count(F.lit(1)).alias("n"))


def mixture_union(spark, d):
    m = _meta(spark, d).drop("source")
    parts = {"x": m, "y": m.withColumn("num", -F.col("num"))}
    return tn.mixture(parts).groupBy("source", "name").agg(F.round(F.sum("num"), 3).alias("num"), F.count(F.lit(1)).alias("n"))


def shared_features(spark, d):
    m = _meta(spark, d)
    one = m.select("name", F.when(F.col("name") == "Brand#1", "categorical").otherwise(F.col("kind")).alias("kind"))
    return ft.shared_features(one.where("num < 1100"), one.where("active"))


def list_sources(spark, d):
    return tn.list_sources(_meta(spark, d))


def interaction_groups(spark, d):
    return ft.interaction_groups(_meta(spark, d).select("name", F.col("source").alias("grp")))


def bed12_blocks(spark, d):
    p = _t(spark, d, "part").where("p_size is not null")
    n = F.lit(2)
    line = F.concat_ws("\t", F.lit("chr1"), F.col("p_partkey") * 100, F.col("p_partkey") * 100 + 90, F.col("p_partkey"), F.lit(0), F.lit("+"), F.lit(0), F.lit(0), F.lit("0"), n, F.concat(F.col("p_size"), F.lit(",20,")), F.lit("0,70,"))
    return tx.parse_bed12(p.select(line.alias("value"))).select("name", "chrom", F.explode("blocks").alias("b")).select("name", "chrom", "b.start", "b.end")


QUERIES = {f.__name__: f for f in (slice_samples, sample_totals, split_by_group, split_with_thresholds, empirical_marginal, empirical_marginal_locus, equal_size_quantiles, ordered_ids, moving_average, moving_average_weighted, convolve_neighbors, mask_contiguous_duplicates, repeat_edges, normalize_gex, normalize_quantile, ordinal_encode, one_hot, mesoscale_state, effect_summary, explanation_pivot, fold_windows, kmer_counts, context_frequencies, region_length, reverse_complement, masked_fraction, context_labels, mutation_contexts, mutation_weights, rainfall, mutation_clusters, left_join_quantification, dedupe_first, relative_contributions, occurrence_quantiles, top_component, sorted_components, locus_offsets, ploidy, poisson_targets, topography_zscore, clip_quantiles, renorm, symlog, context_distribution, dataset_info, gtf_attributes, gff_attributes, json_props, feature_glob, source_fetch, mixture_union, shared_features, list_sources, interaction_groups, bed12_blocks)}
QUERIES |= {"normalize_log1p_cpm": _norm(ft.log1p_cpm), "normalize_minmax": _norm(ft.minmax), "normalize_standardize": _norm(ft.standardize), "normalize_robust": _norm(ft.robust)}

_FREQ = "fq AS (SELECT DISTINCT t.configuration, t.context, t.locus, (r.length - t.configuration * 3)::DOUBLE AS freq FROM tn t JOIN rg r USING (locus))"
_CODE = "CASE grp WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'ECONOMY' THEN 3 WHEN 'STANDARD' THEN 4 WHEN 'PROMO' THEN 5 END"
_SEQ = "sq AS (SELECT doc_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM documents), km AS (SELECT doc_id, substr(seq, i, 3) AS kmer, count(*) AS n FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 1)) AS i FROM sq) GROUP BY ALL)"
_CTX = _SEQ + """, b AS (SELECT unnest(['A','C','G','T']) AS x), ctx AS (SELECT f.x || c.x || t.x AS tri FROM b f, b c, b t WHERE c.x IN ('C', 'T')),
ps AS (SELECT doc_id, sum(CASE WHEN contains(kmer, 'N') THEN n ELSE 0 END) / 64 AS pseudo FROM km GROUP BY doc_id),
fq2 AS (SELECT p.doc_id, q.c AS configuration, ctx.tri AS trinucleotide, p.pseudo + coalesce(k.n, 0) AS freq FROM ps p, ctx, (SELECT unnest([0, 1]) AS c) q LEFT JOIN km k ON k.doc_id = p.doc_id AND k.kmer = CASE WHEN q.c = 0 THEN ctx.tri ELSE reverse(translate(ctx.tri, 'ACGT', 'TGCA')) END)"""
_VAR = """va AS (SELECT event_id AS id, substr('ACGT', (event_id % 4 + 1)::INT, 1) || substr('ACGT', (event_id // 4 % 4 + 1)::INT, 1) || substr('ACGT', (event_id // 16 % 4 + 1)::INT, 1) AS tri, substr('ACGT', (event_id // 4 % 4 + 1)::INT, 1) AS ref, substr('ACGT', (event_id // 64 % 4 + 1)::INT, 1) AS alt, value, user_id FROM events),
vc AS (SELECT *, CASE WHEN ref IN ('A', 'G') THEN 1 ELSE 0 END AS configuration, CASE WHEN ref IN ('A', 'G') THEN reverse(translate(tri, 'ACGT', 'TGCA')) ELSE tri END AS t, CASE WHEN ref IN ('A', 'G') THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS a FROM va)"""
_RAIN = """pl AS (SELECT chrom, start, lag(start) OVER w AS b, lead(start) OVER w AS n FROM (SELECT DISTINCT chrom, start FROM ev) WINDOW w AS (PARTITION BY chrom ORDER BY start)),
a0 AS (SELECT id, chrom, greatest(start - 900, 0) AS start, start + 900 AS "end" FROM ev),
h AS (SELECT a.id, sum(b.score) AS r, sum(b."end" - b.start) AS w FROM a0 a JOIN fv b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" GROUP BY a.id),
rain AS (SELECT ev.id, ev.chrom, ev.start AS pos, CASE WHEN b IS NOT NULL AND (n IS NULL OR start - b <= n - start) THEN start - b ELSE n - start END AS distance, h.r / h.w * (SELECT count(*) FROM h) AS local_rate FROM ev JOIN pl USING (chrom, start) LEFT JOIN h ON h.id = ev.id)"""
_GENES = """genes AS (SELECT chrom, start, "end", 'g' || (id % 500) AS gene_id FROM ev), first AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY chrom, start, "end") AS k FROM genes)"""
_CONTRIB = "co AS (SELECT sample, context AS component, sum(weight) AS value FROM tn GROUP BY ALL)"
_META = "me AS (SELECT grp AS source, class AS name, locus, value AS num, 'continuous' AS kind, length > 5 AS active FROM rg)"


def _q(ctes: str, select: str) -> str:
    return f"WITH {TN}{',' if ctes else ''} {ctes} {select}"


ORACLE = {
    "slice_samples": _q("", "SELECT sample, sum(weight) AS total FROM tn WHERE sample IN (3, 7, 11) GROUP BY sample"),
    "sample_totals": _q("", "SELECT sample, sum(weight) AS total FROM tn GROUP BY sample"),
    "split_by_group": _q("", "SELECT locus, CASE WHEN grp IN ('ECONOMY', 'SMALL') THEN 'test' ELSE 'train' END AS part FROM rg"),
    "split_with_thresholds": _q("g AS (SELECT sample FROM tn GROUP BY sample HAVING sum(weight) >= 800)", "SELECT 'train' AS part, count(*) AS n FROM rg WHERE length >= 5 AND grp <> 'ECONOMY' UNION ALL SELECT 'test', count(*) FROM rg WHERE length >= 5 AND grp = 'ECONOMY' UNION ALL SELECT 'cells', count(*) FROM tn WHERE sample IN (SELECT sample FROM g)"),
    "empirical_marginal": _q(_FREQ + ", w AS (SELECT configuration, context, locus, sum(weight) AS weight FROM tn GROUP BY ALL)", "SELECT configuration, context, locus, round(CASE WHEN freq > 0 THEN coalesce(weight, 0) / freq WHEN coalesce(weight, 0) = 0 THEN 0 END, 6) AS rate FROM fq LEFT JOIN w USING (configuration, context, locus)"),
    "empirical_marginal_locus": _q("w AS (SELECT locus, sum(weight) AS weight FROM tn GROUP BY locus)", "SELECT locus, round(coalesce(weight, 0) / length, 6) AS rate FROM rg LEFT JOIN w USING (locus)"),
    "equal_size_quantiles": _q("", "SELECT locus, floor(round(sum(length) OVER (ORDER BY value, locus) / (SELECT sum(length) FROM rg) * 9, 9))::INT AS bin FROM rg"),
    "ordered_ids": _q("", "SELECT locus, row_number() OVER (ORDER BY grp, locus) - 1 AS id FROM rg"),
    "moving_average": _q("", "SELECT day, round(sum(qty) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6) AS smooth FROM daily"),
    "moving_average_weighted": _q("", "SELECT day, round(sum(qty * n) OVER w / sum(n) OVER w, 6) AS smooth FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "convolve_neighbors": _q("", "SELECT day, coalesce(lag(qty) OVER (ORDER BY day), qty) AS qty_before, qty AS qty_here, coalesce(lead(qty) OVER (ORDER BY day), qty) AS qty_after FROM daily"),
    "mask_contiguous_duplicates": _q("", "SELECT locus, CASE WHEN length = lag(length) OVER (ORDER BY locus) THEN NULL ELSE length END AS length FROM rg"),
    "repeat_edges": _q("", "SELECT day, coalesce(lag(n) OVER (ORDER BY day), n) AS before, coalesce(lead(n) OVER (ORDER BY day), n) AS after FROM daily"),
    "normalize_log1p_cpm": _q("l AS (SELECT locus, grp, ln(1 + value / sum(value) OVER (PARTITION BY grp) * 1e6) AS l FROM rg)", "SELECT locus, round((l - avg(l) OVER (PARTITION BY grp)) / stddev_pop(l) OVER (PARTITION BY grp), 6) AS norm FROM l"),
    "normalize_gex": _q("f AS (SELECT *, NOT coalesce(length = lag(length) OVER (PARTITION BY grp ORDER BY locus), false) AS fresh FROM rg), t AS (SELECT grp, sum(length) FILTER (fresh) AS t FROM f GROUP BY grp), l AS (SELECT f.*, ln(1 + length / t * 1e6) AS l FROM f JOIN t USING (grp)), s AS (SELECT grp, avg(l) FILTER (fresh) AS m, stddev_pop(l) FILTER (fresh) AS s FROM l GROUP BY grp)", "SELECT locus, round((l - m) / s, 6) AS norm FROM l JOIN s USING (grp)"),
    "normalize_minmax": _q("", "SELECT locus, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS norm FROM rg WINDOW w AS (PARTITION BY grp)"),
    "normalize_standardize": _q("", "SELECT locus, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS norm FROM rg WINDOW w AS (PARTITION BY grp)"),
    "normalize_robust": _q("s AS (SELECT grp, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM rg GROUP BY grp)", "SELECT locus, round((value - m) / (b - a), 6) AS norm FROM rg JOIN s USING (grp)"),
    "normalize_quantile": _q(f"s AS (SELECT grp, quantile_cont(value, [{', '.join(repr(i / 999) for i in range(1000))}]) AS q FROM rg GROUP BY grp), c AS (SELECT locus, value, q, len(list_filter(q, lambda v: v < value)) AS below, len(list_filter(q, lambda v: v <= value)) AS upto FROM rg JOIN s USING (grp))",
        "SELECT locus, round(CASE WHEN q[1] = q[1000] OR below = 0 THEN 0 WHEN upto = 1000 THEN 1 WHEN upto > below THEN (below + upto - 1) / 2 / 999 ELSE (upto - 1 + (value - q[upto]) / (q[upto + 1] - q[upto])) / 999 END, 6) AS norm FROM c"),
    "ordinal_encode": _q("", f"SELECT locus, ({_CODE})::BIGINT AS code FROM rg"),
    "one_hot": _q("", "SELECT locus, (grp = 'MEDIUM')::INT AS medium, (grp = 'LARGE')::INT AS large FROM rg"),
    "mesoscale_state": _q("", f"SELECT locus, (length % 3) * 6 + {_CODE} AS plus, (2 - length % 3) * 6 + {_CODE} AS minus FROM rg"),
    "effect_summary": "SELECT l_returnflag, l_linestatus, round(quantile_cont(abs(l_extendedprice - 30000), 0.97), 6) AS effect, round(corr(l_extendedprice - 30000, l_discount), 6) AS corr FROM lineitem GROUP BY ALL",
    "explanation_pivot": "SELECT l_partkey AS locus, round(coalesce(sum(l_discount) FILTER (l_returnflag = 'A'), 0), 6) AS A, round(coalesce(sum(l_discount) FILTER (l_returnflag = 'N'), 0), 6) AS N, round(coalesce(sum(l_discount) FILTER (l_returnflag = 'R'), 0), 6) AS R FROM lineitem GROUP BY l_partkey",
    "fold_windows": "SELECT l_partkey AS locus, l_returnflag AS feature, round(sum(l_discount), 6) AS effect, round(avg(l_tax), 6) AS value FROM lineitem GROUP BY ALL",
    "kmer_counts": f"WITH {_SEQ} SELECT doc_id, kmer, n FROM km",
    "context_frequencies": f"WITH {_CTX} SELECT doc_id, configuration, trinucleotide, round(freq, 6) AS freq FROM fq2",
    "region_length": f"WITH {_CTX} SELECT doc_id, round(sum(freq) * 3, 6) AS length FROM fq2 GROUP BY doc_id",
    "reverse_complement": f"WITH {_SEQ} SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM sq",
    "masked_fraction": "WITH s AS (SELECT doc_id, regexp_replace(text, '[^a-zA-Z]', '', 'g') AS t FROM documents) SELECT doc_id, round(length(regexp_replace(t, '[^a-zN]', '', 'g')) / (length(t) + 1), 9) AS masked FROM s",
    "context_labels": """WITH b AS (SELECT unnest(['A','C','G','T']) AS x, unnest([0, 1, 2, 3]) AS i), k AS (SELECT unnest([0, 1, 2]) AS class),
c AS (SELECT c.x AS c, f.x AS f, t.x AS t, (CASE WHEN c.x = 'C' THEN 0 ELSE 16 END + f.i * 4 + t.i) AS n FROM b c, b f, b t WHERE c.x IN ('C', 'T')),
a AS (SELECT *, CASE class WHEN 0 THEN 'A' WHEN 1 THEN 'G' ELSE CASE WHEN c = 'C' THEN 'T' ELSE 'C' END END AS alt FROM c, k)
SELECT (n * 3 + class)::INT AS index, f || '[' || c || '>' || alt || ']' || t AS label, f || c || t AS trinucleotide, class, c || '>' || alt AS mutation FROM a""",
    "mutation_contexts": f"WITH {_VAR} SELECT id, configuration, substr(t, 1, 1) || '[' || substr(t, 2, 1) || '>' || a || ']' || substr(t, 3, 1) AS context FROM vc WHERE ref <> alt",
    "mutation_weights": "SELECT event_id AS id, round(least(value / 50, 1) / CASE WHEN user_id % 6 + 1 > 3 THEN user_id % 6 + 1 ELSE 1 END, 9) AS weight FROM events",
    "rainfall": f"WITH {EV}, {_RAIN} SELECT id, distance, round(local_rate, 9) AS local_rate FROM rain",
    "mutation_clusters": f"""WITH {EV}, {_RAIN}, c AS (SELECT *, -ln(1 - 0.99) / local_rate AS critical FROM rain WHERE distance IS NOT NULL AND local_rate > 0),
f AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR pos - lag(pos) OVER w > least(120, lag(critical) OVER w) THEN 1 ELSE 0 END AS n FROM c WINDOW w AS (PARTITION BY chrom ORDER BY pos, id)),
g AS (SELECT *, chrom || ':' || (sum(n) OVER (PARTITION BY chrom ORDER BY pos, id ROWS UNBOUNDED PRECEDING))::BIGINT AS cluster FROM f) SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM g""",
    "left_join_quantification": f"WITH {EV}, {_GENES}, q AS (SELECT 'g' || (o_custkey % 700) || '.' || (o_orderkey % 3) AS key, avg(o_totalprice) AS e FROM orders GROUP BY 1), q2 AS (SELECT regexp_replace(key, '\\.[^.]*$', '') AS gene_id, avg(e) AS e FROM q GROUP BY 1) SELECT gene_id, chrom, start, round(coalesce(e, 0), 3) AS estimate FROM first LEFT JOIN q2 USING (gene_id) WHERE k = 1",
    "dedupe_first": f'WITH {EV}, {_GENES} SELECT gene_id, chrom, start, "end" FROM first WHERE k = 1',
    "relative_contributions": _q(_CONTRIB, "SELECT sample, component, round(value / sum(value) OVER (PARTITION BY sample), 6) AS share FROM co"),
    "occurrence_quantiles": _q(_CONTRIB + ", s AS (SELECT component, value / sum(value) OVER (PARTITION BY sample) AS share FROM co), z AS (SELECT component, quantile_cont(share, 0.9) AS quantile FROM s GROUP BY component)", "SELECT component, (quantile > 0.25)::INT AS above_0, (quantile > 0.1)::INT AS above_1, round(quantile, 6) AS quantile FROM z"),
    "top_component": _q(_CONTRIB, "SELECT sample, arg_min(component, (-value, component)) AS component, max(value) AS value FROM co GROUP BY sample"),
    "sorted_components": _q(_CONTRIB, "SELECT component, sum(value) AS value FROM co GROUP BY component"),
    "locus_offsets": _q("o AS (SELECT locus, CASE WHEN length > 3 THEN value ELSE 0 END + 1e-6 AS o FROM rg)", "SELECT locus, round(o / (SELECT avg(o) FROM o), 9) AS offset FROM o"),
    "ploidy": _q("", "SELECT locus, coalesce(CASE WHEN length > 3 THEN length % 5 END::DOUBLE, 2) / 2 - 1 AS ploidy FROM rg"),
    "poisson_targets": _q("m AS (SELECT *, length * (SELECT avg(value / length) FROM rg WHERE length <> 0) AS sw FROM rg)", "SELECT locus, round(CASE WHEN sw <> 0 THEN value / sw ELSE 0 END, 6) AS y, round(sw / (SELECT avg(sw) FROM m WHERE sw > 0), 6) AS weight FROM m"),
    "topography_zscore": _q("r AS (SELECT locus, grp, CASE WHEN value > 0 AND length > 0 THEN ln(value / length) END AS ratio FROM rg)", "SELECT locus, round(ratio, 6) AS ratio, round((ratio - avg(ratio) OVER (PARTITION BY grp)) / stddev_pop(ratio) OVER (PARTITION BY grp), 6) AS z FROM r"),
    "clip_quantiles": _q("s AS (SELECT grp, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.9) AS b FROM rg GROUP BY grp)", "SELECT locus, round(greatest(least(value, b), a), 6) AS value FROM rg JOIN s USING (grp)"),
    "renorm": _q("", "SELECT locus, round(value / sum(value) OVER (PARTITION BY grp), 9) AS value FROM rg"),
    "symlog": _q("", "SELECT locus, round(sign(value - 1000) * ln(1 + abs(value - 1000)), 6) AS v FROM rg"),
    "context_distribution": _q(_FREQ + ", s AS (SELECT context, sum(freq) + 1 AS f FROM fq GROUP BY context)", "SELECT context, round(f / (SELECT sum(f) FROM s), 9) AS share FROM s"),
    "dataset_info": _q("", "SELECT 'features' AS name, count(*) AS rows FROM rg UNION ALL SELECT 'observations', count(*) FROM tn"),
    "gtf_attributes": "SELECT 'chr1' AS seqname, p_partkey + 1 AS start, p_partkey + p_size AS \"end\", 'g' || p_partkey AS gene_id, p_name AS gene_name, p_type AS kind FROM part",
    "gff_attributes": "SELECT p_partkey + 1 AS start, 'g' || p_partkey AS id, p_brand AS brand FROM part",
    "json_props": "SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events",
    "feature_glob": _q(_META + ", ok AS (SELECT source, name FROM me GROUP BY ALL HAVING bool_or(active))", "SELECT CASE WHEN name LIKE 'Brand#1%' THEN 0 ELSE 1 END AS rank, source, name, locus, round(num, 6) AS num FROM me JOIN ok USING (source, name) WHERE name LIKE 'Brand#1%' OR (source = 'SMALL' AND name = 'Brand#2')"),
    "source_fetch": _q(_META + ", x AS (SELECT CASE WHEN source <> 'PROMO' THEN source END AS source, name FROM me), own AS (SELECT DISTINCT name FROM x WHERE source = 'ECONOMY')", "SELECT source, name, count(*) AS n FROM x WHERE source = 'ECONOMY' OR (source IS NULL AND name NOT IN (SELECT name FROM own)) GROUP BY ALL"),
    "mixture_union": _q(_META, "SELECT 'x' AS source, name, round(sum(num), 3) AS num, count(*) AS n FROM me GROUP BY name UNION ALL SELECT 'y', name, round(-sum(num), 3), count(*) FROM me GROUP BY name"),
    "shared_features": _q(_META + ", z AS (SELECT name, CASE WHEN name = 'Brand#1' THEN 'categorical' ELSE kind END AS kind, num, active FROM me)", "SELECT name, kind FROM z WHERE num < 1100 INTERSECT SELECT name, kind FROM z WHERE active"),
    "list_sources": _q(_META, "SELECT DISTINCT source FROM me"),
    "interaction_groups": _q(_META, "SELECT source AS grp, array_to_string(list_sort(list_distinct(list(name))), ',') AS features FROM me GROUP BY source"),
    "bed12_blocks": "SELECT p_partkey AS name, 'chr1' AS chrom, p_partkey * 100 AS start, p_partkey * 100 + p_size AS \"end\" FROM part UNION ALL SELECT p_partkey, 'chr1', p_partkey * 100 + 70, p_partkey * 100 + 90 FROM part",
}
