"""Registered interval queries over the events table and their oracle SQL.

Interval view: chrom = event_type, start = whole seconds since 2024-01-01, end = start + 60 + user_id % 600, score = value. The
second track is the same events half an hour later with other lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.operators import intervals as iv
from genolith.operators import ordered as od

ORIGIN = 1_704_067_200
WINDOW = 3_600

EV = f"""
ev AS (SELECT event_id AS id, event_type AS chrom, epoch_us(ts) // 1000000 - {ORIGIN} AS start, epoch_us(ts) // 1000000 - {ORIGIN} + 60 + user_id % 600 AS "end", value AS score, 'u' || (user_id % 4) AS label FROM events),
fv AS (SELECT event_id AS id, event_type AS chrom, epoch_us(ts) // 1000000 - {ORIGIN} + 1800 AS start, epoch_us(ts) // 1000000 - {ORIGIN} + 1920 + user_id % 300 AS "end", value AS score, 'u' || (user_id % 4) AS label FROM events),
sizes AS (SELECT chrom, max("end") AS size FROM ev GROUP BY chrom),
win0 AS (SELECT chrom, size, unnest(range(0, size, {WINDOW})) AS start FROM sizes),
win AS (SELECT row_number() OVER (ORDER BY chrom, start) - 1 AS "window", chrom, start, least(start + {WINDOW}, size) AS "end" FROM win0)"""


def view(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.expr("unix_micros(cast(ts as timestamp)) div 1000000") - ORIGIN + (1800 if later else 0)
    length = 120 + F.col("user_id") % 300 if later else 60 + F.col("user_id") % 600
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("chrom"), at.alias("start"), (at + length).alias("end"), F.col("value").alias("score"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("label"))


def sizes(ev: DataFrame) -> DataFrame:
    return ev.groupBy("chrom").agg(F.max("end").alias("size"))


def windows(ev: DataFrame) -> DataFrame:
    return iv.fixed_windows(sizes(ev), WINDOW)


def tracks(ev: DataFrame) -> DataFrame:
    return ev.select("chrom", "start", "end", F.lit("ev").alias("track"), F.col("label").alias("feature"))


def blacklist(ev: DataFrame) -> DataFrame:
    return iv.merge(ev.where("score > 100").select("chrom", "start", "end"))


def _ev(spark, sf_dir):
    return view(spark, sf_dir), view(spark, sf_dir, later=True)


def fixed_windows(spark, d):
    return windows(view(spark, d))


def overlap_join(spark, d):
    a, b = _ev(spark, d)
    return iv.overlap_join(a, b).select("id", "id_b", "chrom", F.greatest("start", "start_b").alias("lo"), F.least("end", "end_b").alias("hi"))


def overlap_semi(spark, d):
    a, b = _ev(spark, d)
    return iv.overlap_filter(a, b).select("id", "chrom", "start", "end")


def overlap_anti(spark, d):
    a, b = _ev(spark, d)
    return iv.overlap_filter(a, b, keep=False).select("id", "chrom", "start", "end")


def map_mean(spark, d):
    a, b = _ev(spark, d)
    w = windows(a)
    got = iv.map_intervals(w, b, ["window"], {"mean_score": F.avg("score_b"), "n": F.count("score_b")}, WINDOW)
    return got.select("window", "chrom", "start", F.round("mean_score", 6).alias("mean_score"), F.coalesce("n", F.lit(0)).alias("n"))


def map_distinct_priority(spark, d):
    a, b = _ev(spark, d)
    from genolith.operators.features import discrete_feature

    return discrete_feature(windows(a), b, ["window"], "label", ["u3", "u1", "u0", "u2"], width=WINDOW).select("window", F.col("value").alias("label"))


def strand_feature(spark, d):
    a, b = _ev(spark, d)
    from genolith.operators.features import strand_feature as strand

    b = b.withColumn("strand", F.when(F.col("label") == "u0", "-").when(F.col("label") == "u1", "+"))
    return strand(windows(a), b.where("strand is not null"), ["window"], "strand", width=WINDOW).select("window", "strand")


def weighted_coverage_mean(spark, d):
    a, b = _ev(spark, d)
    return iv.weighted_mean(windows(a), b, ["window"], width=WINDOW).select("window", F.round("mean", 6).alias("mean"))


def coverage_fraction(spark, d):
    a, b = _ev(spark, d)
    return iv.coverage_fraction(windows(a), b, ["window"], width=WINDOW).select("window", F.round("fraction", 9).alias("fraction"))


def coverage_counts(spark, d):
    a = view(spark, d)
    return iv.count_in_windows(a, windows(a), WINDOW).select("window", "n")


def background_rate(spark, d):
    a = view(spark, d)
    return iv.background_rate(a, windows(a), WINDOW).select("window", "n", F.round("rate", 12).alias("rate"))


def merge_intervals(spark, d):
    return iv.merge(view(spark, d), aggs={"n": F.count(F.lit(1)), "top": F.max("score")})


def merge_apart(spark, d):
    return iv.merge(view(spark, d), ["chrom", "label"], gap=-1, aggs={"low": F.min("score")})


def merge_by_label_max(spark, d):
    """Merged islands take the label of their highest score (ties: the greater label)."""
    return iv.merge(view(spark, d), aggs={"label": F.max_by("label", F.struct("score", "label")), "top": F.max("score")})


def endpoint_stream(spark, d):
    return iv.endpoints(tracks(view(spark, d))).groupBy("chrom", "pos", "track", "feature").agg(F.sum("step").alias("net"), F.count(F.lit(1)).alias("n"))


def segments(spark, d):
    a = view(spark, d)
    return iv.segments(tracks(a), windows(a), blacklist(a), width=WINDOW).select("window", "chrom", "start", "end", "labels")


def multi_block_regions(spark, d):
    a = view(spark, d)
    r = iv.multi_block_regions(tracks(a), windows(a), blacklist(a), min_length=30, width=WINDOW)
    return r.select("locus", "chrom", "start", "end", "length", "labels", F.size("blocks").cast("long").alias("blocks"))


def linearize(spark, d):
    return iv.linearize(tracks(view(spark, d)), 90)


def unstack(spark, d):
    a = view(spark, d)
    r = iv.multi_block_regions(tracks(a), windows(a), blacklist(a), min_length=30, width=WINDOW)
    return iv.unstack(r.select("chrom", "labels", "start", "end", "blocks"))


def nearest_neighbor(spark, d):
    return iv.nearest_neighbor(view(spark, d), "start").select("id", "distance", "neighbor")


def nearest_directional(spark, d):
    a, b = _ev(spark, d)
    return iv.nearest_directional(a, b, ["id"]).select("id", "upstream", "downstream")


def distance_features(spark, d):
    a, b = _ev(spark, d)
    return iv.distance_features(a, b, ["id"]).select("id", F.round("progress", 9).alias("progress"), F.col("total").cast("long").alias("total"))


def gene_tiles(spark, d):
    genes = view(spark, d).withColumn("strand", F.when(F.col("id") % 5 == 0, "-").when(F.col("id") % 7 == 0, ".").otherwise("+"))
    return iv.tile_genes(genes, width=90, max_id=4)


def cluster_islands(spark, d):
    return iv.islands(view(spark, d), gap=30, order=("start", "end", "id")).select("id", "chrom", F.col("island").cast("long").alias("island"))


def local_rate(spark, d):
    a, b = _ev(spark, d)
    return iv.band_rate(a, b, ["id"], 900, "start").select("id", F.round("local_rate", 9).alias("local_rate"))


def slop_windows(spark, d):
    return iv.slop(view(spark, d).select("id", F.col("start").alias("pos")), 5_000).select("id", "start", "end")


def slice_regions(spark, d):
    from genolith.operators.tensor import slice_regions as cut

    return cut(view(spark, d), ["click:10,000-500,000", "view:1000000"]).select("id", "chrom", "start", "end")


def window_report(spark, d):
    from genolith.operators.features import length_report

    return length_report(iv.merge(view(spark, d)).withColumn("length", F.col("end") - F.col("start")))


QUERIES = {f.__name__: f for f in (fixed_windows, overlap_join, overlap_semi, overlap_anti, map_mean, map_distinct_priority, strand_feature, weighted_coverage_mean, coverage_fraction, coverage_counts, background_rate, merge_intervals, merge_apart, merge_by_label_max, endpoint_stream, segments, multi_block_regions, linearize, unstack, nearest_neighbor, nearest_directional, distance_features, gene_tiles, cluster_islands, local_rate, slop_windows, slice_regions, window_report)}

_JOIN = 'a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"'
_ISLAND = """i0 AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY {by} ORDER BY start, "end"{tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + ({gap}) THEN 1 ELSE 0 END AS f FROM ev),
i1 AS (SELECT *, sum(f) OVER (PARTITION BY {by} ORDER BY start, "end"{tie} ROWS UNBOUNDED PRECEDING) + 1 AS island FROM i0)"""
_BLACK = """bad0 AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM ev WHERE score > 100),
bad AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM bad0) GROUP BY chrom, g)"""
_SEG = _BLACK + """,
pts AS (SELECT chrom, start AS p FROM ev UNION SELECT chrom, "end" FROM ev UNION SELECT chrom, start FROM win UNION SELECT chrom, "end" FROM win UNION SELECT chrom, start FROM bad UNION SELECT chrom, "end" FROM bad),
el AS (SELECT chrom, p AS start, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS "end" FROM pts),
inside AS (SELECT a.chrom, a.start, a."end", b."window" FROM el a JOIN win b ON """ + _JOIN + """ WHERE a."end" IS NOT NULL),
clean AS (SELECT * FROM inside a WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE """ + _JOIN + """)),
seg AS (SELECT a."window", a.chrom, a.start, a."end", coalesce(array_to_string(list_sort(list_distinct(list('ev:' || b.label) FILTER (WHERE b.label IS NOT NULL))), '|'), '') AS labels FROM clean a LEFT JOIN ev b ON """ + _JOIN + """ GROUP BY ALL),
reg AS (SELECT "window", chrom, labels, min(start) AS start, max("end") AS "end", sum("end" - start) AS length, count(*) AS blocks FROM seg GROUP BY "window", chrom, labels HAVING sum("end" - start) > 30)"""
_NEAR = """dir AS (SELECT a.id, a.start - (SELECT max(b."end") FROM fv b WHERE b.chrom = a.chrom AND b."end" <= a.start) AS upstream, (SELECT min(b.start) FROM fv b WHERE b.chrom = a.chrom AND b.start >= a."end") - a."end" AS downstream FROM ev a)"""


def _q(ctes: str, select: str) -> str:
    return f"WITH {EV}{',' if ctes else ''} {ctes} {select}"


ORACLE = {
    "fixed_windows": _q("", 'SELECT "window", chrom, start, "end" FROM win'),
    "overlap_join": _q("", f'SELECT a.id, b.id AS id_b, a.chrom, greatest(a.start, b.start) AS lo, least(a."end", b."end") AS hi FROM ev a JOIN fv b ON {_JOIN}'),
    "overlap_semi": _q("", f'SELECT id, chrom, start, "end" FROM ev a WHERE EXISTS (SELECT 1 FROM fv b WHERE {_JOIN})'),
    "overlap_anti": _q("", f'SELECT id, chrom, start, "end" FROM ev a WHERE NOT EXISTS (SELECT 1 FROM fv b WHERE {_JOIN})'),
    "map_mean": _q("", f'SELECT a."window", a.chrom, a.start, round(avg(b.score), 6) AS mean_score, count(b.score) AS n FROM win a LEFT JOIN fv b ON {_JOIN} GROUP BY ALL'),
    "map_distinct_priority": _q("", f"""SELECT a."window", CASE WHEN bool_or(b.label = 'u3') THEN 'u3' WHEN bool_or(b.label = 'u1') THEN 'u1' WHEN bool_or(b.label = 'u0') THEN 'u0' WHEN bool_or(b.label = 'u2') THEN 'u2' ELSE '.' END AS label FROM win a LEFT JOIN fv b ON {_JOIN} GROUP BY ALL"""),
    "strand_feature": _q("", f"""SELECT a."window", CASE WHEN bool_or(b.label = 'u0') THEN -1 WHEN bool_or(b.label = 'u1') THEN 1 ELSE 0 END AS strand FROM win a LEFT JOIN fv b ON {_JOIN} GROUP BY a."window" """),
    "weighted_coverage_mean": _q("", f'SELECT a."window", round(sum(b.score * (least(a."end", b."end") - greatest(a.start, b.start))) / sum(least(a."end", b."end") - greatest(a.start, b.start)), 6) AS mean FROM win a LEFT JOIN fv b ON {_JOIN} GROUP BY a."window"'),
    "coverage_fraction": _q("""m0 AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM fv),
m1 AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM m0),
u AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM m1 GROUP BY chrom, g)""", f'SELECT a."window", round(coalesce(sum(CASE WHEN b.start IS NOT NULL THEN least(a."end", b."end") - greatest(a.start, b.start) END), 0) / (a."end" - a.start) + 1e-6, 9) AS fraction FROM win a LEFT JOIN u b ON {_JOIN} GROUP BY a."window", a.start, a."end"'),
    "coverage_counts": _q("", 'SELECT a."window", count(b.id) AS n FROM win a LEFT JOIN ev b ON a.chrom = b.chrom AND b.start >= a.start AND b.start < a."end" GROUP BY a."window"'),
    "background_rate": _q("""c AS (SELECT a."window", count(b.id) AS n FROM win a LEFT JOIN ev b ON a.chrom = b.chrom AND b.start >= a.start AND b.start < a."end" GROUP BY a."window")""", 'SELECT "window", n, round((n + 1) / ((SELECT sum(n) FROM c) + (SELECT count(*) FROM c)), 12) AS rate FROM c'),
    "merge_intervals": _q(_ISLAND.format(by="chrom", tie="", gap=0), 'SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n, max(score) AS top FROM i1 GROUP BY chrom, island'),
    "gene_tiles": _q("""g0 AS (SELECT chrom, start, "end", CASE WHEN id % 5 = 0 THEN '-' WHEN id % 7 = 0 THEN '.' ELSE '+' END AS strand FROM ev),
g1 AS (SELECT *, unnest(CASE strand WHEN '+' THEN range(start - 90, "end", 90) WHEN '-' THEN range("end" + 90, start, -90) ELSE [] END) AS p, generate_subscripts(CASE strand WHEN '+' THEN range(start - 90, "end", 90) WHEN '-' THEN range("end" + 90, start, -90) ELSE [] END, 1) - 2 AS tile FROM g0),
g2 AS (SELECT chrom, greatest(p, 0) AS start, greatest(p, 0) + 90 AS "end", tile FROM g1 WHERE tile <= 4),
""" + _ISLAND.format(by="chrom", tie="", gap=-1).replace("FROM ev)", "FROM g2)"), 'SELECT chrom, min(start) AS start, max("end") AS "end", min(tile)::BIGINT AS tile FROM i1 GROUP BY chrom, island'),
    "merge_apart": _q(_ISLAND.format(by="chrom, label", tie="", gap=-1), 'SELECT chrom, label, min(start) AS start, max("end") AS "end", min(score) AS low FROM i1 GROUP BY chrom, label, island'),
    "merge_by_label_max": _q(_ISLAND.format(by="chrom", tie="", gap=0), 'SELECT chrom, min(start) AS start, max("end") AS "end", last(label ORDER BY score, label) AS label, max(score) AS top FROM i1 GROUP BY chrom, island'),
    "endpoint_stream": _q("""p AS (SELECT chrom, start AS pos, label, 1 AS step FROM ev UNION ALL SELECT chrom, "end", label, -1 FROM ev)""", "SELECT chrom, pos, 'ev' AS track, label AS feature, sum(step)::BIGINT AS net, count(*) AS n FROM p GROUP BY ALL"),
    "segments": _q(_SEG, 'SELECT "window", chrom, start, "end", labels FROM seg'),
    "multi_block_regions": _q(_SEG, 'SELECT row_number() OVER (ORDER BY chrom, start, labels) - 1 AS locus, chrom, start, "end", length::BIGINT AS length, labels, blocks FROM reg'),
    "linearize": _q("""pts AS (SELECT chrom, start AS p FROM ev UNION SELECT chrom, "end" FROM ev),
el AS (SELECT chrom, p AS start, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS "end" FROM pts),
lab AS (SELECT a.chrom, a.start, a."end", array_to_string(list_sort(list_distinct(list('ev:' || b.label))), '|') AS labels FROM el a JOIN ev b ON """ + _JOIN + """ WHERE a."end" IS NOT NULL GROUP BY ALL),
n AS (SELECT *, "end" - start AS len, CASE WHEN ("end" - start) / 90 < 1.5 THEN 1 ELSE ("end" - start) // 90 END AS k FROM lab),
c AS (SELECT *, CASE WHEN k = 1 THEN len ELSE len // k + 1 END AS cut, unnest(range(k)) AS i FROM n)""", 'SELECT chrom, start + i * cut AS start, least("end", start + (i + 1) * cut) AS "end", labels FROM c'),
    "unstack": _q(_SEG, 'SELECT s.chrom, s.labels, s.start, s."end" FROM seg s JOIN reg r ON s."window" = r."window" AND s.labels = r.labels'),
    "nearest_neighbor": _q("""pl AS (SELECT chrom, start, lag(start) OVER w AS b, lead(start) OVER w AS n FROM (SELECT DISTINCT chrom, start FROM ev) WINDOW w AS (PARTITION BY chrom ORDER BY start))""", "SELECT id, CASE WHEN b IS NOT NULL AND (n IS NULL OR start - b <= n - start) THEN start - b ELSE n - start END AS distance, CASE WHEN b IS NOT NULL AND (n IS NULL OR start - b <= n - start) THEN b ELSE n END AS neighbor FROM ev JOIN pl USING (chrom, start)"),
    "nearest_directional": _q(_NEAR, "SELECT id, upstream, downstream FROM dir"),
    "distance_features": _q(_NEAR, "SELECT id, round(CASE WHEN upstream >= 0 AND downstream >= 0 AND upstream + downstream > 0 THEN least(upstream / (upstream + downstream + 1), 1 - upstream / (upstream + downstream + 1)) ELSE 0 END, 9) AS progress, CASE WHEN upstream >= 0 AND downstream >= 0 AND upstream + downstream > 0 THEN upstream + downstream ELSE 0 END AS total FROM dir"),
    "cluster_islands": _q(_ISLAND.format(by="chrom", tie=", id", gap=30), "SELECT id, chrom, island::BIGINT AS island FROM i1"),
    "local_rate": _q("""a0 AS (SELECT id, chrom, greatest(start - 900, 0) AS start, start + 900 AS "end" FROM ev),
h AS (SELECT a.id, sum(b.score) AS r, sum(b."end" - b.start) AS w FROM a0 a JOIN fv b ON """ + _JOIN + " GROUP BY a.id)", "SELECT id, round(r / w * (SELECT count(*) FROM h), 9) AS local_rate FROM h"),
    "slop_windows": _q("", 'SELECT id, greatest(start - 5000, 0) AS start, start + 5000 AS "end" FROM ev'),
    "slice_regions": _q("", """SELECT id, chrom, start, "end" FROM ev WHERE (chrom = 'click' AND start < 500000 AND "end" > 10000) OR (chrom = 'view' AND "end" > 1000000)"""),
    "window_report": _q(_ISLAND.format(by="chrom", tie="", gap=0) + """, m AS (SELECT max("end") - min(start) AS length FROM i1 GROUP BY chrom, island)""", "SELECT count(*) AS n, min(length) AS shortest, max(length) AS longest, round(quantile_cont(length, 0.1), 6) AS q10, round(quantile_cont(length, 0.25), 6) AS q25, round(quantile_cont(length, 0.5), 6) AS q50, round(quantile_cont(length, 0.75), 6) AS q75, round(quantile_cont(length, 0.9), 6) AS q90 FROM m"),
}
