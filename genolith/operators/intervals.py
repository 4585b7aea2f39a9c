"""Interval relations on (chrom, start, end) tables; intervals are half-open and 0-based.

Range conditions become equi-joins: both sides are cut into bins, joined on (chrom, bin), and a pair is
kept only in the bin of the greater start, so each pair appears once without a distinct.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = ("chrom", "start", "end")


def _names(df: DataFrame, *wanted: str) -> list[str]:
    """Internal names that clash with no column of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in wanted:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict overlap of two half-open intervals."""
    return (a_start < b_end) & (b_start < a_end)


def bin_width(*tables: DataFrame) -> int:
    """A width for binning: about the mean interval length, so an interval meets two bins on average."""
    mean = max((t.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 1.0) for t in tables)
    return max(16, int(mean))


#: Overlapping pairs for a task: their number grows with the square of the depth, not with the rows.
TASK_PAIRS = 10_000_000


def _shape(a: DataFrame, b: DataFrame) -> tuple[int, float]:
    """bin_width, and how many pairs overlap if each chrom's rows lie evenly over its span."""
    sums = [
        t.where("end > start").groupBy("chrom").agg(F.count(F.lit(1)).alias(f"n{i}"), F.sum((F.col("end") - F.col("start")).cast("double")).alias(f"l{i}"), F.min("start").alias(f"s{i}"), F.max("end").alias(f"e{i}"))
        for i, t in enumerate((a, b))
    ]
    pairs = (F.col("n0") * F.col("l1") + F.col("n1") * F.col("l0")) / (F.greatest("e0", "e1") - F.least("s0", "s1"))
    *means, found = sums[0].join(sums[1], "chrom", "full").agg(F.sum("l0") / F.sum("n0"), F.sum("l1") / F.sum("n1"), F.sum(pairs)).first()
    return max(16, int(max(m or 1.0 for m in means))), found or 0.0


def _binned(df: DataFrame, width: int, name: str) -> DataFrame:
    valid = df.where(F.col("end") > F.col("start"))  # a zero-length interval covers nothing
    return valid.withColumn(name, F.explode(F.sequence((F.col("start") / width).cast("long"), ((F.col("end") - 1) / width).cast("long"))))


#: Bins of a stretch, a power of two: rows are dealt by stretch and cut into bins where they arrive.
STRETCH = 8


def _met_at(df: DataFrame, suffix: str, width: int, tasks: int, part: str, name: str, places: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """df with a row for each of places(first bin, low, high) in column name, where low to high are the bins of its interval in a stretch; dealt to tasks if there are several.

    Most intervals lie in one stretch, so most rows are shuffled once, however many bins they have. Rows of a task are told by its number, part, which is
    a key of the join: Spark would deal them anew for hashes of fewer columns than the join has.
    """
    start, end, chrom = (c + suffix for c in ("start", "end", "chrom"))
    first, last = (F.col(start) / width).cast("long"), ((F.col(end) - 1) / width).cast("long")
    low, high = first, last
    (at,) = _names(df, "stretch")
    if tasks > 1:
        shift = STRETCH.bit_length() - 1
        df = df.withColumn(at, F.explode(F.sequence(F.shiftright(first, shift), F.shiftright(last, shift))))
        df = df.withColumn(part, F.pmod(F.xxhash64(at, F.col(chrom).cast("string")), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col(part))
        low, high = F.greatest(first, F.col(at) * STRETCH), F.least(last, F.col(at) * STRETCH + (STRETCH - 1))
    else:
        df = df.withColumn(part, F.lit(0))
    return df.withColumn(name, F.explode(places(first, low, high))).drop(at)


def overlap_join(a: DataFrame, b: DataFrame, width: int | None = None, suffix: str = "_b") -> DataFrame:
    """All pairs of overlapping rows on one chrom; columns of b get the suffix.

    A pair meets in the bin where the later of its rows starts, and only there: rows of a meet all of b where they start themselves, and behind that
    only the rows of b that start. So two rows that both reach into a bin from before are no candidates in it.
    """
    width, pairs = (width, 0.0) if width else _shape(a, b)
    tasks = math.ceil(pairs / TASK_PAIRS)  # Spark deals by the bytes of both sides, which say nothing of the pairs
    left, right = a.where("end > start"), b.where("end > start").select([F.col(c).alias(c + suffix) for c in b.columns])  # a zero-length interval covers nothing
    k, kb, part, part_b = (n for pair in zip(_names(left, "bin", "part"), _names(right, "bin_other", "part_other"), strict=True) for n in pair)
    two = F.lit(2).cast("long")
    behind = lambda low, high: F.when(low <= high, F.sequence(low * 2 + 1, high * 2 + 1, two)).otherwise(F.array().cast("array<bigint>"))
    left = _met_at(left, "", width, tasks, part, k, lambda first, low, high: F.when(low == first, F.concat(F.array(first * 2), behind(first + 1, high))).otherwise(behind(low, high)))
    right = _met_at(right, suffix, width, tasks, part_b, kb, lambda first, low, high: F.when(low == first, F.concat(F.sequence(low * 2, high * 2, two), F.array(first * 2 + 1))).otherwise(F.sequence(low * 2, high * 2, two)))
    if tasks > 1:
        right = right.hint("merge")
    s, e, sb, eb = F.col("start"), F.col("end"), F.col("start" + suffix), F.col("end" + suffix)
    # the bin first: sorting compares the first key's prefix, and few chroms tell no rows apart
    return left.join(right, (F.col(k) == F.col(kb)) & (F.col(part) == F.col(part_b)) & (F.col("chrom") == F.col("chrom" + suffix)) & overlaps(s, e, sb, eb)).drop(k, kb, part, part_b)


def overlap_filter(a: DataFrame, b: DataFrame, keep: bool = True, width: int | None = None) -> DataFrame:
    """Rows of a that overlap some row of b (keep) or none (not keep); each row at most once."""
    width = width or bin_width(a, b)
    k, kb, rid = _names(a, "bin", "bin_other", "rid")
    spans = _binned(b.select(*SPAN).distinct(), width, kb).select(F.col("chrom").alias("chrom_b"), F.col("start").alias("start_b"), F.col("end").alias("end_b"), kb)
    hit = _binned(a.select(*SPAN).distinct(), width, k).join(
        spans, (F.col("chrom") == F.col("chrom_b")) & (F.col(k) == F.col(kb)) & overlaps(F.col("start"), F.col("end"), F.col("start_b"), F.col("end_b")), "left_semi"
    ).select(*SPAN).distinct()
    return a.join(hit, list(SPAN), "left_semi" if keep else "left_anti")


def map_intervals(a: DataFrame, b: DataFrame, key: Sequence[str], aggs: dict[str, Column], width: int | None = None) -> DataFrame:
    """For each row of a (identified by key) aggregates over the overlapping rows of b (columns with suffix `_b`); null without one."""
    pairs = overlap_join(a, b, width).groupBy(*key).agg(*[c.alias(n) for n, c in aggs.items()])
    return a.join(pairs, list(key), "left")


def weighted_mean(a: DataFrame, b: DataFrame, key: Sequence[str], value: str = "score", name: str = "mean", width: int | None = None) -> DataFrame:
    """Mean of b's value over the covered bases of each row of a; null without coverage."""
    pairs = overlap_join(a, b, width)
    ov = F.least("end", "end_b") - F.greatest("start", "start_b")
    got = pairs.groupBy(*key).agg((F.sum(F.col(value + "_b") * ov) / F.sum(ov)).alias(name))
    return a.join(got, list(key), "left")


#: Bases of a range: what runs along a chrom is summed up by range first, so a chrom is as many tasks as it has ranges.
RANGE = 1 << 20


def running(df: DataFrame, by: Sequence[str], pos: str, order: Sequence[Column], value: str | Column, name: str, kind: str = "max", inclusive: bool = False, backwards: bool = False, width: int = RANGE) -> DataFrame:
    """Running max, min or sum of value over the rows of a group that come before a row (inclusive: and the row itself) along pos.

    order: begins with pos, descending if backwards. Groups are cut into ranges of pos; a range's own result is a row, and what earlier ranges give
    is carried in by a join, so no window holds more than a range. Rows without a group or a position have what their range gives.
    """
    made = {"max": F.max, "min": F.min, "sum": F.sum}[kind]
    at, own, carry, v = _names(df, "range_", "own_", "carry_", "value_")
    rows = df.withColumn(at, F.floor(F.col(pos) / width)).withColumn(v, F.col(value) if isinstance(value, str) else value)
    earlier = Window.partitionBy(*by).orderBy(F.desc(at) if backwards else F.asc(at)).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = rows.groupBy(*by, at).agg(made(v).alias(own)).select(*by, at, made(own).over(earlier).alias(carry))
    here = made(v).over(Window.partitionBy(*by, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    joined = rows.join(before, [*by, at], "left")
    total = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)) if kind == "sum" else (F.greatest if kind == "max" else F.least)(here, F.col(carry))
    return joined.withColumn(name, total).drop(at, carry, v)


def islands(df: DataFrame, by: Sequence[str] = ("chrom",), gap: int = 0, order: Sequence[str] = ("start", "end"), name: str = "island") -> DataFrame:
    """Number runs of intervals that overlap, abut or lie within gap of the running end; gap -1 keeps abutting ones apart. order begins with start."""
    along = [F.col(c) for c in order]
    reach, fresh = _names(df, "reach_", "fresh_")
    far = running(df, by, "start", along, "end", reach)
    flagged = far.withColumn(fresh, F.when(F.col(reach).isNull() | (F.col("start") > F.col(reach) + gap), 1).otherwise(0))
    return running(flagged, by, "start", along, fresh, name, "sum", inclusive=True).drop(reach, fresh)


def merge(df: DataFrame, by: Sequence[str] = ("chrom",), gap: int = 0, aggs: dict[str, Column] | None = None) -> DataFrame:
    """Union of intervals per group: by, start, end and aggregates of the merged rows."""
    extra = [c.alias(n) for n, c in (aggs or {}).items()]
    return islands(df, by, gap).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *extra).drop("island")


def coverage_fraction(a: DataFrame, b: DataFrame, key: Sequence[str], floor: float = 1e-6, name: str = "fraction", width: int | None = None) -> DataFrame:
    """Share of each row of a that the union of b covers, plus floor."""
    union = merge(b.select(*SPAN))
    got = overlap_join(a, union, width).groupBy(*key).agg(F.sum(F.least("end", "end_b") - F.greatest("start", "start_b")).alias("covered"))
    joined = a.join(got, list(key), "left")
    return joined.withColumn(name, F.coalesce("covered", F.lit(0)) / (F.col("end") - F.col("start")) + floor).drop("covered")


def fixed_windows(sizes: DataFrame, size: int) -> DataFrame:
    """(window, chrom, start, end): each chrom tiled from 0, the last window short; ids run by (chrom, start)."""
    tiles = sizes.where("size > 0").select("chrom", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(size))).alias("start"))
    tiles = tiles.select("chrom", F.col("start").cast("long").alias("start"), F.least(F.col("start") + size, F.col("size")).cast("long").alias("end"))
    # ids need no global sort: windows of earlier chroms are counted on the chrom table
    per = sizes.where("size > 0").select("chrom", F.ceil(F.col("size") / size).alias("n"))
    first = per.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return tiles.join(F.broadcast(first), "chrom").select((F.col("first") + F.expr(f"start div {size}")).cast("long").alias("window"), "chrom", "start", "end")


def count_in_windows(points: DataFrame, windows: DataFrame, size: int, pos: str = "start", name: str = "n") -> DataFrame:
    """Number of points in each window of a fixed tiling; an equi-join on the window's start."""
    counts = points.groupBy("chrom", (F.expr(f"`{pos}` div {size}") * size).cast("long").alias("start")).agg(F.count(F.lit(1)).alias(name))
    return windows.join(counts, ["chrom", "start"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def background_rate(points: DataFrame, windows: DataFrame, size: int, pos: str = "start") -> DataFrame:
    """(count + 1) / (all counts + number of windows) of each window."""
    got = count_in_windows(points, windows, size, pos)
    total = got.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("windows"))
    return got.join(F.broadcast(total)).withColumn("rate", (F.col("n") + 1) / (F.col("total") + F.col("windows"))).drop("total", "windows")


def breakpoints(*tables: DataFrame) -> DataFrame:
    """Elementary segments (chrom, start, end) between all distinct interval ends."""
    points = None
    for t in tables:
        p = t.select("chrom", F.explode(F.array("start", "end")).alias("pos"))
        points = p if points is None else points.unionByName(p)
    found = running(points.distinct(), ["chrom"], "pos", [F.desc("pos")], "pos", "end", "min", backwards=True)
    return found.select("chrom", F.col("pos").alias("start"), "end").where("end is not null")


def endpoints(tracks: DataFrame) -> DataFrame:
    """(chrom, pos, track, feature, step): +1 at each start, -1 at each end."""
    return tracks.select("chrom", "track", "feature", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("step")))).alias("x")).select("chrom", "x.pos", "track", "feature", "x.step")


def segments(tracks: DataFrame, windows: DataFrame | None = None, blacklist: DataFrame | None = None, width: int | None = None) -> DataFrame:
    """Elementary segments with their sorted `track:feature` labels joined by a bar.

    Without windows only labelled segments appear; with windows every segment lies in one of them and carries its id.
    Blacklisted segments are dropped. Lossless: equal labels that overlap or abut lose no bases.
    """
    cut = [tracks.select(*SPAN)] + [t.select(*SPAN) for t in (windows, blacklist) if t is not None]
    width = width or bin_width(windows if windows is not None else tracks)
    parts = breakpoints(*cut)
    if windows is not None:
        parts = overlap_join(parts, windows.select(*SPAN, "window"), width).select(*SPAN, F.col("window_b").alias("window"))
    if blacklist is not None:
        parts = overlap_filter(parts, blacklist, keep=False, width=width)
    named_tracks = tracks.where(F.col("end") > F.col("start")).select(*SPAN, F.concat_ws(":", "track", "feature").alias("label"))
    covered = merge(named_tracks, ["chrom", "label"])  # a segment meets each label once, however many intervals lie over it
    labelled = overlap_join(parts.select(*SPAN), covered, width)
    named = labelled.groupBy(*SPAN).agg(F.array_join(F.array_sort(F.collect_set("label_b")), "|").alias("labels"))
    how = "inner" if windows is None else "left"
    return parts.join(named, list(SPAN), how).withColumn("labels", F.coalesce("labels", F.lit("")))


def multi_block_regions(tracks: DataFrame, windows: DataFrame, blacklist: DataFrame | None = None, min_length: int = 0, width: int | None = None) -> DataFrame:
    """Segments of one window with equal labels become one region of several blocks; total length must exceed min_length.

    (locus, chrom, start, end, length, labels, blocks); locus is dense in (chrom, start, labels) order.
    """
    parts = segments(tracks, windows, blacklist, width)
    grouped = parts.groupBy("window", "chrom", "labels").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("length"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("blocks"))
    from genolith.operators.ordered import ordered_ids

    return ordered_ids(grouped.where(F.col("length") > min_length).drop("window"), ["chrom", "start", "labels"], "locus")


def linearize(tracks: DataFrame, max_length: int, width: int | None = None) -> DataFrame:
    """Labelled segments without windows; one of at least 1.5 max_length is chopped into (len div max) pieces of (len div n) + 1."""
    parts = segments(tracks, width=width).withColumn("len", F.col("end") - F.col("start"))
    n = F.when(F.col("len") / max_length < 1.5, F.lit(1)).otherwise(F.expr(f"len div {max_length}")).cast("long")
    parts = parts.withColumn("n", n).withColumn("cut", F.when(F.col("n") == 1, F.col("len")).otherwise(F.expr("len div n") + 1))
    chopped = parts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return chopped.select("chrom", (F.col("start") + F.col("i") * F.col("cut")).alias("start"), F.least("end", F.col("start") + (F.col("i") + 1) * F.col("cut")).alias("end"), "labels")


def subtract(parts: DataFrame, blacklist: DataFrame, width: int | None = None) -> DataFrame:
    """Rows that touch no blacklisted interval."""
    return overlap_filter(parts, blacklist, keep=False, width=width)


def slop(points: DataFrame, distance: int, pos: str = "pos") -> DataFrame:
    """start, end: the window [max(pos - d, 0), pos + d) around each point."""
    return points.withColumns({"start": F.greatest(F.col(pos) - distance, F.lit(0)), "end": F.col(pos) + distance})


def nearest_neighbor(points: DataFrame, pos: str = "pos") -> DataFrame:
    """Distance to the nearest point at another position of the chrom (null if none) and that position; ties take the left one."""
    places = running(points.select("chrom", pos).distinct(), ["chrom"], pos, [F.col(pos)], pos, "before")
    places = running(places, ["chrom"], pos, [F.desc(pos)], pos, "after", "min", backwards=True)
    left, right = F.col(pos) - F.col("before"), F.col("after") - F.col(pos)
    take_left = F.col("before").isNotNull() & (F.col("after").isNull() | (left <= right))
    near = places.select("chrom", pos, F.when(take_left, left).otherwise(right).alias("distance"), F.when(take_left, F.col("before")).otherwise(F.col("after")).alias("neighbor"))
    return points.join(near, ["chrom", pos])


def nearest_directional(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """For each interval of a the gaps to the end of the nearest b before it and to the start of the nearest b after it; null if none.

    One sorted pass: a and b are united and running extremes carry the neighbours, so no pairs are formed.
    """
    q = a.select(*key, *SPAN)
    ends = b.select("chrom", F.col("end").alias("at"), F.lit(0).alias("kind"), F.col("end").alias("seen"))
    both = q.select("*", F.col("start").alias("at"), F.lit(1).alias("kind")).unionByName(ends, allowMissingColumns=True)
    before = running(both, ["chrom"], "at", [F.col("at"), F.col("kind")], "seen", "prev", inclusive=True).where("kind = 1")
    starts = b.select("chrom", F.col("start").alias("at"), F.lit(1).alias("kind"), F.col("start").alias("seen"))
    base = before.select(*key, *SPAN, "prev")
    both = base.select("*", F.col("end").alias("at"), F.lit(0).alias("kind")).unionByName(starts, allowMissingColumns=True)
    after = running(both, ["chrom"], "at", [F.desc("at"), F.desc("kind")], "seen", "next", "min", inclusive=True, backwards=True).where("kind = 0")
    return after.select(*key, *SPAN, (F.col("start") - F.col("prev")).alias("upstream"), (F.col("next") - F.col("end")).alias("downstream"))


def distance_features(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """progress = min(p, 1 - p) with p = u / (u + d + 1), and total = u + d; (0, 0) where a side is missing or both are 0."""
    d = nearest_directional(a, b, key)
    u, v = F.col("upstream"), F.col("downstream")
    ok = F.coalesce((u >= 0) & (v >= 0) & (u + v > 0), F.lit(False))
    p = u / (u + v + 1)
    return d.withColumns({"progress": F.when(ok, F.least(p, 1 - p)).otherwise(0.0), "total": F.when(ok, u + v).otherwise(0)})


def running_sums(df: DataFrame, by: Sequence[str], pos: str, order: Sequence[Column], values: Sequence[str], width: int = RANGE) -> DataFrame:
    """values replaced by their sums over the rows of a group up to a row along pos; see running."""
    (at,) = _names(df, "range_")
    rows = df.withColumn(at, F.floor(F.col(pos) / width))
    earlier = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = rows.groupBy(*by, at).agg(*[F.sum(v).alias(v) for v in values]).select(*by, at, *[F.sum(v).over(earlier).alias(f"{v}_before") for v in values])
    upto = Window.partitionBy(*by, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {v: F.coalesce(F.sum(v).over(upto), F.lit(0)) + F.coalesce(f"{v}_before", F.lit(0)) for v in values}
    return rows.join(before, [*by, at], "left").select(*[c for c in df.columns if c not in values], *[x.alias(v) for v, x in sums.items()])


def band_rate(points: DataFrame, rates: DataFrame, key: Sequence[str], distance: int, pos: str = "pos", value: str = "score") -> DataFrame:
    """sum(rate) / sum(width) of the rate intervals that touch [pos - d, pos + d), times the number of points that touch any.

    No pairs are formed: what touches a span has begun before its end and not ended by its start, so sums over what has begun less sums over what has
    ended give it. Rates are added as whole numbers, scaled by a power of two to 93 bits of the largest, so nothing is lost where sums cancel.
    """
    x = F.col(value).cast("double")
    plain = F.abs(x) < float("inf")  # not NaN
    valid = rates.where((F.col("end") > F.col("start")) & F.col("chrom").isNotNull())
    top = valid.agg(F.max(F.when(plain, F.abs(x)))).first()[0] or 1.0
    scale = 2.0 ** (92 - math.frexp(top)[1]) if math.frexp(top)[1] > -900 else 2.0**990
    amounts = {"n": F.lit(1).cast("long"), "known": x.isNotNull().cast("long"), "width": (F.col("end") - F.col("start")).cast("long"), "rate": F.when(plain, (x * scale).cast("decimal(38,0)")),
               "nan": F.coalesce(F.isnan(x).cast("long"), F.lit(0).cast("long")), "up": F.coalesce((x == float("inf")).cast("long"), F.lit(0).cast("long")), "down": F.coalesce((x == float("-inf")).cast("long"), F.lit(0).cast("long"))}
    ends = valid.select("chrom", F.explode(F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(2).alias("kind")), F.struct(F.col("end").cast("long").alias("at"), F.lit(0).alias("kind")))).alias("e"), *[a.alias(n) for n, a in amounts.items()])
    ends = ends.groupBy("chrom", "e.at", "e.kind").agg(*[F.sum(n).alias(n) for n in amounts])  # a row a base, however many intervals end there
    places = slop(points.select("chrom", F.col(pos).cast("long").alias("place")).where(F.col("chrom").isNotNull() & F.col("place").isNotNull()).distinct(), distance, "place").where(F.col("end") > F.col("start"))
    asked = places.select("chrom", "place", F.explode(F.array(F.struct(F.col("end").alias("at"), F.lit(2).alias("side")), F.struct(F.col("start").alias("at"), F.lit(0).alias("side")))).alias("q")).select("chrom", "place", "q.at", "q.side", F.lit(1).alias("kind"))
    both = asked.unionByName(ends, allowMissingColumns=True)
    # of what stands at a place, ends come before the question and starts after it
    sides = [(f"{n}_{k}", F.when(F.col("kind") == k, F.col(n))) for n in amounts for k in (0, 2)]
    summed = running_sums(both.select("chrom", "place", "at", "side", "kind", *[v.alias(n) for n, v in sides]), ["chrom"], "at", [F.col("at"), F.col("kind")], [n for n, _ in sides]).where("kind = 1")
    held = summed.groupBy("chrom", "place").agg(*[F.sum(F.when(F.col("side") == 2, F.col(f"{n}_2")).otherwise(-F.col(f"{n}_0"))).alias(n) for n in amounts]).where("n > 0")
    hits = points.select(*key, "chrom", F.col(pos).cast("long").alias("place")).join(held, ["chrom", "place"]).groupBy(*key).agg(*[F.sum(n).alias(n) for n in amounts])
    odd = F.when((F.col("nan") > 0) | ((F.col("up") > 0) & (F.col("down") > 0)), float("nan")).when(F.col("up") > 0, float("inf")).when(F.col("down") > 0, float("-inf"))
    total = F.when(F.col("known") > 0, F.coalesce(odd, F.col("rate").cast("double") / scale))
    n = hits.agg(F.count(F.lit(1)).alias("all"))
    return hits.join(F.broadcast(n)).select(*key, (total / F.col("width") * F.col("all")).alias("local_rate"))


def tile_genes(genes: DataFrame, width: int = 2_000, overhang: int = 1, max_id: int = 100) -> DataFrame:
    """(chrom, start, end, tile): genes (chrom, start, end, strand) cut into tiles from their 5' end, joined where tiles overlap; the least number stays.

    Tile 0 begins at the 5' end; `overhang` tiles before it have negative numbers, and no gene has tiles beyond max_id. Tiles that only abut stay apart. Genes without a strand have no tiles.
    """
    ahead = overhang * width
    n = F.least(F.ceil((F.col("end") - F.col("start") + ahead) / width).cast("long"), F.lit(max_id + overhang + 1))
    rows = genes.where(F.col("strand").isin("+", "-")).select("chrom", "start", "end", "strand", n.alias("n")).where("n > 0")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = F.greatest(F.lit(0), F.when(F.col("strand") == "+", F.col("start") - ahead + F.col("i") * width).otherwise(F.col("end") + ahead - F.col("i") * width))
    tiles = rows.select("chrom", at.cast("long").alias("start"), (at + width).cast("long").alias("end"), (F.col("i") - overhang).alias("tile"))
    return merge(tiles, gap=-1, aggs={"tile": F.min("tile")})


def unstack(regions: DataFrame) -> DataFrame:
    """One row per block of each region, the other columns repeated."""
    rest = [c for c in regions.columns if c not in ("start", "end", "blocks")]
    return regions.select(*rest, F.explode("blocks").alias("x")).select(*rest, "x.start", "x.end")


def is_sorted(df: DataFrame, by: Sequence[str], within: Sequence[str], position: str) -> bool:
    """Whether by never falls along position inside each group."""
    w = Window.partitionBy(*within).orderBy(position)
    return df.withColumn("_before", F.lag(F.struct(*by)).over(w)).where(F.col("_before") > F.struct(*by)).isEmpty()
