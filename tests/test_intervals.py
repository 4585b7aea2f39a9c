import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from genolith.operators import intervals as iv
from genolith.operators import ordered as od


@pytest.fixture(scope="module")
def tracks(spark):
    rng = random.Random(1)

    def make(n):
        rows = []
        for i in range(n):
            s = rng.randrange(2000)
            rows.append((i, rng.choice(["c1", "c2", "c10"]), s, s + rng.randrange(1, 90), float(i)))
        return rows

    a, b = make(200), make(200)
    schema = "id long, chrom string, start long, end long, score double"
    return a, b, spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


@pytest.mark.parametrize("width", [7, 64, 4096])
def test_overlap_join_finds_each_pair_once(tracks, width):
    a, b, da, db = tracks
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    got = sorted((r.id, r.id_b) for r in iv.overlap_join(da, db, width).select("id", "id_b").collect())
    assert got == want
    hit = {i for i, _ in want}
    assert {r.id for r in iv.overlap_filter(da, db, width=width).collect()} == hit
    assert {r.id for r in iv.overlap_filter(da, db, keep=False, width=width).collect()} == set(range(200)) - hit


def test_merge_and_segments_cover_the_same_bases(spark, tracks):
    a, _, da, _ = tracks
    bases = {(c, p) for _, c, s, e, _ in a for p in range(s, e)}
    merged = iv.merge(da.select("chrom", "start", "end")).collect()
    assert {(r.chrom, p) for r in merged for p in range(r.start, r.end)} == bases
    assert sum(r.end - r.start for r in merged) == len(bases)
    t = da.selectExpr("chrom", "start", "end", "'t' as track", "concat('f', id % 3) as feature")
    for r in iv.segments(t).collect():
        want = {f"t:f{i % 3}" for i, c, s, e, _ in a if c == r.chrom and s < r.end and r.start < e}
        assert set(r.labels.split("|")) == want


def test_windows_are_tiled_by_name_with_a_short_last_one(spark):
    sizes = spark.createDataFrame([("c1", 1000), ("c2", 450), ("c10", 250)], "chrom string, size int")
    rows = [tuple(r) for r in iv.fixed_windows(sizes, 400).orderBy("window").collect()]
    assert rows == [(0, "c1", 0, 400), (1, "c1", 400, 800), (2, "c1", 800, 1000), (3, "c10", 0, 250), (4, "c2", 0, 400), (5, "c2", 400, 450)]


def test_nearest_and_distance(spark, tracks):
    a, b, da, db = tracks
    got = {r.id: (r.upstream, r.downstream) for r in iv.nearest_directional(da, db, ["id"]).collect()}
    for i, c, s, e, _ in a:
        up = [s - y[3] for y in b if y[1] == c and y[3] <= s]
        down = [y[2] - e for y in b if y[1] == c and y[2] >= e]
        assert got[i] == (min(up, default=None), min(down, default=None))
    for r in iv.distance_features(da, db, ["id"]).collect():
        assert 0 <= r.progress <= 0.5 and r.total >= 0


def test_chop_rule(spark):
    t = spark.createDataFrame([("c", 0, 100, "t", "f"), ("c", 200, 340, "t", "f"), ("c", 400, 725, "t", "f")], "chrom string, start long, end long, track string, feature string")
    rows = [(r.start, r.end) for r in iv.linearize(t, 100).orderBy("start").collect()]
    assert rows == [(0, 100), (200, 340), (400, 509), (509, 618), (618, 725)]


def test_global_order_over_many_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    assert [(r.k, r.id) for r in od.ordered_ids(df, ["k"], parts=7).orderBy("k").collect()] == [(i, i) for i in range(1000)]
    assert od.ordered_ids(df.where("k < 0"), ["k"]).count() == 0


def test_sampling_is_repeatable(spark):
    df = spark.range(100)
    one, two = ([r.id for r in od.sample_exact(df.repartition(n), "id", 10, seed=3).collect()] for n in (1, 5))
    assert sorted(one) == sorted(two) and len(one) == 10
    a, b = od.hash_split(df, "id", 0.8)
    assert a.count() + b.count() == 100 and a.intersect(b).isEmpty()


def test_running_values_over_ranges(spark):
    """Ranges of any width give what one window over the whole group gives; ties, gaps of many ranges and negative places included."""
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.choice([-5, 0, 3, 3, 7, 90, 91, 1000]) + rng.randrange(3), i, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "chrom string, pos long, id long, v long")
    for kind, backwards, inclusive in (("max", False, False), ("min", True, True), ("sum", False, True)):
        order = [F.desc("pos"), F.desc("id")] if backwards else [F.col("pos"), F.col("id")]
        w = Window.partitionBy("chrom").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = {r.id: r.x for r in df.withColumn("x", {"max": F.max, "min": F.min, "sum": F.sum}[kind]("v").over(w)).collect()}
        for width in (4, 1 << 20):
            got = {r.id: r.x for r in iv.running(df, ["chrom"], "pos", order, "v", "x", kind, inclusive, backwards, width).collect()}
            assert got == want
