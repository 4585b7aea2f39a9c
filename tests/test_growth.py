"""Steps whose work once grew faster than their input."""

import math

import numpy as np

from genolith.functions import sequence as sq
from genolith.llm import embeddings
from genolith.operators import features as ft
from genolith.operators import intervals as iv


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_meet_each_label_once(spark, monkeypatch):
    rows = [("c", i, i + 300, "t", f"u{i % 2}") for i in range(300)] + [("c", 700, 700, "t", "u0"), ("c", 300, 310, "t", "u2")]
    tracks = spark.createDataFrame(rows, "chrom string, start long, end long, track string, feature string").cache()
    made, plain = [], iv.overlap_join
    monkeypatch.setattr(iv, "overlap_join", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    got = {(r.start, r.end): r.labels for r in iv.segments(tracks).collect()}
    ends = sorted({x for r in rows for x in r[1:3]})
    want = {}
    for a, b in zip(ends, ends[1:], strict=False):
        labels = sorted({f"t:{f}" for _, s, e, _, f in rows if s < b and a < e and s < e})
        if labels:
            want[a, b] = "|".join(labels)
    assert got == want
    assert sum(df.count() for df in made) <= 3 * len(want)  # 90,000 pairs of segments and intervals before


def test_quantile_ranks_by_halving(spark):
    values = [float(v) for v in np.random.default_rng(1).integers(0, 400, 900)] + [None]
    df = ft.quantile(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double"), "x", n=100)
    assert "filter(q_" not in plan(df)
    x = np.array(values[:-1])
    q = np.quantile(x, np.arange(100) / 99)
    below, upto = np.searchsorted(q, x, "left"), np.searchsorted(q, x, "right")
    got = {r.id: r.norm for r in df.collect()}
    assert got[900] is None
    for i, v in enumerate(x):
        if below[i] == 0:
            want = 0.0
        elif upto[i] == 100:
            want = 1.0
        elif upto[i] > below[i]:
            want = (below[i] + upto[i] - 1) / 2 / 99
        else:
            want = (upto[i] - 1 + (v - q[upto[i] - 1]) / (q[upto[i]] - q[upto[i] - 1])) / 99
        assert abs(got[i] - want) < 1e-9


def test_context_frequencies_shuffle_a_row_a_key(spark):
    df = sq.context_frequencies(spark.createDataFrame([(1, "ACGTNACG"), (1, "TTT"), (2, "AC"), (3, None), (4, "nCCé")], "id int, seq string"), "id", "seq")
    assert plan(df).count("Exchange hashpartitioning") == plan(sq.region_length(df, "id")).count("Exchange hashpartitioning") == 1
    got = {(r.id, r.configuration, r.trinucleotide): r.freq for r in df.collect()}
    assert len(got) == 128 and {k[0] for k in got} == {1, 4}
    assert got[1, 0, "ACG"] == 2 + 3 / 64 and got[1, 1, "ACG"] == 1 + 3 / 64 and got[1, 1, "TTT"] == 3 / 64 and got[1, 0, "TTT"] == 1 + 3 / 64
    assert {r.id: r.length for r in sq.region_length(df, "id").collect()} == {1: 21.0, 4: 6.0}


def test_blocks_of_vectors_are_stored_once_however_many_meet(spark, monkeypatch):
    made, plain = [], embeddings.stored
    monkeypatch.setattr(embeddings, "stored", lambda df: made.append(plain(df)) or made[-1])
    x = np.random.default_rng(3).normal(size=(600, 4)).astype("float32")
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), cell=50, block=20).collect()}
    held = sum(len(r.x) for df in made if "x" in df.columns for r in df.select("x").collect())
    assert held == x.nbytes and not any("vec" in df.columns for df in made)  # a vector was stored for each cell that it visited
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None]
    assert [got[i].n_links for i in range(600)] == ((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()


def test_local_rates_form_no_pairs(spark, monkeypatch):
    made, plain = [], iv.overlap_join
    monkeypatch.setattr(iv, "overlap_join", lambda *a, **k: made.append(a) or plain(*a, **k))
    rng = np.random.default_rng(5)
    rates = [("ab"[i % 2], int(s), int(s + n), float(v)) for i, (s, n, v) in enumerate(zip(rng.integers(0, 3_000_000, 400), rng.integers(0, 200_000, 400), 10.0 ** rng.integers(-9, 4, 400) / 3, strict=True))]
    rates += [("a", 5_000_000, 5_000_010, None), ("a", 6_000_000, 6_000_010, float("nan")), ("a", 7_000_000, 7_000_010, float("inf")), ("a", 7_000_005, 7_000_010, 1.0)]
    points = [(i, "ab"[i % 2], int(p)) for i, p in enumerate(rng.integers(0, 3_300_000, 300))]
    points += [(300, "a", 5_000_900), (301, "a", 6_000_000), (302, "a", 7_000_000), (303, "a", 4_000_000), (304, None, 5), (305, "a", None), (299, "a", 1_000_000), (306, "a", 10)]
    got = {r.id: r.local_rate for r in iv.band_rate(spark.createDataFrame(points, "id int, chrom string, pos long"), spark.createDataFrame(rates, "chrom string, start long, end long, score double"), ["id"], 900).collect()}
    want: dict = {}
    for i, c, p in points:
        for d, s, e, v in rates if p is not None else []:
            if c == d and max(p - 900, 0) < e and s < p + 900 and s < e:
                want.setdefault(i, []).append((v, e - s))
    assert set(got) == set(want) and not made
    for i, found in want.items():
        known = [v for v, _ in found if v is not None]
        rate = math.fsum(known) / sum(w for _, w in found) * len(want) if known else None
        assert got[i] == rate or (rate != rate and got[i] != got[i]) or math.isclose(got[i], rate, rel_tol=1e-14)


def test_overlapping_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(iv, "TASK_PAIRS", 500, raising=False)
    rng = np.random.default_rng(7)
    draw = lambda n, most: [(i, "ab"[i % 2], int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(-900, 2_000, n), rng.integers(0, most, n), strict=True))]
    a, b = draw(300, 700) + [(300, None, 0, 9), (301, "a", None, 9)], draw(260, 300)
    da, db = (spark.createDataFrame(x, "id int, chrom string, start long, end long") for x in (a, b))
    df = iv.overlap_join(da, db)
    want = sorted((i, j) for i, c, s, e in a for j, d, t, f in b if s is not None and c == d and s < f and t < e and s < e and t < f)
    for width in (None, 16, 90, 5_000):
        assert sorted((r.id, r.id_b) for r in iv.overlap_join(da, db, width).collect()) == want
    assert "BroadcastExchange" not in plan(df)  # a side of small files passed through the driver
    assert df.rdd.getNumPartitions() > 4  # few tasks, however many the pairs, before


def test_overlapping_rows_are_shuffled_once_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(iv, "TASK_PAIRS", 500, raising=False)
    rng = np.random.default_rng(8)
    draw = lambda n: [(i, "abc"[i % 3], int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(-40_000, 40_000, n), rng.integers(1, 1_600, n), strict=True))]
    a, b = draw(700), draw(600)
    a[0] = (0, "a", -39_000, 39_000)  # over many stretches, as some of b
    b[0] = (0, "a", -41_000, 12_345)
    da, db = (spark.createDataFrame(x, "id int, chrom string, start long, end long") for x in (a, b))
    df = iv.overlap_join(da, db)
    want = sorted((i, j) for i, c, s, e in a for j, d, t, f in b if c == d and s < f and t < e)
    assert sorted((r.id, r.id_b) for r in df.collect()) == want
    assert df.columns == ["id", "chrom", "start", "end", "id_b", "chrom_b", "start_b", "end_b"]
    written, todo = [], [df._jdf.queryExecution().executedPlan().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    assert len(written) >= 2
    assert sum(written) < 1.7 * (len(a) + len(b))  # a row for each of its bins, and one more, before
