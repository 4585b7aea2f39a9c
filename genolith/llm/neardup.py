"""MinHash near-dedup: fast similarity sketching, banding, exact verification, connected components.

Texts with equal shingle sets form classes first; only one representative of each class goes on, so exact
copies never meet in pairs. Representatives that share a band are linked in a star to a few leaders
of the band (chosen by hashes, map-side combined), which joins large groups with a linear number of pairs. What
remains, pairs in one band that are still in different components, is tried in full, so no link that the bands find gets
lost and no group is expanded when it is already connected. Before such pairs are formed, documents leave that can't link: only shingles that also occur in
another component can be common, which bounds the intersection, and the bound must reach what the sizes ask for. Pairs
of the others must pass the same bound and longer sketches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genolith.llm.common import bound_batches, stored
from genolith.llm.graph import components
from genolith.llm.shingles import common, mix, shingle_sets, sketches

#: The first 128 of 256 coordinates form 32 bands of 4: a pair of similarity 0.75 shares no band with probability 5e-6.
COORDINATES, BANDS, ROWS = 256, 32, 4
#: Leaders of a band by hashes, beside the most central document (the one with the most company over all its bands).
LEADERS = 2
#: Ids broadcast at most (8 bytes each); beyond that the texts of candidates come by a shuffled join.
MAX_BROADCAST = 1_000_000
#: Four bits of each coordinate are kept; a pair of similarity 0.75 differs in 60 coordinates on average, with a deviation
#: of 6.8. A pair that differs in more than this is not verified (about 1e-8 of the pairs at 0.75).
MAX_DIFFER = 101
#: Documents that are still apart after the leaders get longer sketches of one bit a coordinate: at 0.75 two differ in 256 of these bits on average, with a deviation of 15.
LONG, MAX_LONG = 2048, 340
#: The same for their first words of 64 bits: 64 on average, with a deviation of 7.5.
FIRST, MAX_FIRST = 8, 107
#: Documents of a band that meet the others of the band in one task.
CROWD = 256
#: Shingles of documents that are still apart are counted in ranges of about this many, at least SPREAD ranges.
RANGE, SPREAD = 500_000, 32

_SKETCH = pa.schema([("key", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _nibbles(s: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates to a 64-bit integer."""
    low = (s & np.uint64(15)).reshape(len(s), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return _signed(low.sum(axis=2, dtype=np.uint64))


def _bits(s: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, 64 coordinates to a 64-bit integer."""
    low = (s & np.uint64(1)).reshape(len(s), -1, 64) << np.arange(64, dtype=np.uint64)
    return _signed(low.sum(axis=2, dtype=np.uint64))


def _differ(x: Column, y: Column) -> Column:
    """Number of coordinates in which two packed sketches differ."""

    def word(i: int) -> Column:
        d = F.get(x, i).bitwiseXOR(F.get(y, i))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return sum((word(i) for i in range(1, COORDINATES // 16)), word(0))


def _alike(x: Column, y: Column) -> Column:
    """Whether two long sketches differ in MAX_LONG bits at most. The first FIRST words decide on most pairs; written out in full the test would be too long to be compiled."""
    words = [F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(FIRST)]
    whole = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    return (sum(words[1:], words[0]) <= MAX_FIRST) & (whole <= MAX_LONG)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, two set fingerprints, four bits of each coordinate, and band hashes of each text."""
    salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]
    for batch in batches:
        key, tie, sets, done = batch.column(0), batch.column(1), [], 0

        def flush(done=0, sets=sets, key=key, tie=tie):
            s = sketches(sets, COORDINATES)
            bands = np.zeros((len(sets), BANDS), np.uint64) + salts
            for r in range(ROWS):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + s[:, r : BANDS * ROWS : ROWS])
            prints = [_signed(np.array([mix(x + np.uint64(c)).sum(dtype=np.uint64) for x in sets], np.uint64)) for c in (1, 2**40 + 7)]
            full = [len(x) > 0 for x in sets]
            return pa.record_batch([
                key.slice(done, len(sets)), tie.slice(done, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints[0]), pa.array(prints[1]),
                pa.array(list(_nibbles(s)), pa.list_(pa.int64())),
                pa.array([x if f else [] for x, f in zip(_signed(bands), full, strict=True)], pa.list_(pa.int64())),
            ], schema=_SKETCH)

        size = 0
        for x in shingle_sets(batch.column(2)):
            sets.append(x)
            size += len(x) + COORDINATES
            if size > 100_000:
                yield flush(done)
                done += len(sets)
                sets.clear()
                size = 0
        if sets:
            yield flush(done)


def _sets(long: bool):
    """id, its set and the set's size; long: also its long sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, size, sets = 0, 0, []
            for k, x in enumerate(shingle_sets(batch.column(1))):
                sets.append(x)
                size += len(x) + LONG
                if size > 100_000 or k == batch.num_rows - 1:
                    out = [batch.column(0).slice(done, len(sets)), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())]
                    if long:
                        out.append(pa.array(list(_bits(sketches(sets, LONG))), pa.list_(pa.int64())))
                    yield pa.record_batch(out, ["id", "set", "n", "bits"][: len(out)])
                    done, size, sets = k + 1, 0, []
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run


def _cut(ranges: int):
    """The set of each (id, c) cut into ranges of hashed shingles."""
    step = (1 << 64) // ranges + 1
    bounds = np.array([r * step for r in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts = np.split(x := np.frombuffer(x.as_buffer(), np.uint64), np.searchsorted(x, bounds))
                full = [(r, p.tobytes()) for r, p in enumerate(parts) if len(p)]
                yield pa.record_batch([pa.array([r for r, _ in full], pa.int64()), pa.array([i] * len(full), pa.int64()), pa.array([c] * len(full), pa.int64()), pa.array([p for _, p in full], pa.binary())], ["r", "id", "c", "part"])

    return run


def _foreign(rows: pa.Table) -> pa.Table:
    """Of each id, how many shingles of one range occur in another component as well."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in rows["part"].chunks for x in chunk]
    at = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    _, c = np.unique(rows["c"].to_numpy(), return_inverse=True)
    value, place = np.unique(np.concatenate(parts), return_inverse=True)
    low, high = np.full(len(value), len(c)), np.full(len(value), -1)
    np.minimum.at(low, place, c[at])
    np.maximum.at(high, place, c[at])
    return pa.table({"id": rows["id"], "s": np.bincount(at[(low != high)[place]], minlength=len(parts))})


def _verify(share: int):
    """Pairs whose sets intersect in at least share percent of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                c = common(p, q)
                ok.append(100 * c >= share * (len(p) + len(q) - c) and c > 0)
            yield batch.select([0, 1]).filter(pa.array(ok))
        pa.default_memory_pool().release_unused()

    return run


def _with(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """pairs with the column of both ends, from side (id, column)."""
    one = side.select(F.col("id").alias("a"), F.col(column).alias("x"))
    two = side.select(F.col("id").alias("b"), F.col(column).alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", share: int = 75, max_broadcast: int = MAX_BROADCAST, tie: str | None = None) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept, and the 64-bit hash of the row's text under the name `tie`, if given.

    Documents are linked if 100 * |A & B| >= share * |A | B| for their sets of distinct 5-word shingles
    (A-Z lower-cased; fewer words: the whole sequence); component_id is the smallest key that a document
    reaches, kept marks the row whose key it is. A null or blank text has an empty set and links with nothing.

    A null key stands alone: component_id null, kept true; its text links with no other. Rows that repeat a key:
    each is compared with its own text, they share the smallest component_id of all of them, and of equal keys the row with the smallest text hash is
    kept (of identical rows, all). Other columns are ignored. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = stored(base.mapInArrow(_sketch, "key long, tie long, n long, f1 long, f2 long, bits array<long>, bands array<long>"))
    real = found.where("key is not null and n > 0")
    # a class: equal sets; its smallest key stands for it
    classes = real.groupBy("f1", "f2", "n").agg(F.min_by(F.struct("bits", "bands"), F.struct("key", "tie")).alias("s"), F.min(F.struct("key", "tie")).alias("k"))
    reps = stored(classes.select(F.xxhash64("f1", "f2", "n").alias("id"), "f1", "f2", "n", F.col("k.key").alias("key"), F.col("k.tie").alias("tie"), "s.bits", "s.bands"))

    buckets = reps.select("id", F.explode("bands").alias("band"))
    crowds = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = stored(buckets.join(crowds, "band"))
    central = crowded.groupBy("id").agg(F.sum("size").alias("company"))
    lead = [F.max_by("id", F.struct("company", "id")).alias("l"), *[F.min_by("id", F.xxhash64(F.col("id"), F.lit(i))).alias(f"l{i}") for i in range(LEADERS)]]
    leaders = stored(crowded.join(central, "id").groupBy("band").agg(*lead))
    def of(rows: DataFrame, joined: DataFrame | None, column: str = "id", name: str = "c") -> DataFrame:
        """rows with the component of the document in `column` under `name`."""
        if joined is None:
            return rows.withColumn(name, F.col(column))
        return rows.join(joined.select(F.col("node").alias("node_"), F.col("component").alias("component_")), F.col(column) == F.col("node_"), "left").withColumn(name, F.coalesce("component_", column)).drop("node_", "component_")

    # the documents of a band meet its central one; those that it didn't bring together meet the others
    links, tested, joined = None, None, None
    for names in (["l"], [f"l{i}" for i in range(LEADERS)]):
        stars = crowded.select("band", F.col("id").alias("p")).join(leaders, "band").select("p", F.explode(F.array_distinct(F.array(*names))).alias("q")).where("p <> q")
        stars = _ordered(stars)
        if joined is not None:
            stars = of(of(stars, joined, "a", "ca"), joined, "b", "cb").where("ca <> cb").select("a", "b")
        stars = stored(stars)
        tested = stars if tested is None else tested.unionByName(stars)
        more = _confirm(stars, reps, base, share, max_broadcast)
        if more is not None:
            links = more if links is None else links.unionByName(more)
            joined = stored(components(links))

    # pairs in one band that are still apart
    def apart(rows: DataFrame) -> DataFrame:
        """Rows (band, c, n) of bands in which components of like sizes meet, with the smallest size in their band."""
        met = rows.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("band", "least")
        return rows.join(met, "band")

    left = stored(apart(of(crowded.select("band", "id"), joined).join(reps.select("id", "n", "key", "tie"), "id")).drop("least", "n"))
    which = stored(left.select("id", "key", "tie", "c").distinct())
    if count := which.count():
        sets = stored(_texts(which, base, count, max_broadcast).mapInArrow(_sets(True), "id long, set binary, n long, bits array<long>").dropDuplicates(["id"]))
        total = sets.agg(F.sum("n")).first()[0]
        parts = sets.join(which.select("id", "c"), "id").select("id", "c", "set").mapInArrow(_cut(max(SPREAD, total // RANGE)), "r long, id long, c long, part binary")
        foreign = parts.groupBy("r").applyInArrow(_foreign, "id long, s long").groupBy("id").agg(F.sum("s").alias("s"))
        known = stored(sets.drop("set").join(foreign, "id").where((100 * F.col("s") >= share * F.col("n"))))
        # an intersection of o needs (100 + share) * o >= share * (sum of sizes), and sizes in a link differ by share at most
        near = apart(left.select("band", "id", "c").join(known.select("id", "n", "s"), "id"))
        other = F.greatest("least", F.ceil(F.col("n") * share / 100))
        near = near.where((100 + share) * F.col("s") >= share * (F.col("n") + other)).drop("least")
        near = stored(near.join(known.select("id", "bits"), "id").join(reps.select("id", "bands"), "id"))
        # a large band is dealt out: each of its documents meets the others in one of `deal` tasks
        crowd = near.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("deal"))
        near = near.join(crowd, "band").withColumn("task", F.pmod(F.xxhash64("id"), F.col("deal")).cast("int"))
        x, y = (t.select("band", "task", *[F.col(c).alias(c + side) for c in ("id", "c", "n", "s", "bits", "bands")]) for t, side in ((near, "p"), (near.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("deal") - 1))), "q")))
        width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as the few bytes of these rows say nothing about the work
        x, y = x.repartition(width, "band", "task"), y.repartition(width, "band", "task")
        fits = (100 + share) * F.least("sp", "sq") >= share * (F.col("np") + F.col("nq"))
        once = F.get(F.array_intersect("bandsp", "bandsq"), 0) == F.col("band")  # a pair counts in its first common band
        found_pairs = x.join(y, ["band", "task"]).where((F.col("idp") < F.col("idq")) & (F.col("cp") != F.col("cq")) & fits & _alike(F.col("bitsp"), F.col("bitsq")) & once)
        rest = found_pairs.select(F.col("idp").alias("a"), F.col("idq").alias("b")).join(tested, ["a", "b"], "left_anti")
        more = stored(_with(rest, sets, "set").mapInArrow(_verify(share), "a long, b long"))
        joined = stored(components(more if links is None else links.unionByName(more)))

    named = of(reps.select("id", "f1", "f2", "key"), joined)
    lowest = named.groupBy("c").agg(F.min("key").alias("component_id"))
    each = named.join(lowest, "c").select("f1", "f2", "component_id")
    out = found.select("key", "tie", "n", "f1", "f2").join(each, ["f1", "f2"], "left").withColumn("component_id", F.when(F.col("key").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "key")))
    return _settle(out, key, tie)


def _settle(out: DataFrame, key: str, tie: str | None = None) -> DataFrame:
    """Rows that repeat a key get one component; keys without repeats pass through a map-side combined count."""
    again = out.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("least"), F.min("tie").alias("first")).where("rows > 1")
    return out.join(again, "key", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "component_id").alias("component_id"),
        (F.col("key").isNull() | ((F.col("key") == F.coalesce("least", "component_id")) & (F.col("tie") == F.coalesce("first", "tie")))).alias("kept"),
        *([F.col("tie").alias(tie)] if tie else []))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _texts(ids: DataFrame, base: DataFrame, count: int, max_broadcast: int) -> DataFrame:
    """id and text of the rows of base that stand for ids (id, key, tie)."""
    wanted = ids.select("id", "key", "tie")
    return base.join(F.broadcast(wanted) if count <= max_broadcast else wanted, ["key", "tie"]).select("id", "text")


def _confirm(pairs: DataFrame, reps: DataFrame, base: DataFrame, share: int, max_broadcast: int) -> DataFrame | None:
    """The pairs (a, b) that hold on full sets; None if there are no candidates."""
    pairs = _with(pairs, reps.select("id", "bits"), "bits").where(_differ(F.col("x"), F.col("y")) <= MAX_DIFFER).select("a", "b")
    likely = stored(pairs)
    ids = stored(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(reps.select("id", "key", "tie"), "id"))
    n = ids.count()
    if not n:
        return None
    sets = stored(_texts(ids, base, n, max_broadcast).mapInArrow(_sets(False), "id long, set binary, n long").dropDuplicates(["id"]))
    return stored(_with(likely, sets, "set").mapInArrow(_verify(share), "a long, b long"))
