"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors form a class first. A pair within the threshold may straddle a border between cells: if v lies nearest
to centre b, then u with cos(u, v) >= s lies within sin(acos(s)) of the plane halfway between its own centre and b. Cells are
cut into blocks of bounded size, a row each; every two blocks meet once, and of two cells only the vectors that near to their border
are multiplied, so no link is lost. Two blocks report link counts and a spanning forest, never their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolith.llm.common import bound_batches, stored
from genolith.llm.graph import components

#: k-means is fitted on this many vectors at most (by a hash of the vector); cells aim at CELL vectors, MAX_CELLS at most.
SAMPLE, CELL, MAX_CELLS, BLOCK = 16_384, 4_096, 2_048, 2_048
#: Bytes of a block's vectors at most.
BLOCK_BYTES = 1 << 20


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x /= np.abs(x).max(axis=1)[:, None]  # no overflow or underflow in squares
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fit_centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means with seeds spread by farthest-point choice; x: unit rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        size = np.sqrt((total * total).sum(axis=1))
        centres[size > 1e-9] = total[size > 1e-9] / size[size > 1e-9][:, None]
    return centres


def _near(x: np.ndarray, own: int, other: int, centres: np.ndarray | None, reach: float) -> np.ndarray:
    """Places of the rows of cell `own` that lie near enough to the border with cell `other` to link across it."""
    if own == other or centres is None:
        return np.arange(len(x))
    across = centres[own] - centres[other]
    return np.flatnonzero(x @ across <= reach * math.sqrt(across @ across) + 1e-12)


def _tile(ids: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], threshold: float, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, link counts and roots of a spanning forest of two blocks, or of one with itself; rows without a link are left out."""
    n = len(ids[0])
    every, size = (ids[0], sizes[0]) if alone else (np.concatenate(ids), np.concatenate(sizes))
    links, label = np.zeros(len(every), np.int64), np.arange(len(every))
    for lo in range(0, n, 256):
        near = x[0][lo : lo + 256] @ x[1].T >= threshold
        if alone:
            near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
        if not near.any():
            continue
        i, j = near.nonzero()
        p, q = lo + i, j if alone else n + j
        np.add.at(links, p, size[q])
        if not alone:
            np.add.at(links, q, size[p])
        while len(p):  # the roots of a link's ends are united, so what earlier parts joined moves along; label stays flat
            r, s = label[p], label[q]
            apart = r != s
            p, q = p[apart], q[apart]
            np.minimum.at(label, np.maximum(r, s)[apart], np.minimum(r, s)[apart])
            while (label[label] != label).any():
                label = label[label]
    some = np.flatnonzero((links > 0) | (label != np.arange(len(every))))
    return every[some], links[some], every[label[some]]


def near_vectors(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", threshold: float = 0.95, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """key, n_links, component_id, kept of each row: links join vectors with cosine >= threshold in double precision.

    n_links counts the other rows linked directly, component_id is the smallest key reachable, kept marks the row with it.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows with a null key (component_id null, kept) or
    vectors of different lengths. Rows that repeat a key: each counts as a vector, and they share a component if their vectors link. An empty table gives an empty
    result; other columns are ignored.
    """
    bound_batches(vectors.sparkSession)
    v = F.col("v")
    single = vectors.schema[column].dataType.simpleString() == "array<float>"  # kept as it is: half the bytes, and the same vectors in double precision
    kind, width = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    base = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast(kind).alias("v"))
    usable = F.col("key").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = base.withColumn("h", F.when(F.coalesce(usable, F.lit(False)), F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b"))))
    good = base.where("h is not null")
    reps = stored(good.groupBy("h").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("size"), F.any_value("v").alias("v")).select(F.col("h.a").alias("id"), "h", "low", "size", "v"))

    centres, total = {}, reps.count()
    k = max(1, min(MAX_CELLS, math.ceil(total / cell)))
    seen: dict[int, list] = {}
    for r in reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect():
        seen.setdefault(len(r.v), []).append(r.v)
    for dim, found in seen.items():
        x = np.array(found, float)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        centres[dim] = fit_centres(x, max(1, round(k * len(x) / sum(map(len, seen.values())))))
    given = vectors.sparkSession.sparkContext.broadcast(centres)  # at most MAX_CELLS vectors
    reach = math.sqrt(1 - threshold * threshold) + 1e-9

    def place(batches):
        for batch in batches:
            cells = []
            for vec in batch.column(2):
                u = _units(vec.values.to_numpy(zero_copy_only=False)[None])[0]
                c = given.value.get(len(u))
                cells.append(0 if c is None else int((c @ u).argmax()))
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.int32())], [*batch.schema.names, "cell"])

    placed = reps.select("id", "size", "v").mapInArrow(place, f"id long, size long, v {kind}, cell int").withColumn("dim", F.size("v"))
    held = F.least(F.lit(block), F.greatest(F.lit(16), F.floor(F.lit(BLOCK_BYTES // 8) / F.col("dim"))))
    counts = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).select("dim", "cell", F.ceil(F.col("n") / held).cast("int").alias("blocks"))
    rows = placed.join(F.broadcast(counts), ["dim", "cell"]).withColumn("m", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))  # one row per cell

    def pack(part: pa.Table) -> pa.Table:
        first = [part[c][0].as_py() for c in ("dim", "cell", "m")]
        blobs = [part[c].to_numpy().astype("<i8").tobytes() for c in ("id", "size")] + [pc.list_flatten(part["v"]).to_numpy().astype(width).tobytes()]
        return pa.table([[v] for v in (*first, *blobs)], schema=pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("m", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("x", pa.binary())]))

    # a row a block: its vectors are shuffled and stored once
    blocks = stored(rows.select("dim", "cell", "m", "id", "size", "v").groupBy("dim", "cell", "m").applyInArrow(pack, "dim int, cell int, m int, ids binary, sizes binary, x binary"))

    def meet(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim, cell, m, cell_b, m_b = (batch.column(c)[r].as_py() for c in ("dim", "cell", "m", "cell_b", "m_b"))
                ids, ids_b, sizes, sizes_b = (np.frombuffer(batch.column(c)[r].as_buffer(), "<i8") for c in ("ids", "ids_b", "sizes", "sizes_b"))
                a, b = (_units(np.frombuffer(batch.column(c)[r].as_buffer(), width).reshape(-1, dim)) for c in ("x", "x_b"))
                i, j = _near(a, cell, cell_b, given.value.get(dim), reach), _near(b, cell_b, cell, given.value.get(dim), reach)
                if len(i) and len(j):
                    out = _tile((ids[i], ids_b[j]), (sizes[i], sizes_b[j]), (a[i], b[j]), threshold, (cell, m) == (cell_b, m_b))
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in out], ["id", "links", "root"])

    # every two blocks meet in a task that reads both where they are stored: nothing is copied on disk, however many blocks there are
    later = blocks.select("dim", *[F.col(c).alias(f"{c}_b") for c in ("cell", "m", "ids", "sizes", "x")]).hint("shuffle_replicate_nl").alias("later")
    after = (F.col("cell") < F.col("cell_b")) | ((F.col("cell") == F.col("cell_b")) & (F.col("m") <= F.col("m_b")))
    pairs = blocks.alias("here").join(later, (F.col("here.dim") == F.col("later.dim")) & after).select("here.*", "cell_b", "m_b", "ids_b", "sizes_b", "x_b")
    found = stored(pairs.mapInArrow(meet, "id long, links long, root long"))

    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> root"), "id", "root")
    named = reps.select("id", "h", "low", "size").join(linked, "id", "left").join(joined, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id"))
    lowest = named.groupBy("c").agg(F.min("low").alias("lowest"))
    each = named.join(lowest, "c").select("h", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), "lowest")
    return base.select("key", "h").join(each, "h", "left").select(
        F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNotNull(), F.coalesce("lowest", "key")).alias("component_id"),
        (F.col("key").isNull() | (F.col("key") == F.coalesce("lowest", "key"))).alias("kept"))
