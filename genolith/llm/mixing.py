"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over the cells (source, language, topic); raking scales the cells until their source, language and topic
marginals match the targets; documents are then kept with their cell's calibrated probability, decided by a
hash, so the same document always gets the same answer. Topics are clusters of hashed word counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genolith.llm.common import bound_batches, fresh, stored
from genolith.llm.embeddings import fit_centres
from genolith.llm.shingles import chunks, word_hashes

#: The topic model starts from clusters of this many documents at most and is then fitted on all of them.
SAMPLE, TOPICS, BINS = 1_500, 8, 256
#: Rounds over all documents at most; they end earlier when no centre moves by MOVED. Vectors are summed as integers, so the order of rows changes nothing.
FIT_ROUNDS, MOVED, UNIT = 12, 1e-4, 65_535
#: Share of the tokens to keep; exponent that flattens the cells' tokens into targets.
KEEP, FLATTEN = 0.8, 0.85
#: Rounds of raking at most, the miss of a margin at which they end, and the largest miss of a raking that is used for its higher share of tokens.
ROUNDS, TOLERANCE, ACCEPTED = 1_000, 1e-9, 1e-6
#: Cells raked on the driver at most (about 100 bytes each); more are raked by Spark.
MAX_LOCAL = 200_000
MARGINS = ("source", "lang", "topic")
T_ = TypeVar("T_")


def _vectors(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors of square-root word counts in hashed bins, and word counts, for runs of texts."""
    for lo, hi, data, off in chunks(texts):
        h, first = word_hashes(data, off)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        x = np.zeros((hi - lo, BINS))
        np.add.at(x, (row, (h % np.uint64(BINS)).astype(np.int64)), 1.0)
        x = np.sqrt(x)
        size = np.sqrt((x * x).sum(axis=1))
        yield x / np.where(size > 0, size, 1)[:, None], np.diff(first)


def fit_topics(docs: DataFrame, topics: int = TOPICS, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Centres of word-count clusters over all documents with words; seeds are the clusters of those with the lowest hashes (at most `sample`)."""
    bound_batches(docs.sparkSession)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for x, n in _vectors(batch.column(1)):
                blobs = [v.tobytes() if c else None for v, c in zip(np.rint(x * UNIT).astype("<u2"), n.tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).slice(done, len(blobs)), pa.array(blobs, pa.binary())], ["h", "v"])
                done += len(blobs)

    rows = docs.select(F.xxhash64(F.col(key).cast("long"), text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    all_ = stored(rows.mapInArrow(vectors, "h long, v binary").where("v is not null"))
    seeds = [r.v for r in all_.orderBy("h", "v").limit(sample).collect()]
    if not seeds:
        return np.zeros((1, BINS))
    x = np.frombuffer(b"".join(seeds), "<u2").reshape(len(seeds), BINS) / UNIT
    centres = fit_centres(x / np.sqrt((x * x).sum(axis=1))[:, None], topics)
    for _ in range(FIT_ROUNDS):
        total = np.zeros_like(centres)
        for c, b, n in _sums(all_, centres).collect():  # at most topics x BINS rows
            total[c, b] = n
        size = np.sqrt((total * total).sum(axis=1))
        new = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], centres)
        moved, centres = np.abs(new - centres).max(), new
        if moved < MOVED:
            break
    return centres


def _sums(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(c, b, n): sum of bin b over the vectors nearest to centre c; each task sends one row per centre and bin."""
    given = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(given.value)
        total = np.zeros((k, BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2").reshape(batch.num_rows, BINS)
                nearest = (x @ given.value.T).argmax(axis=1)
                for c in range(k):
                    total[c] += x[nearest == c].sum(axis=0, dtype=np.int64)
        c, b = total.nonzero()
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(b, pa.int32()), pa.array(total[c, b])], ["c", "b", "n"])

    return vectors.select("v").mapInArrow(run, "c int, b int, n long").groupBy("c", "b").agg(F.sum("n").alias("n"))


def with_topics(docs: DataFrame, centres: np.ndarray, text: str = "text") -> DataFrame:
    """docs plus topic (string) and n_tokens (words); a text without words has the topic `none`."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("topic", "n_tokens")
    given = docs.sparkSession.sparkContext.broadcast(centres)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = [], []
            for x, n in _vectors(batch.column(at).fill_null("")):
                best = (x @ given.value.T).argmax(axis=1)
                names += [f"t{b}" if c else "none" for b, c in zip(best.tolist(), n.tolist(), strict=True)]
                counts += n.tolist()
            yield pa.record_batch([*batch.columns, pa.array(names, pa.string()), pa.array(counts, pa.int64())], [*batch.schema.names, "topic", "n_tokens"])

    schema = T.StructType([*docs.schema.fields, T.StructField("topic", T.StringType()), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(run, schema)


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], keep: float | None = None) -> tuple[np.ndarray, float]:
    """Shares of cells whose margins match the targets, nearest to the present shares in relative entropy, and the largest miss of a margin.

    keep: no cell may get more than its present share / keep, so that keeping this share of all tokens needs no probability above 1. The limit is one
    more projection in each round, with Dykstra's correction, as it is no plain equation.
    """
    share = cells / cells.sum()
    w, q = share.copy(), np.ones_like(share)
    for _ in range(ROUNDS):
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, w, len(target))
            w = w * np.divide(target, now, out=np.ones_like(target), where=now > 0)[code]
        if keep is not None:
            z = w * q
            w = np.minimum(z, share / keep)
            q = np.divide(z, w, out=np.ones_like(z), where=w > 0)
        miss = max(float(np.abs(target - np.bincount(code, w, len(target))).max()) for code, target in zip(codes, targets, strict=True))
        if miss < TOLERANCE:
            break
    return w, miss


def _search(raked: Callable[[float | None], tuple[T_, float, float]], keep: float, bound: float) -> tuple[T_, float, float]:
    """The shares to aim at, the share of all tokens that can be kept with them (`keep` or the largest tried below it), and the miss.

    raked(keep) gives shares, miss and the largest ratio of a share to the present one. Plain raking always works with keep = 1 / that ratio; limited
    raking keeps more where it converges. bound: no margin can give more than it has.
    """
    plain, miss, most = raked(None)
    safe, k = min(keep, 1 / most), min(keep, bound)
    while k > safe:
        found, missed, _ = raked(k)
        if missed <= ACCEPTED:
            return found, k, missed
        k *= 0.95
    return plain, safe, miss


def _rake_spark(cells: DataFrame, goals: dict[str, DataFrame], total: float, keep: float | None) -> tuple[DataFrame, float, float]:
    """`rake` on a table of cells of any size: one grouped sum and one join for each margin and round. Also the largest ratio of a share to the present one."""
    share = F.col("tokens") / total
    w, miss = cells.withColumns({"w": share, "q": F.lit(1.0)}), 0.0
    for _ in range(ROUNDS):
        for m in goals:
            now = w.groupBy(m).agg(F.sum("w").alias("now")).join(goals[m], m)
            w = w.join(now, m).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col("g") / F.col("now")).otherwise(F.col("w"))).drop("now", "g")
        if keep is not None:
            z, limit = F.col("w") * F.col("q"), share / keep
            w = w.withColumn("z", z).withColumn("w", F.least("z", limit)).withColumn("q", F.when(F.col("w") > 0, F.col("z") / F.col("w")).otherwise(1.0)).drop("z")
        w = stored(w)
        miss = max(w.groupBy(m).agg(F.sum("w").alias("now")).join(goals[m], m).agg(F.max(F.abs(F.col("g") - F.col("now")))).first()[0] for m in goals)
        if miss < TOLERANCE:
            break
    return w, miss, w.agg(F.max(F.col("w") / share)).first()[0]


def _calibrate_spark(cells: DataFrame, wanted: dict[str, dict[str, float]], keep: float) -> DataFrame:
    total, spark = cells.agg(F.sum("tokens")).first()[0], cells.sparkSession
    sums = {m: cells.groupBy(m).agg(F.sum("tokens").alias("t")) for m in MARGINS}

    def shares(g: DataFrame, m: str) -> DataFrame:
        return stored(g.select(m, (F.col("g") / (g.agg(F.sum("g")).first()[0] or 1.0)).alias("g")))

    goals = {m: shares(sums[m].join(spark.createDataFrame(list(wanted[m].items()), f"{m} string, g double"), m, "left").select(m, F.coalesce("g", F.lit(0.0)).alias("g")), m) for m in MARGINS if wanted.get(m)}
    flat = stored(cells.withColumn("tokens", F.pow(F.col("tokens").cast("double"), FLATTEN)))
    if goals:
        flat = _rake_spark(flat, goals, flat.agg(F.sum("tokens")).first()[0], None)[0].withColumn("tokens", F.col("w"))
    goals |= {m: shares(flat.groupBy(m).agg(F.sum("tokens").alias("g")), m) for m in MARGINS if m not in goals}
    bound = min(goals[m].where("g > 0").join(sums[m], m).agg(F.min(F.col("t") / total / F.col("g"))).first()[0] or 1.0 for m in MARGINS)
    w, k, miss = _search(lambda k: _rake_spark(cells, goals, total, k), keep, bound)
    return w.select(*MARGINS, F.least(F.lit(1.0), F.col("w") * total / F.col("tokens") * k).alias("probability"), F.lit(k).alias("share"), F.lit(float(miss)).alias("miss"))


def calibrate(cells: DataFrame, wanted: dict[str, dict[str, float]] | None = None, keep: float = KEEP, max_local: int = MAX_LOCAL) -> DataFrame:
    """(source, lang, topic, probability, share, miss) of each cell (source, lang, topic, tokens).

    With these probabilities the expected tokens have the target margins. share: the expected share of all tokens, `keep` or less where the targets ask a margin
    or cell for more than it has. miss: the largest difference left between an expected margin and its target, about 0 unless no table with
    these cells has such margins. Cells beyond max_local are raked by Spark, with the same steps.
    """
    wanted, spark = wanted or {}, cells.sparkSession
    kind = ", ".join(f"{m} string" for m in MARGINS) + ", probability double, share double, miss double"
    cells = stored(cells.where("tokens > 0"))
    if (n := cells.count()) > max_local:
        return _calibrate_spark(cells, wanted, keep)
    rows = sorted(tuple(r) for r in cells.select(*MARGINS, "tokens").collect()) if n else []
    if not rows:
        return spark.createDataFrame([], kind)
    tokens = np.array([r[3] for r in rows], float)
    codes, values = [], []
    for i in range(len(MARGINS)):
        values.append(sorted({r[i] for r in rows}))
        place = {v: k for k, v in enumerate(values[i])}
        codes.append(np.array([place[r[i]] for r in rows]))
    targets: list = [np.array([wanted[m].get(v, 0.0) for v in values[i]]) if wanted.get(m) else None for i, m in enumerate(MARGINS)]
    targets = [t if t is None else t / (t.sum() or 1.0) for t in targets]
    named = [i for i, t in enumerate(targets) if t is not None]
    flat = tokens**FLATTEN
    if named:
        flat = rake(flat, [codes[i] for i in named], [targets[i] for i in named])[0]
    flat = flat / (flat.sum() or 1.0)
    targets = [np.bincount(c, flat, len(v)) if t is None else t for c, v, t in zip(codes, values, targets, strict=True)]
    bound = min([1.0, *(float((np.bincount(c, tokens)[t > 0] / tokens.sum() / t[t > 0]).min(initial=1.0)) for c, t in zip(codes, targets, strict=True))])
    present = tokens / tokens.sum()

    def raked(k: float | None) -> tuple[np.ndarray, float, float]:
        w, miss = rake(tokens, codes, targets, k)
        return w, miss, float((w / present).max())

    w, k, miss = _search(raked, keep, bound)
    p = np.minimum(1, k * w / present)
    return spark.createDataFrame([(*r[:3], float(x), float(k), float(miss)) for r, x in zip(rows, p, strict=True)], kind)


def mix(docs: DataFrame, wanted: dict[str, dict[str, float]] | None = None, keep: float = KEEP, topics: int = TOPICS, seed: int = 17, text: str = "text", key: str = "doc_id", max_local: int = MAX_LOCAL) -> DataFrame:
    """docs plus topic, n_tokens, probability and kept.

    wanted: target shares by margin and value, for example {"lang": {"en": 0.5, "de": 0.5}}; values that aren't named get none. Margins that aren't
    named aim at those of the cells' tokens to the power FLATTEN, raked to the named margins; so there is always a table with all of them. keep: the share of all tokens to keep; less is kept where the targets can't be met otherwise.
    Null sources or languages count as "". A row without words has probability 0 and isn't kept. Rows with
    equal key and text get the same answer; null keys are hashed like any other. Columns of docs with the names of results are replaced. An empty table gives an empty result.
    """
    rows = with_topics(docs.drop("probability", "kept"), fit_topics(docs, topics, text=text, key=key), text)
    inner = dict(zip((*MARGINS, "p"), fresh(rows, "_source", "_lang", "_topic", "_p"), strict=True))
    value = {m: F.coalesce(F.col(m).cast("string"), F.lit("")) for m in MARGINS}
    cells = rows.groupBy(*[value[m].alias(m) for m in MARGINS]).agg(F.sum("n_tokens").alias("tokens"))
    found = stored(calibrate(cells, wanted, keep, max_local).select(*[F.col(m).alias(inner[m]) for m in MARGINS], F.col("probability").alias(inner["p"])))
    small = found.count() <= max_local
    met = rows.join(F.broadcast(found) if small else found, [F.col(inner[m]) == value[m] for m in MARGINS], "left")
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(-1)), F.xxhash64(text), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    met = met.withColumn("probability", F.coalesce(F.col(inner["p"]), F.lit(0.0))).drop(*inner.values())
    return met.withColumn("kept", draw < F.col("probability"))
