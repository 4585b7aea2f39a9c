"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

An inner product becomes a distance when every vector x gets one more component sqrt(M - |x|^2), M the largest squared norm, and the
query a zero: |q - x|^2 = |q|^2 + M - 2 q.x. Highest score first is then nearest first, and a window of scores is an annulus
around the query. A tree keeps, for each child of a node, the range of distances to the node's vantage point, so a child that can't
reach into the annulus is left out, and the others are entered in the order of their least distance.

A routing tree, fitted on a bounded sample, deals all vectors into leaves; leaves are cut into shards of bounded size with a tree each. A
query visits the shards of those leaves that its bounds can't exclude.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from genolith.llm.common import bound_batches, stored

#: The routing tree is fitted on SAMPLE vectors at most and has at most LEAVES leaves, each for about SHARD vectors; a shard's tree has
#: buckets of BUCKET vectors; QUERIES queries meet a shard at a time.
SAMPLE, LEAVES, SHARD, BUCKET, QUERIES = 16_384, 1_024, 4_096, 256, 256


class Tree:
    """A vantage-point tree over integer vectors. x: the rows in the tree's order; order: which rows they were."""

    FIELDS = ("x", "order", "nodes", "ranges")

    def __init__(self, x: np.ndarray, order: np.ndarray, nodes: np.ndarray, ranges: np.ndarray):
        self.x, self.order, self.nodes, self.ranges = x, order, nodes, ranges
        self.each, self.spans = nodes.tolist(), ranges.tolist()
        norms = (x.astype(float) ** 2).sum(axis=1)
        self.most = float(norms.max()) if len(x) else 0.0
        self.floats = x.astype(float)

    @classmethod
    def build(cls, x: np.ndarray, bucket: int) -> Tree:
        """x: int64 rows. A node: place of its vantage point in the order, first and last place below it, children (-1: a bucket)."""
        f = x.astype(float)
        norms = (f * f).sum(axis=1)
        extra = np.sqrt(np.maximum(norms.max() - norms, 0)) if len(x) else norms
        order = np.arange(len(x))
        nodes, ranges, todo = [], [], [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][3 + side] = me
            nodes.append([lo, lo, hi, -1, -1])
            ranges.append([0.0] * 4)
            if hi - lo <= bucket:
                continue
            part = order[lo:hi]
            far = (f[part] @ f[part[0]]) + extra[part] * extra[part[0]]  # the vantage point: the one farthest from any of them
            top = int(np.argmin(far - norms[part] / 2))
            part[[0, top]] = part[[top, 0]]
            v, rest = part[0], part[1:]
            d = np.sqrt(np.maximum(((f[rest] - f[v]) ** 2).sum(axis=1) + (extra[rest] - extra[v]) ** 2, 0))
            by = np.argsort(d, kind="stable")
            order[lo + 1 : hi], d = rest[by], d[by]
            half = len(d) // 2
            ranges[me] = [d[0], d[half - 1], d[half], d[-1]]
            todo += [(lo + 1 + half, hi, me, 1), (lo + 1, lo + 1 + half, me, 0)]
        return cls(x[order], order, np.array(nodes, np.int64).reshape(-1, 5), np.array(ranges, float).reshape(-1, 4))

    def save(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.FIELDS}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple[Tree, dict[str, np.ndarray]]:
        z = np.load(io.BytesIO(data))
        return cls(*(z[n] for n in cls.FIELDS)), {n: z[n] for n in z.files if n not in cls.FIELDS}

    def nearest_first(self, q: np.ndarray, ids: np.ndarray, starts: np.ndarray, keep: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
        """score, id of the kept rows with low <= score <= high, highest score first, ties by smaller id; lazily.

        ids[starts[r]:starts[r + 1]] are the ids of row r in the tree's order (a row may stand for several), keep says which of its rows count.
        """
        if not len(self.x):
            return
        f = q.astype(float)
        norm = float(f @ f)
        c = norm + self.most  # squared distance plus twice the score
        slack = 1e-9 * c + 1e-6
        exact = math.sqrt(norm * self.most) < 1 << 52  # then a score and all sums on the way to it are whole numbers that doubles hold
        x, y = (self.floats, f) if exact else (self.x, q)
        heap: list[tuple] = [(-math.inf, 0, 0, 0.0, math.inf)]

        def offer(lo: int, hi: int) -> None:
            """The ids of a bucket wait in order behind its first."""
            scores = x[lo:hi] @ y
            some = np.flatnonzero(keep[lo:hi] & (scores >= low) & (scores <= high))
            if not len(some):
                return
            first, size = starts[lo + some], starts[lo + some + 1] - starts[lo + some]
            if size.max() > 1:
                who = ids[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            else:
                who = ids[first]
            s = np.repeat(scores[some], size)
            by = np.lexsort((who, -s))
            advance(zip(s[by].tolist(), who[by].tolist(), strict=True))

        def advance(rest: Iterator[tuple[float, int]]) -> None:
            for s, i in rest:
                heapq.heappush(heap, (-s, 1, i, id(rest), rest))
                return

        while heap:
            top = heapq.heappop(heap)
            if top[1]:
                yield int(-top[0]), top[2]
                advance(top[4])
                continue
            _, _, node, near, far = top
            place, lo, hi, *children = self.each[node]
            if children[0] < 0:
                offer(lo, hi)
                continue
            score = float(x[place] @ y)
            if keep[place] and low <= score <= high:
                offer(place, place + 1)
            d = math.sqrt(max(c - 2.0 * score, 0.0))
            a, b, u, v = self.spans[node]
            for child, least, most in ((children[0], a, b), (children[1], u, v)):
                n, w = max(near, d - most, least - d), min(far, d + most)
                if (c - n * n) / 2 + slack >= low and (w == math.inf or (c - w * w) / 2 - slack <= high):
                    heapq.heappush(heap, (-((c - n * n) / 2 + slack), 0, child, n, w))


#: The least 64-bit number: no score is below it.
LEAST = -(1 << 63)


class Router:
    """Vantage points of the routing tree for vectors of one length, and per leaf the range of distances to each point above it."""

    def __init__(self, sample: np.ndarray, most: float, leaves: int):
        self.most, self.points, self.radius, self.children, self.paths = most, [], [], [], []
        todo, count = [(np.arange(len(sample)), (), -1, 0)], 1
        full = self.augmented(sample)
        rng = np.random.default_rng(7)
        while todo:
            rows, path, parent, side = todo.pop(0)
            leaf = count >= leaves or len(rows) < 4
            if not leaf:
                v = full[rows[rng.integers(len(rows))]]
                d = np.sqrt(((full[rows] - v) ** 2).sum(axis=1))
                radius = float(np.median(d))
                leaf = not (d > radius).any() or not (d <= radius).any()
            if leaf:
                self.paths.append(path)
                ref = -len(self.paths)
            else:
                ref, count = len(self.points), count + 1
                self.points.append(v)
                self.radius.append(radius)
                self.children.append([0, 0])
                todo += [(rows[d <= radius], (*path, ref), ref, 0), (rows[d > radius], (*path, ref), ref, 1)]
            if parent >= 0:
                self.children[parent][side] = ref
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def augmented(self, x: np.ndarray) -> np.ndarray:
        f = x.astype(float)
        return np.column_stack((f, np.sqrt(np.maximum(self.most - (f * f).sum(axis=1), 0))))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distances to the points above it (as many as its path is long, then NaN)."""
        full, at = self.augmented(x), np.full(len(x), 0 if self.points else -1)
        found = np.full((len(x), max(map(len, self.paths), default=0)), np.nan)
        for depth in range(found.shape[1]):
            for node in np.unique(at[at >= 0]).tolist():
                rows = np.flatnonzero(at == node)
                d = np.sqrt(((full[rows] - self.points[node]) ** 2).sum(axis=1))
                found[rows, depth] = d
                at[rows] = np.where(d > self.radius[node], self.children[node][1], self.children[node][0])
        return -at - 1, found

    def reach(self, q: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Leaves with rows, and bounds of the scores that their rows can have with q."""
        f = np.append(q.astype(float), 0.0)
        c = float(f @ f) + self.most
        d = np.sqrt(((np.array(self.points) - f) ** 2).sum(axis=1)) if self.points else np.zeros(0)
        leaves, lows, highs = sorted(self.ranges), [], []
        for leaf in leaves:
            least, most = self.ranges[leaf]
            up = d[list(self.paths[leaf])] if self.paths[leaf] else np.zeros(0)
            near = max(0.0, *(up - most), *(least - up)) if len(up) else 0.0
            far = float((up + most).min()) if len(up) else math.inf
            highs.append((c - near * near) / 2 + 1e-9 * c + 1e-6)
            lows.append((c - far * far) / 2 - 1e-9 * c - 1e-6 if far < math.inf else -math.inf)
        return leaves, np.array(lows), np.array(highs)


def _shard(bucket: int) -> Callable[[pa.Table], pa.Table]:
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rid").combine_chunks()
        x = rows["vec"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        tree = Tree.build(x, bucket)
        lists = rows["ids"].combine_chunks().take(pa.array(tree.order))
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        return pa.table({"dim": rows["dim"][:1], "leaf": rows["leaf"][:1], "salt": rows["salt"][:1], "tree": pa.array([tree.save(ids=lists.flatten().to_numpy(), starts=starts, labels=rows["label"].to_numpy()[tree.order])], pa.binary())})

    return build


def hard_negatives(
    rows: DataFrame, anchor: Column, vector: str = "vec", label: str = "label", key: str = "vec_id", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    sample: int = SAMPLE, leaves: int = LEAVES, shard: int = SHARD, bucket: int = BUCKET, block: int = QUERIES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor row and each of its first `positives` other rows
    of the same label, the first `negatives` rows of other labels whose score lies between `low` and `high` percent of the positive's.

    vector: integers; a score is the inner product, which must fit 64 bits; higher scores come first, ties by the smaller key. anchor: a condition on the rows.
    Rows with a null key, label or vector, an empty vector or a null component take no part; vectors of different lengths never meet. Of rows that
    repeat a key, the one with the smallest label and vector counts. An empty table gives an empty result; other columns are ignored.

    Scale: equal vectors of one label become one row with the few smallest keys that any list can need, so a group of copies
    costs one row; equal anchors are one query. A leaf is cut into shards by count and its queries into blocks, and a pair of both
    is one row of work. First a query visits its own leaf, which says what score each of its windows needs, then the leaves that can reach that.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    most_ids = max(positives + 1, negatives)
    v = F.col("vec")
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()))
    base = stored(base.groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("r")).select("id", "r.*"))
    same = Window.partitionBy("vec", "label").orderBy("id")
    few = base.withColumn("n", F.row_number().over(same)).where(F.col("n") <= most_ids)
    reps = few.groupBy("vec", "label").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec"))
    reps = stored(reps.withColumn("norm", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))

    sizes = {r.dim: (r.n, r.most) for r in reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).collect()}  # one row per length of vectors
    total = sum(n for n, _ in sizes.values())
    seen: dict[int, list] = {}
    for r in reps.orderBy(F.xxhash64("rid"), "rid").limit(sample).select("vec").collect():
        seen.setdefault(len(r.vec), []).append(r.vec)
    routers = {dim: Router(np.array(seen.get(dim, []), np.int64).reshape(-1, dim), most, max(1, min(leaves * n // total, -(-n // shard)))) for dim, (n, most) in sizes.items()}
    given = spark.sparkContext.broadcast(routers)  # at most SAMPLE vantage points

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(4).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                leaf, above = given.value[dim].place(part.column(0).flatten().to_numpy().reshape(-1, dim))
                yield pa.record_batch([*part.columns, pa.array(leaf, pa.int32()), pa.array([d[~np.isnan(d)] for d in above], pa.list_(pa.float64()))], [*b.schema.names, "leaf", "above"])

    placed = stored(reps.select("vec", "label", "ids", "rid", "dim").mapInArrow(place, "vec array<long>, label long, ids array<long>, rid long, dim int, leaf int, above array<double>"))
    above = placed.select("dim", "leaf", F.posexplode_outer("above").alias("at", "d")).groupBy("dim", "leaf", "at").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    for r in above.orderBy("dim", "leaf", "at").collect():  # a row for each leaf and point above it
        least, most = routers[r.dim].ranges.setdefault(r.leaf, ([], []))
        if r.at is not None:
            least.append(r.least)
            most.append(r.most)
    for x in routers.values():
        x.ranges = {leaf: (np.array(a), np.array(b)) for leaf, (a, b) in x.ranges.items()}
    known = spark.sparkContext.broadcast(routers)
    salts = placed.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("salts"))
    salts = spark.createDataFrame([tuple(r) for r in salts.collect()], "dim int, leaf int, salts int")  # at most LEAVES rows
    dealt = placed.join(F.broadcast(salts), ["dim", "leaf"]).withColumn("salt", F.pmod(F.xxhash64("rid"), "salts").cast("int"))
    index = stored(dealt.select("dim", "leaf", "salt", "rid", "label", "vec", "ids").groupBy("dim", "leaf", "salt").applyInArrow(_shard(bucket), "dim int, leaf int, salt int, tree binary"))

    anchors = base.where("anchor")
    queries = stored(anchors.groupBy("vec", "label").agg(F.count(F.lit(1)).alias("n")).select("vec", "label", F.monotonically_increasing_id().alias("qid")))

    def visits(choose: Callable) -> Callable:
        """Rows of a query for each leaf to visit; choose: router, vector, the windows -> leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, x, lab, lows, highs = (b.column(i).to_pylist() for i in range(5))
                leaf = [choose(known.value[len(y)], np.array(y, np.int64), lo, hi) for y, lo, hi in zip(x, lows, highs, strict=True)]
                at = np.repeat(np.arange(len(q)), [len(z) for z in leaf])
                part = b.take(pa.array(at))
                yield pa.record_batch([pa.array([len(x[i]) for i in at.tolist()], pa.int32()), pa.array([z for y in leaf for z in y], pa.int32()), *part.columns], ["dim", "leaf", *b.schema.names])

        return run

    def met(asked: DataFrame, choose: Callable, same_label: bool, k: int) -> DataFrame:
        """qid, w, score, id: the first k rows of each shard in each window of each query; asked: qid, vec, label, lows, highs."""
        each = stored(asked.select("qid", "vec", "label", "lows", "highs").mapInArrow(visits(choose), "dim int, leaf int, qid long, vec array<long>, label long, lows array<long>, highs array<long>"))
        counts = each.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        parts = each.join(F.broadcast(counts.join(F.broadcast(salts), ["dim", "leaf"])), ["dim", "leaf"]).withColumn("block", F.pmod(F.xxhash64("qid"), "blocks"))  # at most LEAVES rows
        asks = parts.groupBy("dim", "leaf", "salts", "block").agg(F.collect_list(F.struct("qid", "vec", "label", "lows", "highs")).alias("asks"))  # about `block` of them
        work = asks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(index, ["dim", "leaf", "salt"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    tree, more = Tree.load(b.column(1)[i].as_py())
                    out: list[tuple[int, int, int, int]] = []
                    for ask in b.column(0)[i].as_py():
                        spans = list(zip(ask["lows"], ask["highs"], strict=True))
                        left = dict.fromkeys(range(len(spans)), k)
                        keep = more["labels"] == ask["label"] if same_label else more["labels"] != ask["label"]
                        if not spans or not keep.any():
                            continue
                        for score, row in tree.nearest_first(np.array(ask["vec"], np.int64), more["ids"], more["starts"], keep, min(ask["lows"]), max(ask["highs"])):
                            for w in [w for w in left if spans[w][0] <= score <= spans[w][1]]:
                                out.append((ask["qid"], w, score, row))
                                left[w] -= 1
                            left = {w: n for w, n in left.items() if n and score >= spans[w][0]}
                            if not left:
                                break
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], [], []))], ["qid", "w", "score", "id"])

        return work.select("asks", "tree").mapInArrow(run, "qid long, w long, score long, id long")

    def first(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("qid", "w").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    least, greatest = F.lit(LEAST).cast("long"), F.lit((1 << 63) - 1).cast("long")
    open_ = queries.withColumns({"lows": F.array(least), "highs": F.array(greatest)})
    own = lambda r, x, lo, hi: r.place(x[None])[0].tolist()

    def rest(r: Router, x: np.ndarray, lo: list[int], hi: list[int]) -> list[int]:
        """Leaves other than the query's own that can have a row in one of its windows."""
        names, lows, highs = r.reach(x)
        mine = own(r, x, lo, hi)[0]
        return [n for n, a, b in zip(names, lows, highs, strict=True) if n != mine and any(c <= d and b >= c and a <= d for c, d in zip(lo, hi, strict=True))]

    def nearest(asked: DataFrame, same_label: bool, k: int) -> DataFrame:
        """qid, w, score, id, rank: the first k rows of all in each window. What the query's own leaf has k of is the least that the others must reach."""
        home = stored(met(asked, own, same_label, k))
        reached = first(home, k).where(F.col("rank") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("need"))  # a row for each window
        raised = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("need", i.cast("long")), x)))
        away = met(asked.join(reached, "qid", "left").withColumn("lows", raised), rest, same_label, k)
        return first(home.unionByName(away), k)

    best = stored(nearest(open_, True, positives + 1).select("qid", "score", "id"))

    scores = best.select("qid", "score").distinct().groupBy("qid").agg(F.sort_array(F.collect_list("score")).alias("scores"))  # at most positives + 1
    s = F.col("scores")
    # integer bounds: the least and greatest n with low * score <= 100 * n <= high * score
    bound = {"lows": F.transform(s, lambda x: -F.floor(-(x * low).cast("decimal(38,0)") / 100).cast("long")), "highs": F.transform(s, lambda x: F.floor((x * high).cast("decimal(38,0)") / 100).cast("long"))}
    wanted = queries.join(scores, "qid").withColumns(bound)

    mined = nearest(wanted, False, negatives)
    hard = mined.join(scores, "qid").select("qid", F.element_at("scores", (F.col("w") + 1).cast("int")).alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("best"))  # at most positives + 1
    each = anchors.join(queries.join(lists, "qid"), ["vec", "label"]).select(F.col("id").alias("anchor_id"), "qid", F.explode(F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, positives)).alias("p"))
    pairs = each.select("anchor_id", "qid", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score"))
    return pairs.join(hard, ["qid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
