"""Poisson regression trees for locus rates, grown for all components of a model at once, and their exact Shapley values.

Rows stay in Spark as bytes of bin numbers. A pass sums, per task, the weights of each wanted node by (feature, bin) and Spark adds the tasks' sums; the
driver holds nothing but those sums. A tree grows by its best leaf first. What a leaf's children will need is asked for all open leaves in the same pass,
one child each (the other is the difference), so a tree costs about as many passes as it is deep, however many leaves and components there are.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bin of a missing value, and the most cuts a feature may have.
MISSING, MOST_CUTS = 255, 254


@dataclass
class Tree:
    """Nodes in arrays: feature (-1: a leaf), cut (values up to it go left), where missing values go, children, value and cover (the weight of the rows that came by)."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def of(cls, nodes: Sequence[Sequence]) -> Tree:
        kinds = (np.int64, float, bool, np.int64, np.int64, float, float)
        return cls(*(np.array(column, kind) for column, kind in zip(zip(*nodes, strict=True), kinds, strict=True)))

    def leaves(self, x: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The leaf of each row; x holds what `cut` is compared with."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[at]
            if (f < 0).all():
                return at
            f = np.maximum(f, 0)
            go = np.where(missing[rows, f], self.missing_left[at], x[rows, f] <= self.cut[at])
            at = np.where(self.feature[at] < 0, at, np.where(go, self.left[at], self.right[at]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x, np.isnan(x))]

    def paths(self) -> Iterator[tuple[float, list[tuple[int, float, bool, bool, float]]]]:
        """Of each leaf its value and the steps to it: feature, cut, missing_left, whether left, share of the cover that goes there."""
        todo: list[tuple[int, list]] = [(0, [])]
        while todo:
            n, path = todo.pop()
            if self.feature[n] < 0:
                yield float(self.value[n]), path
                continue
            for child, is_left in ((self.left[n], True), (self.right[n], False)):
                share = self.cover[child] / self.cover[n] if self.cover[n] else 0.0
                todo.append((child, [*path, (int(self.feature[n]), float(self.cut[n]), bool(self.missing_left[n]), is_left, float(share))]))

    def plain(self) -> list:
        return [[v.item() for v in row] for row in zip(self.feature, self.cut, self.missing_left, self.left, self.right, self.value, self.cover, strict=True)]


@dataclass
class TreeRate:
    """Locus effect: the sum of trees over the named features."""

    names: list[str]
    trees: list[Tree] = field(default_factory=list)

    def features(self) -> list[str]:
        return list(self.names)

    def log_rate(self) -> Column:
        return F.get(log_rates([self]), 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def to_json(self) -> str:
        return json.dumps({"names": self.names, "trees": [t.plain() for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> TreeRate:
        found = json.loads(text)
        return cls(found["names"], [Tree.of(t) for t in found["trees"]])


def _matrix(columns: pd.DataFrame) -> np.ndarray:
    return columns.to_numpy(float, na_value=np.nan)


def log_rates(models: Sequence[TreeRate]) -> Column:
    """ARRAY of each model's log rate, for rows with the features' columns."""
    names = models[0].names
    if not any(m.trees for m in models):
        return F.array(*[F.lit(0.0)] * len(models))

    @F.pandas_udf("array<double>")
    def run(x: pd.DataFrame) -> pd.Series:
        m = _matrix(x)
        return pd.Series(list(np.column_stack([t.predict(m) for t in models])))

    return run(F.struct(*[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)]))


def quantile_cuts(rows: DataFrame, names: Sequence[str], bins: int = MOST_CUTS + 1) -> list[list[float]]:
    """Bounds of about equally full bins of each feature, from one pass of approximate quantiles."""
    at = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    found = rows.agg(*[F.percentile_approx(F.col(n).cast("double"), at, 10_000).alias(f"x{i}") for i, n in enumerate(names)]).first()
    return [sorted({c for c in q or [] if math.isfinite(c)}) for q in found]


def binned(rows: DataFrame, names: Sequence[str], cuts: Sequence[Sequence[float]], y: str = "y", mu: str = "mu", valid: Column | None = None) -> DataFrame:
    """(bins BINARY, y ARRAY, mu ARRAY, valid): a byte for each feature, the number of cuts below its value; missing values have a bin of their own."""
    bounds = [np.array(c, float) for c in cuts]
    if any(len(b) > MOST_CUTS for b in bounds):
        raise ValueError(f"a feature has more than {MOST_CUTS} cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, len(bounds)), np.uint8)
            for i, cut in enumerate(bounds):
                x = b.column(i).to_numpy(zero_copy_only=False).astype(float)
                out[:, i] = np.where(np.isnan(x), MISSING, np.searchsorted(cut, x, "left"))
            yield pa.record_batch([pa.array([r.tobytes() for r in out], pa.binary()), *b.columns[len(bounds) :]], ["bins", "y", "mu", "valid"])

    chosen = rows.select(*[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)], F.col(y).cast("array<double>").alias("y"), F.col(mu).cast("array<double>").alias("mu"), (valid if valid is not None else F.lit(False)).alias("valid"))
    return chosen.mapInArrow(run, "bins binary, y array<double>, mu array<double>, valid boolean")


@dataclass
class Settings:
    """How trees grow. groups: sets of features (positions) that may meet on a path; none: all may."""

    trees: int = 25
    shrink: float = 0.1
    leaves: int = 31
    depth: int = 5
    least_rows: int = 30
    l2: float = 1.0
    max_features: float = 1.0
    patience: int = 1
    groups: Sequence[Sequence[int]] | None = None
    seed: int = 0


class _Grower:
    """The trees of one component while they grow. Sums of a node: array (feature, bin, 3) of y, mu and rows."""

    def __init__(self, k: int, cuts: Sequence[Sequence[float]], s: Settings):
        self.k, self.cuts, self.s = k, cuts, s
        self.done: list[list[list]] = []
        self.losses: list[float] = []
        self.over = s.trees < 1
        self.start()

    def start(self) -> None:
        self.nodes: list[list] = [[-1, 0, True, -1, -1, 0.0, 0.0]]  # cut: a bin here
        self.depth, self.used, self.sums, self.open, self.child = [0], [frozenset()], {}, [], {}
        self.rng, self.rooted = np.random.default_rng([self.s.seed, self.k, len(self.done)]), False

    def wants(self) -> list[tuple]:
        """What the next pass has to sum: ("root",) or a leaf with a split, for the rows that go left."""
        if self.over:
            return []
        if not self.rooted:
            return [("root",)]
        room = self.s.leaves - sum(n[0] < 0 for n in self.nodes)
        best = heapq.nsmallest(room, [o for o in self.open if o[1] not in self.child and self.depth[o[1]] + 1 < self.s.depth])
        return [("left", leaf, *split) for _, leaf, split in best]

    def give(self, want: tuple, sums: np.ndarray) -> None:
        if want[0] == "root":
            y, mu = sums[0, :, 0].sum(), sums[0, :, 1].sum()
            if not y > 0 or not mu > 0:
                self.over = True
                return
            self.bias, self.rooted = y / mu, True
            self.sums[0] = sums
            self.nodes[0][6] = mu
            self.offer(0)
        else:
            self.child[want[1]] = sums

    def split(self, n: int) -> tuple[float, tuple] | None:
        """The best split of a leaf: gain, (feature, bin, missing_left)."""
        s, best = self.sums[n], None
        allowed = range(len(self.cuts)) if self.s.groups is None else sorted({f for g in self.s.groups if self.used[n] <= set(g) for f in g})
        if self.s.max_features < 1 and len(allowed):
            allowed = sorted(self.rng.choice(allowed, max(1, round(self.s.max_features * len(allowed))), replace=False).tolist())
        for f in allowed:
            m = len(self.cuts[f])
            if not m:
                continue
            y, mu, rows = s[f].sum(axis=0)
            lost = s[f, MISSING]
            for missing_left in (True, False) if lost[2] else (True,):
                left = np.cumsum(s[f, :m], axis=0) + (lost if missing_left else 0)
                g, h, c = left[:, 0] - self.bias * left[:, 1], self.bias * left[:, 1], left[:, 2]
                tg, th = y - self.bias * mu, self.bias * mu
                gain = g**2 / (h + self.s.l2) + (tg - g) ** 2 / (th - h + self.s.l2) - tg**2 / (th + self.s.l2)
                fits = (c >= self.s.least_rows) & (rows - c >= self.s.least_rows) & (h > 1e-12) & (th - h > 1e-12)
                if fits.any():
                    gain = np.where(fits, np.round(gain, 10), -np.inf)
                    b = int(np.argmax(gain))
                    if gain[b] > 0 and (best is None or gain[b] > best[0]):
                        best = (float(gain[b]), (f, b, missing_left))
        return best

    def offer(self, n: int) -> None:
        if self.depth[n] < self.s.depth and (found := self.split(n)):
            heapq.heappush(self.open, (-found[0], n, found[1]))

    def grow(self) -> None:
        """Split the best leaves as long as their children's sums are there; the tree is done when none is left to split."""
        while self.open and sum(n[0] < 0 for n in self.nodes) < self.s.leaves:
            _, n, (f, b, missing_left) = self.open[0]
            last = self.depth[n] + 1 >= self.s.depth
            if n not in self.child and not last:
                return
            heapq.heappop(self.open)
            s = self.sums[n]
            at = [*range(b + 1), *([MISSING] if missing_left else [])]
            whole, part = s[f].sum(axis=0), s[f, at].sum(axis=0)
            ids = len(self.nodes), len(self.nodes) + 1
            self.nodes[n][:5] = [f, b, missing_left, *ids]
            sides = (None, None) if last else (self.child[n], s - self.child[n])
            for i, total, sums in zip(ids, (part, whole - part), sides, strict=True):
                h = self.bias * total[1]
                self.nodes.append([-1, 0, True, -1, -1, self.s.shrink * (total[0] - h) / (h + self.s.l2), total[1]])
                self.depth.append(self.depth[n] + 1)
                self.used.append(self.used[n] | {f})
                if sums is not None:
                    self.sums[i] = sums
                    self.offer(i)
            del self.sums[n]
        if len(self.nodes) > 1:
            self.finish()
        else:
            self.over = True  # nothing to split

    def finish(self) -> None:
        self.done.append(self.nodes)
        self.over = len(self.done) >= self.s.trees
        self.start()

    def judge(self, loss: float) -> None:
        """The validation loss of the trees so far: trees that haven't lowered it for `patience` trees are taken back, and no more grow."""
        self.losses.append(loss)
        best = int(np.argmin(np.round(self.losses, 9)))
        if len(self.losses) - 1 - best >= self.s.patience:
            self.done, self.over = self.done[:best], True


def _summed(table: DataFrame, wants: list[tuple[int, tuple]], trees: list[list[Tree]], partial: list[Tree], losses: bool, n_features: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """One pass: the sums of the wanted nodes, and for each component mu, y * log(mu) and y of the validation rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(wants), n_features, 256, 3))
        loss = np.zeros((len(trees), 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
            missing = x == MISSING
            y, mu = (np.stack(batch.column(i).to_numpy(zero_copy_only=False)) for i in (1, 2))
            valid = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            grown = {k: mu[:, k] * np.exp(sum((t.value[t.leaves(x, missing)] for t in trees[k]), np.zeros(len(x)))) for k in ({k for k, _ in wants} | (set(range(len(trees))) if losses else set()))}
            at = {k: partial[k].leaves(x, missing) for k, w in wants if w[0] != "root"}
            for i, (k, w) in enumerate(wants):
                inside = ~valid
                if w[0] != "root":
                    _, leaf, f, b, missing_left = w
                    inside = inside & (at[k] == leaf) & np.where(missing[:, f], missing_left, x[:, f] <= b)
                rows = x[inside]
                for f in range(n_features):
                    for j, weight in enumerate((y[inside, k], grown[k][inside], None)):
                        sums[i, f, :, j] += np.bincount(rows[:, f], weight, 256)
            if losses and valid.any():
                for k in range(len(trees)):
                    m, seen = grown[k][valid], y[valid, k]
                    loss[k] += m.sum(), (seen * np.log(np.maximum(m, 1e-300))).sum(), seen.sum()
        some = np.argwhere(sums[..., 2] > 0)
        values = sums[tuple(some.T)]
        some = np.concatenate((some, np.array([(-1 - k, 0, 0) for k in range(len(trees))], np.int64).reshape(-1, 3)))
        values = np.concatenate((values, loss))
        yield pa.record_batch([*(pa.array(c, pa.int32()) for c in some.T), *(pa.array(c) for c in values.T)], ["w", "f", "b", "y", "mu", "n"])

    found = table.mapInArrow(run, "w int, f int, b int, y double, mu double, n double").groupBy("w", "f", "b").agg(F.sum("y").alias("y"), F.sum("mu").alias("mu"), F.sum("n").alias("n"))
    sums, loss = {i: np.zeros((n_features, 256, 3)) for i in range(len(wants))}, {}
    for r in found.collect():  # wanted nodes x features x bins
        if r.w < 0:
            loss[-1 - r.w] = np.array([r.y, r.mu, r.n])
        else:
            sums[r.w][r.f, r.b] = r.y, r.mu, r.n
    return sums, loss


def grow(table: DataFrame, names: Sequence[str], cuts: Sequence[Sequence[float]], k: int, settings: Settings | None = None, rate: float = 1.0) -> list[list[Tree]]:
    """New trees for each of k components from a `binned` table whose mu already has what earlier trees predict.

    Poisson loss with a free intercept, refitted for every tree; rows marked valid take no part in growing and end it: a component stops when its validation loss
    hasn't fallen for `patience` trees. rate: the values of the new trees are shrunk by it. The table is read once a pass, so it should be stored.
    """
    s = settings or Settings()
    growers = [_Grower(i, cuts, s) for i in range(k)]
    while True:
        for g in growers:
            if not g.over and g.rooted:
                g.grow()
        wants = [(g.k, w) for g in growers for w in g.wants()]
        trees = [[Tree.of(t) for t in g.done] for g in growers]
        new = [g for g in growers if len(g.losses) <= len(g.done)]
        if not wants and not new:
            break
        sums, loss = _summed(table, wants, trees, [Tree.of(g.nodes) for g in growers], bool(new), len(names))
        for g in new:
            mu, logs, y = loss.get(g.k, np.zeros(3))
            if y > 0 and mu > 0:
                g.judge(y - logs - y * math.log(y / mu))  # the loss at the validation rows' own intercept
            else:
                g.losses.append(0.0)
        for i, (c, w) in enumerate(wants):
            if not growers[c].over:
                growers[c].give(w, sums[i])
        if all(g.over for g in growers) and not any(len(g.losses) <= len(g.done) for g in growers):
            break
    out = []
    for g in growers:
        kept = []
        for nodes in g.done:
            rows = [[f, cuts[f][b] if f >= 0 else 0.0, m, left, right, v * rate, c] for f, b, m, left, right, v, c in nodes]
            kept.append(Tree.of(rows))
        out.append(kept)
    return out


# Shapley values


def _meets(path: Sequence[tuple], x: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Features of a path, whether each row takes all steps of each feature, and the share of the cover that does."""
    features = sorted({f for f, *_ in path})
    ok, share = np.ones((len(x), len(features)), bool), np.ones(len(features))
    for f, cut, missing_left, is_left, part in path:
        i = features.index(f)
        with np.errstate(invalid="ignore"):
            go = np.where(np.isnan(x[:, f]), missing_left, x[:, f] <= cut)
        ok[:, i] &= go == is_left
        share[i] *= part
    return features, ok, share


def _distinct(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.packbits(ok, axis=1)
    _, first, back, counts = np.unique(codes, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return ok[first], back.ravel(), counts


def path_dependent(trees: Sequence[Tree], x: np.ndarray, n_features: int) -> np.ndarray:
    """Shapley values (rows x features) where an unknown feature goes both ways by the cover of the children.

    A leaf's part of the value of a set S is its value times, over the features on its path, whether the row takes their steps (feature in S) or
    the share of the cover that does (not in S). Rows that take the same steps have the same values, so each leaf is solved once per pattern.
    """
    out = np.zeros((len(x), n_features))
    for t in trees:
        for value, path in t.paths():
            features, ok, share = _meets(path, x)
            if not features:
                continue
            patterns, back, _ = _distinct(ok)
            u = len(features)
            weight = np.array([math.factorial(s) * math.factorial(u - s - 1) / math.factorial(u) for s in range(u)])
            phi = np.zeros((len(patterns), u))
            for j in range(u):
                poly = np.ones((len(patterns), 1))  # coefficient s: sum over sets of s others of the product
                for i in range(u):
                    if i != j:
                        a = patterns[:, i : i + 1].astype(float)
                        poly = np.pad(poly * share[i], ((0, 0), (0, 1))) + np.pad(poly * a, ((0, 0), (1, 0)))
                phi[:, j] = value * (patterns[:, j] - share[j]) * (poly @ weight)
            out[:, features] += phi[back]
    return out


def interventional(trees: Sequence[Tree], x: np.ndarray, background: np.ndarray, n_features: int) -> np.ndarray:
    """Shapley values (rows x features) where an unknown feature takes the value of a background row, averaged over these.

    At a leaf only those features matter that the row's steps and the background's steps differ in, and a pair's value depends on their numbers alone;
    both sides are grouped by the steps that they take.
    """
    out = np.zeros((len(x), n_features))
    for t in trees:
        for value, path in t.paths():
            features, ok, _ = _meets(path, x)
            if not features:
                continue
            mine, back, _ = _distinct(ok)
            theirs, _, counts = _distinct(_meets(path, background)[1])
            phi = np.zeros((len(mine), len(features)))
            for i, a in enumerate(mine):
                only_mine, only_theirs = a & ~theirs, ~a & theirs
                reached = (a | theirs).all(axis=1)
                p, q = only_mine.sum(axis=1), only_theirs.sum(axis=1)
                fact = np.array([math.factorial(n) for n in range(len(features) + 1)], float)
                plus = np.where(p > 0, fact[np.maximum(p - 1, 0)] * fact[q], 0) / fact[p + q]
                minus = np.where(q > 0, fact[p] * fact[np.maximum(q - 1, 0)], 0) / fact[p + q]
                w = counts * reached * value / len(background)
                phi[i] = (w * plus) @ only_mine - (w * minus) @ only_theirs
            out[:, features] += phi[back]
    return out


def by_subsets(trees: Sequence[Tree], row: np.ndarray, background: np.ndarray | None, n_features: int) -> np.ndarray:
    """Shapley values of one row from their definition over all subsets of features, for checks: by background rows, or by cover where there are none."""

    def expected(t: Tree, n: int, known: frozenset[int]) -> float:
        f = int(t.feature[n])
        if f < 0:
            return float(t.value[n])
        if f in known:
            go = t.missing_left[n] if np.isnan(row[f]) else row[f] <= t.cut[n]
            return expected(t, int(t.left[n] if go else t.right[n]), known)
        return sum(t.cover[c] / t.cover[n] * expected(t, int(c), known) for c in (t.left[n], t.right[n]))

    def game(known: frozenset[int]) -> float:
        if background is None:
            return sum(expected(t, 0, known) for t in trees)
        mixed = background.copy()
        mixed[:, sorted(known)] = row[sorted(known)]
        return float(np.mean(sum((t.predict(mixed) for t in trees), np.zeros(len(mixed)))))

    out, n = np.zeros(n_features), n_features
    for j in range(n):
        for size in range(n):
            for s in itertools.combinations([i for i in range(n) if i != j], size):
                out[j] += math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n) * (game(frozenset(s) | {j}) - game(frozenset(s)))
    return out


def attributions(loci: DataFrame, components: Sequence[str], models: Sequence[TreeRate], background: int = 1_000, by_cover: bool = False, key: str = "locus") -> DataFrame:
    """(locus, component, feature, value, effect): Shapley values of every feature in a component's trees, exact for any depth.

    Against the loci with the least hashes of their key (`background` of them, so at most that many rows reach the driver), or by_cover: against the shares of the training weight.
    """
    names = models[0].names
    columns = [F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)]
    some = None
    if not by_cover:
        found = loci.orderBy(F.xxhash64(key), key).limit(background).select(*columns).collect()
        some = np.array([list(r) for r in found], float).reshape(len(found), len(names))
    kind = loci.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))])
            for component, m in zip(components, models, strict=True):
                phi = path_dependent(m.trees, x, len(names)) if some is None else interventional(m.trees, x, some, len(names))
                for i, n in enumerate(names):
                    yield pa.record_batch([b.column(0), pa.array([component] * len(x)), pa.array([n] * len(x)), b.column(1 + i), pa.array(phi[:, i])], [key, "component", "feature", "value", "effect"])

    return loci.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, component string, feature string, value double, effect double")
