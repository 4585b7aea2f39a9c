"""Connected components of a distributed link table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolith.llm.common import stored


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one partition, reduced to (node, smallest node of its local component). Bounded by the partition's nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for part in parts:
        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [(x, r) for x in list(parent) if (r := find(x)) != x]
    for i in range(0, len(nodes), 100_000):
        yield pd.DataFrame(nodes[i : i + 100_000], columns=["a", "b"])


def _sum_up(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in links; component: the smallest node that it reaches.

    Each task first reduces its links to a forest. Then large-star and small-star steps alternate until
    nothing changes (about log of the diameter); each round is written to the shared folder, so
    lineage stays short. Links with a null end are ignored; self-links and repeats do no harm.
    """
    e = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = stored(e.mapInPandas(_forest, "a long, b long"))  # a > b
    before = _sum_up(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a > b").distinct()
        e = stored(small)
        after = _sum_up(e)
        if after == before:
            break
        before = after
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
