"""Connected components of links between long ids, as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.scratch import lean
from ledgerlens.session import materialize


#: Links that a task joins up by itself, about; so many fill some 50 MB.
LOCAL_LINKS = 250_000


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: (u, v), v the smallest node that they reach from u, u > v."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for x, y in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    yield from pa.Table.from_arrays([pa.array(np.array(nodes, np.int64)), pa.array(np.array([find(x) for x in nodes], np.int64))],
                                    names=["u", "v"]).to_batches(max_chunksize=50_000)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that links reach; nodes without a link are left out.

    The links are first joined up inside partitions of about ``LOCAL_LINKS``,
    which leaves one link a node and partition; if these are several, stars
    follow: each round moves a node's larger neighbours, then its smaller ones,
    to the smallest of them all, until the links are stars around the roots.
    Every round is written; its minima are summed up before they are shuffled
    and joined from a written table, so a hub's links can be split.
    """
    both = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v")
    parts = -(-both.count() // LOCAL_LINKS)
    # a written table's partitions, or equal shares if these would be too large
    dealt = both.coalesce(1) if parts <= 1 else both.repartition(parts)
    edges = materialize(dealt.mapInArrow(lean(_local_roots), "u long, v long"), "edges")
    seen = None
    while parts > 1:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        # larger neighbours go to the smallest neighbour (or the node itself)
        way = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(way.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(way.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # the node and its smaller neighbours go to the smallest of these
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
