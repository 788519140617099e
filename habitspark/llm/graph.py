"""Connected components on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitspark.plans.scale import stored

BLOCK_EDGES = 1_000_000  # a task contracts at most about so many edges


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one block as (node, smallest node it is connected with in the block)."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not ends:
        return
    u, v = (np.concatenate([e[i] for e in ends]) for i in range(2))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())


def components(links: DataFrame) -> DataFrame:
    """Smallest node of each component: columns ``node`` and ``root``, for nodes with a link.

    ``links`` has columns ``a`` and ``b``. Blocks of bounded size are contracted first. If there is
    more than one, large-star and small-star steps alternate until nothing changes; every
    step is an aggregate and a join, so a hub with many links is combined before the
    shuffle and split by adaptive joins after it.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    blocks = -(-edges.count() // BLOCK_EDGES)
    dealt = edges.coalesce(1) if blocks <= 1 else edges.repartition(blocks)
    edges = stored(dealt.mapInArrow(_contracted, "u long, v long"))
    before = _state(edges) if blocks > 1 else (0,)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
