"""Connected components by alternating star contraction, every round a table in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tidy


def _smallest(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of its neighbourhood."""
    sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = sym.join(_smallest(sym), "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges point from the larger node."""
    least = _smallest(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest node of its component, node) with the components of the edges u, v."""
    nodes, ends = np.unique(np.r_[u, v], return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    least = np.arange(len(nodes))
    while (least[a] != least[b]).any():
        low, x, y = np.minimum(least[a], least[b]), least[a], least[b]
        for at in (x, y, a, b):
            np.minimum.at(least, at, low)
        while (least[least] != least).any():
            least = least[least]
    far = least != np.arange(len(nodes))
    return nodes[least[far]], nodes[far]


def contracted(edges: DataFrame) -> DataFrame:
    """u, v: the edges of every batch as stars, which have the same components and are fewer where a dense group is spanned many times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(*(c.to_numpy() for c in batch.columns))], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(tidy(run), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of the component) for every node of edges (u, v longs); roots are not listed.

    Ends when a round changes nothing: then every edge leads from a node to its root. An empty table gives none.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
    now, before = materialize(pairs, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        after = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now, before = after, mark
