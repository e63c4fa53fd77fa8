"""Connected components of a graph of integer nodes, with the same join-and-group rounds for any shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each is connected to."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars, in bounded pieces."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(h[0]) for h in held) > 2_000_000:
            held = [_stars(held)]
            if len(held[0][0]) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], ["a", "b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _stars(held)], ["a", "b"])


def _stars(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    nodes, root = forest(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
    away = nodes != root
    return nodes[away], root[away]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, not null) -> ``node``, ``component`` (the smallest node connected to it).

    Each round links every node's larger neighbours to its smallest one (large star), then its
    smaller neighbours to the smallest (small star), until all are stars; that takes a number of rounds that
    grows with the logarithm of the longest path.  Partitions first reduce their own edges to stars.  Each round is cut
    off with a checkpoint.
    """
    edges = materialize(edges.select("a", "b").where("a <> b"))  # a stage of its own: tasks need one Python worker at a time
    edges = materialize(edges.mapInArrow(_local_forest, "a long, b long").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct())  # a > b
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("b").alias("n"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(least.select("a", F.col("m").alias("b")).unionByName(small).distinct())
        # done when every node has one smaller neighbour and that one has none
        tail = new.groupBy("a").count().where("count > 1").limit(1).count() or new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        edges = new
        if not tail:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
