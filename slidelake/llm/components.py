"""Connected components: tasks contract the edges they hold, then alternating large-star and small-star steps. Few rounds, no
neighbour list in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task contracts at once.
MOST_HELD = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b) edges. Only each node's smallest neighbour is gathered; the edges are then joined with it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where(F.col("b") < F.col("a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("u"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): each node of the edges but the smallest of its group, with that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        ri, rj = root[i], root[j]
        apart = ri != rj
        i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
        np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
        while ((up := root[root]) != root).any():
            root = up
    linked = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[linked], nodes[root[linked]]


def contracted(edges: DataFrame, most_held: int = MOST_HELD) -> DataFrame:
    """(a, b), a > b: edges that lead as far as the (a, b) given, one per node, task and most_held edges at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[pa.RecordBatch] = []

        def settle() -> None:
            nonlocal a, b
            a, b = rooted(*(np.concatenate([own, *(x.column(c).to_numpy() for x in held)]) for c, own in enumerate((a, b))))
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) > most_held:
                settle()
                if len(a) > most_held:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a, b = a[:0], b[:0]
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def settled(edges: DataFrame) -> bool:
    """Whether every node of the distinct (a, b) edges, a > b, has one root, which is nobody's node itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("n")), F.struct(F.col("b").alias("node"), F.lit(0).alias("n")))).alias("e")).select("e.*")
    # A root sums to 0 however often it is named; a node that has one root and is none sums to 1 and is named once.
    odd = ends.groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).where("n > 0 and c > 1")
    return odd.agg(F.count(F.lit(1)).alias("c")).first().c == 0


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root): each node of the long (a, b) edges with the smallest node that it reaches. Loops are ignored.

    Where a task holds all of a group's edges, as with few edges, its contraction settles the group and no round is needed.
    """
    edges = cut(contracted(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()).distinct())
    for _ in range(most_rounds):
        if settled(edges):
            break
        edges = cut(contracted(_star(_star(edges, True), False)).distinct())
    else:
        raise RuntimeError("components have not settled")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
