"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docbatch.plans.staging import released, staged, staged_with

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge: the component is the smallest node reachable.

    Each round points nodes at the smallest node of their neighbourhood, in a number of rounds that
    follows the logarithm of the component's size. Neighbourhoods are never gathered: minima come from
    aggregation and return by joins of both sides' shuffles, as files of edges are far smaller than their rows. Each round is one written table; a round that would change no edge, by
    an exact count, ends the work, and the tables of earlier rounds are deleted. Raises if the rounds do not settle.
    """
    now, seen = staged_with(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if not seen["n"]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = Observation()
        # edges to nodes that are no root of both their ends, that is, all that this round moves
        near = both.join(least.hint("merge"), "u").observe(moved, F.count_if(F.col("m") != F.least("u", "v")).alias("n"))
        large = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # large points every node only to smaller ones, so what remains is the small star
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        before, now = now, staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        released(before)
        if not moved.get["n"]:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one connected with it by the edges (a, b), all at once: roots hook onto smaller roots, then paths are halved."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label
