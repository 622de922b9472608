"""Connected components of a graph, which may be too large for one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpoint, on_driver

#: Edges that the driver takes at once; more are joined as tables.
FEW_EDGES = 250_000


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, sorted, and of each the smallest node that it reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        while (further := new[new]).tobytes() != new.tobytes():
            new = further
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each node of edges reaches.

    A few edges go to the driver. More take alternating large-star and small-star steps (each hangs a node's neighbours under the smallest one
    around it) until the edges stay the same: a number of rounds in the logarithm of the longest path. The edges of a
    round are as many as before at most; each is written to the checkpoint folder.
    """
    pairs, before = checkpoint(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v")), None
    if (table := on_driver(pairs, FEW_EDGES)) is not None:
        nodes, roots = components_of(table["u"].to_numpy(), table["v"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "component": roots}))
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = checkpoint(small)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
