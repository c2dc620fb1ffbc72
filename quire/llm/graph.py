"""Connected components of graphs whose node ids are well-mixed hashes.

Up to AT_ONCE edges one task merges them; beyond that the graph is contracted round by round.
Either way gives the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import heavy_aware_join
from quire.runtime import checkpoint

#: 16 MB of edges: what one task may hold.
AT_ONCE = 1_000_000


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """(node, comp, n) from all (a, b) edges at once; a component's name is its smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    comps = np.array([root(x) for x in nodes.tolist()], np.int64)
    _, place, sizes = np.unique(comps, return_inverse=True, return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comps), pa.array(sizes[place] if len(nodes) else comps)], names=["node", "comp", "n"])


def connected(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, comp, n) for every node of the undirected (a, b) edges; n is the component's size.

    Each round maps every node to the smallest id among itself and its neighbours and contracts
    the edges accordingly.  Ids are random, so the number of edges falls by a constant factor a
    round, long chains included.  Minima are combined before they are shuffled; nodes of very many
    edges, and components of very many nodes, are joined apart.
    """
    left = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if left.count() <= at_once:
        return checkpoint(left.repartition(1).mapInArrow(_merged, "node bigint, comp bigint, n bigint"))
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("comp"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = checkpoint(both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select(F.col("a").alias("comp"), F.least("a", "low").alias("low"), "n"))
        held = to.drop("n").join(nodes.groupBy("comp").agg(F.count("*").alias("held")), "comp")
        nodes = checkpoint(heavy_aware_join(nodes, held, "comp", "held", nodes.count()).select("node", F.coalesce("low", "comp").alias("comp")))
        total = left.count()
        x, y = (to.withColumnsRenamed({"comp": c, "low": d, "n": f"n_{d}"}) for c, d in (("a", "x"), ("b", "y")))
        ends = heavy_aware_join(heavy_aware_join(left, x, "a", "n_x", total), y, "b", "n_y", total)
        left = checkpoint(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("n"))
    return checkpoint(heavy_aware_join(nodes, sizes, "comp", "n", nodes.count()).select("node", "comp", "n"))
