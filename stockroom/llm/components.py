"""Connected components of a graph too large for one machine: hooking and pointer doubling on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def connect(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (v, c) after joining the components that ``edges`` (a, b) link.

    Each round works on links between components: every component points at
    the least one among itself and its neighbours, the pointers are doubled
    until they reach their roots, and links and labels are renamed. Components
    with links at least halve in a round, so rounds are logarithmic.
    """
    ends = (edges.join(labels.withColumnsRenamed({"v": "a", "c": "ca"}), "a")
            .join(labels.withColumnsRenamed({"v": "b", "c": "cb"}), "b"))
    links = _links(ends.select("ca", "cb"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parent = stored(both.groupBy("x").agg(F.least("x", F.min("y")).alias("p")), "components-parent")
        while True:
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            parent = stored(parent.join(up, "p").select("x", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")),
                            "components-parent")
            moved = not parent.filter("moved").isEmpty()
            parent = parent.drop("moved")
            if not moved:
                break
        to = parent.withColumnsRenamed({"x": "c", "p": "root"})
        labels = stored(labels.join(to, "c", "left").select("v", F.coalesce("root", "c").alias("c")), "components-labels")
        x = parent.withColumnsRenamed({"p": "ca"})
        y = parent.withColumnsRenamed({"x": "y", "p": "cb"})
        links = _links(links.join(x, "x").join(y, "y").select("ca", "cb"))
    return labels


def _links(pairs: DataFrame) -> DataFrame:
    pairs = pairs.filter("ca <> cb").select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))
    return stored(pairs.distinct(), "components-links")
