"""Connected components of an edge table by repeated contraction, as joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b: long).

    Each round hooks every node to its smallest neighbour if that is smaller, shortens the chains, and replaces edges by those between
    different roots. Only per-node minima are aggregated, so a node with very many edges is no large group. A node without an edge to another
    node has no row.
    """
    links = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while True:
        up = cut(links.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "node"), "hooks")
        if up.isEmpty():
            break
        for _ in range(2):  # node -> to -> further; a node without a hook is a root
            far = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
            up = up.join(far, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        up = cut(up, "hooks")
        ends = lambda df, c: df.join(up.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")), c, "left").withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_to")
        if found is None:
            nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            found = nodes.join(up, "node", "left").select("node", F.coalesce("to", "node").alias("component"))
        else:
            found = ends(found, "component")
        found = cut(found, "components")
        moved = ends(ends(links, "a"), "b").filter("a <> b")
        links = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if found is None:
        return edges.sparkSession.createDataFrame([], "node bigint, component bigint")
    return found
