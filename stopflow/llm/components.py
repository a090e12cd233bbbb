"""Connected components of an edge table, by alternating large and small stars.

Every step is a minimum per node (combined map-side) joined back to the edges, so no list of
neighbours is ever built and a node with very many edges is an ordinary skewed join. Each round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected edges ``a > b``. Large star: each node links its larger
    neighbours to the smallest node in reach; small star: itself and its smaller ones."""
    if large:
        pairs = edges.union(edges.select("b", "a"))
    else:
        pairs = edges
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = pairs.join(least, "a")
    if large:
        linked = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return linked.filter("a != b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links(a, b)`` of longs -> (node, root): every node that is not the smallest of its
    component, with the smallest."""
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a != b").distinct(),
        name,
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)
        edges = written(_star(_star(edges, large=True), large=False), name)
