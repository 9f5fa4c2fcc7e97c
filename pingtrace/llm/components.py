"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrace.sources.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    `edges` has columns a and b of one type. Each round takes the smallest label
    among neighbours and then the label of that label, so paths shorten to a
    fraction of their length per round; labels are staged between rounds. Nodes
    with many edges are summed up by partial aggregation before the shuffle.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.where("a <> b").distinct(), "component-edges")
    labels = staged(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("component")
        ),
        "component-labels",
    )
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        closer = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        target = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        moved = staged(
            closer.join(target, "next", "left").select(
                "node",
                F.least("next", F.coalesce("beyond", "next")).alias("component"),
                F.col("component").alias("was"),
            ),
            "component-labels",
        )
        labels = moved.select("node", "component")
        if moved.where("component <> was").isEmpty():
            return labels


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """`components` of the links that `known` is of and `links` together.

    Only the components that `links` join are looked at again, each as one node, so settled
    edges are not.
    """
    fresh = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    fresh = fresh.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    known = staged(known.union(fresh), "component-known")
    for end in ("a", "b"):
        of = known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        links = links.join(of, end)
    joined = components(links.select(F.col("a_in").alias("a"), F.col("b_in").alias("b")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("into"))
    found = known.join(joined, "component", "left")
    return staged(found.select("node", F.coalesce("into", "component").alias("component")), "component-merged")
