"""Connected components of a table of links, by contraction: only links and labels move, never whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import stored


def _changed(df: DataFrame) -> bool:
    return df.filter("parent <> before").limit(1).count() > 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it reaches.

    Each round every node takes its smallest neighbour if that is smaller, chains of such parents are halved until
    flat, and the links are contracted to parents. Rows per node are combined before they are shuffled.
    """
    edges = stored(links.filter("a <> b").select("a", "b"))
    labels = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
                         .select("node", F.least("node", "parent").alias("parent"), F.col("node").alias("before")))
        while _changed(parents):
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            parents = stored(parents.join(up, "parent")
                             .select("node", F.col("above").alias("parent"), F.col("parent").alias("before")))
        parents = parents.select("node", "parent")
        if labels is None:
            labels = stored(parents.withColumnRenamed("parent", "component"))
        else:
            renamed = parents.select(F.col("node").alias("component"), "parent")
            labels = stored(labels.join(renamed, "component", "left")
                            .select("node", F.coalesce("parent", "component").alias("component")))
        for end in ("a", "b"):
            edges = edges.join(parents.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("parent", end)
        edges = stored(edges.filter("a <> b").select("a", "b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
