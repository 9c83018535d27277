"""Connected components of an edge table, by hooking to the smallest neighbour and contracting."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.scratch import small, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of `edges` (a, b): label is the smallest vertex reachable.

    A round sends every vertex to its smallest neighbour, flattens the chains by pointer jumping, and keeps the edges
    between different labels. A vertex with many edges is reduced by partial minima before it is shuffled.
    """
    links = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = stored(
        links.select(F.col("a").alias("v")).union(links.select("b")).distinct().select("v", F.col("v").alias("label")), "labels"
    )
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = stored(
            both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "parents"
        )
        while True:  # chains get half as long each time
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = stored(parent.join(small(up), "p").select("v", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "parents")
            moved = not jumped.filter("moved").isEmpty()
            parent = jumped.select("v", "p")
            if not moved:
                break
        labels = stored(
            labels.join(small(parent.withColumnRenamed("v", "label")), "label", "left").select("v", F.coalesce("p", "label").alias("label")),
            "labels",
        )
        a, b = (parent.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        links = stored(
            links.join(small(a), "a").join(small(b), "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(),
            "edges",
        )
    return labels
