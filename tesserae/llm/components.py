"""Connected components of a graph that is given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, free


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has a link; root is the smallest node that links reach.

    ``links``: two columns of one ordered type, without nulls; direction, repeats and loops don't matter.
    Large-star and small-star steps in turn hang each node below smaller ones until nothing changes. A node's
    neighbours are never gathered: their minimum is aggregated before the shuffle, written, and joined back to the links from there, so that
    the links of a node that has very many can be split over tasks (a join right onto its own aggregation can't be).
    The rounds grow with the logarithm of the longest chain; of what they write, only the last round's links stay.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut(edges, "links")
    if edges.isEmpty():
        return edges.toDF("node", "root")
    mark = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "links-least")
        # large star: neighbours above u hang below the least of u's neighbourhood
        up = both.join(least, F.col("u") == F.col("w")).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        up = cut(up, "links-up")
        # small star: neighbours below u, and u, hang below the least of them
        low = cut(up.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "links-low")
        down = up.join(low, F.col("u") == F.col("w")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        older, edges = edges, cut(down.where("u <> v").distinct(), "links")
        free(older, least, up, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components need more than {most_rounds} rounds")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
