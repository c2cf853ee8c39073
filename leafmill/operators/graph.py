"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.storage import discard, materialize

#: Files for each core of tables that hold links.
FEW_FILES = 2


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): every node that an edge of (a, b) names, with the least node it reaches.

    Alternating large-star and small-star rounds; each round only takes minima by node
    (combined before the shuffle, then written) and joins them back, so a hub is never gathered
    in one task: Spark splits the hot partitions of a join of two plain exchanges. Every round is written
    to the shared folder, and removed once the next one is. Null ends and loops are ignored; an empty table of edges gives an empty result.
    """
    links = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
        FEW_FILES,
    )
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", FEW_FILES
        )
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large", FEW_FILES)
        discard(links, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least", FEW_FILES)
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        links = materialize(small, "small", FEW_FILES)
        discard(large, least)
        many = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        inner = links.select(F.col("v").alias("u")).distinct().join(links.select("u").distinct(), "u", "left_semi")
        if many.select("u").unionByName(inner).isEmpty():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
