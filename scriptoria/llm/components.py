"""Connected components by label propagation over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import common

#: Rounds of plain propagation, enough for stars and for stars of stars; longer chains are then halved by jumps.
PLAIN_ROUNDS = 4


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, component), the smallest node that is reached; nodes without links have no row.

    Each round gives every node the smallest label among its own and its neighbours'. If labels still change after
    PLAIN_ROUNDS, a round also tells each label's own node of the smaller labels met and jumps to the label's label,
    so that rounds are about the logarithm of the longest chain. A node's messages are combined before they are
    shuffled, so that a hot node isn't one task's work."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = 2 * links.count()  # of edges; labels are fewer
    edges = common.stored(both.where("a <> b").distinct(), "edges", rows)
    labels = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node")
    labels = common.stored(labels.withColumn("moved", F.lit(True)), "labels", rows)
    number = 0
    while not labels.where("moved").isEmpty():
        number += 1
        # only labels that moved are news
        news = labels.where("moved").select(F.col("node").alias("b"), "component")
        heard = edges.join(news, "b").groupBy("a").agg(F.min("component").alias("heard")).withColumnRenamed("a", "node")
        fresh = labels.join(heard, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        if number > PLAIN_ROUNDS:
            told = fresh.groupBy(F.col("was").alias("node")).agg(F.min("component").alias("told"))
            fresh = fresh.join(told, "node", "left").select("node", "was", F.least("component", "told").alias("component"))
            jump = fresh.select(F.col("node").alias("component"), F.col("component").alias("further"))
            fresh = fresh.join(jump, "component").select("node", "was", F.col("further").alias("component"))
        labels = common.stored(fresh.select("node", "component", (F.col("component") != F.col("was")).alias("moved")), "labels", rows)
    return labels.select("node", "component")
