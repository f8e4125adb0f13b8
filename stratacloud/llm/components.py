"""Connected components of links between nodes of any orderable type, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """Components of links (a, b): one row (node, label) per node of a link; nodes with the same label are connected.

    Each round every node takes the name of its smallest neighbour or itself, links are renamed, and loops and repeats
    go; no link is lost, since a node's link to its new name stays a link between their new names. At least half of
    the linked nodes vanish per round, whatever the shape. Names travel as joins and grouped minima, which combine
    before the shuffle, so a node with a third of all links is no hot group."""
    left = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .filter("a != b").distinct(), "links")
    names = None
    while True:
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                       .select("node", F.least("node", "near").alias("to")), "names")
        stale = [left]
        if names is None:
            names = step.select("node", F.col("to").alias("label"))
        else:
            stale += [names, step]
            names = written(names.join(step.withColumnRenamed("node", "label"), "label", "left")
                            .select("node", F.coalesce("to", "label").alias("label")), "labels")
        one, two = step.toDF("a", "ta"), step.toDF("b", "tb")
        left = written(left.join(one, "a").join(two, "b")
                       .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                       .filter("a != b").distinct(), "links")
        discard(*stale)
        if left.isEmpty():
            return names
