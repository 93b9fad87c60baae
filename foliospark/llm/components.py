"""Connected components of a graph whose links are a DataFrame, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of links (a, b), the least node that it reaches.

    Each round maps every node to the least of itself and its neighbours and rewrites the
    links to these; a component's least node keeps its name, so it is what remains. A round
    at least halves what is left of a component, and only staged tables pass between rounds.
    """
    links = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "least")
        if labels is None:
            labels = least.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            old, new = labels.alias("l"), least.alias("m")
            labels = old.join(new, F.col("l.component") == F.col("m.a"), "left").select("node", F.coalesce("m.to", "l.component").alias("component"))
        labels = stage(labels, "labels")
        ends = links.join(least.select("a", F.col("to").alias("x")), "a").join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        links = stage(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
