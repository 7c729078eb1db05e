"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.shared import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node that it is connected with), for each end of a link.

    Each round a node takes the least label among its neighbours', and then
    that label's own label; the number of rounds grows with the logarithm of
    a component's width for most shapes. Labels are written after each round,
    so that a lost executor costs no more than one. Minima are taken per
    partition before a shuffle, so nodes of very many links do no harm.
    """
    both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "v", "root": "r"}), "v").groupBy("u").agg(F.min("r").alias("m"))
        took = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        hop = took.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = written(took.join(hop, "root", "left").select("node", "old", F.coalesce("next", "root").alias("root")))
        labels = new.select("node", "root")
        if new.filter("old != root").isEmpty():
            return labels
