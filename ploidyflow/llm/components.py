"""Connected components of a graph whose links are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link.

    links: columns a and b (bigint); self-links and repeats do no harm. Each round
    takes the least label of all neighbours, then the label of that label, and is
    written into the shared folder, so paths shorten by more than half a round and
    no lineage grows. Only a count of changes reaches the driver.
    """
    both = links.where("a != b").select("a", "b").union(links.where("a != b").select("b", "a")).toDF("node", "other").distinct()
    both = written(both, "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        hooked = written(labels.select("node", "component").join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")), "hooked")
        roots = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = hooked.join(roots, "component").select("node", F.least("component", "root").alias("component"), "was")
        last, labels = labels, written(jumped, "labels")
        discard(last, hooked)
        if labels.where("component != was").isEmpty():
            discard(both)
            return labels.select("node", "component")
