"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import forget, stored

# Copies of each label row for the label-of-label join: a label that a third
# of all nodes carry is met in that many partitions.
SALTS = 16


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of any sortable type -> (node, root), root the least node reached.

    Each round takes the least label among a node's neighbours, then replaces
    labels by the labels of those labels, which halves the distance to the
    root; rounds grow with the logarithm of the longest chain. Every round is
    written to the shared folder, so that a lost executor costs one round.
    Null ends and loops are ignored; no links give no rows.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        heard = (both.join(labels, both.b == labels.node)
                 .groupBy("a").agg(F.min("root").alias("heard")))
        best = (labels.join(heard, labels.node == heard.a, "left")
                .select("node", F.least("root", "heard").alias("next"),
                        F.col("root").alias("was")))
        best = stored(best, "labels")
        tops = (best.select(F.col("next").alias("node")).distinct()
                .join(best.select("node", F.col("next").alias("top")), "node")
                .select(F.col("node").alias("next"), "top",
                        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
        salted = best.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        jumped = stored(salted.join(tops, ["next", "salt"])
                        .select("node", F.col("top").alias("root"), "was"), "labels")
        forget(best)
        forget(labels)
        labels = jumped
        if jumped.where("root <> was").isEmpty():
            forget(both)
            return labels.select("node", "root")
