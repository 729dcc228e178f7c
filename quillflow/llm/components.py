"""Connected components of a graph of links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """From links (u bigint, v bigint): (node, root), root being the smallest node reachable from node.

    Each round takes the smallest label among a node's neighbours, then follows
    labels of labels, until a round changes nothing.  Sums and minima combine
    before the shuffle, and the joins have no operator above them that keeps
    Spark from splitting a hot key.  Every round is written to the shared folder.
    """
    edges = materialize(links.select("u", "v").union(links.select("v", "u")).where(F.col("u") != F.col("v")).distinct(), "links")
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), "labels")
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        met = materialize(labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "met")
        up = met.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        jumped = met.join(up, F.col("root") == F.col("up"), "left").select("node", "old", F.least("root", "up_root").alias("root"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "root")
        if jumped.where(F.col("old") != F.col("root")).limit(1).count() == 0:
            return labels
