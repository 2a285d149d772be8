"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banterscope.session import materialise

LINKS_A_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node that a link ``a, b`` names; the root is the component's least node.

    Every round takes the least root among the neighbours and then the root's root, so long chains shrink by
    half. Each round's table is written to the shared folder: no lineage grows, and a lost executor costs one
    round at most. Nothing but a count reaches the driver.
    """
    # Few links need few tasks; many have a bounded number in each.
    tasks = 8 + links.count() // LINKS_A_TASK
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.where("a <> b").distinct().coalesce(tasks), "links")
    roots = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")).coalesce(tasks), "roots")
    while True:
        near = edges.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("root", "near").alias("root"), F.col("root").alias("old")
        )
        above = roots.select(F.col("node").alias("_up"), F.col("root").alias("_top"))
        step = step.join(above, F.col("root") == F.col("_up"), "left").select(
            "node", F.least("root", "_top").alias("root"), "old"
        )
        step = materialise(step.coalesce(tasks), "roots")
        changed = step.where("root <> old").limit(1).count()
        roots = step.select("node", "root")
        if not changed:
            return roots
