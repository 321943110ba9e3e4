"""Connected components of a link table, by joins; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (src, dst); the component is its smallest id.

    Every round takes the smallest label among the neighbours, then follows labels to the label's
    own label, so long chains shrink by more than half. Rounds end when no label changes. Each
    round is written to the shared folder. Nulls and self links are ignored; no links give no rows.
    """
    ends = edges.where("src <> dst").select("src", "dst")
    both = cut(ends.unionAll(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
                .select("id", F.least("id", "m").alias("component")))
    while True:
        near = (both.join(label, both.dst == label.id).groupBy(F.col("src").alias("id"))
                .agg(F.min("component").alias("m")))
        hooked = label.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        root = label.select(F.col("id").alias("new"), F.col("component").alias("root"))
        step = cut(hooked.join(root, "new", "left").select(
            "id", F.least("new", F.coalesce("root", "new")).alias("component"), "old"))
        label = step.select("id", "component")
        if step.where("component <> old").isEmpty():
            return label
