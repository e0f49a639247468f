"""Connected components of a table of links, by joins: nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each linked node can reach.

    ``links``: a, b. Each round every node takes the smallest label around it, then its label's label, so
    paths shorten by more than half; rounds are written to the shared folder. Hot nodes pre-aggregate.
    """
    a, b = F.col("a"), F.col("b")
    ends = F.array(F.struct(a.alias("node"), b.alias("other")), F.struct(b.alias("node"), a.alias("other")))
    both = written(links.select(F.inline(ends)).distinct(), "links")  # of one reading of the links
    labels = written(
        both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")),
        "labels",
    )
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        )
        nearer = labels.join(around, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        nearer = written(nearer, "labels")
        jumped = nearer.join(
            nearer.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left"
        ).select("node", "before", F.least("component", F.coalesce("next", "component")).alias("component"))
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.filter("component != before").isEmpty():
            return labels
