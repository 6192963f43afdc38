"""Connected components over an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaspark.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for all ids in edges (a, b): label is the smallest id of the component.

    Each round takes the smallest label among the neighbours, by a two-step aggregate, and then the label's own label.
    Rounds are written to the shared folder; the driver only learns how many labels changed.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.where("a <> b").distinct(), "component-edges")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "component-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(near.withColumnRenamed("a", "id"), "id").select(
            "id", F.least("label", "near").alias("best"), F.col("label").alias("old")
        )
        jump = best.select(F.col("id").alias("best"), F.col("best").alias("further"))
        new = best.join(jump, "best").select("id", F.least("best", "further").alias("label"), (F.least("best", "further") < F.col("old")).alias("moved"))
        new = staged(new, "component-labels")
        labels = new.select("id", "label")
        if not new.where("moved").limit(1).count():
            return labels
