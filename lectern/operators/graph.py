"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id that can be reached) for each end of
    ``links`` (a, b). A round takes the smallest label of the neighbours, then
    that label's own label, so chains halve; labels are written each round, and
    the rounds end when none changes."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    edges = materialise(both, "component_edges")
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component")), "component_labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("id") == F.col("a")).select("id", "component", F.least("component", "near").alias("lower"))
        roots = labels.select(F.col("id").alias("root"), F.col("component").alias("above"))
        stepped = lower.join(roots, F.col("lower") == F.col("root"), "left").select("id", "component", F.least("lower", "above").alias("next"))
        stepped = materialise(stepped, "component_labels")
        changed = stepped.where(F.col("component") != F.col("next")).limit(1).count()
        labels = stepped.select("id", F.col("next").alias("component"))
        if not changed:
            return labels
