"""Connected components of a link table by minimum labels with pointer jumping.

Each round every vertex takes the smallest label among its neighbours, then the label of that
label; a path of length n needs about log n rounds. Labels stay in tables: nothing is collected
but the number of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.plans.session import Scratch


def connected_components(links: DataFrame, s: Scratch) -> DataFrame:
    """(vertex, component) for every vertex of ``links(u, v)``; component is the smallest id in it."""
    both = s.keep(links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).filter("u <> v").distinct(), "edges")
    labels = s.keep(both.groupBy(F.col("u").alias("vertex")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("vertex").alias("v"), "component"), "v").groupBy(F.col("u").alias("vertex")).agg(F.min("component").alias("near"))
        new = labels.join(near, "vertex").select("vertex", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("vertex").alias("component"), F.col("component").alias("above"))
        new = new.join(up, "component", "left").select("vertex", "old", F.least("component", F.coalesce("above", "component")).alias("component"))
        new = s.keep(new, "labels")
        changed = new.filter("component <> old").limit(1).count()
        s.drop(labels)
        labels = new.select("vertex", "component")
        labels.scratch_path = new.scratch_path
        if not changed:
            return labels
