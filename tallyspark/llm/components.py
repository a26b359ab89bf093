"""Connected components of a link table, by contraction; nothing of it is gathered on the driver.

Each round gives every node the least of itself and its neighbours and rewrites the links with these
labels; links inside a component vanish, so the table shrinks to nothing. A node's label is then
looked up through the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: (a, b), both long. Returns (node, root) of every linked node; root is the least node reachable."""
    rest = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = written(rest, "links")
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        ends = rest.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.col("a").alias("near")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("x")).select("x.*")
        label = written(ends.groupBy("node").agg(F.min("near").alias("near")), "labels")
        # a node's label may have a smaller label itself: follow one step, which halves what is left
        up = label.select(F.col("node").alias("near"), F.col("near").alias("above"))
        label = written(label.join(up, "near").select("node", F.col("above").alias("root")), "labels")
        steps.append(label)
        for end in ("a", "b"):
            rest = rest.join(label.select(F.col("node").alias(end), F.col("root").alias("new")), end) \
                .drop(end).withColumnRenamed("new", end)
        rest = written(rest.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), "links")
    if not steps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
        out = out.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return out
