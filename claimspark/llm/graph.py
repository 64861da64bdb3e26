"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of ``edges`` (a, b): the label is the least node that can be reached.

    Minimum labels pass along the edges, then each label is replaced by its own label (pointer jumping), until nothing
    changes; each round is written to the shared folder. Sums and minima are combined before each shuffle, and joins
    are plain equi-joins, so that adaptive execution can split the label of a hub. Null ends take no part; an empty
    table gives an empty one.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"))
    label = whole = materialise(label, "labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = materialise(step.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        discard(whole)
        label, whole = step.select("node", "label"), step
        if step.where("label <> was").isEmpty():
            discard(both)
            return label
