"""Connected components of a large graph, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import Scratch


def connected_components(edges: DataFrame, a: str, b: str, most: int = 100) -> DataFrame:
    """node, root: the smallest node of its component, for every node of an edge.

    Each round a node takes the least label among its own, its neighbours' and its label's label, so paths of any shape
    shrink fast. Every round is written to the shared folder. A node of very many edges costs no more than its edges:
    labels are reduced before the shuffle.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    both = scratch.write(pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "0")
    for k in range(1, most):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("near"))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = label.join(up, "root", "left").join(near, F.col("node") == F.col("a"), "left")
        new = new.select("node", F.least("root", "above", "near").alias("new"), "root")
        new = scratch.write(new.select("node", F.col("new").alias("root"), (F.col("new") < F.col("root")).alias("moved")), str(k))
        done = not new.where("moved").take(1)
        label = new.select("node", "root")
        if k > 1:
            scratch.drop(str(k - 2))
        if done:
            return label
    raise RuntimeError("the components did not settle")
