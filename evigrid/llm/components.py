"""Connected components of a link table, by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.session import materialise


def smallest_labels(links: DataFrame) -> DataFrame:
    """``node``, ``label`` for every node of ``links`` (columns ``a``, ``b``): the smallest node it is connected to.

    Each round lowers a node's parent, and its parent's parent, to the smallest grandparent among its neighbours, and
    takes the shortcut to its own grandparent; rounds grow with the logarithm of the longest path. A round reads and
    writes stored tables, so its plan stays short and a lost executor costs one round's tasks. Hub keys appear only in
    aggregates that combine before the shuffle and in joins that the adaptive planner may split.
    """
    both = materialise(
        links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct()
    )
    # first labels: the smallest of a node and its neighbours
    state = materialise(
        both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent"))
    )
    while True:
        grand = materialise(
            state.alias("s").join(state.select(F.col("node").alias("p"), F.col("parent").alias("g")), F.col("parent") == F.col("p"))
            .select("node", "parent", "g")
        )
        around = both.join(grand.select(F.col("node").alias("v"), F.col("g").alias("seen")), "v")
        lowest = around.groupBy("u").agg(F.min("seen").alias("seen"))
        offers = grand.join(lowest, F.col("node") == F.col("u")).select(
            F.explode(
                F.array(
                    F.struct(F.col("node").alias("node"), F.least("g", "seen").alias("parent")),
                    F.struct(F.col("parent").alias("node"), F.least("g", "seen").alias("parent")),
                )
            ).alias("o")
        )
        after = materialise(offers.select("o.*").groupBy("node").agg(F.min("parent").alias("parent")))
        moved = (
            after.select("node", F.col("parent").alias("now")).join(state, "node").where(F.col("now") != F.col("parent")).limit(1)
        )
        if moved.isEmpty():
            return after.select("node", F.col("parent").alias("label"))
        state = after
