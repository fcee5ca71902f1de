"""Connected components by hooking and pointer jumping: O(log n) rounds of joins, whatever the shape of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _to(column: str) -> Column:
    return F.coalesce("to", column)


def followed(hooks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hooks (from, to) with each chain followed to its end: the length of chains halves with each join. The second is the
    table behind it.

    A step goes to a smaller node, so chains have no circles.
    """
    made = None
    while True:
        on = hooks.select(F.col("from").alias("via"), F.col("to").alias("on"))
        before, longer = hooks, written(
            hooks.join(on, F.col("to") == F.col("via"), "left").select(
                "from", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved"),
            ),
            "hooks",
        )
        discard(before if made is None else made)
        hooks, made = longer.select("from", "to"), longer
        if longer.filter("moved").isEmpty():
            return hooks, longer


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component: the smallest node reachable. Nodes are of any type with an order.

    A round hooks every node to the least of its neighbours, if that is less than itself, follows the hooks to their ends
    by pointer jumping, and contracts the edges to those ends. A chain in the order of its nodes is one round of
    log2(length) jumps; where nodes stand otherwise, each round leaves only nodes that are less than all their
    neighbours, at most half of a chain. Each round's tables are written to the shared folder; nothing but the question
    whether any row is left reaches the driver. A node with many edges is met by partial minima and by joins that Spark
    can split, and a round's tables go when the next one's are written. Edges of a node with itself give it a component; an empty table gives none.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    labels = written(both.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "labels")
    own = written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while not own.isEmpty():
        # the smaller end of an edge hooks the larger one
        hooks, table = followed(written(own.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")), "least"))
        moved = own.join(hooks, F.col("a") == F.col("from"), "left").select(_to("a").alias("a"), "b")
        moved = moved.join(hooks, F.col("b") == F.col("from"), "left").select("a", _to("b").alias("b"))
        old = (own, labels, table)
        own = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "edges")
        labels = written(
            labels.join(hooks, F.col("component") == F.col("from"), "left").select("node", _to("component").alias("component")),
            "labels",
        )
        discard(*old)
    return labels
