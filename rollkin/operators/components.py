"""Connected components of an edge table, by contraction.

Each round hooks every node to its smallest neighbour, follows those pointers to
their roots by pointer jumping, and replaces both ends of each edge by their roots.
At least half of the nodes that still have an edge vanish in a round, so the rounds
grow with the logarithm of the graph, whatever its diameter. All steps are joins and
minimum aggregations: a node with very many edges is pre-aggregated on the map
side, and its join is an ordinary shuffled one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkin.sources.scratch import discard, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges``; component = smallest node.

    Direction, repeated edges and self-loops don't matter. Rows with a null end are
    ignored. Nodes can be of any type with an order (numbers, strings). No edges: an
    empty result.
    """
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")
    ).distinct()
    pairs = written(pairs, "edges")
    known = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    known = known.withColumn("component", F.col("node"))
    left = pairs.where("a > b")
    while not left.isEmpty():
        hooks = written(left.groupBy("a").agg(F.min("b").alias("b")), "hooks")
        while True:
            next_hop = hooks.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
            jumped = written(
                hooks.join(next_hop, F.col("b") == F.col("_a"), "left")
                .select("a", F.coalesce("_b", "b").alias("b"), F.col("_b").isNotNull().alias("moved")),
                "jumps",
            )
            settled = jumped.where("moved").isEmpty()
            discard(hooks)
            hooks = jumped
            if settled:
                break
        hooks = hooks.select("a", "b")
        last_known, last_left = known, left
        known = written(_follow(known, "component", hooks), "components")
        left = written(
            _follow(_follow(left, "a", hooks), "b", hooks)
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .where("a > b").distinct(),
            "edges",
        )
        discard(last_known, last_left, jumped, pairs)
    return known


def _follow(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    roots = hooks.select(F.col("a").alias("_at"), F.col("b").alias("_root"))
    return df.join(roots, F.col(column) == F.col("_at"), "left").withColumn(
        column, F.coalesce("_root", column)
    ).drop("_at", "_root")
