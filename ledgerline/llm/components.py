"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.rows import materialize


def connected_components(links: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of its component.

    Each round a node takes the smallest root among its neighbours, then the
    root of that root, so the rounds grow with the logarithm of a component's
    width.  Every round is written to the shared folder.  Nodes are longs.
    ``rows``: links and nodes at most, for the number of files.
    Components that have not settled after ``max_rounds`` are an error.
    """
    both = materialize(
        links.filter("a != b").select("a", "b").union(links.filter("a != b").select("b", "a")).distinct().toDF("a", "b"), "links", rows
    )
    # The first round needs no join: each node looks at its neighbours' own numbers.
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    roots = materialize(roots, "roots", rows)
    for _ in range(max_rounds):
        near = (
            both.join(roots, both["b"] == roots["node"])
            .groupBy(F.col("a").alias("near_node"))
            .agg(F.min("root").alias("near_root"))
        )
        lower = roots.join(near, roots["node"] == near["near_node"]).select(
            "node", F.col("root").alias("old"), F.least("root", "near_root").alias("mid")
        )
        up = roots.select(F.col("node").alias("up_node"), F.col("root").alias("up_root"))
        moved = lower.join(up, F.col("mid") == F.col("up_node"), "left").select(
            "node", F.least("mid", F.coalesce("up_root", "mid")).alias("root"), "old"
        )
        moved = materialize(moved, "roots", rows)
        done = not moved.filter("root != old").limit(1).count()
        roots = moved.select("node", "root")
        if done:
            return roots
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
