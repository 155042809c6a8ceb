"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: long); component is the smallest node reachable.

    In each round every node hooks to its smallest neighbour, hooks are followed to
    their roots by doubling, and edges contract to roots: at least half of a component's
    nodes go, so rounds grow with the logarithm of its size. Hot nodes are
    pre-aggregated before the shuffle, and each step ends as a written table.
    Nulls link nothing; loops keep their node; repeated edges count once.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    out = written(nodes.withColumn("component", F.col("node")), "nodes")
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        hook = written(low.select("node", F.least("node", "to").alias("to"), F.lit(True).alias("moved")), "hook")
        while not hook.where("moved").isEmpty():
            over = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            last, hook = hook, written(hook.join(over, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "hook")
            discard(last)
        label = hook.select("node", "to")
        before = (out, live, hook)
        out = written(out.join(label.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "nodes")
        live = written(
            live.join(label.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(label.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct(),
            "edges",
        )
        discard(*before)
    discard(live)
    return out
