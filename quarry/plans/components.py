"""Connected components of a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import drop_path, shuffled, written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for links ``(a, b)``; a component is its least node.

    In each round every node moves to the first of itself and its neighbours; links follow, and those inside one node go, so the
    graph shrinks until no link is left. The order is that of the ids and of a hash of them in turn: the first draws
    stars into their least node at once, the second shortens chains whatever their ids. Choices are
    pre-aggregated in each task, so a node with any number of links sends one row per task. Every round is written to
    the shared folder, so no lineage grows. Links to oneself only name the node; a link with a null end is ignored.
    """
    links = links.where("a is not null and b is not null")
    spark = links.sparkSession
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    edges, path = written(links.where("a <> b").select("a", "b"), "links")
    moves, moved_to = [], []
    while edges.limit(1).count():
        turn = len(moves)

        def order(c: str, turn: int = turn) -> Column:
            return F.col(c) if turn % 2 == 0 else F.xxhash64(F.col(c), F.lit(turn))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("k"), F.col("b").alias("to"))).alias("m"))
        move = first.select("a", F.when(order("a") <= F.col("m.k"), F.col("a")).otherwise(F.col("m.to")).alias("to"))
        move, where = written(move, "moves")
        moved_to.append(where)
        moved = edges.join(shuffled(move), "a").select("b", F.col("to").alias("x")).join(shuffled(move.withColumnsRenamed({"a": "b", "to": "y"})), "b")
        shrunk = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges, new_path = written(shrunk, "links")
        drop_path(spark, path)
        path = new_path
        moves.append(move)
    at = nodes.withColumn("at", F.col("node"))
    for move in moves:
        step = move.select(F.col("a").alias("at"), "to")
        at = at.join(shuffled(step), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    at, _ = written(at, "placed")
    drop_path(spark, path, *moved_to)
    least = at.groupBy("at").agg(F.min("node").alias("component"))
    return at.join(shuffled(least), "at").select("node", "component")
