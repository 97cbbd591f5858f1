"""Connected components of a distributed edge list."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, cut


def components(edges: DataFrame, u: str = "u", v: str = "v", keep: Scratch | None = None) -> DataFrame:
    """`node`, `component`: for every node of an edge the smallest node that it reaches.

    Rounds of contraction. Each node takes its smallest neighbour (or itself) as parent, so a parent is never
    larger and every tree's root is its smallest node; the edges are rewritten to the roots' names, equal ones and
    loops go, and the rest is the next round's graph. Only nodes smaller than all their neighbours outlive a round.

    A hub doesn't gather its rows in one task where that can be helped: whether parents have parents of their own is
    asked once a parent, not once a node, and an edge's larger end is renamed first, so that a star's edges are loops,
    and gone, before its middle is joined on. What is left to join on a hub is split by adaptive skew joins.
    Nothing but the first row of a table, as a sign that it isn't empty, goes to the driver. Null ends are ignored. No edges give no rows.

    With `keep` the tables of the rounds, and the result, are kept there; without, each is a checkpoint. One that has
    a successor is not read again.
    """
    kept = keep or (lambda rows, name: cut(rows))
    own = uuid4().hex  # the results of several calls stay beside each other
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    graph = kept(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"graph {own}")
    nodes = graph.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    names = nodes.select("node", F.col("node").alias("component"))
    while graph.take(1):
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        jump = kept(parent.select(F.col("u").alias("old"), F.col("p").alias("new")), f"jump {own}")
        while True:  # to the roots: each step doubles the reach, so a chain of n takes log n steps
            to = jump.select(F.col("old").alias("new"), F.col("new").alias("far"))
            on = kept(jump.select("new").distinct().join(to, "new").where("new <> far"), f"on {own}")
            if not on.take(1):
                break
            jump = kept(jump.join(on, "new", "left").select("old", F.coalesce("far", "new").alias("new")), f"jump {own}")
        names = kept(_renamed(names, jump, "component"), f"names {own}")
        graph = _renamed(_renamed(graph, jump, "v").where("u <> v"), jump, "u").where("u <> v")
        graph = kept(graph.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"graph {own}")
    return names


def _renamed(df: DataFrame, jump: DataFrame, name: str) -> DataFrame:
    other: list[Column | str] = [c for c in df.columns if c != name]
    return df.join(jump, df[name] == jump["old"], "left").select(*other, F.coalesce("new", name).alias(name))
