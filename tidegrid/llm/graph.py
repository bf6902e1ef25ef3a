"""Connected components of link tables, by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _stars(pairs: DataFrame) -> DataFrame:
    """Every (node, neighbour) with the least node among the node and its neighbours."""
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    return pairs.join(least, "node")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found``, (node, component), with further ``links`` (a, b): only components that a link joins are worked on."""
    name = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = links.select("a", "b").join(name("a"), "a", "left").join(name("b"), "b", "left")
    joins = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moves = shared.stored(joins.withColumnRenamed("component", "whole"), "joined")
    old = found.join(moves.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    new = moves.join(found, "node", "left_anti").select("node", F.col("whole").alias("component"))  # had no link before
    return shared.stored(old.union(new), "components")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of all nodes with a link; a component is named by its least node.

    ``links`` has longs a and b. A node's neighbours are never gathered: each step is a
    minimum by node, joined back, so a node with very many links is no hot spot. Each
    round's table is written to the shared folder. Links that still change after
    ``most_rounds`` rounds are an error, never a result.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    edges = shared.stored(edges, "links")
    before = None
    for round_ in itertools.count():
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        if round_ >= most_rounds:
            raise RuntimeError(f"components: the links still change after {most_rounds} rounds")
        before = state
        both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(edges.select("lo", "hi"))
        large = _stars(both).filter("other > node").select(F.col("other").alias("hi"), F.col("least").alias("lo")).distinct()
        down = large.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        starred = _stars(down)
        small = starred.select(F.col("other").alias("hi"), F.col("least").alias("lo")).union(starred.select("node", "least")).filter("hi <> lo").distinct()
        edges = shared.stored(small, "links")
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return ends.union(edges.select("lo", "lo").distinct()).distinct()
