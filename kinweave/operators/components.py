"""Connected components by alternating large-star and small-star steps over numbers.

Every step keeps the components and brings the edges closer to stars around the smallest node of each. Nodes are 64-bit
numbers while it works, so minima are hash aggregates that combine on the map side, and an edge is 16 bytes. The edges
of a step are written to the shared folder, so lineage does not grow and a lost executor costs one step at most. A
join's lines of one node may be many; the other side is a written table with a line per node, so adaptive execution can
split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.sources.shared import SharedTable, materialise

# Edges are kept as (u, v) with u > v, each once.


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down and none up, or none down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.filter("down > 1 OR down > 0 AND up > 0").isEmpty()


def _large_star(edges: DataFrame) -> SharedTable:
    """Every neighbour larger than a node is linked to the node's smallest neighbour (or the node, if smaller)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = materialise(both.groupBy("u").agg(F.min("v").alias("low")).filter("low < u"), "lows")
    moved = edges.select(F.col("v").alias("node"), "u").join(lows.df.withColumnRenamed("u", "node"), "node", "left")
    out = materialise(moved.select("u", F.coalesce("low", "node").alias("v")).distinct(), "edges")
    lows.drop()
    return out


def _small_star(edges: DataFrame) -> SharedTable:
    """A node and its smaller neighbours are all linked to the smallest of them."""
    lows = materialise(edges.groupBy("u").agg(F.min("v").alias("low")), "lows")
    others = edges.join(lows.df, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    out = materialise(others.unionByName(lows.df.withColumnRenamed("low", "v")).distinct(), "edges")
    lows.drop()
    return out


def components_of_numbers(edges: DataFrame) -> SharedTable:
    """``node, component`` for every node of ``edges`` (64-bit columns ``id_a, id_b`` without nulls; loops and repeats
    do no harm), a component named by its smallest node. The rounds needed grow with the logarithm of the size."""
    ordered = edges.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v"))
    given = materialise(ordered.distinct(), "edges")
    loops = given.df.filter("u = v").select(F.col("u").alias("node"))
    current = SharedTable(given.df.filter("u > v"), given.path)
    while not _are_stars(current.df):
        large = _large_star(current.df)
        small = _small_star(large.df)
        large.drop()
        if current.path != given.path:
            current.drop()
        current = small
    found = current.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.df.groupBy(F.col("v").alias("node")).agg(F.first("v").alias("component"))
    linked = found.unionByName(roots)
    if not loops.isEmpty():
        alone = loops.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
        linked = linked.unionByName(alone)
    out = materialise(linked, "components")
    if current.path != given.path:
        current.drop()
    given.drop()
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``id_a, id_b`` without nulls, of any type that can be
    ordered); a component is named by its smallest node.

    Nodes are numbered once, in their order, so that the smallest number of a component is its smallest node and edges
    that are stars already stay so; names are joined back at the end. The result reads a table below the shared folder.
    """
    names = edges.select(F.col("id_a").alias("node")).unionByName(edges.select(F.col("id_b").alias("node"))).distinct()
    numbers = materialise(names.orderBy("node").withColumn("number", F.monotonically_increasing_id()), "numbers")

    def of(end: str) -> DataFrame:
        return numbers.df.select(F.col("node").alias(end), F.col("number").alias(f"n_{end}"))

    numbered = edges.select("id_a", "id_b").join(of("id_a"), "id_a").join(of("id_b"), "id_b")
    parts = components_of_numbers(numbered.select(F.col("n_id_a").alias("id_a"), F.col("n_id_b").alias("id_b")))
    members = numbers.df.join(parts.df.withColumnRenamed("node", "number"), "number").select("node", "component")
    firsts = numbers.df.select(F.col("number").alias("component"), F.col("node").alias("first"))
    out = materialise(members.join(firsts, "component").select("node", F.col("first").alias("component")), "components")
    for table in (numbers, parts):
        table.drop()
    return out.df
