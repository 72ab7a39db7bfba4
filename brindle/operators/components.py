"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from brindle.catalog import materialize

FEW = 100_000  # rows up to which one side of a join is broadcast


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); a component is named by its least node.

    The graph is contracted until no edge is left, then the places are followed back. In each round
    every node goes to itself or a neighbour, and only edges between different places remain, so the
    work of all rounds is a multiple of the first one's. Where half of the nodes or more have one
    neighbour only, those go to it and the others stay. Else a node goes to the one of least hash
    among itself and its neighbours; the hash differs by round, so on average a fixed share of the
    nodes goes, whatever the graph. Each round is written to the shared folder, which cuts lineage.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    places, sizes = [], []
    while True:
        seen = Observation()
        nodes = left.select(F.col("a").alias("node")).union(left.select("b")).groupBy("node").agg(F.count("*").alias("n"))
        nodes = materialize(nodes.observe(seen, F.count("*").alias("all"), F.count_if(F.col("n") == 1).alias("leaves")))
        n, leaves = seen.get["all"], seen.get["leaves"]
        if not n:
            break
        place, left = without_leaves(left, nodes, n - leaves) if 2 * leaves >= n else towards_least(left, len(sizes), n)
        places.append(place)
        sizes.append(n)
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    if not places:
        return loops.distinct().select("node", F.col("node").alias("component"))
    found = places.pop()
    for place, n in zip(reversed(places), reversed(sizes[1:])):
        found = materialize(place.join(few(found.select(F.col("node").alias("of"), F.col("place").alias("end")), n), F.col("place") == F.col("of"), "left").select("node", F.coalesce("end", "place").alias("place")))
    seen = Observation()
    names = materialize(found.groupBy(F.col("place").alias("of")).agg(F.min("node").alias("component")).observe(seen, F.count("*").alias("all")))
    labels = found.join(few(names, seen.get["all"]), F.col("place") == F.col("of")).select("node", "component")
    lone = loops.join(labels, "node", "left_anti").distinct().select("node", F.col("node").alias("component"))
    return labels.union(lone)


def few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= FEW else rows


def without_leaves(edges: DataFrame, nodes: DataFrame, n_inner: int) -> tuple[DataFrame, DataFrame]:
    """(node, place) where nodes of one neighbour go to it, of two such the greater to the least; and the edges between the others."""
    inner = nodes.where("n > 1").select("node")
    for end in ("a", "b"):
        edges = edges.join(few(inner.select(F.col("node").alias(f"inner_{end}")), n_inner), F.col(end) == F.col(f"inner_{end}"), "left")
    edges = materialize(edges.select("a", "b", F.col("inner_a").isNotNull().alias("inner_a"), F.col("inner_b").isNotNull().alias("inner_b")))
    up = F.col("inner_b") & ~F.col("inner_a")
    gone = edges.where("NOT (inner_a AND inner_b)").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("place"))
    stay = inner.union(edges.where("NOT (inner_a OR inner_b)").select("a")).select("node", F.col("node").alias("place"))
    return gone.union(stay), edges.where("inner_a AND inner_b").select("a", "b")


def towards_least(edges: DataFrame, number: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(node, place), the node of least hash among a node and its neighbours; and the edges between different places."""

    def ranked(c: str):
        return F.struct(F.xxhash64(F.lit(number), c).alias("hash"), F.col(c).alias("node"))

    heard = edges.select(F.col("a").alias("node"), ranked("b").alias("r")).union(edges.select("b", ranked("a")))
    least = heard.groupBy("node").agg(F.min("r").alias("r"))
    place = materialize(least.select("node", F.least("r", ranked("node"))["node"].alias("place")))
    for end in ("a", "b"):
        edges = edges.join(few(place.select(F.col("node").alias("of"), F.col("place").alias(f"place_{end}")), n), F.col(end) == F.col("of")).drop("of")
    moved = edges.where("place_a <> place_b").select(F.least("place_a", "place_b").alias("a"), F.greatest("place_a", "place_b").alias("b"))
    return place, materialize(moved.distinct())
