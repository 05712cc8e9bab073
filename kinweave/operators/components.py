"""Connected components of a pair table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import write_table


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for each node of links (a, b of one orderable type); the root is the component's smallest node.

    Self-links, repeated and reversed links are allowed. Each round hangs nodes under the smallest neighbour,
    by an aggregation of minima and a join, so a node with very many neighbours is pre-aggregated and split.
    """
    links = write_table(links.select("a", "b"), "pairs")  # found once, though read twice
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    edges = write_table(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = write_table(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = write_table(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small-star")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti"))


def label_all(nodes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """node, root for every row of nodes; nodes without links are their own root."""
    found = connected_components(links)
    every = nodes.select(F.col(id_col).alias("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _doubled(step: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """id, to: where each id of step (id, to) ends when followed 2 ** rounds times or to the end; and whether all have ended."""
    jump = write_table(step, "jumps")
    for _ in range(rounds):
        further = jump.select(F.col("id").alias("via"), F.col("to").alias("beyond"))
        hop = jump.join(further, F.col("to") == F.col("via"), "left")
        jump = write_table(hop.select("id", F.coalesce("beyond", "to").alias("to"), F.col("via").isNotNull().alias("moved")), "jumps")
        if jump.where("moved").isEmpty():
            return jump.select("id", "to"), True
        jump = jump.select("id", "to")
    return jump, False


def resolve_aliases(aliases: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, resolved: the end of each id's chain of aliases (from_id, to_id).

    Pointers double each round, so a chain of n ids takes log2 n rounds. A chain that runs into a circle ends at the last id
    before one that it has seen: the circle's id before the one where it entered. Of several aliases of one id the greatest counts.
    """
    step = write_table(aliases.where("from_id <> to_id").groupBy(F.col("from_id").alias("id")).agg(F.max("to_id").alias("to")), "steps")
    rounds = max(1, step.count().bit_length())
    ends, done = _doubled(step, rounds)
    if not done:
        # after so many hops, whatever still moves is on a circle; each id of a circle is where another of it has come to
        circle = write_table(ends.join(step.select(F.col("id").alias("on")), F.col("to") == F.col("on"), "left_semi").select(F.col("to").alias("id")).distinct(), "circles")
        inside = circle.select(F.col("id").alias("on"))
        entries, _ = _doubled(step.join(inside, F.col("id") == F.col("on"), "left_anti"), rounds)
        before = step.join(inside, F.col("id") == F.col("on"), "left_semi").select(F.col("to").alias("enters"), F.col("id").alias("last"))
        every = entries.unionByName(circle.select("id", F.col("id").alias("to")))
        ends = every.join(before, F.col("to") == F.col("enters"), "left").select("id", F.coalesce("last", "to").alias("to"))
    if ids is None:
        ids = step.select("id").unionByName(step.select(F.col("to").alias("id")))
    ends = ends.select(F.col("id").alias("from_id"), "to")
    return ids.select("id").distinct().join(ends, F.col("id") == F.col("from_id"), "left").select("id", F.coalesce("to", "id").alias("resolved"))
