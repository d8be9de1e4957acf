"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hintspark.plans.shared import SharedTables


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges are stars around least nodes: whoever has a smaller neighbour has no other."""
    around = _both_ways(edges).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return not around.where("m < u AND n > 1").agg(F.count("*")).first()[0]


def _attach_least(edges: DataFrame) -> DataFrame:
    """edges with the least v of their u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def stars(edges: DataFrame, tables: SharedTables | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v) but the least of each component, which is component.

    Large-star and small-star rounds: each node hangs its larger neighbours, then itself, on its
    least neighbour, until the edges are stars around the components' least nodes. One aggregate
    tells that, so stars cost no round. Every round is written to the shared folder, so the lineage
    stays short; it is deduplicated only there, since repeated edges don't change a minimum. Minima
    are partial aggregates and joins can be split, so a node with very many edges doesn't land in
    one task. Null ends and loops are ignored, repeated edges count once, an empty table gives no rows.
    """
    tables = tables or SharedTables(edges.sparkSession, "components")
    now = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = tables.keep(now)
    for _ in range(most_rounds):
        if _settled(now):
            break
        large = _attach_least(_both_ways(now)).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        hung = _attach_least(large)
        small = hung.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = tables.keep(small)
        tables.drop(now)
        now = after
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(edges: DataFrame, tables: SharedTables | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node it reaches."""
    found = stars(edges, tables, most_rounds)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
