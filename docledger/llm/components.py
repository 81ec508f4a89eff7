"""Connected components of a table of links, by alternating stars.

Every round hangs neighbours on the smallest id seen (combined map-side), until nothing
changes; the number of rounds grows with the logarithm of the longest chain. Nothing but
two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import save


def _star(rows: DataFrame) -> DataFrame:
    """``u, v, m``: each link beside the smallest neighbour of ``u``."""
    least = rows.groupBy("u").agg(F.min("v").alias("least"))
    return rows.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def _sum(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (its smallest node) of every node with a link to another one."""
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = save(links.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    state = _sum(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        found = _star(large)
        hung = found.select("u", F.col("m").alias("v")).unionByName(
            found.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = save(hung.distinct(), "edges")
        now = _sum(edges)
        if now == state:
            break
        state = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
