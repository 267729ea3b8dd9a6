"""Connected components of an edge table by alternating large and small stars, each round a written table.

Both stars need only the minimum neighbour of each node, which aggregates before its shuffle; a node with very many
neighbours is split by adaptive execution where its edges meet its minimum. Rounds grow with the logarithm of the
longest path; nothing is collected but one row of checksums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) with u > v. Large: join all higher neighbours of each node to its minimum; small: all lower ones."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    j = around.join(least, around["u"] == least["c"])
    if large:
        out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node. Null ends are dropped."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(edges[a].isNotNull() & edges[b].isNotNull() & (edges[a] != edges[b])).distinct()
    edges, last = materialize(edges, "edges"), None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == last or not seen.n:
            break
        last, old = seen, edges
        edges = materialize(_stars(_stars(old, True), False), "edges")
        release(old)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
