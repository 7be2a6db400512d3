"""Connected components by repeated contraction: every node joins its smallest neighbour.

A round takes the smallest neighbour of each node (a partial aggregate, so a node with very many links is no hot
spot), jumps twice along those pointers and keeps only links between different survivors. Links of a written
round are the next round's input, so lineage stays flat. Rounds follow the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id in a link; the root is the smallest id of its component."""
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    rest = cut(
        pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    ups: list[DataFrame] = []
    while not rest.isEmpty():
        near = rest.unionAll(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(near.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "up")
        for _ in range(2):
            over = up.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
            up = up.join(over, up["up"] == over["_id"], "left").select("id", F.coalesce("_up", "up").alias("up"))
        up = cut(up, "up")
        ups.append(up)
        left = up.select(F.col("id").alias("a"), F.col("up").alias("_a"))
        right = up.select(F.col("id").alias("b"), F.col("up").alias("_b"))
        moved = rest.join(left, "a").join(right, "b").filter(F.col("_a") != F.col("_b"))
        rest = cut(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    if not ups:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("root"))
    roots = ups[0]
    for up in ups[1:]:
        over = up.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        roots = roots.join(over, roots["up"] == over["_id"], "left").select("id", F.coalesce("_up", "up").alias("up"))
    return cut(roots.select("id", F.col("up").alias("root")), "roots")
