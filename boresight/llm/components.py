"""Connected components by alternating large-star and small-star steps; no link ever leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boresight.llm.common import cut, few


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``node, root`` for the nodes of ``links(a, b)``; root is the smallest node that can be reached.

    Each step is a combinable minimum by node and a join back, so a star of any size is pre-aggregated before it is
    shuffled and adaptive execution can split the join. Few edges are taken in few tasks, from
    the start where the number of ``rows`` of the links is told. Cases: self-links and repeated links add nothing.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(edges.distinct() if rows is None else few(few(edges, rows).distinct(), rows))
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        n = 2 * mark[0]
        both = few(edges, n).select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        lows = few(both.groupBy("u").agg(F.min("v").alias("m")), n).select("u", F.least("u", "m").alias("m"))
        large = few(few(both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), n).distinct(), n)
        lows = few(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v")))
        edges = cut(few(few(small, n).distinct(), n))
        if (now := _mark(edges)) == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    heads = few(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), mark[0])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(heads)
