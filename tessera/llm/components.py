"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours to its smallest one, then every node's smaller neighbours likewise. Sides: a > b."""
    both = _both(links)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    return small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch, rows: int, rounds: int = 60) -> DataFrame:
    """(a, b) links, about ``rows`` of them at most, to (node, root): one row for each node that isn't its component's smallest."""
    now = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), rows)
    before = None
    for _ in range(rounds):
        now = scratch.keep(_star(now), rows if before is None else before[0])
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"links between documents did not converge in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
