"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, spread_join


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest reachable id) for every id that occurs in links (a, b) with another one.

    Each round every vertex hands its larger neighbours to its smallest one (large star) and then its smaller
    ones (small star), so trees flatten in a logarithmic number of rounds; neighbours are never gathered in lists,
    and the many edges of a star's centre are dealt over all tasks.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count, state = edges.count(), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least, "u", 2 * count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        count, state = now[0], now
