"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _least(links: DataFrame) -> DataFrame:
    """(u, v, m): each link seen from u with the least id among u and its neighbours."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = _least(down)
    return (seen.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(seen.select("u", F.col("m").alias("v")))
            .where("u != v").distinct())


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every linked id: the least id it is connected with (the root itself is left out).

    ``links`` has long columns ``u`` and ``v``. Each round is written out; it
    stops when a round changes nothing, which takes a number of rounds
    logarithmic in the longest path.
    """
    links, before = saved(links.where("u != v").distinct()), None
    while True:
        links = saved(_small_star(_large_star(links)))
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first())
        if now == before:
            return links.select("u", F.col("v").alias("root"))
        before = now
