"""Connected components of links by alternating star contractions; no link reaches the driver.

A node may have any number of links: its least neighbour is found by an aggregate with map-side combine and written,
so that the join with its links is one of two written tables, which adaptive execution splits at a hot node.
Edge cases: links of a node with itself and repeated ones don't count, an empty table has no components. The rounds grow
with the logarithm of the nodes; more than ``ROUNDS`` (far beyond any table) are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

ROUNDS = 200


def stars(links: DataFrame, *, both: bool) -> DataFrame:
    """Each node's neighbours (both ways: the larger ones; else the smaller ones) go to its least neighbour or itself."""
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else links
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", light=True)
    met = near.join(least, "u")
    if both:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    done = materialize(out.where("u > v").distinct(), "links", light=True)
    discard(least)
    return done


def components(links: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """(node, component): the smallest reachable node, for every node of links (u, v) that isn't its own component.

    The result is a written table, which the caller may discard; those of the rounds are gone by then.
    """
    links = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links", light=True)
    before = None
    for _ in range(rounds):
        half = stars(links, both=True)
        whole = stars(half, both=False)
        discard(links, half)
        links = whole
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if now == before:
            out = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.work_path = links.work_path
            return out
        before = now
    raise RuntimeError("components did not settle")
