"""Connected components by large-star and small-star steps on tables; no link or label comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v): every node's neighbours point to the least of it and them."""
    around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        moved = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:   # u > v in every link: the node itself follows too
        moved = around.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of its component, for every node of ``links`` (two columns of one orderable type)."""
    a, b = links.columns
    now = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = stored(_star(_star(now, True), False), "links")
    # stars: every node points to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
