"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewarden.storage import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, root: root is the smallest node of the component.

    Each round lets every node point its larger neighbours, then its smaller ones, to the
    smallest node it knows of; rounds are written, and end when no link changes. Minima are
    partially aggregated, so a node with very many links is no single task's work. Links point
    downwards (a > b), so the smallest that a node knows of is itself if none starts from it. Both
    halves of a round are written: the stages of a plan start together, and each costs the driver.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "cc")
    state = None
    while True:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        large = edges.toDF("u", "v").join(least.toDF("v", "m"), "v", "left")
        large = written(large.select(F.col("u").alias("a"), F.coalesce("m", "v").alias("b")).distinct(), "cc")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        turned = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(turned.union(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        state = now
