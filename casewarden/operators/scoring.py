"""Explainable additive risk score of each case, in one grouping over a long table of components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewarden.operators import network as N

#: Signal names, bands and routes.
TYPES = ("WAGE_HARVESTING", "ACCOUNT_CONTROL", "SPENDING_ANOMALY", "GEOGRAPHIC_RISK", "SECTOR_RISK")
VERSION = "additive-v1"


def all_signals(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [x.select("case_id", F.lit(name).alias("signal_type"), "detected", "points") for name, x in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def typology_points(alerts: DataFrame, signals: DataFrame) -> DataFrame:
    one = [F.max(F.when(F.col("signal_type") == n, F.col("points")).otherwise(0)).alias(n.lower()) for n in TYPES]
    g = signals.where("detected").groupBy("case_id").agg(F.sum("points").alias("total"), F.count(F.lit(1)).alias("detected_count"), *one)
    return alerts.select("case_id").join(g, "case_id", "left").na.fill(0)


def case_entities(alerts: DataFrame, edges: DataFrame) -> DataFrame:
    return alerts.select("case_id", "account_id").unionByName(N.nodes(edges)).distinct()


def intelligence_points(alerts: DataFrame, entities: DataFrame, watchlist: DataFrame, points: int = 4) -> DataFrame:
    real = entities.where(F.col("account_id") != N.EXTERNAL)
    listed = watchlist.select(F.col("matched_account_id").alias("account_id"), "risk_level")
    g = real.join(listed, "account_id").groupBy("case_id").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("risk_level") == "HIGH").alias("high_hits"))
    g = alerts.select("case_id").join(g, "case_id", "left").na.fill(0)
    return g.withColumn("points", F.when(F.col("high_hits") > 0, points).otherwise(0))


def document_points(alerts: DataFrame, docs: DataFrame, min_risky: int = 3, points: int = 4) -> DataFrame:
    g = docs.groupBy("case_id").agg(
        F.count_distinct("document_id").alias("documents"), F.count_if(F.size("risk_indicators") > 0).alias("risky"), F.min("confidence").alias("min_confidence"),
        F.count_if(F.col("review_status") == "REVIEWED").alias("reviewed"),
    )
    g = alerts.select("case_id").join(g, "case_id", "left").na.fill(0, ["documents", "risky", "reviewed"])
    return g.withColumn("points", F.when(F.col("risky") >= min_risky, points).otherwise(0))


def risk_summary(typology: DataFrame, intel: DataFrame, docs: DataFrame, cap: int = 100, bands: tuple[int, int, int] = (90, 70, 40)) -> DataFrame:
    """Every case with score, band, strength, route and the factors behind it."""
    names = [n.lower() for n in TYPES]
    zero = F.lit(0).cast("long")

    def rows(df: DataFrame, count: str, **own) -> DataFrame:
        return df.select("case_id", *[own.get(n, zero).alias(n) for n in [*names, "intelligence", "document"]], F.col(count).alias(count)).select(
            "case_id", *names, "intelligence", "document",
            *[(F.col(c) if c == count else zero).cast("long").alias(c) for c in ("detected_count", "high_hits", "risky")],
        )

    parts = [
        rows(typology, "detected_count", **{n: F.col(n).cast("long") for n in names}),
        rows(intel, "high_hits", intelligence=F.col("points").cast("long")),
        rows(docs, "risky", document=F.col("points").cast("long")),
    ]
    long = reduce(DataFrame.unionByName, parts)
    parts_of = [*names, "intelligence", "document"]
    g = long.groupBy("case_id").agg(*[F.sum(c).alias(c) for c in [*parts_of, "detected_count", "high_hits", "risky"]])
    g = g.withColumn("risk_score", F.least(F.lit(cap).cast("long"), reduce(lambda a, b: a + b, [F.col(c) for c in parts_of])))
    s, n = F.col("risk_score"), F.col("detected_count")
    top, high, medium = bands
    band = F.when(s >= top, "CRITICAL").when(s >= high, "HIGH").when(s >= medium, "MEDIUM").otherwise("LOW")
    backed = (F.col("high_hits") > 0) | (F.col("risky") > 0)
    strength = F.when((n >= 4) & (F.col("high_hits") > 0) & (F.col("risky") >= 3), "STRONG").when((n >= 2) & backed, "MODERATE").otherwise("LIMITED")
    route = F.when(s >= top, "ESCALATE_TO_SAR").when(s >= high, "REQUEST_MORE_EVIDENCE").when(s >= medium, "MONITOR_CASE").otherwise("CLOSE_AS_FALSE_POSITIVE")
    factors = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c.replace("_", " "))) for c in parts_of])), "; ")
    return g.select(
        "case_id", "risk_score", band.alias("risk_band"), strength.alias("evidence_strength"), route.alias("recommended_route"),
        factors.alias("factors"), *parts_of, F.lit(VERSION).alias("scoring_version"),
    )
