"""Acceptance checks: expected and actual values of one ledger or score, reconciled by subject and check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewarden.operators.scoring import TYPES

BANDS = {"CRITICAL": 90, "HIGH": 70, "MEDIUM": 40}


def values(rows: DataFrame, subject: str, **checks: Column) -> DataFrame:
    """(subject, check_name, value): one row for each check of a row, values as text."""
    pairs = F.array(*[F.struct(F.lit(name).alias("check_name"), value.cast("string").alias("value")) for name, value in checks.items()])
    return rows.select(F.col(subject).alias("subject"), F.inline(pairs))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One PASS or FAIL row for each subject and check of either side, with both values.

    What only one side has fails. A value that is null on both sides passes.
    """
    e = expected.select("subject", "check_name", F.col("value").alias("expected"), F.lit(True).alias("_e"))
    a = actual.select("subject", "check_name", F.col("value").alias("actual"), F.lit(True).alias("_a"))
    same = F.col("_e") & F.col("_a") & F.col("expected").eqNullSafe(F.col("actual"))
    both = e.join(a, ["subject", "check_name"], "full_outer")
    return both.select("subject", "check_name", "expected", "actual", F.when(same, "PASS").otherwise("FAIL").alias("status"))


def _counts(cases: DataFrame, rows: DataFrame) -> DataFrame:
    n = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return cases.select("case_id").join(n, "case_id", "left").na.fill(0, ["n"])


def expected_scores(typology: DataFrame, intelligence: DataFrame, documents: DataFrame) -> DataFrame:
    """Score, band and number of signals of every case, added up from the component tables."""
    part = lambda df, name: df.select("case_id", F.col("points").alias(name))
    rows = typology.select("case_id", "total", "detected_count").join(part(intelligence, "i"), "case_id").join(part(documents, "d"), "case_id")
    score = F.least(F.lit(100), F.col("total") + F.col("i") + F.col("d"))
    band = reduce(lambda rest, b: F.when(score >= BANDS[b], b).otherwise(rest), reversed(BANDS), F.lit("LOW"))
    return values(rows, "case_id", score=score, band=band, signals=F.col("detected_count"))


def actual_scores(risk: DataFrame) -> DataFrame:
    detected = reduce(lambda a, b: a + b, [(F.col(n.lower()) > 0).cast("int") for n in TYPES])
    return values(risk, "case_id", score=F.col("risk_score"), band=F.col("risk_band"), signals=detected)


def ledger_checks(cases: DataFrame, entries: DataFrame, audit: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Expected and actual number of audit rows of a case: one for each entry."""
    return values(_counts(cases, entries), "case_id", **{name: F.col("n")}), values(_counts(cases, audit), "case_id", **{name: F.col("n")})
