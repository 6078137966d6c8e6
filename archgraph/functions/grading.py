"""Threshold ladders."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("HIGH", "MEDIUM", "LOW")


def severity(value: Column, low: int, medium: int, high: int) -> Column:
    return (
        F.when(value >= high, F.lit("HIGH"))
        .when(value >= medium, F.lit("MEDIUM"))
        .when(value >= low, F.lit("LOW"))
    )


def severity_order(grade: Column) -> Column:
    """0 for HIGH, 1 for MEDIUM, 2 for LOW."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), grade) - 1
