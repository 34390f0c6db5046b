"""Decisions that carry a distribution, and the measures of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choice_reason(choice: Column, probabilities: Column, confidence: Column, labels: Column) -> Column:
    """The first reason why an answer is refused; empty if it holds. ``probabilities`` maps labels to numbers."""
    values = F.map_values(probabilities)
    bad = F.exists(values, lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, p: a + p)
    n, peak = F.size(values), F.array_max(values)
    right = (n * peak - 1) / (n - 1)
    return (
        F.when(F.array_sort(F.map_keys(probabilities)) != F.array_sort(labels), "distribution_labels")
        .when(bad, "numeric_range")
        .when(F.abs(total - 1) > 0.020000001, "distribution_sum")
        .when(confidence.isNull() | F.isnan(confidence) | ~confidence.between(0.0, 1.0), "numeric_range")
        .when(F.coalesce(F.try_element_at(probabilities, choice) < peak, F.lit(True)), "choice")
        .when(F.abs(confidence - right) > 0.020000001, "confidence_metric")
        .otherwise("")
    )


def abstained(choice: Column, confidence: Column) -> Column:
    return F.coalesce(choice.isin("unknown", "none") | (confidence < 0.8), F.lit(True))


def measures(df: DataFrame, expected: Column, found: Column) -> DataFrame:
    """(tp, fp, fn, abstained, precision, recall, abstention) of two columns where null abstains; shares are null over nothing."""
    counts = df.agg(
        F.count_if(expected.isNotNull() & found.eqNullSafe(expected)).alias("tp"),
        F.count_if(found.isNotNull() & ~found.eqNullSafe(expected)).alias("fp"),
        F.count_if(expected.isNotNull() & ~found.eqNullSafe(expected)).alias("fn"),
        F.count_if(expected.isNull() & found.isNull()).alias("abstained"),
        F.count_if(expected.isNull()).alias("open"),
    )
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 4)
    c = F.col
    return counts.select("tp", "fp", "fn", "abstained", share(c("tp"), c("tp") + c("fp")).alias("precision"), share(c("tp"), c("tp") + c("fn")).alias("recall"), share(c("abstained"), c("open")).alias("abstention"))
