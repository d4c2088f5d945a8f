"""The weighted quality score of an inspected build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Component weights, penalties by severity, and grades with their least score and colour.
WEIGHTS = {"dimensional": 0.35, "layer": 0.25, "anomaly": 0.25, "completeness": 0.15}
PENALTIES = {"critical": 15, "warning": 5, "info": 1}
GRADES = ((85, "A", "#00FF00"), (70, "B", "#ADFF2F"), (50, "C", "#FFA500"), (30, "D", "#FF4500"), (None, "F", "#FF0000"))


def layer_accuracy(errors: DataFrame, tolerance: float, *by: str) -> DataFrame:
    """Percentage of height errors within the tolerance; 100 without any."""
    share = F.avg(F.when(F.abs("error") <= tolerance, 1.0).otherwise(0.0)) * 100
    return errors.groupBy(*by).agg(F.coalesce(share, F.lit(100.0)).alias("layer"))


def anomaly_score(found: DataFrame, *by: str) -> DataFrame:
    """100 less each anomaly's penalty, 0 at least."""
    penalty = F.lit(0)
    for name, points in PENALTIES.items():
        penalty = F.when(F.col("severity") == name, points).otherwise(penalty)
    return found.groupBy(*by).agg(F.greatest(F.lit(0.0), 100.0 - F.coalesce(F.sum(penalty), F.lit(0))).alias("anomaly"), F.count("*").alias("n_anomalies"))


def graded(score: Column, part: int) -> Column:
    """The grade (part 1) or colour (part 2) of a score."""
    out = None
    for row in GRADES[:-1]:
        out = F.when(score >= row[0], row[part]) if out is None else out.when(score >= row[0], row[part])
    return out.otherwise(GRADES[-1][part])


def quality(parts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add completeness, score, grade and color to rows of dimensional, layer, anomaly, n_processed and n_expected.

    Weights are scaled to a sum of 1 where they have one over 0. Without an
    expected number, completeness is 100.
    """
    w = dict(weights or WEIGHTS)
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()} if total > 0 else w
    rows = parts.withColumn("completeness", F.when(F.col("n_expected") > 0, F.least(F.lit(100.0), F.col("n_processed") / F.col("n_expected") * 100.0)).otherwise(100.0))
    score = sum((F.col(k) * v for k, v in w.items()), F.lit(0.0))
    return rows.withColumn("score", score).withColumns({"grade": graded(F.col("score"), 1), "color": graded(F.col("score"), 2)})
