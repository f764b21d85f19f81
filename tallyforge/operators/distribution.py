"""Distribution statistics: exact percentiles, spread, outliers, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}


def report(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Linear quantiles, mean, sample deviation and coefficient of variation, in one pass; missing values excluded and counted."""
    x = F.col(value).cast("double")
    stats = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.percentile(x, F.array(*map(F.lit, QUANTILES.values()))).alias("q"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("stdev"),
        F.count(x).alias("n"),
        F.count_if(x.isNull()).alias("n_missing"),
    )
    cv = F.when(F.col("mean") > 0, F.col("stdev") / F.col("mean"))
    quantiles = {name: F.get("q", F.lit(i)) for i, name in enumerate(QUANTILES)}
    return stats.withColumns({**quantiles, "cv": cv}).drop("q")


def iqr_bounds(df: DataFrame, value: str, by: list[str], k: float = 1.5) -> DataFrame:
    """P25 and P75 with k times their distance outside, per group of 4 values at least (else no bounds)."""
    x = F.col(value).cast("double")
    stats = df.groupBy(*by).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(x).alias("n"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    enough = F.col("n") >= 4
    return stats.select(
        *by, "n", F.when(enough, low - k * (high - low)).alias("low"), F.when(enough, high + k * (high - low)).alias("high")
    )


def iqr_outliers(df: DataFrame, value: str, by: list[str], k: float = 1.5) -> DataFrame:
    """All rows, with a flag for values strictly outside the bounds of their group: flagged, never removed."""
    bounds = iqr_bounds(df, value, by, k)
    x = F.col(value).cast("double")
    flag = F.coalesce((x < F.col("low")) | (x > F.col("high")), F.lit(False))
    return df.join(bounds, by).withColumn("is_outlier", flag)


def head_concentration(df: DataFrame, key: str, value: Column, top: int = 5) -> DataFrame:
    """Share of the ``top`` largest keys in the total; NULL for a total of 0. Ties go to the smaller key."""
    per_key = df.groupBy(key).agg(F.sum(value).alias("v"))
    total = per_key.agg(F.sum("v").alias("total"))
    head = per_key.orderBy(F.col("v").desc(), key).limit(top).agg(F.sum("v").alias("head"))
    return head.join(total).withColumn("share", F.try_divide(F.col("head").cast("double"), F.col("total").cast("double")))


def point_change(current: Column, base: Column) -> Column:
    """The change of a share in percentage points, exact: from 4% to 5% is 1 point. NULL if either is missing."""
    places = "decimal(20,9)"
    return ((current.cast(places) - base.cast(places)) * 100).cast("decimal(24,7)")


def changes(df: DataFrame, order: str, value: str) -> DataFrame:
    """Each row's value against the one before it in order, of a table of a few aggregated rows."""
    before = F.lag(value).over(Window.orderBy(order))
    return df.withColumns({"base": before, "delta": F.col(value) - before, "relative": F.try_divide((F.col(value) - before).cast("double"), before.cast("double"))})
