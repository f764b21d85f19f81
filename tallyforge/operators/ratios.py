"""Ratios, changes and intervals. Numerators and denominators are summed first; what can't be computed is NULL with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.cells import div_reason, quotient

SUM = "decimal(20,4)"


def _by(df: DataFrame, by: list[str] | None):
    return df.groupBy(*by) if by else df.groupBy()


def pooled_ratio(df: DataFrame, numerator: Column, denominator: Column, by: list[str] | None = None) -> DataFrame:
    """Sum of numerators over sum of denominators, of the rows that have both; the others are counted in n_skipped."""
    both = numerator.isNotNull() & denominator.isNotNull()
    sums = _by(df, by).agg(
        F.sum(F.when(both, numerator)).try_cast(SUM).alias("numerator"),
        F.sum(F.when(both, denominator)).try_cast(SUM).alias("denominator"),
        F.count_if(both).alias("n_groups"),
        F.count_if(~both).alias("n_skipped"),
    )
    return sums.withColumns(
        {
            "ratio": quotient(F.col("numerator"), F.col("denominator")),
            "reason": div_reason(F.col("numerator"), F.col("denominator")),
        }
    )


def excluded_groups(df: DataFrame, by: list[str], numerator: Column, denominator: Column, zero: bool = False) -> DataFrame:
    """The groups that a pooled ratio leaves out, with the reason: a side is missing, or with ``zero`` the denominator is 0,
    for which a standardised ratio has no ratio of the group either."""
    left_out = numerator.isNull() | denominator.isNull() | (F.lit(zero) & (denominator == 0))
    return df.where(left_out).select(*by, div_reason(numerator, denominator).alias("reason"))


def pooled_roi(df: DataFrame, spend: Column, gmv: Column, roi: Column, by: list[str] | None = None) -> DataFrame:
    """Pooled return on spend: the amount sold, or spend times its ratio where only that is known."""
    return pooled_ratio(df, F.coalesce(gmv, spend * roi).cast(SUM), spend, by)


def attribution_roi(df: DataFrame, gmv: Column, spend: Column, model: str = "", window: str = "") -> DataFrame:
    """What a platform attributes to spend, with the model and window that it depends on: no gain that spend caused."""
    out = pooled_ratio(df, gmv, spend)
    return out.withColumn("scope", F.lit(f"平台归因，模型：{model or '未说明'}，窗口：{window or '未说明'}；不等于新增"))


def standardised_ratio(groups: DataFrame, weight: Column, numerator: Column, denominator: Column) -> DataFrame:
    """Sum of weight times ratio over groups. Weights must sum to 1; with a group that has no denominator the whole isn't
    computable, and the sum over the others stands beside it as ``partial``."""
    ratio = quotient(numerator, denominator)
    sums = groups.agg(
        F.sum(weight).alias("weights"),
        F.count_if(ratio.isNull()).alias("n_missing"),
        F.sum(weight * ratio.cast("double")).alias("partial"),
    )
    ok = (F.abs(F.col("weights") - 1) <= 1e-9) & (F.col("n_missing") == 0)
    return sums.withColumn("ratio", F.when(ok, F.col("partial"))).withColumn(
        "reason", F.when(F.abs(F.col("weights") - 1) > 1e-9, "权重之和不为1").when(F.col("n_missing") > 0, "存在分母缺失的组")
    )


def delta(current: Column, base: Column) -> Column:
    return current - base


def relative_change(current: Column, base: Column) -> Column:
    """(current - base) / base; NULL for a base of 0."""
    return F.try_divide(current - base, base)


def wilson(k: Column, n: Column, z: float = 1.96) -> dict[str, Column]:
    """Rate with the bounds of its Wilson interval, NULL unless 0 <= k <= n and n > 0."""
    ok = (n > 0) & (k >= 0) & (k <= n)
    n_ = F.when(ok, n.cast("double"))
    p, zz = k.cast("double") / n_, z * z
    centre = (p + zz / (2 * n_)) / (1 + zz / n_)
    half = z * F.sqrt(p * (1 - p) / n_ + zz / (4 * n_ * n_)) / (1 + zz / n_)
    return {
        "rate": p,
        "low": F.when(ok, F.greatest(F.lit(0.0), centre - half)),
        "high": F.when(ok, F.least(F.lit(1.0), centre + half)),
    }


def mean(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    sums = _by(df, by).agg(F.sum(value).try_cast(SUM).alias("total"), F.count(value).alias("n"), F.count_if(value.isNull()).alias("n_missing"))
    return sums.withColumn("mean", quotient(F.col("total"), F.col("n").cast(SUM)))


def count_ratio(df: DataFrame, hit: Column, key: Column, by: list[str] | None = None) -> DataFrame:
    """Distinct keys that are hit over all distinct keys: refunded orders, redeemed orders, redeemed coupons."""
    counts = _by(df, by).agg(F.count_distinct(F.when(hit, key)).alias("n_hit"), F.count_distinct(key).alias("n_all"))
    return counts.withColumn("ratio", F.try_divide(F.col("n_hit").cast("double"), F.col("n_all").cast("double")))
