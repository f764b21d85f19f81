"""Maturity-gated cohorts: an object counts once its whole window lies before the cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.cells import flag_is_set, is_missing


def hours(h: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(h * 3600).cast("decimal(18,6)"))


def maturity(t0: Column, cutoff: Column, h: float) -> Column:
    """eligible (the window has ended by the cutoff, inclusive) · immature · unparsable."""
    return F.when(t0.isNull(), "unparsable").when(t0 + hours(h) <= cutoff, "eligible").otherwise("immature")


def mature_split(df: DataFrame, t0: Column, cutoff: Column, h: float, key: Column) -> DataFrame:
    """Rows and distinct objects of each state."""
    state = maturity(t0, cutoff, h).alias("state")
    return df.select(state, key.alias("k")).groupBy("state").agg(F.count("*").alias("n_rows"), F.count_distinct("k").alias("n_objects"))


def _objects(df: DataFrame, key: Column, t0: Column, cutoff: Column, h: float, hit: Column) -> DataFrame:
    rows = df.select(key.alias("k"), (maturity(t0, cutoff, h) == "eligible").alias("ok"), F.coalesce(hit, F.lit(False)).alias("hit"), is_missing(key).alias("gone"))
    return rows.where("ok and not gone").groupBy("k").agg(F.bool_or("hit").alias("hit"))


def cohort_rate(df: DataFrame, key: Column, t0: Column, event: Column, cutoff: Column, h: float) -> DataFrame:
    """Objects with any event in (t0, t0 + h] over eligible objects; a missing key is no object."""
    inside = (event > t0) & (event <= t0 + hours(h))
    return _rate(_objects(df, key, t0, cutoff, h, inside))


def cohort_presence(df: DataFrame, key: Column, t0: Column, flag: Column, cutoff: Column, h: float) -> DataFrame:
    """The same by whether an event flag is set at all, whenever it was."""
    return _rate(_objects(df, key, t0, cutoff, h, flag_is_set(flag)))


def _rate(objects: DataFrame) -> DataFrame:
    counts = objects.agg(F.count("*").alias("n_eligible"), F.count_if("hit").alias("n_hit"))
    ratio = F.try_divide(F.col("n_hit").cast("double"), F.col("n_eligible").cast("double"))
    return counts.withColumn("rate", ratio).withColumn("reason", F.when(F.col("n_eligible") == 0, "没有成熟对象"))


def cohort_curve(df: DataFrame, key: Column, t0: Column, event: Column, cutoff: Column, nodes: Sequence[float], first_valid: bool = False) -> DataFrame:
    """Hits at each node, all over the cohort that is mature for the longest one, with the increase from node to node.

    An object's earliest event decides, so one at or before t0 hides later ones; with ``first_valid`` the earliest
    event after t0 does.
    """
    rows = df.select(key.alias("k"), t0.alias("t0"), event.alias("e"), maturity(t0, cutoff, max(nodes)).alias("s"), is_missing(key).alias("gone"))
    chosen = F.min(F.when(F.col("e") > F.col("t0"), F.col("e")) if first_valid else F.col("e"))
    objects = rows.where("s = 'eligible' and not gone").groupBy("k").agg(F.min("t0").alias("t0"), chosen.alias("e"))
    hits = [F.count_if((F.col("e") > F.col("t0")) & (F.col("e") <= F.col("t0") + hours(h))).alias(f"h{i}") for i, h in enumerate(sorted(nodes))]
    wide = objects.agg(F.count("*").alias("n_eligible"), *hits)
    node = F.explode(F.array(*(F.struct(F.lit(float(h)).alias("hours"), F.col(f"h{i}").alias("n_hit")) for i, h in enumerate(sorted(nodes)))))
    tall = wide.select("n_eligible", node.alias("x")).select("x.hours", "n_eligible", "x.n_hit")
    tall = tall.withColumn("rate", F.try_divide(F.col("n_hit").cast("double"), F.col("n_eligible").cast("double")))
    return tall.withColumn("increase", F.col("rate") - F.lag("rate").over(Window.orderBy("hours")))


def event_semantics(df: DataFrame, event: str, parsed: Column) -> str:
    """time, presence or blank: whether an event column holds times (80% of what isn't missing), marks, or nothing."""
    c = F.col(event)
    there = ~is_missing(c)
    n, ok = df.agg(F.count_if(there), F.count_if(there & parsed.isNotNull())).first()
    return "blank" if not n else "time" if ok >= 0.8 * n else "presence"


def status_as_time(df: DataFrame, event: str, parsed: Column) -> DataFrame:
    """Refuses a column whose values are there but none a time: then no rate is computable."""
    there = ~is_missing(F.col(event))
    counts = df.agg(F.count_if(there).alias("n_present"), F.count_if(there & parsed.isNotNull()).alias("n_parsed"))
    return counts.withColumn("computable", ~((F.col("n_present") > 0) & (F.col("n_parsed") == 0)))
