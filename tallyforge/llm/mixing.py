"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, shuffle_partitions

#: Times a document may be taken.
MOST_TIMES = 3
#: A source's shuffled documents are summed in so many runs, so that no source meets in one task.
RUN_BITS = 10
WORD = r"[^\x20\x09-\x0D]+"


class MixPlan(NamedTuple):
    """runs: (source, run) with size of the source, target, and words of the runs before. cutoff: the last key taken."""

    runs: DataFrame
    cutoff: tuple | None


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _rows(docs: DataFrame, keep: list[Column], id_col: str, text: str, source: str) -> DataFrame:
    """What the queue needs of each document; its place in the shuffled order is a hash of its contents."""
    place = F.xxhash64(F.col(id_col), F.col(source), F.col(text))
    return docs.select(
        *keep,
        F.col(source).cast("string").alias("__source"),
        F.col(id_col).cast("string").alias("__id"),
        words_in(F.col(text)).alias("__size"),
        place.alias("__place"),
        F.shiftrightunsigned(place, 64 - RUN_BITS).cast("int").alias("__run"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """(__source, __source_size) with __target: shares by weights 1, 2, 3, 1, ... in order of the source's code points, null last.

    No target is above MOST_TIMES the size of its source; what that leaves over is shared again by
    weight. In order of cap over weight the capped sources come first, so running sums find the
    common share at once. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    cap = (F.col("__source_size") * MOST_TIMES).cast("double")
    ranked = sizes.withColumn("__weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn(
        "__level", cap / F.col("__weight")
    )
    every = Window.partitionBy()
    before = Window.orderBy("__level", F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("__source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    weights = F.sum("__weight").over(every) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    shared = ranked.withColumn("__share", left / weights)
    fits = F.when(F.col("__share") <= F.col("__level"), F.struct("__level", F.col("__share").alias("s")))
    level = F.min(fits).over(every)["s"]
    return shared.select("__source", "__source_size", F.least(cap, level * F.col("__weight")).alias("__target"))


def _joined(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """Inner join by ``names``, in which nulls are equal."""
    b = b.withColumnsRenamed({n: f"{n}_b" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"{n}_b")) for n in names]
    return a.join(b, on).drop(*(f"{n}_b" for n in names))


def _queued(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds __end: words of the row's source up to and with it, in shuffled order; joins by (source, run), so a hot source spreads."""
    joined = _joined(rows, runs, "__source", "__run")
    running = Window.partitionBy("__source", "__run").orderBy("__place", "__id", "__size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return joined.withColumn("__end", F.col("__before") + F.sum("__size").over(running))


def _key(epoch: Column | int) -> list[Column]:
    """Virtual finish time of a copy, then what breaks ties."""
    done = F.lit(epoch) * F.col("__source_size") + F.col("__end")
    finish = F.when(F.col("__target") > 0, done / F.col("__target")).otherwise(F.lit(0.0))
    return [finish, F.col("__source"), F.col("__place"), F.col("__id")]


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> MixPlan:
    """Virtual finish times of all copies, sorted over the whole table and cut at the total of all sizes."""
    rows = cut(_rows(docs, [], id_col, text, source), narrow=False)
    n = rows.count()
    per_run = rows.groupBy("__source", "__run").agg(F.sum("__size").alias("__words"))
    per_run = cut(per_run, rows=n // 8)
    sized = targets(per_run.groupBy("__source").agg(F.sum("__words").alias("__source_size")))
    before = Window.partitionBy("__source").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.withColumn("__before", F.coalesce(F.sum("__words").over(before), F.lit(0)))
    runs = cut(_joined(offsets, sized, "__source").drop("__words"), rows=n // 8)
    budget = per_run.agg(F.sum("__words")).first()[0] or 0
    copies = (
        _queued(rows, runs)
        .withColumn("__epoch", F.explode(F.array(*(F.lit(e) for e in range(MOST_TIMES)))))
        .where(
            (F.col("__size") > 0)
            & (F.col("__epoch") * F.col("__source_size") + F.col("__end") - F.col("__size") < F.col("__target"))
        )
    )
    f, s, p, i = _key(F.col("__epoch"))
    keys = copies.select(f.alias("f"), s.alias("s"), p.alias("p"), i.alias("i"), F.col("__size").alias("n"))
    order = ["f", F.col("s").asc_nulls_first(), "p", F.col("i").asc_nulls_first()]
    keys = cut(keys, rows=n)
    ranges = keys.repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
    sorted_runs = cut(ranges.withColumn("part", F.spark_partition_id()), rows=n)
    part, held = None, 0
    for r in sorted(sorted_runs.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # one row per task
        if held + r.n > budget:
            part = r.part
            break
        part, held = r.part, held + r.n
    if part is None:
        return MixPlan(runs, None)
    # the part in which the budget ends: its rows up to there
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before_it = sorted_runs.where(F.col("part") < part).agg(F.sum("n")).first()[0] or 0
    within = sorted_runs.where(F.col("part") == part).withColumn("end", F.sum("n").over(running) + before_it)
    last = within.where(F.col("end") <= budget).agg(F.max(F.struct("f", "s", "p", "i")).alias("k")).first().k
    if last is None and part > 0:
        last = sorted_runs.where(F.col("part") < part).agg(F.max(F.struct("f", "s", "p", "i")).alias("k")).first().k
    return MixPlan(runs, tuple(last) if last is not None else None)


def _times(cutoff: tuple | None) -> Column:
    """How often the mix takes a row: its copies up to the cutoff that start before the target."""
    if cutoff is None:
        return F.lit(0)
    f, s, p, i = cutoff
    end = F.struct(
        F.lit(f).cast("double").alias("f"), F.lit(s).cast("string").alias("s"), F.lit(p).cast("long").alias("p"), F.lit(i).cast("string").alias("i")
    )
    times = F.lit(0)
    for e in range(MOST_TIMES):
        key = F.struct(*(c.alias(n) for c, n in zip(_key(e), "fspi")))
        starts = F.lit(e) * F.col("__source_size") + F.col("__end") - F.col("__size") < F.col("__target")
        times = times + F.when(starts & (F.col("__size") > 0) & (key <= end), 1).otherwise(0)
    return times


def decide(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, times and taken words.

    Null texts have size 0; size 0 is taken 0 times. Null sources form a source of their own. Null
    ids and repeated rows are documents like any other. Ties of the finish time go by source, then by a hash of the row, then by id;
    rows that agree in all are taken together. Texts of any length are counted whole. An empty table gives an empty one. Only the
    three named columns are read, so others may have any name.
    """
    mix = plan(docs, id_col, text, source)
    rows = _rows(docs, [F.col(id_col)], id_col, text, source)
    times = _times(mix.cutoff).cast("long")
    return _queued(rows, mix.runs).select(
        id_col, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        times.alias("times"), (times * F.col("__size")).alias("taken"),
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, all columns kept.

    Documents without words weigh nothing in the mix and are left out.
    """
    mix = plan(docs, id_col, text, source)
    rows = _rows(docs, [F.struct("*").alias("__doc")], id_col, text, source)
    times = _times(mix.cutoff).cast("int")
    taken = _queued(rows, mix.runs).withColumn("__times", times).where("__times > 0")
    return taken.select("__doc", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).select("__doc.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))
