"""Audits of joins, groups and duplicates.

A join is never carried out to audit it: both sides become counts and sums per key, and everything that the join would do
follows from those. So the cost goes with distinct keys, not with pairs, and a hot key is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.cells import bare, is_missing, key_date, key_shape, norm_key, strict_number
from tallyforge.functions.names import ROW, agg_method

EPS = "0.01"
#: Characters of the runs by which labels are indexed.
GRAM = 3
SUM = "decimal(28,4)"
RELATIONS = ("一对一", "一对多", "多对一", "多对多")
PASS, WARN, FAIL = "通过", "警告", "失败-禁止使用该结果"
# Labels of rows that sum up others.
SUMMARY_LABELS = ("合计", "总计", "汇总", "全店", "全部", "所有", "total", "sum", "整体", "小计", "综合")


def key_counts(df: DataFrame, key: Column, values: dict[str, Column] | None = None) -> DataFrame:
    """Per normalised key (blank kept): rows, and of each value column its sum."""
    sums = [F.sum(v).cast(SUM).alias(name) for name, v in (values or {}).items()]
    return df.groupBy(norm_key(key).alias("key")).agg(F.count("*").alias("n"), *sums)


def side_counts(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Rows (key, ln, rn): of each normalised key of either side (blank kept) the rows on both.

    Both sides' rows are grouped at once: a task then holds one table of keys, not one of each side and their sorted copies for a join.
    """
    rows = left.select(norm_key(left_key).alias("key"), F.lit(True).alias("is_left")).union(right.select(norm_key(right_key).alias("key"), F.lit(False).alias("is_left")))
    return rows.groupBy("key").agg(F.count_if("is_left").alias("ln"), F.count_if(~F.col("is_left")).alias("rn"))


def multiplicity(df: DataFrame, key: Column) -> DataFrame:
    """How many keys have how many rows."""
    return key_counts(df, key).groupBy(F.col("n").alias("rows_per_key")).agg(F.count("*").alias("n_keys"))


def relationship(left_max: Column, right_max: Column) -> Column:
    """From the most rows that a key has on either side; an empty side counts as unique."""
    left, right = F.coalesce(left_max, F.lit(0)) <= 1, F.coalesce(right_max, F.lit(0)) <= 1
    return F.when(left & right, RELATIONS[0]).when(left, RELATIONS[1]).when(right, RELATIONS[2]).otherwise(RELATIONS[3])


def amplified(before: Column, after: Column, tolerance: str = EPS) -> Column:
    """Whether a sum grew by more than the tolerance (a share of it) and by more than a cent."""
    eps = F.lit(EPS).cast(SUM)
    grown = after - before
    limit = F.when(before == 0, eps).otherwise(F.greatest(F.abs(before) * F.lit(tolerance).cast("decimal(10,6)"), eps))
    return (after > before) & (grown > limit)


def join_audit(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_value: Column, right_value: Column, tolerance: str = EPS
) -> DataFrame:
    """One row that tells what an inner join on one key would do to both sums. Blank keys never join.

    ``verdict`` is fail for grown sums or rows, warn for unmatched rows, blank keys or an N:M relation. Growth is also
    judged against the matched rows alone, so that unmatched ones can't mask it (``matched_amplified``).
    """
    lk = key_counts(left, left_key, {"v": left_value}).select("key", F.col("n").alias("ln"), F.col("v").alias("lv"))
    rk = key_counts(right, right_key, {"v": right_value}).select("key", F.col("n").alias("rn"), F.col("v").alias("rv"))
    both = lk.join(rk, "key", "full_outer")
    real = F.col("key") != ""
    hit = real & F.col("ln").isNotNull() & F.col("rn").isNotNull()
    zero = F.lit(0).cast(SUM)
    out = both.agg(
        F.max("ln").alias("left_max"),
        F.max("rn").alias("right_max"),
        F.coalesce(F.sum("lv"), zero).cast(SUM).alias("left_before"),
        F.coalesce(F.sum("rv"), zero).cast(SUM).alias("right_before"),
        F.coalesce(F.sum(F.when(hit, F.col("lv"))), zero).cast(SUM).alias("left_matched"),
        F.coalesce(F.sum(F.when(hit, F.col("rv"))), zero).cast(SUM).alias("right_matched"),
        F.coalesce(F.sum(F.when(hit, F.col("lv") * F.col("rn"))), zero).cast(SUM).alias("left_after"),
        F.coalesce(F.sum(F.when(hit, F.col("rv") * F.col("ln"))), zero).cast(SUM).alias("right_after"),
        F.coalesce(F.sum(F.when(hit, F.col("ln") * F.col("rn"))), F.lit(0)).alias("matched_pairs"),
        F.coalesce(F.sum(F.when(hit, F.col("ln"))), F.lit(0)).alias("matched_left_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("rn"))), F.lit(0)).alias("matched_right_rows"),
        F.count_if(hit).alias("matched_keys"),
        F.coalesce(F.sum(F.when(F.col("rn").isNull() | ~real, F.col("ln"))), F.lit(0)).alias("unmatched_left_rows"),
        F.count_if(F.col("ln").isNotNull() & (F.col("rn").isNull() | ~real)).alias("unmatched_left_keys"),
        F.coalesce(F.sum(F.when(F.col("ln").isNull() | ~real, F.col("rn"))), F.lit(0)).alias("unmatched_right_rows"),
        F.count_if(F.col("rn").isNotNull() & (F.col("ln").isNull() | ~real)).alias("unmatched_right_keys"),
        F.count_if(~real).alias("blank_key_sides"),
    )
    out = out.withColumn("relationship", relationship(F.col("left_max"), F.col("right_max")))
    c = F.col
    out = out.withColumns(
        {
            "left_amplified": amplified(c("left_before"), c("left_after"), tolerance),
            "right_amplified": amplified(c("right_before"), c("right_after"), tolerance),
            "matched_amplified": amplified(c("left_matched"), c("left_after"), tolerance) | amplified(c("right_matched"), c("right_after"), tolerance),
            "row_amplified": (c("matched_left_rows") > 0) & (c("matched_pairs") > c("matched_left_rows")),
        }
    )
    warn = (c("unmatched_left_rows") > 0) | (c("unmatched_right_rows") > 0) | (c("relationship") == RELATIONS[3]) | (c("blank_key_sides") > 0)
    fail = c("left_amplified") | c("right_amplified") | c("row_amplified")
    return out.withColumn("verdict", F.when(fail, FAIL).when(warn, WARN).otherwise(PASS)).drop("left_max", "right_max", "blank_key_sides")


def unmatched(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Rows (side, key, n) of keys that the other side doesn't have; a blank key is always unmatched."""
    both = side_counts(left, right, left_key, right_key)
    only = lambda n, other, side: both.where(f"{n} > 0 and ({other} = 0 or key = '')").select(F.lit(side).alias("side"), "key", F.col(n).alias("n"))
    return only("ln", "rn", "left").unionByName(only("rn", "ln", "right"))


def unmatched_reasons(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Unmatched keys with the shape of the key and why it has no partner, by the shapes on the other side (six at most)."""
    shapes = lambda df, key, side: df.select(F.lit(side).alias("side"), key_shape(norm_key(key)).alias("s")).distinct()
    other = shapes(right, right_key, "left").unionByName(shapes(left, left_key, "right")).groupBy("side").agg(F.collect_set("s").alias("shapes"))
    found = unmatched(left, right, left_key, right_key).withColumn("shape", key_shape(F.col("key")))
    same = F.array_contains("shapes", F.col("shape"))
    reason = F.when(is_missing(F.col("key"), "reconcile"), "键缺失(空)").when(same, "时间范围不同(键不存在于另一表)").otherwise("其他")
    return found.join(F.broadcast(other), "side", "left").withColumn("reason", F.coalesce(reason, F.lit("其他"))).drop("shapes")


def key_profile(df: DataFrame, key: Column) -> DataFrame:
    """One row about a key column: rows, keys, blank rows, repeated keys, most rows of a key, range of dates."""
    counts = key_counts(df, key)
    date = F.to_date(key_date(F.col("key")))
    return counts.agg(
        F.sum("n").alias("n_rows"),
        F.count_if(F.col("key") != "").alias("n_keys"),
        F.coalesce(F.sum(F.when(F.col("key") == "", F.col("n"))), F.lit(0)).alias("n_blank"),
        F.count_if((F.col("key") != "") & (F.col("n") > 1)).alias("n_repeated"),
        F.max(F.when(F.col("key") != "", F.col("n"))).alias("max_rows"),
        F.date_format(F.min(date), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max(date), "yyyy-MM-dd").alias("last_date"),
    )


AGG_METHODS = ("sum", "max", "min", "first", "last", "count", "nunique", "list")


def aggregate(df: DataFrame, key: Column, plan: dict[str, str], order: Sequence[str] = (), number=None) -> DataFrame:
    """One row per normalised key (a blank one is a group too); ``plan`` names a method for each column.

    first and last go by ``order`` (without one by the row number of a file, else by all columns); sum, max and min by the numbers that parse; list
    joins distinct values in order. What counts or lists distinct values first makes one row of each (key, value), so that
    no key's rows are held together and no row is multiplied by the number of such columns.
    """
    number = number or (lambda c: strict_number(c)["value"])
    by = F.struct(*(order or ([ROW] if ROW in df.columns else sorted(df.columns))))
    rows = df.withColumns({"__key": norm_key(key), "__by": by})

    def one(name: str, method: str) -> Column:
        c = F.col(name)
        there = ~is_missing(c, "reconcile")
        match method:
            case "sum":
                return F.sum(number(c)).cast(SUM)
            case "max":
                return F.max(number(c))
            case "min":
                return F.min(number(c))
            case "first":
                return F.min_by(F.when(there, c), F.when(there, F.col("__by")))
            case "last":
                return F.max_by(F.when(there, c), F.when(there, F.col("__by")))
            case "count":
                return F.count("*")
        raise ValueError(f"no method {method!r}; there are {AGG_METHODS}")

    def distinct(name: str, method: str) -> DataFrame:
        c = F.col(name)
        value = norm_key(c) if method == "nunique" else c.cast("string")
        there = rows.where(~is_missing(c, "reconcile"))
        if method == "nunique":
            return there.select("__key", value.alias("v")).distinct().groupBy("__key").agg(F.count("*").alias(name))
        seen = there.groupBy("__key", value.alias("v")).agg(F.min("__by").alias("b"))
        inner = F.array_sort(F.collect_list(F.struct("b", "v")))
        return seen.groupBy("__key").agg(F.array_join(F.transform(inner, lambda x: x["v"]), "/").alias(name))

    apart = {name: method for name, method in plan.items() if method in ("nunique", "list")}
    made = [one(name, method).alias(name) for name, method in plan.items() if name not in apart]
    out = rows.groupBy("__key").agg(F.count("*").alias("n_rows"), *made)
    for name, method in apart.items():
        out = out.join(distinct(name, method), "__key", "left")
    nothing = {"nunique": F.lit(0).cast("long"), "list": F.lit("")}
    shown = [F.coalesce(name, nothing[apart[name]]).alias(name) if name in apart else F.col(name) for name in plan]
    return out.select(F.col("__key").alias("key"), "n_rows", *shown)


def infer_plan(columns: Sequence[str]) -> dict[str, str]:
    return {c: agg_method(c) for c in columns}


def aggregate_then_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, right_plan: dict[str, str], order: Sequence[str] = (), number=None) -> DataFrame:
    """The many side first becomes one row per key, then joins 1:1. Columns of the right side get the prefix ``right_``."""
    many = aggregate(right, right_key, right_plan, order, number).where("key <> ''")
    named = many.select("key", F.col("n_rows").alias("right_n_rows"), *(F.col(c).alias(f"right_{c}") for c in right_plan))
    return left.withColumn("key", norm_key(left_key)).join(named, "key", "inner")


def object_table(objects: DataFrame, events: DataFrame, object_key: Column, event_key: Column, event_time: Column, out: str = "event_time") -> DataFrame:
    """Every object row with the first and last event time of its key and the number of events that have a time; without any: NULL and 0.

    A key that is a missing mark is none: such objects have no events, such events no object.
    """
    times = events.select(_real_key(event_key).alias("__key"), event_time.alias("__time"))
    many = times.groupBy("__key").agg(F.min("__time").alias(f"{out}_first"), F.max("__time").alias(f"{out}_last"), F.count("__time").alias(f"{out}_count"))
    joined = objects.withColumn("__key", _real_key(object_key)).join(many.where("__key <> ''"), "__key", "left").drop("__key")
    return joined.withColumn(f"{out}_count", F.coalesce(f"{out}_count", F.lit(0)))


def _real_key(key: Column) -> Column:
    """A normalised key, blank where it is a missing mark."""
    return F.when(is_missing(key), "").otherwise(norm_key(key))


def object_audit(objects: DataFrame, events: DataFrame, object_key: Column, event_key: Column, event_time: Column, raw_time: Column) -> DataFrame:
    """One row about what ``object_table`` joined: rows of both sides, objects among the events, those with several
    events and the most, objects with and without events, and events whose time is missing or can't be read."""
    per_key = events.groupBy(_real_key(event_key).alias("key")).agg(
        F.count("*").alias("n"),
        F.count_if(is_missing(raw_time)).alias("missing"),
        F.count_if(~is_missing(raw_time) & event_time.isNull()).alias("bad"),
    )
    real = F.col("key") != ""
    about = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("event_rows"), F.count_if(real).alias("event_objects"),
        F.count_if(real & (F.col("n") > 1)).alias("repeated_objects"), F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0)).alias("most_events"),
        F.coalesce(F.sum(F.when(real, F.col("missing"))), F.lit(0)).alias("missing_times"), F.coalesce(F.sum(F.when(real, F.col("bad"))), F.lit(0)).alias("bad_times"),
    )
    held = objects.groupBy(_real_key(object_key).alias("key")).agg(F.count("*").alias("o"))
    met = held.join(per_key.where(real).select("key", "n"), "key", "left").agg(
        F.coalesce(F.sum("o"), F.lit(0)).alias("object_rows"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("o"))), F.lit(0)).alias("matched_rows")
    )
    return about.join(met).withColumn("unmatched_rows", F.col("object_rows") - F.col("matched_rows"))


def group_sums(df: DataFrame, group: Column, values: dict[str, Column], cells: dict[str, Column] | None = None) -> DataFrame:
    """Per group, without white space at its ends: rows, sums and cells without a value; a blank group is one too.

    ``cells`` holds the text that a value was read from. Cells that aren't missing and still have no value are then counted
    as bad, apart from missing ones, and the least and the greatest of them shown. ``only_space_differs`` marks groups that
    would be one if all white space went.
    """
    sums = [F.sum(v).cast(SUM).alias(f"sum_{n}") for n, v in values.items()]
    for name, v in values.items():
        text = (cells or {}).get(name)
        bad = F.lit(False) if text is None else v.isNull() & ~is_missing(text, "reconcile")
        sums.append(F.count_if(v.isNull() & ~bad).alias(f"missing_{name}"))
        if text is not None:
            seen = F.when(bad, text)
            sums += [F.count_if(bad).alias(f"bad_{name}"), F.min(seen).alias(f"least_bad_{name}"), F.max(seen).alias(f"greatest_bad_{name}")]
    groups = df.groupBy(bare(F.coalesce(group.cast("string"), F.lit(""))).alias("grp")).agg(F.count("*").alias("n_rows"), *sums)
    alike = Window.partitionBy(norm_key(F.col("grp")))  # a row per group by now
    return groups.withColumn("only_space_differs", F.count("*").over(alike) > 1)


def additivity(df: DataFrame, group: Column, value: Column, total: Column | None = None, tolerance: str = EPS) -> DataFrame:
    """Whether group sums add up to a total (given, or of the whole table on a path of its own)."""
    parts = group_sums(df, group, {"v": value}).agg(F.sum("sum_v").cast(SUM).alias("group_total"), F.count("*").alias("n_groups"))
    whole = df.agg((total if total is not None else F.sum(value)).cast(SUM).alias("table_total"))
    diff = F.col("group_total") - F.col("table_total")
    return parts.join(whole).withColumn("diff", diff).withColumn("adds_up", F.abs(F.col("diff")) < F.lit(tolerance).cast(SUM))


def partition_labels(df: DataFrame, group: Column) -> DataFrame:
    """Rows (label, is_summary, is_multi, contained_in): labels that may overlap others.

    A label is contained in another wherever the other has all its characters in a row; words need not be set apart. Labels
    are indexed by their runs of up to GRAM characters, and each is looked up by the rarest of its own, so that few unrelated
    pairs are made even where all labels begin alike.
    """
    labels = df.select(F.trim(F.coalesce(group.cast("string"), F.lit(""))).alias("label")).distinct().where("label <> ''")
    size = F.length("label")

    def grams(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("label"), i, n))

    every = F.flatten(F.transform(F.sequence(F.lit(1), F.least(size, F.lit(GRAM))), grams))
    outer = labels.select(F.col("label").alias("outer"), F.explode(F.array_distinct(every)).alias("gram"))
    often = outer.groupBy("gram").agg(F.count("*").alias("often"))
    own = labels.select(F.col("label").alias("inner_label"), F.explode(F.array_distinct(grams(F.least(size, F.lit(GRAM))))).alias("gram"))
    rarest = own.join(often, "gram").groupBy("inner_label").agg(F.min(F.struct("often", "gram")).alias("g")).select("inner_label", "g.gram")
    pairs = rarest.join(outer, "gram").where("inner_label <> `outer` and contains(`outer`, inner_label)")
    held = pairs.groupBy(F.col("inner_label").alias("label")).agg(F.count_distinct("outer").alias("contained_in"))
    marks = labels.withColumns({"is_summary": F.lower(norm_key(F.col("label"))).isin(*SUMMARY_LABELS), "is_multi": F.col("label").rlike("[/、,，;；|]")})
    return marks.join(held, "label", "left").withColumn("contained_in", F.coalesce("contained_in", F.lit(0)))


def partition_rows(df: DataFrame, group: str, other: str) -> DataFrame:
    """How two label columns relate row by row: same, contained, or neither; hierarchy if half or more are related."""
    a, b = F.trim(F.col(group).cast("string")), F.trim(F.col(other).cast("string"))
    related = (a == b) | F.contains(a, b) | F.contains(b, a)
    counts = df.where((a != "") & (b != "")).agg(
        F.count("*").alias("n_rows"), F.count_if(a == b).alias("n_same"), F.count_if(related).alias("n_related")
    )
    return counts.withColumn("is_related", F.coalesce(F.col("n_related") * 2 >= F.col("n_rows"), F.lit(False)) & (F.col("n_rows") > 0))


def dedupe_check(df: DataFrame, keys: list[Column], order: Sequence[str], value: Column) -> DataFrame:
    """One row: repeated keys, extra rows, and the sum before and after keeping the first row of each. Nothing is deleted."""
    parts = [norm_key(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    rows = df.select(*parts, value.cast(SUM).alias("__v"), F.struct(*order).alias("__o"))
    groups = rows.groupBy(*(f"__k{i}" for i in range(len(keys)))).agg(
        F.count("*").alias("n"), F.sum("__v").alias("all_v"), F.min_by("__v", "__o").alias("first_v")
    )
    return groups.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"), F.count_if(F.col("n") > 1).alias("n_repeated_keys"),
        F.sum(F.col("n") - 1).alias("n_extra_rows"), F.sum("all_v").cast(SUM).alias("sum_before"), F.sum("first_v").cast(SUM).alias("sum_after"),
    )


def keep_first(df: DataFrame, keys: list[Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    at = Window.partitionBy(*(norm_key(k) for k in keys)).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(at)).where("__rn = 1").drop("__rn")


def dedupe_count(df: DataFrame, key: Column) -> DataFrame:
    """Distinct keys that aren't missing, rows without one, rows per key."""
    k = F.when(~is_missing(key), F.trim(key.cast("string")))
    counts = df.agg(F.count_distinct(k).alias("n_objects"), F.count_if(k.isNull()).alias("n_missing"), F.count("*").alias("n_rows"))
    return counts.withColumn("rows_per_object", F.try_divide(F.col("n_rows").cast("double"), F.col("n_objects").cast("double")))
