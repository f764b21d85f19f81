"""Column and table profiles: counts of blanks, missing marks and values, and what kind of column it is.

All columns are profiled by one wide aggregate; only what needs a grouping of its own runs apart.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import names
from tallyforge.functions.cells import FLOAT_TAIL, SCIENTIFIC, half_width, is_blank, is_missing, missing_label, parse_number, parse_time_format

SAMPLE_ROWS = 200
MONEY = "decimal(20,4)"


def _real(c: Column) -> Column:
    return ~is_blank(c) & ~is_missing(c, "contract")


def looks_like_time(df: DataFrame, columns: list[str], order: list[str] = ()) -> dict[str, bool]:
    """Columns of whose first 200 values (3 at least) 80% are times.

    First by ``order``; without one by the row number of a file, else by a hash of all columns, so that reruns agree.
    """
    by = list(order) or ([names.ROW] if names.ROW in df.columns else [F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))])
    first = df.orderBy(*by).limit(SAMPLE_ROWS)
    sums = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`").cast("string")
        sums += [F.count_if(_real(c)).alias(f"n{i}"), F.count_if(_real(c) & parse_time_format(c)["value"].isNotNull()).alias(f"t{i}")]
    r = first.agg(*sums).first() if sums else {}
    return {name: r[f"n{i}"] >= 3 and r[f"t{i}"] >= max(3, int(r[f"n{i}"] * 0.8 + 0.5)) for i, name in enumerate(columns)}


def missing_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: blank, missing by mark, zero and other values; three different things."""
    c = F.col(f"`{column}`").cast("string")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(is_blank(c)).alias("n_blank"),
        F.count_if(~is_blank(c) & is_missing(c, "contract")).alias("n_marked"),
        F.count_if(_real(c) & (parse_number(c) == 0)).alias("n_zero"),
        F.count_if(_real(c)).alias("n_real"),
    )


def missing_marks(df: DataFrame, column: str) -> DataFrame:
    """How often each missing mark occurs."""
    label = missing_label(F.col(f"`{column}`"))
    return df.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


def id_profile(df: DataFrame, column: str) -> DataFrame:
    c = half_width(F.trim(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))))
    rows = df.select(c.alias("c"), _real(c).alias("real"))
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("c").alias("n_distinct"),
        (F.count("*") - F.count_distinct("c")).alias("n_duplicates"),
        F.count_if(F.col("real") & F.col("c").rlike(SCIENTIFIC)).alias("n_scientific"),
        F.count_if(F.col("real") & F.col("c").rlike(FLOAT_TAIL)).alias("n_float_tail"),
        F.count_if(F.col("real") & F.col("c").rlike("^0[0-9]+$")).alias("n_leading_zero"),
        F.min(F.when(F.col("real"), F.length("c"))).alias("shortest"),
        F.max(F.when(F.col("real"), F.length("c"))).alias("longest"),
    )


def digit_lengths(df: DataFrame, column: str) -> DataFrame:
    c = half_width(F.trim(F.col(f"`{column}`").cast("string")))
    return df.where(c.rlike("^[0-9]+$")).groupBy(F.length(c).alias("digits")).agg(F.count("*").alias("n"))


def money_profile(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`").cast("string")
    rows = df.select(parse_number(c).alias("v"), _real(c).alias("real"))
    return rows.agg(
        F.count("v").alias("n_numeric"),
        F.count_if(F.col("real") & F.col("v").isNull()).alias("n_bad"),
        F.count_if(~F.col("real")).alias("n_missing"),
        F.sum("v").cast(MONEY).alias("total"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.count_if(F.col("v") < 0).alias("n_negative"),
        F.count_if(F.col("v") == 0).alias("n_zero"),
    )


def time_profile(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`").cast("string")
    rows = df.select(parse_time_format(c)["value"].alias("t"), _real(c).alias("real"))
    return rows.agg(
        F.count_if("real").alias("n_real"),
        F.count_if(F.col("real") & F.col("t").isNotNull()).alias("n_parsed"),
        F.count_if(F.col("real") & F.col("t").isNull()).alias("n_failed"),
        F.min("t").alias("first_time"),
        F.max("t").alias("last_time"),
        (F.datediff(F.max("t"), F.min("t")) + 1).alias("span_days"),
    )


def time_formats(df: DataFrame, column: str) -> DataFrame:
    made = parse_time_format(F.col(f"`{column}`").cast("string"))["format"]
    # A filter on the format would be pushed down and read every time twice; one on the count can't be.
    return df.select(made.alias("format")).groupBy("format").agg(F.count("format").alias("n")).where("n > 0")


def status_profile(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent values, ties by value, and how many rows the others have."""
    counts = df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    head = counts.orderBy(F.col("n").desc(), "value").limit(top)
    return head.join(total).withColumn("n_other", F.col("total") - F.sum("n").over(Window.partitionBy())).drop("total")


def full_row_duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, unique rows, groups that repeat, rows beyond the first of each."""
    groups = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count("*").alias("__n"))
    return groups.agg(
        F.sum("__n").alias("n_rows"), F.count("*").alias("n_unique"), F.count_if(F.col("__n") > 1).alias("n_repeated"), F.sum(F.col("__n") - 1).alias("n_extra")
    )


def candidate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, n_distinct, n_rows, is_key), the most distinct first."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_distinct(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(f"d{i}") for i, c in enumerate(columns)))
    row = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns))))
    tall = counts.select("n", row.alias("x")).select("x.column", "x.n_distinct", F.col("n").alias("n_rows"))
    return tall.withColumn("is_key", (F.col("n_rows") > 0) & (F.col("n_distinct") == F.col("n_rows")))


def rows_per_day(df: DataFrame, ts: Column) -> DataFrame:
    return df.where(ts.isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def missing_days(df: DataFrame, ts: Column) -> DataFrame:
    """Days between the first and the last that have no row; none for fewer than 3 days with rows."""
    days = df.select(F.to_date(ts).alias("day")).where("day is not null").distinct()
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count("*").alias("n")).where("n >= 3")
    every = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return every.join(days, "day", "left_anti")


def partial_last_day(df: DataFrame, ts: Column, value: Column) -> DataFrame:
    """Whether the last day's sum is under half the median of the other days (of 4 days at least)."""
    per_day = df.where(ts.isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.sum(value).cast("double").alias("v"))
    last = per_day.agg(F.max_by("v", "day").alias("last_sum"), F.max("day").alias("last_day"), F.count("*").alias("n_days"))
    others = per_day.join(last.select("last_day"), F.col("day") < F.col("last_day")).agg(F.percentile("v", 0.5).alias("median_others"))
    ratio = F.try_divide(F.col("last_sum"), F.col("median_others"))
    return last.join(others).withColumn("ratio", ratio).withColumn("is_partial", F.coalesce((F.col("n_days") >= 4) & (F.col("ratio") < 0.5), F.lit(False)))


def profile(df: DataFrame, order: list[str] = ()) -> list[dict]:
    """Every column's counts and kind, from one wide aggregate and one pass over the first rows."""
    headers = [c for c in df.columns if c != names.ROW]
    guessed = looks_like_time(df, [c for c in headers if names.kind(c) in ("数量", "文本")], order)
    kinds = {c: names.kind(c, guessed.get(c, False)) for c in headers}
    parsed, sums = [], [F.count("*").alias("n_rows")]
    for i, name in enumerate(headers):
        text = F.col(f"`{name}`").cast("string")
        parsed.append(text.alias(f"c{i}"))
        c = F.col(f"c{i}")
        sums += [
            F.count_if(is_blank(c)).alias(f"blank{i}"),
            F.count_if(~is_blank(c) & is_missing(c, "contract")).alias(f"marked{i}"),
            F.count_distinct(F.coalesce(c, F.lit(""))).alias(f"distinct{i}"),
        ]
        v = F.col(f"v{i}")  # parsed once, used by several sums
        if kinds[name] in ("金额", "数量"):
            parsed.append(parse_number(text).alias(f"v{i}"))
            sums += [F.sum(v).cast(MONEY).alias(f"total{i}"), F.count(v).alias(f"numeric{i}"), F.count_if(v < 0).alias(f"negative{i}"), F.count_if(v == 0).alias(f"zero{i}")]
        if kinds[name] == "时间":
            parsed.append(parse_time_format(text)["value"].alias(f"v{i}"))
            sums += [F.count(v).alias(f"parsed{i}"), F.min(v).alias(f"first{i}"), F.max(v).alias(f"last{i}")]
        if kinds[name] == "ID":
            parsed.append(half_width(F.trim(text)).alias(f"v{i}"))
            sums += [F.count_if(v.rlike(SCIENTIFIC)).alias(f"scientific{i}"), F.count_if(v.rlike("^0[0-9]+$")).alias(f"leading_zero{i}")]
    r = df.select(*parsed).agg(*sums).first().asDict()
    out = []
    for i, name in enumerate(headers):
        own = {k.removesuffix(str(i)): v for k, v in r.items() if k.endswith(str(i)) and k.removesuffix(str(i)).isidentifier() and not k.removesuffix(str(i))[-1].isdigit()}
        out.append({"column": name, "kind": kinds[name], "n_rows": r["n_rows"], **own, "unique": own["distinct"] == r["n_rows"]})
    return out


def daily_gaps(df: DataFrame, columns: list[dict]) -> DataFrame | None:
    """Days without rows, by the first time column of a table whose rows are days of something.

    None for a table without times, and for one with an ID of events (orders, coupons): its days may well be empty.
    """
    times = [c["column"] for c in columns if c["kind"] == "时间"]
    events = [c for c in columns if c["kind"] == "ID" and not names.DIMENSION.search(c["column"])]
    if events or not times:
        return None
    return missing_days(df, parse_time_format(F.col(f"`{times[0]}`").cast("string"))["value"])


def file_date_note(day: datetime.date | None, columns: list[dict]) -> tuple[bool | None, str]:
    """Whether the date in a file's name lies within the times of its columns, export times left out, and what to say of it."""
    spans = [c for c in columns if c["kind"] == "时间" and c["parsed"] and not names.EXPORT_TIME.search(c["column"])]
    if day is None:
        return None, ""
    if not spans:
        return None, f"文件名日期 {day}，表内没有时间列可供核对"
    first, last = min(c["first"] for c in spans).date(), max(c["last"] for c in spans).date()
    inside = first <= day <= last
    said = "在数据时间之内，但仍不能当作业务日期过滤" if inside else "【警告】不在数据时间之内，请按表内时间列过滤"
    return inside, f"文件名日期 {day}（数据 {first} ~ {last}）：{said}"


def suggest(df: DataFrame, order: list[str] = ()) -> dict[str, list[str]]:
    """Columns to use as times, ids and amounts, and times that say when a table was made, by which nothing should be filtered.

    Times go by name; only where no name says so, by values, ids left out.
    """
    headers = [c for c in df.columns if c != names.ROW]
    times = [c for c in headers if names.TIME.search(c)]
    if not times:
        guessed = looks_like_time(df, [c for c in headers if not names.ID.search(c)], order)
        times = [c for c, is_time in guessed.items() if is_time]
    return {
        "time": times,
        "id": [c for c in headers if names.ID.search(c)],
        "money": [c for c in headers if names.is_money(c)],
        "export_time": [c for c in times if names.EXPORT_TIME.search(c)],
    }


def grain(columns: list[dict]) -> list[dict]:
    """What one row may stand for, from unique columns and what their names say; always to be confirmed by a person."""
    rules = (("一行一张券", names.COUPON), ("一行一个售后单", names.AFTER_SALE), ("一行一个订单", names.ORDER), ("一行一个素材", names.MATERIAL), ("一行一个计划", names.PLAN))
    found = []
    for said, pattern in rules:
        for c in columns:
            if pattern.search(c["column"]):
                found.append({"grain": said, "column": c["column"], "confidence": "高" if c["unique"] else "低", "duplicates": c["n_rows"] - c["distinct"]})
    days = [c for c in columns if c["kind"] == "时间"]
    if not found and days:
        stores = [c["column"] for c in columns if names.STORE.search(c["column"])]
        found.append({"grain": "一行一天一门店" if stores else "一行一天", "column": days[0]["column"], "confidence": "高" if days[0]["unique"] else "中", "duplicates": days[0]["n_rows"] - days[0]["distinct"]})
    return sorted(found, key=lambda g: "高中低".index(g["confidence"]))


def answers(columns: list[dict], grains: list[dict]) -> dict[str, list[str]]:
    """What the table can answer and what it can't, three of each at most, by the kinds of its columns."""
    has = {c["kind"] for c in columns}
    can, cannot = [], []
    (can if {"金额", "时间"} <= has else cannot).append("金额随时间的变化")
    (can if "ID" in has else cannot).append("按对象去重计数")
    (can if any(g["grain"] == "一行一张券" for g in grains) else cannot).append("核销率与核销时间")
    return {"can": can[:3], "cannot": cannot[:3]}
