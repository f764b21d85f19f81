"""Which columns of a messy table are amounts: by name, by how many cells are numbers, and not if they are dates or ids."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import names
from tallyforge.functions.cells import bare, is_missing, norm_key, strict_number
from tallyforge.operators.reconcile import AGG_METHODS

#: Shares and counts from which a column is numeric, a date, or an id.
NUMERIC_SHARE, DATE_SHARE, ID_SHARE = 0.6, 0.5, 0.8
ID_DIGITS, ID_VALUES = 10, 3


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column, from one pass: cells, missing, bad and parsed ones, the parsed share of what is there, and what speaks
    for dates (8 digits from 2020 to 2030) or ids (long, mostly unique digits)."""
    parsed, sums = [], []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        parsed += [strict_number(c).alias(f"x{i}"), bare(F.coalesce(c.cast("string"), F.lit(""))).alias(f"s{i}")]
        number, text = F.col(f"x{i}"), F.col(f"s{i}")
        there = text != ""
        sums += [
            F.count_if(number["is_missing"]).alias(f"missing{i}"),
            F.count_if(number["is_bad"]).alias(f"bad{i}"),
            F.count(number["value"]).alias(f"parsed{i}"),
            F.count_if(there).alias(f"there{i}"),
            F.count_if(text.rlike(r"^20(2\d|30)\d{4}$")).alias(f"dates{i}"),
            F.count_if(text.rlike(rf"^\d{{{ID_DIGITS},}}$")).alias(f"digits{i}"),
            F.count_distinct(F.when(there, text)).alias(f"distinct{i}"),
        ]
    wide = df.select(*parsed).agg(F.count("*").alias("n_rows"), *sums)
    kinds = ("missing", "bad", "parsed", "there", "dates", "digits", "distinct")
    row = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{k}{i}").alias(k) for k in kinds)) for i, c in enumerate(columns))))
    tall = wide.select("n_rows", row.alias("x")).select("x.column", "n_rows", *(f"x.{k}" for k in kinds))
    return tall.withColumns(
        {
            "numeric_share": F.coalesce(F.try_divide(F.col("parsed").cast("double"), (F.col("n_rows") - F.col("missing")).cast("double")), F.lit(0.0)),
            "looks_like_date": (F.col("there") > 0) & (F.col("dates") >= DATE_SHARE * F.col("there")),
            "looks_like_id": (F.col("there") >= ID_VALUES) & (F.col("digits") == F.col("there")) & (F.col("distinct") >= ID_SHARE * F.col("there")),
        }
    )


def amounts(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(columns that are amounts or quantities, columns left out as ids). The second is to be told, not hidden."""
    columns = [c for c in df.columns if c not in exclude]
    taken, left_out = [], []
    for r in column_stats(df, columns).collect() if columns else []:  # a row per column
        if names.DATE_COLUMN.search(r.column) or r.looks_like_date:
            continue
        if names.ID_COLUMN.search(r.column) or r.looks_like_id:
            left_out.append(r.column)
        elif r.parsed and r.numeric_share >= NUMERIC_SHARE:
            taken.append(r.column)
    return taken, left_out


def pair_values(left: Sequence[str], right: Sequence[str], given: bool) -> list[tuple[str, str]]:
    """Columns to compare across a join: by position if both sides were given, else those of the same name without spaces."""
    if given:
        return list(zip(left, right))
    squeeze = lambda s: "".join(s.split())
    by_name = {squeeze(c): c for c in right}
    return [(c, by_name[squeeze(c)]) for c in left if squeeze(c) in by_name]


def tolerance(text: object) -> Decimal:
    """A share that isn't negative."""
    try:
        value = Decimal(str(text))
    except InvalidOperation as e:
        raise ValueError(f"{text!r} is no tolerance") from e
    if not value.is_finite() or value < 0:
        raise ValueError(f"{text!r} is no tolerance")
    return value


def parse_plan(spec: Sequence[str] | dict[str, str] | None, headers: Sequence[str]) -> dict[str, str]:
    """A method per column from ``column=method`` words or a dict; without any, by the columns' names."""
    if not spec:
        return {h: names.agg_method(h) for h in headers}
    pairs = spec.items() if isinstance(spec, dict) else (x.rsplit("=", 1) if "=" in x else (x, names.agg_method(x)) for x in spec)
    plan = {names.column(list(headers), c): m for c, m in pairs}
    for m in plan.values():
        if m not in AGG_METHODS:
            raise ValueError(f"no method {m!r}; there are {AGG_METHODS}")
    return plan


def parse_totals(items: Sequence[str], columns: Sequence[str]) -> dict[str, Decimal]:
    """Totals from ``column=value`` words, or values in the order of the columns."""
    out = {}
    for i, item in enumerate(items):
        name, _, value = item.rpartition("=")
        if not name and i >= len(columns):
            raise ValueError(f"more totals than columns: {item!r}")
        out[names.column(list(columns), name) if name else columns[i]] = Decimal(value.replace(",", ""))
    return out


def metric_label(column: str, rows: bool = False) -> str:
    """What distinct keys (or rows) of a column count."""
    c = column.lower()
    if rows and ("券码" in c or "券号" in c):
        return "核销券数"
    for label, words in (("订单数", ("订单", "单号", "order")), ("券数", ("券",)), ("门店数", ("店",)), ("商品数", ("商品", "sku")), ("用户数", ("用户", "顾客", "会员"))):
        if any(w in c for w in words):
            return label
    return f"{column}唯一值数"


def key_report(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys that aren't missing, and rows, of one column."""
    k = F.when(~is_missing(F.col(f"`{key}`"), "reconcile"), norm_key(F.col(f"`{key}`")))
    return df.agg(F.lit(metric_label(key)).alias("label"), F.count_distinct(k).alias("n_keys"), F.count("*").alias("n_rows"))
