"""Commands over files: contract, join, group, duplicates, partition, object-table, cohort, facts, report."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import names
from tallyforge.functions.cells import parse_time, strict_number
from tallyforge.operators import cohort, profile, reconcile
from tallyforge.plans import facts, report
from tallyforge.session import session
from tallyforge.sources import sinks
from tallyforge.sources.tables import ROW, Table, load_table


def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def _money(name: str):
    return strict_number(F.col(f"`{name}`"))["value"]


def _gap_notes(gaps: DataFrame | None) -> list[str]:
    if gaps is None:
        return []
    r = gaps.agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last")).first()
    return [f"【警告】{r['n']} 天没有数据，最早 {r['first']}，最晚 {r['last']}"] if r["n"] else []


def contract(spark: SparkSession, paths: Sequence[str], as_json: bool = False) -> tuple[str, int]:
    """Profiles of files; one that can't be read is told of and doesn't stop the others."""
    parts, failed = [], 0
    for path in paths:
        try:
            t = load_table(spark, path)
        except (OSError, ValueError, RuntimeError) as e:
            failed = 1
            parts.append(f"# {path}\n\n无法读取：{e}")
            continue
        columns = profile.profile(t.df)
        exported = profile.suggest(t.df)["export_time"]
        grains = profile.grain(columns)
        _, dated = profile.file_date_note(names.file_date(t.name), columns)
        notes = t.notes + ([dated] if dated else []) + _gap_notes(profile.daily_gaps(t.df, columns))
        notes += [f"「{c}」是导出或快照时间，不是业务发生时间" for c in exported]
        parts.append(sinks.to_json({"table": t.name, "columns": columns, "grain": grains}) if as_json else report.contract_report(t.name, columns, grains, notes, profile.answers(columns, grains)))
    return "\n\n".join(parts), failed


def join(left: Table, right: Table, left_key: str, right_key: str, left_value: str, right_value: str, aggregate: bool = False) -> dict:
    lk, rk = names.column(left.headers, left_key), names.column(right.headers, right_key)
    lv, rv = names.column(left.headers, left_value), names.column(right.headers, right_value)
    right_df, left_df = right.df, left.df
    left_sum, right_sum = _money(lv), _money(rv)
    if aggregate:
        right_df = reconcile.aggregate(right_df, F.col(f"`{rk}`"), {rv: names.agg_method(rv)}, [ROW])
        left_df = reconcile.aggregate(left_df, F.col(f"`{lk}`"), {lv: names.agg_method(lv)}, [ROW])
        lk = rk = "key"
        left_sum, right_sum = F.col(f"`{lv}`"), F.col(f"`{rv}`")
    return _row(reconcile.join_audit(left_df, right_df, F.col(f"`{lk}`"), F.col(f"`{rk}`"), left_sum, right_sum))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("tallyforge", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    p = sub.add_parser("contract")
    p.add_argument("files", nargs="+")
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("join")
    for x in ("--left", "--right", "--left-key", "--right-key", "--left-value", "--right-value"):
        p.add_argument(x, required=True)
    p.add_argument("--aggregate", action="store_true")
    for what, extra in (("group", "--value"), ("duplicates", "--value"), ("partition", "--other")):
        p = sub.add_parser(what)
        p.add_argument("file")
        p.add_argument("--by", required=True)
        p.add_argument(extra, required=what != "partition")
    p = sub.add_parser("object-table")
    for x in ("--objects", "--events", "--key", "--time", "--out"):
        p.add_argument(x, required=True)
    p = sub.add_parser("cohort")
    p.add_argument("file")
    for x in ("--key", "--t0", "--event", "--cutoff"):
        p.add_argument(x, required=True)
    p.add_argument("--hours", type=float, default=24)
    p.add_argument("--curve", type=float, nargs="*", default=[])
    p.add_argument("--json")
    p = sub.add_parser("facts")
    p.add_argument("rate")
    p.add_argument("--label", default="")
    p.add_argument("--out", required=True)
    p.add_argument("--merge")
    p = sub.add_parser("report")
    p.add_argument("facts")
    a = parser.parse_args(argv)
    if a.what == "facts":
        import json

        sinks.write_facts([facts.rate_fact(json.loads(Path(a.rate).read_text(encoding="utf-8")), a.label, a.rate)], a.out, a.merge)
        return 0
    if a.what == "report":
        print(report.scaffold(sinks.load_facts(a.facts)))
        return 0
    spark = spark or session()
    if a.what == "contract":
        text, code = contract(spark, a.files, a.json)
        print(text)
        return code
    if a.what == "join":
        row = join(load_table(spark, a.left), load_table(spark, a.right), a.left_key, a.right_key, a.left_value, a.right_value, a.aggregate)
        print(report.audit_report([("关联审计" + "（先聚合）" * a.aggregate, row)]))
        return report.exit_code(row["verdict"])
    if a.what == "object-table":
        objects, events = load_table(spark, a.objects), load_table(spark, a.events)
        ok, ek = names.column(objects.headers, a.key), names.column(events.headers, a.key)
        when = parse_time(F.col(f"`{names.column(events.headers, a.time)}`"))
        made = reconcile.object_table(objects.df, events.df, F.col(f"`{ok}`"), F.col(f"`{ek}`"), when).orderBy(ROW).drop(ROW)
        sinks.write_small_csv(made, a.out)
        return 0
    t = load_table(spark, a.file)
    if a.what == "cohort":
        key, t0, event = (F.col(f"`{names.column(t.headers, x)}`") for x in (a.key, a.t0, a.event))
        cutoff = F.lit(a.cutoff).try_cast("timestamp_ntz")
        how = cohort.event_semantics(t.df, names.column(t.headers, a.event), parse_time(event))
        if a.curve and how != "time":
            print("曲线需要时间列", file=sys.stderr)
            return 2
        made = cohort.cohort_rate(t.df, key, parse_time(t0), parse_time(event), cutoff, a.hours) if how == "time" else cohort.cohort_presence(t.df, key, parse_time(t0), event, cutoff, a.hours)
        rate = _row(made)
        curve = [r.asDict() for r in cohort.cohort_curve(t.df, key, parse_time(t0), parse_time(event), cutoff, a.curve).collect()] if a.curve else []
        if a.json:
            held = {"value": rate["rate"], "numerator": rate["n_hit"], "denominator": rate["n_eligible"], "reason": rate["reason"], "meta": {"n_eligible": rate["n_eligible"], "n_hit": rate["n_hit"]}}
            Path(a.json).write_text(sinks.to_json({"rate": held, "curve": curve}), encoding="utf-8")
        print(report.cohort_report(rate, curve, how))
        return 0 if rate["rate"] is not None else 2
    by = F.col(f"`{names.column(t.headers, a.by)}`")
    if a.what == "group":
        row = _row(reconcile.additivity(t.df, by, _money(names.column(t.headers, a.value))))
        row["verdict"] = reconcile.PASS if row["adds_up"] else reconcile.FAIL
    elif a.what == "duplicates":
        row = _row(reconcile.dedupe_check(t.df, [by], [ROW], _money(names.column(t.headers, a.value))))
        row["verdict"] = reconcile.WARN if row["n_extra_rows"] else reconcile.PASS
    else:
        marks = reconcile.partition_labels(t.df, by).agg(F.count_if("is_summary").alias("n_summary"), F.count_if("is_multi").alias("n_multi"), F.count_if(F.col("contained_in") > 0).alias("n_contained"))
        row = _row(marks)
        conflict = False
        if a.other:
            rows = _row(reconcile.partition_rows(t.df, names.column(t.headers, a.by), names.column(t.headers, a.other)))
            row |= rows
            conflict = rows["is_related"] and rows["n_related"] < rows["n_rows"]
        row["verdict"] = reconcile.FAIL if conflict else reconcile.WARN if any(row[k] for k in ("n_summary", "n_multi", "n_contained")) else reconcile.PASS
    print(report.audit_report([(a.what, row)]))
    return report.exit_code(row["verdict"])


if __name__ == "__main__":
    sys.exit(main())
