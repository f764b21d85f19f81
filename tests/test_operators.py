"""Ratios, distributions, audits, cohorts, guards on small fixtures with known answers."""

import math
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import cells
from tallyforge.functions.cells import parse_time, strict_number
from tallyforge.operators import cohort, distribution, profile, ratios, reconcile
from tallyforge.plans import guards


def dec(c):
    return F.col(c).cast("decimal(20,4)")


def test_pooled_never_averages_ratios(spark):
    g = spark.createDataFrame([(100, None, 3.0), (10000, 10000, None)], "spend int, gmv int, roi double")
    r = ratios.pooled_roi(g, dec("spend"), dec("gmv"), dec("roi")).first()
    assert (float(r.numerator), float(r.denominator)) == (10300, 10100) and round(float(r.ratio), 4) == 1.0198
    naive = (3 + 1) / 2
    assert abs(float(r.ratio) - naive) > 0.9


def test_pooled_skips_and_counts(spark):
    g = spark.createDataFrame([(1, 100), (0, 100), (5, None)], "n int, d int")
    r = ratios.pooled_ratio(g, dec("n"), dec("d")).first()
    assert (float(r.ratio), r.n_groups, r.n_skipped) == (0.005, 2, 1)
    r = ratios.pooled_ratio(spark.createDataFrame([(0, 0)], "n int, d int"), dec("n"), dec("d")).first()
    assert r.ratio is None and r.reason == "分母为零"
    r = ratios.pooled_ratio(g.limit(0), dec("n"), dec("d")).first()
    assert r.ratio is None and r.reason


def test_standardised(spark):
    g = lambda rows: spark.createDataFrame(rows, "w double, n int, d int")
    one = lambda rows: ratios.standardised_ratio(g(rows), F.col("w"), dec("n"), dec("d")).first()
    assert abs(one([(0.5, 1, 10), (0.5, 5, 10)]).ratio - 0.3) < 1e-12
    assert one([(0.5, 1, 10), (0.6, 5, 10)]).ratio is None
    r = one([(0.5, 1, 10), (0.5, 0, 0)])
    assert r.ratio is None and r.n_missing == 1 and abs(r.partial - 0.05) < 1e-12


def test_wilson(spark):
    df = spark.createDataFrame([(30, 100), (1, 0), (5, 3)], "k int, n int")
    out = df.withColumns(ratios.wilson(F.col("k"), F.col("n"))).collect()
    p, n, z = 0.3, 100, 1.96
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert abs(out[0].low - (centre - half)) < 1e-12 and abs(out[0].high - (centre + half)) < 1e-12
    assert out[1].low is None and out[2].high is None


def test_distribution(spark):
    df = spark.createDataFrame([(float(i), "a") for i in range(1, 101)] + [(5.0, "b")], "x double, g string")
    out = {r.g: r for r in distribution.report(df, "x", ["g"]).collect()}
    assert (out["a"].p25, out["a"].p75, out["a"].p50) == (25.75, 75.25, 50.5) and out["b"].stdev is None
    df = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "x double")
    assert round(distribution.report(df, "x").first().stdev, 5) == 2.13809


def test_outliers_are_flagged_not_removed(spark):
    df = spark.createDataFrame([(float(x), "a") for x in (10, 11, 12, 13, 14, 15, 1000)] + [(1.0, "b"), (2.0, "b")], "x double, g string")
    out = distribution.iqr_outliers(df, "x", ["g"])
    assert out.count() == 9 and [r.x for r in out.where("is_outlier").collect()] == [1000.0]


def test_concentration_of_nothing(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "k int, v int")
    assert distribution.head_concentration(df, "k", dec("v"), 1).first().share is None


ORDERS = [("O1", "200")]
COUPONS = [("C1", "O1", "100", "2"), ("C2", "O1", "100", "2")]


def audit(left, right, lk="o", rk="o", lv="v", rv="v"):
    number = lambda c: strict_number(F.col(c))["value"]
    return reconcile.join_audit(left, right, F.col(lk), F.col(rk), number(lv), number(rv)).first()


def test_one_order_two_coupons(spark):
    o = spark.createDataFrame(ORDERS, "o string, v string")
    c = spark.createDataFrame(COUPONS, "c string, o string, v string, q string")
    r = audit(o, c)
    assert (r.relationship, float(r.left_before), float(r.left_after), r.verdict) == ("一对多", 200, 400, reconcile.FAIL)
    many = reconcile.aggregate(c, F.col("o"), {"v": "sum", "q": "max", "c": "nunique"}, ["c"]).first()
    assert (float(many.v), float(many.q), many.c, many.n_rows) == (200, 2, 2, 2)
    joined = reconcile.aggregate_then_join(o, c, F.col("o"), F.col("o"), {"v": "sum"}, ["c"])
    assert joined.count() == 1 and float(joined.first().right_v) == 200
    one = reconcile.aggregate(c, F.col("o"), {"v": "sum"}).withColumn("v", F.col("v").cast("string"))
    assert audit(o, one, rk="key").verdict == reconcile.PASS


def test_blank_keys_never_join(spark):
    left = spark.createDataFrame([("", "1"), (None, "1"), ("a ", "1")], "o string, v string")
    right = spark.createDataFrame([(" ", "5"), ("a", "5")], "o string, v string")
    r = audit(left, right)
    assert (r.matched_pairs, r.unmatched_left_rows, r.unmatched_right_rows, r.verdict) == (1, 2, 1, reconcile.WARN)


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "o string, v string")
    r = audit(empty, empty)
    assert (r.matched_pairs, r.relationship, float(r.left_after), r.verdict) == (0, "一对一", 0.0, reconcile.PASS)


def test_masked_growth_is_seen(spark):
    left = spark.createDataFrame([("a", "100"), ("x", "1000")], "o string, v string")
    right = spark.createDataFrame([("a", "1"), ("a", "1")], "o string, v string")
    r = audit(left, right)
    assert not r.left_amplified and r.matched_amplified and r.row_amplified and r.verdict == reconcile.FAIL


def test_unmatched_groups_both_sides_at_once(spark):
    left = spark.createDataFrame([("1",), ("1",), (" 2",), (None,), ("",)], "k string")
    right = spark.createDataFrame([("2",), ("3",), ("3",), (" ",)], "k string")
    out = reconcile.unmatched(left, right, F.col("k"), F.col("k"))
    assert sorted(tuple(r) for r in out.collect()) == [("left", "", 2), ("left", "1", 2), ("right", "", 1), ("right", "3", 2)]
    # no join, for which a task would hold the keys of both sides, sorted once more
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_unmatched_reasons(spark):
    left = spark.createDataFrame([("1",), ("2",), ("",), ("门店",), ("2024-01-01",)], "k string")
    right = spark.createDataFrame([("1",), ("9",)], "k string")
    out = {r.key: r.reason for r in reconcile.unmatched_reasons(left, right, F.col("k"), F.col("k")).where("side = 'left'").collect()}
    assert out == {"2": "时间范围不同(键不存在于另一表)", "": "键缺失(空)", "门店": "其他", "2024-01-01": "其他"}


def test_unmatched_numbers_that_read_as_dates(spark):
    left = spark.createDataFrame([("1",), ("100001",), ("20240801",), ("SKU100001",)], "k string")
    right = spark.createDataFrame([(1,), (9,)], "k long")
    out = {r.key: (r.shape, r.reason) for r in reconcile.unmatched_reasons(left, right, F.col("k"), F.col("k")).where("side = 'left'").collect()}
    number = ("纯数字", "时间范围不同(键不存在于另一表)")
    assert out == {"100001": number, "20240801": number, "SKU100001": ("字母数字", "其他")}


def test_time_formats_reads_a_time_once(spark):
    df = spark.createDataFrame([("2024/8/1",), ("20240801",), ("20240802",), ("soon",), (None,)], "t string")
    out = profile.time_formats(df, "t")
    assert {tuple(r) for r in out.collect()} == {("yyyy/M/d", 1), ("yyyyMMdd", 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1 and plan.index("Filter") < plan.index("Aggregate")


def test_object_table_reads_a_time_once(spark):
    objects = spark.createDataFrame([("a",), ("b",), ("-",)], "k string")
    events = spark.createDataFrame([("a", "2024-8-2"), (" a", "2024/8/1 9:05"), ("a", "soon"), ("-", "2024-8-1"), ("b", None)], "k string, t string")
    out = reconcile.object_table(objects, events, F.col("k"), F.col("k"), parse_time(F.col("t")))
    assert {tuple(r) for r in out.collect()} == {("a", datetime(2024, 8, 1, 9, 5), datetime(2024, 8, 2), 2), ("b", None, None, 0), ("-", None, None, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("yyyy-M-d'T'H:m:s") == 1  # not once for each of first, last and count


def test_additivity_and_dedupe(spark):
    df = spark.createDataFrame([(1, "a", "10"), (2, " a", "5"), (3, "b", "-"), (3, "b", "7")], "i int, g string, v string")
    number = strict_number(F.col("v"))["value"]
    r = reconcile.additivity(df, F.col("g"), number).first()
    assert r.adds_up and r.n_groups == 2 and float(r.group_total) == 22
    assert not reconcile.additivity(df, F.col("g"), number, F.lit(23)).first().adds_up
    r = reconcile.dedupe_check(df, [F.col("i")], ["g", "v"], number).first()
    assert (r.n_rows, r.n_unique, r.n_extra_rows) == (4, 3, 1) and float(r.sum_before) == 22 and float(r.sum_after) == 15


def test_partition(spark):
    df = spark.createDataFrame([("华东",), ("华东 上海",), ("合计",), ("a/b",), ("",)], "g string")
    out = {r.label: r for r in reconcile.partition_labels(df, F.col("g")).collect()}
    assert out["华东"].contained_in == 1 and out["合计"].is_summary and out["a/b"].is_multi and "" not in out


def rows(spark, data):
    return spark.createDataFrame(data, "o string, t0 string, e string")


def test_maturity_gate(spark):
    data = [("1", "2024-08-01 00:00:00", "2024-08-01 05:00:00"), ("2", "2024-08-02 00:00:00", ""), ("3", "2024-08-05 21:00:00", ""), ("4", "不是日期", "")]
    df, cutoff = rows(spark, data), F.lit(datetime(2024, 8, 6)).cast("timestamp_ntz")
    t0, e = parse_time(F.col("t0")), parse_time(F.col("e"))
    r = cohort.cohort_rate(df, F.col("o"), t0, e, cutoff, 24).first()
    assert (r.n_hit, r.n_eligible, r.rate) == (1, 2, 0.5)
    states = {r.state: r.n_rows for r in cohort.mature_split(df, t0, cutoff, 24, F.col("o")).collect()}
    assert states == {"eligible": 2, "immature": 1, "unparsable": 1}
    edge = cohort.mature_split(rows(spark, [("1", "2024-08-05 00:00:00", "")]), t0, cutoff, 24, F.col("o")).first()
    assert edge.state == "eligible"


def test_any_row_hits_and_earliest_curve(spark):
    data = [("1", "2024-08-01", "2024-07-31"), ("1", "2024-08-01", "2024-08-02 12:00:00"), ("2", "2024-08-01", "")]
    df, cutoff = rows(spark, data), F.lit(datetime(2024, 9, 1)).cast("timestamp_ntz")
    t0, e = parse_time(F.col("t0")), parse_time(F.col("e"))
    assert cohort.cohort_rate(df, F.col("o"), t0, e, cutoff, 48).first().rate == 0.5
    curve = cohort.cohort_curve(df, F.col("o"), t0, e, cutoff, (24, 48)).orderBy("hours").collect()
    assert [(r.n_hit, r.n_eligible) for r in curve] == [(0, 2), (0, 2)]
    curve = cohort.cohort_curve(df, F.col("o"), t0, e, cutoff, (24, 48), first_valid=True).orderBy("hours").collect()
    assert [(r.n_hit, r.increase) for r in curve] == [(0, None), (1, 0.5)]


def test_presence_and_refusal(spark):
    df = rows(spark, [("1", "2024-08-01", "已完成"), ("2", "2024-08-01", "")])
    t0, cutoff = parse_time(F.col("t0")), F.lit(datetime(2024, 9, 1)).cast("timestamp_ntz")
    assert cohort.cohort_presence(df, F.col("o"), t0, F.col("e"), cutoff, 24).first().rate == 0.5
    assert not cohort.status_as_time(df, "e", parse_time(F.col("e"))).first().computable
    assert cohort.event_semantics(df, "e", parse_time(F.col("e"))) == "presence"
    r = cohort.cohort_rate(df.limit(0), F.col("o"), t0, t0, cutoff, 24).first()
    assert r.rate is None and r.reason


def test_profile_blocks(spark):
    df = spark.createDataFrame([("0012", "1.00", "2024-08-01"), ("7.00123E+15", "-", ""), ("12.0", "-5", "x"), ("0012", "0", "20240803")], "id string, amount string, t string")
    r = profile.id_profile(df, "id").first()
    assert (r.n_duplicates, r.n_scientific, r.n_float_tail, r.n_leading_zero) == (1, 1, 1, 2)
    r = profile.money_profile(df, "amount").first()
    assert (r.n_numeric, r.n_missing, r.n_negative, r.n_zero, r.total) == (3, 1, 1, 1, Decimal("-4.0000"))
    r = profile.time_profile(df, "t").first()
    assert (r.n_parsed, r.n_failed, r.span_days) == (2, 1, 3)
    days = spark.createDataFrame([("2024-08-01",), ("2024-08-02",), ("2024-08-05",)], "d string")
    assert [str(r.day) for r in profile.missing_days(days, F.to_date("d")).orderBy("day").collect()] == ["2024-08-03", "2024-08-04"]


@pytest.mark.parametrize(
    ("records", "periods", "units", "infer", "usable", "reasons"), [(2000, 1, None, False, False, 3), (50, None, 60, True, True, 0), (None, None, None, False, True, 0), (60, 5, 60, True, True, 0)]
)
def test_units_guard(spark, records, periods, units, infer, usable, reasons):
    df = spark.createDataFrame([(records, periods, units)], "r int, p int, u int")
    r = df.select(*(c.alias(n) for n, c in guards.independent_units(F.col("r"), F.col("p"), F.col("u")).items())).first()
    assert (r.ok_to_infer, r.records_usable) == (infer, usable)
    assert len([x for x in r.reasons.split("；") if x]) == reasons


def test_group_sums_tell_bad_from_missing(spark):
    df = spark.createDataFrame([("a", "1"), ("a ", "-"), ("a", "zz"), ("a", "yy"), ("a b", "2"), ("ab", None), (None, "3")], "g string, v string")
    out = {r.grp: r for r in reconcile.group_sums(df, F.col("g"), {"v": cells.strict_number(F.col("v"))["value"]}, {"v": F.col("v")}).collect()}
    assert (out["a"].n_rows, out["a"].missing_v, out["a"].bad_v, out["a"].least_bad_v, out["a"].greatest_bad_v) == (4, 1, 2, "yy", "zz")
    assert out["a b"].only_space_differs and out["ab"].only_space_differs and not out["a"].only_space_differs
    assert out[""].sum_v == 3 and out["ab"].missing_v == 1 and out["ab"].bad_v == 0
    assert reconcile.group_sums(df.limit(0), F.col("g"), {"v": F.lit(1)}).count() == 0
