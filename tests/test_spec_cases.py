"""Eight questions that are easily answered wrongly, with the wrong way beside the right one; and column detection."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.cells import strict_number
from tallyforge.operators import columns, ratios, reconcile
from tallyforge.plans import guards


def dec(c):
    return F.col(c).cast("decimal(20,4)")


def test_1_overall_return_isnt_the_mean_of_returns(spark):
    g = spark.createDataFrame([(100, 300), (10000, 10000)], "spend int, gmv int")
    r = ratios.pooled_ratio(g, dec("gmv"), dec("spend")).first()
    wrong = g.agg(F.avg(F.col("gmv") / F.col("spend"))).first()[0]
    assert round(float(r.ratio), 4) == 1.0198 and wrong == 2


def test_2_one_order_two_coupons_is_one_order(spark):
    orders = spark.createDataFrame([("O1", "200")], "o string, v string")
    coupons = spark.createDataFrame([("C1", "O1", "100", "2"), ("C2", "O1", "100", "2")], "c string, o string, v string, q string")
    wrong = orders.join(coupons, "o").agg(F.sum(orders["v"].cast("int"))).first()[0]
    one = reconcile.aggregate(coupons, F.col("o"), {"v": "sum", "q": "max", "c": "nunique"}, ["c"]).first()
    assert wrong == 400 and (one.c, float(one.v), float(one.q)) == (2, 200, 2)
    assert coupons.agg(F.sum(F.col("q").cast("int"))).first()[0] == 4  # quantities repeat the order's, so summing them is wrong


def test_4_a_point_isnt_a_percent(spark):
    r = spark.createDataFrame([(0.05, 0.04), (0.01, 0.0)], "a double, b double").select(
        ratios.delta(F.col("a"), F.col("b")).alias("d"), ratios.relative_change(F.col("a"), F.col("b")).alias("r")
    ).collect()
    assert round(r[0].d, 10) == 0.01 and round(r[0].r, 10) == 0.25 and r[1].r is None


def test_5_attributed_isnt_caused(spark):
    flag = lambda x: F.lit(x)
    r = spark.range(1).select(
        guards.causal_label(flag(False), flag(False), flag(True)).alias("attributed"), guards.causal_label(flag(False), flag(True), flag(True)).alias("controlled"),
        guards.causal_label(flag(True), flag(True), flag(True)).alias("random"), guards.causal_label(flag(False), flag(False), flag(False)).alias("nothing"),
    ).first()
    assert tuple(r) == ("待验证假设", "观察性差异", "已对账事实", "数据不足")


def test_6_redemptions_of_the_batch_not_of_the_visits(spark):
    rows = [(i, "now" if i < 200 else "before", i < 70 or i >= 200) for i in range(230)]
    df = spark.createDataFrame(rows, "c int, batch string, used boolean")
    r = ratios.count_ratio(df.where("batch = 'now'"), F.col("used"), F.col("c")).first()
    assert (r.n_hit, r.n_all, r.ratio) == (70, 200, 0.35) and df.where("used").count() == 100


def test_7_paid_less_refunds_isnt_net_revenue(spark):
    f, t = F.lit(False), F.lit(True)
    r = spark.range(1).select(*(guards.net_revenue(*x)[k].alias(f"{k}{i}") for i, x in enumerate(((f, f, f), (t, f, t), (t, t, t))) for k in ("can_net", "can_profit"))).first()
    assert tuple(r) == (False, False, True, False, True, True)


def test_8_orders_arent_experiments(spark):
    r = spark.range(1).select(*(c.alias(n) for n, c in guards.independent_units(F.lit(2000), F.lit(1), F.lit(None).cast("int")).items())).first()
    assert not r.ok_to_infer and not r.records_usable and r.label == "数据不足"


@pytest.mark.parametrize(
    ("name", "values", "amount"),
    [
        ("金额", ["10", "20.5", "-", ""], True), ("券码", ["10", "20", "30"], False), ("编码值", ["1", "2", "3"], False), ("x", ["7001234567890001", "7001234567890002", "7001234567890003"], False),
        ("x", ["7001234567890001", "7001234567890002"], True), ("x", ["70012345678", "70012345678", "70012345678", "70012345678", "70012345678"], True), ("日期", ["20240101", "20240102"], False),
        ("x", ["20240101", "20240102"], False), ("x", ["a", "b", "3"], False), ("x", ["", "", "", "5"], True),
    ],
)
def test_amount_columns(spark, name, values, amount):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` string")
    taken, left_out = columns.amounts(df)
    assert (name in taken) == amount and not set(taken) & set(left_out)


def test_plans_totals_tolerances():
    assert columns.parse_plan(["核销金额=max", "购买数量"], ["核销金额", "购买数量"]) == {"核销金额": "max", "购买数量": "max"}
    assert columns.parse_plan(None, ["门店"]) == {"门店": "first"}
    assert columns.parse_totals(["7", "b=2"], ["a", "b"]) == {"a": Decimal(7), "b": Decimal(2)}
    assert columns.tolerance("0.01") == Decimal("0.01")
    for bad in ("-1", "x", "nan"):
        with pytest.raises(ValueError):
            columns.tolerance(bad)
    with pytest.raises(ValueError):
        columns.parse_plan({"a": "median"}, ["a"])
    assert columns.pair_values(["金 额", "x"], ["金额"], False) == [("金 额", "金额")] and columns.pair_values(["a"], ["b"], True) == [("a", "b")]
    assert columns.metric_label("订单ID") == "订单数" and columns.metric_label("券码", rows=True) == "核销券数" and columns.metric_label("x") == "x唯一值数"


def test_strict_numbers_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string")
    assert columns.amounts(df) == ([], []) and df.select(strict_number(F.col("a"))).count() == 0
