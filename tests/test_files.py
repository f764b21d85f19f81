"""Loading messy files, facts, reports, commands."""

import datetime
import json
from decimal import Decimal

import pytest

from tallyforge import cli
from tallyforge.operators import profile, reconcile
from tallyforge.plans import facts, guards, report
from tallyforge.sources import sinks, tables

ORDERS = """订单ID,下单时间,支付时间,实收金额,订单状态
D1,2024-08-01 10:00:00,2024-08-01 10:01:00,"1,100.00",已完成
D2,2024-08-02 10:00:00,,50.00,待支付
D3,2024-08-03 10:00:00,2024-08-03 10:05:00,-,已完成
D3,2024-08-03 10:00:00,2024-08-03 10:05:00,-,已完成
"""
COUPONS = "券码;订单ID;核销时间;核销金额;购买数量\nC1;D1;2024-08-01 20:00:00;60;2\nC2;D1;2024-08-05 20:00:00;40;2\nC3;D9;-;-;1\n"


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(t):
    return [tuple(r)[:-1] for r in t.df.orderBy(tables.ROW).collect()]


def test_loads_with_mark_and_quotes(spark, tmp_path):
    t = tables.load_table(spark, put(tmp_path / "orders.csv", ORDERS, "utf-8-sig"))
    assert t.headers == ["订单ID", "下单时间", "支付时间", "实收金额", "订单状态"] and t.encoding == "utf-8"
    assert rows(t)[0][3] == "1,100.00" and rows(t)[1][2] == "" and len(rows(t)) == 4


def test_encodings_and_delimiters(spark, tmp_path):
    assert rows(tables.load_table(spark, put(tmp_path / "a.csv", "门店,金额\n上海,1\n", "gbk"))) == [("上海", "1")]
    assert tables.load_table(spark, put(tmp_path / "b.csv", COUPONS)).headers[0] == "券码"
    assert rows(tables.load_table(spark, put(tmp_path / "c.tsv", "a\tb\n1\t2,3\n"))) == [("1", "2,3")]


def test_title_ragged_rows_and_headers(spark, tmp_path):
    text = "导出报表,,\n\nid,金额,,金额\n1,2,,3\n4\n,,,\n5,6,,7,extra\n"
    t = tables.load_table(spark, put(tmp_path / "x.csv", text))
    assert t.headers == ["id", "金额", "(空列3)", "金额__2", "(空列5)"]
    assert rows(t) == [("1", "2", "", "3", ""), ("4", "", "", "", ""), ("5", "6", "", "7", "extra")]
    assert any("repeated" in n for n in t.notes)


@pytest.mark.parametrize(("name", "data"), [("a.xls", b"x"), ("b.csv", b""), ("c.csv", b"a\x00b,c\n"), ("d.parquet", b"x")])
def test_refused_files(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path / name))
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "none.csv"))


def test_sheet_cells():
    assert [tables.sheet_text(v) for v in (None, 12.0, 7.00123e17, 1.5, True, False)] == ["", "12", "7.00123e+17", "1.5", "TRUE", "FALSE"]
    stamps = (datetime.datetime(2024, 8, 1), datetime.datetime(2024, 8, 1, 9, 5), datetime.date(2024, 8, 1), datetime.time(9, 5), datetime.time())
    assert [tables.sheet_text(v) for v in stamps] == ["2024-08-01", "2024-08-01 09:05:00", "2024-08-01", "09:05:00", "00:00:00"]


def test_profile_of_a_file(spark, tmp_path):
    t = tables.load_table(spark, put(tmp_path / "orders.csv", ORDERS))
    out = {c["column"]: c for c in profile.profile(t.df.drop(tables.ROW))}
    assert out["订单ID"]["kind"] == "ID" and out["支付时间"]["blank"] == 1 and out["实收金额"]["marked"] == 2
    assert out["实收金额"]["total"] == Decimal("1150.0000") and out["订单ID"]["distinct"] == 3
    assert profile.grain(list(out.values()))[0]["grain"] == "一行一个订单"


def test_facts_and_report(tmp_path):
    rate = {"rate": {"value": "0.5", "numerator": 1, "denominator": 2, "meta": {"n_eligible": 2, "n_hit": 1}}}
    fact = facts.rate_fact(rate, "核销率", "cohort.json")
    assert "50%" in facts.fact_line(fact) and "1 / 2" in facts.fact_line(fact)
    assert "无法计算" in facts.fact_line({"label": "x", "value": None, "reason": "分母为零"})
    assert "0.1235" in facts.fact_line({"label": "x", "value": "0.123456"})
    sinks.write_facts([fact], str(tmp_path / "f.json"))
    sinks.write_facts([{"label": "b", "value": Decimal("1.50")}], str(tmp_path / "g.json"), merge=str(tmp_path / "f.json"))
    assert [f["label"] for f in sinks.load_facts(str(tmp_path / "g.json"))] == ["核销率", "b"]
    text = report.scaffold(sinks.load_facts(str(tmp_path / "g.json")))
    assert "核销率：50%" in text and text.count("- [ ]") == 12
    assert all(x in text for x in (*report.RED_LINES, *guards.LABELS))
    r = facts.Result(None, reason="分母为零")
    assert not r.ok and "0.00" not in r.display() and facts.Result(Decimal("0.25")).display(as_percent=True) == "25.00%"


def test_commands(spark, tmp_path, capsys):
    orders, coupons = put(tmp_path / "orders.csv", ORDERS), put(tmp_path / "coupons.csv", COUPONS)
    args = ["join", "--left", orders, "--right", coupons, "--left-key", "订单ID", "--right-key", "订单ID", "--left-value", "实收金额", "--right-value", "核销金额"]
    assert cli.main(args, spark) == 2 and reconcile.FAIL in capsys.readouterr().out
    assert cli.main([*args, "--aggregate"], spark) == 0
    assert cli.main(["contract", orders, str(tmp_path / "no.csv")], spark) == 1
    assert "无法读取" in capsys.readouterr().out
    assert cli.main(["group", coupons, "--by", "订单ID", "--value", "核销金额"], spark) == 0
    assert cli.main(["duplicates", orders, "--by", "订单ID", "--value", "实收金额"], spark) == 0
    assert cli.main(["partition", orders, "--by", "订单状态"], spark) == 0
    table = str(tmp_path / "objects.csv")
    assert cli.main(["object-table", "--objects", orders, "--events", coupons, "--key", "订单ID", "--time", "核销时间", "--out", table], spark) == 0
    made = tables.load_table(spark, table)
    assert made.df.count() == 4 and "event_time_first" in made.headers
    rate = str(tmp_path / "rate.json")
    args = ["cohort", table, "--key", "订单ID", "--t0", "支付时间", "--event", "event_time_first", "--cutoff", "2024-08-25 00:00:00", "--json", rate]
    assert cli.main([*args, "--curve", "24", "72"], spark) == 0
    held = json.loads(open(rate, encoding="utf-8").read())
    assert (held["rate"]["numerator"], held["rate"]["denominator"]) == (1, 2)
    assert cli.main(["facts", rate, "--label", "核销率", "--out", str(tmp_path / "facts.json")], spark) == 0
    assert cli.main(["report", str(tmp_path / "facts.json")], spark) == 0 and "核销率：50%" in capsys.readouterr().out
    status = ["cohort", orders, "--key", "订单ID", "--t0", "支付时间", "--event", "订单状态", "--cutoff", "2024-08-25", "--curve", "24"]
    assert cli.main(status, spark) == 2


def test_value_fact():
    fact = facts.value_fact("3,120.50", unit="元", source="订单表")
    assert (fact["label"], fact["value"], fact["unit"], fact["numerator"], fact["as_percent"]) == ("未命名指标", "3,120.50", "元", None, False)
    assert facts.fact_line(fact) == "- 未命名指标：3,120.50　[来源：订单表]"
    assert facts.value_fact("0.05", "退款率", as_percent=True, numerator="1", denominator="20")["denominator"] == "20"


def test_suggestions(spark):
    from tallyforge.operators import profile

    df = spark.createDataFrame([("1", "2024-08-01", "x", i) for i in range(5)], "`券码` string, made string, note string, __rid long")
    assert profile.suggest(df) == {"time": ["made"], "id": ["券码"], "money": [], "export_time": []}
    named = spark.createDataFrame([("1", "a")], "`生成时间` string, `实付金额` string")
    assert profile.suggest(named) == {"time": ["生成时间"], "id": [], "money": ["实付金额"], "export_time": ["生成时间"]}


def test_dates_of_files_and_gaps(spark, tmp_path):
    day = datetime.date(2024, 8, 9)
    columns = [{"column": "日期", "kind": "时间", "parsed": 2, "first": datetime.datetime(2024, 8, 1), "last": datetime.datetime(2024, 8, 9, 12)}]
    assert profile.file_date_note(day, columns)[0] is True and profile.file_date_note(datetime.date(2024, 8, 10), columns)[0] is False
    assert profile.file_date_note(None, columns) == (None, "") and profile.file_date_note(day, [])[0] is None
    exported = [{**columns[0], "column": "导出时间"}]
    assert profile.file_date_note(day, exported)[0] is None

    df = spark.createDataFrame([("2024-08-01",), ("2024/8/2",), ("2024-08-05",)], "`日期` string")
    assert profile.daily_gaps(df, columns).count() == 2
    store, order = {"column": "门店ID", "kind": "ID"}, {"column": "订单ID", "kind": "ID"}
    assert profile.daily_gaps(df, [*columns, store]).count() == 2 and profile.daily_gaps(df, [*columns, order]) is None and profile.daily_gaps(df, []) is None

    daily = put(tmp_path / "spend_20240901.csv", "日期,消耗\n2024-08-01,1\n2024-08-02,2\n2024-08-05,3\n")
    text, failed = cli.contract(spark, [daily])
    assert not failed and "不在数据时间之内" in text and "2 天没有数据，最早 2024-08-03，最晚 2024-08-04" in text
