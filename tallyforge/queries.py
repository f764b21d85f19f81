"""Named queries over the driver's tables, one for each operator or group of operators, each beside SQL that says the same.

Money is cast to decimals before it is summed, so that sums don't depend on order; results are doubles rounded to six
places, whole numbers, text or booleans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import cells
from tallyforge.operators import cohort, columns, distribution, profile, ratios, reconcile
from tallyforge.plans import guards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dec(name: str, places: int = 2) -> Column:
    return F.col(name).cast(f"decimal(18,{places})")


def num(c: Column | str, places: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places)


def whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def nums(df: DataFrame, doubles: list[str] = (), longs: list[str] = ()) -> DataFrame:
    return df.withColumns({**{c: num(c) for c in doubles}, **{c: whole(c) for c in longs}})


# --- ratios ---------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS numerator,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS denominator, count(*) AS n_groups,
    round(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 9) AS ratio
    FROM lineitem GROUP BY l_returnflag""")
def pooled_ratio(spark, sf_dir):
    out = ratios.pooled_ratio(table(spark, sf_dir, "lineitem"), dec("l_discount"), dec("l_extendedprice"), ["l_returnflag"])
    return out.select("l_returnflag", num("numerator"), num("denominator"), whole("n_groups").alias("n_groups"), num("ratio", 9).alias("ratio")).toDF(
        "l_returnflag", "numerator", "denominator", "n_groups", "ratio"
    )


@query("""WITH g AS (SELECT c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS spend,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(18,2)) * 2 END AS gmv,
    CAST(1.5 AS DECIMAL(4,2)) AS roi FROM customer WHERE c_acctbal > 0)
    SELECT c_mktsegment, CAST(sum(coalesce(gmv, spend * roi)) AS DOUBLE) AS numerator, CAST(sum(spend) AS DOUBLE) AS denominator,
    round(CAST(sum(coalesce(gmv, spend * roi)) AS DOUBLE) / CAST(sum(spend) AS DOUBLE), 6) AS ratio FROM g GROUP BY c_mktsegment""")
def pooled_roi(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    spend = dec("c_acctbal")
    gmv = F.when(F.col("c_custkey") % 3 != 0, spend * 2)
    out = ratios.pooled_roi(c, spend, gmv, F.lit(1.5).cast("decimal(4,2)"), ["c_mktsegment"])
    return nums(out.select("c_mktsegment", "numerator", "denominator", "ratio"), ["numerator", "denominator", "ratio"])


@query("""WITH g AS (SELECT l_suppkey, sum(CAST(l_discount AS DECIMAL(18,2))) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS d FROM lineitem GROUP BY l_suppkey)
    SELECT round(avg(CAST(n AS DOUBLE) / CAST(d AS DOUBLE)), 6) AS naive, round(CAST(sum(n) AS DOUBLE) / CAST(sum(d) AS DOUBLE), 6) AS pooled FROM g WHERE d <> 0""")
def naive_vs_pooled(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(dec("l_discount")).alias("n"), F.sum(dec("l_quantity")).alias("d"))
    naive = F.avg(F.try_divide(F.col("n").cast("double"), F.col("d").cast("double")))
    pooled = F.try_divide(F.sum("n").cast("double"), F.sum("d").cast("double"))
    return g.where("d <> 0").agg(num(naive).alias("naive"), num(pooled).alias("pooled"))


@query("""WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS n,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 11 + 1 END AS d FROM orders)
    SELECT CASE WHEN n IS NULL THEN '分子缺失' WHEN d IS NULL THEN '分母缺失' WHEN d = 0 THEN '分母为零' ELSE 'ok' END AS reason, count(*) AS n_rows,
    round(CAST(sum(CASE WHEN d <> 0 THEN CAST(n AS DOUBLE) / d END) AS DOUBLE), 2) AS total FROM g GROUP BY 1""")
def safe_div_reasons(spark, sf_dir):
    k = F.col("o_orderkey")
    n = F.when(k % 5 != 0, dec("o_totalprice"))
    d = F.when(k % 7 == 0, None).when(k % 3 == 0, 0).otherwise(k % 11 + 1).cast("decimal(18,2)")
    rows = table(spark, sf_dir, "orders").select(F.coalesce(cells.div_reason(n, d), F.lit("ok")).alias("reason"), cells.quotient(n, d).alias("q"))
    return rows.groupBy("reason").agg(F.count("*").alias("n_rows"), num(F.sum("q"), 2).alias("total"))


@query("""SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n,
    round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_orderpriority""")
def mean_with_missing(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 4 != 0, dec("o_totalprice"))
    out = ratios.mean(table(spark, sf_dir, "orders"), value, ["o_orderpriority"])
    return out.select("o_orderpriority", num("total").alias("total"), "n", num("mean", 4).alias("mean"))


@query("""WITH g AS (SELECT l_returnflag, sum(CAST(l_tax AS DECIMAL(18,2))) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS d FROM lineitem GROUP BY l_returnflag)
    SELECT round(sum(CASE l_returnflag WHEN 'A' THEN 0.25 WHEN 'N' THEN 0.5 ELSE 0.25 END * CAST(n AS DOUBLE) / CAST(d AS DOUBLE)), 8) AS ratio FROM g""")
def standardized_ratio(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(dec("l_tax")).alias("n"), F.sum(dec("l_quantity")).alias("d"))
    weight = F.when(F.col("l_returnflag") == "N", 0.5).otherwise(0.25)
    return ratios.standardised_ratio(g, weight, F.col("n"), F.col("d")).select(num("ratio", 8).alias("ratio"))


@query("""WITH g AS (SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 4 <> 1 THEN 1 END AS n, CASE WHEN n_nationkey % 5 <> 2 THEN n_nationkey % 3 END AS d FROM nation),
    r AS (SELECT *, CASE WHEN n IS NULL THEN '分子缺失' WHEN d IS NULL THEN '分母缺失' WHEN d = 0 THEN '分母为零' END AS reason FROM g)
    SELECT 'pooled' AS kind, CAST(nation AS BIGINT) AS nation, reason FROM r WHERE n IS NULL OR d IS NULL
    UNION ALL SELECT 'standardised', CAST(nation AS BIGINT), reason FROM r WHERE reason IS NOT NULL""")
def excluded_groups(spark, sf_dir):
    k = F.col("n_nationkey")
    g = table(spark, sf_dir, "nation").select(whole(k).alias("nation"), F.when(k % 4 != 1, 1).alias("n"), F.when(k % 5 != 2, k % 3).alias("d"))
    both = (("pooled", False), ("standardised", True))
    parts = [ratios.excluded_groups(g, ["nation"], F.col("n"), F.col("d"), zero).withColumn("kind", F.lit(kind)) for kind, zero in both]
    return parts[0].unionByName(parts[1])


@query("""WITH y AS (SELECT year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1)
    SELECT CAST(y AS BIGINT) AS y, CAST(v AS DOUBLE) AS v, CAST(v - lag(v) OVER (ORDER BY y) AS DOUBLE) AS delta,
    round(CAST(v - lag(v) OVER (ORDER BY y) AS DOUBLE) / CAST(lag(v) OVER (ORDER BY y) AS DOUBLE), 6) AS relative FROM y""")
def changes(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sum(dec("o_totalprice")).alias("v"))
    return nums(distribution.changes(y, "y", "v").select("y", "v", "delta", "relative"), ["v", "delta", "relative"], ["y"])


@query("""WITH y AS (SELECT year(o_orderdate) AS y, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY 1),
    s AS (SELECT y, CAST(k * 10000 // n AS DECIMAL(12,4)) / 10000 AS share FROM y)
    SELECT CAST(y AS BIGINT) AS y, round(CAST(share AS DOUBLE), 6) AS share, round(CAST((share - lag(share) OVER (ORDER BY y)) * 100 AS DOUBLE), 4) AS points, '个百分点' AS unit FROM s""")
def point_changes(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    shares = y.select("y", (F.expr("k * 10000 div n").cast("decimal(12,4)") / 10000).cast("decimal(12,6)").alias("share"))
    base = F.lag("share").over(Window.orderBy("y"))  # a row per year
    return shares.select(whole("y").alias("y"), num("share").alias("share"), num(distribution.point_change(F.col("share"), base), 4).alias("points"), F.lit("个百分点").alias("unit"))


@query("""WITH g AS (SELECT p_brand, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
    w AS (SELECT *, CAST(k AS DOUBLE) / n AS p, 1.96 * 1.96 AS zz FROM g)
    SELECT p_brand, k, n, round(p, 6) AS rate,
    round(greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 6) AS low,
    round(least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 6) AS high FROM w""")
def wilson(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = lines.groupBy("p_brand").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n"))
    return nums(g.withColumns(ratios.wilson(F.col("k"), F.col("n"))), ["rate", "low", "high"])


@query("""SELECT count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS n_hit, count(DISTINCT l_orderkey) AS n_all,
    round(CAST(count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS DOUBLE) / count(DISTINCT l_orderkey), 6) AS ratio FROM lineitem""")
def refund_order_ratio(spark, sf_dir):
    out = ratios.count_ratio(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", F.col("l_orderkey"))
    return nums(out, ["ratio"])


# --- cells -----------------------------------------------------------------------------------------------------------


def _dirty_money() -> Column:
    k, v = F.col("o_orderkey"), dec("o_totalprice").cast("string")
    return (
        F.when(k % 9 == 0, "-").when(k % 9 == 1, F.concat(F.lit("¥"), v)).when(k % 9 == 2, F.concat(F.lit("("), v, F.lit(")")))
        .when(k % 9 == 3, F.concat(v, F.lit("元"))).when(k % 9 == 4, F.concat(F.lit(" "), F.format_number(dec("o_totalprice"), 2)))
        .when(k % 9 == 5, "5%").when(k % 9 == 6, "abc").otherwise(v)
    )


@query("""WITH g AS (SELECT o_orderkey % 9 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders),
    c AS (SELECT k, CASE WHEN k IN (0, 6) THEN NULL WHEN k = 2 THEN -v WHEN k = 5 THEN 0.05 ELSE v END AS v FROM g)
    SELECT k, count(*) AS n_rows, count(v) AS n_parsed, round(CAST(sum(v) AS DOUBLE), 2) AS total FROM c GROUP BY k""")
def parse_money(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9).alias("k"), cells.to_decimal(_dirty_money()).alias("v"))
    return rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.count("v").alias("n_parsed"), num(F.sum("v"), 2).alias("total"))


@query("""WITH g AS (SELECT o_orderkey % 9 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders),
    c AS (SELECT k, CASE WHEN k IN (0, 6) THEN NULL WHEN k = 2 THEN -v WHEN k = 5 THEN 5 ELSE v END AS v FROM g)
    SELECT k, count(*) FILTER (k = 0) AS n_missing, count(*) FILTER (k = 6) AS n_bad, round(CAST(sum(v) AS DOUBLE), 2) AS total FROM c GROUP BY k""")
def parse_strict(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9).alias("k"), cells.strict_number(_dirty_money()).alias("x"))
    return rows.groupBy("k").agg(
        F.count_if("x.is_missing").alias("n_missing"), F.count_if("x.is_bad").alias("n_bad"), num(F.sum("x.value"), 2).alias("total")
    )


@query("""SELECT o_orderkey % 6 AS k, count(*) AS n_rows, count(CASE WHEN o_orderkey % 6 < 5 THEN 1 END) AS n_parsed,
    CASE WHEN o_orderkey % 6 < 5 THEN strftime(min(o_orderdate), '%Y-%m-%d') END AS first_day,
    CASE WHEN o_orderkey % 6 < 5 THEN strftime(max(o_orderdate), '%Y-%m-%d') END AS last_day FROM orders GROUP BY 1""")
def parse_time(spark, sf_dir):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy/M/d", "yyyyMMdd", "yyyy年M月d日", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.lit("08/01/2024")
    for i, f in enumerate(formats):
        text = F.when(k == i, F.date_format(d, f)).otherwise(text)
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), cells.parse_time(text).alias("t"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.groupBy("k").agg(
        F.count("*").alias("n_rows"), F.count("t").alias("n_parsed"), day(F.min("t")).alias("first_day"), day(F.max("t")).alias("last_day")
    )


@query("""SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey % 10 = 0) AS n_blank, count(*) FILTER (o_orderkey % 10 IN (1, 2)) AS n_marked,
    count(*) FILTER (o_orderkey % 10 = 3) AS n_zero, count(*) FILTER (o_orderkey % 10 > 2) AS n_real FROM orders""")
def missing_profile(spark, sf_dir):
    return profile.missing_counts(_marked(spark, sf_dir), "v")


@query("""SELECT CASE o_orderkey % 10 WHEN 1 THEN 'N/A' ELSE '暂无' END AS label, count(*) AS n FROM orders WHERE o_orderkey % 10 IN (1, 2) GROUP BY 1""")
def missing_marks(spark, sf_dir):
    return profile.missing_marks(_marked(spark, sf_dir), "v")


def _marked(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey") % 10
    v = F.when(k == 0, "  ").when(k == 1, "Ｎ/Ａ").when(k == 2, " 暂无").when(k == 3, "0").otherwise(dec("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select(v.alias("v"))


@query("""WITH k AS (SELECT p_type AS v FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT 'SKU' || p_partkey FROM part
    UNION ALL SELECT '门店' || (p_partkey % 3) FROM part UNION ALL SELECT '2024-01-' || (p_partkey % 28 + 1) FROM part UNION ALL SELECT ' ' FROM part)
    SELECT CASE WHEN trim(v) = '' THEN '空' WHEN regexp_full_match(v, '2024-01-[0-9]+') THEN '日期' WHEN regexp_full_match(v, '[0-9]+') THEN '纯数字'
    WHEN regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') THEN '字母数字' WHEN v LIKE '门店%' THEN '含中文' ELSE '其他' END AS shape,
    count(*) AS n FROM k GROUP BY 1""")
def key_shape(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = k.cast("string")
    every = [F.col("p_type"), text, F.concat(F.lit("SKU"), text), F.concat(F.lit("门店"), (k % 3).cast("string")), F.concat(F.lit("2024-01-"), (k % 28 + 1).cast("string")), F.lit(" ")]
    rows = p.select(F.explode(F.array(*every)).alias("v"))
    return rows.groupBy(cells.key_shape(cells.norm_key(F.col("v"))).alias("shape")).agg(F.count("*").alias("n"))


# --- profiles ----------------------------------------------------------------------------------------------------------


@query("""SELECT count(c_acctbal) AS n_numeric, CAST(0 AS BIGINT) AS n_bad, CAST(0 AS BIGINT) AS n_missing, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total,
    CAST(min(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS least, CAST(max(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS most,
    count(*) FILTER (CAST(c_acctbal AS DECIMAL(18,2)) < 0) AS n_negative, count(*) FILTER (CAST(c_acctbal AS DECIMAL(18,2)) = 0) AS n_zero FROM customer""")
def profile_money(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(dec("c_acctbal").cast("string").alias("amount"))
    return nums(profile.money_profile(c, "amount"), ["total", "least", "most"])


@query("""WITH c AS (SELECT CASE WHEN l_orderkey % 50 = 0 THEN '7.0E+15' WHEN l_orderkey % 50 = 1 THEN '00' || l_orderkey WHEN l_orderkey % 50 = 2 THEN l_orderkey || '.0' ELSE CAST(l_orderkey AS VARCHAR) END AS c, l_orderkey AS k FROM lineitem)
    SELECT count(*) AS n_rows, count(DISTINCT c) AS n_distinct, count(*) - count(DISTINCT c) AS n_duplicates, count(*) FILTER (k % 50 = 0) AS n_scientific,
    count(*) FILTER (k % 50 = 2) AS n_float_tail, count(*) FILTER (k % 50 = 1) AS n_leading_zero, min(length(c)) AS shortest, max(length(c)) AS longest FROM c""")
def profile_id(spark, sf_dir):
    k, text = F.col("l_orderkey") % 50, F.col("l_orderkey").cast("string")
    c = F.when(k == 0, "7.0E+15").when(k == 1, F.concat(F.lit("00"), text)).when(k == 2, F.concat(text, F.lit(".0"))).otherwise(text)
    return nums(profile.id_profile(table(spark, sf_dir, "lineitem").select(c.alias("id")), "id"), [], ["shortest", "longest"])


@query("""SELECT CAST(length(CAST(l_orderkey AS VARCHAR)) AS BIGINT) AS digits, count(*) AS n FROM lineitem GROUP BY 1""")
def digit_lengths(spark, sf_dir):
    return nums(profile.digit_lengths(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id")), "id"), [], ["digits"])


@query("""SELECT count(*) AS n_real, count(*) AS n_parsed, CAST(0 AS BIGINT) AS n_failed, strftime(min(o_orderdate), '%Y-%m-%d') AS first_time,
    strftime(max(o_orderdate), '%Y-%m-%d') AS last_time, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS BIGINT) AS span_days FROM orders""")
def profile_time(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy/MM/dd").alias("t"))
    out = profile.time_profile(rows, "t")
    return out.withColumns({"first_time": F.date_format("first_time", "yyyy-MM-dd"), "last_time": F.date_format("last_time", "yyyy-MM-dd"), "span_days": whole("span_days")})


@query("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'yyyy/M/d' ELSE 'yyyyMMdd' END AS format, count(*) AS n FROM orders GROUP BY 1""")
def time_formats(spark, sf_dir):
    t = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return profile.time_formats(table(spark, sf_dir, "orders").select(t.alias("t")), "t")


@query("""WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), h AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 10)
    SELECT value, n, CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM h) AS BIGINT) AS n_other FROM h""")
def profile_status(spark, sf_dir):
    return profile.status_profile(table(spark, sf_dir, "part").select(F.col("p_brand").alias("status")), "status")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, count(*) FILTER (n > 1) AS n_repeated, CAST(sum(n - 1) AS BIGINT) AS n_extra FROM g""")
def full_row_dups(spark, sf_dir):
    return profile.full_row_duplicates(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@query("""WITH n AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS a, count(DISTINCT o_custkey) AS b, count(DISTINCT o_orderpriority) AS c FROM orders)
    SELECT 'o_orderkey' AS "column", a AS n_distinct, n AS n_rows, a = n AS is_key FROM n UNION ALL SELECT 'o_custkey', b, n, b = n FROM n
    UNION ALL SELECT 'o_orderpriority', c, n, c = n FROM n""")
def candidate_keys(spark, sf_dir):
    return profile.candidate_keys(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1""")
def rows_per_day(spark, sf_dir):
    return profile.rows_per_day(table(spark, sf_dir, "events"), F.col("ts")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE day(ts) % 5 <> 2), s AS (SELECT min(d) AS a, max(d) AS b FROM d)
    SELECT strftime(x, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS x FROM s) WHERE CAST(x AS DATE) NOT IN (SELECT d FROM d)""")
def missing_days(spark, sf_dir):
    some = table(spark, sf_dir, "events").where(F.dayofmonth("ts") % 5 != 2)
    return profile.missing_days(some, F.col("ts")).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS d, sum(CAST(value AS DECIMAL(18,4))) AS v FROM events WHERE ts < TIMESTAMP '2024-01-30 06:00:00' GROUP BY 1),
    l AS (SELECT max(d) AS d, count(*) AS n FROM d), o AS (SELECT quantile_cont(CAST(v AS DOUBLE), 0.5) AS m FROM d WHERE d < (SELECT d FROM l))
    SELECT strftime(l.d, '%Y-%m-%d') AS last_day, round(CAST(v AS DOUBLE), 4) AS last_sum, n AS n_days, round(m, 4) AS median_others, round(CAST(v AS DOUBLE) / m, 4) AS ratio,
    n >= 4 AND CAST(v AS DOUBLE) / m < 0.5 AS is_partial FROM l JOIN d USING (d), o""")
def partial_last_day(spark, sf_dir):
    some = table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-30 06:00:00").cast("timestamp_ntz"))
    out = profile.partial_last_day(some, F.col("ts"), F.col("value").cast("decimal(18,4)"))
    return out.select(
        F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), num("last_sum", 4).alias("last_sum"), "n_days",
        num("median_others", 4).alias("median_others"), num("ratio", 4).alias("ratio"), "is_partial",
    )


@query("""WITH c AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS m, CASE WHEN o_orderkey % 9 = 6 THEN 1 ELSE 0 END AS b FROM orders)
    SELECT 'amount' AS "column", count(*) AS n_rows, CAST(sum(m) AS BIGINT) AS missing, CAST(sum(b) AS BIGINT) AS bad, CAST(count(*) - sum(m) - sum(b) AS BIGINT) AS parsed,
    round(CAST(count(*) - sum(m) - sum(b) AS DOUBLE) / (count(*) - sum(m)), 6) AS numeric_share, false AS looks_like_date, false AS looks_like_id FROM c
    UNION ALL SELECT 'day', count(*), 0, 0, count(*), 1.0, true, false FROM orders
    UNION ALL SELECT 'code', count(*), 0, 0, count(*), 1.0, false, true FROM orders
    UNION ALL SELECT 'status', count(*), 0, count(*), 0, 0.0, false, false FROM orders""")
def column_stats(spark, sf_dir):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 300).cast("int")), "yyyyMMdd")
    rows = table(spark, sf_dir, "orders").select(
        _dirty_money().alias("amount"), day.alias("day"), (F.col("o_orderkey") + 7000000000000).cast("string").alias("code"), F.col("o_orderstatus").alias("status")
    )
    out = columns.column_stats(rows, rows.columns)
    return nums(out.select("column", "n_rows", "missing", "bad", "parsed", "numeric_share", "looks_like_date", "looks_like_id"), ["numeric_share"])


@query("""SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS numerator, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS denominator,
    round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 4) AS ratio,
    '平台归因，模型：末次点击，窗口：7天；不等于新增' AS scope FROM lineitem""")
def attribution_roi(spark, sf_dir):
    out = ratios.attribution_roi(table(spark, sf_dir, "lineitem"), dec("l_extendedprice"), dec("l_quantity"), "末次点击", "7天")
    return out.select(num("numerator").alias("numerator"), num("denominator").alias("denominator"), num("ratio", 4).alias("ratio"), "scope")


@query("""SELECT '订单数' AS label, count(DISTINCT l_orderkey) AS n_keys, count(*) AS n_rows FROM lineitem""")
def key_report(spark, sf_dir):
    return columns.key_report(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("订单ID")), "订单ID")


@query("""SELECT * FROM (VALUES ('time', '下单时间'), ('time', '导出日期'), ('id', '订单编号'), ('money', '实付金额'), ('export_time', '导出日期')) t(role, "column")""")
def suggested_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("订单编号"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("下单时间"), dec("o_totalprice").cast("string").alias("实付金额"),
        F.col("o_orderstatus").alias("订单状态"), F.lit("2024-08-01").alias("导出日期"), F.lit("2").alias("退款笔数"),
    )
    rows = [(role, c) for role, found in profile.suggest(o).items() for c in found]
    return spark.createDataFrame(rows, "role string, column string")


@query("""SELECT 'time' AS role, 'seen' AS "column" UNION ALL SELECT 'id', '用户ID'""")
def suggested_by_value(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("用户ID"), F.date_format("ts", "yyyy/M/d H:mm:ss").alias("seen"), F.col("event_type").alias("what"))
    rows = [(role, c) for role, found in profile.suggest(e).items() for c in found]
    return spark.createDataFrame(rows, "role string, column string")


# --- joins -------------------------------------------------------------------------------------------------------------


@query("""SELECT n AS rows_per_key, count(*) AS n_keys FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n""")
def key_multiplicity(spark, sf_dir):
    return reconcile.multiplicity(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"))


@query("""WITH l AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)), r AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))
    SELECT CASE WHEN l.m <= 1 AND r.m <= 1 THEN '一对一' WHEN l.m <= 1 THEN '一对多' WHEN r.m <= 1 THEN '多对一' ELSE '多对多' END AS relationship FROM l, r""")
def relationship(spark, sf_dir):
    left = reconcile.key_counts(table(spark, sf_dir, "orders"), F.col("o_orderkey")).agg(F.max("n").alias("a"))
    right = reconcile.key_counts(table(spark, sf_dir, "lineitem"), F.col("l_orderkey")).agg(F.max("n").alias("b"))
    return left.join(right).select(reconcile.relationship(F.col("a"), F.col("b")).alias("relationship"))


AUDIT_SQL = """WITH o AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders WHERE {l}), li AS (SELECT l_orderkey AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem WHERE {r}),
    j AS (SELECT o.k, o.v AS lv, li.v AS rv FROM o JOIN li USING (k)), b AS (SELECT (SELECT sum(v) FROM o) AS lb, (SELECT sum(v) FROM li) AS rb,
    (SELECT sum(v) FROM o WHERE k IN (SELECT k FROM li)) AS lm, (SELECT sum(v) FROM li WHERE k IN (SELECT k FROM o)) AS rm, (SELECT sum(lv) FROM j) AS la, (SELECT sum(rv) FROM j) AS ra,
    (SELECT count(*) FROM j) AS pairs, (SELECT count(*) FROM o WHERE k IN (SELECT k FROM li)) AS ml, (SELECT count(*) FROM li WHERE k IN (SELECT k FROM o)) AS mr,
    (SELECT count(DISTINCT k) FROM j) AS mk, (SELECT count(*) FROM o WHERE k NOT IN (SELECT k FROM li)) AS ul, (SELECT count(DISTINCT k) FROM o WHERE k NOT IN (SELECT k FROM li)) AS ulk,
    (SELECT count(*) FROM li WHERE k NOT IN (SELECT k FROM o)) AS ur, (SELECT count(DISTINCT k) FROM li WHERE k NOT IN (SELECT k FROM o)) AS urk)
    SELECT CAST(lb AS DOUBLE) AS left_before, CAST(rb AS DOUBLE) AS right_before, CAST(lm AS DOUBLE) AS left_matched, CAST(rm AS DOUBLE) AS right_matched,
    CAST(la AS DOUBLE) AS left_after, CAST(ra AS DOUBLE) AS right_after, pairs AS matched_pairs, ml AS matched_left_rows, mr AS matched_right_rows, mk AS matched_keys,
    ul AS unmatched_left_rows, ulk AS unmatched_left_keys, ur AS unmatched_right_rows, urk AS unmatched_right_keys, '{rel}' AS relationship,
    la > lb AND la - lb > greatest(abs(lb) * 0.01, 0.01) AS left_amplified, ra > rb AND ra - rb > greatest(abs(rb) * 0.01, 0.01) AS right_amplified,
    (la > lm AND la - lm > greatest(abs(lm) * 0.01, 0.01)) OR (ra > rm AND ra - rm > greatest(abs(rm) * 0.01, 0.01)) AS matched_amplified,
    ml > 0 AND pairs > ml AS row_amplified, CASE WHEN (ml > 0 AND pairs > ml) THEN '失败-禁止使用该结果' ELSE '警告' END AS verdict FROM b"""
AUDIT_SUMS = ["left_before", "right_before", "left_matched", "right_matched", "left_after", "right_after"]


def _audit(left: DataFrame, right: DataFrame) -> DataFrame:
    out = reconcile.join_audit(left, right, F.col("o_orderkey"), F.col("l_orderkey"), dec("o_totalprice"), dec("l_extendedprice"))
    longs = ["matched_pairs", "matched_left_rows", "matched_right_rows", "matched_keys", *(f"unmatched_{s}_{w}" for s in ("left", "right") for w in ("rows", "keys"))]
    return nums(out, AUDIT_SUMS, longs)


@query(AUDIT_SQL.format(l="true", r="true", rel="一对多"))
def join_audit_direct(spark, sf_dir):
    return _audit(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


@query(AUDIT_SQL.format(l="o_orderkey % 3 <> 0", r="l_orderkey % 4 <> 0", rel="一对多"))
def join_audit_unmatched(spark, sf_dir):
    """With unmatched rows on both sides, which mask part of the growth."""
    return _audit(table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0"), table(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0"))


@query("""SELECT 'left' AS side, CAST(o_orderkey AS VARCHAR) AS key, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 2
    UNION ALL SELECT 'right', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 0) GROUP BY 2""")
def unmatched(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left = reconcile.unmatched(o, li, F.col("o_orderkey"), F.col("l_orderkey")).where("side = 'left'")
    return left.unionByName(reconcile.unmatched(o.where("o_orderkey % 100 <> 0"), li, F.col("o_orderkey"), F.col("l_orderkey")).where("side = 'right'"))


@query("""WITH l AS (SELECT CASE WHEN o_orderkey % 20 = 0 THEN '' WHEN o_orderkey % 20 = 1 THEN 'SKU' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS k FROM orders),
    u AS (SELECT k, count(*) AS n FROM l WHERE k = '' OR k NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem) GROUP BY k)
    SELECT CASE WHEN k = '' THEN '空' WHEN k LIKE 'SKU%' THEN '字母数字' ELSE '纯数字' END AS shape,
    CASE WHEN k = '' THEN '键缺失(空)' WHEN k LIKE 'SKU%' THEN '其他' ELSE '时间范围不同(键不存在于另一表)' END AS reason, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM u GROUP BY ALL""")
def unmatched_reason(spark, sf_dir):
    k, text = F.col("o_orderkey") % 20, F.col("o_orderkey").cast("string")
    left = table(spark, sf_dir, "orders").select(F.when(k == 0, " ").when(k == 1, F.concat(F.lit("SKU"), text)).otherwise(text).alias("k"))
    found = reconcile.unmatched_reasons(left, table(spark, sf_dir, "lineitem"), F.col("k"), F.col("l_orderkey")).where("side = 'left'")
    return found.groupBy("shape", "reason").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))


@query("""SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_keys, CAST(0 AS BIGINT) AS n_blank,
    (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) AS n_repeated, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) AS max_rows""")
def key_profile(spark, sf_dir):
    return reconcile.key_profile(table(spark, sf_dir, "lineitem"), F.col("l_orderkey")).drop("first_date", "last_date")


@query("""WITH r AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v, max(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1)
    SELECT o_orderpriority, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS left_total, CAST(sum(v) AS DOUBLE) AS right_total,
    CAST(sum(q) AS DOUBLE) AS quantity, CAST(sum(n) AS BIGINT) AS n_lines FROM orders JOIN r ON o_orderkey = l_orderkey GROUP BY 1""")
def aggregate_then_join(spark, sf_dir):
    plan = {"l_extendedprice": "sum", "l_quantity": "max"}
    lines = table(spark, sf_dir, "lineitem").withColumns({"l_extendedprice": dec("l_extendedprice"), "l_quantity": dec("l_quantity")})
    joined = reconcile.aggregate_then_join(table(spark, sf_dir, "orders"), lines, F.col("o_orderkey"), F.col("l_orderkey"), plan, number=lambda c: c)
    return joined.groupBy("o_orderpriority").agg(
        F.count("*").alias("n_orders"), num(F.sum(dec("o_totalprice"))).alias("left_total"), num(F.sum("right_l_extendedprice")).alias("right_total"),
        num(F.sum("right_l_quantity")).alias("quantity"), F.sum("right_n_rows").alias("n_lines"),
    )


def _shipped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders and lines with a key that is "-" in one of 40 orders, and lines without a time."""
    key = lambda c: F.when(F.col(c) % 40 == 0, "-").otherwise(F.col(c).cast("string")).alias("k")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", key("o_orderkey"))
    raw = F.when(F.col("l_linenumber") % 5 == 0, "无").when(F.col("l_linenumber") % 5 == 1, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return orders, table(spark, sf_dir, "lineitem").select(key("l_orderkey"), raw.alias("raw"))


@query("""SELECT o_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS first_ship, strftime(max(l_shipdate), '%Y-%m-%d') AS last_ship, count(l_orderkey) AS n_lines
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND o_orderkey % 40 <> 0 AND l_linenumber % 5 > 1 GROUP BY o_orderkey""")
def object_left_join(spark, sf_dir):
    orders, lines = _shipped(spark, sf_dir)
    out = reconcile.object_table(orders, lines, F.col("k"), F.col("k"), cells.parse_time(F.col("raw")), "ship")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("o_orderkey", day("ship_first").alias("first_ship"), day("ship_last").alias("last_ship"), F.col("ship_count").alias("n_lines"))


@query("""WITH e AS (SELECT l_orderkey AS k, l_linenumber % 5 AS m FROM lineitem WHERE l_orderkey % 40 <> 0), c AS (SELECT k, count(*) AS n FROM e GROUP BY 1)
    SELECT (SELECT count(*) FROM lineitem) AS event_rows, (SELECT count(*) FROM c) AS event_objects, (SELECT count(*) FROM c WHERE n > 1) AS repeated_objects,
    (SELECT max(n) FROM c) AS most_events, (SELECT count(*) FROM e WHERE m = 0) AS missing_times, (SELECT count(*) FROM e WHERE m = 1) AS bad_times,
    (SELECT count(*) FROM orders) AS object_rows, (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT k FROM c)) AS matched_rows,
    (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM c)) AS unmatched_rows""")
def object_audit(spark, sf_dir):
    orders, lines = _shipped(spark, sf_dir)
    return reconcile.object_audit(orders, lines, F.col("k"), F.col("k"), cells.parse_time(F.col("raw")), F.col("raw"))


@query("""WITH r AS (SELECT *, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS o FROM lineitem)
    SELECT CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n_rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(max(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS most,
    CAST(min(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS least, arg_min(l_returnflag, o) AS first_flag, arg_max(l_linestatus, o) AS last_status, count(DISTINCT l_suppkey) AS n_suppliers FROM r GROUP BY l_orderkey""")
def agg_methods(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumns({c: dec(c) for c in ("l_extendedprice", "l_quantity", "l_tax")})
    plan = {"l_extendedprice": "sum", "l_quantity": "max", "l_tax": "min", "l_returnflag": "first", "l_linestatus": "last", "l_suppkey": "nunique"}
    out = reconcile.aggregate(lines, F.col("l_orderkey"), plan, ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], number=lambda c: c)
    return out.select(
        "key", "n_rows", num("l_extendedprice").alias("total"), num("l_quantity").alias("most"), num("l_tax").alias("least"),
        F.col("l_returnflag").alias("first_flag"), F.col("l_linestatus").alias("last_status"), F.col("l_suppkey").alias("n_suppliers"),
    )


@query("""WITH f AS (SELECT l_orderkey, l_shipdate, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
    SELECT CAST(l_orderkey AS VARCHAR) AS key, string_agg(l_returnflag, '/' ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) FILTER (rn = 1) AS flags FROM f GROUP BY l_orderkey""")
def agg_list(spark, sf_dir):
    out = reconcile.aggregate(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), {"l_returnflag": "list"}, ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("key", F.col("l_returnflag").alias("flags"))


# --- groups and duplicates ---------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_mktsegment || CASE WHEN c_custkey % 7 = 0 AND c_mktsegment < 'G' THEN ' A' ELSE 'A' END AS grp, c_custkey AS k, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer),
    t AS (SELECT *, k % 6 = 0 AS gone, k % 6 <> 0 AND k % 5 = 0 AS bad FROM c),
    g AS (SELECT grp, count(*) AS n_rows, CAST(sum(CASE WHEN NOT gone AND NOT bad THEN v END) AS DOUBLE) AS sum_balance, count(*) FILTER (gone) AS missing_balance, count(*) FILTER (bad) AS bad_balance,
    min(CASE WHEN bad THEN 'x' || k END) AS least_bad_balance, max(CASE WHEN bad THEN 'x' || k END) AS greatest_bad_balance, count(*) FILTER (k % 6 = 0) AS missing_flag FROM t GROUP BY 1)
    SELECT *, count(*) OVER (PARTITION BY replace(grp, ' ', '')) > 1 AS only_space_differs FROM g""")
def group_sums(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, "-").when(k % 5 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(dec("c_acctbal").cast("string"))
    values = {"balance": cells.strict_number(text)["value"], "flag": F.when(k % 6 != 0, F.lit(1).cast("decimal(4,0)"))}
    tail = F.when((k % 7 == 0) & (F.col("c_mktsegment") < "G"), " A").otherwise("A")
    group = F.concat(F.lit(" "), F.col("c_mktsegment"), tail, F.lit("\u3000"))
    out = reconcile.group_sums(table(spark, sf_dir, "customer"), group, values, {"balance": text})
    return out.drop("sum_flag").withColumn("sum_balance", num("sum_balance"))


@query("""SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS group_total, count(DISTINCT c_mktsegment) AS n_groups,
    CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS table_total, CAST(0 AS DOUBLE) AS diff, true AS adds_up FROM customer""")
def additivity(spark, sf_dir):
    return nums(reconcile.additivity(table(spark, sf_dir, "customer"), F.col("c_mktsegment"), dec("c_acctbal")), ["group_total", "table_total", "diff"])


@query("""WITH l AS (SELECT DISTINCT p_type AS label FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) FROM part UNION SELECT DISTINCT '门店' || p_partkey FROM part
    UNION SELECT unnest(['合计', '全店合计', '总 计', '新客', '新客优惠券', '老客/新客', 'a/b', 'a', '券']))
    SELECT label, label IN ('合计', '总 计') AS is_summary, label LIKE '%/%' AS is_multi, (SELECT count(*) FROM l o WHERE o.label <> l.label AND contains(o.label, l.label)) AS contained_in FROM l""")
def partition_check(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    every = [F.col("p_type"), F.substring_index("p_type", " ", 1), F.concat(F.lit("门店"), F.col("p_partkey").cast("string"))]
    extra = spark.createDataFrame([(x,) for x in ("合计", "全店合计", "总 计", "新客", "新客优惠券", "老客/新客", "a/b", "a", " 券 ", "")], "g string")
    return reconcile.partition_labels(p.select(F.explode(F.array(*every)).alias("g")).unionByName(extra), F.col("g"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (p_type = split_part(p_type, ' ', 1)) AS n_same, count(*) AS n_related, true AS is_related FROM part""")
def partition_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("head", F.substring_index("p_type", " ", 1))
    return reconcile.partition_rows(p, "p_type", "head")


@query("""WITH r AS (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS v, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn,
    count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
    SELECT count(*) AS n_rows, count(*) FILTER (rn = 1) AS n_unique, count(*) FILTER (rn = 1 AND n > 1) AS n_repeated_keys, count(*) FILTER (rn > 1) AS n_extra_rows,
    CAST(sum(v) AS DOUBLE) AS sum_before, CAST(sum(v) FILTER (rn = 1) AS DOUBLE) AS sum_after FROM r""")
def dedupe_keys(spark, sf_dir):
    out = reconcile.dedupe_check(table(spark, sf_dir, "lineitem"), [F.col("l_orderkey"), F.col("l_linenumber")], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], dec("l_extendedprice"))
    return nums(out, ["sum_before", "sum_after"])


@query("""SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1 GROUP BY 1""")
def keep_first(spark, sf_dir):
    first = reconcile.keep_first(table(spark, sf_dir, "lineitem"), [F.col("l_orderkey")], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    return first.groupBy("l_returnflag").agg(F.count("*").alias("n"), num(F.sum(dec("l_extendedprice"))).alias("total"))


@query("""SELECT count(DISTINCT l_orderkey) FILTER (l_orderkey % 9 <> 0) AS n_objects, count(*) FILTER (l_orderkey % 9 = 0) AS n_missing, count(*) AS n_rows,
    round(CAST(count(*) AS DOUBLE) / count(DISTINCT l_orderkey) FILTER (l_orderkey % 9 <> 0), 6) AS rows_per_object FROM lineitem""")
def dedupe_count(spark, sf_dir):
    k = F.when(F.col("l_orderkey") % 9 == 0, "n/a").otherwise(F.col("l_orderkey").cast("string"))
    return nums(reconcile.dedupe_count(table(spark, sf_dir, "lineitem"), k), ["rows_per_object"])


# --- distributions -----------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS stdev, count(*) AS n, round(min(l_extendedprice), 4) AS min,
    round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
    round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(max(l_extendedprice), 4) AS max, round(stddev_samp(l_extendedprice) / avg(l_extendedprice), 4) AS cv FROM lineitem GROUP BY 1""")
def distribution_report(spark, sf_dir):
    out = distribution.report(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]).drop("n_missing")
    return out.select("l_returnflag", "n", *(num(c, 4).alias(c) for c in ("mean", "stdev", "min", "p25", "p50", "p75", "p90", "max", "cv")))


@query("""WITH b AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1)
    SELECT o_orderpriority, round(a - 0.3 * (b - a), 4) AS low, round(b + 0.3 * (b - a), 4) AS high, count(*) AS n_rows,
    count(*) FILTER (o_totalprice < a - 0.3 * (b - a) OR o_totalprice > b + 0.3 * (b - a)) AS n_outliers FROM orders JOIN b ON p = o_orderpriority GROUP BY ALL""")
def iqr_outliers(spark, sf_dir):
    out = distribution.iqr_outliers(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], 0.3)
    sums = out.groupBy("o_orderpriority", "low", "high").agg(F.count("*").alias("n_rows"), F.count_if("is_outlier").alias("n_outliers"))
    return sums.withColumns({"low": num("low", 4), "high": num("high", 4)})


@query("""WITH c AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1), h AS (SELECT v FROM c ORDER BY v DESC, o_custkey LIMIT 5)
    SELECT CAST((SELECT sum(v) FROM h) AS DOUBLE) AS head, CAST(sum(v) AS DOUBLE) AS total, round(CAST((SELECT sum(v) FROM h) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 6) AS share FROM c""")
def head_concentration(spark, sf_dir):
    return nums(distribution.head_concentration(table(spark, sf_dir, "orders"), "o_custkey", dec("o_totalprice")), ["head", "total", "share"])


# --- cohorts -----------------------------------------------------------------------------------------------------------

CUTOFF = "2001-07-01 00:00:00"


def _cutoff(text: str = CUTOFF) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _order_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")


@query(f"""WITH s AS (SELECT o_custkey, CASE WHEN o_orderkey % 17 = 0 THEN 'unparsable' WHEN o_orderdate + INTERVAL 720 HOUR <= TIMESTAMP '{CUTOFF}' THEN 'eligible' ELSE 'immature' END AS state FROM orders)
    SELECT state, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_objects FROM s GROUP BY 1""")
def mature_split(spark, sf_dir):
    t0 = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate"))
    return cohort.mature_split(table(spark, sf_dir, "orders"), t0, _cutoff(), 720, F.col("o_custkey"))


@query(f"""WITH o AS (SELECT o_orderkey, bool_or(coalesce(l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 720 HOUR, false)) AS hit FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderdate + INTERVAL 720 HOUR <= TIMESTAMP '{CUTOFF}' GROUP BY 1)
    SELECT count(*) AS n_eligible, count(*) FILTER (hit) AS n_hit, round(CAST(count(*) FILTER (hit) AS DOUBLE) / count(*), 6) AS rate FROM o""")
def cohort_rate(spark, sf_dir):
    out = cohort.cohort_rate(_order_lines(spark, sf_dir), F.col("o_orderkey"), F.col("o_orderdate"), F.col("l_shipdate"), _cutoff(), 720)
    return nums(out.drop("reason"), ["rate"])


@query(f"""WITH o AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS hit FROM orders WHERE o_orderdate + INTERVAL 720 HOUR <= TIMESTAMP '{CUTOFF}' GROUP BY 1)
    SELECT count(*) AS n_eligible, count(*) FILTER (hit) AS n_hit, round(CAST(count(*) FILTER (hit) AS DOUBLE) / count(*), 6) AS rate FROM o""")
def cohort_presence(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") == "F", "已完成").when(F.col("o_orderstatus") == "O", "否").otherwise("-")
    out = cohort.cohort_presence(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderdate"), flag, _cutoff(), 720)
    return nums(out.drop("reason"), ["rate"])


CURVE_SQL = """WITH o AS (SELECT o_orderkey, min(o_orderdate) AS t0, min(l_shipdate) {f} AS e FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderdate + INTERVAL 8760 HOUR <= TIMESTAMP '%s' GROUP BY 1), h AS (SELECT unnest([720.0, 2160.0, 8760.0])::DOUBLE AS hours),
    r AS (SELECT hours, count(*) AS n_eligible, count(*) FILTER (e > t0 AND e <= t0 + to_hours(CAST(hours AS BIGINT))) AS n_hit FROM o, h GROUP BY 1)
    SELECT hours, n_eligible, n_hit, round(CAST(n_hit AS DOUBLE) / n_eligible, 6) AS rate,
    round(CAST(n_hit AS DOUBLE) / n_eligible - lag(CAST(n_hit AS DOUBLE) / n_eligible) OVER (ORDER BY hours), 6) AS increase FROM r""" % CUTOFF


def _curve(spark, sf_dir, first_valid: bool) -> DataFrame:
    out = cohort.cohort_curve(_order_lines(spark, sf_dir), F.col("o_orderkey"), F.col("o_orderdate"), F.col("l_shipdate"), _cutoff(), (720, 2160, 8760), first_valid)
    return nums(out, ["rate", "increase"])


@query(CURVE_SQL.replace("{f}", ""))
def cohort_curve(spark, sf_dir):
    return _curve(spark, sf_dir, False)


@query(CURVE_SQL.replace("{f}", "FILTER (l_shipdate > o_orderdate)"))
def cohort_curve_first_valid(spark, sf_dir):
    return _curve(spark, sf_dir, True)


@query("""WITH u AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY 1), o AS (SELECT u.user_id, bool_or(coalesce(e.ts > t0 AND e.ts <= t0 + INTERVAL 24 HOUR, false)) AS hit
    FROM u LEFT JOIN events e ON e.user_id = u.user_id AND event_type = 'purchase' WHERE t0 + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT count(*) AS n_eligible, count(*) FILTER (hit) AS n_hit, round(CAST(count(*) FILTER (hit) AS DOUBLE) / count(*), 6) AS rate FROM o""")
def events_cohort(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    rows = first.join(e.where("event_type = 'purchase'").select("user_id", "ts"), "user_id", "left")
    out = cohort.cohort_rate(rows, F.col("user_id"), F.col("t0"), F.col("ts"), _cutoff("2024-01-20 00:00:00"), 24)
    return nums(out.drop("reason"), ["rate"])


@query("""SELECT count(*) AS n_present, CAST(0 AS BIGINT) AS n_parsed, false AS computable FROM orders WHERE o_orderkey % 5 <> 0""")
def status_as_time(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, "已完成").otherwise("-").alias("e"))
    return cohort.status_as_time(rows, "e", cells.parse_time(F.col("e")))


@query("""SELECT count(*) FILTER (event_type = 'view') AS visits, count(DISTINCT user_id) FILTER (event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11') AS buyers FROM events""")
def day_range(spark, sf_dir):
    """Whole calendar days, half open: from the first day to the one after the last."""
    ts = F.col("ts")
    inside = (ts >= F.lit("2024-01-05").cast("timestamp_ntz")) & (ts < (F.lit("2024-01-10").cast("date") + 1).cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").agg(
        F.count_if(F.col("event_type") == "view").alias("visits"),
        F.count_distinct(F.when((F.col("event_type") == "purchase") & inside, F.col("user_id"))).alias("buyers"),
    )


# --- guards ------------------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT event_type, count(*) AS n_records, count(DISTINCT CAST(ts AS DATE)) AS n_units FROM events GROUP BY 1)
    SELECT event_type, n_records, n_units, n_units >= 10 AS ok_to_infer, n_records <= n_units AS records_usable, CASE WHEN n_units >= 10 THEN '观察性差异' ELSE '数据不足' END AS label,
    concat_ws('；', CASE WHEN n_records > n_units THEN n_records || ' 条记录来自 ' || n_units || ' 个单位，组内相关' END, CASE WHEN n_units < 3 THEN '干预周期只有 ' || n_units || ' 个' END,
    CASE WHEN n_units < 10 THEN '独立单位只有 ' || n_units || ' 个，仅供探索' END) AS reasons FROM g""")
def units_guard(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_records"), F.count_distinct(F.to_date("ts")).alias("periods"))
    return g.withColumns(guards.independent_units(F.col("n_records"), F.col("periods"), F.lit(None).cast("long"))).drop("periods")


@query("""WITH b(a, c, r) AS (SELECT * FROM (VALUES (false), (true)) x(a), (VALUES (false), (true)) y(c), (VALUES (false), (true)) z(r))
    SELECT a, c, r, CASE WHEN r AND c THEN '已对账事实' WHEN c THEN '观察性差异' WHEN a THEN '待验证假设' ELSE '数据不足' END AS causal, a AND r AS can_net, a AND r AND c AS can_profit,
    CASE WHEN a AND r AND c THEN '已对账事实' WHEN a AND r THEN '观察性差异' ELSE '数据不足' END AS net_label FROM b""")
def evidence_labels(spark, sf_dir):
    b = spark.range(8).select(*((F.col("id").bitwiseAND(F.lit(1 << i)) > 0).alias(n) for i, n in enumerate("acr")))
    a, c, r = F.col("a"), F.col("c"), F.col("r")
    net = guards.net_revenue(a, c, r)
    return b.select("a", "c", "r", guards.causal_label(r, c, a).alias("causal"), net["can_net"].alias("can_net"), net["can_profit"].alias("can_profit"), net["label"].alias("net_label"))


@query("""WITH k(kind, n) AS (VALUES ('fact', NULL), ('diff', 0), ('假设', 3), ('insufficient', 10), ('其他', 12))
    SELECT kind, CASE kind WHEN 'fact' THEN '已对账事实' WHEN 'diff' THEN '观察性差异' WHEN '假设' THEN '待验证假设' WHEN 'insufficient' THEN '数据不足' END AS label,
    CASE WHEN n IS NULL OR n < 1 THEN '数据不足' WHEN n >= 10 THEN '待验证假设' ELSE '观察性差异' END AS comparisons FROM k""")
def label_kinds(spark, sf_dir):
    k = spark.createDataFrame([("fact", None), ("diff", 0), ("假设", 3), ("insufficient", 10), ("其他", 12)], "kind string, n int")
    return k.select("kind", guards.evidence_label(F.col("kind")).alias("label"), guards.multiple_comparisons(F.col("n")).alias("comparisons"))
