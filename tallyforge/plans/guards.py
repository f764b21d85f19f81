"""Evidence labels, and the guards that refuse a claim the data can't carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four labels, the words that mean them, the verdicts.
FACT, DIFFERENCE, HYPOTHESIS, INSUFFICIENT = "已对账事实", "观察性差异", "待验证假设", "数据不足"
LABELS = (FACT, DIFFERENCE, HYPOTHESIS, INSUFFICIENT)
KINDS = {
    "reconciled": FACT, "fact": FACT, "observational": DIFFERENCE, "diff": DIFFERENCE, "hypothesis": HYPOTHESIS, "假设": HYPOTHESIS,
    "insufficient": INSUFFICIENT, **{x: x for x in LABELS},
}


def evidence_label(kind: Column) -> Column:
    """One of the four labels, NULL for a kind that isn't known."""
    seen = F.trim(kind)
    out = F.lit(None).cast("string")
    for word, label in KINDS.items():
        out = F.when(seen == word, label).otherwise(out)
    return out


def causal_label(random_assignment: Column, control: Column, attribution: Column) -> Column:
    """Whether a gain may be called caused: only with random assignment and a control."""
    return F.when(random_assignment & control, FACT).when(control, DIFFERENCE).when(attribution, HYPOTHESIS).otherwise(INSUFFICIENT)


def net_revenue(reconciled: Column, fulfilment_cost: Column, fee_policy: Column) -> dict[str, Column]:
    """Whether net revenue and profit may be named."""
    net = reconciled & fee_policy
    profit = net & fulfilment_cost
    return {"can_net": net, "can_profit": profit, "label": F.when(profit, FACT).when(net, DIFFERENCE).otherwise(INSUFFICIENT)}


def independent_units(records: Column, periods: Column, units: Column) -> dict[str, Column]:
    """Records aren't independent samples: inference needs 10 units, counted by periods where units aren't given.

    ``reasons`` says what stands against inference, joined by semicolons, and is blank where nothing does.
    """
    n = F.coalesce(units, periods)
    infer = F.coalesce(n >= 10, F.lit(False))
    usable = ~F.coalesce(records > n, F.lit(False))
    against = F.concat_ws(
        "；",
        F.when(records > n, F.concat(records.cast("long").cast("string"), F.lit(" 条记录来自 "), n.cast("long").cast("string"), F.lit(" 个单位，组内相关"))),
        F.when(periods < 3, F.concat(F.lit("干预周期只有 "), periods.cast("long").cast("string"), F.lit(" 个"))),
        F.when(n < 10, F.concat(F.lit("独立单位只有 "), n.cast("long").cast("string"), F.lit(" 个，仅供探索"))),
    )
    return {"n_units": n, "ok_to_infer": infer, "records_usable": usable, "label": F.when(infer, DIFFERENCE).otherwise(INSUFFICIENT), "reasons": against}


def multiple_comparisons(n_tests: Column) -> Column:
    """Ten comparisons or more are exploratory."""
    return F.when(n_tests.isNull() | (n_tests < 1), INSUFFICIENT).when(n_tests >= 10, HYPOTHESIS).otherwise(DIFFERENCE)
