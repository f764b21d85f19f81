"""Markdown reports from aggregated rows and facts. Everything here works on a few rows on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from tallyforge.functions.cells import cell_text
from tallyforge.operators.reconcile import FAIL, PASS, WARN
from tallyforge.plans.facts import fact_line
from tallyforge.plans.guards import LABELS

SECTIONS = ("结论", "数据范围与口径", "关键数字", "对账结果", "观察与差异", "限制与风险", "下一步")
# The twelve questions of the checklist, and the sentences that no report may hold.
CHECKLIST = (
    "金额合计能否由原始记录独立复算。",
    "日、商品、渠道等互斥完整分组能否回加总量。",
    "状态类别是否互斥；不互斥时不能强行相加。",
    "关联是否造成重复累计。",
    "每个比例的分母是否匹配。",
    "日期是否包含部分日或跨期记录。",
    "退款、核销状态是否处理撤销和后续变更。",
    "缺失是否被错误当成零。",
    "极端值是否核实。",
    "用户口述与表格结果是否混为一谈。",
    "抽样检验是否误当成全量验证。",
    "每项重要结论是否能追溯到字段、筛选和公式。",
)
RED_LINES = (
    "「今天核销额 ÷ 今天成交额 = 真实核销率」",
    "「整体 ROI = 各组 ROI 的平均」",
    "「核销率 0%」（当分母为 0 时 —— 应该说「不可计算」）",
    "「广告新增 ROI = 总成交额 ÷ 消耗」",
    "「3000 个订单 = 3000 个独立样本」",
    "「提升 1%」（当实际是 1 个百分点时）",
    "「净收入 = 用户实付 － 退款」（未对账时）",
    "「剔除已退款订单后核销率提升到 XX%」",
    "「A 素材比 B 素材好」（当两者观察年龄或批次不同时）",
)


def md_table(headers: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    lines = ["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers)]
    return "\n".join(lines + ["| " + " | ".join(cell_text(c) for c in r) + " |" for r in rows])


def overall(verdicts: Sequence[str]) -> str:
    """The worst verdict."""
    return next((v for v in (FAIL, WARN) if v in verdicts), PASS)


def exit_code(verdict: str) -> int:
    return 2 if verdict == FAIL else 0


def contract_report(name: str, columns: list[dict], grains: list[dict], notes: Sequence[str] = (), answers: dict | None = None) -> str:
    """What a table holds: columns with their kinds and counts, and what a row may stand for."""
    rows = [[c["column"], c["kind"], c["n_rows"], c["blank"], c["marked"], c["distinct"], "是" if c["unique"] else ""] for c in columns]
    parts = [f"# 数据契约：{name}", md_table(("列", "类型", "行数", "空", "缺失符号", "唯一值", "唯一"), rows)]
    for kind, keys in (("时间", ("parsed", "first", "last")), ("ID", ("scientific", "leading_zero")), ("金额", ("numeric", "total", "negative", "zero"))):
        some = [c for c in columns if c["kind"] == kind]
        if some:
            parts += [f"## {kind}列", md_table(("列", *keys), [[c["column"], *(c.get(k) for k in keys)] for c in some])]
    parts += ["## 粒度（需人工确认）", *(f"- {g['grain']}：{g['column']}，把握 {g['confidence']}，重复 {g['duplicates']} 行" for g in grains)]
    for title, key in (("可以回答", "can"), ("不能回答", "cannot")):
        if answers and answers[key]:
            parts += [f"## {title}", "\n".join(f"- {x}" for x in answers[key])]
    return "\n\n".join([*parts, *(f"> {n}" for n in notes)])


def audit_report(results: list[tuple[str, dict]]) -> str:
    """One section for each audit, after a summary; (title, row) pairs whose rows may hold a verdict."""
    verdicts = [r.get("verdict", PASS) for _, r in results]
    parts = [f"# 对账报告：{overall(verdicts)}", md_table(("检查", "结论"), [[t, v] for (t, _), v in zip(results, verdicts)])]
    for title, row in results:
        parts += [f"## {title}", md_table(("项目", "值"), [[k, v] for k, v in row.items()])]
    return "\n\n".join(parts)


def cohort_report(rate: dict, curve: list[dict], semantics: str) -> str:
    shown = f"{rate['rate']:.2%}（{rate['n_hit']}/{rate['n_eligible']}）" if rate.get("rate") is not None else f"无法计算：{rate.get('reason')}"
    parts = ["# 同期群", f"- 比例：{shown}", f"- 事件口径：{semantics}"]
    if curve:
        parts.append(md_table(("小时", "命中", "分母", "比例", "增量"), [[c["hours"], c["n_hit"], c["n_eligible"], c["rate"], c["increase"]] for c in curve]))
    return "\n\n".join(parts)


def scaffold(facts: list[dict], meta: dict | None = None) -> str:
    """Seven sections, the key numbers filled in, then the evidence labels to choose from, the checklist and the red lines."""
    meta = meta or {}
    parts = [f"# {meta.get('title', '经营数据核对报告')}"]
    for i, name in enumerate(SECTIONS, 1):
        parts.append(f"## {i}. {name}")
        if name == "关键数字":
            parts += [fact_line(f) for f in facts] or ["（没有可引用的数字）"]
        else:
            parts.append(meta.get(name, "（待填写）"))
    parts += ["## 附录：证据标签", "、".join(LABELS), "## 附录：检查清单", "\n".join(f"- [ ] {x}" for x in CHECKLIST)]
    return "\n\n".join([*parts, "## 附录：红线（报告中不得出现）", "\n".join(f"- {x}" for x in RED_LINES)])
