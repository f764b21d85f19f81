"""Results with their provenance, and how they read in a report."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from decimal import Decimal

from tallyforge.functions.cells import rounded


@dataclass
class Result:
    """A number with what it was made of; without a value, the reason why."""

    value: Decimal | float | str | None = None
    numerator: Decimal | int | None = None
    denominator: Decimal | int | None = None
    unit: str = ""
    formula: str = ""
    scope: str = ""
    reason: str = ""
    note: str = ""
    meta: dict = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.value is not None

    def display(self, digits: int = 2, as_percent: bool = False) -> str:
        """The value, never 0 for what can't be computed."""
        if not self.ok:
            return f"无法计算：{self.reason}"
        if isinstance(self.value, str):
            return self.value
        v = Decimal(str(self.value)) * (100 if as_percent else 1)
        text = f"{v:.{digits}f}" + ("%" if as_percent else self.unit)
        return text + (f"（{self.numerator}/{self.denominator}）" if self.denominator is not None else "")

    def line(self, label: str, as_percent: bool = False) -> str:
        tail = "；".join(x for x in (self.formula, self.scope, self.note) if x)
        return f"- {label}：{self.display(as_percent=as_percent)}" + (f" — {tail}" if tail else "")

    def to_dict(self) -> dict:
        return {k: (str(v) if isinstance(v, (Decimal, float, int)) and not isinstance(v, bool) else v) for k, v in asdict(self).items()}


def from_row(row: dict, value: str, numerator: str, denominator: str, **about: str) -> Result:
    """A Result from one collected row of an operator."""
    return Result(row.get(value), row.get(numerator), row.get(denominator), reason=row.get("reason") or "", **about)


def rate_fact(rate: dict, label: str = "", source: str = "") -> dict:
    """A fact from a rate, or from the first node of a curve; counts of objects make it a percentage."""
    one = rate.get("rate") or (rate.get("curve") or [None])[0] or rate
    one = one if isinstance(one, dict) else {"value": one}
    meta = one.get("meta") or {}
    percent = not one.get("unit") and {"n_eligible", "n_hit"} <= meta.keys()
    return {**one, "label": label or one.get("label", ""), "source": source, "as_percent": percent}


def value_fact(value: str, label: str = "", as_percent: bool = False, **about: str) -> dict:
    """A fact from a value that is told as it stands, with what is told about it: unit, numerator, denominator, formula, scope, source, note."""
    held = {k: about.get(k) or "" for k in ("unit", "formula", "scope", "source", "note")}
    counts = {k: about.get(k) for k in ("numerator", "denominator")}
    return {"label": label or "未命名指标", "value": value, **held, **counts, "as_percent": as_percent}


def fact_line(fact: dict) -> str:
    """One line of a report: value or reason, at most four places, then where it comes from."""
    label, value = fact.get("label") or "(未命名)", fact.get("value")
    if value is None:
        shown = f"无法计算（{fact.get('reason') or '未说明原因'}）"
    else:
        try:
            number = Decimal(str(value))
            shown = rounded(number * 100, 2) + "%" if fact.get("as_percent") else rounded(number) + (fact.get("unit") or "")
        except ArithmeticError:
            shown = str(value)
        if fact.get("denominator") is not None:
            shown += f"（{fact.get('numerator')} / {fact['denominator']}）"
    tail = "；".join(f"{name}：{fact[k]}" for name, k in (("公式", "formula"), ("口径", "scope"), ("来源", "source")) if fact.get(k))
    return f"- {label}：{shown}" + (f"　[{tail}]" if tail else "")
