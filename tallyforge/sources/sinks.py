"""Where results go: CSV with a byte order mark, JSON with exact numbers, facts."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame


def json_value(value: object) -> object:
    """Decimals as plain text, sets in order, times as ISO."""
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, (set, frozenset)):
        return sorted(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    raise TypeError(f"{type(value).__name__} has no JSON form")


def to_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, default=json_value)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, for tables of any size."""
    df.write.option("header", True).option("emptyValue", "").csv(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """One local CSV file that spreadsheets open: with a byte order mark, row by row, for small tables."""
    import csv

    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def write_facts(facts: list[dict], path: str, merge: str | None = None) -> None:
    """{"facts": [...]}; with ``merge`` those of another file come first."""
    before = load_facts(merge) if merge else []
    Path(path).write_text(to_json({"facts": before + facts}), encoding="utf-8")


def load_facts(path: str) -> list[dict]:
    """A list, a dict that wraps one, a single result, or results by name."""
    held = json.loads(Path(path).read_text(encoding="utf-8"))
    if isinstance(held, list):
        return held
    for key in ("facts", "numbers", "key_numbers", "results"):
        if isinstance(held.get(key), list):
            return held[key]
    if "value" in held or "reason" in held:
        return [held]
    return [{"label": name, **r} for name, r in held.items() if isinstance(r, dict)]
