"""Messy delimited files as tables of text.

The driver reads the head of a file only: for its encoding, its delimiter and its header row. The rows are read by Spark,
every cell as text, blanks as blanks, with a row number that keeps the order of the file.
"""

from __future__ import annotations

import csv
import datetime
import io
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.names import ROW

# Extensions, encodings in the order they are tried, delimiters.
TEXT = (".csv", ".tsv", ".txt", ".tab", ".dat")
SHEETS = (".xlsx", ".xlsm")
ENCODINGS = ("utf-8", "gbk", "gb18030")
DELIMITERS = (",", "\t", ";", "|")
HEAD_BYTES = 1 << 20
HEADER_ROWS = 50
#: Columns beyond the widest row of the head that later rows may have.
SPARE_COLUMNS = 16


@dataclass
class Table:
    """A DataFrame of text columns with what is known about where it came from."""

    name: str
    df: DataFrame
    headers: list[str]
    encoding: str | None = None
    sheet: str | None = None
    notes: list[str] = field(default_factory=list)


def read_head(spark: SparkSession, path: str, most: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise FileNotFoundError(path)
    if store.getFileStatus(where).isDirectory():
        raise IsADirectoryError(path)
    stream = store.open(where)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def detect_encoding(head: bytes) -> str:
    """The first encoding in which the head is text; its last character may be cut."""
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8"
    if b"\x00" in head:
        raise ValueError("the file is binary")
    for name in ENCODINGS:
        for cut in range(4):
            try:
                text = head[: len(head) - cut].decode(name)
            except UnicodeDecodeError:
                continue
            if "�" not in text or name == "utf-8":
                return name
    raise ValueError(f"none of {ENCODINGS} fits")


def sniff_delimiter(text: str, path: str = "") -> str:
    """A tab for .tsv and .tab; else what is most frequent in the first line, with half a point for each of four lines that agrees."""
    if path.lower().endswith((".tsv", ".tab")):
        return "\t"
    lines = [x for x in text.splitlines() if x.strip()][:5]
    if not lines:
        return ","
    score = {d: lines[0].count(d) + 0.5 * sum(x.count(d) == lines[0].count(d) for x in lines[1:]) if lines[0].count(d) else 0 for d in DELIMITERS}
    return max(DELIMITERS, key=lambda d: score[d])


def header_row(rows: list[list[str]]) -> int:
    """The first row that isn't blank; a title of one or two cells above a wider table is skipped."""
    filled = [(i, sum(bool(c.strip()) for c in r)) for i, r in enumerate(rows[:HEADER_ROWS])]
    filled = [x for x in filled if x[1]]
    if not filled:
        raise ValueError("the table is empty")
    widest = max(n for _, n in filled)
    if filled[0][1] <= 2 and widest >= 3:
        return next(i for i, n in filled if n >= max(3, math.ceil(0.6 * widest)))
    return filled[0][0]


def name_headers(cells: list[str], width: int, notes: list[str]) -> list[str]:
    """Headers without a byte order mark and white space; blank ones named, repeated ones numbered and noted."""
    cells = [c.replace("﻿", "").strip() for c in cells] + [""] * (width - len(cells))
    seen, out = Counter(), []
    for i, c in enumerate(cells, 1):
        c = c or f"(空列{i})"
        seen[c] += 1
        out.append(c if seen[c] == 1 else f"{c}__{seen[c]}")
    again = [c for c, n in seen.items() if n > 1]
    if again:
        notes.append(f"repeated headers: {', '.join(again)}")
    return out


def load_table(spark: SparkSession, path: str, sheet: str | None = None, encoding: str | None = None) -> Table:
    """A .csv, .tsv, .txt, .tab, .dat, .xlsx or .xlsm file as a Table; anything else is an error.

    Blank rows go, short rows are filled with blanks, empty columns at the end go, and each row keeps its number.
    """
    name = re.split(r"[/\\]", path)[-1]
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext in SHEETS:
        return load_sheet(spark, path, sheet)
    if ext not in TEXT:
        raise ValueError(f"{name}: only {', '.join(TEXT + SHEETS)} can be read")
    head = read_head(spark, path)
    if not head.strip():
        raise ValueError(f"{name}: the file is empty")
    encoding = encoding or detect_encoding(head)
    text = head.decode(encoding, "ignore").lstrip("﻿")
    if len(head) == HEAD_BYTES:
        text = text[: text.rfind("\n") + 1] or text
    sep, notes = sniff_delimiter(text, path), []
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r]
    at = header_row(rows)
    if at:
        notes.append(f"the header is row {at + 1}")
    width = max(map(len, rows))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width + SPARE_COLUMNS)])
    options = {"sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "header": "false"}
    raw = spark.read.options(**options).schema(schema).csv(path)
    raw = raw.withColumn(ROW, F.monotonically_increasing_id()).where(F.col(ROW) > at)
    return _shaped(raw, rows[at], width, Table(name, raw, [], encoding, None, notes))


def _shaped(raw: DataFrame, header: list[str], width: int, out: Table) -> Table:
    columns = [c for c in raw.columns if c != ROW]
    filled = raw.na.fill("", columns)
    real = lambda c: F.trim(F.regexp_replace(c, "[\\s\\u3000\\u00a0\\ufeff]+", "")) != ""
    used = filled.agg(*(F.coalesce(F.bool_or(real(F.col(c))), F.lit(False)).alias(c) for c in columns)).first()
    last = max([i + 1 for i, c in enumerate(columns) if used[c]] + [sum(1 for c in header if c.strip()) and max(i + 1 for i, c in enumerate(header) if c.strip())])
    if last > width:
        out.notes.append(f"some rows have {last} cells, the head has {width}")
    out.headers = name_headers(header[:last], last, out.notes)
    any_real = F.lit(False)
    for c in columns[:last]:
        any_real = any_real | real(F.col(c))
    named = [F.col(c).alias(h) for c, h in zip(columns, out.headers)]
    out.df = filled.where(any_real).select(*named, ROW)
    return out


def sheet_text(value: object) -> str:
    """A spreadsheet cell as text: whole numbers without a point, large floats with their exponent, so that damaged ids show.

    Truth values are TRUE and FALSE; a time stamp at midnight is its date; a time of day stays one.
    """
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float) and abs(value) < 1e16 and value == int(value):
        return str(int(value))
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d" if value.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")
    return repr(value) if isinstance(value, float) else str(value)


def load_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> Table:
    """One sheet of a workbook (the first if none is named); needs openpyxl, and reads the workbook on the driver."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    book = openpyxl.load_workbook(io.BytesIO(read_head(spark, path, 1 << 30)), read_only=True, data_only=True)
    one = book[sheet] if sheet else book.worksheets[0]
    rows = [[sheet_text(v) for v in r] for r in one.iter_rows(values_only=True)]
    notes = [f"other sheets: {', '.join(s for s in book.sheetnames if s != one.title)}"] if len(book.sheetnames) > 1 else []
    return from_rows(spark, re.split(r"[/\\]", path)[-1], rows, notes, one.title)


def from_rows(spark: SparkSession, name: str, rows: list[list[str]], notes: list[str] | None = None, sheet: str | None = None) -> Table:
    """A Table from rows of text that the driver holds, the header among them."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    at, width = header_row(rows), max(map(len, rows))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)] + [T.StructField(ROW, T.LongType())])
    data = [(*r, *[""] * (width - len(r)), i) for i, r in enumerate(rows[at + 1 :])]
    df = spark.createDataFrame(data, schema)
    return _shaped(df, rows[at], width, Table(name, df, [], None, sheet, notes or []))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Row numbers for a table that came without: by ``order``, over the whole table, for bounded tables."""
    return df.withColumn(ROW, F.row_number().over(Window.orderBy(*order)) - 1)
