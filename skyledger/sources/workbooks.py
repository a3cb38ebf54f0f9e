"""Workbooks (Office Open XML) as grid rows, cells as they are shown: days first, times to the nearest minute.

A workbook is one file and is read by one task, out of its bytes.

Defined results: a file that is no workbook, or a damaged one, has no rows; blank rows at a sheet's end and blank cells at
a row's end are left out; a cell without a value is empty.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import content_kind

#: Number formats that show dates or times, of those that a workbook does not spell out.
_DATES = {14, 15, 16, 17, 22, *range(27, 37), *range(50, 59)}
_TIMES = {18, 19, 20, 21, 45, 46, 47}
_SCHEMA = "file string, sheet string, line int, cells array<string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node, name: str) -> list:
    return [x for x in node if _local(x.tag) == name]


def _text(node) -> str:
    """All runs of a string, phonetic ones left out."""
    if node is None:
        return ""
    return "".join(t.text or "" for part in node for t in ([part] if _local(part.tag) == "t" else _children(part, "t") if _local(part.tag) == "r" else []))


def shown(number: float, is_date: bool, is_time: bool) -> str:
    """A serial number as its day, its time or both; ``1904`` workbooks are not told apart."""
    minutes = int(number % 1 * 1440 + 0.5)
    day = datetime.date(1899, 12, 30) + datetime.timedelta(days=int(number) + minutes // 1440)
    clock = f"{minutes % 1440 // 60:02d}:{minutes % 60:02d}"
    if is_time and (not is_date or number < 1):
        whole = int(number * 1440 + 0.5)
        return f"{whole // 60:02d}:{whole % 60:02d}"
    return day.strftime("%d/%m/%Y") + (f" {clock}" if minutes else "")


def _kind(code: int, own: dict[int, str]) -> tuple[bool, bool]:
    if code not in own:
        return code in _DATES, code in _TIMES or code == 22
    form = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own[code]).lower()
    return bool(re.search("[yd]", form)), bool(re.search("[hs]", form))


def read_sheets(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, line, cells) of a workbook's bytes."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        xml = lambda n: ElementTree.fromstring(book.read(n)) if n in names else None
        strings = [_text(s) for s in xml("xl/sharedStrings.xml") or []] if "xl/sharedStrings.xml" in names else []
        styles, own, formats = xml("xl/styles.xml"), {}, []
        for part in styles if styles is not None else ():
            if _local(part.tag) == "numFmts":
                own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in part}
            elif _local(part.tag) == "cellXfs":
                formats = [int(f.get("numFmtId", 0)) for f in part]
        links = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        for sheet in next(iter(_children(xml("xl/workbook.xml"), "sheets")), ()):
            target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id" and "}" in k)]
            grid: dict[int, dict[int, str]] = {}
            data = _children(xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), "sheetData")
            for at, line in enumerate(data[0] if data else ()):
                row = grid.setdefault(int(line.get("r", at + 1)) - 1, {})
                for i, cell in enumerate(line):
                    letters = re.match("[A-Z]+", cell.get("r", ""))
                    place = i if not letters else sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters[0]))) - 1
                    row[place] = _cell(cell, strings, formats, own)
            filled = {r: {c: t for c, t in cells.items() if t} for r, cells in grid.items()}
            last = max((r for r, cells in filled.items() if cells), default=-1)
            for r in range(last + 1):
                cells = filled.get(r, {})
                yield sheet.get("name", ""), r, [cells.get(c, "") for c in range(max(cells, default=-1) + 1)]


def _cell(cell, strings: list[str], formats: list[int], own: dict[int, str]) -> str:
    value = next((v.text or "" for v in _children(cell, "v")), "")
    kind = cell.get("t", "n")
    if kind == "s":
        value = strings[int(value)]
    elif kind == "inlineStr":
        value = _text(next(iter(_children(cell, "is")), None))
    elif kind == "b":
        value = "TRUE" if value == "1" else "FALSE"
    elif kind == "n" and value:
        style = int(cell.get("s", 0))
        is_date, is_time = _kind(formats[style] if style < len(formats) else 0, own)
        number = float(value)
        value = shown(number, is_date, is_time) if is_date or is_time else str(int(number)) if number == int(number) else value
    return "\n".join(t for t in (re.sub(r"\s+", " ", x).strip() for x in re.split(r"\r\n|\r|\n", value)) if t)


def _sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            try:
                found = [(path, *row) for row in read_sheets(content.as_py())]
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError, IndexError):
                continue  # no workbook, or a damaged one
            if found:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["file", "sheet", "line", "cells"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, line, cells) of the workbooks among a folder's files."""
    files = spark.read.format("binaryFile").load(path).filter(content_kind(F.col("content")) == "excel")
    return files.select("path", "content").mapInArrow(_sheets, _SCHEMA)
