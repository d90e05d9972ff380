"""Spreadsheets as rows of cells, with the standard library: a workbook is a ZIP of XML."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def cells(data: bytes, sheet: str) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of a sheet, from 0; dates stay day numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rel = next(s.get(REL) for s in book.iter(f"{NS}sheet") if s.get("name") == sheet)
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in links if r.get("Id") == rel)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
        for c in ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter(f"{NS}c"):
            letters, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            col = 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            v = c.find(f"{NS}v")
            text = "".join(t.text or "" for t in c.iter(f"{NS}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
            if text is not None:
                yield int(number) - 1, col - 1, shared[int(text)] if c.get("t") == "s" else text


def series(spark: SparkSession, path: str, sheet: str = "Data1", header: int = 0, first: int = 10) -> DataFrame:
    """(path, series, period_end, value): rows from ``first`` whose first cell is a day number, one row a filled cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                grid: dict[int, dict[int, str]] = {}
                for r, c, t in cells(data, sheet):
                    grid.setdefault(r, {})[c] = t
                out = []
                for r, row in sorted(grid.items()):
                    try:
                        day = dt.date(1899, 12, 30) + dt.timedelta(days=int(float(row.get(0, ""))))
                    except ValueError:
                        continue
                    for c, t in row.items():
                        if r >= first and c > 0:
                            try:
                                out.append((name, grid.get(header, {}).get(c), day, float(t)))
                            except ValueError:
                                pass
                yield pd.DataFrame(out, columns=["path", "series", "period_end", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, series string, period_end date, value double")
