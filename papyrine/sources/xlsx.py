"""XLSX sheets as rows, read from the zip's XML with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from papyrine.sources.session import ship_package

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SHEETS = 20
CELLS = "path string, sheet string, row bigint, column bigint, value string"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def cells(data: bytes, most: int = SHEETS) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of the first ``most`` sheets; rows and columns from 0."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root.iter(f"{MAIN}si")]
        sheets = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for number, name in sheets[:most]:
            for c in ElementTree.fromstring(book.read(name)).iter(f"{MAIN}c"):
                where = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                value, inline = c.find(f"{MAIN}v"), c.find(f"{MAIN}is")
                if where is None or (value is None and inline is None):
                    continue
                text = "".join(t.text or "" for t in inline.iter(f"{MAIN}t")) if inline is not None else value.text or ""
                yield f"sheet{number}", int(where[2]) - 1, _column(where[1]), shared[int(text)] if c.get("t") == "s" else text


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every workbook below ``path``, one task for a file."""
    ship_package(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, data in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(where, *c) for c in cells(bytes(data))], columns=["path", "sheet", "row", "column", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)
