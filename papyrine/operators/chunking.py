"""Text cut into chunks and table bodies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.sources.session import ship_package


def windows(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, chunk, chunk_text): windows of ``size`` characters that share ``overlap``; a text has one at least."""
    step = size - overlap
    n = F.greatest(F.lit(1).cast("bigint"), F.ceil((F.length(text) - overlap) / step))
    rows = docs.select(key, text, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk"))
    return rows.select(key, "chunk", F.substr(text, (F.col("chunk") * step + 1).cast("int"), F.lit(size)).alias("chunk_text"))


def pack_paragraphs(text: str, size: int = 800, overlap: int = 150, least: int = 200) -> list[str]:
    """Paragraphs packed up to ``size``; longer ones cut into overlapping windows; a short tail joins the last chunk."""
    chunks: list[str] = []
    held = ""
    for para in (p.strip() for p in re.split(r"\n\s*\n|\n", text)):
        if not para:
            continue
        if len(para) > size:
            if held:
                chunks.append(held)
                held = ""
            chunks += [para[i : i + size] for i in range(0, max(1, len(para) - overlap), size - overlap)]
        elif held and len(held) + len(para) + 2 > size:
            chunks.append(held)
            held = para
        else:
            held = f"{held}\n\n{para}" if held else para
    if held:
        if chunks and len(held) < least:
            chunks[-1] = f"{chunks[-1]}\n\n{held}"
        else:
            chunks.append(held)
    return chunks


def paragraph_chunks(docs: DataFrame, key: str, text: str, size: int = 800, overlap: int = 150, least: int = 200) -> DataFrame:
    """(key, chunk, chunk_text): packing depends on what was packed before, so it runs over batches of whole texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, c) for k, t in zip(frame[key], frame[text], strict=True) for i, c in enumerate(pack_paragraphs(t or "", size, overlap, least))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "chunk_text"])

    ship_package(docs.sparkSession)
    return docs.select(key, text).mapInPandas(run, f"{key} bigint, chunk bigint, chunk_text string")


def hits_without_exclusion(docs: DataFrame, key: str, text: str, term: str, excluded: str, reach: int) -> DataFrame:
    """(key, hits): occurrences of ``term`` with no ``excluded`` within ``reach`` characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text], strict=True):
                low = (t or "").lower()
                places = [m.start() for m in re.finditer(re.escape(term), low)]
                free = [p for p in places if excluded not in low[max(0, p - reach) : p + len(term) + reach]]
                if free:
                    rows.append((k, len(free)))
            yield pd.DataFrame(rows, columns=[key, "hits"])

    ship_package(docs.sparkSession)
    return docs.select(key, text).mapInPandas(run, f"{key} bigint, hits bigint")


def table_bodies(lines: DataFrame, key: str, place: str, line: str, least: int = 2) -> DataFrame:
    """(key, first_line, last_line, rows): runs of neighbouring lines with ``least`` or more fields of equal number.

    A run goes on while lines follow each other and keep their field count, so it is an island of
    place minus row number within (key, fields).
    """
    from pyspark.sql import Window

    fields = lines.select(key, place, F.size(F.split(line, r"\t|  +|\|")).alias("__n")).where(F.col("__n") >= least)
    island = F.col(place) - F.row_number().over(Window.partitionBy(key, "__n").orderBy(place))
    runs = fields.withColumn("__i", island).groupBy(key, "__n", "__i")
    return runs.agg(F.min(place).alias("first_line"), F.max(place).alias("last_line"), F.count(F.lit(1)).alias("rows")).drop("__n", "__i")
