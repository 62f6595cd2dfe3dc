"""Structure of tables that stand in texts: a gate, four ways of reading, and how sure the reading is.

``table_structure`` is a chain of projections in the JVM, without a shuffle; each stage is a column, so nothing is computed
twice.  ``delimited_structure`` reads delimited texts with quoted fields, which no built-in expression can split across
lines; there a small helper runs over Arrow batches.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import LINE_END, SPACE, strip
from papyrine.sources.session import ship_package

#: Limits of a table that can be read from text.
MOST_ROWS, MOST_COLUMNS, LEAST_LINES, LEAST_COLUMNS, LEAST_CHARS = 100, 30, 2, 2, 20
AGREEMENT, HEADER_SHARE = 0.6, 0.3
FLAT_COLUMNS, FLAT_CELLS = (3, 12), 6
GAP = f"{SPACE}{{2,}}"


def _lettered(cells: Column) -> Column:
    """How many cells hold a Latin letter."""
    return F.size(F.filter(cells, lambda c: c.rlike("[A-Za-z]")))


def _commonest(counts: Column) -> Column:
    """Struct (n, place, value) of the commonest number, of equals the one that comes first; null without any."""
    kinds = F.array_distinct(counts)
    return F.array_max(F.transform(kinds, lambda v, i: F.struct(F.size(F.filter(counts, lambda c: c == v)).alias("n"), (-i).alias("place"), v.alias("value"))))


def _cells(line: Column, pattern: str) -> Column:
    return F.transform(F.split(line, pattern), strip)


def _from(cells: Column, start: int) -> Column:
    return F.slice(cells, start, F.greatest(F.size(cells), F.lit(1)))


def table_structure(texts: DataFrame, text: str, *, gap: str = GAP, bare_pipes: bool = False) -> DataFrame:
    """``texts`` with status, method, confidence, header, cells (an array of rows of cells), width and empty_rows of the table in column ``text``.

    status is ``structure_pending`` for texts below 20 characters or two lines, ``simple_structure_extracted``, or
    ``complex_structure_skipped`` for lines that do not agree on columns, over 30 columns or over 100 lines.  Of the ways of reading the first
    with a header of two columns and a row counts: ``markdown_like`` (lines that start with a bar; with ``bare_pipes``
    also lines with a bar inside), ``tab_delimited``, ``whitespace_aligned`` (cells parted by ``gap``, lines of the commonest number, the line with
    the largest share of lettered cells as header), ``whitespace_flat`` (cells of all lines dealt into rows of the number of columns
    whose header reads best).  Other texts have null header and cells.  A null text is empty.
    """
    marker = F.lit("|")

    def piped(line: Column) -> Column:
        return line.contains("|") if bare_pipes else line.startswith(marker) & (F.instr(F.substring(line, 2, 1 << 30), "|") > 0)

    def bar_cells(line: Column) -> Column:
        cells = _cells(line, r"\|")
        inner = F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0)))
        return F.when(line.startswith(marker), inner).otherwise(cells) if bare_pipes else inner

    def rule(cells: Column) -> Column:
        return F.forall(cells, lambda c: c.rlike("^[-:]*$"))

    lines = F.filter(F.transform(F.split(strip(F.coalesce(F.col(text), F.lit(""))), LINE_END), strip), lambda x: x != "")
    df = texts.withColumns({"__all": lines, "__chars": F.length(strip(F.coalesce(F.col(text), F.lit(""))))})
    df = df.withColumn("__gapped", F.filter(F.transform("__all", lambda x: F.filter(_cells(x, gap), lambda c: c != "")), lambda cs: F.size(cs) >= LEAST_COLUMNS))
    df = df.withColumns({"__bars": F.filter("__all", piped), "__tabs": F.filter("__all", lambda x: x.contains("\t")), "__counts": F.transform("__gapped", F.size)})
    df = df.withColumn("__common", _commonest(F.col("__counts")))
    agreed = (F.size("__counts") >= LEAST_LINES) & (F.col("__common.n") >= AGREEMENT * F.size("__counts"))
    small = (F.col("__common.value") <= MOST_COLUMNS) & (F.size("__all") <= MOST_ROWS)
    gate = (
        F.when((F.col("__chars") < LEAST_CHARS) | (F.size("__all") < LEAST_LINES), "unavailable")
        .when(F.size("__bars") >= 2, "simple")
        .when(agreed, F.when(small, "simple").otherwise("complex"))
        .when(F.size("__tabs") >= LEAST_LINES, "simple")
        .otherwise("complex")
    )
    df = df.withColumn("__gate", gate)

    def read(ready: Column, value: Column) -> Column:
        return F.when((F.col("__gate") == "simple") & ready, value)

    def headed(rows: Column, least: Column) -> Column:
        return F.when(least, F.struct(F.get(rows, 0).alias("header"), _from(rows, 2).alias("cells")))

    barred = F.filter(F.transform("__bars", bar_cells), lambda cs: ~rule(cs))
    df = df.withColumn("__markdown", read(F.size("__bars") >= 2, barred)).withColumn("__markdown", headed(F.col("__markdown"), F.size("__markdown") >= 2))
    tabbed = F.transform("__tabs", lambda x: _cells(x, "\t"))
    df = df.withColumn("__tabbed", read(F.size("__tabs") >= 2, tabbed)).withColumn("__tabbed", headed(F.col("__tabbed"), F.size("__tabbed") >= 2))
    same = F.filter("__gapped", lambda cs: F.size(cs) == F.col("__common.value"))
    df = df.withColumn("__same", read(F.size("__counts") >= 2, same)).withColumn("__letters", F.transform("__same", _lettered))
    best = F.array_max("__letters")
    at = F.when(best >= HEADER_SHARE * F.col("__common.value"), F.array_position("__letters", best)).otherwise(F.lit(1)).cast("int")
    aligned = F.struct(F.get("__same", at - 1).alias("header"), F.filter("__same", lambda cs, i: i != at - 1).alias("cells"))
    df = df.withColumn("__aligned", F.when(F.size("__same") >= 2, aligned))
    open_ = F.coalesce(F.size("__markdown.header") < LEAST_COLUMNS, F.lit(True)) & F.coalesce(F.size("__tabbed.header") < LEAST_COLUMNS, F.lit(True)) & F.col("__aligned").isNull()
    df = df.withColumn("__flat", read(open_, F.flatten(F.filter("__gapped", lambda cs: F.size(cs) >= 3))))
    n_cells = F.size("__flat")

    def rated(n: Column) -> Column:
        share = _lettered(F.slice("__flat", F.lit(1), n)) / n
        rows = F.floor(n_cells / n).cast("int") - 1
        uneven = (n_cells % n != 0) & (n_cells % n < n - 2)
        return F.when(~uneven & (share >= HEADER_SHARE) & (rows >= 1), F.struct((share + F.least(rows * 0.1, F.lit(0.5))).alias("score"), (-n).alias("n")))

    widths = F.sequence(F.lit(FLAT_COLUMNS[0]), F.least(F.lit(FLAT_COLUMNS[1]), F.floor(n_cells / 2).cast("int")))
    df = df.withColumn("__flat_n", F.when(n_cells >= FLAT_CELLS, -F.array_max(F.transform(widths, rated))["n"]))
    n = F.col("__flat_n")
    starts = F.sequence(F.lit(1), F.least(F.floor(n_cells / n).cast("int") - 1, F.lit(MOST_ROWS)))
    flat = F.struct(F.slice("__flat", F.lit(1), n).alias("header"), F.transform(starts, lambda r: F.slice("__flat", r * n + 1, n)).alias("cells"))
    df = df.withColumn("__flat_read", F.when(n.isNotNull(), flat))

    ways = {"markdown_like": "__markdown", "tab_delimited": "__tabbed", "whitespace_aligned": "__aligned", "whitespace_flat": "__flat_read"}
    found: Column = F.lit(None)
    method: Column = F.lit(None).cast("string")
    for name, way in reversed(ways.items()):
        fits = (F.size(f"{way}.header") >= LEAST_COLUMNS) & (F.size(f"{way}.cells") >= 1)
        found, method = F.when(fits, F.col(way)).otherwise(found), F.when(fits, name).otherwise(method)
    df = df.withColumns({"__found": found, "__method": method})
    header, rows = F.col("__found.header"), F.col("__found.cells")

    def named(row: Column) -> Column:
        """How many different names a row's cells have; surplus cells are named by their place."""
        surplus = F.when(F.size(row) > F.size(header), F.transform(F.sequence(F.size(header), F.size(row) - 1), lambda i: F.concat(F.lit("col_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.size(F.array_distinct(F.concat(F.slice(header, F.lit(1), F.least(F.size(row), F.size(header))), surplus)))

    df = df.withColumn("__names", F.transform(rows, named))
    agreeing = _commonest(F.col("__names"))["n"]
    letters = F.when(_lettered(header) >= 0.5 * F.size(header), 2).otherwise(0)
    even = F.when(agreeing == F.size(rows), 2).when(agreeing >= 0.8 * F.size(rows), 1).otherwise(0)
    score = letters + even + F.when(F.size(rows) >= 10, 1).otherwise(0) + F.when(F.col("__method").isin("markdown_like", "tab_delimited"), 1).otherwise(0)
    confidence = F.when(F.col("__found").isNull(), "none").when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")
    status = F.when(F.col("__gate") == "unavailable", "structure_pending").when(F.col("__found").isNull(), "complex_structure_skipped").otherwise("simple_structure_extracted")
    return df.select(
        *texts.columns, status.alias("status"), F.coalesce("__method", F.when(F.col("__gate") == "unavailable", "unavailable").otherwise("skipped_complex")).alias("method"), confidence.alias("confidence"), header.alias("header"), rows.alias("cells"),
        F.greatest(F.size(header), F.array_max(F.transform(rows, F.size))).alias("width"), F.size(F.filter(rows, lambda r: F.forall(r, lambda c: c == ""))).alias("empty_rows"),
    )


#: Columns named in a header, and rows shown after it.
HEADER_CELLS, SHOWN_ROWS = 50, 20
_STRUCTURE = "status string, delimiter string, n_rows bigint, n_columns bigint, header array<string>, empty_rows bigint, shown array<array<string>>"


def delimiter_of(text: Column) -> Column:
    """Tab where it is the most frequent of tab, comma and semicolon, semicolon where it is more frequent than comma, else comma."""
    tabs, commas, semicolons = (F.regexp_count(text, F.lit(c)) for c in ("\t", ",", ";"))
    return F.when((tabs > commas) & (tabs > semicolons), "\t").when(semicolons > commas, ";").otherwise(",")


def _structure(text: str, delimiter: str, shown: int) -> tuple:
    width, empty, n, header, after = 0, 0, 0, None, []
    try:
        for row in csv.reader(io.StringIO(text), delimiter=delimiter):
            n += 1
            width = max(width, len(row))
            if not any(c.strip() for c in row):
                empty += 1
            elif header is None:
                header = [c.strip() for c in row[:HEADER_CELLS]]
                continue
            if header is not None and len(after) < shown:
                after.append(row)
    except csv.Error:
        return "failed", delimiter, 0, 0, [], 0, []
    if header is None:
        return ("parsed" if n else "empty"), delimiter, n, width, [], empty, []
    return "parsed", delimiter, n, width, header, empty, after


def delimited_structure(texts: DataFrame, key: str, text: str, *, delimiter: str | None = None, shown: int = SHOWN_ROWS) -> DataFrame:
    """``key`` with status, delimiter, n_rows, n_columns (the widest row), header (the first row that is not blank, 50 cells at most), empty_rows
    and the first ``shown`` rows after the header, of a text of delimited rows with quoted fields.

    Without a ``delimiter`` the whole text decides (``delimiter_of``).  All rows count.  A null or empty text is ``empty``;
    one that breaks the rules of quoting lines (a bare carriage return inside a field) is ``failed``.
    """
    ship_package(texts.sparkSession)
    given = texts.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    given = given.withColumn("__by", delimiter_of(F.col("__text")) if delimiter is None else F.lit(delimiter))
    names = [f.split()[0] for f in _STRUCTURE.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            found = [_structure(t, d, shown) for t, d in zip(batch.column("__text").to_pylist(), batch.column("__by").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), *[pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]], names=["__key", *names])

    kind = given.schema["__key"].dataType.simpleString()
    return given.mapInArrow(run, f"__key {kind}, {_STRUCTURE}").withColumnRenamed("__key", key)
