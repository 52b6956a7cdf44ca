"""File readers and the admission check."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import strip
from brindle.session import written

# Accepted endings and sizes of uploads.
DOCUMENT_ENDINGS, DATA_ENDINGS = (".pdf", ".txt"), (".csv", ".xlsx", ".xls")
DOCUMENT_BYTES, DATA_BYTES = 50 * 1024 * 1024, 100 * 1024 * 1024
MAX_FILENAME = 255
# How far down a header is looked for, and how many filled cells it needs.
HEADER_ROWS, HEADER_CELLS = 20, 3

SHEET_ROWS = "path string, row_idx bigint, cells array<struct<value:string,is_text:boolean>>"


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some record may go over several lines: the line on which it begins then holds an odd number of quotes.

    Byte ranges of the files are looked through by many tasks. A stray quote also counts, and so does a carriage return inside a line, which
    readers of lines would take for its end; that costs speed, not rows.
    """
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    returned = F.instr("value", "\r").between(F.lit(1), F.length("value") - 1)
    return not spark.read.option("lineSep", "\n").text(path).filter((quotes % 2 == 1) | returned).isEmpty()


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All columns as text; quotes inside a quoted field are doubled, and a quoted field may hold line breaks.

    Line breaks in fields make a file one task. Whether there are any is found out first unless ``multi_line`` says so; files
    that have none are read by many tasks. Refuses an empty file.
    """
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path)
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"')
    if df.isEmpty():
        raise ValueError("file is empty")
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Reader chosen by the file ending."""
    low = path.lower()
    if low.endswith(".csv"):
        return read_csv(spark, path)
    if low.endswith(".xlsx"):
        return sheet_table(sheet_rows(spark.read.format("binaryFile").load(path)))
    raise ValueError("unsupported file type, use CSV or XLSX")


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _all_text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


# Number formats that show dates or times, and the letters that do so in a format of its own.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
_DATE_LETTERS = re.compile(r"[ymdhs]", re.IGNORECASE)
_NOT_SHOWN = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


def _tree(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _first_sheet_name(book: zipfile.ZipFile) -> str:
    """The sheet that the workbook lists first; without a list the one with the smallest number."""
    listed, links = _tree(book, "xl/workbook.xml"), _tree(book, "xl/_rels/workbook.xml.rels")
    if listed is not None and links is not None:
        targets = {link.get("Id"): link.get("Target") for link in links}
        for sheet in listed.iter():
            if _local(sheet.tag) == "sheet":
                link = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None)
                target = targets.get(link, "")
                name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if name in book.namelist():
                    return name
    return min((n for n in book.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Places of the cell styles that show a number as a date."""
    root = _tree(book, "xl/styles.xml")
    if root is None:
        return set()
    own = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iter() if _local(f.tag) == "numFmt"}
    styles = next((x for x in root if _local(x.tag) == "cellXfs"), ())
    shown = [s.get("numFmtId", "0") for s in styles]
    return {i for i, f in enumerate(shown) if int(f) in DATE_FORMATS or _DATE_LETTERS.search(_NOT_SHOWN.sub("", own.get(f, "")))}


def _first_sheet(content: bytes) -> Iterator[tuple[int, list]]:
    """(row index, cells) of a workbook's first sheet. Dates become ``yyyy-MM-dd HH:mm:ss``, booleans true and false."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, listed = _tree(book, "xl/sharedStrings.xml"), _tree(book, "xl/workbook.xml")
        shared = [_all_text(item) for item in strings] if strings is not None else []
        since_1904 = listed is not None and any(
            _local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in listed.iter())
        start, dates = pd.Timestamp("1904-01-01" if since_1904 else "1899-12-30"), _date_styles(book)
        number = 0
        for _, row in ElementTree.iterparse(book.open(_first_sheet_name(book))):
            if _local(row.tag) != "row":
                continue
            number = int(row.get("r", number + 1))
            cells: list = []
            for cell in row:
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells.extend([None] * (at - len(cells)))
                kind = cell.get("t", "n")
                raw = next((c.text for c in cell if _local(c.tag) == "v"), None)
                if kind == "s" and raw is not None:
                    raw = shared[int(raw)]
                elif kind == "inlineStr":
                    raw = _all_text(cell)
                elif kind == "b" and raw is not None:
                    raw = "true" if raw.strip() == "1" else "false"
                elif kind == "n" and raw and int(cell.get("s", 0)) in dates:
                    raw = str((start + pd.to_timedelta(float(raw), "D")).round("s"))
                cells.append(None if raw is None else {"value": raw, "is_text": kind in ("s", "str", "inlineStr")})
            yield number - 1, cells
            row.clear()


def sheet_rows(files: DataFrame) -> DataFrame:
    """Rows of the first sheet of every workbook in a (path, content) table, one task per few files."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = list(_first_sheet(content))
                yield pd.DataFrame({
                    "path": path, "row_idx": [i for i, _ in rows], "cells": [c for _, c in rows],
                })

    return files.select("path", "content").mapInPandas(read, SHEET_ROWS)


def header_rows(rows: DataFrame) -> DataFrame:
    """(path, header_row): the first of the leading rows with three or more cells that are all text, else 0."""
    filled = F.filter("cells", lambda c: c.isNotNull())
    fits = (F.col("row_idx") < HEADER_ROWS) & (F.size(filled) >= HEADER_CELLS) & F.forall(filled, lambda c: c["is_text"])
    return rows.groupBy("path").agg(F.coalesce(F.min(F.when(fits, F.col("row_idx"))), F.lit(0)).alias("header_row"))


def sheet_table(rows: DataFrame) -> DataFrame:
    """Text table below the header rows, each workbook under its own header.

    Workbooks read together are united by column name; a column that a workbook does not have is NULL in its rows. Columns
    without a title are called by their place, a title that repeats inside a workbook gets a number.
    """
    # needed for widths, headers, names and the table itself, and parsed once
    rows = written(rows, "sheets")
    shape = rows.groupBy("path").agg(F.max(F.size("cells")).alias("width")).join(header_rows(rows), "path")
    placed = rows.join(shape, "path")
    every = F.sequence(F.lit(0), F.col("width") - 1)

    def titled(i: Column) -> Column:
        title = F.regexp_replace(F.trim(F.get("cells", i)["value"]), "\n", " ")
        return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("column_"), i.cast("string")))

    heads = placed.filter("row_idx = header_row AND width > 0").select("path", F.transform(every, titled).alias("plain"))

    def numbered(name: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice("plain", F.lit(1), i), lambda x: x == name))
        return F.when(earlier > 0, F.concat(name, F.lit("_"), (earlier + 1).cast("string"))).otherwise(name)

    heads = heads.select("path", F.transform("plain", numbered).alias("names"))
    # one name per column of the result
    named = heads.select("path", F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min(F.struct("path", "at")).alias("first"))
    names = [r["name"] for r in named.orderBy("first").collect()]
    if not names:
        raise ValueError("file is empty")
    values = F.transform(every, lambda i: F.get("cells", i)["value"])
    body = placed.filter("row_idx > header_row").join(heads, "path").select(F.map_from_arrays("names", values).alias("m"))
    return body.select(*[F.try_element_at("m", F.lit(n)).alias(n) for n in names])


def decode_text(content: Column) -> Column:
    """UTF-8 when valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def text_documents(files: DataFrame) -> DataFrame:
    """(path, text) of the non-blank files of a (path, content) table."""
    return files.select("path", decode_text(F.col("content")).alias("text")).filter(strip(F.col("text")) != "")


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    return text_documents(spark.read.format("binaryFile").load(path))


def admission(
    name: Column, size: Column, endings: tuple[str, ...] = DOCUMENT_ENDINGS, max_bytes: int = DOCUMENT_BYTES
) -> Column:
    """struct(verdict, safe_name) with verdict 'no_name', 'name_too_long', 'too_large', 'bad_type' or 'ok'."""
    safe = F.regexp_replace(F.replace(name, F.lit(".."), F.lit("")), r"[/\\]", "_")
    ending = F.lower(F.regexp_extract(safe, r"\.[^.]*$", 0))
    verdict = (
        F.when(name.isNull() | (name == ""), "no_name")
        .when(F.length(name) > MAX_FILENAME, "name_too_long")
        .when(size > max_bytes, "too_large")
        .when(~ending.isin(*endings), "bad_type")
        .otherwise("ok")
    )
    return F.struct(verdict.alias("verdict"), F.when(verdict == "ok", safe).alias("safe_name"))


