"""Spreadsheet workbooks as a source (IO4): rater sheets as they are delivered.

A workbook is a zip archive of XML files.  Spark lists and reads the archives (``binaryFile``,
any store that Spark reads); a task unpacks one workbook at a time and reads the wanted sheet row
by row.  A file that is no workbook, or has no such sheet, gives an error that names it.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.functions.text import ustrip

RATER_COLUMNS = ["comment_id", "polarity", "emotion"]
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _text(node) -> str:
    """The text of an inline or shared string, its formatted runs joined (phonetic hints left out)."""
    return "".join(t.text or "" for part in node if part.tag in (MAIN + "t", MAIN + "r")
                   for t in ([part] if part.tag == MAIN + "t" else part.iter(MAIN + "t")))


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _sheet_file(archive: zipfile.ZipFile, sheet: str) -> str:
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    wanted = [s.get(REL_ID) for s in book.iter(MAIN + "sheet") if s.get("name") == sheet]
    if not wanted:
        raise ValueError(f"no sheet {sheet!r}")
    rels = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels.iter(PACKAGE_REL) if r.get("Id") == wanted[0])
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def sheet_rows(content: bytes, sheet: str):
    """(row number from 1, {column number: text}) of a sheet; empty cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            with archive.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == MAIN + "si":
                        shared.append(_text(node))
                        node.clear()
        with archive.open(_sheet_file(archive, sheet)) as f:
            number = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != MAIN + "row":
                    continue
                number = int(row.get("r", number + 1))
                cells, at = {}, -1
                for c in row.iter(MAIN + "c"):
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    kind, value = c.get("t", "n"), c.find(MAIN + "v")
                    if kind == "inlineStr":
                        node = c.find(MAIN + "is")
                        text = _text(node) if node is not None else None
                    elif value is None or value.text is None:
                        text = None
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "b":
                        text = "True" if value.text == "1" else "False"
                    else:
                        text = value.text
                    if text is not None and kind != "e":
                        cells[at] = text
                row.clear()
                yield number, cells


def workbook_rows(files: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """``files`` (path, content) -> (path, row, the named columns), all strings, null where a cell is
    empty.  The sheet's first row holds the columns' names; a missing column is an error, others
    are not read; rows without any of the columns are left out."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType())]
                          + [T.StructField(c, T.StringType()) for c in columns])

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = sheet_rows(content, sheet)
                    _, head = next(rows, (0, {}))
                    at = {name: i for i, name in reversed(list(head.items()))}
                    missing = [c for c in columns if c not in at]
                    if missing:
                        raise ValueError(f"no column {missing[0]!r}")
                    out = []
                    for number, cells in rows:
                        values = [cells.get(at[c]) for c in columns]
                        if any(v is not None for v in values):
                            out.append((path, number, *values))
                        if len(out) == 10_000:
                            yield pd.DataFrame(out, columns=schema.names, dtype=object)
                            out = []
                    yield pd.DataFrame(out, columns=schema.names, dtype=object)
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    raise ValueError(f"{path}: {e}") from e

    return files.select("path", "content").mapInPandas(run, schema)


def read_workbooks(spark: SparkSession, path_glob: str, sheet: str, columns: list[str]) -> DataFrame:
    """The rows of a sheet of all workbooks under ``path_glob`` (see :func:`workbook_rows`)."""
    files = spark.read.format("binaryFile").load(path_glob)
    # one archive at a time in a task
    return workbook_rows(files.select("path", "content").repartition(F.col("path")), sheet, columns)


def read_rater_workbooks(spark: SparkSession, path_glob: str, sheet: str = "Annotate",
                         rater_pattern: str = r"annotator_([^/_.]+)[^/]*\.xlsx$") -> DataFrame:
    """IO4: (rater, comment_id, polarity, emotion) of all raters' workbooks; an empty cell is ''
    and texts are trimmed.  The rater is named by the file."""
    rows = read_workbooks(spark, path_glob, sheet, RATER_COLUMNS)
    return rows.select(F.regexp_extract("path", rater_pattern, 1).alias("rater"),
                       *[ustrip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in RATER_COLUMNS])


def workbook_bytes(rows: list[list[str | None]], sheet: str) -> bytes:
    """A workbook with one sheet of these rows (texts as inline strings, None: no cell)."""
    from xml.sax.saxutils import escape, quoteattr

    def name(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, rest = divmod(i - 1, 26)
            out = chr(65 + rest) + out
        return out

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    body = "".join(
        f'<row r="{r}">' + "".join(
            f'<c r="{name(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
            for i, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, start=1))
    main, rel = MAIN[1:-1], REL_ID[1:-3]
    package = PACKAGE_REL[1:].split("}")[0]
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                               '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                               f'<Override PartName="/xl/workbook.xml" ContentType="{types}sheet.main+xml"/>'
                               f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path, text in parts.items():
            archive.writestr(path, text)
    return out.getvalue()


def workbooks(rows: DataFrame, path_col: str, order_col: str, columns: list[str], sheet: str, per_book: int = 50_000) -> DataFrame:
    """(path, content): ``rows`` as workbooks, one for each path and ``per_book`` rows or so (the file's
    number is put before its extension), the rows in order of ``order_col``."""
    sizes = rows.groupBy(path_col).agg(F.count(F.lit(1)).alias("_n"))
    dealt = rows.join(sizes, path_col).withColumn("_part", F.pmod(F.xxhash64(order_col), F.ceil(F.col("_n") / per_book)))

    def pack(key, pdf):
        pdf = pdf.sort_values(order_col)
        values = pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist()
        stem, _, kind = key[0].rpartition(".")
        return pd.DataFrame({"path": [f"{stem}_{key[1]}.{kind}"], "content": [workbook_bytes([columns, *values], sheet)]})

    return dealt.groupBy(path_col, "_part").applyInPandas(pack, "path string, content binary")
