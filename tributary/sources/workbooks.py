"""Workbooks (XLSX) and delimited files in any encoding, read and written where the rows are.

Files come as Spark's own binaryFile rows, so any store that Spark reads will do, and each file is
read in the task that holds it. A workbook is a zip of XML parts; strings may be shared or in line,
numbers, booleans and formula results are taken as they are stored, gaps in a row are nulls.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.history import tables_of
from tributary.sources.files import clean_name

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: rows of an exported sheet, as a workbook's other readers expect them
MOST_ROWS = 50_000


def _column(number: int) -> str:
    out = ""
    while number:
        number, digit = divmod(number - 1, 26)
        out = chr(65 + digit) + out
    return out


def _place(reference: str) -> int:
    number = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        number = number * 26 + ord(c) - 64
    return number - 1


def _cell(at: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def to_xlsx(sheets: dict[str, Sequence[Sequence]]) -> bytes:
    """A workbook of sheets by name, each rows of cells (text, numbers, booleans, nulls)."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, office = MAIN[1:-1], LINK[1:-1]
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    listed = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>',
    }
    for i, rows in enumerate(sheets.values(), 1):
        lines = "".join(f'<row r="{r}">{"".join(_cell(f"{_column(c)}{r}", v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(zipfile.ZipInfo(name), head + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def from_xlsx(data: bytes) -> dict[str, list[list[str | None]]]:
    """The sheets of a workbook by name, as rows of text; rows that are left out in the file are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        tree = lambda name: ElementTree.fromstring(book.read(name))
        shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in tree("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        target = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        out = {}
        for sheet in tree("xl/workbook.xml").iter(f"{MAIN}sheet"):
            path = target[sheet.get(f"{LINK}id")]
            rows: list[list] = []
            for row in tree(path.lstrip("/") if path.startswith("/") else f"xl/{path}").iter(f"{MAIN}row"):
                rows += [[] for _ in range(int(row.get("r", len(rows) + 1)) - len(rows) - 1)]
                cells: list = []
                for cell in row.iter(f"{MAIN}c"):
                    at = _place(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in cell.iter(f"{MAIN}t")))
                    elif value is None or value.text is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(value.text)] if kind == "s" else ("TRUE" if value.text == "1" else "FALSE") if kind == "b" else value.text)
                rows.append(cells)
            out[sheet.get("name")] = rows
    return out


def encoding_of(data: bytes) -> str:
    """A text's encoding: by its mark, as UTF-8 if it is valid, else the one of which its bytes make most sense.

    Of the encodings that can be decoded strictly, the one wins whose characters beyond ASCII are
    most often letters of the script that it is used for.
    """
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name
    head = data[: 1 << 20]
    try:
        data.decode("utf-8")
        return "utf-16-le" if head[1::2].count(0) > len(head) // 4 else "utf-16-be" if head[::2].count(0) > len(head) // 4 else "utf-8"
    except UnicodeDecodeError:
        pass
    if head[1::2].count(0) > len(head) // 8:
        return "utf-16-le"
    if head[::2].count(0) > len(head) // 8:
        return "utf-16-be"
    best, most = "cp1252", -1.0
    for name, script in (("cp949", r"[가-힣]"), ("shift_jis", r"[぀-ヿ一-鿿]"), ("cp1252", r"[À-ÖØ-öø-ÿŒœŠšŸŽž]")):
        try:
            text = head.decode(name, "strict" if len(head) == len(data) else "ignore")
        except UnicodeDecodeError:
            continue
        odd = [c for c in text if c > "\x7f"]
        share = len(re.findall(script, text)) / max(1, len(odd))
        if name == "shift_jis":  # Japanese has kana between its ideographs
            share *= min(1.0, 4 * len(re.findall(r"[぀-ヿ]", text)) / max(1, len(odd)))
        if name == "cp1252":  # letters of a Latin word stand among ASCII ones
            share *= min(1.0, 2 * len(re.findall(r"[a-zA-Z][À-ÿ]|[À-ÿ][a-zA-Z]", text)) / max(1, len(odd)))
        if share > most:
            best, most = name, share
    return best


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of the files below a path; a file must fit into a task's memory."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def parsed(data: bytes) -> list[list[list[str | None]]]:
    """The tables of a file: a workbook's sheets, or one of comma-, tab-, semicolon- or bar-separated text in any encoding."""
    if data[:4] == b"PK\x03\x04":
        return list(from_xlsx(data).values())
    text = data.decode(encoding_of(data), "replace")
    first = next((line for line in text.splitlines() if line.strip()), "")
    sep = max(",\t;|", key=first.count)
    return [[[c if c != "" else None for c in row] for row in csv.reader(io.StringIO(text), delimiter=sep)]]


def read_tables(files: DataFrame, fields: Sequence[str], key: str = "path") -> DataFrame:
    """(path, table, row, fields as strings) of all tables of all files, heads matched to the fields."""
    return tables_of(files, key, "content", parsed, fields)


def workbooks(rows: DataFrame, book: str, sheet: str, columns: Sequence[str], order: str, most: int = MOST_ROWS) -> DataFrame:
    """(book, content) with a workbook for each value of `book`, a sheet for each of `sheet`, of at most `most` rows each in order.

    What a sheet cannot hold goes to further ones, so no row is lost; a workbook is made in one
    task, which is what a workbook allows.
    """
    import pandas as pd

    def made(group: pd.DataFrame) -> pd.DataFrame:
        sheets: dict[str, list] = {}
        for name, part in group.sort_values([sheet, order], kind="stable").groupby(sheet, sort=True, dropna=False):
            lines = part[list(columns)].astype(object).where(part[list(columns)].notna(), None).values.tolist()
            for i in range(0, len(lines), most):
                title = f"{name}" if i == 0 else f"{name} ({i // most + 1})"
                sheets[title[:31]] = [[clean_name(c) for c in columns], *lines[i : i + most]]
        return pd.DataFrame({book: [group[book].iloc[0]], "content": [to_xlsx(sheets)]})

    kind = dict(rows.dtypes)[book]
    return rows.select(*dict.fromkeys([book, sheet, order, *columns])).groupBy(book).applyInPandas(made, f"`{book}` {kind}, content binary")


def sheet_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, row, cells) of the workbooks among files (path, content)."""
    import pandas as pd

    def rows(batches):
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                if data is not None and bytes(data[:4]) == b"PK\x03\x04":
                    out += [(path, name, i, cells) for name, lines in from_xlsx(bytes(data)).items() for i, cells in enumerate(lines)]
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(rows, "path string, sheet string, row int, cells array<string>")


def encodings(files: DataFrame) -> DataFrame:
    """(path, encoding) as the bytes tell."""
    found = F.pandas_udf(lambda content: content.map(lambda c: encoding_of(bytes(c))), "string")
    return files.select("path", found("content").alias("encoding"))
