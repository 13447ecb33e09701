"""Readers of delimited and JSON files, sheets and pages of rows, with columns cleaned, mapped and typed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import text as t

DATE_FORMS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy")


def clean_name(name) -> str:
    text = "" if name is None else str(name).strip()
    return text.lower().replace(" ", "_").replace("\n", "_") or "unnamed"


def map_columns(columns: Sequence[str], fields: Sequence[dict]) -> dict[str, str]:
    """Column to field name: for each column the first field that equals it, or whose selector or name holds it or lies in it."""
    found = {}
    for column in columns:
        name = clean_name(column)
        for field in fields:
            own, selector = clean_name(field["name"]), (field.get("selector") or "").lower()
            if name == own or selector and (selector in name or name in selector) or own in name or name in own:
                found[column] = field["name"]
                break
    return found


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, encoding: str = "utf-8", schema: str | None = None, columns: Sequence[str] | None = None, skip: int = 0) -> DataFrame:
    """A delimited file as strings (or by a schema). Lines that do not fit are dropped; count_malformed counts them.

    skip: lines of every file before its header; such files are read a line at a time, so their
    values hold no line breaks, and they are UTF-8.
    """
    if skip:
        if encoding.lower().replace("-", "") not in ("utf8", "usascii"):
            raise ValueError("files with lines to skip must be UTF-8")
        rows = _skipped(spark, path, sep, header, schema, skip)
    else:
        rows = spark.read.option("sep", sep).option("encoding", encoding).option("multiLine", "true").option("mode", "DROPMALFORMED").csv(path, header=header, schema=schema)
    rows = rows.toDF(*[clean_name(c) for c in rows.columns]) if header and schema is None else rows
    return rows.select(*columns) if columns else rows


def _skipped(spark: SparkSession, path: str, sep: str, header: bool, schema: str | None, skip: int) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    # ids follow one another within a block of a file, so its first lines are those from the least id on
    first = lines.where("block = 0").groupBy("file").agg(F.min("i").alias("first"))
    after = lines.join(first, "file").where((F.col("block") > 0) | (F.col("i") >= F.col("first") + skip))
    head = after.where((F.col("block") == 0) & (F.col("i") == F.col("first") + skip)).orderBy("file").select("value").first()
    if head is None:
        return spark.createDataFrame([], schema or "unnamed string")
    cells = F.from_csv(F.lit(head[0]), F.lit(", ".join(f"c{i} string" for i in range(head[0].count(sep) + 1))), {"sep": sep})
    names = list(spark.range(1).select(cells.alias("r")).select("r.*").first())
    while names and names[-1] is None:  # separators inside quotes leave fields over
        names.pop()
    if header:
        after = after.where((F.col("block") > 0) | (F.col("i") > F.col("first") + skip))
    kinds = schema or ", ".join(f"`{n or f'_c{i}'}` string" if header else f"_c{i} string" for i, n in enumerate(names))
    row = F.from_csv("value", F.lit(f"{kinds}, _bad string"), {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return after.where(F.length("value") > 0).select(row.alias("r")).where("r._bad is null").select("r.*").drop("_bad")


def count_malformed(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, encoding: str = "utf-8") -> int:
    """How many records do not fit the schema, which readers drop."""
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad")
    rows = reader.csv(path, header=header, schema=f"{schema}, _bad string")
    # the other columns must be read too for a record to be parsed
    return rows.select(F.count_if(F.col("_bad").isNotNull() & (F.to_json(F.struct(*rows.columns)) != ""))).first()[0]


def read_tabs(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, sep="\t", **options)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    return spark.read.option("multiLine", str(not lines).lower()).option("mode", "DROPMALFORMED").json(path, schema=schema)


def read_sheets(spark: SparkSession, path: str, sheets: Sequence[str] | None = None, header_row: int = 0) -> DataFrame:
    """All sheets of the workbooks at a path as strings, with the sheet's name in _sheet and the file in _path; columns that a sheet lacks are null.

    Workbooks are read in tasks; only the head of each different sheet layout reaches the driver.
    """
    from tributary.sources.workbooks import read_files, sheet_rows

    rows = sheet_rows(read_files(spark, path)).where(F.col("row") >= header_row)
    rows = rows.where(F.col("sheet").isin(list(sheets))) if sheets else rows
    heads = rows.where(F.col("row") == header_row).select("path", "sheet", F.col("cells").alias("head"))
    both = rows.where(F.col("row") > header_row).join(heads, ["path", "sheet"])
    parts = []
    for (head,) in heads.select("head").distinct().collect():  # one for each layout
        names: dict[str, int] = {}
        for i, c in enumerate(head):
            name = clean_name(c)
            names[name if name not in names else f"{name}_{i}"] = i
        mine = both.where(F.col("head").eqNullSafe(F.lit([c for c in head]).cast("array<string>")))
        cells = [F.try_element_at("cells", F.lit(i + 1)).alias(n) for n, i in names.items()]
        parts.append(mine.select(*cells, F.col("sheet").alias("_sheet"), F.col("path").alias("_path")).dropna(how="all", subset=list(names)))
    return union_all(parts) if parts else rows.select(F.col("sheet").alias("_sheet"), F.col("path").alias("_path")).where("false")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of all parts; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pages(parts: Sequence[DataFrame], key: str | None = None, most: int | None = None) -> DataFrame:
    """Pages of a listing as one table: at most `most` pages, and each item once if it has a key."""
    tagged = [p.withColumn("_page", F.lit(i)) for i, p in enumerate(parts[:most] if most else parts)]
    rows = union_all(tagged)
    if key is None:
        return rows
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "_page").alias("r")).select("r.*")


def mapped(rows: DataFrame, fields: Sequence[dict]) -> DataFrame:
    """rows with the columns that a field claims, under its name; the first column of a field wins."""
    claimed: dict[str, str] = {}
    for column, field in map_columns(rows.columns, fields).items():
        claimed.setdefault(field, column)
    return rows.select(*[F.col(f"`{c}`").alias(f) for f, c in claimed.items()])


def typed(rows: DataFrame, fields: Sequence[dict]) -> DataFrame:
    """Strings to their field's data_type (number, date or string); what cannot be read is null, and so is the text nan."""
    out = {}
    for field in fields:
        name, kind = field["name"], field.get("data_type", "string")
        if name not in rows.columns:
            continue
        c = F.col(f"`{name}`").cast("string")
        if kind == "number":
            x = t.strip(c).try_cast("double")
            out[name] = F.when(~F.isnan(x), x)
        elif kind == "date":
            out[name] = F.coalesce(*[F.try_to_timestamp(t.strip(c), F.lit(f)) for f in DATE_FORMS])
        else:
            out[name] = F.when(F.lower(c) != "nan", c)
    return rows.withColumns(out).dropna(how="all")


def zipped(rows: DataFrame, lists: Sequence[str]) -> DataFrame:
    """Arrays side by side: a row for each place of the longest, null where another ends, with its place."""
    rest = [c for c in rows.columns if c not in lists]
    return rows.select(*rest, F.posexplode_outer(F.arrays_zip(*lists)).alias("place", "z")).select(*rest, "place", *[F.col(f"z.{c}").alias(c) for c in lists])


def extract_patterns(rows: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """Each field's pattern in a text: its first group, or the whole match without one; null without a match."""
    import re

    out = {}
    for name, pattern in fields.items():
        group = 1 if re.compile(pattern).groups else 0
        found = F.regexp_extract(F.col(text), f"(?im){pattern}", group)
        out[name] = F.when(F.col(text).rlike(f"(?im){pattern}"), found)
    return rows.withColumns(out)


def text_rows(boxes: DataFrame, page: str, tolerance: float = 20.0) -> DataFrame:
    """(page, row, cells) of recognised boxes (page, x, y, text): a row ends where y leaves its running middle.

    The middle depends on all boxes before, so a page is read in order; a page is one group.
    """
    import pandas as pd

    def rows(group: pd.DataFrame) -> pd.DataFrame:
        found, middle = [], None
        for x, y, text in group.sort_values(["y", "x"], kind="stable")[["x", "y", "text"]].itertuples(index=False):
            if middle is None or abs(y - middle) > tolerance:
                found.append([])
                middle = y
            else:
                middle = (middle + y) / 2
            found[-1].append((x, text))
        return pd.DataFrame({page: group[page].iloc[0], "row": range(len(found)), "cells": [[t for _, t in sorted(r, key=lambda b: b[0])] for r in found]})

    kind = dict(boxes.dtypes)[page]
    return boxes.where("x is not null and y is not null").groupBy(page).applyInPandas(rows, f"`{page}` {kind}, row int, cells array<string>")
