"""Delivered bills, read from their cells.

``cells``: pair, sheet, row, col, value; rows and columns from 1.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metreur import catalogue
from metreur.functions.text import collapse, normalize_text, trim_blanks
from metreur.operators import ordered

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_COLUMNS = ["pair", "sheet", "row", "col", "value"]


def code_columns(cells: DataFrame) -> DataFrame:
    """Column of the codes in each bill: most dotted codes among the first six, the first of equals, else 1."""
    dotted = trim_blanks("value").rlike(r"^\d+(?:\.\d+)+$")
    counted = (
        cells.where((F.col("sheet") == 1) & F.col("col").between(1, 6))
        .groupBy("pair", "col")
        .agg(F.count_if(dotted).alias("n"))
    )
    best = F.max_by("col", F.struct(F.col("n"), (-F.col("col")).alias("left")))
    return counted.groupBy("pair").agg(F.when(F.max("n") > 0, best).otherwise(1).alias("code_col"))


def read_reference_bill(cells: DataFrame) -> DataFrame:
    """Lines of delivered bills: pair, ref_index, code, designation, unit, kind."""
    first = cells.where((F.col("sheet") == 1) & F.col("value").isNotNull())
    placed = first.join(code_columns(cells), "pair").withColumn("place", F.col("col") - F.col("code_col"))
    value = lambda n: F.coalesce(trim_blanks(F.max(F.when(F.col("place") == n, F.col("value")))), F.lit(""))
    rows = (
        placed.where(F.col("place").between(0, 2))
        .groupBy("pair", "row")
        .agg(value(0).alias("code"), value(1).alias("designation"), value(2).alias("unit"))
        .withColumn("designation", collapse("designation"))
    )
    header = rows.where(F.lower("code") == "code").groupBy("pair").agg(F.min("row").alias("header_row"))
    normalized = normalize_text("designation")
    works = (
        rows.join(header, "pair", "left")
        .where(F.col("row") > F.coalesce("header_row", F.lit(0)))
        .where(F.length("designation") >= 3)
        .withColumn("normalized", normalized)
        .where(~F.col("normalized").rlike("(?i)" + catalogue.BILL_TOTAL_PATTERN) & ~F.col("normalized").isin(*catalogue.BILL_NOISE))
    )
    return ordered.numbered(works, ["pair"], "row", "rank").select(
        "pair",
        (F.col("rank") - 1).cast("int").alias("ref_index"),
        "code",
        trim_blanks(F.ltrim("designation", F.lit("->• "))).alias("designation"),
        "unit",
        F.when(F.col("unit") != "", "item").otherwise("section").alias("kind"),
    )


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number


def _sheet_cells(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        read = lambda name: ElementTree.fromstring(archive.read(name))
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in item.iter(_S + "t")) for item in read("xl/sharedStrings.xml").findall(_S + "si")]
        first = read("xl/workbook.xml").find(f"{_S}sheets/{_S}sheet").get(_R + "id")
        targets = {link.get("Id"): link.get("Target") for link in read("xl/_rels/workbook.xml.rels")}
        target = targets[first].lstrip("/")
        for cell in read(target if target.startswith("xl/") else "xl/" + target).iter(_S + "c"):
            value, inline = cell.find(_S + "v"), cell.find(_S + "is")
            text = value.text if value is not None else None
            if cell.get("t") == "s" and text is not None:
                text = shared[int(text)]
            elif inline is not None:
                text = "".join(t.text or "" for t in inline.iter(_S + "t"))
            if text is not None:
                place = cell.get("r")
                yield int(re.search(r"\d+", place).group()), _column_number(place), text


def _decode(batches):
    for files in batches:
        rows = []
        for pair, content in zip(files["pair"], files["content"]):
            try:
                rows += [(pair, 1, row, col, text, None) for row, col, text in _sheet_cells(content)]
            except Exception as problem:  # told beside the cells
                rows.append((pair, None, None, None, None, f"{type(problem).__name__}: {problem}"))
        found = pd.DataFrame(rows, columns=[*_COLUMNS, "error"])
        yield found.astype({"sheet": "Int32", "row": "Int32", "col": "Int32"})


def read_workbook_cells(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of the first sheet of each workbook, and (pair, error) of those that cannot be read.

    ``files``: pair, content. A pair that failed is no empty bill: leave it out
    of the totals.
    """
    read = files.select("pair", "content").mapInPandas(_decode, "pair string, sheet int, row int, col int, value string, error string")
    return read.where("error is null").drop("error"), read.where("error is not null").select("pair", "error")


def read_csv_cells(spark, path: str) -> DataFrame:
    """Cells already laid out as rows."""
    schema = "pair string, sheet int, row int, col int, value string"
    return spark.read.csv(path, header=True, schema=schema)
