"""Blocks of Word files, decoded in Arrow batches where the bytes are."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

BLOCK_SCHEMA = (
    "source_id string, pos int, text string, page int, style string, font_size double, bold boolean,"
    " source_kind string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double,"
    " error string"
)
_COLUMNS = [part.split()[0] for part in BLOCK_SCHEMA.split(",")]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _clean(text: str) -> str:
    text = text.replace("\u00a0", " ").replace("\u200b", "").replace("\uf0a7", "\u2022")
    return re.sub("[ \t]+", " ", text).strip()


def _text(element) -> str:
    signs = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n", _W + "noBreakHyphen": "-"}
    return "".join((node.text or "") if node.tag == _W + "t" else signs.get(node.tag, "") for node in element.iter())


def _flag(properties, name: str):
    """True or False where the property is set, None where it is not."""
    node = None if properties is None else properties.find(_W + name)
    return None if node is None else node.get(_W + "val", "1") not in ("0", "false", "off")


def _style_names(archive: zipfile.ZipFile) -> tuple[dict[str, str], str]:
    if "word/styles.xml" not in archive.namelist():
        return {}, ""
    names, default = {}, ""
    for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(_W + "style"):
        label = style.find(_W + "name")
        name = label.get(_W + "val", "") if label is not None else ""
        # Word stores built-in names in lower case and shows them capitalised
        name = name[:1].upper() + name[1:] if re.match(r"heading \d$", name) else name
        names[style.get(_W + "styleId", "")] = name
        if style.get(_W + "type") == "paragraph" and style.get(_W + "default") in ("1", "true"):
            default = name
    return names, default


def _runs(paragraph):
    for child in paragraph:
        if child.tag == _W + "r":
            yield child
        elif child.tag == _W + "hyperlink":
            yield from child.findall(_W + "r")


def _paragraph(paragraph, names, default):
    properties = paragraph.find(_W + "pPr")
    chosen = None if properties is None else properties.find(_W + "pStyle")
    style = default if chosen is None else names.get(chosen.get(_W + "val", ""), default)
    if re.match(r"toc\s*\d*$", style.strip().casefold()):
        return None
    text = _clean("".join(_text(run) for run in _runs(paragraph)))
    if not text:
        return None
    runs = [run for run in paragraph.findall(_W + "r") if _text(run).strip()]
    formats = [run.find(_W + "rPr") for run in runs]
    sizes = [
        float(f.find(_W + "sz").get(_W + "val")) / 2 for f in formats if f is not None and f.find(_W + "sz") is not None
    ]
    bold = sum(1 for f in formats if _flag(f, "b"))
    return text, style, max(sizes, default=0.0), bool(runs) and 2 * bold >= len(runs), "paragraph"


def _cells(row, above: list[str]) -> list[str]:
    """Texts by grid column: a merged cell is read once per column and row it covers."""
    texts = []
    for cell in row.findall(_W + "tc"):
        properties = cell.find(_W + "tcPr")
        span = None if properties is None else properties.find(_W + "gridSpan")
        merge = None if properties is None else properties.find(_W + "vMerge")
        if merge is not None and merge.get(_W + "val", "continue") == "continue" and len(texts) < len(above):
            text = above[len(texts)]
        else:
            text = _clean("\n".join(_text(p) for p in cell.findall(_W + "p")))
        texts += [text] * (int(span.get(_W + "val", "1")) if span is not None else 1)
    return texts


def _blocks(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names, default = _style_names(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
        for child in body:
            if child.tag == _W + "p":
                block = _paragraph(child, names, default)
                if block:
                    yield block
            elif child.tag == _W + "tbl":
                cells = []
                for row in child.findall(_W + "tr"):
                    cells = _cells(row, cells)
                    text = " | ".join(cell for cell in cells if cell)
                    if text:
                        yield text, "Table", 0.0, False, "table_row"


def _decode(batches):
    for files in batches:
        rows = []
        for source_id, content in zip(files["source_id"], files["content"]):
            try:
                found = list(_blocks(content))
                rows += [
                    (source_id, n, text, None, style, size, bold, kind, *[None] * 6, None)
                    for n, (text, style, size, bold, kind) in enumerate(found, 1)
                ]
            except Exception as problem:  # one broken file must not fail the corpus
                rows.append((source_id, 0, "", None, "", 0.0, False, "error", *[None] * 6, str(problem)[:500]))
        yield pd.DataFrame(rows, columns=_COLUMNS).astype(object)


def read_docx_blocks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, failures: source_id and error) of Word files.

    ``files``: source_id, content. One file is one row and at most 80 MB.
    """
    decoded = files.select("source_id", "content").mapInPandas(_decode, BLOCK_SCHEMA)
    return decoded.where("error is null").drop("error"), decoded.where("error is not null").select("source_id", "error")
