"""From the positioned spans of printed pages to blocks.

``spans``: source_id, page, line_no, span_no, text, size, flags, font, x0, y0,
x1, y1, page_width, page_height. ``line_no`` runs through a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metreur.functions.codes import CODE_ONLY
from metreur.functions.text import clean_block_text, repeat_key, trim_blanks
from metreur.operators import ordered

BOLD_FLAG = 16
LINE_KEYS = ["source_id", "page", "line_no"]
# lines of a document in order: page by page, with room for this many on a page
_PAGE_ROOM = 1 << 24


def assemble_pdf_lines(spans: DataFrame) -> DataFrame:
    """One row per printed line that holds text."""
    box = ["x0", "y0", "x1", "y1", "page_width", "page_height"]
    texts = F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"])
    return (
        spans.groupBy(*LINE_KEYS)
        .agg(
            F.array_join(texts, "").alias("text"),
            F.coalesce(F.max(F.when(F.col("text") != "", F.col("size"))), F.lit(0.0)).alias("size"),
            F.bool_or((F.col("flags").bitwiseAND(BOLD_FLAG) != 0) | F.contains(F.lower("font"), F.lit("bold"))).alias("bold"),
            *[(F.min if c in ("x0", "y0") else F.max)(c).alias(c) for c in box],
        )
        .withColumn("text", clean_block_text("text"))
        .where(F.col("text") != "")
    )


def merge_split_headings(lines: DataFrame) -> DataFrame:
    """Join a number printed alone with the title printed to its right.

    A consumed title is never a lone number, so merges cannot chain and each
    line only looks at the next.
    """
    nxt = ["text", "size", "bold", "x0", "y0", "x1", "y1", "line_no"]
    seen = ordered.following(lines, ["source_id", "page"], "line_no", nxt, "n")
    text, n = F.col("text"), F.col("n")
    merges = (
        text.rlike(CODE_ONLY)
        & (F.abs(F.col("y0") - n["y0"]) <= F.greatest(F.lit(2.6), F.col("size") * 0.22))
        & (n["x0"] >= F.col("x0") + 8)
        & F.length(n["text"]).between(2, 220)
        & ~n["text"].rlike(CODE_ONLY)
        & ~n["text"].rlike("^[•\\-–]")
        & ((F.col("bold") == n["bold"]) | (F.abs(F.col("size") - n["size"]) <= 1.2))
    )
    marked = seen.withColumn("merged_heading", F.coalesce(merges, F.lit(False)))
    consumed = marked.where("merged_heading").select("source_id", "page", F.col("n.line_no").alias("line_no"))
    code = trim_blanks("text")
    code = F.when(code.rlike(r"^.*\..*\.$"), F.substring(code, F.lit(1), F.length(code) - 1)).otherwise(code)
    joined = {
        "text": F.concat(code, F.lit(" "), n["text"]),
        "x1": F.greatest("x1", n["x1"]),
        "y1": F.greatest("y1", n["y1"]),
        "size": F.greatest("size", n["size"]),
        "bold": F.col("bold") | n["bold"],
    }
    return marked.join(consumed, LINE_KEYS, "left_anti").select(
        *[
            (F.when(F.col("merged_heading"), joined[c]).otherwise(F.col(c)) if c in joined else F.col(c)).alias(c)
            for c in lines.columns
        ],
        "merged_heading",
    )


def repeated_keys(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_id, repeat_key) of running headers and footers.

    ``pages``: source_id, page_count.
    """
    edge = (F.col("y0") <= F.col("page_height") * 0.09) | (F.col("y1") >= F.col("page_height") * 0.91)
    keyed = lines.where(edge & (F.length("text") < 160)).select("source_id", "page", repeat_key("text").alias("repeat_key"))
    threshold = F.greatest(F.lit(3), F.bround(F.col("page_count") * 0.35).cast("int"))
    return (
        keyed.where(F.length("repeat_key") >= 4)
        .groupBy("source_id", "repeat_key")
        .agg(F.countDistinct("page").alias("pages"))
        .join(pages.where(F.col("page_count") > 2), "source_id")
        .where(F.col("pages") >= threshold)
        .select("source_id", "repeat_key")
    )


def drop_repeated_boundaries(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Drop every line that reads like a running header or footer, wherever it stands."""
    keyed = lines.withColumn("repeat_key", repeat_key("text"))
    return keyed.join(repeated_keys(lines, pages), ["source_id", "repeat_key"], "left_anti").drop("repeat_key")


def body_sizes(spans: DataFrame) -> DataFrame:
    """Median span size of each document. Sizes are counted first: few differ."""
    sized = spans.where((F.col("text") != "") & (F.col("size") != 0)).groupBy("source_id", "size").agg(F.count("*").alias("n"))
    return sized.groupBy("source_id").agg(F.percentile("size", F.lit(0.5), F.col("n")).alias("body_size"))


def flag_pdf_headings(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks from the lines that remain, headings flagged by weight and size."""
    placed = lines.withColumn("line_pos", F.col("page").cast("bigint") * _PAGE_ROOM + F.col("line_no"))
    sized = ordered.numbered(placed, ["source_id"], "line_pos", "order").join(sizes, "source_id", "left")
    larger = (F.coalesce("body_size", F.lit(0.0)) != 0) & (F.col("size") >= F.col("body_size") * 1.07)
    heading = F.col("bold") | F.col("merged_heading") | F.coalesce(larger, F.lit(False))
    box = ["x0", "y0", "x1", "y1", "page_width", "page_height"]
    return sized.select(
        "source_id",
        F.col("order").cast("int").alias("pos"),
        "text",
        "page",
        F.when(heading, "Heading").otherwise("").alias("style"),
        F.bround("size", 2).alias("font_size"),
        "bold",
        F.when(F.col("merged_heading"), "pdf_merged_heading").otherwise("pdf_line").alias("source_kind"),
        *[F.bround(c, 2).alias(c) for c in box],
    )


def low_text_warning(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Printed documents with too little text: source_id, character_count, message."""
    counted = blocks.groupBy("source_id").agg(F.sum(F.length("text")).alias("character_count"))
    return (
        documents.where(F.col("extension") == ".pdf")
        .select("source_id", "page_count")
        .join(counted, "source_id", "left")
        .withColumn("character_count", F.coalesce("character_count", F.lit(0)))
        .where(F.col("character_count") < F.greatest(F.lit(250), F.col("page_count") * 80))
        .select(
            "source_id",
            "character_count",
            F.lit(
                "Le document contient très peu de texte exploitable. Il peut s'agir d'un PDF scanné nécessitant un OCR."
            ).alias("message"),
        )
    )


def read_pdf_blocks(spans: DataFrame) -> DataFrame:
    """The steps above in order."""
    pages = spans.groupBy("source_id").agg(F.max("page").alias("page_count"))
    lines = merge_split_headings(assemble_pdf_lines(spans))
    return flag_pdf_headings(drop_repeated_boundaries(lines, pages), body_sizes(spans))
