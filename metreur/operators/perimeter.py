"""Which headings of a document describe priceable work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metreur.functions import codes
from metreur.functions.text import normalize_text
from metreur.operators import ordered

DEMOLITION = "desamiantage_demolition"
#: Deepest heading level; headings below it are refused.
DEEPEST = 12


def _with_part(headings: DataFrame) -> DataFrame:
    return headings.withColumn("part", codes.first_part("code")).where(F.col("part").isNotNull())


def score_anchors(headings: DataFrame) -> DataFrame:
    """Headings that open a works chapter, with how many deeper headings of that chapter follow.

    Counted by running sums read from the end of the document, one per level,
    so no heading is ever paired with another.
    """
    backwards = _with_part(headings).withColumn("back", -F.col("pos"))
    deeper = {f"deeper_{k}": (F.col("level") > k).cast("bigint") for k in range(1, DEEPEST + 1)}
    counted = ordered.running(backwards, ["source_id", "part"], "back", sums=deeper, strict=True)
    refused = F.raise_error(F.lit(f"a heading lies deeper than level {DEEPEST}")).cast("bigint")
    score = F.when(F.col("level") > DEEPEST, refused).otherwise(F.lit(0).cast("bigint"))
    for k in range(DEEPEST, 0, -1):
        score = F.when(F.col("level") == k, F.col(f"deeper_{k}")).otherwise(score)
    return counted.where(codes.opens_work("title")).select(*headings.columns, "part", score.alias("score"))


def _facts(*extra):
    return F.struct(
        F.col("code").alias("anchor_code"),
        F.col("title").alias("anchor_title"),
        F.col("page").alias("start_page"),
        F.col("pos").alias("start_pos"),
        F.col("part"),
        *extra,
    )


def forced_anchors(headings: DataFrame, lots: DataFrame) -> DataFrame:
    asked = lots.where(F.coalesce("forced_code", F.lit("")) != "").select(
        "source_id", codes.normalize_code("forced_code").alias("code")
    )
    return (
        _with_part(headings).join(asked, ["source_id", "code"]).groupBy("source_id").agg(F.min_by(_facts(), "pos").alias("forced"))
    )


def trade_anchors(headings: DataFrame, lots: DataFrame) -> DataFrame:
    """Demolition lots: site setup, else the first heading of the trade's works."""
    demolition = lots.where(F.col("family") == DEMOLITION).select("source_id")
    title = normalize_text("title")
    opens = r"^(?:installation de chantier|travaux de (?:desamiantage|curage|deconstruction|demolition))\b"
    found = (
        headings.join(demolition, "source_id", "left_semi")
        .withColumn("part", codes.first_part("code"))
        .withColumn("normalized", title)
        .where(F.col("normalized").rlike(opens))
    )
    setup = F.when(F.col("normalized") == "installation de chantier", F.col("pos"))
    return found.groupBy("source_id").agg(
        F.coalesce(F.min_by(_facts(), setup), F.min_by(_facts(), "pos")).alias("trade")
    )


def explicit_anchors(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(richest opening of each document, chapters of comparable richness)."""
    best = scored.groupBy("source_id").agg(
        F.max_by(_facts(F.col("score")), F.struct(F.col("score"), (-F.col("pos")).alias("back"))).alias("explicit")
    )
    chapters = scored.groupBy("source_id", "part").agg(F.max("score").alias("score")).join(best, "source_id").where(
        F.col("score") >= F.col("explicit.score") * 0.6
    )
    return best, chapters.select("source_id", "part", F.col("explicit.start_pos").alias("start_pos"))


def dominant_chapters(headings: DataFrame) -> DataFrame:
    """Most frequent first part among codes of two parts and more."""
    counted = (
        _with_part(headings)
        .where(codes.code_level("code") >= 2)
        .groupBy("source_id", "part")
        .agg(F.count("*").alias("n"), F.min_by(_facts(), "pos").alias("first"))
    )
    order = F.struct(F.col("n"), codes.natural_code_key("part").alias("key"), (-F.col("first.start_pos")).alias("back"))
    return counted.groupBy("source_id").agg(
        F.max_by(
            F.struct(
                F.col("part").alias("anchor_code"),
                F.col("first.anchor_title").alias("anchor_title"),
                F.col("first.start_page").alias("start_page"),
                F.col("part"),
                F.col("n"),
            ),
            order,
        ).alias("dominant")
    )


def select_perimeter(headings: DataFrame, lots: DataFrame, cut=None) -> tuple[DataFrame, DataFrame]:
    """(perimeter of each lot, headings inside it).

    ``lots``: source_id, family, forced_code. The ways of finding a perimeter
    are worked out side by side, one row per document each, and the first that
    answers is kept; the headings are then read once more. ``cut`` may store
    anchors and perimeters, which both results are read from.
    """
    cut = cut or (lambda df: df)
    # only chapters that something opens have a score
    parts = _with_part(headings)
    opened = parts.where(codes.opens_work("title")).select("source_id", "part").distinct()
    scored = score_anchors(parts.join(opened, ["source_id", "part"], "left_semi").select(headings.columns))
    best, chapters = explicit_anchors(cut(scored))
    found = (
        lots.select("source_id", "family")
        .join(forced_anchors(headings, lots), "source_id", "left")
        .join(trade_anchors(headings, lots), "source_id", "left")
        .join(best, "source_id", "left")
        .join(dominant_chapters(headings), "source_id", "left")
    )
    # fixed values: names and confidences of the methods
    ways = [
        ("forced", "llm_confirmed_anchor", F.lit(0.9)),
        ("trade", "trade_work_anchor", F.lit(0.96)),
        ("explicit", "explicit_anchor", F.lit(0.98)),
        ("dominant", "dominant_numbered_chapter", F.when(F.col("dominant.n") >= 6, 0.92).otherwise(0.78)),
    ]
    case = None
    for name, method, confidence in ways:
        facts = F.struct(
            F.lit(method).alias("method"),
            F.col(f"{name}.anchor_code").alias("anchor_code"),
            F.col(f"{name}.anchor_title").alias("anchor_title"),
            F.col(f"{name}.start_page").alias("start_page"),
            confidence.alias("confidence"),
            (F.col(f"{name}.start_pos") if name != "dominant" else F.lit(0)).cast("int").alias("start_pos"),
            F.col(f"{name}.part").alias("part"),
        )
        held = F.col(name).isNotNull()
        case = F.when(held, facts) if case is None else case.when(held, facts)
    nothing = F.struct(
        F.lit("not_found").alias("method"),
        F.lit("").alias("anchor_code"),
        F.lit("").alias("anchor_title"),
        F.lit(None).cast("int").alias("start_page"),
        F.lit(0.0).alias("confidence"),
        F.lit(None).cast("int").alias("start_pos"),
        F.lit(None).cast("string").alias("part"),
    )
    perimeters = cut(found.select("source_id", "family", case.otherwise(nothing).alias("p")).select("source_id", "family", "p.*"))
    one_chapter = perimeters.where(F.col("method").isin("llm_confirmed_anchor", "dominant_numbered_chapter"))
    several = perimeters.where(F.col("method") == "explicit_anchor").select("source_id").join(chapters, "source_id")
    by_part = one_chapter.select("source_id", "part", "start_pos").unionByName(several.select("source_id", "part", "start_pos"))
    open_ended = perimeters.where(F.col("method") == "trade_work_anchor").select(
        "source_id", F.col("start_pos").alias("open_pos")
    )
    selected = (
        headings.withColumn("part", codes.first_part("code"))
        .join(by_part, ["source_id", "part"], "left")
        .join(open_ended, "source_id", "left")
        .where(F.col("pos") >= F.coalesce("start_pos", "open_pos"))
        .select(headings.columns)
    )
    return perimeters.drop("start_pos", "part"), selected
