"""Counts and quality figures of lots, dossiers and portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sources of a unit that count as reliable, weights of the quality index
TRUSTED_SOURCES = ["explicit", "rule", "skeleton"]
WEIGHTS = {"classification": 0.58, "accepted": 0.27, "unit": 0.15}

_EXACT = "decimal(20,6)"


def _mean(c: Column, when: Column) -> Column:
    """Mean over the rows that count, summed in decimals so the order of rows cannot show."""
    return F.sum(F.when(when, c.cast(_EXACT))).cast("double") / F.count_if(when)


def quality_stats(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Quality figures per ``keys``; lines carry ``source_id`` as their lot."""
    item = F.col("kind") == "item"
    reviewed = item & (F.coalesce("review_status", F.lit("")) != "validated")
    manual = F.col("origin") == "manual"
    trusted = item & F.coalesce(F.col("unit_source").isin(*TRUSTED_SOURCES) | manual, F.lit(False))
    measured = item & F.coalesce(
        (F.col("quantity_source") == "explicit") | (manual & F.col("quantity").isNotNull()), F.lit(False)
    )
    unit_confidence = F.when(F.coalesce("unit_confidence", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("unit_confidence"))
    # one row per lot first: a hot dossier reaches the second step as few rows
    counted = lines.groupBy(*keys).agg(
        F.countDistinct("source_id").alias("lots"),
        F.count_if(F.col("kind") == "section").alias("sections"),
        F.count_if(item).alias("items"),
        F.count_if(reviewed).alias("to_review"),
        F.count_if(trusted).alias("trusted"),
        F.count_if(measured).alias("measured"),
        _mean(F.coalesce("confidence", F.lit(0.0)), item).alias("classification"),
        _mean(unit_confidence, item).alias("unit_quality"),
    )
    some = F.col("items") > 0
    accepted = (F.col("items") - F.col("to_review")) / F.col("items")
    index = (
        F.col("classification") * WEIGHTS["classification"] + accepted * WEIGHTS["accepted"] + F.col("unit_quality") * WEIGHTS["unit"]
    )
    percent = lambda c: F.when(some, F.bround(F.col(c) / F.col("items") * 100).cast("int")).otherwise(0)
    ratio = lambda c: F.when(some, F.bround(c, 2)).otherwise(0.0)
    return counted.select(
        *keys,
        "lots",
        "sections",
        "items",
        "to_review",
        (F.col("items") - F.col("to_review")).alias("validated"),
        percent("trusted").alias("unit_coverage"),
        percent("measured").alias("quantity_coverage"),
        ratio(F.col("classification")).alias("classification_confidence"),
        ratio(accepted).alias("accepted_ratio"),
        ratio(F.least(F.lit(0.99), index)).alias("average_confidence"),
    )


def dossier_summary(dossiers: DataFrame, documents: DataFrame, lots: DataFrame, lines: DataFrame) -> DataFrame:
    """Document, lot, line (items) and review counts of each dossier."""
    item = F.col("kind") == "item"
    per_lot = lines.groupBy("source_id").agg(
        F.count_if(item).alias("line_count"), F.count_if(item & (F.col("review_status") != "validated")).alias("review_count")
    )
    per_dossier = (
        lots.select("dossier_id", "source_id")
        .join(per_lot, "source_id", "left")
        .groupBy("dossier_id")
        .agg(
            F.count("*").alias("lot_count"),
            F.coalesce(F.sum("line_count"), F.lit(0)).alias("line_count"),
            F.coalesce(F.sum("review_count"), F.lit(0)).alias("review_count"),
        )
    )
    held = documents.groupBy("dossier_id").agg(F.count("*").alias("document_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        dossiers.select("dossier_id")
        .join(held, "dossier_id", "left")
        .join(per_dossier, "dossier_id", "left")
        .select("dossier_id", zero("document_count"), zero("lot_count"), zero("line_count"), zero("review_count"))
    )


def dossier_status(summary: DataFrame) -> DataFrame:
    """Append status and progress. ``summary`` may carry ``done_count``, documents treated so far."""
    status = F.when(F.col("lot_count") == 0, "failed").when(F.col("review_count") > 0, "needs_review").otherwise("ready")
    if "done_count" not in summary.columns:
        return summary.withColumn("status", status).withColumn("progress", F.lit(100))
    total = F.greatest(F.lit(1), F.col("document_count"))
    running = F.col("done_count") < F.col("document_count")
    progress = F.when(running, F.lit(10) + F.bround(F.col("done_count") / total * 78).cast("int")).otherwise(100)
    return summary.withColumn("status", F.when(running, "processing").otherwise(status)).withColumn("progress", progress)


def portfolio_totals(dossiers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Projects, ready projects, lots and lines of the dossiers a viewer sees."""
    return dossiers.groupBy(*(keys or [])).agg(
        F.count("*").alias("projects"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.coalesce(F.sum("lot_count"), F.lit(0)).alias("lots"),
        F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"),
    )


def lot_counters(lines: DataFrame) -> DataFrame:
    item = F.col("kind") == "item"
    return lines.groupBy("source_id").agg(
        F.count_if(item).alias("items"), F.count_if(item & (F.col("review_status") != "validated")).alias("to_review")
    )
