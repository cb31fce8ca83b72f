"""Orders and first-n reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metreur.functions.codes import natural_code_key
from metreur.functions.text import normalize_text
from metreur.functions.units import classify_family


def lot_order(lots: DataFrame) -> DataFrame:
    """Append the sort key of lots: code by value, usual place of the trade, title."""
    return (
        lots.withColumn("code_key", natural_code_key(F.coalesce("lot_code", F.lit(""))))
        .withColumn("title_norm", normalize_text(F.coalesce("lot_title", F.lit(""))))
        .withColumn("family_rank", classify_family("title_norm", normalized=True)["rank"])
        .withColumn("title_key", F.lower(F.coalesce("lot_title", F.lit(""))))
        .drop("title_norm")
    )


def order_lots(lots: DataFrame) -> DataFrame:
    keyed = lot_order(lots)
    return keyed.orderBy("code_key", "family_rank", "title_key").select(lots.columns)


def top_examples(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of each key.

    Every key is first cut into 64 parts that keep their own first ``n``; the
    second pass compares at most 64 n rows.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    few = salted.withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= n)
    final = Window.partitionBy(*keys).orderBy(*order)
    return few.withColumn("__n", F.row_number().over(final)).where(F.col("__n") <= n).select(rows.columns)
