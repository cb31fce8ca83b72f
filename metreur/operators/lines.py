"""From the headings of a perimeter to typed, scored bill lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metreur.functions import codes, units
from metreur.functions.text import collapse
from metreur.operators import ordered
from metreur.operators.headings import without_object
from metreur.operators.perimeter import DEMOLITION

CONTEXT_BLOCKS = 13
LINE = [
    "source_id", "pos", "line_id", "kind", "level", "code", "designation", "description", "unit", "unit_source",
    "unit_confidence", "quantity", "quantity_source", "unit_price", "included", "confidence", "review_status",
    "review_reason", "review_fields", "source_page", "source_excerpt", "origin", "user_edited",
]


def attach_context(headings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Append ``next`` (following heading), ``context`` and ``is_void``.

    The context is the text of at most 13 blocks after the heading and before
    the next. Each heading asks for those positions by key, so a long document
    spreads over tasks like any other.
    """
    placed = ordered.following(headings, ["source_id"], "pos", ["pos", "code", "level"], "next")
    stop = F.least(F.coalesce(F.col("next.pos"), F.col("pos") + CONTEXT_BLOCKS + 1), F.col("pos") + CONTEXT_BLOCKS + 1)
    wanted = placed.where(stop > F.col("pos") + 1).select(
        "source_id", F.col("pos").alias("heading_pos"), F.explode(F.sequence(F.col("pos") + 1, stop - 1)).alias("pos")
    )
    first = F.col("pos") == F.col("heading_pos") + 1
    texts = (
        blocks.select("source_id", "pos", "text")
        .join(wanted, ["source_id", "pos"])
        .groupBy("source_id", F.col("heading_pos").alias("pos"))
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("blocks"),
            F.max(F.when(first, F.col("text"))).alias("first_text"),
        )
        .select("source_id", "pos", collapse(F.array_join(F.col("blocks.text"), " ")).alias("context"), "first_text")
    )
    return placed.join(texts, ["source_id", "pos"], "left").select(
        *placed.columns,
        F.coalesce("context", F.lit("")).alias("context"),
        F.coalesce(without_object("first_text"), F.lit(False)).alias("is_void"),
    )


def has_child(code, level, next_code, next_level) -> Column:
    """The next heading is deeper and continues this code."""
    code, level, next_code, next_level = (F.col(c) if isinstance(c, str) else c for c in (code, level, next_code, next_level))
    prefix = F.slice(codes.code_parts(next_code), F.lit(1), level)
    return F.coalesce((next_level > level) & (prefix == codes.code_parts(code)), F.lit(False))


def type_lines(headings: DataFrame) -> DataFrame:
    """Append ``is_anchor`` and ``kind``.

    ``headings`` carry ``next`` and the family, method and anchor_code of their perimeter.
    """
    opens = F.col("method").isin("llm_confirmed_anchor", "trade_work_anchor") | (
        (F.col("method") == "explicit_anchor") & codes.opens_work("title")
    )
    parent = has_child("code", "level", F.col("next.code"), F.col("next.level"))
    demolition = (F.col("family") == DEMOLITION) & (F.col("method") == "trade_work_anchor")
    section = F.when(demolition, F.col("is_anchor") | parent).otherwise(
        F.col("is_anchor") | (F.col("level") <= 1) | (parent & (F.col("level") == 2))
    )
    return headings.withColumn("is_anchor", (F.col("code") == F.col("anchor_code")) & opens).withColumn(
        "kind", F.when(section, "section").otherwise("item")
    )


def drop_generic_items(lines: DataFrame) -> DataFrame:
    """Drop items whose title only introduces prose; their children stay."""
    return lines.where(
        (F.col("kind") != "item") | F.col("is_anchor") | ~units.is_generic_title("title_key", normalized=True)
    )


def score_lines(lines: DataFrame) -> DataFrame:
    """Append confidence, review_reason, review_status and review_fields."""
    item = F.col("kind") == "item"
    base = F.col("perimeter_confidence")
    raised = F.when(F.col("source_kind") == "pdf_merged_heading", F.least(F.lit(0.99), base + 0.01)).otherwise(base)
    seen = F.when(~F.col("bold") & (F.col("source_kind") != "paragraph"), raised - 0.03).otherwise(raised)
    plain = F.when(item, seen * 0.78 + F.col("unit_confidence") * 0.22).otherwise(F.greatest(F.lit(0.9), seen))
    doubts = [
        (item & F.col("code_conflict"), 0.12,
         F.concat(F.lit("Code "), F.col("code"), F.lit(" présent avec plusieurs intitulés"))),
        (item & (base < 0.85), 0.08, F.lit("Périmètre des ouvrages à confirmer")),
        (item & (F.col("unit_source") == "default"), 0.08, F.lit("Unité de métré à confirmer")),
    ]
    confidence = plain
    for doubt, cost, _ in doubts:
        confidence = confidence - F.when(doubt, F.lit(cost)).otherwise(0.0)
    reason = F.concat_ws(" · ", *[F.when(doubt, text) for doubt, _, text in doubts])
    return (
        lines.withColumn("confidence", F.bround(F.greatest(F.lit(0.35), F.least(F.lit(0.99), confidence)), 2))
        .withColumn("review_reason", reason)
        .withColumn("review_status", F.when(reason != "", "to_review").otherwise("validated"))
        .withColumn(
            "review_fields",
            F.when(F.col("code_conflict"), F.array(F.lit("code"))).otherwise(F.array().cast("array<string>")),
        )
    )


def build_lines(headings: DataFrame, blocks: DataFrame, perimeters: DataFrame) -> DataFrame:
    """Lines read in the documents, from deduplicated headings."""
    facts = perimeters.select(
        "source_id", "family", "method", "anchor_code", F.col("confidence").alias("perimeter_confidence")
    )
    # the context comes last, so that its texts are not shuffled for places and facts
    indexed = ordered.numbered(headings.join(facts, "source_id"), ["source_id"], "pos", "rank")
    typed = type_lines(attach_context(indexed, blocks)).where(~F.col("is_void"))
    kept = drop_generic_items(typed)
    item = F.col("kind") == "item"
    known = (
        kept.withColumn("u", units.infer_unit("title", "context", "family", "title_key"))
        .withColumn("q", units.explicit_quantity("title", "context"))
        .withColumn("unit", F.when(item, F.col("u.unit")))
        .withColumn("unit_source", F.when(item, F.col("u.source")))
        .withColumn("unit_confidence", F.when(item, F.col("u.confidence")))
        .withColumn("quantity", F.when(item, F.col("q")))
        .withColumn("quantity_source", F.when(item, F.when(F.col("q").isNotNull(), "explicit").otherwise("missing")))
    )
    excerpt = F.concat(F.col("code"), F.lit(" "), F.col("title"), F.lit(". "), F.substring("context", 1, 500))
    return score_lines(known).select(
        "source_id",
        F.col("pos").cast("bigint").alias("pos"),
        codes.stable_line_id("source_id", "code", "title", F.col("rank") - 1).alias("line_id"),
        "kind",
        F.col("level").cast("int").alias("level"),
        "code",
        F.col("title").alias("designation"),
        F.substring("context", 1, 1200).alias("description"),
        "unit",
        "unit_source",
        "unit_confidence",
        "quantity",
        "quantity_source",
        F.lit(None).cast("double").alias("unit_price"),
        (~units.is_option("title")).alias("included"),
        "confidence",
        "review_status",
        "review_reason",
        "review_fields",
        F.col("page").alias("source_page"),
        F.trim(excerpt).alias("source_excerpt"),
        F.lit("deterministic-v2").alias("origin"),
        F.lit(False).alias("user_edited"),
    )


def document_warnings(
    documents: DataFrame, identities: DataFrame, perimeters: DataFrame, lines: DataFrame, blocks: DataFrame | None = None
) -> DataFrame:
    """Messages about each document: source_id, source_name, message."""
    counted = lines.groupBy("source_id").agg(F.count_if(F.col("kind") == "item").alias("items"))
    state = (
        documents.select("source_id", F.col("original_name").alias("source_name"))
        .join(identities.drop("family"), "source_id")
        .join(perimeters, "source_id")
        .join(counted, "source_id", "left")
    )
    conflict = F.concat(
        F.lit("Le nom du fichier annonce le lot "), F.col("lot_code"), F.lit(" alors que le document mentionne le lot "),
        F.col("conflict_code"), F.lit(" « "), F.col("conflict_title"), F.lit(" ». Le lot "), F.col("lot_code"),
        F.lit(" a été retenu : vérifier l'intitulé et les unités."),
    )
    lost = F.lit(
        "Le chapitre des ouvrages n'a pas été identifié avec assez de certitude. Aucune ligne hasardeuse n'a été créée."
    )
    guessed = F.concat(
        F.lit("Périmètre déduit du chapitre dominant "), F.col("anchor_code"),
        F.lit(" (aucun titre « Description des ouvrages » explicite)."),
    )
    empty = F.lit("Aucun poste chiffrable n'a été identifié automatiquement.")
    no_heading = F.col("selected_heading_count") == 0
    messages = F.array_compact(
        F.array(
            F.when(F.col("conflict_code").isNotNull(), conflict),
            F.when(no_heading, lost).when(F.col("method") == "dominant_numbered_chapter", guessed),
            F.when(F.coalesce("items", F.lit(0)) == 0, empty),
        )
    )
    found = state.select("source_id", "source_name", F.explode(messages).alias("message"))
    if blocks is not None:
        from metreur.sources.layout import low_text_warning

        scanned = low_text_warning(documents, blocks)
        found = found.unionByName(
            scanned.join(documents.select("source_id", F.col("original_name").alias("source_name")), "source_id").select(
                "source_id", "source_name", "message"
            )
        )
    if "error" in documents.columns:
        failed = documents.where(F.col("error").isNotNull())
        found = found.unionByName(
            failed.select(
                "source_id",
                F.col("original_name").alias("source_name"),
                F.concat(F.lit("Document non traité : "), F.col("error")).alias("message"),
            )
        )
    return found
