"""Documents in, bills out: the operators in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metreur.functions.text import normalize_text
from metreur.functions.units import classify_family
from metreur.operators import enrich, headings, lines, perimeter
from metreur.session import counted_list, store_step


@dataclass
class Extraction:
    """``headings`` are those written in the documents. Lines and warnings are worked out, once, when they are asked for."""

    lots: DataFrame
    perimeters: DataFrame
    headings: DataFrame
    read: Callable[[], DataFrame]
    warn: Callable[[DataFrame], DataFrame]

    @cached_property
    def lines(self) -> DataFrame:
        return self.read()

    @cached_property
    def warnings(self) -> DataFrame:
        return self.warn(self.lines)


def _demolition(candidates: DataFrame, lots: DataFrame, blocks: DataFrame) -> DataFrame:
    """Candidates with the items demolition lots write as plain paragraphs."""
    members = counted_list(store_step(lots.where(F.col("family") == perimeter.DEMOLITION).select("source_id")))
    theirs = candidates.join(members, "source_id", "left_semi")
    their_blocks = blocks.join(members, "source_id", "left_semi")
    others = candidates.join(members, "source_id", "left_anti")
    return others.unionByName(headings.recover_demolition_items(theirs, their_blocks, store_step))


def extract_lines(documents: DataFrame, blocks: DataFrame, forced: DataFrame | None = None) -> Extraction:
    """Bills of a corpus.

    ``documents``: source_id, original_name, extension, page_count.
    ``forced``: source_id, anchor_code of perimeters someone confirmed.
    ``blocks`` are read by several steps: give a stored table.

    Headings and read lines are written to the checkpoint folder: each is used
    by several later steps, and a lost executor costs one step.
    """
    identities = headings.lot_identity(documents, blocks)
    named = identities.withColumn("title_key", normalize_text("lot_title")).withColumn(
        "family", classify_family("title_key", normalized=True)["family"]
    )
    if forced is None:
        named = named.withColumn("forced_code", F.lit(None).cast("string"))
    else:
        named = named.join(forced.select("source_id", F.col("anchor_code").alias("forced_code")), "source_id", "left")
    lots = store_step(named)

    marked = store_step(headings.marked_blocks(blocks))
    contents = store_step(headings.toc_pages(marked))
    written = store_step(headings.candidate_headings(marked, contents, store_step))
    candidates = store_step(_demolition(written, lots, blocks))
    perimeters, selected = perimeter.select_perimeter(candidates, lots, store_step)
    selected = store_step(selected)
    trade = counted_list(store_step(perimeters.where(F.col("method") == "trade_work_anchor").select("source_id")))
    rebuilt = headings.renumber_under(
        headings.drop_sans_objet(
            selected.join(trade, "source_id", "left_semi"), blocks.join(trade, "source_id", "left_semi")
        )
    )
    inside_work = store_step(selected.join(trade, "source_id", "left_anti").unionByName(rebuilt))
    kept = store_step(headings.dedupe_headings(inside_work, store_step))

    # the first rebuilt code is the anchor of a demolition perimeter
    anchors = kept.join(trade, "source_id", "left_semi").groupBy("source_id").agg(F.min_by("code", "pos").alias("rebuilt_code"))
    found = candidates.groupBy("source_id").agg(F.count("*").cast("int").alias("candidates"))
    inside = kept.groupBy("source_id").agg(F.count("*").cast("int").alias("inside"))
    listed = contents.groupBy("source_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    perimeters = (
        perimeters.join(anchors, "source_id", "left")
        .join(found, "source_id", "left")
        .join(inside, "source_id", "left")
        .join(listed, "source_id", "left")
        .select(
            "source_id",
            "family",
            "method",
            F.coalesce("rebuilt_code", "anchor_code").alias("anchor_code"),
            "anchor_title",
            "start_page",
            "confidence",
            F.coalesce("pages", F.array().cast("array<int>")).alias("ignored_toc_pages"),
            F.coalesce("candidates", F.lit(0)).alias("candidate_count_before_perimeter"),
            F.coalesce("inside", F.lit(0)).alias("selected_heading_count"),
        )
    )
    perimeters = store_step(perimeters)

    def read() -> DataFrame:
        return store_step(enrich.enrich(store_step(lines.build_lines(kept, blocks, perimeters)), lots, store_step))

    return Extraction(lots, perimeters, written, read, lambda found: store_step(lines.document_warnings(documents, lots, perimeters, found, blocks)))


def retry_perimeter(
    documents: DataFrame, blocks: DataFrame, first: Extraction, suggestions: DataFrame
) -> Extraction:
    """Extract again, from a suggested anchor, the documents whose perimeter was a guess.

    A suggestion counts when its code is a heading of the document; the new
    bill is kept when it holds an item.
    """
    weak = first.perimeters.where(F.col("method").isin("dominant_numbered_chapter", "not_found")).select("source_id")
    asked = suggestions.where(F.coalesce("anchor_code", F.lit("")) != "").join(weak, "source_id", "left_semi")
    real = first.headings.select("source_id", F.col("code").alias("anchor_code")).distinct()
    valid = store_step(asked.join(real, ["source_id", "anchor_code"], "left_semi").select("source_id", "anchor_code"))
    ids = valid.select("source_id")
    second = extract_lines(
        documents.join(ids, "source_id", "left_semi"), store_step(blocks.join(ids, "source_id", "left_semi")), valid
    )
    better = store_step(second.lines.where(F.col("kind") == "item").select("source_id").distinct())

    def take(old, new):
        return old.join(better, "source_id", "left_anti").unionByName(new.join(better, "source_id", "left_semi"))

    return Extraction(
        take(first.lots, second.lots),
        take(first.perimeters, second.perimeters),
        take(first.headings, second.headings),
        lambda: take(first.lines, second.lines),
        lambda _: take(first.warnings, second.warnings),
    )
