"""Documents that changed, extracted again over what reviewers had made of them.

One plan from a new state of the documents and the stored lines to the next stored
lines: changes told by content, only changed documents extracted, suggestions taken
over, edits and manual lines laid back, a copy of the old lines kept, facts and figures
of every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metreur.operators import enrich, overlay, stats
from metreur.operators.lines import LINE
from metreur.plans.extract import extract_lines
from metreur.session import counted_list, passing_steps, store_step
from metreur.sources import contract

#: Parts of the stored lines; a part with a changed document is replaced as a whole.
BUCKETS = 256
_DOCUMENT = ("original_name", "extension", "page_count")
_BLOCK = ("pos", "text", "page", "style", "font_size", "bold", "source_kind")


@dataclass
class Reprocessed:
    """``facts``: source_id, content_hash, page_count, character_count, changed, items, to_review, status."""

    facts: DataFrame
    lines: DataFrame
    statistics: DataFrame


def content_facts(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """source_id, content_hash, page_count, character_count of every document.

    The hash is of sums over the blocks, each with its position, so that it hangs neither
    on the order of rows nor on a row or task that holds a whole document.
    """
    one = [F.col(c) for c in _BLOCK if c in blocks.columns]
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)")).cast("string")
    held = blocks.groupBy("source_id").agg(
        F.count("*").alias("n"), wide(*one).alias("a"), wide(F.lit("second"), *one).alias("b"), F.sum(F.length("text")).alias("character_count")
    )
    named = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _DOCUMENT])
    joined = documents.join(held, "source_id", "left")
    return joined.select(
        "source_id", F.sha2(F.concat_ws("|", named, F.coalesce("n", F.lit(0)).cast("string"), "a", "b"), 256).alias("content_hash"), "page_count",
        F.coalesce("character_count", F.lit(0)).cast("bigint").alias("character_count"),
    )


def reprocess(
    documents: DataFrame, blocks: DataFrame, stored: DataFrame, previous: DataFrame, *, suggestions: DataFrame | None = None,
    refinements: DataFrame | None = None, stamp: str | None = None, revisions: str | None = None,
) -> Reprocessed:
    """The next state of all documents.

    ``stored``: source_id, content_hash as of the last run. ``previous``: its lines, of any
    document, edits included. Documents whose content or name differs, or that are new, are
    extracted; others keep their lines as they are. Lines of documents that are gone go
    too. ``suggestions`` and ``refinements`` concern extracted lines. With ``revisions``, a
    folder, the lines before are kept there under ``stamp``.
    """
    known = stored.groupBy("source_id").agg(F.max("content_hash").alias("__before"))
    facts = content_facts(documents, blocks).join(known, "source_id", "left")
    facts = store_step(facts.withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("__before"))).drop("__before"))
    if revisions is not None:
        contract.snapshot_revision(previous, stamp or "", revisions)
    lines = previous.join(facts.where("not changed").select("source_id"), "source_id", "left_semi").select(LINE)
    with passing_steps() as keep:
        changed = store_step(facts.where("changed").select("source_id"))
        if not changed.isEmpty():
            listed = counted_list(changed)
            own = lambda df: df.join(listed, "source_id", "left_semi")
            found = extract_lines(own(documents), store_step(own(blocks)))
            fresh = found.lines
            if suggestions is not None:
                fresh = enrich.fill_missing_units(fresh, suggestions, found.lots)
            if refinements is not None:
                fresh = enrich.merge_refinements(fresh, refinements, found.lots)
            lines = lines.unionByName(overlay.overlay_edits(store_step(fresh), store_step(own(previous))).select(LINE))
        lines = keep(lines)
    counted = lines.groupBy("source_id").agg(
        F.count_if(F.col("kind") == "item").alias("items"),
        F.count_if((F.col("kind") == "item") & (F.coalesce("review_status", F.lit("")) != "validated")).alias("to_review"),
    )
    none = F.lit(0)
    facts = facts.join(counted, "source_id", "left").withColumn("items", F.coalesce("items", none)).withColumn("to_review", F.coalesce("to_review", none))
    status = F.when(F.col("items") == 0, "failed").when(F.col("to_review") > 0, "needs_review").otherwise("ready")
    return Reprocessed(store_step(facts.withColumn("status", status)), lines, stats.quality_stats(lines, ["source_id"]))


def merge_stored(result: Reprocessed, path: str, buckets: int = BUCKETS) -> None:
    """Put the state into stored tables by document: only the parts with a changed document are written."""
    bucket = F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int")
    touched = result.facts.where("changed").select(bucket.alias("bucket")).distinct()  # at most ``buckets`` rows
    for name, table in (("facts", result.facts.drop("changed")), ("lines", result.lines)):
        own = table.withColumn("bucket", bucket).join(F.broadcast(touched), "bucket", "left_semi")
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")
