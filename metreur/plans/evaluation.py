"""A corpus of generated bills against the delivered ones, in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metreur.operators import evaluate as ops
from metreur.operators import listing, ordered
from metreur.session import cut_lineage

UNIT_ERRORS, UNMATCHED = 15, 25


@dataclass
class Evaluation:
    matches: DataFrame
    by_pair: DataFrame
    total: DataFrame
    unit_sources: DataFrame
    unit_errors: DataFrame
    unmatched_generated: DataFrame
    unmatched_reference: DataFrame


def generated_items(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items of extracted lots as generated lines. ``pairs``: pair, source_id."""
    items = lines.where(F.col("kind") == "item").join(pairs, "source_id")
    ranked = ordered.numbered(items, ["pair"], "pos", "rank")
    return ranked.select(
        "pair", (F.col("rank") - 1).alias("gen_index"), "designation", "unit", "unit_source", "review_status"
    )


def pair_errors(pairs: DataFrame, failures: DataFrame) -> DataFrame:
    """pair, error: pairs without one of their sides, and those whose files could not be read.

    ``pairs``: pair, has_source, has_bill. ``failures``: pair, error, of both readers.
    """
    # fixed value: the message of a pair that lacks a side
    missing = pairs.where(~(F.coalesce("has_source", F.lit(False)) & F.coalesce("has_bill", F.lit(False))))
    return missing.select("pair", F.lit("couple CCTP/DPGF incomplet").alias("error")).unionByName(failures.select("pair", F.coalesce("error", F.lit("")).alias("error")))


def evaluate_corpus(generated: DataFrame, reference: DataFrame, errors: DataFrame | None = None) -> Evaluation:
    """Every figure and report from one matching. ``reference`` may hold sections; items count.

    Pairs of ``errors`` (see :func:`pair_errors`) keep a row of their own and are in no other
    figure or report.
    """
    if errors is not None:
        errors = cut_lineage(errors)
        generated, reference = (df.join(errors, "pair", "left_anti") for df in (generated, reference))
    wanted = reference.where(F.col("kind") == "item") if "kind" in reference.columns else reference
    matches = cut_lineage(ops.match_one_to_one(ops.similar_line_pairs(generated, wanted), generated, wanted))
    by_pair = ops.evaluate_pairs(generated, wanted, matches, errors)
    errors = ops.checked_matches(generated, wanted, matches).where(~F.col("unit_ok"))
    left_gen, left_ref = ops.unmatched(generated, wanted, matches)
    return Evaluation(
        matches,
        by_pair,
        ops.evaluate_total(by_pair),
        ops.unit_source_counts(generated),
        listing.top_examples(errors, ["pair"], ["ref_index"], UNIT_ERRORS),
        listing.top_examples(left_gen, ["pair"], ["gen_index"], UNMATCHED),
        listing.top_examples(left_ref, ["pair"], ["ref_index"], UNMATCHED),
    )
