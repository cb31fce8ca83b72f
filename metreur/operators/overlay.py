"""Edits of reviewers over extracted lines, and who sees what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metreur import catalogue
from metreur.functions.codes import natural_code_key
from metreur.functions.text import trim_blanks
from metreur.operators import ordered
from metreur.session import cut_lineage

EDITABLE = [
    "kind", "level", "code", "designation", "description", "unit", "quantity", "unit_price", "included",
    "review_status", "review_reason",
]


def is_manual(origin: str = "origin"):
    return F.coalesce(F.col(origin), F.lit("")).startswith("manual")


def sanitize_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean lines, refused lines) of an edited bill.

    Text columns may hold anything; a quantity that is no number refuses the line.
    """
    designation = trim_blanks(F.coalesce("designation", F.lit("")))
    named = lines.where(designation != "")
    section = F.col("kind").eqNullSafe("section")
    raw = trim_blanks(F.col("quantity").cast("string"))
    number = F.nullif(raw, F.lit("")).try_cast("double")
    bad = F.coalesce(raw, F.lit("")).isin("") == F.lit(False)
    refused = bad & number.isNull()
    unit = F.when(F.col("unit").isin(*catalogue.LINE_UNITS), F.col("unit")).otherwise("Ens")
    numbered = ordered.numbered(named.where(~refused), ["source_id"], "pos", "__rank", sparse=True)
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    changed = {
        "kind": F.when(section, "section").otherwise("item"),
        "level": F.greatest(F.lit(1), F.least(F.lit(8), F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(1)))),
        "code": cut("code", 60),
        "designation": F.substring(designation, 1, 240),
        "description": cut("description", 2000),
        "unit": F.when(~section, unit),
        "quantity": F.when(~section, number),
        "included": F.coalesce("included", F.lit(True)),
        "review_status": F.when(F.col("review_status") == "validated", "validated").otherwise("to_review"),
        "origin": F.coalesce(F.nullif(F.col("origin"), F.lit("")), F.lit("manual")),
    }
    clean = numbered.select(
        *[changed.get(c, F.col(c)).alias(c) for c in lines.columns], (F.col("__rank") - 1).cast("int").alias("sort_order")
    )
    return clean, named.where(refused)


def _once(previous: DataFrame) -> DataFrame:
    """One row per line: the last by ``seq``, or, without it, by the stored fields."""
    columns = [c for c in previous.columns if c != "line_id"]
    order = F.col("seq") if "seq" in columns else F.struct(F.coalesce("user_edited", F.lit(False)), *EDITABLE)
    last = previous.groupBy("line_id").agg(F.max_by(F.struct(*columns), order).alias("__last"))
    return last.select(*[F.col(c) if c == "line_id" else F.col(f"__last.{c}") for c in previous.columns])


def detect_edits(lines: DataFrame, previous: DataFrame) -> DataFrame:
    """Mark the lines whose editable fields differ from what was stored; of a line stored twice the last counts."""
    before = _once(previous).select("line_id", F.col("user_edited").alias("__was"), F.struct(*EDITABLE).alias("__before"))
    joined = lines.join(before, "line_id", "left")
    same = F.lit(True)
    for name in EDITABLE:
        same = same & F.col(name).eqNullSafe(F.col(f"__before.{name}"))
    edited = F.coalesce("__was", F.lit(False)) | ~same
    known = F.col("__before").isNotNull() & ~is_manual()
    return joined.withColumn("user_edited", F.when(known, edited).otherwise(F.col("user_edited"))).select(lines.columns)


def overlay_edits(lines: DataFrame, previous: DataFrame) -> DataFrame:
    """Extracted lines with stored edits laid over them and manual lines put back in code order.

    All editable fields come back. ``previous`` may carry ``deleted``: lines so
    marked stay away. Of a line stored twice the last counts.
    """
    previous = _once(previous)
    if "deleted" in previous.columns:
        gone = previous.where(F.col("deleted")).select("line_id")
        lines = lines.join(gone, "line_id", "left_anti")
        previous = previous.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")
    edits = previous.where(F.col("user_edited")).select("line_id", F.struct(*EDITABLE).alias("__edit"))
    hit = F.col("__edit").isNotNull()
    laid = lines.join(edits, "line_id", "left").select(
        *[
            F.when(hit, F.col(f"__edit.{c}")).otherwise(F.col(c)).alias(c)
            if c in EDITABLE
            else F.when(hit, F.lit(True)).otherwise(F.col(c)).alias(c)
            if c == "user_edited"
            else F.when(hit, F.lit("deterministic-v2+manual-edit")).otherwise(F.col(c)).alias(c)
            if c == "origin"
            else F.col(c)
            for c in lines.columns
        ]
    )
    manual = previous.where(is_manual()).join(lines.select("line_id"), "line_id", "left_anti").select(lines.columns)
    return insert_by_code(laid, manual)


def _first_greater(lines: DataFrame, new: DataFrame) -> DataFrame:
    """Position of the first line of a greater code than each new line's: source_id, line_id, before.

    Codes of a source are sorted from the greatest down, by ranges over the whole
    table; a new line's place is the least position seen so far in its range or in the
    ranges before. Neither a source nor a chapter is one task, and no new line is
    compared with every line. A null source is a source.
    """
    coded = lambda df: df.where(trim_blanks(F.coalesce("code", F.lit(""))) != "").withColumn(
        "key", natural_code_key("code")
    )
    known = coded(lines).groupBy("source_id", "key").agg(F.min(F.col("pos").cast("bigint")).alias("at"))
    asked = coded(new).select("source_id", "key", "line_id", F.lit(None).cast("bigint").alias("at"))
    both = known.withColumn("line_id", F.lit(None).cast("string")).unionByName(asked)
    # at equal codes the new line comes first, so that only greater codes count
    down = both.orderBy("source_id", F.desc("key"), F.col("at").isNotNull(), "line_id")
    down = cut_lineage(down.select("source_id", "line_id", "at", F.monotonically_increasing_id().alias("seen"), F.spark_partition_id().alias("range")))
    earlier = Window.partitionBy("source_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = down.groupBy("source_id", "range").agg(F.min("at").alias("least"))
    before = before.select(F.col("source_id").alias("source"), F.col("range").alias("of"), F.min("least").over(earlier).alias("beyond"))
    inside = Window.partitionBy("source_id", "range").orderBy("seen").rowsBetween(Window.unboundedPreceding, 0)
    return (
        down.withColumn("inside", F.min("at").over(inside))
        .where("line_id is not null")
        .join(before, F.col("source_id").eqNullSafe(F.col("source")) & (F.col("range") == F.col("of")))
        .select("source_id", "line_id", F.least("inside", "beyond").alias("before"))
    )


def insert_by_code(lines: DataFrame, new: DataFrame) -> DataFrame:
    """Lines with ``new`` ones before the first line of a greater code, else at the end; ``pos`` from 1.

    New lines that meet in one place stand in the order of their codes, however many
    they are. All lines are sorted by ranges; a line's number is its place in its range
    and the lines of the same source in the ranges before, so no place is one task.
    """
    ends = lines.groupBy(F.col("source_id").alias("__source")).agg((F.max("pos") + 1).alias("end"))
    places = _first_greater(lines, new).select(F.col("source_id").alias("__of"), F.col("line_id").alias("__line"), "before")
    put = (
        new.join(places, F.col("source_id").eqNullSafe(F.col("__of")) & F.col("line_id").eqNullSafe(F.col("__line")), "left")
        .join(ends, F.col("source_id").eqNullSafe(F.col("__source")), "left")
        .withColumn("__slot", F.coalesce("before", "end", F.lit(1)).cast("bigint"))
    )
    both = (
        lines.withColumn("__slot", F.col("pos").cast("bigint")).withColumn("__known", F.lit(True))
        .unionByName(put.select(*lines.columns, "__slot", F.lit(False).alias("__known")))
    )
    fresh = lambda c: F.when(~F.col("__known"), c)
    uncoded = trim_blanks(F.coalesce("code", F.lit(""))) == ""
    order = ["__slot", "__known", fresh(uncoded), fresh(natural_code_key("code")), "pos", "line_id"]
    numbered = ordered.ranked(both, ["source_id"], order, "__number")
    return numbered.select(*[F.col("__number").alias(c) if c == "pos" else F.col(c) for c in lines.columns])


def visible_dossiers(dossiers: DataFrame, shares: DataFrame, owner: str, email: str, search: str = "") -> DataFrame:
    """Dossiers a viewer owns or was given, with the permission, newest first."""
    given = shares.where(F.col("email") == email.strip().lower()).select(
        "dossier_id", F.col("permission").alias("shared_permission")
    )
    seen = dossiers.join(given, "dossier_id", "left").where(
        (F.col("owner_sub") == owner) | F.col("shared_permission").isNotNull()
    )
    if search.strip():
        seen = search_dossiers(seen, search)
    return newest_first(seen)


def search_dossiers(dossiers: DataFrame, term: str) -> DataFrame:
    """Dossiers whose project, reference or client holds the term; ``%`` and ``_`` are wildcards."""
    pattern = f"%{term.strip()}%"
    hit = F.lit(False)
    for name in ("project_name", "project_reference", "client_name"):
        hit = hit | F.col(name).ilike(pattern)
    return dossiers.where(hit)


def newest_first(dossiers: DataFrame) -> DataFrame:
    return dossiers.orderBy(F.desc("updated_at"))


def filter_lines(lines: DataFrame, status: str = "all", search: str = "") -> DataFrame:
    """Lines of a review status whose code, designation or description holds a text, whatever the case."""
    if status != "all":
        lines = lines.where(F.col("review_status") == status)
    term = search.strip().lower()
    if term:
        text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("code", "designation", "description")])
        lines = lines.where(F.contains(F.lower(text), F.lit(term)))
    return lines
