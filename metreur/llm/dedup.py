"""Exact duplicates by a tree of sorted digest runs, in built-in expressions only.

Every row becomes (digest, check, place): SHA-256 of the normalised text, a second
fingerprint of it (another hash and the length), and the row's place, which names its
input partition. The rows of a partition, sorted by digest, are a run; a run holds
each text once, with its smallest identifier and its number of rows.

Runs meet in binomial rounds: in each round the runs of ``FAN`` neighbours are merged
into one, which again holds each text once with the smallest identifier. Entries are
one text only where digest and check agree, at every level. A run is dealt over tasks
by digest, so the last run, of all texts, is no single task. A text that a third of
all rows hold is one row a partition after the first step and at most ``FAN`` rows a
merge after that.

What the last run decided goes back the same way: each level tells the runs it was
merged from, and the partitions tell their rows, so that no join meets more rows of
one text than a merge or an input partition had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metreur.llm.common import ROW, cut_lineage, packed

#: Runs that are merged into one.
FAN = 8
_KEY = ["digest", "check"]


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]++", " ")


def _facts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, digest, check, at, run) of every row, stored."""
    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("text"))
    said = rows.select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("length")).alias("check"),
        F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("run"),
    )
    return cut_lineage(said)


def _merged(runs: DataFrame) -> DataFrame:
    """Each text of each run once, with its smallest identifier (rows without one last) and its number of rows.

    The least of structs is aggregated over sorted rows: each partition is a sorted run before
    the exchange, and what a task receives is merged in order after it.
    """
    return runs.groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def assigned(docs: DataFrame, *, id: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical with every run of blanks as one space; a null text is
    empty. The row with the smallest id stays; of rows that repeat that id one stays.
    Rows without an id stay only where their text has no row with one; then one does,
    and keep_id is null. Other columns are not looked at.
    """
    facts = _facts(docs, id, text)
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "at")
    level = cut_lineage(_merged(facts.select("run", *_KEY, best.alias("best"), F.lit(1).cast("bigint").alias("n"))))
    runs = int(facts.agg(F.max("run")).first()[0] or 0) + 1
    levels = [level]
    while runs > 1:
        runs = -(-runs // fan)
        level = cut_lineage(_merged(level.withColumn("run", F.expr(f"run div {fan}").cast("int"))))
        levels.append(level)
    told = levels.pop()
    while levels:
        lower = levels.pop().select("run", *_KEY).withColumn("up", F.expr(f"run div {fan}").cast("int"))
        told = lower.join(told.withColumnRenamed("run", "up"), ["up", *_KEY]).select("run", *_KEY, "best", "n")
    done = facts.join(told, ["run", *_KEY])
    return done.select(
        "doc_id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("best.at")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, *, id: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """The rows that stay, with all columns of ``docs``. Of rows that repeat an id and a text any one stays."""
    rows = packed(docs, None, id=F.col(f"`{id}`").cast("bigint"), digest=F.sha2(normalised(F.col(f"`{text}`")), 256)).dropDuplicates(["id", "digest"])
    stay = assigned(docs, id=id, text=text, fan=fan).where("kept").select(F.col("keep_id").alias("stay"), "text_sha256")
    good = rows.join(stay, F.col("id").eqNullSafe(F.col("stay")) & (F.col("digest") == F.col("text_sha256")), "left_semi")
    return good.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns])
