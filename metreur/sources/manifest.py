"""Source files of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metreur.functions.codes import safe_original_name

# fixed values: what a dossier accepts; the two limits are parameters, None for no limit
EXTENSIONS = [".pdf", ".docx"]
MAX_BYTES = 80 * 1024 * 1024
MAX_DOCUMENTS = 30

#: The same kinds as a pattern of file names, in either case, which the reader applies to its listing.
NAME_PATTERN = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in EXTENSIONS) + "}"

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def extension(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_extract(name, r"(?s).(\.[^.]*)$", 1))


def accepted_files(files: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Files of an accepted kind and size, told by path and length alone."""
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*EXTENSIONS)
    return files.where(kind if max_bytes is None else kind & (F.col("length") <= max_bytes))


def describe_files(files: DataFrame, max_bytes: int | None = MAX_BYTES, contents: DataFrame | None = None) -> DataFrame:
    """One row per file: names, size, hash, when it came, and why it is refused, if it is.

    ``files``: path, length, content, and modificationTime if known. The folder of a file is
    its dossier. Only accepted files are read and hashed; others have no hash. With
    ``contents``, a reader of the accepted kinds alone, ``files`` is a listing whose
    content is never asked for.
    """
    when = F.col("modificationTime") if "modificationTime" in files.columns else F.lit(None)
    came = when.cast("timestamp").alias("arrived")
    good = accepted_files(files if contents is None else contents, max_bytes).select("path", "length", came, F.sha2("content", 256).alias("sha256"))
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*EXTENSIONS)
    bad = files.where(~kind if max_bytes is None else ~kind | (F.col("length") > max_bytes)).select("path", "length", came, F.lit(None).cast("string").alias("sha256"))
    described = good.unionByName(bad).select(
        F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("dossier_id"),
        F.concat(F.lit("src_"), F.substring(F.sha1("path"), 1, 14)).alias("source_id"),
        safe_original_name("path").alias("original_name"),
        extension(safe_original_name("path")).alias("extension"),
        F.col("length").alias("size"),
        "sha256",
        "path",
        "arrived",
    )
    return described.withColumn(
        "reject_reason",
        F.when(~F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*EXTENSIONS), "format").when(F.col("sha256").isNull(), "size"),
    )


def limit_documents(manifest: DataFrame, limit: int | None = MAX_DOCUMENTS, before: DataFrame | None = None) -> DataFrame:
    """Refuse the files of a dossier past the limit (None: none), in the order they came, then of their names.

    ``before``: dossier_id, taken - how many of a dossier's places were taken earlier.
    Two passes: each stretch of names keeps its first ``limit`` before the
    dossier's are compared, so an overfull folder never sits in one task.
    """
    if limit is None:
        return manifest
    names = manifest.where("reject_reason is null").select("dossier_id", "path", "arrived")
    salted = names.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(64)))
    first = Window.partitionBy("dossier_id", "salt").orderBy("arrived", "path")
    short = salted.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit)
    final = Window.partitionBy("dossier_id").orderBy("arrived", "path")
    short = short.withColumn("n", F.row_number().over(final)).where(F.col("n") <= limit)
    taken = F.lit(0)
    if before is not None:
        short, taken = short.join(before, "dossier_id", "left"), F.coalesce("taken", F.lit(0))
    kept = short.where(F.col("n") + taken <= limit).select("path", F.lit(True).alias("kept"))
    return (
        manifest.join(kept, "path", "left")
        .withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("kept").isNull(), "count")))
        .drop("kept")
    )


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (files if pattern is None else files.option("pathGlobFilter", pattern)).load(path)


def read_manifest(
    spark: SparkSession, path: str, max_bytes: int | None = MAX_BYTES, max_documents: int | None = MAX_DOCUMENTS
) -> tuple[DataFrame, DataFrame]:
    """(accepted files, refused files with the reason).

    What is refused comes from the listing, whose content no step asks for. What is read is
    told by its name in the reader and by its length before it is opened.
    """
    described = describe_files(read_files(spark, path), max_bytes, read_files(spark, path, NAME_PATTERN))
    manifest = limit_documents(described, max_documents)
    accepted = manifest.where("reject_reason is null").drop("reject_reason")
    return accepted, manifest.where("reject_reason is not null")
