"""New files processed once as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metreur.plans.extract import extract_lines
from metreur.session import cut_lineage
from metreur.sources.docx import read_docx_blocks
from metreur.sources.layout import read_pdf_blocks
from metreur.sources.manifest import FILE_SCHEMA, MAX_BYTES, MAX_DOCUMENTS, accepted_files, describe_files, limit_documents

_COUNTS = "dossier_id string, taken bigint"
TABLES = ("documents", "lots", "perimeters", "lines", "warnings")


def _taken_before(spark: SparkSession, output: str, batch_id: int) -> DataFrame:
    """How many documents of each dossier earlier batches took: dossier_id, taken."""
    spark.createDataFrame([], _COUNTS).write.mode("ignore").parquet(f"{output}/counts/batch=-1")
    kept = spark.read.schema(_COUNTS + ", batch bigint").parquet(f"{output}/counts").where(F.col("batch") < batch_id)
    # Counts only grow, so the largest is the last.
    return kept.groupBy("dossier_id").agg(F.max("taken").alias("taken"))


def process_batch(
    files: DataFrame, batch_id: int, output: str, max_bytes: int | None = MAX_BYTES, max_documents: int | None = MAX_DOCUMENTS,
    spans: DataFrame | None = None,
) -> None:
    """Documents, lots, perimeters, lines and warnings of one batch, written under ``output``.

    Word files are decoded. Printed files come as ``spans`` (``sources.layout``, with
    the file's ``path``), which are looked up by path; one without spans is a failure of
    its own. A broken file becomes a warning and leaves the others alone.

    The limit of documents holds for a dossier over all batches: each batch writes how many
    it has taken of the dossiers it touched, with those before, and reads the counts of
    the batches before it. A batch replaces its own folders, so a restart repeats it
    without doubling anything. Files count in the order they came, so the tables hold
    the same rows however the files are dealt over batches.

    ``documents``: one row per file with its facts: dossier_id, source_id, original_name,
    extension, size, sha256, status (ready, failed or refused), page_count (0 for Word),
    character_count, error.
    """
    spark = files.sparkSession
    before = _taken_before(spark, output, batch_id)
    described = cut_lineage(limit_documents(describe_files(files, max_bytes), max_documents, before))
    accepted = described.where("reject_reason is null")
    now = accepted.groupBy("dossier_id").agg(F.count("*").alias("now"))
    counts = now.join(before, "dossier_id", "left").select("dossier_id", (F.col("now") + F.coalesce("taken", F.lit(0))).alias("taken"))
    cut_lineage(counts).write.mode("overwrite").parquet(f"{output}/counts/batch={batch_id}")

    words = accepted.where(F.col("extension") == ".docx")
    content = accepted_files(files, max_bytes).select("path", "content")
    blocks, failures = read_docx_blocks(words.join(content, "path"))
    blocks, failures = cut_lineage(blocks), cut_lineage(failures)
    printed = accepted.where(F.col("extension") == ".pdf").select("path", "source_id")
    pages = spark.createDataFrame([], "source_id string, page_count int")
    if spans is not None:
        own = cut_lineage(spans.join(printed, "path").drop("path"))
        laid = read_pdf_blocks(own)
        pages = own.groupBy("source_id").agg(F.max("page").cast("int").alias("page_count"))
        blocks = cut_lineage(blocks.unionByName(laid.select([c for c in laid.columns if c in blocks.columns]), allowMissingColumns=True))
    missing = printed.join(pages, "source_id", "left_anti").select("source_id", F.lit("pages attendues en lignes").alias("error"))
    size = blocks.groupBy("source_id").agg(F.sum(F.length("text")).alias("character_count"))
    documents = (
        described.join(failures.select("source_id", "error").unionByName(missing), "source_id", "left")
        .join(pages, "source_id", "left")
        .join(size, "source_id", "left")
        .withColumn("error", F.coalesce("reject_reason", "error"))
        .withColumn("status", F.when(F.col("reject_reason").isNotNull(), "refused").when(F.col("error").isNotNull(), "failed").otherwise("ready"))
        .withColumn("page_count", F.coalesce("page_count", F.lit(0)))
        .withColumn("character_count", F.coalesce("character_count", F.lit(0)))
    )
    documents = cut_lineage(documents)
    found = extract_lines(documents.where("status = 'ready'"), blocks)
    said = F.when(F.col("status") == "refused", F.col("error")).otherwise(F.concat(F.lit("Document non traité : "), "error"))
    told = documents.where("status <> 'ready'").select("source_id", F.col("original_name").alias("source_name"), said.alias("message"))
    facts = ["dossier_id", "source_id", "original_name", "extension", "size", "sha256", "status", "page_count", "character_count", "error"]
    written = (documents.select(facts), found.lots, found.perimeters, found.lines, found.warnings.unionByName(told))
    for name, table in zip(TABLES, written, strict=True):
        table.write.mode("overwrite").parquet(f"{output}/{name}/batch={batch_id}")


def ingest_new(
    spark: SparkSession, path: str, output: str, checkpoint: str, files_per_batch: int = 1000, spans: str | None = None,
    max_documents: int | None = MAX_DOCUMENTS,
) -> StreamingQuery:
    """Start reading ``path``; each file is processed once over all restarts.

    ``spans``: a stored table of the spans of printed files, read anew for every batch. Files
    are taken in the order of their modification times.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )

    def batch(rows: DataFrame, batch_id: int) -> None:
        printed = None if spans is None else rows.sparkSession.read.parquet(spans)
        process_batch(rows, batch_id, output, max_documents=max_documents, spans=printed)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
