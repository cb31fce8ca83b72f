"""What the corpus operators share: reading, lineage, shared folders, Arrow helpers."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metreur.session import checkpoint_folder, cut_lineage, ship_package

__all__ = ["ROW", "Shelf", "WORD_BYTES", "ascii_words", "bounded_batches", "checkpoint_folder", "cut_lineage", "listed", "packed", "read", "sha256_hex", "shared_folder"]

#: The struct that carries a row's own columns past an operator, so that names never clash.
ROW = "__row"
#: Rows of one Arrow batch; the session's own setting counts texts by the ten thousand.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most so many rows from now on, as rows carry whole texts; the workers know this package."""
    ship_package(spark)
    if int(spark.conf.get(_BATCH)) > rows:
        spark.conf.set(_BATCH, str(rows))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, keep: Iterable[str] | None, **inputs: Column) -> DataFrame:
    """One struct of the columns to keep (all: None) beside the operator's inputs under its own names."""
    bounded_batches(df.sparkSession)
    names = df.columns if keep is None else list(keep)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(ROW), *[c.alias(k) for k, c in inputs.items()])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors reach."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes that a task holds back while it writes a step.
SHELF_BLOCK = 16 << 20


class Shelf:
    """Steps of one operator stored as Parquet below the checkpoint folder, taken away when they are done with."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, shared_folder(spark, name)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("parquet.block.size", str(SHELF_BLOCK)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, name: str | None = None) -> None:
        """Delete one step, or all."""
        jvm, context = self.spark._jvm, self.spark._jsc.sc()
        path = jvm.org.apache.hadoop.fs.Path(self.folder if name is None else f"{self.folder}/{name}")
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def _word_table() -> bytes:
    table = bytearray(range(256))
    for b in range(128):
        if 65 <= b <= 90:
            table[b] = b + 32
        elif not (48 <= b <= 57 or 97 <= b <= 122):
            table[b] = 32
    return bytes(table)


#: Bytes of UTF-8 with A-Z lowered and every other ASCII character but letters and digits made a space.
WORD_BYTES = _word_table()


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def listed(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
