"""Session settings, lineage cutting and shipping of the package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_shipped: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("metreur")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in ``spark.checkpoint.dir``.

    A session on one machine may leave the setting out; it then gets a temporary
    folder that is removed when the process ends. A cluster must set it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master.partition("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="metreur-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its plan."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of one row group of a stored step, which a task holds back while it writes.
STORED_BLOCK = 32 << 20
#: Rows of a list of keys that go through the driver to every executor at most.
FEW = 50_000


@contextmanager
def storing(spark: SparkSession) -> Iterator[None]:
    """Settings while a step is worked out, put back after that.

    Rows that repeat themselves, or that a sequence is made of, take up to hundreds of times what their
    files do. So no side of a join is broadcast for the size of its files, only for what it measures once
    it is there. Shuffles go with the step that made them: what it stored is read instead.
    """
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    measured = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        measured: spark.conf.get(measured, None) or str(limit),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def store_step(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, but as Parquet: later steps read only the columns they use, and know the size.

    For inputs that many steps read. A checkpoint is read row by row with all its columns, and
    what Spark knows of its values is not always renamed with it: a union of two of its readers
    may then fail. The files go when the session's file system is closed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/step-{uuid.uuid4().hex}"
    with storing(spark):
        df.write.option("parquet.block.size", str(STORED_BLOCK)).option("compression", "zstd").parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    if _passing:
        _passing[-1].append((spark, there))
    return spark.read.schema(df.schema).parquet(path)


#: Steps stored since each open :func:`passing_steps` began.
_passing: list[list] = []


@contextmanager
def passing_steps() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Steps stored within are removed at its end, but for what is stored by the function it gives."""
    kept: list = []

    def keep(df: DataFrame) -> DataFrame:
        stored = store_step(df)
        kept.append(_passing[-1].pop())
        return stored

    _passing.append([])
    try:
        yield keep
    finally:
        for spark, path in _passing.pop():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if _passing:
            _passing[-1] += kept


def counted_list(keys: DataFrame) -> DataFrame:
    """A stored list of keys, broadcast if it is counted to be short: what meets it is not shuffled then."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may run anywhere. Once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="metreur-package-"), "metreur.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("metreur", os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
