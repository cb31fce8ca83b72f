"""Bulk-synchronous best-fit packing of token sequences.

Pieces of one length are alike, and so are sequences with one gap, so documents
and gaps are swept as runs: (length, how many) and (gap, first sequence, how
many), sorted by size. There are at most ``capacity`` lengths and gaps whatever the
corpus. A round finds for each run of lengths the smallest gap that holds it (its
successor), lets the runs that want one gap take its sequences in order of rank,
longest first, and then makes the gaps smaller; rounds go on until every piece is
placed. When no piece fits any gap, as many sequences are opened as the tokens left
need at least, so opening never wastes one.

Runs become pieces again by rank: every piece gets its dense rank among those of
its length, counted in ``SALTS`` parts so that a frequent length is not one task,
and the placement whose ranks hold it gives sequence and offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metreur.llm import tokens
from metreur.llm.common import ROW, cut_lineage, packed

CAPACITY = 2048
END = 0
TOKENIZER = "word_bpe_49k.json"
SALTS = 256
#: Placements that are sent to every task: 40 bytes each.
BROADCAST_ROWS = 200_000


def _cutter(tokenizer: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.tokenizer(tokenizer)
        for batch in batches:
            parent, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(table.ids(text), np.uint32(end)).astype("<u4")
                for k in range(0, len(ids), capacity):
                    own = ids[k : k + capacity]
                    parent.append(row)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
            columns = [batch.column(0).take(pa.array(parent, pa.int32())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(columns, names=[ROW, "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, *, keep: list[str] | None, text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: ``__row``, piece, start, length, ids_crc32. A null text is an empty one: the end token alone."""
    rows = packed(docs, keep, words=F.col(text))
    kind = rows.schema[ROW].dataType.simpleString()
    return rows.mapInArrow(_cutter(tokenizer, capacity, end), f"`{ROW}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements of pieces given as {length: how many}, and the number of sequences.

    A placement (length, first rank, ranks, first sequence, offset, each) puts
    ``each`` pieces of a length into every sequence from the first on, one behind the
    other from the offset.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of (first sequence, how many)
    placed: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    while left:
        sizes = sorted(gaps)
        wanted: dict[int, list[int]] = {}
        for n in sorted(left, reverse=True):
            k = bisect_left(sizes, n)
            if k < len(sizes):
                wanted.setdefault(sizes[k], []).append(n)
        if not wanted:
            more = -(-sum(n * c for n, c in left.items()) // capacity)
            gaps.setdefault(capacity, []).append((opened, more))
            opened += more
            continue
        fresh: dict[int, list[tuple[int, int]]] = {}
        for gap, lengths in wanted.items():
            runs = gaps.pop(gap)[::-1]
            for n in lengths:
                fit = gap // n
                while runs and left.get(n):
                    first, many = runs.pop()
                    whole = min(many, left[n] // fit)
                    each, used = (fit, whole) if whole else (left[n], 1)
                    placed.append((n, rank[n], each * used, first, capacity - gap, each))
                    rank[n] += each * used
                    left[n] -= each * used
                    if gap > each * n:
                        fresh.setdefault(gap - each * n, []).append((first, used))
                    if many > used:
                        runs.append((first + used, many - used))
                if not left[n]:
                    del left[n]
            if runs:
                fresh.setdefault(gap, []).extend(runs[::-1])
        for gap, runs in fresh.items():
            gaps.setdefault(gap, []).extend(runs)
    return placed, opened


def place(found: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of a stored table with ``length``.

    Rows with equal values in all columns are places in their own right.
    """
    spark = found.sparkSession
    salted = found.withColumn("__salt", F.pmod(F.xxhash64(ROW, "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__many"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_lineage(sizes.withColumn("__before", F.coalesce(F.sum("__many").over(before), F.lit(0))))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("__many")).collect()}  # at most capacity rows
    placed, _ = sweep(counts, capacity)
    slots = spark.createDataFrame(placed, "length bigint, __from bigint, __ranks bigint, __first bigint, __offset bigint, __each bigint")
    slots = F.broadcast(slots) if len(placed) <= BROADCAST_ROWS else slots
    within = Window.partitionBy("length", "__salt").orderBy("piece", "ids_crc32", "start")
    ranked = salted.withColumn("__n", F.row_number().over(within)).join(sizes.drop("__many"), ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__n") - 1)
    here = (ranked["length"] == slots["length"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__ranks"))
    at = F.col("__rank") - F.col("__from")
    return ranked.join(slots, here).select(
        *[ranked[c] for c in found.columns],
        (F.col("__first") + F.expr("(__rank - __from) div __each")).alias("sequence_id"),
        (F.col("__offset") + at % F.col("__each") * ranked["length"]).alias("offset"),
    )


def pack(docs: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """One row per piece of each document with its place. Repeated documents are packed each."""
    capacity = options.get("capacity", CAPACITY)
    found = cut_lineage(pieces(docs, keep=[id], **options))
    return place(found, capacity).select(F.col(f"{ROW}.`{id}`").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
