"""Training order on disk: fixed-stride shards of token ids in a keyed random order.

Documents' ids, each followed by the end token, are one stream, cut into sequences of
``length`` ids. A keyed Feistel network over the smallest even power of two that holds
all sequences, walked until it falls inside, is a permutation of them: it gives
sequence i its slot. Slots are dealt to shards of ``per_shard`` slots, and each shard is one
file of equal strides, so slot s starts at byte ``(s mod per_shard) * stride`` of shard
``s div per_shard`` and reading goes on from any slot.

Texts are read and encoded once and never shuffled: their ids are stored as chunks, compressed,
with the input partition and the place in its stream. The sizes of the chunks say where the stream
of every partition begins; the chunks are cut into the pieces of sequences, which are shuffled
once, each to the task of its shard. The chunks are deleted when the shards are there.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metreur.llm import tokens
from metreur.llm.common import Shelf, bounded_batches, cut_lineage, shared_folder

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Free in that vocabulary of 50,256 ids.
END = 50256
LENGTH = 2048
PER_SHARD = 4096
KEY = 20240607
ROUNDS = 6
#: Ids of one stored chunk.
CHUNK = 1 << 16
_CODEC = pa.Codec("zstd", 5)
_U = np.uint64


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + _U(key & 0xFFFFFFFFFFFFFFFF)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def permuted(index: np.ndarray, size: int, key: int = KEY, rounds: int = ROUNDS, back: bool = False) -> np.ndarray:
    """The slot of each index below ``size`` (``back``: the index of each slot)."""
    half = max((max(size - 1, 1).bit_length() + 1) // 2, 1)
    mask = _U((1 << half) - 1)
    out = np.array(index, _U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> _U(half), out[todo] & mask
        for r in reversed(range(rounds)) if back else range(rounds):
            if back:
                left, right = right ^ (_mixed(left, key * 1_000_003 + r) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, key * 1_000_003 + r) & mask)
        out[todo] = (left << _U(half)) | right
        todo = todo[out[todo] >= _U(size)]  # outside: walk on
    return out.astype(np.int64)


def _packed(ids: np.ndarray) -> bytes:
    return _CODEC.compress(ids.tobytes(), asbytes=True)


def _unpacked(data: pa.BinaryScalar, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(data.as_buffer(), size * np.dtype(kind).itemsize), kind)


def _encoder(tokenizer: str, end: int, kind: str):
    """The stream of each input partition in chunks (part, start, size, ids)."""

    def run(batches):
        table, part, start = tokens.tokenizer(tokenizer), TaskContext.get().partitionId(), 0
        last = np.array([end], np.uint32)
        for batch in batches:
            parts = [np.zeros(0, np.uint32)]
            for text in batch.column(0).to_pylist():
                parts += [table.ids(text), last]
            ids = np.concatenate(parts).astype(kind)
            for at in range(0, len(ids), CHUNK):
                chunk = ids[at : at + CHUNK]
                values = [pa.array([x], pa.int64()) for x in (part, start + at, len(chunk))]
                yield pa.RecordBatch.from_arrays([*values, pa.array([_packed(chunk)], pa.binary())], names=["part", "start", "size", "ids"])
            start += len(ids)

    return run


def _cutter(starts: dict[int, int], total: int, length: int, key: int, kind: str):
    """Pieces of sequences (slot, at, size, ids); a sequence that spans chunks comes in several."""
    sequences = -(-total // length)

    def run(batches):
        for batch in batches:
            for part, start, size, ids in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3), strict=True):
                stream, begin = _unpacked(ids, size, kind), starts[part] + start
                cuts = np.concatenate(([0], np.arange(length - begin % length, size, length), [size]))
                at = begin + cuts[:-1]
                pieces = [_packed(stream[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                columns = [pa.array(permuted(at // length, sequences, key)), pa.array(at % length, pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "at", "size", "ids"])

    return run


def _shards(folder: str, total: int, length: int, per_shard: int, end: int, kind: str):
    """Writes each shard, all of whose pieces are in one task, sorted by slot, to a file of its own."""
    size = -(-total // length)

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        shard, out, name, row, slot, crc = None, None, "", None, None, 0
        done = []

        def put():
            nonlocal crc
            data = row.tobytes()
            crc = zlib.crc32(data, crc)
            out.write(data)

        def close():
            put()
            out.close()
            first = shard * per_shard
            done.append((shard, name, first, min(per_shard, size - first), crc))

        for batch in batches:
            for s, at, many, ids in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3), strict=True):
                if s // per_shard != shard:
                    if out is not None:
                        close()
                    shard, slot, crc = s // per_shard, None, 0
                    name = f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                    out = store.open_output_stream(f"{base}/{name}")
                if s != slot:
                    if slot is not None:
                        put()
                    row, slot = np.full(length, end, kind), s
                row[at : at + many] = _unpacked(ids, many, kind)
        if out is not None:
            close()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=["shard", "file", "first_slot", "slots", "crc32"])

    return run


class Order:
    """What was written: folder, sizes, and the stored list (shard, file, first_slot, slots, crc32) of the files that count."""

    def __init__(self, folder: str, shards: DataFrame, total: int, length: int, per_shard: int, key: int, kind: str):
        self.folder, self.shards, self.total = folder, shards, total
        self.length, self.per_shard, self.key, self.kind = length, per_shard, key, kind
        self.sequences = -(-total // length)


def materialise(
    docs: DataFrame, *, text: str = "text", folder: str | None = None, tokenizer: str = TOKENIZER, end: int = END, length: int = LENGTH,
    per_shard: int = PER_SHARD, key: int = KEY,
) -> Order:
    """Write the training order of the documents. A null text is an empty one: the end token alone.

    ``docs`` are read once; repeated rows count each. A text of any length is cut whole: a task
    holds the ids of one batch of texts. Ids are 16 bits wide where the end token, the largest
    id, allows it. The last sequence is filled up with end tokens. No documents give no shards.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or shared_folder(spark, "order")
    kind = "<u2" if end < 1 << 16 else "<u4"
    texts = docs.select(F.col(text).cast("string").alias("text"))
    shelf = Shelf(spark, "ids")
    chunks = shelf.store(texts.mapInArrow(_encoder(tokenizer, end, kind), "part bigint, start bigint, size bigint, ids binary"), "chunks")
    starts, total = {}, 0
    for part, ids in sorted(tuple(r) for r in chunks.groupBy("part").agg(F.sum("size")).collect()):  # a row for each input partition
        starts[part] = total
        total += ids
    shards = max(-(-(-(-total // length)) // per_shard), 1)
    pieces = chunks.mapInArrow(_cutter(starts, total, length, key, kind), "slot bigint, at int, size int, ids binary")
    # Each shard is one task, dealt by its number: drawing ranges would read and cut every chunk once more.
    dealt = pieces.repartitionById(shards, F.expr(f"cast(slot div {per_shard} as int)")) if shards > 1 else pieces.repartition(1)
    sorted_ = dealt.sortWithinPartitions("slot", "at")
    written = cut_lineage(sorted_.mapInArrow(_shards(folder, total, length, per_shard, end, kind), "shard bigint, file string, first_slot bigint, slots bigint, crc32 bigint"))
    shelf.clear()
    return Order(folder, written, total, length, per_shard, key, kind)


def _reader(order_folder: str, length: int, per_shard: int, kind: str, first: int, last: int, ids: bool):
    stride = length * np.dtype(kind).itemsize

    def run(batches):
        store, base = fs.FileSystem.from_uri(order_folder)
        for batch in batches:
            for shard, file, begin, many in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                a, b = max(first, begin), min(last, begin + many)
                if a >= b:
                    continue
                with store.open_input_file(f"{base}/{file}") as source:
                    source.seek((a - begin) * stride)
                    for at in range(a, b, 256):
                        data = source.read(min(256, b - at) * stride)
                        rows = [data[k : k + stride] for k in range(0, len(data), stride)]
                        slots = np.arange(at, at + len(rows))
                        columns = [pa.array(slots), pa.array(np.full(len(rows), shard)), pa.array((slots - begin) * stride), pa.array([zlib.crc32(r) for r in rows], pa.int64())]
                        names = ["slot", "shard", "byte", "crc32"]
                        if ids:
                            columns.append(pa.array([np.frombuffer(r, kind).astype(np.int32) for r in rows], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read(spark: SparkSession, order: Order, *, first: int = 0, last: int | None = None, ids: bool = True) -> DataFrame:
    """Slots from ``first`` to before ``last`` in the files: slot, shard, byte, crc32 of its ids and, if asked, the ids."""
    last = order.sequences if last is None else last
    files = order.shards.select("shard", "file", "first_slot", "slots").where((F.col("first_slot") < last) & (F.col("first_slot") + F.col("slots") > first))
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    run = _reader(order.folder, order.length, order.per_shard, order.kind, first, last, ids)
    return files.repartition(wide).mapInArrow(run, "slot bigint, shard bigint, byte bigint, crc32 bigint" + ", ids array<int>" * ids)


def _named(size: int, key: int):
    def run(batches):
        for batch in batches:
            index = permuted(batch.column("slot").to_numpy(), size, key, back=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index)], names=[*batch.schema.names, "sequence"])

    return run


def report(docs: DataFrame, **options) -> DataFrame:
    """Write the order, read it back: slot, sequence, shard, byte, crc32 of the ids, for every slot."""
    order = materialise(docs, **options)
    found = read(docs.sparkSession, order, ids=False)
    if not order.sequences:
        return found.withColumn("sequence", F.lit(0).cast("bigint"))
    return found.mapInArrow(_named(order.sequences, order.key), "slot bigint, shard bigint, byte bigint, crc32 bigint, sequence bigint")
