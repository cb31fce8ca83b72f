import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metreur.llm import order, tokens
from metreur.session import cut_lineage

from .fixtures import documents, empty, prose


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 65537])
def test_permutation(size):
    slots = order.permuted(np.arange(size), size, 5)
    assert sorted(slots.tolist()) == list(range(size))
    assert (order.permuted(slots, size, 5, back=True) == np.arange(size)).all()
    if size > 100:
        assert (slots != order.permuted(np.arange(size), size, 6)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(size), slots)[0, 1]) < 0.2


def test_ids_are_the_tokenizers():
    table = tokens.ByteIds(tokens.tokenizer_file(order.TOKENIZER), kept=60)
    odd = ["a  b", " a", "a ", "a \n b", "a\n b", "a b\n", "a\u00a0 b", "a \u3000b", "  ", "\n", "don't 's 't x", "é🙂 ñ ", "1 22 333 4444", "... ,, !?", "a b", "\t a", "x" * 4000]
    for text in [*odd, *odd, prose(3, 500), prose(4, 500), "\n".join([prose(5, 40)] * 3)]:
        assert table.ids(text).tolist() == table.encoding.encode_ordinary(text), ascii(text)[:50]
        assert table.count(text) == len(table.ids(text))
    assert table.ids(None).tolist() == []


@pytest.mark.parametrize(("length", "per_shard"), [(16, 8), (2048, 4096), (7, 1)])
def test_files_hold_the_stream_in_order(spark, length, per_shard):
    rows = [(k, prose(k, k * 13 % 90)) for k in range(120)] + [(1, None), (2, ""), (2, ""), (None, "é🙂")]
    docs = cut_lineage(documents(spark, rows).repartition(5))
    done = order.materialise(docs, length=length, per_shard=per_shard)
    table = tokens.tokenizer(order.TOKENIZER)
    texts = [r.text for r in docs.collect()]
    stream = np.concatenate([np.append(table.ids(t), np.uint32(order.END)) for t in texts])
    many = -(-len(stream) // length)
    full = np.concatenate([stream, np.full(many * length - len(stream), order.END, np.uint32)]).astype("<u2").reshape(many, length)
    got = order.read(spark, done).collect()
    assert done.sequences == many and sorted(r.slot for r in got) == list(range(many))
    where = order.permuted(np.arange(many), many)
    by_slot = {r.slot: r for r in got}
    for k in range(many):
        r = by_slot[where[k]]
        assert r.ids == full[k].tolist() and r.crc32 == zlib.crc32(full[k].tobytes())
        assert (r.shard, r.byte) == (r.slot // per_shard, r.slot % per_shard * length * 2)
    some = order.read(spark, done, first=many // 3, last=many // 2, ids=False)
    assert sorted(r.slot for r in some.collect()) == list(range(many // 3, many // 2))
    files = done.shards.collect()
    assert sum(f.slots for f in files) == many
    for f in files:
        path = f"{done.folder.removeprefix('file:')}/{f.file}"
        data = open(path, "rb").read()
        assert len(data) == f.slots * length * 2 and zlib.crc32(data) == f.crc32


def test_report_and_empty(spark):
    docs = cut_lineage(documents(spark, [(k, prose(k, 30)) for k in range(40)]).repartition(3))
    rows = order.report(docs, length=32).collect()
    assert sorted(r.sequence for r in rows) == list(range(len(rows)))
    assert order.report(empty(spark)).count() == 0


def test_texts_are_read_once(spark):
    rows = [(k, prose(k, 30)) for k in range(40)] + [(40, prose(7, 60_000))]  # the last one fills several chunks
    plain = cut_lineage(documents(spark, rows).repartition(3))
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    done = order.materialise(plain.withColumn("text", F.udf(told, "string")("text")))
    assert seen.value == len(rows)
    table = tokens.tokenizer(order.TOKENIZER)
    stream = np.concatenate([np.append(table.ids(r.text), np.uint32(order.END)) for r in plain.collect()])
    assert done.total == len(stream) > order.CHUNK
    got = {r.slot: r.ids for r in order.read(spark, done).collect()}
    where = order.permuted(np.arange(done.sequences), done.sequences)
    assert np.concatenate([got[s] for s in where])[: len(stream)].tolist() == stream.tolist()
