import random

import pytest
from pyspark.sql import functions as F

from metreur.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for doc in range(6):
        places = sorted(rng.sample(range(1, 400), 5 + 25 * doc))
        data += [(f"d{doc}", pos, rng.randint(1, 5), rng.choice([None, rng.randint(0, 99)])) for pos in places]
    schema = "doc string, pos int, level int, value int"
    return data, spark.createDataFrame(data, schema).repartition(5)


def documents(data):
    for doc in sorted({row[0] for row in data}):
        yield doc, [row for row in data if row[0] == doc]


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_running(rows, sparse, strict):
    data, df = rows
    out = ordered.running(
        df, ["doc"], "pos", sums={"total": F.col("level")}, lasts={"seen": F.col("value")}, strict=strict, chunk=7, sparse=sparse
    )
    got = {(r["doc"], r["pos"]): (r["total"], r["seen"]) for r in out.collect()}
    expected = {}
    for doc, part in documents(data):
        total, seen = 0, None
        for _, pos, level, value in part:
            before = (total, seen)
            total += level
            seen = value if value is not None else seen
            expected[doc, pos] = before if strict else (total, seen)
    assert got == expected


@pytest.mark.parametrize("sparse", [False, True])
def test_following(rows, sparse):
    data, df = rows
    got = {
        (r["doc"], r["pos"]): r["n"] and (r["n"]["pos"], r["n"]["value"])
        for r in ordered.following(df, ["doc"], "pos", ["pos", "value"], "n", chunk=7, sparse=sparse).collect()
    }
    expected = {}
    for doc, part in documents(data):
        for row, after in zip(part, part[1:] + [None]):
            expected[doc, row[1]] = after and (after[1], after[3])
    assert got == expected


def test_counters(rows):
    data, df = rows
    got = {(r["doc"], r["pos"]): r["c"] for r in ordered.counters(df, ["doc"], "pos", "level", "c", depth=5, chunk=7).collect()}
    for doc, part in documents(data):
        state = [0] * 5
        for _, pos, level, _ in part:
            state = state[: level - 1] + [state[level - 1] + 1] + [0] * (5 - level)
            assert got[doc, pos] == state


def test_shuffle_partitions_do_not_show(spark, rows):
    _, df = rows
    run = lambda: sorted(map(tuple, ordered.numbered(df, ["doc"], "pos", "n", chunk=9).collect()))
    first, before = run(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stretches_are_cut_once(rows):
    """Sums and next rows over stretches that a column holds; documents of one stretch hand nothing on."""
    data, df = rows
    cut = ordered.stretched(df, ["doc"], "pos", "stretch", chunk=50)
    held = {r.doc: r.stretches for r in cut.groupBy("doc").agg(F.sort_array(F.collect_set("stretch")).alias("stretches")).collect()}
    for doc, own in documents(data):
        assert held[doc] == [-1] if len(own) <= 50 else min(held[doc]) == 0 < max(held[doc])
    summed = ordered.running(cut, ["doc"], "pos", sums={"total": F.col("level")}, strict=True, stretch="stretch")
    # some of the rows, by a further key
    some = ordered.following(summed.where("level >= 3"), ["doc", "level"], "pos", ["pos", "total"], "next", stretch="stretch")
    got = {(r.doc, r.pos): (r.total, r.next and tuple(r.next)) for r in some.collect()}
    for doc, own in documents(data):
        before = {r[1]: sum(q[2] for q in own if q[1] < r[1]) for r in own}
        for _, pos, level, _ in own:
            if level >= 3:
                later = [q[1] for q in own if q[1] > pos and q[2] == level]
                assert got[doc, pos] == (before[pos], (min(later), before[min(later)]) if later else None)
