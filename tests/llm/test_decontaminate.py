import hashlib
import random
import re

import numpy as np
import pytest

from metreur.llm import decontaminate as d

from .fixtures import documents, empty, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window):
    found = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                found.setdefault(tuple(w[k : k + n]), set()).add(item)
    sizes = {len(k) for k in found}
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := found.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    own |= got
        digest = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(own), digest, bool(hit)))
    return sorted(out, key=str)


def tables():
    items = [(1, prose(1, 30)), (2, prose(2, 12)), (2, prose(2, 12)), (10, "Tiny Item"), (11, ""), (12, None), (None, prose(3, 20)), (13, prose(1, 30)[20:]), (14, "É é É é É é É é É é É")]
    long = " ".join([prose(9, 400), prose(1, 30), "x" * 5000, prose(2, 12), prose(8, 400)])
    docs = [(1, None), (2, ""), (3, prose(1, 30)), (3, prose(1, 30)), (4, prose(2, 12).upper()), (5, "so: tiny, item! tiny item"), (6, long), (None, prose(1, 30)), (7, prose(7, 50)), (8, "É é É é É é É é É é É é"), (9, "...")]
    docs += [(100 + k, " ".join(prose(1, 30).split()[k : k + 15] * 3)) for k in range(12)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_words": 40}, {"block_bytes": 150}, {"window": 4}])
def test_report_is_the_plain_search(spark, options):
    docs, items = tables()
    frame = documents(spark, docs).repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, n_words string")
    rows = d.report(frame, bench, **options).collect()
    assert sorted([tuple(r)[:6] for r in rows], key=str) == brute(docs, items, options.get("window", 10))


def test_longest_match(spark):
    docs, items = tables()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = {r.doc_id: r for r in d.report(documents(spark, docs), bench).collect()}
    assert (rows[6].longest, rows[6].longest_item, rows[6].longest_at) == (30, 1, 400)
    assert (rows[7].longest, rows[7].longest_item) == (0, None)


def test_removal_keeps_columns(spark):
    docs, items = tables()
    frame = documents(spark, docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = d.remove_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(b[0]) for b in brute(docs, items, 10) if not b[5])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.report(empty(spark), none).count() == 0
    row = d.report(documents(spark, [(1, "a b")]), none).first()
    assert tuple(row)[1:6] == (2, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_suffix_array():
    r = random.Random(4)
    for n in (0, 1, 2, 50, 300):
        text = np.array([r.randrange(3) for _ in range(n)], np.int64)
        assert d.suffix_array(text).tolist() == sorted(range(n), key=lambda k: text[k:].tolist())
