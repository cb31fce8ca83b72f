"""Exact duplicates against plain grouping."""

import hashlib
import random
import re

import pytest

from metreur.llm import dedup

SCHEMA = "doc_id long, text string, digest string, run int, n long, best string"


def plain(rows):
    """{doc_id: (keep_id, group_size, kept, digest)} for rows with ids of their own."""
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(d)
    return {d: (min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}


def got(found):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()}


def _rows(texts):
    return [(d, t, "clash", 7, 7, "clash") for d, t in texts]


@pytest.mark.parametrize("parts,fan", [(1, 8), (2, 2), (9, 2), (9, 3), (20, 8)])
def test_equals_plain_grouping_for_any_tree(spark, parts, fan):
    draw = random.Random(parts * 10 + fan)
    kinds = ["", " ", "\t\n", None, "a b", "a  b", "a\x0b\x0c\rb", "a b", " a b", "a b ", "A b", "ü" * 1000, "word " * 40_000, "word\n" * 40_000, "\x1c", "a" + " " * 100_000 + "b"]
    ids = draw.sample(range(-500, 500), 300)
    rows = _rows([(d, draw.choice(kinds) if draw.random() < 0.7 else f"text {draw.randrange(150)}") for d in ids])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert got(dedup.assigned(docs, fan=fan)) == plain(rows)


def test_one_text_that_holds_a_third_of_the_rows(spark):
    rows = _rows([(k, "copy") for k in range(3000)] + [(10_000 + k, f"own {k}") for k in range(6000)])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(16)
    assert got(dedup.assigned(docs)) == plain(rows)


def test_rows_without_ids_and_repeated_rows(spark):
    rows = _rows([(None, "a"), (None, "a"), (5, "b"), (5, "b"), (None, "b"), (6, "b"), (7, "a  c"), (7, "a c"), (7, "other")])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup.assigned(docs).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(found, key=key) == sorted(
        [(None, None, 2, True), (None, None, 2, False), (5, 5, 4, True), (5, 5, 4, False), (None, 5, 4, False), (6, 5, 4, False), (7, 7, 2, True), (7, 7, 2, False), (7, 7, 1, True)], key=key
    )
    kept = sorted(((r.doc_id, re.sub(" +", " ", r.text), r.digest, r.run) for r in dedup.keep_first(docs).collect()), key=str)
    assert kept == sorted([(None, "a", "clash", 7), (5, "b", "clash", 7), (7, "a c", "clash", 7), (7, "other", "clash", 7)], key=str)
    assert dedup.keep_first(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert dedup.assigned(docs).collect() == []
    assert dedup.keep_first(docs).collect() == []
