"""The byte pass against plain Python, and the audit against a walk through every order."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metreur.llm import audit

SCHEMA = "doc_id long, text string, lang string, part string"


def plain(text):
    words = [w for w in text.encode().split()]
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)]


def measured(texts, **options):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    return audit.measure(np.frombuffer(b"".join(raw), np.uint8), offsets, **options).T.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é€𐍈#|\t\n\x1f\x85  -")), max_size=8))
def test_measures_equal_plain_counts(texts):
    assert measured(texts) == [plain(t) for t in texts]


def test_state_is_carried_over_blocks_and_spans_over_insertions():
    texts = ["", "ab cd ab", " ", "wörd " * 50 + "Wörd", "x" * 300, "", "last one last"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    whole = audit.transduce(data, offsets)
    for block in (1, 2, 3, 7, 64):
        cut = audit.transduce(data, offsets, block)
        assert all(np.array_equal(whole[k], cut[k]) for k in whole)
    assert measured(texts, spans=3) == [plain(t) for t in texts]


def test_equal_hashes_do_not_merge_words(monkeypatch):
    monkeypatch.setattr(audit.SpanTable, "_hash", lambda self, begin, length: np.zeros(len(begin), np.uint64))
    texts = ["a b c a bb aab aac abcdefgh1 abcdefgh2 abcdefgh1", "a a"]
    assert measured(texts) == [plain(t) for t in texts]


def walk(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    facts = []
    for d, text, lang, _ in rows:
        text = text or ""
        n, distinct, caps, points, symbols = plain(text)
        earlier = any(o is not None and d is not None and o < d and (t or "") == text for o, t, *_ in rows)
        facts.append((d, lang or "", [n < 100, 100 * distinct < 80 * n, 100 * caps > 10 * points, symbols > 0, earlier]))
    out = {}
    for part in {p for _, p, _ in facts}:
        own = [(d, f) for d, p, f in facts if p == part]
        shapley = dict.fromkeys(range(5), 0)
        steps = {}
        for order in permutations(range(5)):
            gone = set()
            for step, k in enumerate(order):
                here = [j for j, (_, f) in enumerate(own) if f[k] and j not in gone]
                redundant = sum(f[k] and j in gone for j, (_, f) in enumerate(own))
                gone |= set(here)
                shapley[k] += len(here)
                unique = sum(f[k] and sum(f) == 1 for _, f in own)
                steps[order, step, k] = [len(own) - len(gone), len(here), redundant, unique, sum(own[j][0] in good for j in here), sum(own[j][0] in toxic for j in here)]
        for (order, step, k), v in steps.items():
            out[part, "".join("ABCDE"[x] for x in order), step + 1] = [*v, shapley[k]]
    return out


@pytest.fixture(scope="module")
def rows():
    many = " ".join(f"w{k}" for k in range(120))
    return [
        (1, many, "en", "x"), (2, many, "en", "x"), (3, many, "de", "x"), (3, many, "de", "x"), (None, many, "en", "x"), (4, many + " $", "en", None),
        (5, None, None, "x"), (6, "", "", "x"), (7, "same " * 200, "en", "x"), (8, "ABC " * 30, "de", "x"), (9, "A#", "de", "x"), (10, "W" * 200_000 + "\t#" * 3000, "de", "x"),
        (11, many.replace(" ", " "), "en", "x"), (None, None, "en", "x"), (12, many + "\x0b", "en", "x"),
    ]


def test_audit_equals_a_walk_through_every_order(spark, rows):
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (7, 1, 0), (9, 0, 1), (99, 1, 1), (None, 1, 1)]
    got = audit.audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    expected = walk(rows, labels)
    assert len(got) == len(expected) == 3 * 600
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == expected


def test_many_copies_of_one_text_in_small_partitions(spark):
    rows = [(k, "copy " * 5, "en", None) for k in range(400)] + [(1000 + k, f"own {k}", "en", None) for k in range(50)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = {r["mask"]: r["n"] for r in audit.marked(spark.createDataFrame(rows, SCHEMA).repartition(13), labels).collect()}
    assert counts == {1 + 2: 1, 1 + 2 + 16: 399, 1: 50}


def test_no_documents_give_no_parts(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], SCHEMA), labels).collect() == []
