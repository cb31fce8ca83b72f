import random

import pytest

from metreur.llm import neardup

from .fixtures import documents, empty, prose


def brute(docs):
    """Components over exact sets, all pairs."""
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if c.isascii() else c for c in t or "")
        for c in "\t\n\v\f\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, seed, n):
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{seed}x{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    docs, base, passage = [], prose(1, 150), prose(2, 40)
    docs += [(k, edited(base, k, k % 6)) for k in range(1, 90)]  # a group about its first text; some beyond 0.75
    chain = [base + " tail"]
    for k in range(12):
        chain.append(edited(chain[-1], 500 + k, 2))
    docs += [(100 + k, t) for k, t in enumerate(chain)]
    docs += [(200 + k, prose(300 + k, 45) + " " + passage) for k in range(60)]  # half of each is a passage that all share
    docs += [(300 + k, passage + " " + " ".join(f"u{k}x{j}" for j in range(k % 9))) for k in range(40)]
    docs += [(400 + k, " ".join(prose(7, 12).split()[: 3 + k])) for k in range(9)]
    docs += [(500, ""), (501, None), (502, "One two"), (503, "one\ttwo"), (504, "É a b c d e"), (505, "é a b c d e"), (506, "  x"), (507, prose(9, 3000)), (508, edited(prose(9, 3000), 1, 40))]
    return docs


def test_components_are_those_of_all_pairs(spark):
    docs = corpus()
    want = brute(docs)
    got = neardup.grouped(documents(spark, docs).repartition(3)).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays(spark):
    docs = [d for d in corpus() if d[0] >= 300]
    frame = documents(spark, docs)
    kept = neardup.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(docs).values()})


@pytest.mark.parametrize("small, large", [(145, 193), (192, 256), (193, 257), (237, 316), (250, 333), (255, 340), (256, 341), (256, 320)])
def test_texts_that_hold_a_smaller_one_at_three_quarters(spark, small, large):
    docs = []
    for k in range(16):
        words = [f"w{small}x{k}x{j}" for j in range(large + 4)]
        docs += [(2 * k + 1, " ".join(words[: small + 4])), (2 * k + 2, " ".join(words))]
    got = neardup.grouped(documents(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


def test_rows_without_id_and_repeated_rows(spark):
    docs = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (None, None)]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in neardup.grouped(documents(spark, docs)).collect())
    assert got == [("3", 3, True), ("3", 3, True), ("4", 3, False), ("None", None, True), ("None", None, True)]
    assert neardup.keep_one(documents(spark, docs)).count() == 4


def test_texts_of_one_id_are_told_apart(spark):
    one, other = prose(1, 150), " ".join(f"own{k}" for k in range(400))
    docs = [(1, one), (1, other), (2, edited(one, 1, 1)), (7, one + " tail"), (7, prose(3, 90)), (5, other + " tail")]
    frame = documents(spark, docs)
    got = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in neardup.grouped(frame).collect())
    assert [g[:3] for g in got] == [(1, 1, True), (1, 1, True), (2, 1, False), (5, 1, False), (7, 1, False), (7, 7, True)]
    assert sorted((r.doc_id, r.text) for r in neardup.keep_one(frame).collect()) == sorted([docs[0], docs[1], docs[4]])


def test_empty_table(spark):
    assert neardup.grouped(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 40])
def test_graph_components(spark, n):
    r = random.Random(n)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(n)] + [(100 + k, 101 + k) for k in range(n)]
    comp = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {x.node: x.comp for x in neardup.components(frame).collect()}
    assert {x: got.get(x, x) for x in comp} == comp


def test_of_equally_typical_members_the_one_without_own_text_is_compared(spark):
    # the edits of 1 and 3 lie outside the sketch, 4 is cut short; 2 is the text they come from
    rows = [(7, 1, 100, 5.0, 5), (7, 2, 100, 5.0, 0), (7, 3, 100, 5.0, 10), (7, 4, 96, 5.0, 0), (7, 5, 100, 4.0, 0)]
    entries = spark.createDataFrame(rows, "value bigint, rep bigint, n bigint, typical double, own bigint")
    pairs = neardup._Linker.stars(entries, neardup.F.lit(True))
    assert sorted(map(tuple, pairs.collect())) == [(2, 1), (2, 3), (2, 4), (2, 5)]
