"""The trie against dictionaries of prefixes, in one range and in many."""

import hashlib
import random
import zlib

import pytest

from metreur.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, part int, seq string, n int"


def conversations(rows):
    """{conv_id: [(role, text)]} in the order of the operator."""
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def rebuilt(own):
    done = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        done[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return done


def plain(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        own = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not children[node]
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted((min(w), len(n), min(members[n[:-1]]) if n else -1, len(w), children[n], leaves[n], saved[n], sha(n)) for n, w in members.items())


def shown(found):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in found.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash", 3) for r in rows], SCHEMA)


def drawn(seed, many, deep=7, names=3):
    draw = random.Random(seed)
    return {c: [("ua"[k % 2], f"é{draw.randrange(names)}" * draw.randrange(3)) for k in range(draw.randrange(deep + 1))] for c in draw.sample(range(10_000), many)}


def stored(spark, convs):
    return trie.sequences(table(spark, [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]))


@pytest.mark.parametrize("seed,many,range_rows", [(1, 60, 10**6), (2, 120, 60), (4, 40, 9)])
def test_nodes_equal_plain_prefixes(spark, seed, many, range_rows):
    convs = {c: t for c, t in drawn(seed, many).items() if t}
    assert shown(trie.nodes(stored(spark, convs), range_rows=range_rows)) == plain(convs)


def test_copies_and_shared_beginnings_that_fill_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    first = ("u", "hello")
    convs = {k: [first, ("a", "x"), ("u", "y")] for k in range(0, 90)}
    convs |= {k: [first] for k in range(300, 345)}
    convs |= {k: [first, ("a", "x"), ("u", "y"), ("a", f"{k % 40}")] for k in range(450, 500)}
    convs |= {k: [("u", f"own {k}")] * (k % 4 + 1) for k in range(600, 630)}
    assert shown(trie.nodes(stored(spark, convs), range_rows=60)) == plain(convs)


def test_one_long_conversation_and_its_copies(spark):
    long = [("u", f"t{k}") for k in range(120)]
    convs = {1: long, 2: long, 3: long[:80] + [("a", "other")], 4: long[:60], 9: [("u", "x" * 200_000)]}
    assert shown(trie.nodes(stored(spark, convs), range_rows=130)) == plain(convs)


def test_rebuilt_conversations_with_nulls_ties_and_repeated_rows(spark):
    draw = random.Random(7)
    rows = []
    for c in draw.sample(range(-20, 120), 60):
        for k in range(draw.randrange(1, 12)):
            rows.append((c, draw.choice([k, k, None, 3]), draw.choice(["user", "assistant", None, ""]), draw.choice(["a", "b", "", None, "ü" * 9])))
    rows += [(None, 1, "user", "lost"), (None, None, None, None)] + rows[:30]
    own = {c: t for c, t in conversations(rows).items() if c >= 0}
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    turns = table(spark, rows)
    assert shown(trie.rebuilt_nodes(turns)) == plain(rebuilt(own))
    held = {r.conv_id: len(r.turns) for r in trie.rebuilt(trie.sequences(turns)).collect()}
    assert held == {c: len(t) for c, t in rebuilt(own).items()}
    assert 0 in held.values()  # some have no turns left


def test_turnless_conversations_and_empty_tables(spark):
    turns = table(spark, [(1, 0, "user", "a")])  # h is 8 for conversation 1: nothing is left
    assert zlib.crc32(b"1") % 9 >= 1
    assert shown(trie.rebuilt_nodes(turns)) == plain({1: []})
    assert trie.rebuilt_nodes(table(spark, [])).collect() == []
    assert trie.rebuilt_nodes(table(spark, [(None, 0, "user", "a")])).collect() == []
