import functools
import itertools
import random
import re
from collections import defaultdict

import pytest

from metreur.llm import chat

LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


def brute(roles):
    """Cheapest repair over all legal sequences, empty turns put in one by one."""

    @functools.cache
    def best(k, s):
        if k == len(roles):
            return {0: 0, 1: 6, 2: 3, 3: 0}[s]
        ways = []
        for o in (1, 2, 3):
            named = 0 if roles[k] == o else 2
            if o == s:
                ways.append(named + 1 + best(k + 1, o))
            reach = {s: 0}
            for _ in range(4):
                after = {}
                for at, cost in reach.items():
                    for n in LEGAL[at]:
                        if n == o:
                            ways.append(named + cost + best(k + 1, o))
                        after[n] = min(after.get(n, 99), cost + 3)
                reach = after
        return min(ways)

    return best(0, 0)


def test_cost_is_least():
    for n in range(6):
        for roles in itertools.product(range(4), repeat=n):
            assert chat.path(list(roles), 0, None)[0] == brute(roles)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_conversations_over_many_tasks(spark, parts):
    r = random.Random(parts)
    names = ["system", "user", "assistant", None, "tool", "Human ", "gpt"]
    rows = [(c, t, r.choice(names), f"t{c}.{t}", 1, "x") for c in [1, *range(2, 30)] for t in range(700 if c == 1 else r.randint(1, 6))]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, cost int, tie string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = chat.repair(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(done) == len(rows)
    by = defaultdict(list)
    for x in done:
        by[x.conv_id].append(x)
    for c, own in by.items():
        own.sort(key=lambda x: x.turn)
        given = [chat.role_number(x[2]) for x in sorted(x for x in rows if x[0] == c)] if c is None else [chat.role_number(x.role_in) for x in own]
        assert sum(x.cost for x in own) == chat.path(given, 0, None)[0]
        whole = "".join(x.rendered for x in own)
        roles = re.findall(r"<\|(system|user|assistant)\|>\n", whole)
        assert re.fullmatch("s?(ua)+", "".join(x[0] for x in roles))
        turns = whole.split("<|end|>\n")
        assert len(turns) == len(roles) + 1 and turns[-1] == ""
        for x in own:
            assert f"t{c}.{x.turn}" in turns[x.out_turn].split("\n") and turns[x.out_turn].startswith(f"<|{x.role_out}|>\n")


def test_odd_rows(spark):
    rows = [(None, None, "user", None), (None, 3, "user", "<|end|>"), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 2, "assistant", "b"), (6, 0, "", ""), (7, 0, "assistant", "x" * 50_000)]
    done = chat.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(done) == len(rows)
    five = [x for x in done if x.conv_id == 5]
    assert sorted(x.action for x in five) == ["keep", "keep", "merge"] and sorted(x.out_turn for x in five) == [0, 0, 1]
    assert [x.put_before for x in done if x.conv_id == 7] == ["user"]
    assert "< |end|>" in "".join(x.rendered for x in done if x.conv_id is None)
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.repair(none).count() == 0
