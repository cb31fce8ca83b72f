import difflib
import random
import re

import pytest

from metreur import catalogue
from metreur.operators import evaluate
from metreur.plans.evaluation import evaluate_corpus, pair_errors

THINGS = ["clôture", "bordure", "regard", "tranchée", "câble", "peinture", "portail"]
DETAILS = ["existante", "béton", "acier", "de visite", "en pied", "type T1", "type CS1"]


def words(value):
    return {w for w in re.findall("[a-z0-9]+", value) if len(w) > 1 and w not in catalogue.COMPARISON_STOPWORDS}


def likeness(a, b):
    if not a or not b:
        return 0.0
    x, y = words(a), words(b)
    return (difflib.SequenceMatcher(None, a, b).ratio() + (len(x & y) / len(x | y) if x | y else 0.0)) / 2


def fold(value):
    return value.lower().replace("ô", "o").replace("é", "e").replace("â", "a")


@pytest.fixture(scope="module")
def bills(spark):
    rng = random.Random(11)
    sides = {"g": [], "r": []}
    for pair in ("p1", "p2", "p3"):
        for side, rows in sides.items():
            for n in range(rng.randint(30, 45)):
                verb = rng.choice(["Dépose de", "Fourniture", ""])
                name = f"{verb} {rng.choice(THINGS)} {rng.choice(DETAILS)}".strip()
                unit = rng.choice(["U", "u", "ml", "m²"])
                rows.append((pair, n, name, unit, "rule", "validated") if side == "g" else (pair, n, name, unit))
    gen = spark.createDataFrame(
        sides["g"], "pair string, gen_index bigint, designation string, unit string, unit_source string, review_status string"
    )
    ref = spark.createDataFrame(sides["r"], "pair string, ref_index bigint, designation string, unit string")
    return sides, gen, ref


def greedy(sides):
    out = []
    for pair in ("p1", "p2", "p3"):
        scored = [
            (likeness(fold(g[2]), fold(r[2])), g[1], r[1]) for g in sides["g"] if g[0] == pair for r in sides["r"] if r[0] == pair
        ]
        used_g, used_r = set(), set()
        for score, g, r in sorted(scored, reverse=True):
            if score >= evaluate.MATCH_THRESHOLD and g not in used_g and r not in used_r:
                used_g.add(g)
                used_r.add(r)
                out.append((pair, g, r, round(score, 9)))
    return sorted(out)


def shown(df):
    return sorted((r["pair"], r["gen_index"], r["ref_index"], round(r["score"], 9)) for r in df.collect())


def test_no_likely_pair_is_lost(bills):
    sides, gen, ref = bills
    got = {(r["pair"], r["gen_text"], r["ref_text"]) for r in evaluate.similar_line_pairs(gen, ref).collect()}
    want = {
        (g[0], fold(g[2]), fold(r[2]))
        for g in sides["g"] for r in sides["r"]
        if g[0] == r[0] and likeness(fold(g[2]), fold(r[2])) >= evaluate.MATCH_THRESHOLD
    }
    assert got == want and len(want) > 50


def test_matching_equals_the_greedy_walk(bills):
    sides, gen, ref = bills
    want = greedy(sides)
    assert len(want) > 30
    assert shown(evaluate.match_one_to_one(evaluate.similar_line_pairs(gen, ref), gen, ref)) == want


def sorted_walk(edges, gen, ref):
    """All likenesses of lines, sorted, taken from the top."""
    lines = sorted(((s, g, r, p) for p, a, b, s in edges for q, g, t in gen if (q, t) == (p, a) for o, r, u in ref if (o, u) == (p, b)), reverse=True)
    used, out = set(), []
    for s, g, r, p in lines:
        if (p, "g", g) not in used and (p, "r", r) not in used:
            used |= {(p, "g", g), (p, "r", r)}
            out.append((p, g, r, s))
    return sorted(out)


def test_chain_of_falling_scores_copies_and_ties(spark):
    chain = [("c", f"g{k // 2 + k % 2}", f"r{k // 2}", 1 - k / 100) for k in range(13)]
    gen = [("c", k, f"g{k}") for k in range(8)]
    ref = [("c", k, f"r{k}") for k in range(7)]
    # copies whose indexes interleave, all of one score, and lone partners with more lines on one side
    tied = [("t", a, b, 0.9) for a in ("x", "y", "z") for b in ("p", "q") if (a, b) != ("z", "q")] + [("t", "lone", "only", 0.5)]
    gen += [("t", k, "xyz"[k % 3]) for k in range(12)] + [("t", 100 + k, "lone") for k in range(5)]
    ref += [("t", k, "ppq"[k % 3]) for k in range(10)] + [("t", 200 + k, "only") for k in range(3)]
    edges = chain + tied
    table = lambda rows, name: spark.createDataFrame([(p, n, t, "U", None, "validated") for p, n, t in rows], f"pair string, {name} long, designation string, unit string, unit_source string, review_status string")
    got = evaluate.match_one_to_one(spark.createDataFrame(edges, "pair string, gen_text string, ref_text string, score double"), table(gen, "gen_index"), table(ref, "ref_index"))
    assert shown(got) == [(p, g, r, round(s, 9)) for p, g, r, s in sorted_walk(edges, gen, ref)]


def _interleaved():
    """Copies of a few texts, all likenesses of two scores, with indexes that take turns."""
    rng = random.Random(5)
    edges = [("t", f"g{a}", f"r{b}", 0.9 if (a + b) % 3 else 0.8) for a in range(5) for b in range(4) if (a, b) != (4, 1)]
    edges += [("u", "g0", "r0", 0.7), ("u", "g0", "r1", 0.7), ("u", "g1", "r1", 0.7)]
    gen = [(p, k, f"g{rng.randrange(5)}") for p in ("t", "u") for k in range(90)]
    ref = [(p, k, f"r{rng.randrange(4)}") for p in ("t", "u") for k in range(80)]
    return edges, gen, ref


def _matched(spark, edges, gen, ref):
    table = lambda rows, name: spark.createDataFrame([(p, n, t, "U", None, "validated") for p, n, t in rows], f"pair string, {name} long, designation string, unit string, unit_source string, review_status string")
    return shown(evaluate.match_one_to_one(spark.createDataFrame(edges, "pair string, gen_text string, ref_text string, score double"), table(gen, "gen_index"), table(ref, "ref_index")))


def test_interleaved_copies_need_no_round_a_line(spark, monkeypatch):
    edges, gen, ref = _interleaved()
    stored, cut = [], evaluate.cut_lineage
    monkeypatch.setattr(evaluate, "cut_lineage", lambda df: stored.append(1) or cut(df))
    got = _matched(spark, edges, gen, ref)
    assert got == [(p, g, r, round(s, 9)) for p, g, r, s in sorted_walk(edges, gen, ref)]
    assert len(stored) < 12


def test_windows_and_large_pairs_of_bills_match_alike(spark, monkeypatch):
    edges, gen, ref = _interleaved()
    gen, ref = [x for x in gen if x[1] < 30], [x for x in ref if x[1] < 25]
    monkeypatch.setattr(evaluate, "WALK_LINES", 20)
    monkeypatch.setattr(evaluate, "WALK_EDGES", 12)
    assert _matched(spark, edges, gen, ref) == [(p, g, r, round(s, 9)) for p, g, r, s in sorted_walk(edges, gen, ref)]


def test_no_likeness_gives_no_match(bills):
    _, gen, ref = bills
    none = gen.sparkSession.createDataFrame([], "pair string, gen_text string, ref_text string, score double")
    assert evaluate.match_one_to_one(none, gen, ref).collect() == []


def test_figures(bills):
    sides, gen, ref = bills
    found = evaluate_corpus(gen, ref)
    rows = {r["pair"]: r for r in found.by_pair.collect()}
    want = greedy(sides)
    for pair, row in rows.items():
        n = sum(1 for m in want if m[0] == pair)
        assert row["matched"] == n
        assert row["recall"] == pytest.approx(n / row["reference_items"])
    total = found.total.first()
    assert total["matched"] == len(want)
    left = found.unmatched_generated.groupBy("pair").count().collect()
    assert all(r["count"] <= 25 for r in left)


def test_a_threshold_that_cannot_be_blocked_is_refused(bills):
    _, gen, ref = bills
    with pytest.raises(ValueError):
        evaluate.similar_line_pairs(gen, ref, 0.5)


def test_pairs_with_errors_have_a_row_and_no_figures(bills):
    sides, gen, ref = bills
    spark = gen.sparkSession
    pairs = spark.createDataFrame([("p1", True, True), ("p2", True, True), ("p3", True, True), ("lone", True, None)], "pair string, has_source boolean, has_bill boolean")
    failures = spark.createDataFrame([("p2", "BadZipFile: no workbook"), ("p2", "another")], "pair string, error string")
    found = evaluate_corpus(gen, ref, pair_errors(pairs, failures))
    rows = {r["pair"]: r for r in found.by_pair.collect()}
    assert {p: r["error"] for p, r in rows.items()} == {"p1": None, "p2": "BadZipFile: no workbook", "p3": None, "lone": "couple CCTP/DPGF incomplet"}
    assert rows["p2"]["generated_items"] == rows["p2"]["matched"] == 0
    want = [m for m in greedy(sides) if m[0] != "p2"]
    assert found.total.first()["matched"] == len(want)
    assert {r["pair"] for r in found.unmatched_reference.collect()} <= {"p1", "p3"}
