"""Generated bills measured against delivered ones.

``generated``: pair, gen_index, designation, unit, unit_source, review_status.
``reference``: pair, ref_index, designation, unit.

Lines that read the same are one text here: likeness depends on the text alone,
so it is worked out once per pair of texts, and copies are only counted off
against each other when lines are matched.
"""

from __future__ import annotations

import heapq
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metreur.functions.similarity import ratio_ceiling, sequence_ratio
from metreur.functions.text import comparison_tokens, jaccard, normalize_text
from metreur.functions.units import unit_class
from metreur.operators import ordered
from metreur.session import checkpoint_folder, cut_lineage

MATCH_THRESHOLD = 0.62
_MARGIN = 1e-9
#: Likenesses of texts, and lines, of one pair of bills that one task walks at a time.
WALK_EDGES, WALK_LINES = 200_000, 1_000_000


def _texts(lines: DataFrame) -> DataFrame:
    texts = lines.select("pair", normalize_text("designation").alias("text")).where(F.col("text") != "").distinct()
    return texts.withColumn("tokens", comparison_tokens("text", normalized=True)).where(F.size("tokens") > 0)


def _by_rarity(generated: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts of both sides with tokens from the rarest of the pair to the most common."""
    both = generated.withColumn("side", F.lit("g")).unionByName(reference.withColumn("side", F.lit("r")))
    held = both.select("pair", "side", "text", F.explode("tokens").alias("token"))
    common = held.groupBy("pair", "token").agg(F.count("*").alias("n"))
    ranked = (
        held.join(common, ["pair", "token"])
        .groupBy("pair", "side", "text")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
        .select("pair", "side", "text", F.col("ranked.token").alias("tokens"))
    )
    return ranked.where("side = 'g'").drop("side"), ranked.where("side = 'r'").drop("side")


def shared_vocabulary(generated: DataFrame, reference: DataFrame, least: float) -> DataFrame:
    """Pairs of texts whose token sets overlap by ``least`` or more: pair, gen_text, ref_text, overlap.

    Two such sets share a token among the rarest few of each, so only those
    tokens are joined on, and a pair is taken at the first token it shares. Very
    common words come last in every text and hardly ever meet.
    """
    if least <= 0:
        raise ValueError("without a least overlap every pair of texts would have to be compared")
    left, right = _by_rarity(_texts(generated), _texts(reference))

    def probes(df, side):
        size = F.size("tokens")
        reach = size - F.ceil(size * F.lit(least) - _MARGIN).cast("int") + 1
        return df.select(
            "pair",
            F.col("text").alias(f"{side}_text"),
            F.col("tokens").alias(f"{side}_tokens"),
            F.slice("tokens", F.lit(1), reach).alias(f"{side}_probe"),
        ).select("*", F.posexplode(f"{side}_probe").alias(f"{side}_at", "token"))

    g, r = probes(left, "gen"), probes(right, "ref")
    gs, rs = F.size("gen_tokens"), F.size("ref_tokens")
    # overlap both sets need, and the most they can have from this token on
    needed = (gs + rs) * (least / (1 + least)) - _MARGIN
    possible = F.least(gs - F.col("gen_at"), rs - F.col("ref_at"))
    met = g.join(r, ["pair", "token"]).where(
        (possible >= needed)
        & (F.get(F.array_intersect("gen_probe", "ref_probe"), F.lit(0)) == F.col("token"))
    )
    return (
        met.withColumn("overlap", jaccard("gen_tokens", "ref_tokens"))
        .where(F.col("overlap") >= least - _MARGIN)
        .select("pair", "gen_text", "ref_text", "overlap")
    )


def similar_line_pairs(generated: DataFrame, reference: DataFrame, min_score: float = MATCH_THRESHOLD) -> DataFrame:
    """Pairs of distinct normalised texts alike by ``min_score`` or more: pair, gen_text, ref_text, score."""
    near = shared_vocabulary(generated, reference, 2 * min_score - 1)
    hopeful = near.where((ratio_ceiling("gen_text", "ref_text") + F.col("overlap")) / 2 >= min_score - _MARGIN)
    scored = hopeful.withColumn("score", (sequence_ratio("gen_text", "ref_text") + F.col("overlap")) / 2)  # once: not deterministic for the planner
    return scored.where(F.col("score") >= min_score).select("pair", "gen_text", "ref_text", "score")


def _members(lines: DataFrame, edges: DataFrame, index: str, text: str) -> DataFrame:
    """Lines of the texts that have a likeness: pair, text, idx."""
    wanted = edges.select("pair", F.col(text).alias("text")).distinct()
    return lines.select("pair", normalize_text("designation").alias("text"), F.col(index).cast("bigint").alias("idx")).join(
        wanted, ["pair", "text"], "left_semi"
    )


def _ranked(members: DataFrame) -> DataFrame:
    """Members with their rank in their text, greatest index first. Stored."""
    return cut_lineage(ordered.ranked(members, ["pair", "text"], [F.desc("idx")], "rank").select("pair", "text", "rank", "idx"))


def _side(members: DataFrame, edges: DataFrame, text: str, tag: str) -> DataFrame:
    """Lines and partners of each text."""
    lines = members.groupBy("pair", F.col("text").alias(text)).agg(F.count("*").alias(f"{tag}_n"))
    return lines.join(edges.groupBy("pair", text).agg(F.count("*").alias(f"{tag}_partners")), ["pair", text])


def _walk(edges: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
    """What one pair of bills takes from the top until a text has used the lines of its window.

    A generated line is served before those of smaller index at the same score, and takes
    the free line of greatest index among the texts it has that score with.
    """
    idx, used, more = {}, {}, {}
    for side, text, begun, left, lines in windows[["side", "text", "used", "left", "lines"]].itertuples(index=False):
        idx[side, text], used[side, text], more[side, text] = lines.tolist(), begun, left > len(lines)
    at, runs, stopped = dict.fromkeys(idx, 0), [], False
    pair = edges["pair"].iloc[0] if len(edges) else None
    for score, level in sorted(edges.groupby("score"), key=lambda x: -x[0]):
        partners: dict = {}
        for g, r in level[["gen_text", "ref_text"]].itertuples(index=False):
            partners.setdefault(("g", g), []).append(("r", r))
        heap = [(-idx[g][at[g]], g) for g in partners if at[g] < len(idx[g])]
        heapq.heapify(heap)
        while heap and not stopped:
            g = heap[0][1]
            r = max((r for r in partners[g] if at[r] < len(idx[r])), key=lambda r: idx[r][at[r]], default=None)
            if r is None:
                heapq.heappop(heap)
                continue
            last = runs[-1] if runs else None
            if last and last[0] == g[1] and last[1] == r[1] and last[2] == score:
                last[5] += 1
            else:
                runs.append([g[1], r[1], score, used[g] + at[g], used[r] + at[r], 1])
            at[g] += 1
            at[r] += 1
            ended = [t for t in (g, r) if at[t] == len(idx[t])]
            stopped = any(more[t] for t in ended)
            if g in ended:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (-idx[g][at[g]], g))
        if stopped:
            break
    found = pd.DataFrame(runs, columns=["gen_text", "ref_text", "score", "g_used", "r_used", "k"])
    found.insert(0, "pair", pair)
    return found


_TAKEN = "pair string, gen_text string, ref_text string, score double, g_used bigint, r_used bigint, k bigint"


def _walked(live: DataFrame, gen: DataFrame, ref: DataFrame) -> DataFrame:
    """Stretches that pairs of bills take, each walked over windows of at most about ``WALK_LINES`` lines."""
    texts = live.select("pair", F.explode(F.array(
        F.struct(F.lit("g").alias("side"), F.col("gen_text").alias("text"), F.col("g_used").alias("used"), (F.col("g_n") - F.col("g_used")).alias("left")),
        F.struct(F.lit("r").alias("side"), F.col("ref_text").alias("text"), F.col("r_used").alias("used"), (F.col("r_n") - F.col("r_used")).alias("left")),
    )).alias("t")).select("pair", "t.*").distinct()
    total = texts.groupBy("pair").agg(F.sum("left").alias("total"))
    # Texts get lines in proportion, so that their windows end at about the same time.
    share = F.greatest(F.lit(1), F.floor(F.col("left") * F.lit(float(WALK_LINES)) / F.greatest("total", F.lit(WALK_LINES))))
    texts = texts.join(total, "pair").withColumn("upto", F.col("used") + share).drop("total")
    members = gen.withColumn("side", F.lit("g")).unionByName(ref.withColumn("side", F.lit("r")))
    windows = members.join(texts, ["pair", "side", "text"]).where("rank > used and rank <= upto").groupBy("pair", "side", "text", "used", "left").agg(
        F.sort_array(F.collect_list("idx"), asc=False).alias("lines")
    )
    edges = live.select("pair", "gen_text", "ref_text", "score")
    windows = windows.select(F.col("pair").alias("bill"), "side", "text", "used", "left", "lines")  # told apart from that of the edges
    return edges.groupBy("pair").cogroup(windows.groupBy("bill")).applyInPandas(_walk, _TAKEN)


def _mutual(live: DataFrame, gen: DataFrame, ref: DataFrame) -> DataFrame:
    """Stretches that texts which are best for each other take, in pairs of bills of any size."""

    def bests(own: str, other: str, other_top: str) -> DataFrame:
        value = F.struct(F.col("score"), F.col(other_top).alias("top"), F.col(other).alias("text"))
        best = live.groupBy("pair", own).agg(F.max(value).alias("best"))
        rest = live.join(best, ["pair", own]).where(F.col(other) != F.col("best.text"))
        second = rest.groupBy("pair", own).agg(F.max(value).alias("second"))
        # a rival of the same score ends the stretch at its own next line
        rival = F.when(F.col("second.score") == F.col("best.score"), F.col("second.top"))
        return best.join(second, ["pair", own], "left").select("pair", own, F.col("best.text").alias(other), rival.alias(f"{own}_rival"))

    top = lambda members, text, tag: members.select(
        "pair", F.col("text").alias(text), (F.col("rank") - 1).alias(f"{tag}_used"), F.col("idx").alias(f"{tag}_top")
    )
    live = cut_lineage(live.join(top(gen, "gen_text", "g"), ["pair", "gen_text", "g_used"]).join(top(ref, "ref_text", "r"), ["pair", "ref_text", "r_used"]))
    mutual = cut_lineage(
        live.join(bests("gen_text", "ref_text", "r_top"), ["pair", "gen_text", "ref_text"])
        .join(bests("ref_text", "gen_text", "g_top"), ["pair", "gen_text", "ref_text"])
    )

    def ahead(members: DataFrame, text: str, used: str, rival: str, name: str) -> DataFrame:
        counted = (
            mutual.where(F.col(rival).isNotNull())
            .join(members.select("pair", F.col("text").alias(text), "rank", "idx"), ["pair", text])
            .where((F.col("rank") > F.col(used)) & (F.col("idx") > F.col(rival)))
        )
        return counted.groupBy("pair", text).agg(F.count("*").alias(name))

    return (
        mutual.join(ahead(ref, "ref_text", "r_used", "gen_text_rival", "r_run"), ["pair", "ref_text"], "left")
        .join(ahead(gen, "gen_text", "g_used", "ref_text_rival", "g_run"), ["pair", "gen_text"], "left")
        .withColumn("k", F.least(F.col("g_n") - F.col("g_used"), F.col("r_n") - F.col("r_used"), "r_run", "g_run"))
    )


def match_one_to_one(pairs: DataFrame, generated: DataFrame, reference: DataFrame) -> DataFrame:
    """One reference line at most per generated line: pair, gen_index, ref_index, score.

    Best score first, then greatest indexes, as if the likenesses of all lines were sorted
    and taken from the top. ``pairs`` holds each pair of texts once.

    A text's lines are used from the greatest index down, so all it has to keep is how
    many are gone. Texts that are each other's only partner are settled at once. Of the
    rest, a pair of bills with at most ``WALK_EDGES`` likenesses is walked by one task, over
    windows of its texts' next lines: lines of equal scores whose indexes interleave are
    taken one by one, so that anything that stops at each of them would take a round a line.
    In larger pairs of bills a round takes every pair of texts that are best for each
    other, and counts off as many lines of both as stay ahead of the next best; those
    would be taken before any other line of either text. What a round took is appended to a
    stored table, one row per stretch of lines. Each round takes at least the best likeness
    left in every pair of bills.
    """
    spark = pairs.sparkSession
    edges = cut_lineage(pairs)
    gen = _ranked(_members(generated, edges, "gen_index", "gen_text"))
    ref = _ranked(_members(reference, edges, "ref_index", "ref_text"))
    stretches = f"{checkpoint_folder(spark)}/matches-{uuid.uuid4().hex}"

    def take(found: DataFrame) -> None:
        found.select("pair", "gen_text", "ref_text", "score", "g_used", "r_used", "k").write.mode("append").parquet(stretches)

    state = edges.join(_side(gen, edges, "gen_text", "g"), ["pair", "gen_text"]).join(_side(ref, edges, "ref_text", "r"), ["pair", "ref_text"])
    zero = F.lit(0).cast("bigint")
    state = cut_lineage(state.withColumn("g_used", zero).withColumn("r_used", zero))
    lone = (F.col("g_partners") == 1) & (F.col("r_partners") == 1)
    take(state.where(lone).withColumn("k", F.least("g_n", "r_n")))
    live = cut_lineage(state.where(~lone).drop("g_partners", "r_partners"))
    while not live.isEmpty():
        large = live.groupBy("pair").agg(F.count("*").alias("many")).where(F.col("many") > WALK_EDGES).select("pair")
        taken = _walked(live.join(large, "pair", "left_anti"), gen, ref)
        if not large.isEmpty():
            some = _mutual(live.join(large, "pair", "left_semi"), gen, ref)
            taken = taken.unionByName(some.select(taken.columns))
        taken = cut_lineage(taken)
        take(taken)
        moved = lambda text, tag: taken.groupBy("pair", text).agg(F.sum("k").alias(f"{tag}_k"))
        state = live.join(moved("gen_text", "g"), ["pair", "gen_text"], "left").join(moved("ref_text", "r"), ["pair", "ref_text"], "left")
        state = state.withColumn("g_used", F.col("g_used") + F.coalesce("g_k", zero)).withColumn("r_used", F.col("r_used") + F.coalesce("r_k", zero))
        live = cut_lineage(state.drop("g_k", "r_k").where("g_used < g_n and r_used < r_n"))
    line = lambda members, tag: members.select("pair", F.col("text").alias(f"{tag}_text"), F.col("rank").alias(f"{tag}_rank"), F.col("idx").alias(f"{tag}_index"))
    return (
        spark.read.schema(_TAKEN).parquet(stretches)
        .select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("k"))).alias("step"))
        .select("pair", "gen_text", "ref_text", "score", (F.col("g_used") + F.col("step")).alias("gen_rank"), (F.col("r_used") + F.col("step")).alias("ref_rank"))
        .join(line(gen, "gen"), ["pair", "gen_text", "gen_rank"])
        .join(line(ref, "ref"), ["pair", "ref_text", "ref_rank"])
        .select("pair", "gen_index", "ref_index", "score")
    )


def unmatched(generated: DataFrame, reference: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(generated lines, reference lines) no match used."""
    return (
        generated.join(matches.select("pair", "gen_index"), ["pair", "gen_index"], "left_anti"),
        reference.join(matches.select("pair", "ref_index"), ["pair", "ref_index"], "left_anti"),
    )


def checked_matches(generated: DataFrame, reference: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches with both units and whether they are of one class."""
    return (
        matches.join(generated.select("pair", "gen_index", F.col("unit").alias("gen_unit"), "unit_source"), ["pair", "gen_index"])
        .join(
            reference.select("pair", "ref_index", F.col("designation").alias("ref_designation"), F.col("unit").alias("ref_unit")),
            ["pair", "ref_index"],
        )
        .withColumn("unit_ok", unit_class("gen_unit") == unit_class("ref_unit"))
    )


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def with_ratios(counts: DataFrame) -> DataFrame:
    both = F.col("recall") + F.col("precision")
    return (
        counts.withColumn("recall", _share("matched", "reference_items"))
        .withColumn("precision", _share("matched", "generated_items"))
        .withColumn("unit_accuracy", _share("unit_ok", "matched"))
        .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), both), F.lit(0.0)))
    )


def evaluate_pairs(generated: DataFrame, reference: DataFrame, matches: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Counts, recall, precision, unit accuracy and F1 of each pair of bills.

    ``errors``: pair, error of pairs that could not be read or lack a side. Such a pair has a
    row with its first error and no counts, whatever was read of it; others have a null error.
    """
    if errors is not None:
        failed = errors.groupBy("pair").agg(F.min("error").alias("error"))
        sound = lambda df: df.join(failed, "pair", "left_anti")
        found = evaluate_pairs(sound(generated), sound(reference), sound(matches))
        blank = {c: F.lit(0).cast(t) for c, t in found.dtypes if c != "pair"}
        rows = failed.select("pair", *[v.alias(c) for c, v in blank.items()], "error")
        return found.withColumn("error", F.lit(None).cast("string")).unionByName(rows)
    made = generated.groupBy("pair").agg(
        F.count("*").alias("generated_items"), F.count_if(F.col("review_status") != "validated").alias("flagged")
    )
    wanted = reference.groupBy("pair").agg(F.count("*").alias("reference_items"))
    hit = checked_matches(generated, reference, matches).groupBy("pair").agg(
        F.count("*").alias("matched"), F.count_if("unit_ok").alias("unit_ok")
    )
    counts = made.join(wanted, "pair", "full").join(hit, "pair", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return with_ratios(
        counts.select("pair", *[zero(c) for c in ("reference_items", "generated_items", "matched", "unit_ok", "flagged")])
    )


def evaluate_total(evaluation: DataFrame) -> DataFrame:
    """The same over all pairs without an error, from the summed counts."""
    if "error" in evaluation.columns:
        evaluation = evaluation.where(F.coalesce("error", F.lit("")) == "")
    counts = ("reference_items", "generated_items", "matched", "unit_ok", "flagged")
    return with_ratios(evaluation.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]))


def unit_source_counts(generated: DataFrame) -> DataFrame:
    return generated.groupBy("pair", F.coalesce("unit_source", F.lit("?")).alias("unit_source")).agg(F.count("*").alias("n"))
