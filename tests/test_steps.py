"""Stored steps: what is broadcast is measured, and nothing of a step stays but its rows."""

import os
import time

import pytest
from pyspark.sql import functions as F

from metreur import session
from metreur.operators import enrich, headings, lines, ordered, rollup
from metreur.plans import reprocess
from metreur.plans.extract import extract_lines
from metreur.session import counted_list, passing_steps, store_step
from specs import SPECS, tables


def _last_plan(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    return done.apply(done.size() - 1).physicalPlanDescription()


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(n).getName() for n in range(found.size()) if found.apply(n).getName().startswith("shuffle_")}


def test_small_files_of_many_rows_are_not_broadcast(spark):
    many = store_step(spark.range(1_000_000).select(F.col("id").cast("string").alias("key"), F.lit("Ouvrages").alias("title")))
    got = store_step(many.join(many.select("key"), "key"))
    assert "BroadcastHashJoin" not in _last_plan(spark) and got.count() == 1_000_000
    # files of a few rows, from which a sequence makes many
    few = store_step(spark.range(3).select(F.col("id").cast("string").alias("key")))
    made = few.select("key", F.explode(F.sequence(F.lit(1), F.lit(400_000))).alias("pos"))
    got = store_step(many.join(made, "key"))
    assert "BroadcastHashJoin" not in _last_plan(spark) and got.count() == 1_200_000
    got = store_step(many.join(few, "key"))
    assert "BroadcastHashJoin" in _last_plan(spark) and got.count() == 3


def test_settings_are_put_back(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before = [spark.conf.get(n, None) for n in names]
    store_step(spark.range(3))
    with pytest.raises(Exception):
        store_step(spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x")))
    assert [spark.conf.get(n, None) for n in names] == before


def test_shuffles_go_with_their_step(spark):
    before = _shuffle_files(spark)
    stored = store_step(spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before and stored.count() == 7


def test_lists_are_broadcast_while_short(spark, monkeypatch):
    monkeypatch.setattr(session, "FEW", 3)
    for n, broadcast in ((3, True), (4, False)):
        keys = counted_list(store_step(spark.range(n).select(F.col("id").alias("key"))))
        assert keys.count() == n and ("broadcast" in keys._jdf.queryExecution().logical().toString()) == broadcast


def test_warnings_are_stored(spark):
    documents, blocks = tables(spark, {k: SPECS[k] for k in ("dominant", "hierarchy")})
    got = extract_lines(documents, blocks).warnings
    assert "Join" not in got._jdf.queryExecution().toString() and got.count() > 0


def test_context_is_attached_last(spark, monkeypatch):
    documents, blocks = tables(spark, {k: SPECS[k] for k in ("dominant", "hierarchy")})
    given, attach = [], lines.attach_context
    monkeypatch.setattr(lines, "attach_context", lambda headings, b: given.append(headings.columns) or attach(headings, b))
    assert extract_lines(documents, blocks).lines.count() > 0
    assert {"rank", "family", "method"} <= set(given[0])


def _noted(stored):
    return lambda df: stored.append(df.columns) or store_step(df)


def _same(a, b):
    return sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


def test_repeated_headings_are_told_without_their_texts(spark):
    titles = ["Description des ouvrages", "Voirie", "VOIRIE ", "Réseaux", None]
    rows = [("st"[n % 2], n, f"{n % 4 + 1}{'aA'[n % 3 == 0]}", titles[n % 5], 1 + n % 3, 1, "paragraph", 10.0, False) for n in range(1, 61)]
    found = spark.createDataFrame(rows, "source_id string, pos int, code string, title string, level int, page int, source_kind string, font_size double, bold boolean")
    stored = []
    got = headings.dedupe_headings(found, _noted(stored))
    # as a list of texts would be told, document by document
    first, kept, told = {}, {}, {}
    key = {r["title"]: r["title_key"] for r in got.select("title", "title_key").collect()} | {"VOIRIE ": "voirie", None: None}
    for s, n, code, title, level, *_ in rows:
        first.setdefault((s, code), n)
        if level != 1 or first[s, code] == n or title == "Description des ouvrages":
            kept.setdefault((s, code.lower(), key[title]), (s, n, code, key[title]))
    for s, _, code, k in kept.values():
        told.setdefault((s, code), set()).add(k)
    expected = {(s, n, len(told[s, code] - {None}) > 1) for s, n, code, _ in kept.values()}
    assert {(r["source_id"], r["pos"], r["code_conflict"]) for r in got.collect()} == expected
    assert _same(got, headings.dedupe_headings(found)) and len([c for c in stored if "title" in c or "title_key" in c]) == 1 < len(stored)


def test_added_lines_are_numbered_without_the_texts(spark, monkeypatch):
    documents, blocks = tables(spark, {k: SPECS[k] for k in ("decomposed", "skeleton", "controls_vrd")})
    first = extract_lines(documents, blocks)
    read = store_step(first.lines.where("origin = 'deterministic-v2'"))
    for apply in (enrich.apply_decomposition, enrich.apply_skeleton):
        stored = []
        monkeypatch.setattr(enrich, "store_step", _noted(stored))
        got = apply(read, first.lots, store_step)
        assert got.count() > read.count() and _same(got, apply(read, first.lots)) and stored == [["source_id", "slot", "pos"]]


def test_only_lines_that_close_sections_are_stored(spark, monkeypatch):
    rows = []
    for s in "ab":
        for n in range(1, 201):
            kind, level, code = ("section", 2, f"4.{n // 50 + 1}") if n % 50 == 1 else ("item", 3, f"4.{n // 50 + 1}.{n}")
            rows.append((s, n, kind, level, code, f"Poste {n}", float(n), 2.0, n % 3 != 0))
    bills = spark.createDataFrame(rows, "source_id string, pos bigint, kind string, level int, code string, designation string, quantity double, unit_price double, included boolean")
    stored = []
    monkeypatch.setattr(rollup, "store_step", lambda df: stored.append(store_step(df)) or stored[-1])
    got = {(r["source_id"], r["pos"]): float(r["amount"]) for r in rollup.bill_rollup(bills).where("row_kind = 'subtotal'").collect()}
    assert got == {(s, p): float(sum(2 * n for n in range(p, min(p + 50, 201)) if n % 50 != 1 and n % 3)) for s in "ab" for p in (1, 51, 101, 151)}
    assert sorted(df.count() for df in stored) == [2, 8, 10]  # totals, subtotals, and sections with the ends of both bills


def test_steps_that_passed_are_removed(spark):
    with passing_steps() as outer:
        with passing_steps() as keep:
            first = store_step(spark.range(5))
            second = keep(first.withColumn("x", F.lit(1)))
        assert second.count() == 5
        with pytest.raises(Exception):
            first.count()
        third = outer(second)
    assert third.count() == 5
    with pytest.raises(Exception):
        second.count()


def test_places_in_an_order_do_not_go_through_the_driver(spark):
    rows = spark.range(100).select((F.col("id") % 5).cast("string").alias("key"), F.col("id").alias("at"))
    placed = store_step(ordered.ranked(rows, ["key"], ["at"], "place"))
    assert "BroadcastHashJoin" not in _last_plan(spark)
    assert {tuple(r) for r in placed.collect()} == {(str(n % 5), n, n // 5 + 1) for n in range(100)}


def test_a_reprocessing_leaves_its_results_alone(spark):
    documents, blocks = tables(spark, {k: SPECS[k] for k in ("dominant", "hierarchy")})
    previous = extract_lines(documents.where("source_id = 'hierarchy'"), blocks.where("source_id = 'hierarchy'")).lines
    stored = reprocess.content_facts(documents, blocks).where("source_id = 'hierarchy'").select("source_id", "content_hash")
    before = _steps(spark)
    done = reprocess.reprocess(documents, blocks, stored, previous)
    assert {r["source_id"]: r["changed"] for r in done.facts.collect()} == {"dominant": True, "hierarchy": False}
    assert {r["source_id"] for r in done.lines.select("source_id").distinct().collect()} == {"dominant", "hierarchy"}
    assert len(_steps(spark) - before) == 3  # what changed, the lines, and the facts with their figures


def _steps(spark):
    folder = session.checkpoint_folder(spark).removeprefix("file:")
    return {x for x in os.listdir(folder) if x.startswith("step-")}
