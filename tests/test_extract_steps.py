"""The steps of the extraction: each text is asked once, and nothing is worked out that nobody reads."""

import pytest
from pyspark.sql import functions as F

from metreur.functions import text
from metreur.operators import enrich, headings, lines, perimeter
from metreur.plans.extract import extract_lines, retry_perimeter
from metreur.session import store_step
from specs import SPECS, tables

BLOCK = "source_id string, pos int, text string, page int, style string, font_size double, bold boolean, source_kind string"
HEADINGS = "source_id string, pos int, code string, title string, level int, page int, source_kind string, font_size double, bold boolean"


def _counted(spark, df):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def _same(a, b):
    return sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


def test_phrases_are_told_as_by_the_normalised_text(spark):
    values = [
        "Sommaire", "  ŚÖMMAIRE 　", "TABLE  DES\tMATIÈRES", "sommaire.", "Table des matières et annexes", "s" + "́" * 40 + "ommaire",
        " " * 60 + "sommaire", "ｓｏｍｍａｉｒｅ", "sommaire général", "", None, "Sans objet. . .", "SANS OBJET…", "sans objet" + "." * 50, "sans objet !", "sans objets", "Ｓans objet .",
    ]
    df = spark.createDataFrame([(v,) for v in values], "text string")
    plain = text.normalize_text("text")
    rows = df.select(
        text.reads("text", "sommaire", "table des matieres").alias("a"), plain.isin("sommaire", "table des matieres").alias("b"),
        text.reads("text", "sans objet", ends=" .").alias("c"), (F.rtrim(plain, F.lit(" .")) == "sans objet").alias("d"),
    ).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and [r["c"] for r in rows] == [r["d"] for r in rows]
    assert sum(bool(r["a"]) for r in rows) >= 5 and sum(bool(r["c"]) for r in rows) >= 4


def test_single_spaces_of_every_blank(spark):
    values = [*(f"a{b}b" for b in text.BLANKS), *(f"a {b} b" for b in text.BLANKS), "a b", "a  b", " a ", "é​b", ""]
    rows = spark.createDataFrame([(v,) for v in values], "text string").select("text", text.single_spaced("text").alias("got")).collect()
    assert [r["got"] for r in rows[: 2 * len(text.BLANKS)]] == ["a b"] * (2 * len(text.BLANKS))
    assert [r["got"] for r in rows[2 * len(text.BLANKS) :]] == ["a b", "a b", " a ", "é​b", ""]


@pytest.mark.parametrize("styled", [True, False])
def test_headings_of_marked_blocks(spark, styled):
    odd = ["Sommaire", "3.1 Réseaux ..... 12", "LOT 03 - Gros œuvre", "", None, "x" * 300, "1.1  Sols durs ", "2", "4.2 - .", "B2.1 Clôture", "\x1c1.3 Murs ... 4\x1c"]
    rows = [(s, n, t, 1 + n // 4, "Heading 2" if styled and n % 2 or s == "b" else "Normal", 10.0, n % 3 == 0, "paragraph" if n % 4 else "pdf_line")
            for s in "ab" for n, t in enumerate([*odd, *(f"{k}.1 Ouvrage" if s == "a" else f"Ouvrage {k}" for k in range(1, 9)), *odd], 1)]
    plain = spark.createDataFrame(rows, BLOCK)
    counted, seen = _counted(spark, plain)
    marked = store_step(headings.marked_blocks(counted))
    contents = store_step(headings.toc_pages(marked))
    got = headings.candidate_headings(marked, contents, store_step)
    assert _same(contents, headings.toc_pages(plain)) and _same(got, headings.candidate_headings(plain)) and got.count() > 5
    assert seen.value == len(rows)


def test_perimeters_and_headings_read_stored_anchors(spark):
    rows = [("s", n, f"{1 + n // 9}.{n}", "Description des ouvrages" if n % 9 == 0 else f"Poste {n}", 1 + n % 3, 1, "paragraph", 10.0, False) for n in range(1, 41)]
    rows += [("t", n, f"{n}.1", f"Poste {n}", 2, 1, "paragraph", 10.0, False) for n in range(1, 6)]
    plain = spark.createDataFrame(rows, HEADINGS)
    lots = spark.createDataFrame([("s", "vrd", None), ("t", "cvc", None), ("u", "cvc", None)], "source_id string, family string, forced_code string")
    stored = []
    got = perimeter.select_perimeter(plain, lots, lambda df: stored.append(1) or store_step(df))
    assert len(stored) == 2
    assert all(_same(a, b) for a, b in zip(got, perimeter.select_perimeter(plain, lots)))


def test_added_lines_alone_are_stored(spark):
    documents, blocks = tables(spark, {k: SPECS[k] for k in ("decomposed", "skeleton", "controls_vrd")})
    first = extract_lines(documents, blocks)
    stored = []
    read = store_step(first.lines.where("origin = 'deterministic-v2'"))
    got = enrich.enrich(read, first.lots, lambda df: stored.append(store_step(df)) or stored[-1])
    assert _same(got, enrich.enrich(read, first.lots)) and stored
    assert all(df.where("origin = 'deterministic-v2'").isEmpty() for df in stored)


def test_lines_are_read_when_asked_for(spark, monkeypatch):
    documents, blocks = tables(spark, {k: SPECS[k] for k in ("dominant", "hierarchy")})
    calls = []
    build = lines.build_lines
    monkeypatch.setattr(lines, "build_lines", lambda *a: calls.append(1) or build(*a))
    first = extract_lines(documents, blocks)
    asked = spark.createDataFrame([("dominant", "3"), ("hierarchy", "9.9")], "source_id string, anchor_code string")
    again = retry_perimeter(documents, blocks, first, asked)
    assert {r["source_id"]: r["method"] for r in again.perimeters.collect()}["dominant"] == "llm_confirmed_anchor"
    assert len(calls) == 1  # the documents extracted again; whether they hold an item decides
    assert again.lines.where("source_id = 'hierarchy'").count() == first.lines.where("source_id = 'hierarchy'").count() > 0
    assert again.lines is again.lines and len(calls) == 2
