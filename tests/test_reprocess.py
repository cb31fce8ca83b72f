"""Reprocessing: what changed is extracted, what did not change is left alone."""


from metreur.plans import reprocess
from metreur.plans.extract import extract_lines
from specs import SPECS, tables


def shown(lines, source):
    return sorted((r["pos"], r["code"], r["designation"], r["origin"], r["user_edited"]) for r in lines.where(f"source_id = '{source}'").collect())


def test_only_changed_documents_are_extracted_and_edits_come_back(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    documents, blocks = tables(spark, {k: SPECS[k] for k in ("hierarchy", "style")})
    first = extract_lines(documents, blocks).lines.persist()
    stored = reprocess.content_facts(documents, blocks).select("source_id", "content_hash")
    edit = F.col("code") == "3.1.1"
    edited = first.withColumn("user_edited", edit | F.col("user_edited")).withColumn("designation", F.when(edit, "Terrassements repris").otherwise(F.col("designation")))
    manual = first.where(edit).withColumns({"line_id": F.lit("manual_1"), "code": F.lit("3.1.1.5"), "designation": F.lit("Ajout"), "origin": F.lit("manual")})
    previous = edited.unionByName(manual).persist()
    seen = []
    real = reprocess.extract_lines
    monkeypatch.setattr(reprocess, "extract_lines", lambda d, b: seen.append(sorted(r[0] for r in d.select("source_id").collect())) or real(d, b))

    # Nothing changed: nothing is extracted, and every line is as it was.
    same = reprocess.reprocess(documents, blocks.repartition(3), stored, previous, stamp="2024", revisions=str(tmp_path / "r"))
    assert seen == [] and same.facts.where("changed").count() == 0
    ids = sorted(r[0] for r in documents.select("source_id").collect())
    assert [shown(same.lines, s) for s in ids] == [shown(previous, s) for s in ids]
    assert spark.read.parquet(str(tmp_path / "r")).count() == previous.count()
    reprocess.merge_stored(same, str(tmp_path / "s"))
    assert not list((tmp_path / "s" / "lines").glob("bucket=*"))

    # One document changed: only that one is extracted; its edit and its manual line are back.
    one = next(s for s in ids if any(c == "3.1.1" for _, c, *_ in shown(first, s)))
    other = next(s for s in ids if s != one)
    now = blocks.withColumn("text", F.when((F.col("source_id") == one) & F.col("text").startswith("3.1.2"), "3.1.2 Béton de fondation").otherwise(F.col("text")))
    done = reprocess.reprocess(documents, now, stored, previous)
    assert seen == [[one]]
    lines = {r["code"]: r for r in done.lines.where(f"source_id = '{one}'").collect()}
    assert lines["3.1.1"]["designation"] == "Terrassements repris" and lines["3.1.2"]["designation"] == "Béton de fondation"
    assert lines["3.1.1.5"]["line_id"] == "manual_1" and lines["3.1.1"]["pos"] < lines["3.1.1.5"]["pos"] < lines["3.1.2"]["pos"]
    assert shown(done.lines, other) == shown(previous, other)
    facts = {r["source_id"]: r for r in done.facts.collect()}
    assert facts[one]["changed"] and not facts[other]["changed"]
    assert all(f["status"] in ("ready", "needs_review") and f["items"] > 0 for f in facts.values())
    assert {r["source_id"] for r in done.statistics.collect()} == set(ids)

    # A document that is gone takes its lines along.
    left = reprocess.reprocess(documents.where(F.col("source_id") == other), now.where(F.col("source_id") == other), stored, previous)
    assert {r[0] for r in left.lines.select("source_id").distinct().collect()} == {other}
