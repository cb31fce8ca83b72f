import pytest
from pyspark.sql import functions as F

from metreur.operators import overlay

SCHEMA = (
    "line_id string, source_id string, pos bigint, kind string, level int, code string, designation string, description string, unit string, "
    "quantity double, unit_price double, included boolean, review_status string, review_reason string, origin string, user_edited boolean"
)


def line(line_id, pos, code, designation="x", origin="deterministic-v2", edited=False, unit="U"):
    return (line_id, "s", pos, "item", 3, code, designation, "", unit, None, None, True, "validated", "", origin, edited)


def order(df):
    return [r["line_id"] for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize(
    "code, expected",
    [
        ("3.1.2", ["a", "new", "b", "c", "d"]),
        ("3.2", ["a", "b", "new", "c", "d"]),
        ("3.1.10", ["a", "b", "new", "c", "d"]),
        ("9", ["a", "b", "c", "d", "new"]),
        ("", ["a", "b", "c", "d", "new"]),
    ],
)
def test_place_of_a_new_line(spark, code, expected):
    known = spark.createDataFrame([line("a", 1, "3.1.1"), line("b", 2, "3.1.3" if code == "3.1.2" else "3.1.9"), line("c", 3, "3.10"), line("d", 4, "")], SCHEMA)
    new = spark.createDataFrame([line("new", 1, code)], SCHEMA)
    assert order(overlay.insert_by_code(known, new)) == expected


def test_first_greater_line_not_nearest_code(spark):
    # codes out of order: the first greater line in the bill counts
    known = spark.createDataFrame([line("a", 1, "5"), line("b", 2, "2"), line("c", 3, "4")], SCHEMA)
    new = spark.createDataFrame([line("new", 1, "3")], SCHEMA)
    assert order(overlay.insert_by_code(known, new)) == ["new", "a", "b", "c"]


def test_edits_and_manual_lines_survive_reprocessing(spark):
    fresh = spark.createDataFrame([line("a", 1, "3.1"), line("b", 2, "3.2"), line("c", 3, "3.4")], SCHEMA)
    stored = spark.createDataFrame(
        [line("a", 1, "3.1", "Revu", edited=True, unit="ml"), line("b", 2, "3.2", "non repris"), line("m", 3, "3.3", origin="manual"), line("gone", 4, "3.9")],
        SCHEMA,
    )
    out = {r["line_id"]: r for r in overlay.overlay_edits(fresh, stored).collect()}
    assert [k for k, _ in sorted(out.items(), key=lambda kv: kv[1]["pos"])] == ["a", "b", "m", "c"]
    assert (out["a"]["designation"], out["a"]["unit"], out["a"]["origin"]) == ("Revu", "ml", "deterministic-v2+manual-edit")
    assert out["a"]["user_edited"] and out["b"]["designation"] == "x"


def test_deleted_lines_stay_away(spark):
    fresh = spark.createDataFrame([line("a", 1, "1"), line("b", 2, "2")], SCHEMA)
    stored = spark.createDataFrame([(*line("b", 2, "2"), True)], SCHEMA + ", deleted boolean")
    assert order(overlay.overlay_edits(fresh, stored)) == ["a"]


def test_changed_fields_are_edits(spark):
    stored = spark.createDataFrame([line("a", 1, "1"), line("b", 2, "2"), line("m", 3, "3", origin="manual")], SCHEMA)
    sent = spark.createDataFrame([line("a", 1, "1", "autre"), line("b", 2, "2"), line("m", 3, "3", "autre", origin="manual")], SCHEMA)
    assert {r["line_id"]: r["user_edited"] for r in overlay.detect_edits(sent, stored).collect()} == {"a": True, "b": False, "m": False}


def test_a_line_stored_twice_stays_one(spark):
    lines = spark.createDataFrame([line("a", 1, "1.1"), line("b", 2, "1.2")], SCHEMA)
    stored = spark.createDataFrame([line("a", 1, "1.1", "old", edited=True), line("a", 1, "1.1", "young", edited=True)], SCHEMA)
    got = overlay.overlay_edits(lines, stored).collect()
    assert sorted((r.line_id, r.designation) for r in got) == [("a", "young"), ("b", "x")]
    assert overlay.detect_edits(lines, stored).count() == 2


def test_more_new_lines_at_one_place_than_half_a_million(spark):
    many = 530_000
    known = spark.createDataFrame([line("a", 1, "1"), line("b", 2, "3")], SCHEMA)
    one = spark.createDataFrame([line("", 0, "")], SCHEMA)
    made = {"pos": F.col("id"), "line_id": F.concat(F.lit("n"), "id"), "code": F.concat(F.lit("2."), (F.col("id") % 7).cast("string"))}
    new = one.drop(*made).crossJoin(spark.range(many)).withColumns(made).select(one.columns)
    got = overlay.insert_by_code(known, new).select("line_id", "pos", F.expr("try_cast(substr(code, 3) as int)").alias("part"), F.expr("try_cast(substr(line_id, 2) as int)").alias("turn")).toPandas().sort_values("pos")
    assert list(got.pos) == list(range(1, many + 3))
    assert (got.line_id.iloc[0], got.line_id.iloc[-1]) == ("a", "b")
    inside = got.iloc[1:-1]
    assert list(zip(inside.part, inside.turn)) == sorted((k % 7, k) for k in range(many))
