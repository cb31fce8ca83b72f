import pytest

from metreur.plans.extract import extract_lines, retry_perimeter
from specs import tables


@pytest.fixture(scope="module")
def found(spark):
    documents, blocks = tables(spark)
    result = extract_lines(documents, blocks)
    return {
        "lines": [r.asDict() for r in result.lines.orderBy("source_id", "pos").collect()],
        "lots": {r["source_id"]: r.asDict() for r in result.lots.collect()},
        "perimeters": {r["source_id"]: r.asDict() for r in result.perimeters.collect()},
        "warnings": [r.asDict() for r in result.warnings.collect()],
        "result": result,
        "inputs": (documents, blocks),
    }


def lines(found, key):
    return [line for line in found["lines"] if line["source_id"] == key]


def by(found, key, field):
    return {line[field]: line for line in lines(found, key)}


def test_hierarchy(found):
    assert found["lots"]["hierarchy"]["lot_code"] == "03"
    assert "GROS" in found["lots"]["hierarchy"]["lot_title"]
    codes = by(found, "hierarchy", "code")
    assert codes["3.1.1"]["unit"] == "m³" and codes["3.1.1"]["unit_source"] == "explicit"
    assert codes["3.1.2"]["quantity"] == 12.5
    assert codes["3.2.9"]["unit"] == "mois"
    assert codes["3.2.1"]["source_excerpt"].startswith("3.2.1 Réservations et percements. Ensemble")
    assert codes["3.1"]["kind"] == "section" and codes["3.1"]["unit"] is None


def test_style_numbering(found):
    names = by(found, "style", "designation")
    assert names["Ragréage"]["code"] == "1.1.1" and names["Ragréage"]["kind"] == "item"
    assert names["Carrelage grès cérame 45 x 45"]["code"] == "1.2.1"
    assert found["perimeters"]["style"]["method"] == "explicit_anchor"


def test_demolition(found):
    p = found["perimeters"]["demolition"]
    assert (p["method"], p["anchor_title"], p["anchor_code"]) == ("trade_work_anchor", "Installation de chantier", "3.1")
    names = by(found, "demolition", "designation")
    assert "Qualifications qualibat" not in names and "Travaux de déplombage" not in names
    expected = {
        "Installation de chantier": ("3.1", "section", None),
        "Base vie - Roulotte": ("3.1.1", "item", "Ens"),
        "Neutralisation des réseaux concessionnaires": ("3.1.2", "item", "Ens"),
        "Travaux de désamiantage": ("3.2", "section", None),
        "Colle bitumineuse sous revêtement de sol PVC": ("3.2.1", "item", "m²"),
        "Conduit en fibres-ciment": ("3.2.2", "item", "ml"),
        "Travaux de curage": ("3.3", "section", None),
        "Dépose des cloisons légères et doublages": ("3.3.1", "item", "m²"),
        "Dépose des menuiseries intérieures": ("3.3.2", "item", "U"),
        "Compte prorata": ("3.6", "item", "PM"),
    }
    for name, (code, kind, unit) in expected.items():
        assert (names[name]["code"], names[name]["kind"], names[name]["unit"]) == (code, kind, unit), name
    assert all(l["unit_source"] != "default" for l in names.values() if l["kind"] == "item")


def test_only_shallow_codes_are_sections(found):
    codes = by(found, "deep", "code")
    assert codes["3.4"]["kind"] == "section"
    assert all(codes[c]["kind"] == "item" for c in ("3.4.2", "3.4.2.1", "3.4.2.2"))


def test_typography(found):
    same = [l for l in lines(found, "apostrophe") if l["designation"].replace("’", "'") == "Vanne d'isolement DN 15"]
    assert [l["origin"] for l in same] == ["deterministic-v2"]


def test_generic_titles(found):
    names = by(found, "generic", "designation")
    assert "Généralités" not in names and "Acoustique" not in names
    assert names["Vase d'expansion"]["unit"] == "U"


def test_identity(found):
    lot = found["lots"]["conflict"]
    assert lot["lot_code"] == "03" and "Clôtures" in lot["lot_title"]
    assert lot["family"] == "espaces_verts_clotures_nettoyage"
    assert any("lot 02" in w["message"] for w in found["warnings"] if w["source_id"] == "conflict")
    assert "extérieures" in found["lots"]["agreed"]["lot_title"]
    assert not [w for w in found["warnings"] if w["source_id"] == "agreed"]


def test_richest_chapter(found):
    assert found["perimeters"]["richest"]["anchor_code"] == "2"
    names = by(found, "richest", "designation")
    assert {"Constat d'huissier", "Décapage de terre végétale"} <= set(names)
    assert "Contenu du prix" not in names


def test_guessed_unit_is_flagged(found):
    line = by(found, "guessed", "code")["3.1"]
    assert line["unit_source"] == "default" and line["review_status"] == "to_review" and "Unité" in line["review_reason"]
    # 0.98 * 0.78 + 0.62 * 0.22 - 0.08
    assert line["confidence"] == 0.82


def test_decomposition(found):
    got = lines(found, "decomposed")
    start = [l["designation"] for l in got].index("Tube cuivre")
    assert [l["designation"] for l in got][start + 1 :] == [
        "Tube cuivre diam. 12/14", "Tube cuivre diam. 14/16", "Tube cuivre diam. 16/18", "Tube cuivre diam. 20/22",
        "Tube cuivre diam. 30/32", "Calorifuge antigel épaisseur 19 mm", "Calorifuge anticondensation épaisseur 13 mm",
    ]
    child = got[start + 1]
    assert (child["origin"], child["review_status"], child["level"]) == ("rule-derived", "to_review", 4)
    assert child["quantity"] is None and "implique" in child["review_reason"]
    assert [l["pos"] for l in got] == list(range(1, len(got) + 1))


def test_decomposition_skips_written_variants(found):
    same = [l for l in lines(found, "written") if l["designation"] == "Tube cuivre diam. 12/14"]
    assert [l["origin"] for l in same] == ["deterministic-v2"]


def test_closing_lines(found):
    control = "Contrôle qualité des ouvrages d'assainissement (étanchéité RV)"
    vrd = [l["designation"] for l in lines(found, "controls_vrd")]
    assert vrd.index("Nettoyage de fin de chantier") < vrd.index(control) < vrd.index("REFECTION DE VOIRIE")
    other = [l["designation"] for l in lines(found, "controls_other")]
    assert other.index(control) < other.index("Nettoyage de fin de chantier")


def test_skeleton(found):
    added = {l["designation"]: l for l in lines(found, "skeleton") if l["origin"] == "skeleton"}
    assert "Canalisation diamètre 160 mm PVC SN8" in added
    assert all(l["review_status"] == "to_review" and l["quantity"] is None and l["source_excerpt"] == "" for l in added.values())
    general = lines(found, "skeleton_general")
    assert not [l for l in general if "Canalisation" in l["designation"]]
    assert [l["origin"] for l in general if "constat" in l["designation"].lower()] == ["deterministic-v2"]
    assert {l["designation"]: l["unit"] for l in general}["Sondage"] == "Ft"


def test_weak_perimeters(found):
    p = found["perimeters"]["dominant"]
    assert (p["method"], p["anchor_code"], p["confidence"]) == ("dominant_numbered_chapter", "2", 0.78)
    assert found["perimeters"]["nothing"]["method"] == "not_found"
    messages = [w["message"] for w in found["warnings"] if w["source_id"] == "nothing"]
    assert len(messages) == 2


def test_retry_from_a_suggested_anchor(spark, found):
    documents, blocks = found["inputs"]
    asked = spark.createDataFrame(
        [("dominant", "3"), ("nothing", "7"), ("richest", "1")], "source_id string, anchor_code string"
    )
    again = retry_perimeter(documents, blocks, found["result"], asked)
    p = {r["source_id"]: r for r in again.perimeters.collect()}
    assert (p["dominant"]["method"], p["dominant"]["anchor_code"]) == ("llm_confirmed_anchor", "3")
    assert p["nothing"]["method"] == "not_found" and p["richest"]["anchor_code"] == "2"
    assert len(p) == len(found["perimeters"])
    names = {r["designation"] for r in again.lines.where("source_id = 'dominant'").collect()}
    assert "Peinture des murs" in names and "Normes" not in names
