import difflib

import pytest
from pyspark.sql import functions as F

from metreur import catalogue
from metreur.functions import codes, similarity, text, units

TEXTS = [
    "  Béton   de propreté ", "GROS ŒUVRE", "d’étanchéité", "m² et m³", "½ … ﬁn ™", "Straße Ünï", "vase d`expansion", "",
    " NBSP ici ", "éa", "Ĳ ŉ ǆ", "Ωμέγα Ёлка",
]


def test_catalogue_sizes():
    c = catalogue
    overrides = sum(len(rules) for rules in c.FAMILY_UNIT_OVERRIDES.values())
    assert (len(c.UNIT_RULES), overrides, len(c.FAMILY_UNIT_OVERRIDES), len(c.LOT_FAMILY_RULES)) == (8, 39, 14, 17)
    assert (len(c.DECOMPOSITION_RULES), len(c.decomposition_children()), len(c.skeleton_items("vrd"))) == (40, 98, 54)
    assert (len(c.GENERIC_TITLES), len(c.SIGNATURE_STOPWORDS), len(c.UNIT_CLASSES)) == (20, 22, 24)


def test_both_normalisations_agree(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for row in df.select("t", text.normalize_text("t").alias("a"), text.normalize_text_full("t").alias("b")).collect():
        assert row["a"] == row["b"], row["t"]
    assert "gros oeuvre" in {r[0] for r in df.select(text.normalize_text("t")).collect()}


def test_every_letter_of_the_table_agrees(spark):
    letters = [chr(c) for c in range(0x80, 0x600)]
    df = spark.createDataFrame([(f"x{c}y",) for c in letters], "t string")
    wrong = df.where(text.normalize_text("t") != text.normalize_text_full("t")).collect()
    assert not wrong


UNITS = {
    "cvc": "Réseaux aérauliques=Ens; Vase d'expansion=U; Caisson d'extraction=U; Boitier de répartition=U; Soupape de sécurité=U; "
    "Désemboueur magnétique=U; Régulation=Ens; Collecteur départ retour=Ens",
    "fondations_gros_oeuvre": "Maçonnerie de remplissage=m²; Panneau de signalisation de chantier=U; Branchements provisoires de chantier=Ens; Remblaiements compactés=m³",
    "plomberie_sanitaire": "Dégorgement des canalisations=Ens; Tampons de visite=Ens; Tube acier diam 20/27=ml; Isolation acoustique=Ens",
    "serrurerie_metallerie": "Portillon métallique=U; Vantail de porte coulissante=U; Garde-corps à barreaudage=ml; Sprinkler=U",
    "couverture_etancheite_bardage": "Couvertines aluminium=ml; Descente eaux pluviales=ml; Relevés d’étanchéité=ml",
    "menuiserie_exterieure": "Imposte fixe=U; Appuis de fenêtre aluminium=ml",
    "menuiserie_interieure": "Signalétique intérieure=Ens; Placard de rangement=U",
    "cloisons_doublages_plafonds": "Parement hydrofuge=m²; Ossature métallique=m²",
    "peinture": "Préparation des supports béton=m²; Lasure sur bois=m²; Zorglub=Ens",
    "revetements_sols": "Siphon de sol=U; Sous-couche acoustique=m²",
    "espaces_verts_clotures_nettoyage": "Arbres tiges=U; Paillage des massifs=m²",
    "electricite": "Câblage basse tension=Ens",
    "vrd": "Câblage basse tension=ml; Nettoyage de la chaussée et couche d'accrochage=m²; Démolition de chaussée et trottoir existants=m²; "
    "Couche de forme en grave non traitée 0/31.5=m³; Fourniture et mise en œuvre de BBSG 0/10 pour couche de surface=m²; Tranchée 2 réseaux=ml; "
    "Fourniture et pose de caniveau à fente=ml; Fourniture et pose de regard de visite=U; Abattage et essouchage d'arbres=U; "
    "Déplacement de mât d'éclairage=U; Décapage de terre végétale et évacuation hors site=m³; Raccordement sur le réseau existant=Ft; Zorglub=Ft",
}


def test_units_by_family(spark):
    rows = [(family, *case.strip().split("=")) for family, cases in UNITS.items() for case in cases.split(";")]
    df = spark.createDataFrame(rows, "family string, title string, expected string").withColumn("key", text.normalize_text("title"))
    got = df.withColumn("u", units.infer_unit("title", F.lit(""), "family", "key")).where("u.unit <> expected").collect()
    assert not got


@pytest.mark.parametrize(
    "title, context, unit, quantity",
    [
        ("Béton", "Unité de règlement : m³.", "m³", None),
        ("Béton", "unité = m3x", None, None),
        ("Location", "Unité : mois.", "mois", None),
        ("Dalle", "quantité 12,5 m²", None, 12.5),
        ("Dalle", "Qté totale : 7", None, 7.0),
        ("Dalle 15 mm", "épaisseur 12 mm", None, None),
        ("U.O. : ens", "", "Ens", None),
    ],
)
def test_stated_unit_and_quantity(spark, title, context, unit, quantity):
    row = spark.range(1).select(
        units.explicit_unit(F.lit(title), F.lit(context)).alias("u"), units.explicit_quantity(F.lit(title), F.lit(context)).alias("q")
    ).first()
    assert (row["u"], row["q"]) == (unit, quantity)


def test_lot_order_and_codes(spark):
    raw = ["10", "2", "A", "3.10", "3.9", "", "3", "b.1"]
    df = spark.createDataFrame([(c,) for c in raw], "c string")
    assert [r["c"] for r in df.orderBy(codes.natural_code_key("c")).collect()] == ["", "2", "3", "3.9", "3.10", "10", "A", "b.1"]
    padded = {r[0]: r[1] for r in df.select("c", codes.pad_lot_code("c")).collect()}
    assert padded["2"] == "02" and padded["10"] == "10" and padded["A"] == "A"


def test_line_similarity(spark):
    a, b = "Dépose de clôture existante", "Dépose des clôtures"
    score = spark.range(1).select(similarity.line_similarity(F.lit(a), F.lit(b))).first()[0]
    na, nb = "depose de cloture existante", "depose des clotures"
    assert score == pytest.approx((difflib.SequenceMatcher(None, na, nb).ratio() + 1 / 4) / 2)


def test_answers_without_an_object_are_null(spark):
    answers = ["```json\n{\"a\": 3}\n```", "bla {\"a\": 4} bla", "rien", "}{", "{cassé"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(answers)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.extract_json_object("t", "a int")["a"]).collect()]
    assert got == [3, 4, None, None, None]


def test_tokens_need_no_interpreter(spark):
    rows = spark.createDataFrame([("Pose d'un x tube 1 a22 é",), ("a b c",), ("",), (None,)], "t string")
    found = rows.select(text.signature("t").alias("s"))
    assert [r["s"] for r in found.collect()] == [["a22", "pose", "tube", "un"] if "un" not in catalogue.SIGNATURE_STOPWORDS else ["a22", "pose", "tube"], [], [], None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(length" not in plan.lower() and "array_sort" not in plan.lower()


def test_plain_searches_in_front_of_patterns(spark):
    assert units.needed_runs(r"tubes?\s+(?:en\s+)?cuivre") == ("cuivre",)
    assert units.needed_runs(r"\b(?:portes?|fenetres? hautes|x)\b") == () == units.needed_runs(r"[ab]c*")
    patterns = [p for p, _ in catalogue.DECOMPOSITION_RULES] + [p for _, _, p in catalogue.UNIT_RULES + catalogue.LOT_FAMILY_RULES]
    patterns += [p for rules in catalogue.FAMILY_UNIT_OVERRIDES.values() for _, _, p in rules]
    lines_ = [d for _, d, _ in catalogue.decomposition_children() + catalogue.skeleton_items("vrd")]
    lines_ += ["Tubes en cuivre", "vanne d'arrêt", "VOIRIE et réseaux divers", "mètres carrés", "cuivre", "regard 60 x 60", *TEXTS]
    keyed = spark.createDataFrame([(t,) for t in lines_], "t string").select(text.normalize_text("t").alias("n"))
    both = keyed.select([(units.holds(F.col("n"), p) == F.col("n").rlike("(?i)" + p)).alias(f"c{k}") for k, p in enumerate(patterns)])
    assert all(all(row) for row in both.collect())
    assert sum(bool(units.needed_runs(p)) for p in patterns) > 60


def test_stated_units_keep_their_edges(spark):
    given = [("Unité : m²", "m²"), ("UNITÉ DE MESURE = ml", "ml"), ("pluunité : ml", None), ("u.o. : forfait", "Ft"), ("unité m²", None), ("2unité : ml", None)]
    shown = spark.createDataFrame(given, "t string, u string").select("t", "u", units.explicit_unit("t", F.lit("")).alias("got"), units.explicit_quantity("t", F.lit(" nombre : 3")).alias("q"))
    for row in shown.collect():
        assert (row.got is None) == (row.u is None), row
        assert row.q == 3.0
