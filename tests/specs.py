"""Small specifications, written as (heading level or style, text)."""

BLOCK = (
    "source_id string, pos int, text string, page int, style string, font_size double, bold boolean, source_kind string"
)

CONTROLS = [
    (2, "3.4 OUVRAGES D'ASSAINISSEMENT"),
    (3, "3.4.1 Ouvrages d'assainissement"),
    ("", "Ensemble des canalisations et regards, au forfait."),
    (3, "3.4.2 Nettoyage de fin de chantier"),
    ("", "Ensemble, forfait."),
    (2, "3.5 REFECTION DE VOIRIE"),
    (3, "3.5.1 Réglage de fond de forme"),
    ("", "Surface en m²."),
]

SPECS = {
    "hierarchy": ("CCTP LOT 03.docx", [
        (1, "LOT 03 — GROS ŒUVRE"), (2, "3.1 INFRASTRUCTURES"), (3, "3.1.1 Terrassements"),
        ("", "Terrassements en pleine masse, évacuation comprise. Unité de règlement : m³."),
        (3, "3.1.2 Béton de propreté"), ("", "Béton dosé suivant prescriptions, quantité 12,5 m²."),
        (2, "3.2 OUVRAGES DIVERS"), (3, "3.2.1 Réservations et percements"),
        ("", "Ensemble des sujétions, au forfait."), (3, "3.2.9 Location mensuelle"),
        ("", "Installation maintenue pendant le chantier. Unité : mois.")]),
    "style": ("CCTP LOT 20 CARRELAGE.docx", [
        (1, "LOT 20 — CARRELAGE"), (1, "Description des ouvrages"), (2, "Travaux préparatoires"), (3, "Ragréage"),
        ("", "Fourniture et mise en œuvre d'un ragréage."), (2, "Carrelage"), (3, "Carrelage grès cérame 45 x 45"),
        ("", "Fourniture et pose d'un carrelage grès cérame.")]),
    "demolition": ("CCTP LOT 01 DEMOLITION CURAGE DESAMIANTAGE.docx", [
        ("", "CCTP Lot n°01 - Démolition - Curage - Désamiantage"), (2, "Qualifications qualibat"),
        ("", "Prescriptions administratives."), (2, "Installation de chantier"), ("", "Base vie - Roulotte"),
        ("", "Roulotte autonome avec vestiaire et sanitaires."), ("", "Neutralisation des réseaux concessionnaires"),
        ("", "Neutralisation de l'eau, du gaz et de l'électricité."), (2, "Travaux de désamiantage"),
        ("", "Retrait suivant le diagnostic amiante."), ("", "Localisation :"),
        ("Default", "Colle bitumineuse sous revêtement de sol PVC"), ("Default", "Conduit en fibres-ciment"),
        (2, "Travaux de déplombage"), ("", "Sans Objet."), (2, "Travaux de curage"),
        ("", "Dépose des cloisons légères et doublages"), ("", "Nature des prestations"),
        ("", "Dépose complète et évacuation."), ("", "Dépose des menuiseries intérieures"),
        ("", "Nature des prestations"), ("", "Dépose complète et évacuation."), (2, "Travaux de déconstruction"),
        ("", "Démolitions du bâtiment complet"), ("", "Nature des prestations"), ("", "Déconstruction et évacuation."),
        (2, "Nettoyage de fin de chantier"), ("", "Nettoyage des voiries et abords."), (2, "Compte prorata"),
        ("", "Participation de 1,5 %.")]),
    "deep": ("CCTP LOT 01 VRD.docx", [
        (1, "LOT 01 — VRD"), (2, "3.4 OUVRAGES D'ASSAINISSEMENT"), (3, "3.4.2 Fourniture et pose de canalisation"),
        (4, "3.4.2.1 Tranchée pour pose de canalisation"), ("", "Section courante, quantité en ml."),
        (4, "3.4.2.2 Remblai de tranchée"), ("", "Remblai compacté, quantité en m³.")]),
    "apostrophe": ("CCTP LOT 16 PLOMBERIE.docx", [
        (1, "LOT 16 — PLOMBERIE"), (1, "Description des ouvrages"), (2, "Vanne d’isolement"),
        ("", "Vanne à boisseau sphérique."), (2, "Vanne d’isolement DN 15"), ("", "Section courante DN 15, quantité 4 U.")]),
    "generic": ("CCTP LOT 12 CVC.docx", [
        (1, "LOT 12 — CVC"), (1, "2 DESCRIPTION DES OUVRAGES"), (2, "2.1 Généralités"), ("", "Texte."),
        (2, "2.2 Acoustique"), ("", "Texte."), (2, "2.3 Vase d'expansion"), ("", "Fourniture et pose.")]),
    "conflict": ("CCTP LOT 03 - Clôtures et portails.docx", [
        ("", "CCTP Lot n°02 – Voirie et Réseaux Divers"), (1, "3 Description des ouvrages"),
        (2, "3.1 Clôture panneaux à plis"), ("", "Nature des prestations : fourniture et pose.")]),
    "agreed": ("CCTP LOT 05 - Menuiseries.docx", [
        ("", "CCTP Lot n°05 – Menuiseries extérieures alu"), (1, "3 Description des ouvrages"),
        (2, "3.1 Châssis fixe"), ("", "Fourniture et pose.")]),
    "richest": ("CCTP LOT 01 - VRD.docx", [
        (1, "1 CONSISTANCE ET DESCRIPTION DES TRAVAUX"), (2, "1.1 Objet"), ("", "Le présent CCTP définit les travaux."),
        (2, "1.2 Contenu du prix"), ("", "Les prix comprennent toutes sujétions."),
        (1, "2 DESCRIPTION ET LOCALISATION DES OUVRAGES"), (2, "2.1 Travaux généraux"), (3, "2.1.1 Constat d'huissier"),
        ("", "Nature des prestations : constat avant travaux."), (3, "2.1.2 Sondage"),
        ("", "Nature des prestations : sondages de sol."), (2, "2.2 Terrassements"),
        (3, "2.2.1 Décapage de terre végétale"), ("", "Nature des prestations : décapage et évacuation.")]),
    "guessed": ("CCTP LOT 20 - Ascenseurs.docx", [
        (1, "LOT 20 — Ascenseurs"), (1, "3 Description des ouvrages"), (2, "3.1 Zorglub télescopique"),
        ("", "Fourniture et pose selon plans.")]),
    "decomposed": ("CCTP LOT 15 CVC.docx", [
        (1, "LOT 15 — CVC"), (2, "15.1 DESCRIPTION DES OUVRAGES"), (3, "15.1.1 Tube cuivre"),
        ("", "Fourniture et pose de tube cuivre pour l'ensemble des réseaux.")]),
    "written": ("CCTP LOT 15 CVC.docx", [
        (1, "LOT 15 — CVC"), (2, "15.1 DESCRIPTION DES OUVRAGES"), (3, "15.1.1 Tube cuivre"),
        ("", "Fourniture et pose de tube cuivre."), (3, "15.1.2 Tube cuivre diam. 12/14"),
        ("", "Section courante en diamètre 12/14, quantité 30 ml.")]),
    "controls_vrd": ("CCTP LOT 01 VRD.docx", [(1, "LOT 01 — VRD"), *CONTROLS]),
    "controls_other": ("CCTP LOT 03 GROS OEUVRE.docx", [(1, "LOT 03 — GROS ŒUVRE"), *CONTROLS]),
    "skeleton": ("CCTP LOT 01 - VRD.docx", [
        (1, "LOT 01 — Voirie et Réseaux Divers"), (1, "3 Description des ouvrages"),
        (2, "3.1 Ouvrages d'assainissement"), (3, "3.1.1 Prestation décrite au CCTP"),
        ("", "Nature des prestations : exécution complète.")]),
    "skeleton_general": ("CCTP LOT 01 - VRD.docx", [
        (1, "LOT 01 — Voirie et Réseaux Divers"), (1, "3 Description des ouvrages"), (2, "3.1 Travaux généraux"),
        (3, "3.1.1 Constat d'huissier"), ("", "Nature des prestations : constat avant travaux.")]),
    "dominant": ("CCTP LOT 09 - Peinture.docx", [
        (1, "LOT 09 — Peinture"), (1, "2 Prescriptions"), (2, "2.1 Normes"), (2, "2.2 Documents"), (2, "2.3 Essais"),
        (1, "3 Travaux"), (2, "3.1 Peinture des murs"), ("", "Deux couches."), (2, "3.2 Lasure sur bois")]),
    "nothing": ("CCTP LOT 10 - Divers.docx", [("", "Texte sans titre."), ("", "Autre texte.")]),
}


def tables(spark, specs=SPECS):
    """(documents, blocks) of the specifications."""
    documents = [(key, name, name[name.rfind("."):], 0) for key, (name, _) in specs.items()]
    blocks = []
    for key, (_, parts) in specs.items():
        for pos, (style, text) in enumerate(parts, 1):
            name = f"Heading {style}" if isinstance(style, int) else style or "Normal"
            blocks.append((key, pos, text, None, name, 0.0, False, "paragraph"))
    return (
        spark.createDataFrame(documents, "source_id string, original_name string, extension string, page_count int"),
        spark.createDataFrame(blocks, BLOCK),
    )
