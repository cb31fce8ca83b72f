"""Rule catalogues.

Everything below the marker is a table of fixed values: spellings, patterns,
confidences and their order decide the result, so they are stated as they are.
Rules are tried top to bottom and the first that matches wins. Patterns run on
text normalised by :func:`metreur.functions.text.normalize_text`.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values

# (unit, confidence, pattern) for any trade
UNIT_RULES = [
    ("Ens", 0.85, r"\bisolation acoustique\b"),
    ("U", 0.87,
     r"\b(?:unites?|porte|fenetre|chassis|trappe|regard|caniveau|appareil|equipement|robinet|lavabo|"
     r"vasque|wc|urinoir|evier|radiateur|ventilo\w*|ventilateurs?|extracteur|escalier|echelle|store|"
     r"luminaire|tableau|coffret|prise|interrupteur|detecteur|extincteur|pompe|siphons?|douche|miroir|"
     r"seche[\s-]mains?|barre d'appui|borne|sprinklers?|gaches?|serrures?|telecommandes?|compteurs?|"
     r"manometres?|bouches?|vannes?|filtres?|thermometres?|convecteurs?|inters?|baes|disconnecteurs?|"
     r"descentes?|boutons?[\s-]?poussoirs?|clapets?|purgeurs?|sondes?|extraction des locaux humides)\b"),
    ("ml", 0.88, r"\bisolation\b.*\b(?:canalisations?|evacuations?|tuyaux?)\b"),
    ("ml", 0.86,
     r"\b(?:tuyauteries?|fourreaux?|plinthes?|bordure|gouttiere|profile|main[\s-]courante|garde-corps|"
     r"releves? d'etancheite|couronnements? d'acrotere|bavettes?|linteaux?|grilles? anti-rongeurs?|"
     r"encadrements? de baies?|habillages?|baguettes? aluminium|barres? de seuils?|nez de marche|"
     r"seuils?|chemins? de cables?)\b"),
    ("m²", 0.88,
     r"\b(?:peinture|enduit|revetement|carrelage|faience|sol souple|etancheite|isolation|doublage|"
     r"cloison|plafond|bardage|toiture|membrane|chape|ragreage|moquette|bac acier|pare-vapeur|"
     r"reglage de fond de forme|geotextiles?|platres?|peau (?:interieure|exterieure)|engazonnement)\b"),
    ("m³", 0.82,
     r"\b(?:terrassements?|deblais?|remblais?(?:ements?)?|betons?|grave|terre vegetale|fouilles?|"
     r"evacuation des terres|longrines?)\b"),
    ("kg", 0.78, r"\b(?:acier|armature|charpente metallique)\b"),
    ("Ens", 0.82,
     r"\b(?:installation|preparation|etudes?|plans?|dossier|essais?|controle|mise en service|nettoyage|"
     r"depose|demolition|signalisation|implantation|repliement|protection|reservations?|"
     r"constat des lieux|accessoires|ouvrages complementaires|recolement|base[\s-]vie|aire de chantier|"
     r"bennes?|recettage|formations?|branchements? provisoires?|calfeutrements?|percements?|"
     r"evacuations?|raccordements?|calorifuges?|etiquetage|reperage|sterilisation du reseau|"
     r"constat d'huissier|gestion des dechets|registres? de reglage|contrat d'entretien|"
     r"coupe[\s-]feu|silencieux|pieges? a son)\b"),
]

# the same, tried first when the trade family of the lot is known
FAMILY_UNIT_OVERRIDES = {
    "vrd": [
        ("m²", 0.8, r"\bnoues?\b"),
        ("m³", 0.9, r"couches? de forme"),
        ("U", 0.85, r"\bfosses?\s+d'?\s*arbres?"),
        ("m³", 0.85,
         r"gestion des terres|\bisdnd\b|\bisdi\b|decapage|bassin.{0,30}(?:tamponnement|caissons)|tamponnement"),
        ("U", 0.85,
         r"mise a niveau|abat+ages?|essouchages?|\bmats?\b|massifs?\b|potence|separateurs? a hydrocarbures|"
         r"reprises? de sorties?|sorties? en pied|en pied de batiment|descentes? d'?\s*eau\s+pluviale|"
         r"regards?\b|\bfontes?\b|\bb125\b|\bc250\b|\bd400\b"),
        ("ml", 0.9,
         r"\b(?:canalisations?|cables?|cablage|caniveaux?|tranchees?|fourreaux?|gaines?|voliges?)\b|"
         r"busages?|remodelages?|\bdn\s?\d+\b"),
        ("m²", 0.88,
         r"\bchaussees?\b|\btrottoirs?\b|\bvoiries?\b|\bplateformes?\b|"
         r"couches? d'?\s*(?:assise|accrochage|cure)|couches? de surface|\bbbsg\b|\bbbme\b|\bbb\s*0/|"
         r"enrobes?\b|grave[\s-]bitume|bandes? sterile"),
        ("Ens", 0.85, r"\bcompactages?\b|\betancheites?\b"),
    ],
    "electricite": [("Ens", 0.75, r"\b(?:cablage|reseau)\b")],
    "cvc": [
        ("Ens", 0.7, r"\b(?:reseau|cablage|canalisations?|cables?)\b"),
        ("Ens", 0.78, r"reseaux?\s+aerauliques?"),
        ("U", 0.85,
         r"vases?\s+d['’]?\s*expansion|\bcaissons?\b|\bboitiers?\b|\bsoupapes?\b|\btamis\b|desemboueurs?"),
        ("Ens", 0.72, r"\bregulation\b|\bcollecteurs?\b"),
    ],
    "desamiantage_demolition": [
        ("m²", 0.9,
         r"colle bitumineuse|dalles? de sol|plaques? (?:en )?fibres?[ -]?ciment|cloisons?|doublages?|"
         r"revetements? (?:de sol|muraux?)|faux plafonds?"),
        ("ml", 0.88, r"conduits?.*fibres?[ -]?ciment"),
        ("U", 0.86, r"menuiseries? (?:interieures?|exterieures?)"),
        ("m³", 0.84, r"massifs?|socles?|recharges? beton|dechets? et gravats"),
        ("PM", 0.95, r"compte prorata"),
        ("Ens", 0.78,
         r"\b(?:reseaux?|cables?|cablage|canalisations?|base vie|neutralisation|metallerie|serrurerie|"
         r"elements? (?:en toiture|en facade)|batiment complet)\b"),
    ],
    "fondations_gros_oeuvre": [
        ("m²", 0.85, r"\bmaconnerie\b"),
        ("U", 0.78, r"\bpanneau\w*\b"),
        ("Ens", 0.8, r"\bbranchements?\b|\bconstat\b"),
    ],
    "plomberie_sanitaire": [
        ("Ens", 0.88, r"\bdegorgements?\b|\btampons?\b|\bcondensation\b"),
        ("ml", 0.85, r"\bdiam\b"),
    ],
    "serrurerie_metallerie": [("U", 0.85, r"\bvantaux\b|\bvantail\b|\bportillons?\b|\bbutoirs?\b")],
    "couverture_etancheite_bardage": [
        ("ml", 0.85, r"\bcouvertines?\b"),
        ("ml", 0.78, r"\bdescentes?\b"),
    ],
    "menuiserie_exterieure": [("U", 0.8, r"\bimpostes?\b"), ("ml", 0.72, r"\bappuis\b")],
    "menuiserie_interieure": [("Ens", 0.8, r"\bsignaletique\b"), ("U", 0.72, r"\bplacards?\b")],
    "cloisons_doublages_plafonds": [
        ("m²", 0.85, r"\bhydrofuges?\b|\bparements?\b|\bossatures?\b|\bdalles?\b"),
        ("U", 0.72, r"\bbloc\w*\b"),
    ],
    "peinture": [
        ("m²", 0.78, r"\bbetons?\b"),
        ("m²", 0.82, r"\bsupports?\b|\bpreparations?\b|\bparois\b|\blasures?\b|\bbatis\b"),
    ],
    "revetements_sols": [("U", 0.8, r"\bsiphons?\b"), ("m²", 0.78, r"\bacoustique\b")],
    "espaces_verts_clotures_nettoyage": [("U", 0.75, r"\barbres?\b"), ("m²", 0.75, r"\bpaillages?\b")],
}

DEFAULT_UNIT = ("Ens", 0.62)
EXPLICIT_UNIT_CONFIDENCE = 0.99

# (family, rank in the usual order of trades, pattern)
LOT_FAMILY_RULES = [
    ("cvc", 12,
     r"(?:\bcvc\b|chauffage|ventilation|climatisation).{0,40}desenfumage|"
     r"desenfumage.{0,40}(?:\bcvc\b|chauffage|ventilation|climatisation)"),
    ("desamiantage_demolition", 0, r"desamiant\w*|demoli\w*|deplomb\w*|depollution|curage"),
    ("vrd", 1, r"\bvrd\b|voirie|reseaux? divers"),
    ("fondations_gros_oeuvre", 2, r"gros[\s-]oeuvre|fondation|maconnerie|dallage|\bgo\b"),
    ("charpente", 3, r"charpente"),
    ("couverture_etancheite_bardage", 4, r"couverture|etanche\w*|bardage|zinguerie|desenfumage"),
    ("menuiserie_exterieure", 5, r"menuiserie\w*\s+ext\w*|facade|mur[\s-]rideau"),
    ("serrurerie_metallerie", 6, r"serrurerie|metallerie|portes? industrielles?|portes? sectionnelles?"),
    ("cloisons_doublages_plafonds", 7, r"cloison|doublage|faux[\s-]plafond|platrerie"),
    ("menuiserie_interieure", 8, r"menuiserie\w*\s+int\w*|menuiserie\w*\s+bois"),
    ("revetements_sols", 9,
     r"revetement\w*\s+de\s+sols?|carrelage|faience|chape|sol souple|parquet|resine"),
    ("peinture", 10, r"peinture"),
    ("electricite", 11, r"electricit\w*|courants? (?:forts?|faibles?)|\bcfo\b|\bcfa\b|photovoltaique"),
    ("cvc", 12, r"\bcvc\b|chauffage|ventilation|climatisation"),
    ("plomberie_sanitaire", 13, r"plomberie|sanitaire|sprinkler|\bria\b|detection gaz"),
    ("ascenseur", 14, r"ascenseur|monte[\s-]charges?|plateformes? elevatrices?"),
    ("espaces_verts_clotures_nettoyage", 15, r"espaces? verts?|cloture|portail|nettoyage"),
]
DEFAULT_FAMILY = ("autre", 99)

# how a lump sum is written, where it is not "Ens"
FAMILY_LUMP_SUM = {"vrd": "Ft"}

# normalised headings that introduce prose and are never priced
GENERIC_TITLES = [
    "description", "prescription", "prescriptions", "generalites", "objet", "consistance des travaux",
    "description des ouvrages", "description des travaux", "descriptif des ouvrages", "principe",
    "conditions exterieures", "conditions interieures", "acoustique", "certification eurovent",
    "certification passive house", "niveaux sonores", "charges internes", "bilan estime",
    "limites de prestations", "efficacite energetique des moteurs",
]
GENERIC_PATTERN = (
    r"^(?:nature des prestations|localisation|apercu(?: de l['’]ouvrage)?|mode d['’]execution|"
    r"mise en oeuvre|caracteristiques(?: techniques)?|performances?|documents? de reference|"
    r"normes? et reglementations?|specifications? generales(?: de la technologie retenue)?|"
    r"interface avec le lot .+)$"
)

# (trigger pattern, [(designation, unit), ...]) in order
DECOMPOSITION_RULES = [
    (r"tubes?\s+(?:en\s+)?cuivre", [
        ("Tube cuivre diam. 12/14", "ml"), ("Tube cuivre diam. 14/16", "ml"),
        ("Tube cuivre diam. 16/18", "ml"), ("Tube cuivre diam. 20/22", "ml"),
        ("Tube cuivre diam. 30/32", "ml"), ("Calorifuge antigel épaisseur 19 mm", "Ens"),
        ("Calorifuge anticondensation épaisseur 13 mm", "Ens")]),
    (r"tubes?\s+(?:en\s+)?pvc", [
        ("Tube PVC diam. 40", "ml"), ("Tube PVC diam. 50", "ml"), ("Tube PVC diam. 63", "ml"),
        ("Tube PVC diam. 75", "ml"), ("Tube PVC diam. 100", "ml"), ("Tube PVC diam. 110", "ml"),
        ("Tube PVC diam. 125", "ml")]),
    (r"tubes?\s+(?:en\s+)?per\b", [
        ("Tube PER Ø12", "ml"), ("Tube PER Ø16", "ml"), ("Tube PER Ø20", "ml")]),
    (r"vannes?\s+d['’]?\s*(?:isolement|arret)", [
        ("Vanne d'isolement DN 15", "U"), ("Vanne d'isolement DN 20", "U"),
        ("Vanne d'isolement DN 25", "U"), ("Vanne d'équilibrage DN", "U")]),
    (r"fourreaux?\s+rouges?", [
        ("Fourreau rouge DN63", "ml"), ("Fourreau rouge DN90", "ml"), ("Fourreau rouge DN160", "ml"),
        ("Chambre de tirage — taille 40 x 40 cm avec fonte B125", "U"),
        ("Chambre de tirage — taille 80 x 80 cm avec fonte C250", "U"),
        ("Chambre de tirage — taille 80 x 80 cm avec fonte D400", "U")]),
    (r"reseaux?\s+divers", [
        ("Tranchée 1 réseau", "ml"), ("Tranchée 2 réseaux", "ml"), ("Tranchée 3 réseaux", "ml"),
        ("Tranchée 4 réseaux", "ml"), ("Tranchée 5 réseaux", "ml")]),
    (r"travaux\s+generaux", [
        ("Implantation, piquetage, dossier EXE, dossier DOE", "Ens"),
        ("Installation de chantier VRD : base vie, entretien, barriérage, balisage et signalisation", "Ens")]),
    (r"ouvrages?\s+d['’]?\s*assainissement|collecteurs?\s+d['’]?\s*assainissement|\bremblais?\b", [
        ("Regard de visite diamètre 1000 avec fonte D400", "U"),
        ("Regard de branchement 60x60 avec fonte B125", "U"),
        ("Regard de branchement 80x80 avec fonte B125", "U"),
        ("Contrôle qualité des ouvrages d'assainissement (étanchéité RV)", "Ens"),
        ("Contrôle qualité des collecteurs d'assainissement (curage, étanchéité, ITV)", "Ens")]),
    (r"controle\s+qualite.*(?:compactage|couche\s+de\s+forme)", [
        ("Contrôle qualité des ouvrages d'assainissement (étanchéité RV)", "Ens"),
        ("Contrôle qualité des collecteurs d'assainissement (curage, étanchéité, ITV)", "Ens"),
        ("Contrôle qualité des enrobés : contrôle de densité, carottage pour contrôle des épaisseurs", "Ens")]),
    (r"\bvoirie\b", [
        ("Géotextile classe V", "m²"), ("Réglage de fond de forme", "m²"),
        ("Couche de forme en grave non traitée 0/31.5", "m³"),
        ("Fourniture et mise en œuvre de BBSG 0/10 pour couche de surface", "m²")]),
    (r"cloison\s+\d{2,3}[/.]\d{2,3}", [
        ("Plus-value plaque hydrofuge", "m²"), ("Doublage 1/2 stil isolant", "m²")]),
    (r"encadrements?\s+de\s+baies?", [
        ("Bavette basse des ouvertures", "ml"), ("Linteau de baies", "ml")]),
    (r"support\s+d['’]?\s*etancheite", [
        ("Bac acier sur charpente", "m²"), ("Ouvrages complémentaires : points spécifiques", "Ens")]),
    (r"\bappareillage\b", [
        ("Interrupteur va-et-vient couleur blanc", "U"), ("Détecteur de présence/mouvement", "U"),
        ("Prise 2P+T standard encastrée couleur blanc", "U")]),
    (r"ossatures?\s+de\s+facade", [
        ("Encadrements de menuiseries", "kg"), ("Lisses support de bardage", "kg"),
        ("Chevêtres techniques", "Ens")]),
    (r"ossatures?\s+de\s+toiture|\bpannes\b", [("Chevêtres EP", "U"), ("Chevêtres de lanternaux", "U")]),
    (r"nettoyage\s+de\s+la\s+chaussee", [
        ("Marquage normalisé place PMR", "U"), ("Marquage bande STOP", "m²"),
        ("F&P de panneau AB4 « STOP »", "U")]),
    (r"lecteur\s+vigik", [("Badge Vigik", "U"), ("BP de sortie NO/NF lumineux loi Handicap", "U")]),
    (r"eclairage\s+de\s+securite|\bbaes\b", [
        ("BAES étanche", "U"), ("Dépose / repose des BAES existants", "Ens")]),
    (r"prise\s+rj\s?45", [
        ("Test et recette de l'installation, cuivre et optique", "Ens"), ("Recettage", "Ens")]),
    (r"beton\s+de\s+proprete", [("Gros béton de rattrapage", "m³")]),
    (r"trappes?\s+de\s+visite", [("Protection coupe-feu", "Ens")]),
    (r"bennes?\s+de\s+chantier", [
        ("Moyens de levage et accès chantier", "Ens"), ("Aménagement de l'aire de chantier", "Ens")]),
    (r"sterilisation\s+du\s+reseau", [("Repérage étiquetage", "Ens"), ("Analyse d'eau", "Ens")]),
    (r"chambres?\s+de\s+tirage", [
        ("Chambre de tirage — type L1T", "U"),
        ("Chambre de tirage — taille 40 x 40 cm avec fonte B125", "U")]),
    (r"\bfilets\b", [("Garde-corps", "ml"), ("Accès toiture phase chantier", "Ens")]),
    (r"reprise\s+des\s+sorties\s+en\s+pied\s+de\s+batiment", [
        ("Raccordement sur le réseau existant", "Ens"), ("Station de refoulement EU 4 l/s", "Ens")]),
    (r"releves?\s+d['’]?\s*etancheite", [("Thermosoudage des supports sur la membrane", "ml")]),
    (r"\bragreage\b", [("Système d'étanchéité faïence murale", "m²")]),
    (r"espaces?\s+verts?", [("Préparations avant plantations et engazonnement", "m²")]),
    (r"\bonduleurs?\b", [
        ("Câbles alternatif RO2V des onduleurs à l'armoire AC", "Ens"),
        ("Chemins de câbles en dalle en acier galvanisé à chaud", "ml")]),
    (r"\bthermometres?\b", [("Clapet anti-retour DN", "U"), ("Filtre DN", "U")]),
    (r"robinet\s+de\s+purge", [("Purgeur d'air automatique isolable", "U")]),
    (r"vanne\s+de\s+regulation", [
        ("Boîtier de commande et de régulation", "U"),
        ("Pompe de relevage des condensats montée d'usine", "U"), ("Liaison et raccordement", "Ens")]),
    (r"clapet\s+antipollution", [("Anti-bélier", "Ens")]),
    (r"pieges?\s+a\s+son", [("Bouche de soufflage débit > 200 m3/h", "U")]),
    (r"branchement\s+du\s+batiment", [("Vanne DN", "U")]),
    (r"calorifugeage\s+du\s+reseau\s+eau\s+froide", [("Calorifuge anticondensation épaisseur 13 mm", "Ens")]),
    (r"garantie\s+de\s+reprise", [("Contrat d'entretien", "Ens")]),
    (r"\bregulation\b", [("Purgeur d'air", "Ens")]),
]
# derived lines that close their section in these families
CLOSING_CHILD_PATTERN = r"^controle\s+qualit"
CLOSING_CHILD_FAMILIES = ["vrd"]

# family -> [(chapter, [(designation, unit), ...]), ...]
LOT_SKELETONS = {
    "vrd": [
        ("Travaux généraux", [
            ("Installation de chantier propre au VRD : base vie & entretien, barriérage, balisage et signalisation",
             "Ens"),
            ("Implantation piquetage, dossier EXE, dossier DOE", "Ens"),
            ("Constat d'huissier", "Ens"), ("Sondage", "Ens")]),
        ("Travaux préparatoires", [
            ("Dépose de clôture existante", "Ens"), ("Dépose de bordure", "ml")]),
        ("Terrassements", [
            ("Décapage de terre végétale et évacuation hors site", "m³"),
            ("Décapage de terre végétale et mise en stock sur site", "m³"),
            ("Reprise de terre végétale et mise en œuvre sur espaces verts", "m³"),
            ("Terrassement en déblai évacué hors site", "m³"), ("Plateforme bâtiment", "m²")]),
        ("Ouvrages d'assainissement", [
            ("Canalisation diamètre 160 mm PVC SN8", "ml"), ("Canalisation diamètre 200 mm PVC SN8", "ml"),
            ("Canalisation diamètre 250 mm PVC SN8", "ml"), ("Canalisation diamètre 315 mm PVC SN8", "ml"),
            ("Regard de branchement 60x60 avec fonte B125", "U"),
            ("Reprise de descente d'eau pluviale", "U"), ("Reprise des sorties en pied de bâtiment", "U"),
            ("Raccordement à l'existant", "Ens"), ("Contrôle qualité du niveau de compactage", "Ens"),
            ("Contrôle qualité des collecteurs d'assainissement (curage, étanchéité, ITV)", "Ens"),
            ("Contrôle qualité des ouvrages d'assainissement (étanchéité RV)", "Ens")]),
        ("Voirie", [
            ("Réglage de fond de forme", "m²"), ("Géotextile classe V", "m²"),
            ("Couche de forme en grave non traitée 0/31.5", "m³"),
            ("Fourniture et mise en œuvre de BBSG 0/10 pour couche de surface", "m²"),
            ("Nettoyage de la chaussée et réalisation d'une couche d'accrochage", "m²"),
            ("Bordure béton type T1 (y compris partie adoucie)", "ml"), ("Bordure béton type CS1", "ml"),
            ("Mise à niveau des ouvrages existants", "U"), ("Marquage normalisé place PMR", "U"),
            ("Marquage normalisé place électrique", "U"), ("Marquage bande STOP", "m²"),
            ("Marquage zébra", "m²"), ("Flèche directionnelle", "U"), ("F&P de panneau AB4 « STOP »", "Ens"),
            ("F&P de panneau véhicule électrique + 2 panonceaux M3a1", "Ens"),
            ("Contrôle qualité de la couche de forme", "Ens"),
            ("Contrôle qualité des enrobés : contrôle de densité, carottage pour contrôle des épaisseurs", "Ens")]),
        ("Réseaux divers", [
            ("Tranchée 1 réseau", "ml"), ("Tranchée 2 réseaux", "ml"),
            ("Fourniture et pose de fourreau PVC 42/45 aiguillé", "ml"),
            ("Fourniture et pose de gaine janolène DN60 rouge", "ml"), ("Fourreau DN63 vert", "ml"),
            ("Fourreau DN90 rouge", "ml"), ("Fourreau DN160", "ml"),
            ("Fourniture et pose de câble de mise à la terre CU25²", "ml"),
            ("Chambre de tirage type L1T", "U"), ("Chambre de tirage 40 x 40 cm avec fonte B125", "U"),
            ("Chambre de tirage 80 x 80 cm avec fonte C250", "U"),
            ("Fourniture et pose de fosse à compteur", "U"),
            ("Réalisation des massifs et finition autour du pied de mâts", "U"),
            ("Réalisation des massifs et finition autour du pied de borne", "U"),
            ("Contrôle qualité de compactage", "Ens")]),
    ],
}

# words left out of a line's token signature, when building a bill
SIGNATURE_STOPWORDS = [
    "de", "du", "des", "le", "la", "les", "un", "une", "et", "en", "a", "au",
    "aux", "pour", "sur", "par", "avec", "d", "l", "ou", "y", "compris",
]
# the same, when comparing with a delivered bill
COMPARISON_STOPWORDS = [
    "de", "du", "des", "le", "la", "les", "un", "une", "et", "en", "a", "au",
    "aux", "pour", "sur", "par", "avec", "d", "l", "the", "ou",
]
UNIT_CLASSES = {
    "m²": "surface", "m2": "surface", "m 2": "surface", "m³": "volume", "m3": "volume",
    "ml": "longueur", "m": "longueur", "mL": "longueur",
    "u": "unite", "U": "unite", "unité": "unite", "unite": "unite", "kg": "masse", "t": "masse",
    "ft": "forfait", "forfait": "forfait", "ens": "forfait", "ensemble": "forfait",
    "forfait/an": "forfait", "f": "forfait", "pm": "memoire", "h": "heure", "heure": "heure", "mois": "duree",
}
OTHER_UNIT_CLASS = "autre"
# normalised spelling -> unit
CANONICAL_UNITS = {
    "m2": "m²", "metre carre": "m²", "metres carres": "m²",
    "m3": "m³", "metre cube": "m³", "metres cubes": "m³",
    "ml": "ml", "metre lineaire": "ml", "metres lineaires": "ml",
    "u": "U", "unite": "U", "unites": "U",
    "kg": "kg", "kilogramme": "kg", "kilogrammes": "kg",
    "h": "h", "heure": "h", "heures": "h", "mois": "mois",
}
LINE_UNITS = ["Ens", "Ft", "U", "ml", "m²", "m³", "kg", "h", "mois", "PM"]
SUGGESTED_UNITS = ["m²", "m³", "ml", "U", "Ens", "Ft", "kg", "PM"]
# rows of a delivered bill that are not works
BILL_TOTAL_PATTERN = r"^(?:sous[\s-]?total|total|montant|tva|prorata|net\b|s/total)"
BILL_NOISE = ["designation", "descriptif des ouvrages", "description des ouvrages", "unite", "quantite", "code"]
DESCRIPTIVE_SECTIONS = ["description des ouvrages", "description des travaux", "descriptif des ouvrages"]

# -------------------------------------------------------- end of fixed values


def decomposition_children():
    """Children of every rule as rows (child, rule, designation, unit)."""
    return [
        (rule, designation, unit)
        for rule, (_, children) in enumerate(DECOMPOSITION_RULES)
        for designation, unit in children
    ]


def skeleton_items(family):
    """Items of a family as rows (chapter, designation, unit)."""
    return [
        (chapter, designation, unit)
        for chapter, (_, items) in enumerate(LOT_SKELETONS.get(family, []))
        for designation, unit in items
    ]
