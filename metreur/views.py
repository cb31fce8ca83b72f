"""Inputs for the registered queries, derived whole from the given tables.

Each view is one SELECT both Spark and the checking engine understand; names in
braces are other views or tables. Only cutting texts into rows is written twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# wordings of works, so that the rule catalogues have something to say
WORKS = [
    "Tube cuivre", "Ouvrages d''assainissement", "Voirie", "Béton de propreté", "Câblage basse tension",
    "Réglage de fond de forme", "Travaux généraux", "Constat d''huissier", "Peinture des murs", "Cloison 72/48",
    "Vanne d’isolement", "Fourreaux rouges", "Nettoyage de la chaussée", "Généralités", "Zorglub télescopique",
    "Tranchée 2 réseaux", "Terrassements", "Régulation", "Vase d''expansion", "Appareillage", "Descentes d’eau",
    "Compte prorata", "Menuiseries intérieures", "Réseaux divers", "Contrôle qualité de compactage",
    "OPTION : Garde-corps", "Espaces verts", "Mise en œuvre", "Trappe de visite", "Éclairage de sécurité",
]
TRADES = [
    "Voirie et Réseaux Divers", "Gros œuvre", "CVC - Désenfumage", "Électricité CFO", "Peinture", "Plomberie sanitaire",
    "Démolition curage", "Menuiseries extérieures", "Cloisons doublages", "Espaces verts", "Ascenseur", "Divers",
]


def _pick(values: list[str], number: str) -> str:
    """CASE that chooses a constant by a number."""
    whens = " ".join(f"WHEN {i} THEN '{value}'" for i, value in enumerate(values))
    return f"CASE ({number}) % {len(values)} {whens} END"


_WORK = _pick(WORKS, "n * 7 + pos")
_DIGIT = "CAST(1 + CAST(floor(n / {by}) AS INT) % {mod} AS STRING)"


def _digit(by: int, mod: int) -> str:
    return _DIGIT.format(by=by, mod=mod)


_CODE2 = f"{_digit(3, 4)} || '.' || {_digit(5, 6)}"
_CODE = f"CASE n % 5 WHEN 0 THEN {_digit(3, 4)} WHEN 1 THEN {_CODE2} ELSE {_CODE2} || '.' || {_digit(7, 9)} END"
_LEVEL = "CASE n % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END"

VIEWS = {
    # one row per sentence, decorated as a specification
    "spec_blocks": f"""
        SELECT source_id, pos, CAST(floor((pos - 1) / 12) AS INT) + 1 AS page,
               CASE WHEN n = 0 THEN ''
                    WHEN n % 29 = 0 THEN 'Sommaire'
                    WHEN n % 13 = 0 THEN text || ' ..... ' || CAST(n AS STRING)
                    WHEN n % 31 = 0 THEN 'Sans objet.'
                    WHEN n % 19 = 0 THEN '{{CODE1}} Description des ouvrages'
                    WHEN n % 2 = 0 THEN {_CODE} || ' ' || {_WORK}
                    ELSE text END AS text,
               CASE WHEN n % 2 = 0 THEN 'Heading ' || CAST(1 + n % 4 AS STRING)
                    WHEN n % 9 = 0 THEN 'Titre ' || CAST(1 + n % 5 AS STRING)
                    ELSE 'Normal' END AS style,
               CAST(9 + n % 4 AS DOUBLE) AS font_size, n % 5 = 0 AS bold, 'paragraph' AS source_kind
        FROM {{sentences}}""".replace("'{CODE1}", f"{_digit(3, 4)} || '").replace("{{", "{").replace("}}", "}"),
    # the same sentences taken as headings already found
    "spec_headings": f"""
        SELECT source_id, pos, {_CODE} AS code, {_LEVEL} AS level,
               CASE WHEN n % 11 = 0 THEN 'Description des ouvrages ' || text
                    WHEN n % 4 = 0 THEN {_WORK} ELSE {_WORK} || ' ' || text END AS title,
               CAST(floor((pos - 1) / 12) AS INT) + 1 AS page,
               CASE WHEN n % 6 = 0 THEN 'pdf_merged_heading' WHEN n % 6 = 1 THEN 'pdf_line' ELSE 'paragraph' END AS source_kind,
               CAST(9 + n % 4 AS DOUBLE) AS font_size, n % 3 = 0 AS bold, n
        FROM {{sentences}}""".replace("{{", "{").replace("}}", "}"),
    "spec_documents": f"""
        SELECT 'src_' || CAST(doc_id AS STRING) AS source_id, 'dos_' || source AS dossier_id,
               'CCTP_LOT ' || CAST(1 + doc_id % 40 AS STRING) || ' - ' || {_pick(TRADES, "doc_id")} ||
               CASE WHEN lang = 'en' THEN '.docx' ELSE '.pdf' END AS original_name,
               CASE WHEN lang = 'en' THEN '.docx' ELSE '.pdf' END AS extension,
               CAST(1 + floor(n_chars / 600) AS INT) AS page_count, {_pick(TRADES, "doc_id")} AS lot_title,
               CAST(1 + doc_id % 40 AS STRING) AS lot_code, doc_id, text
        FROM {{documents}}""".replace("{{", "{").replace("}}", "}"),
    # lots of lines with a unit, a price and a state
    "bill_lines": """
        SELECT CAST(l_orderkey AS STRING) AS source_id,
               ((CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END * 16 + l_linenumber)
                 * CAST(8388608 AS BIGINT) + l_partkey) * 131072 + l_suppkey AS pos,
               'item' AS kind, 3 AS level,
               '4.' || CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END || '.' || CAST(l_linenumber AS STRING) AS code,
               'Poste ' || CAST(l_partkey AS STRING) AS designation,
               CAST(l_quantity AS DECIMAL(10, 2)) AS quantity, CAST(l_extendedprice AS DECIMAL(12, 2)) AS unit_price,
               l_linestatus = 'O' AS included
        FROM {lineitem}
        UNION ALL
        SELECT DISTINCT CAST(l_orderkey AS STRING),
               (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END * 16)
                 * CAST(8388608 AS BIGINT) * 131072,
               'section', 2, '4.' || CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END,
               CASE l_returnflag WHEN 'R' THEN 'DESCRIPTION DES OUVRAGES' ELSE 'Chapitre ' || l_returnflag END,
               CAST(NULL AS DECIMAL(10, 2)), CAST(NULL AS DECIMAL(12, 2)), true
        FROM {lineitem}""",
    # sentences as priced lines whose levels jump and whose sections nest
    "priced_lines": """
        SELECT source_id, CAST(pos AS BIGINT) AS pos, CASE WHEN n % 3 = 0 THEN 'section' ELSE 'item' END AS kind, CAST(1 + (n * 3 + pos) % 5 AS INT) AS level,
               CASE n % 4 WHEN 0 THEN '4.' || CAST(n % 9 AS STRING) WHEN 1 THEN '4.1.' || CAST(n % 7 AS STRING) WHEN 2 THEN '' ELSE '5' END AS code,
               CASE WHEN n % 10 = 0 THEN 'Descriptif des ouvrages' ELSE 'Poste ' || CAST(pos AS STRING) END AS designation,
               CASE WHEN n % 2 = 0 THEN 'm²' ELSE '' END AS unit,
               CASE WHEN n % 6 <> 1 THEN CAST(n % 50 AS DECIMAL(10, 2)) / 4 END AS quantity,
               CASE WHEN n % 11 <> 2 THEN CAST(n AS DECIMAL(12, 2)) / 8 END AS unit_price, n % 7 <> 0 AS included
        FROM {sentences}""",
    # parts as typed lines of projects
    "typed_lines": """
        SELECT 'ln_' || CAST(p_partkey AS STRING) AS line_id, p_brand AS source_id, p_brand AS project, p_partkey AS pos,
               CASE WHEN p_size > 45 THEN 'section' ELSE 'item' END AS kind, 1 + p_size % 4 AS level,
               CAST(1 + p_size % 9 AS STRING) || '.' || CAST(p_partkey AS STRING) AS code,
               p_name || ' ' || lower(p_type) AS designation, 'Fourniture ' || p_name AS description,
               CASE p_type WHEN 'STANDARD' THEN 'm2' WHEN 'SMALL' THEN 'ml' WHEN 'MEDIUM' THEN 'Ens'
                           WHEN 'LARGE' THEN 'U' WHEN 'ECONOMY' THEN 'Ft' ELSE 'm³' END AS unit,
               CASE p_size % 5 WHEN 0 THEN 'explicit' WHEN 1 THEN 'rule' WHEN 2 THEN 'default' WHEN 3 THEN 'skeleton' ELSE 'llm' END
                 AS unit_source,
               CAST(p_size % 100 AS DOUBLE) / 100 AS unit_confidence,
               CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS quantity,
               CASE WHEN p_size % 3 = 0 THEN 'explicit' ELSE 'missing' END AS quantity_source,
               p_retailprice AS unit_price, p_size % 7 <> 0 AS included,
               CAST(40 + p_size AS DOUBLE) / 100 AS confidence,
               CASE WHEN p_size % 2 = 0 THEN 'validated' ELSE 'to_review' END AS review_status,
               CASE WHEN p_size % 2 = 0 THEN '' ELSE 'Unité de métré à confirmer' END AS review_reason,
               CASE WHEN p_size % 4 = 1 THEN 1 + p_size END AS source_page,
               CASE WHEN p_size % 4 = 2 THEN '' ELSE p_name END AS source_excerpt,
               CASE p_size % 6 WHEN 0 THEN 'manual' WHEN 1 THEN 'rule-derived' ELSE 'deterministic-v2' END AS origin,
               false AS user_edited
        FROM {part}""",
    # what was stored before: larger parts were edited, and the dearest were typed by hand
    "previous_lines": """
        SELECT CASE WHEN level = 1 AND unit = 'U' THEN 'manual_' || line_id ELSE line_id END AS line_id,
               source_id, project, pos, kind, level, code,
               CASE WHEN level = 3 THEN upper(designation) ELSE designation END AS designation, description,
               CASE WHEN level = 2 THEN 'U' ELSE unit END AS unit, unit_source, unit_confidence, quantity, quantity_source,
               unit_price, CASE WHEN level = 4 THEN NOT included ELSE included END AS included, confidence, review_status,
               review_reason, source_page, source_excerpt,
               CASE WHEN level = 1 AND unit = 'U' THEN 'manual' ELSE origin END AS origin, level = 3 AS user_edited
        FROM {typed_lines}""",
    "dossiers": """
        SELECT CAST(o_orderkey AS STRING) AS dossier_id, CAST(o_custkey AS STRING) AS owner_sub,
               'Projet ' || o_orderpriority AS project_name, 'R' || CAST(o_orderkey AS STRING) AS project_reference,
               'Client ' || CAST(o_custkey AS STRING) AS client_name, 'DCE' AS phase, '' AS due_date,
               CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'needs_review' ELSE 'processing' END AS status,
               o_orderdate AS updated_at
        FROM {orders}""",
    "shares": """
        SELECT CAST(user_id * 7 AS STRING) AS dossier_id, 'user' || CAST(user_id % 10 AS STRING) || '@example.com' AS email,
               CASE WHEN max(value) > 40 THEN 'edit' ELSE 'view' END AS permission
        FROM {events} GROUP BY user_id""",
    # two sides of a bill: smaller parts are what was generated, larger ones what was delivered
    "gen_lines": """
        SELECT p_brand AS pair, p_partkey AS gen_index, p_name || ' ' || lower(p_type) AS designation,
               CASE p_type WHEN 'STANDARD' THEN 'm2' WHEN 'SMALL' THEN 'ml' ELSE 'Ens' END AS unit,
               CASE WHEN p_size % 2 = 0 THEN 'rule' WHEN p_size % 3 = 0 THEN 'explicit' END AS unit_source,
               CASE WHEN p_size % 4 = 0 THEN 'to_review' ELSE 'validated' END AS review_status
        FROM {part} WHERE p_size <= 25""",
    "ref_lines": """
        SELECT p_brand AS pair, p_partkey AS ref_index, p_name || ' ' || lower(p_type) AS designation,
               CASE WHEN p_retailprice > 950 THEN 'm²' WHEN p_type = 'SMALL' THEN 'm' ELSE 'ft' END AS unit
        FROM {part} WHERE p_size > 25""",
    # printed words: each line of a document is a line of a page, each word a span
    "pdf_lines": """
        SELECT source_id, CAST(floor((pos - 1) / 6) AS INT) + 1 AS page, CAST((pos - 1) % 6 AS INT) + 1 AS line_no,
               CASE WHEN length(text) % 5 = 0 THEN '3.' || CAST(1 + length(text) % 7 AS STRING) || '.'
                    WHEN length(text) % 7 = 0 THEN 'Page ' || CAST(pos AS STRING) ELSE text END AS text,
               CAST(9 + length(text) % 4 AS DOUBLE) AS size, length(text) % 3 = 0 AS bold,
               CAST(40 + 20 * (pos % 2) AS DOUBLE) AS x0, CAST(100 * floor(((pos - 1) % 6) / 2) AS DOUBLE) AS y0,
               CAST(500 AS DOUBLE) AS x1, CAST(100 * floor(((pos - 1) % 6) / 2) + 12 AS DOUBLE) AS y1,
               CAST(595 AS DOUBLE) AS page_width, CAST(842 AS DOUBLE) AS page_height, length(text) AS n
        FROM {doc_lines} WHERE length(text) > 0""",
}

# cutting texts into rows, per engine
_CUT_SQL = {
    "doc_lines": ("string_split(text, chr(10))", "split(text, '\\n')"),
    "sentences": ("string_split_regex(text, '[.\\n]+ *')", "split(text, '[.\\n]+ *')"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over the given tables."""
    if name == "documents":
        # One row group is one task however long its texts are; a shuffle of the scanned columns deals them out.
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in _CUT_SQL:
        pattern = "\n" if name == "doc_lines" else "[.\n]+ *"
        return (
            table(spark, sf_dir, "documents")
            .select("doc_id", "source", "lang", F.posexplode(F.split("text", pattern)).alias("pos", "text"))
            .select(
                F.concat(F.lit("src_"), F.col("doc_id").cast("string")).alias("source_id"),
                "source",
                "lang",
                (F.col("pos") + 1).alias("pos"),
                "text",
                F.length("text").alias("n"),
            )
        )
    sql = VIEWS[name]
    return spark.sql(sql, **{used: table(spark, sf_dir, used) for used in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))})


def _duck_ctes(name: str, done: dict[str, str]) -> None:
    if name in TABLES or name in done:
        return
    if name in _CUT_SQL:
        done[name] = f"""SELECT 'src_' || CAST(doc_id AS STRING) AS source_id, source, lang, pos, text, CAST(length(text) AS INT) AS n
            FROM (SELECT doc_id, source, lang, CAST(unnest(range(1, len(parts) + 1)) AS INT) AS pos, unnest(parts) AS text
                  FROM (SELECT *, {_CUT_SQL[name][0]} AS parts FROM (SELECT doc_id, source, lang, text FROM documents)))"""
        return
    for used in dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])):
        _duck_ctes(used, done)
    done[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """The checking statement with the views it reads in front. Its own ``WITH`` parts may follow."""
    done: dict[str, str] = {}
    for name in names:
        _duck_ctes(name, done)
    ctes = ", ".join(f"{name} AS ({body})" for name, body in done.items())
    if not ctes:
        return sql
    stripped = sql.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {stripped[15:]}"
    if stripped.upper().startswith("WITH "):
        return f"WITH {ctes}, {stripped[5:]}"
    return f"WITH {ctes} {stripped}"
