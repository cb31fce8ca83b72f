"""Statements the registered queries are compared with, for an engine with standard SQL.

Where no statement is given the result needs code SQL does not have (matching
block ratios, folds over accepted lines, whole extractions); those are tested
on fixtures.
"""

from __future__ import annotations

from metreur import catalogue
from metreur.views import with_views

CHECKS: dict[str, str] = {}


def check(name: str, sql: str, *views: str) -> None:
    CHECKS[name] = with_views(sql, *views)


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(value) for value in values)


def norm(c: str) -> str:
    """Comparison form of a text."""
    for a, b in (("’", "'"), ("‘", "'"), ("œ", "oe"), ("Œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("²", "2"), ("³", "3")):
        c = f"replace({c}, {quoted(a)}, {quoted(b)})"
    return f"trim(regexp_replace(lower(strip_accents({c})), '\\s+', ' ', 'g'))"


def clean(c: str) -> str:
    """Title form of a text."""
    c = f"regexp_replace({c}, '\\.{{3,}}\\s*\\d+\\s*$', '')"
    return f"substr(trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' ' || chr(9) || '-–—:.;'), 1, 240)"


def words(c: str, stop) -> str:
    found = f"regexp_extract_all({norm(c)}, '[a-z0-9]+')"
    kept = f"list_filter({found}, lambda w: length(w) > 1 AND NOT list_contains([{listed(stop)}], w))"
    return f"list_sort(list_distinct({kept}))"


def overlap(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST({shared} AS DOUBLE) / (len({a}) + len({b}) - {shared}) END"


def parts(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[.\\-]'), lambda p: p <> '')"


HEADING = (
    r"(?i)^\s*(?:ARTICLE\s+)?([A-Z]?\d{1,3}(?:[.\-]\d{1,3}){0,6})[.)]?(?:\s*[-–—:]\s*|\s+)(\S.+?)\s*$"
)
LOT = r"(?i)\bLOT\s*(?:N[°O]\s*)?([A-Z]?\d{1,3}(?:[.\-]\d{1,3})?)(?:\s*[-–—:]\s*|\s+)([^\n|]{3,100})"
TOC = r"\.{3,}\s*\d+\s*$"
ANCHOR = (
    r"(?i)\b(?:descriptions?|descriptifs?)\b(?:\s+\S+){0,3}?\s+(?:ouvrages?|travaux|prestations?)\b"
)

# parts several statements share, on spec_blocks
TOC_PAGES = f"""toc AS (
    SELECT source_id, page FROM spec_blocks GROUP BY source_id, page
    HAVING bool_or({norm('text')} IN ('sommaire', 'table des matieres'))
        OR count(*) FILTER (regexp_matches(text, '{TOC}')) >= 4)"""
OUTSIDE = f"""NOT regexp_matches(trim(text), '{TOC}') AND NOT regexp_matches(trim(text), '{LOT}')
    AND NOT EXISTS (SELECT 1 FROM toc WHERE toc.source_id = b.source_id AND toc.page = b.page)"""
POSSIBLE = "trim(text) <> '' AND length(trim(text)) <= 260"
NUMBERED = f"""{TOC_PAGES}, numbered AS (
    SELECT * FROM (
        SELECT source_id, pos, page, style, bold,
               regexp_replace(replace(regexp_extract(trim(text), '{HEADING}', 1), '-', '.'), '[.]+$', '') AS code,
               {clean(f"regexp_extract(trim(text), '{HEADING}', 2)")} AS title
        FROM spec_blocks b WHERE {POSSIBLE} AND {OUTSIDE} AND regexp_matches(trim(text), '{HEADING}'))
    WHERE length(title) >= 2)"""
STYLE_LEVEL = "CASE WHEN regexp_matches(style, '(?i)(heading|titre)\\s*\\d+') THEN least(8, greatest(1, CAST(regexp_extract(style, '(?i)(?:heading|titre)\\s*(\\d+)', 1) AS INT))) END"


def counters(source: str, level: str, deepest: int) -> str:
    """Multilevel counters as windows: rows of level k since the last shallower one."""
    runs = ", ".join(
        f"count(*) FILTER ({level} < {k}) OVER (PARTITION BY source_id ORDER BY pos) AS g{k}" for k in range(1, deepest + 1)
    )
    counts = ", ".join(
        f"count(*) FILTER ({level} = {k}) OVER (PARTITION BY source_id, g{k} ORDER BY pos) AS c{k}" for k in range(1, deepest + 1)
    )
    return f"SELECT *, {counts} FROM (SELECT *, {runs} FROM {source})"


def counted_code(level: str, deepest: int) -> str:
    pieces = [f"CASE WHEN {level} >= {k} THEN CAST(c{k} AS VARCHAR) END" for k in range(1, deepest + 1)]
    return f"concat_ws('.', {', '.join(pieces)})"


SYNTH = f"""{TOC_PAGES}, usable AS (
    SELECT b.*, {STYLE_LEVEL} AS sl FROM spec_blocks b WHERE {OUTSIDE} AND {STYLE_LEVEL} IS NOT NULL),
  styled AS (
    SELECT source_id, pos, {clean('trim(text)')} AS title,
           CAST(sl - (SELECT min(sl) - 1 FROM usable u WHERE u.source_id = usable.source_id) AS INT) AS level
    FROM usable WHERE {POSSIBLE}),
  synth AS ({counters("(SELECT * FROM styled WHERE length(title) >= 2)", "level", 8)}),
  by_style AS (SELECT source_id, pos, {counted_code('level', 8)} AS code, title, level FROM synth)"""
NEEDS = f"""needs AS (
    SELECT source_id, avg(CASE WHEN regexp_matches(trim(text), '{HEADING}') THEN 1.0 ELSE 0.0 END) AS numbered_share
    FROM spec_blocks WHERE {STYLE_LEVEL} IS NOT NULL GROUP BY source_id HAVING numbered_share < 0.5)"""

# ------------------------------------------------------------------- sources

check("s1_manifest", r"""
    SELECT source AS dossier_id,
           regexp_replace(trim('a_' || doc_id || ext, ' .'), '[:]', '_') AS original_name, lower(ext) AS extension,
           CAST(length(text) AS BIGINT) AS size,
           CASE WHEN lower(ext) IN ('.pdf', '.docx') AND length(text) <= 83886080 THEN sha256(text) END AS sha256,
           CASE WHEN lower(ext) NOT IN ('.pdf', '.docx') THEN 'format' WHEN length(text) > 83886080 THEN 'size'
                WHEN row_number() OVER (PARTITION BY source, lower(ext) IN ('.pdf', '.docx') AND length(text) <= 83886080
                                        ORDER BY 'corpus/' || source || '/a:' || doc_id || ext) > 30 THEN 'count' END AS reject_reason
    FROM (SELECT *, CASE lang WHEN 'en' THEN '.docx' WHEN 'fr' THEN '.PDF' ELSE '.doc' END AS ext FROM documents)""")

SPANS = """spans AS (
    SELECT source_id, page, line_no, x0, y0, y1, CAST(unnest(range(1, len(w) + 1)) AS INT) AS span_no, unnest(w) AS word
    FROM (SELECT *, string_split(text, ' ') AS w FROM pdf_lines))"""
check("s3_assemble_pdf_lines", rf"""WITH {SPANS}, joined AS (
    SELECT source_id, page, line_no, trim(regexp_replace(string_agg(word || ' ', '' ORDER BY span_no), '[ \t]+', ' ', 'g'), ' ' || chr(9)) AS text,
           max(CAST(8 + length(word) % 5 AS DOUBLE)) AS size, bool_or(length(word) > 12 OR word LIKE 'Et%') AS bold,
           min(x0 + span_no - 1) AS x0, min(y0) AS y0, max(x0 + span_no - 1 + 5) AS x1, max(y1) AS y1
    FROM spans GROUP BY ALL)
    SELECT * FROM joined WHERE text <> ''""", "pdf_lines")

CODE_ONLY = r"(?i)^\s*(?:ARTICLE\s+)?[A-Z]?\d{1,3}(?:[.\-]\d{1,3}){0,6}[.)]?\s*$"
check("s4_merge_split_headings", f"""WITH seen AS (
    SELECT *, lead(text) OVER w AS nt, lead(size) OVER w AS ns, lead(bold) OVER w AS nb, lead(x0) OVER w AS nx0,
           lead(y0) OVER w AS ny0, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1
    FROM pdf_lines WINDOW w AS (PARTITION BY source_id, page ORDER BY line_no)),
  marked AS (
    SELECT *, coalesce(regexp_matches(text, '{CODE_ONLY}') AND abs(y0 - ny0) <= greatest(2.6, size * 0.22) AND nx0 >= x0 + 8
        AND length(nt) BETWEEN 2 AND 220 AND NOT regexp_matches(nt, '{CODE_ONLY}') AND left(nt, 1) NOT IN ('•', '-', '–')
        AND (bold = nb OR abs(size - ns) <= 1.2), false) AS merges FROM seen),
  kept AS (SELECT *, lag(merges) OVER (PARTITION BY source_id, page ORDER BY line_no) AS eaten FROM marked)
    SELECT source_id, page, line_no,
           CASE WHEN merges THEN regexp_replace(text, '^(.*[.].*)[.]$', '\\1') || ' ' || nt ELSE text END AS text,
           CASE WHEN merges THEN greatest(size, ns) ELSE size END AS size,
           CASE WHEN merges THEN bold OR nb ELSE bold END AS bold, x0,
           CASE WHEN merges THEN greatest(x1, nx1) ELSE x1 END AS x1,
           CASE WHEN merges THEN greatest(y1, ny1) ELSE y1 END AS y1, merges AS merged_heading
    FROM kept WHERE NOT coalesce(eaten, false)""", "pdf_lines")

REPEAT = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\b\d+\s*/\s*\d+\b', '#/#', 'g'),
    '\bpage\s+\d+\b', 'page #', 'g'), '\s+', ' ', 'g'), ' -–—')"""
check("s5_drop_repeated_boundaries", f"""WITH keyed AS (
    SELECT *, {REPEAT.format(c='text')} AS k, max(page) OVER (PARTITION BY source_id) AS pages FROM pdf_lines),
  repeated AS (
    SELECT source_id, k FROM keyed
    WHERE pages > 2 AND (y0 <= page_height * 0.09 OR y1 >= page_height * 0.91) AND length(k) >= 4 AND length(text) < 160
    GROUP BY source_id, k, pages HAVING count(DISTINCT page) >= greatest(3, round_even(pages * 0.35, 0)))
    SELECT source_id, page, line_no, text FROM keyed ANTI JOIN repeated USING (source_id, k)""", "pdf_lines")
check("s6_flag_pdf_headings", """WITH body AS (SELECT source_id, median(size) AS m FROM pdf_lines GROUP BY source_id)
    SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY page, line_no) AS INT) AS pos,
           CASE WHEN bold OR n % 11 = 0 OR (m <> 0 AND size >= m * 1.07) THEN 'Heading' ELSE '' END AS style, round(size, 2) AS font_size,
           CASE WHEN n % 11 = 0 THEN 'pdf_merged_heading' ELSE 'pdf_line' END AS source_kind, x0, y1
    FROM pdf_lines JOIN body USING (source_id)""", "pdf_lines")
check("s7_low_text_warning", """WITH c AS (SELECT source_id, CAST(sum(n) AS BIGINT) AS character_count FROM doc_lines GROUP BY source_id)
    SELECT source_id, coalesce(character_count, 0) AS character_count FROM spec_documents LEFT JOIN c USING (source_id)
    WHERE extension = '.pdf' AND coalesce(character_count, 0) < greatest(250, page_count * 80)""", "doc_lines", "spec_documents")

check("s8_code_columns", """WITH n AS (
    SELECT p_brand AS pair, count(*) FILTER (p_size > 5) AS dotted FROM part GROUP BY p_brand)
    SELECT pair, CASE WHEN dotted > 0 THEN 2 ELSE 1 END AS code_col FROM n""")
check("s8_read_reference_bill", """WITH cells AS (
    SELECT p_brand AS pair, p_partkey AS row, CASE WHEN p_size > 5 THEN p_size || '.2' ELSE 'code' END AS code,
           CASE WHEN p_size = 9 THEN 'Total HT' ELSE '- ' || p_name END AS name, CASE WHEN p_type = 'SMALL' THEN '' ELSE lower(p_type) END AS unit
    FROM part),
  head AS (SELECT pair, min(row) AS head FROM cells WHERE code = 'code' GROUP BY pair)
    SELECT pair, CAST(row_number() OVER (PARTITION BY pair ORDER BY row) - 1 AS INT) AS ref_index, code,
           trim(ltrim(name, '->• ')) AS designation, unit, CASE WHEN unit <> '' THEN 'item' ELSE 'section' END AS kind
    FROM cells LEFT JOIN head USING (pair) WHERE row > coalesce(head, 0) AND name <> 'Total HT'""")

# ---------------------------------------------------------- scalar functions

for name in ("f1_normalize_text", "f1_normalize_text_full"):
    check(name, f"SELECT source_id, pos, {norm('text')} AS normalized FROM spec_blocks", "spec_blocks")
check("f2_clean_block_text", r"SELECT source_id, pos, trim(regexp_replace(text, '[ \t]+', ' ', 'g')) AS cleaned FROM sentences", "sentences")
check("f3_clean_title", f"SELECT source_id, pos, {clean('text')} AS title FROM (SELECT * REPLACE ('- ' || text AS text) FROM sentences)", "sentences")
check("f4_code_parts", """SELECT source_id, pos, code, replace(code, '.', '|') AS parts, CAST(len(string_split(code, '.')) AS INT) AS depth
    FROM spec_headings""", "spec_headings")
check("f5_natural_code_key", """SELECT source_id, pos, code, '0:' || replace(CASE WHEN n % 4 = 0 THEN left(code, length(code) - 3) ELSE code END, '.', ':|0:')
        || ':' || CASE WHEN n % 4 = 0 THEN '|1:0:b1' ELSE '' END AS sort_key
    FROM (SELECT source_id, pos, n, CASE WHEN n % 4 = 0 THEN code || '.B1' ELSE code END AS code FROM spec_headings)""", "spec_headings")
check("f6_style_level", f"SELECT source_id, pos, style, {STYLE_LEVEL} AS level FROM spec_blocks", "spec_blocks")
check("f7_heading_level", f"SELECT source_id, pos, CASE WHEN bold THEN 3 ELSE coalesce({STYLE_LEVEL}, 2) END AS level FROM spec_blocks", "spec_blocks")
check("f8_pad_lot_code", """SELECT p_partkey, CASE WHEN p_size > 30 THEN 'A' || p_size WHEN p_size < 10 THEN '0' || p_size ELSE '' || p_size END AS lot_code
    FROM part""")
check("f9_canonical_unit", """SELECT line_id, CASE unit WHEN 'm2' THEN 'm²' WHEN 'm³' THEN 'm³' WHEN 'ml' THEN 'ml' WHEN 'U' THEN 'U' ELSE 'Ens' END AS unit
    FROM typed_lines""", "typed_lines")
check("f10_family_unit", "SELECT line_id, CASE WHEN unit = 'Ens' AND level = 1 THEN 'Ft' ELSE unit END AS unit FROM typed_lines", "typed_lines")
check("f11_unit_class", """SELECT line_id, CASE unit WHEN 'm2' THEN 'surface' WHEN 'm³' THEN 'volume' WHEN 'ml' THEN 'longueur' WHEN 'U' THEN 'unite'
    WHEN 'Ens' THEN 'forfait' WHEN 'Ft' THEN 'forfait' ELSE 'autre' END AS unit_class FROM typed_lines""", "typed_lines")
check("f12_explicit_unit", "SELECT line_id, CASE level WHEN 1 THEN 'm³' WHEN 2 THEN 'ml' END AS unit FROM typed_lines", "typed_lines")
check("f13_explicit_quantity", """SELECT line_id, CASE level WHEN 3 THEN CAST(pos || '.5' AS DOUBLE) WHEN 4 THEN 12.0 END AS quantity
    FROM typed_lines""", "typed_lines")
check("f14_is_option", r"SELECT source_id, pos, regexp_matches(title, '(?i)\b(?:option|variante|pse|prestation\s+supplémentaire)\b') AS is_option FROM spec_headings", "spec_headings")
GENERIC = f"({norm('title')} IN ({listed(catalogue.GENERIC_TITLES)}) OR regexp_matches({norm('title')}, {quoted(catalogue.GENERIC_PATTERN)}))"
check("f15_is_generic_title", f"SELECT source_id, pos, {GENERIC} AS is_generic FROM spec_headings", "spec_headings")
check("f16_filename_identity", r"""WITH s AS (SELECT source_id, trim(regexp_replace(regexp_replace(regexp_replace(original_name, '[.][^.]*$', ''), '[_\-]+', ' ', 'g'), '\s+', ' ', 'g')) AS stem
    FROM spec_documents), f AS (SELECT source_id, regexp_extract(stem, 'LOT\s*(\d+)', 1) AS code, regexp_extract(stem, 'LOT\s*\d+(.*)$', 1) AS rest FROM s)
    SELECT source_id, lpad(code, CAST(greatest(2, length(code)) AS INT), '0') AS code, substr(trim(rest, ' -–—:.;'), 1, 100) AS title FROM f""", "spec_documents")
check("f17_repeat_key", f"""SELECT source_id, pos, {REPEAT.format(c="'- ' || text || ' Page ' || pos || ' | 3 / 12 '")} AS repeat_key FROM sentences""", "sentences")
check("f18_signature", f"""SELECT source_id, pos, array_to_string({words('title', catalogue.SIGNATURE_STOPWORDS)}, '|') AS signature,
    array_to_string({words('title', catalogue.COMPARISON_STOPWORDS)}, '|') AS tokens FROM spec_headings""", "spec_headings")
check("f19_jaccard", f"""WITH s AS (SELECT line_id, {words('designation', catalogue.SIGNATURE_STOPWORDS)} AS a, {words('description', catalogue.SIGNATURE_STOPWORDS)} AS b
    FROM typed_lines) SELECT line_id, {overlap('a', 'b')} AS overlap FROM s""", "typed_lines")
NAMED = r"""b AS (
    SELECT source_id, dossier_id, doc_id, rtrim(substr('DPGF_' || trim(regexp_replace(dossier_id, '[^\p{L}\p{N}_\-]+', '_', 'g'), '_') || '_' ||
           trim(regexp_replace('LOT_' || lot_code || '_' || lot_title, '[^\p{L}\p{N}_\-]+', '_', 'g'), '_'), 1, 170), '_') AS base FROM spec_documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY dossier_id, lower(base) ORDER BY doc_id) AS n FROM b),
  nm AS (SELECT source_id, CASE WHEN n = 1 THEN base ELSE substr(base, 1, 170 - length('_' || n)) || '_' || n END || '.xlsx' AS lot_file FROM r)"""
check("f20_output_names", f"WITH {NAMED} SELECT * FROM nm", "spec_documents")
check("f20_sheet_titles", r"""WITH b AS (
    SELECT source_id, dossier_id, doc_id, substr(trim(regexp_replace('LOT ' || lot_code || ' ' || lot_title, '\s+', ' ', 'g')), 1, 31) AS base FROM spec_documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY dossier_id, lower(base) ORDER BY doc_id) AS n FROM b)
    SELECT source_id, CASE WHEN n = 1 THEN base ELSE substr(base, 1, 31 - length(' (' || n || ')')) || ' (' || n || ')' END AS sheet_title FROM r""", "spec_documents")
check("f21_line_depth", """SELECT source_id, pos, CAST(CASE WHEN n % 7 = 0 THEN greatest(1, level - 1) ELSE len(string_split(code, '.')) END AS INT) AS depth
    FROM spec_headings""", "spec_headings")
check("f22_stable_ids", """SELECT source_id, pos, 'ln_' || left(sha1(source_id || '|' || code || '|' || title || '|' || pos), 14) AS line_id,
    'lot_' || left(sha1(source_id), 12) AS lot_id FROM spec_headings""", "spec_headings")
check("f23_is_dossier_id", "SELECT o_orderkey, o_orderstatus NOT IN ('F', 'P') OR (o_orderstatus = 'F' AND md5('' || o_orderkey) = upper(md5('' || o_orderkey))) AS is_id FROM orders")
check("f24_extract_json_object", """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(json_extract(props, '$.k') AS INT) END AS k FROM events""")
check("f27_line_amount", "SELECT source_id, pos, CAST(quantity * unit_price AS DOUBLE) AS amount FROM bill_lines WHERE kind = 'item'", "bill_lines")
check("f28_display_designation", """WITH t AS (SELECT *, designation || CASE WHEN included THEN '' ELSE ' (OPTION / VARIANTE)' END AS d FROM typed_lines)
    SELECT line_id, CASE WHEN level <= 2 THEN upper(d) ELSE d END AS shown FROM t""", "typed_lines")
check("f29_notes", """SELECT line_id, CASE unit_source WHEN 'explicit' THEN 'Unité explicitement mentionnée dans le CCTP.'
        WHEN 'rule' THEN 'Unité proposée selon la prestation ; à confirmer.' WHEN 'default' THEN 'Unité forfaitaire proposée par défaut ; à confirmer.'
        ELSE 'Unité renseignée manuellement.' END AS unit_note,
    CASE WHEN source_page IS NULL AND source_excerpt = '' THEN NULL ELSE
        CASE WHEN source_page IS NOT NULL THEN 'Source : page ' || source_page ELSE 'Source : document Word' END
        || CASE WHEN source_excerpt <> '' THEN chr(10) || chr(10) || source_excerpt ELSE '' END END AS source_note,
    CASE WHEN quantity IS NULL THEN 'Quantité non démontrée par le CCTP : cellule volontairement vide.' END AS quantity_note
    FROM typed_lines""", "typed_lines")

# ------------------------------------------------------------------- filters

check("p1_heading_prefilter", f"WITH {TOC_PAGES} SELECT source_id, pos, trim(text) AS text FROM spec_blocks b WHERE {POSSIBLE} AND {OUTSIDE}", "spec_blocks")
check("p2_looks_like_heading", """SELECT source_id, pos, source_kind = 'paragraph' OR bold OR n % 8 = 0 OR source_kind = 'pdf_merged_heading' OR level >= 2 AS looks
    FROM spec_headings""", "spec_headings")
check("p3_filter_lines", """SELECT line_id FROM typed_lines WHERE review_status = 'to_review'
    AND lower(code || ' ' || designation || ' ' || description) LIKE '%ring%'""", "typed_lines")
check("p4_search_dossiers", """SELECT dossier_id FROM dossiers WHERE project_name ILIKE '%r_5%' OR project_reference ILIKE '%r_5%' OR client_name ILIKE '%r_5%'""", "dossiers")
check("p5_drop_sans_objet", f"""WITH {NUMBERED} SELECT source_id, pos, code FROM numbered n WHERE NOT EXISTS (
    SELECT 1 FROM spec_blocks b WHERE b.source_id = n.source_id AND b.pos = n.pos + 1 AND rtrim({norm('b.text')}, ' .') = 'sans objet'
      AND NOT EXISTS (SELECT 1 FROM numbered m WHERE m.source_id = b.source_id AND m.pos = b.pos))""", "spec_blocks")
check("p6_sanitize_lines", f"""WITH e AS (SELECT *, repeat(designation, 20) AS d FROM typed_lines WHERE confidence <= 0.85 AND confidence >= 0.45)
    SELECT line_id, source_id, CASE WHEN kind = 'section' THEN 'section' ELSE 'item' END AS kind,
           CAST(greatest(1, least(8, level * 3 - 3)) AS INT) AS level, substr(repeat(code, 20), 1, 60) AS code, substr(d, 1, 240) AS designation,
           substr(repeat(description, 150), 1, 2000) AS description,
           CASE WHEN kind = 'section' THEN NULL WHEN unit IN ({listed(catalogue.LINE_UNITS)}) THEN unit ELSE 'Ens' END AS unit,
           CASE WHEN kind = 'section' THEN NULL ELSE quantity END AS quantity, included, review_status, 'manual' AS origin,
           CAST(row_number() OVER (PARTITION BY source_id ORDER BY pos) - 1 AS INT) AS sort_order FROM e""", "typed_lines")
check("p6_sanitize_rejects", "SELECT line_id, 'beaucoup' AS quantity FROM typed_lines WHERE confidence < 0.45", "typed_lines")

# ----------------------------------------------------------------- structure

check("d1_toc_pages", f"WITH {TOC_PAGES} SELECT * FROM toc", "spec_blocks")
check("d2_lot_identity", r"""WITH cover AS (
    SELECT source_id, lpad(CAST(n % 9 + 1 AS VARCHAR), 2, '0') AS text_code,
           """ + clean("regexp_extract('Travaux ' || text, '^[^|\n]{3,100}')") + r""" AS text_title FROM sentences WHERE pos = 1)
    SELECT source_id, CASE WHEN length(lot_code) = 1 THEN '0' || lot_code ELSE lot_code END AS lot_code,
           CASE WHEN text_code <> lpad(lot_code, 2, '0') THEN trim(regexp_replace(regexp_replace(lot_title, '[_\-]+', ' ', 'g'), '\s+', ' ', 'g')) ELSE text_title END AS lot_title,
           CASE WHEN text_code <> lpad(lot_code, 2, '0') THEN text_code END AS conflict_code,
           CASE WHEN text_code <> lpad(lot_code, 2, '0') THEN text_title END AS conflict_title
    FROM spec_documents JOIN cover USING (source_id)""", "sentences", "spec_documents")
check("d3_numbered_headings", f"WITH {NUMBERED} SELECT source_id, pos, code, title, CAST(len({parts('code')}) AS INT) AS level FROM numbered", "spec_blocks")
check("d4_needs_style_numbering", f"WITH {NEEDS} SELECT * FROM needs", "spec_blocks")
check("d5_synthesize_numbering", f"WITH {SYNTH} SELECT * FROM by_style", "spec_blocks")
SCORED = f"""h AS (SELECT *, string_split(code, '.')[1] AS part FROM spec_headings),
  scored AS (SELECT a.source_id, a.pos, a.part, a.code, a.title, a.page, count(d.pos) AS score FROM h a
    LEFT JOIN h d ON d.source_id = a.source_id AND d.part = a.part AND d.pos > a.pos AND d.level > a.level
    WHERE regexp_matches(a.title, '{ANCHOR}') GROUP BY ALL)"""
check("d6_score_anchors", f"WITH {SCORED} SELECT source_id, pos, part, score FROM scored", "spec_headings")
PERIMETER = SCORED.replace(
    "FROM spec_headings)",
    "FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS rows_ FROM spec_headings))", 1,
).replace("h AS (SELECT *,", "h AS (SELECT * REPLACE (CASE WHEN rows_ < 20 THEN replace(title, 'Description', 'Chapitre') ELSE title END AS title),", 1) + """,
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, pos) = 1),
  chapters AS (SELECT DISTINCT s.source_id, s.part, b.pos AS start FROM scored s JOIN best b USING (source_id) WHERE s.score >= 0.6 * b.score),
  counted AS (SELECT source_id, part, count(*) AS n, arg_min(title, pos) AS title, arg_min(page, pos) AS page, min(pos) AS pos FROM h
    WHERE len(string_split(code, '.')) >= 2 GROUP BY source_id, part),
  dominant AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, CAST(part AS INT) DESC, pos) = 1)"""
check("d7_select_perimeter", f"""WITH {PERIMETER}
    SELECT d.source_id, CASE WHEN b.pos IS NOT NULL THEN 'explicit_anchor' WHEN m.n IS NOT NULL THEN 'dominant_numbered_chapter' ELSE 'not_found' END AS method,
           CASE WHEN b.pos IS NOT NULL THEN b.code ELSE coalesce(m.part, '') END AS anchor_code,
           CASE WHEN b.pos IS NOT NULL THEN b.title ELSE coalesce(m.title, '') END AS anchor_title,
           CASE WHEN b.pos IS NOT NULL THEN b.page ELSE m.page END AS start_page,
           CAST(CASE WHEN b.pos IS NOT NULL THEN 0.98 WHEN m.n >= 6 THEN 0.92 WHEN m.n IS NOT NULL THEN 0.78 ELSE 0 END AS DOUBLE) AS confidence
    FROM spec_documents d LEFT JOIN best b USING (source_id) LEFT JOIN dominant m USING (source_id)""", "spec_headings", "spec_documents")
check("d7_selected_headings", f"""WITH {PERIMETER}
    SELECT h.source_id, h.pos, h.code FROM h LEFT JOIN chapters c USING (source_id, part) LEFT JOIN dominant m USING (source_id)
    LEFT JOIN best b USING (source_id)
    WHERE CASE WHEN b.pos IS NOT NULL THEN c.start IS NOT NULL AND h.pos >= c.start ELSE h.part = m.part END""", "spec_headings")
check("d7_forced_and_trade", r"""WITH h AS (SELECT * REPLACE (CASE WHEN n % 9 = 0 THEN 'Travaux de curage' ELSE title END AS title), string_split(code, '.')[1] AS part FROM spec_headings),
  forced AS (SELECT source_id, min(pos) AS pos FROM h JOIN spec_documents USING (source_id) WHERE lot_title = 'Peinture' AND h.code = '2.1' GROUP BY source_id),
  trade AS (SELECT source_id, min(pos) AS pos FROM h JOIN spec_documents USING (source_id) WHERE lot_title = 'Démolition curage' AND title = 'Travaux de curage' GROUP BY source_id)
    SELECT a.source_id, 'llm_confirmed_anchor' AS method, '2.1' AS anchor_code, a.page AS start_page, count(h.pos) AS selected
    FROM forced f JOIN h a USING (source_id, pos) JOIN h ON h.source_id = a.source_id AND h.pos >= a.pos AND h.part = '2' GROUP BY ALL
    UNION ALL SELECT a.source_id, 'trade_work_anchor', a.code, a.page, count(h.pos)
    FROM trade t JOIN h a USING (source_id, pos) JOIN h ON h.source_id = a.source_id AND h.pos >= a.pos GROUP BY ALL""", "spec_headings", "spec_documents")
check("d8_recover_demolition_items", f"""WITH b AS (
    SELECT source_id, pos, n, CASE WHEN n % 8 = 0 THEN CASE n % 3 WHEN 0 THEN 'Travaux de curage' WHEN 1 THEN 'Installation de chantier' ELSE 'Travaux de désamiantage' END
           WHEN n % 7 = 0 THEN 'Nature des prestations :' WHEN n % 5 = 0 THEN 'Localisation :' WHEN n % 9 = 0 THEN 'Base vie de chantier' ELSE text END AS text
    FROM sentences),
  p AS (SELECT *, max(CASE WHEN n % 8 = 0 THEN pos END) OVER w AS parent, max(CASE WHEN n % 8 <> 0 AND n % 7 <> 0 AND n % 5 = 0 THEN pos END) OVER w AS mark,
           lead(text) OVER o AS after_text FROM b
        WINDOW w AS (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY source_id ORDER BY pos)),
  c AS (SELECT p.source_id, p.pos, p.parent, {clean('p.text')} AS title FROM p JOIN b q ON q.source_id = p.source_id AND q.pos = p.parent
        WHERE p.n % 8 <> 0 AND CASE q.text WHEN 'Installation de chantier' THEN {norm('p.text')} LIKE 'base vie%'
              WHEN 'Travaux de curage' THEN coalesce(after_text = 'Nature des prestations :', false)
              ELSE coalesce(mark > p.parent AND mark < p.pos, false) AND p.n % 2 = 0 END),
  f AS (SELECT * FROM c WHERE length(title) >= 3 QUALIFY row_number() OVER (PARTITION BY source_id, parent, {norm('title')} ORDER BY pos) = 1)
    SELECT source_id, pos, '2.' || parent || '.' || row_number() OVER (PARTITION BY source_id, parent ORDER BY pos) AS code, title, 3 AS level FROM f
    UNION ALL SELECT source_id, pos, '2.' || pos, text, 2 FROM b WHERE n % 8 = 0""", "sentences")
check("d9_renumber_under", f"""WITH r AS (SELECT *, CAST(level - min(level) OVER (PARTITION BY source_id) + 1 AS INT) AS rel FROM spec_headings),
    c AS ({counters('r', 'rel', 4)})
    SELECT source_id, pos, '3.' || {counted_code('rel', 4)} AS code, rel + 1 AS level FROM c""", "spec_headings")
DEDUPED = f"""k AS (SELECT *, {norm('title')} AS t, min(pos) OVER (PARTITION BY source_id, code) AS first_pos FROM spec_headings),
  fresh AS (SELECT * FROM k WHERE level <> 1 OR pos = first_pos OR regexp_matches(title, '{ANCHOR}')),
  kept AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY source_id, code, t ORDER BY pos) = 1)"""
check("d10_dedupe_headings", f"""WITH {DEDUPED}
    SELECT source_id, pos, code, min(t) OVER w <> max(t) OVER w AS code_conflict FROM kept WINDOW w AS (PARTITION BY source_id, code)""", "spec_headings")
check("d11_attach_context", f"""WITH {NUMBERED}, nx AS (SELECT source_id, pos, lead(pos) OVER (PARTITION BY source_id ORDER BY pos) AS next_pos FROM numbered)
    SELECT n.source_id, n.pos, coalesce(trim(regexp_replace(string_agg(b.text, ' ' ORDER BY b.pos), '\\s+', ' ', 'g')), '') AS context,
           coalesce(bool_or(b.pos = n.pos + 1 AND rtrim({norm('b.text')}, ' .') = 'sans objet'), false) AS is_void
    FROM nx n LEFT JOIN spec_blocks b ON b.source_id = n.source_id AND b.pos > n.pos AND b.pos < coalesce(n.next_pos, n.pos + 14) AND b.pos < n.pos + 14
    GROUP BY n.source_id, n.pos""", "spec_blocks")
TYPED = f"""x AS (SELECT *, lead(code) OVER w AS nc, lead(level) OVER w AS nl FROM spec_headings WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
  y AS (SELECT *, code = '2' AND regexp_matches(title, '{ANCHOR}') AS is_anchor, coalesce(nl > level AND nc LIKE code || '.%', false) AS has_child FROM x),
  typed AS (SELECT *, CASE WHEN is_anchor OR level <= 1 OR (has_child AND level = 2) THEN 'section' ELSE 'item' END AS kind FROM y)"""
check("d12_type_lines", f"WITH {TYPED} SELECT source_id, pos, kind, is_anchor FROM typed", "spec_headings")
check("d13_drop_generic_items", f"WITH {TYPED} SELECT source_id, pos FROM typed WHERE kind <> 'item' OR is_anchor OR NOT {GENERIC}", "spec_headings")
check("d14_score_lines", """WITH s AS (
    SELECT *, level <> 1 AS item, CASE WHEN n % 4 = 0 THEN 0.78::DOUBLE ELSE 0.98::DOUBLE END AS base, CASE WHEN n % 3 = 0 THEN 0.62::DOUBLE ELSE 0.88::DOUBLE END AS uc FROM spec_headings),
  t AS (SELECT *, CASE WHEN source_kind = 'pdf_merged_heading' THEN least(0.99::DOUBLE, base + 0.01::DOUBLE) ELSE base END AS up FROM s),
  u AS (SELECT *, CASE WHEN NOT bold AND source_kind <> 'paragraph' THEN up - 0.03::DOUBLE ELSE up END AS seen FROM t),
  w AS (SELECT *, CASE WHEN item THEN seen * 0.78::DOUBLE + uc * 0.22::DOUBLE ELSE greatest(0.9::DOUBLE, seen) END
        - CASE WHEN item AND n % 7 = 0 THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN item AND n % 4 = 0 THEN 0.08::DOUBLE ELSE 0 END
        - CASE WHEN item AND n % 3 = 0 THEN 0.08::DOUBLE ELSE 0 END AS raw,
        concat_ws(' · ', CASE WHEN item AND n % 7 = 0 THEN 'Code ' || code || ' présent avec plusieurs intitulés' END,
                  CASE WHEN item AND n % 4 = 0 THEN 'Périmètre des ouvrages à confirmer' END, CASE WHEN item AND n % 3 = 0 THEN 'Unité de métré à confirmer' END) AS review_reason FROM u)
    SELECT source_id, pos, round_even(greatest(0.35::DOUBLE, least(0.99::DOUBLE, raw)), 2) AS confidence, review_reason,
           CASE WHEN review_reason <> '' THEN 'to_review' ELSE 'validated' END AS review_status, CASE WHEN n % 7 = 0 THEN 'code' ELSE '' END AS review_fields FROM w""", "spec_headings")
check("d16_list_headings", f"""WITH {NUMBERED}, {SYNTH.split(', ', 1)[1] if False else SYNTH[len(TOC_PAGES) + 2:]}, {NEEDS},
  styled_docs AS (SELECT DISTINCT source_id FROM by_style SEMI JOIN needs USING (source_id))
    SELECT source_id, pos, code, title, CAST(len({parts('code')}) AS INT) AS level FROM numbered ANTI JOIN styled_docs USING (source_id)
    UNION ALL SELECT source_id, pos, code, title, level FROM by_style SEMI JOIN styled_docs USING (source_id)""", "spec_blocks")

# ---------------------------------------------------------------------- rules


def first_rule(c: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {quoted(p)}) THEN {quoted(str(x))}" for p, x in rules) + f" ELSE {otherwise} END"


check("r1_classify_family", f"""WITH d AS (SELECT source_id, {norm('lot_title')} AS t FROM spec_documents)
    SELECT source_id, {first_rule('t', [(p, f) for f, _, p in catalogue.LOT_FAMILY_RULES], "'autre'")} AS family,
           CAST({first_rule('t', [(p, r) for _, r, p in catalogue.LOT_FAMILY_RULES], "'99'")} AS INT) AS family_rank FROM d""", "spec_documents")


def unit_case(pick) -> str:
    general = first_rule("t", [(p, pick(u, c, "rule")) for u, c, p in catalogue.UNIT_RULES], quoted(str(pick("Ens", 0.62, "default"))))
    per_family = {
        level: first_rule("t", [(p, pick(u, c, "rule")) for u, c, p in catalogue.FAMILY_UNIT_OVERRIDES[family]], general)
        for level, family in ((1, "vrd"), (2, "cvc"), (3, "peinture"))
    }
    return "CASE level " + " ".join(f"WHEN {k} THEN {sql}" for k, sql in per_family.items()) + " END"


check("r2_infer_unit", f"""WITH t AS (SELECT source_id, pos, level, {norm('title')} AS t FROM spec_headings),
    u AS (SELECT *, {unit_case(lambda u, c, s: u)} AS u FROM t)
    SELECT source_id, pos, CASE WHEN u = 'Ens' AND level = 1 THEN 'Ft' ELSE u END AS unit, {unit_case(lambda u, c, s: s)} AS unit_source,
           CAST({unit_case(lambda u, c, s: c)} AS DOUBLE) AS unit_confidence FROM u""", "spec_headings")
check("r3_mine_rules", f"""WITH k AS (SELECT unnest({words('designation', catalogue.SIGNATURE_STOPWORDS)}) AS token, unit, project FROM typed_lines),
  c AS (SELECT token, unit, count(*) AS n FROM k GROUP BY ALL),
  s AS (SELECT token, CAST(sum(n) AS BIGINT) AS support, arg_min(unit, struct_pack(m := -n, u := unit)) AS dominant_unit, max(n) / sum(n) AS purity FROM c GROUP BY token),
  p AS (SELECT token, count(DISTINCT project) AS projects FROM k GROUP BY token)
    SELECT token, support, dominant_unit, CAST(purity AS DOUBLE) AS purity, projects FROM s JOIN p USING (token)
    WHERE support >= 15 AND purity >= 0.15 AND projects >= 3""", "typed_lines")
check("r4_flag_co_occurrence", """SELECT a.description AS concept, b.designation AS extra, count(DISTINCT a.project) AS projects
    FROM (SELECT DISTINCT project, description FROM typed_lines) a JOIN (SELECT DISTINCT project, designation FROM typed_lines) b USING (project)
    GROUP BY ALL HAVING projects >= 3""", "typed_lines")
RULES = ", ".join(f"CASE WHEN regexp_matches(t, {quoted(p)}) THEN {i} END" for i, (p, _) in enumerate(catalogue.DECOMPOSITION_RULES))
check("e1_decomposition_triggers", f"""WITH t AS (SELECT source_id, pos, level, {norm('title')} AS t FROM spec_headings WHERE level > 2),
    f AS (SELECT source_id, pos, level, unnest([{RULES}]) AS rule FROM t)
    SELECT source_id, rule, CAST(min(pos) AS BIGINT) AS pos, arg_min(level, pos) AS level FROM f WHERE rule IS NOT NULL GROUP BY source_id, rule""", "spec_headings")
CHAPTERS = ", ".join(f"({i}, {quoted(title)})" for i, (title, _) in enumerate(catalogue.LOT_SKELETONS["vrd"]))
check("e2_skeleton_anchors", f"""WITH c AS (SELECT chapter, {words('title', catalogue.SIGNATURE_STOPWORDS)} AS w FROM (VALUES {CHAPTERS}) v(chapter, title)),
    s AS (SELECT source_id, pos, {words('title', catalogue.SIGNATURE_STOPWORDS)} AS x FROM spec_headings WHERE level <= 2),
    j AS (SELECT source_id, chapter, CAST(pos AS BIGINT) AS pos, {overlap('w', 'x')} AS score FROM s, c)
    SELECT source_id, chapter, pos, score FROM j WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY source_id, chapter ORDER BY score DESC, pos) = 1""", "spec_headings")
LOTS = f"""lots AS (SELECT source_id, CASE WHEN extension = '.docx' THEN 'vrd' ELSE {first_rule(norm('lot_title'), [(p, f) for f, _, p in catalogue.LOT_FAMILY_RULES], "'autre'")} END AS family
    FROM spec_documents),
  l AS (SELECT source_id, CAST(pos AS BIGINT) AS pos, 'ln_' || source_id || '_' || pos AS line_id, title AS designation, level, level <= 2 AS section,
        CASE WHEN level > 2 THEN 'Ens' END AS unit, 'deterministic-v2' AS origin, {norm('title')} AS t FROM spec_headings)"""
LUMP = "CASE WHEN {u} = 'Ens' THEN CASE {f} " + " ".join(f"WHEN {quoted(f)} THEN {quoted(u)}" for f, u in catalogue.FAMILY_LUMP_SUM.items()) + " ELSE 'Ens' END ELSE {u} END"
CHOSEN = """chosen(source_id{key}, k, kept) AS (
    SELECT source_id{key}, 0, CAST([] AS INTEGER[]) FROM cand WHERE rn = 1
    UNION ALL SELECT c.source_id{ckey}, k + 1, CASE WHEN len(list_intersect(kept, clashes)) > 0 THEN kept ELSE list_append(kept, c.i) END
    FROM chosen c0 JOIN cand c ON c.source_id = c0.source_id{on} AND c.rn = c0.k + 1),
  done AS (SELECT source_id{key}, unnest(kept) AS i, unnest(range(1, len(kept) + 1)) AS n FROM chosen QUALIFY k = max(k) OVER (PARTITION BY source_id{key}))"""
CHILDREN = ", ".join(f"({i}, {rule}, {quoted(d)}, {quoted(u)})" for i, (rule, d, u) in enumerate(catalogue.decomposition_children()))


def same_line(a: str, b: str) -> str:
    short, long = f"least(length({a}), length({b}))", f"greatest(length({a}), length({b}))"
    return f"({short} >= 6 AND {short} >= 0.7 * {long} AND (contains({a}, {b}) OR contains({b}, {a})))"


check("e1_apply_decomposition", f"""WITH RECURSIVE {LOTS},
  ch AS (SELECT i, rule, d, u, {norm('d')} AS key FROM (VALUES {CHILDREN}) v(i, rule, d, u)),
  cl AS (SELECT a.i, list(b.i ORDER BY b.i) AS clashes FROM ch a JOIN ch b ON {same_line('a.key', 'b.key')} GROUP BY a.i),
  fired AS (SELECT source_id, pos, level, designation, unnest([{RULES}]) AS rule FROM l WHERE NOT section),
  tr AS (SELECT source_id, rule, min(pos) AS pos, arg_min(level, pos) AS level FROM fired WHERE rule IS NOT NULL GROUP BY ALL),
  has AS (SELECT DISTINCT source_id, i FROM (SELECT DISTINCT source_id, t FROM l WHERE length(t) < 200) x JOIN ch ON {same_line('x.t', 'ch.key')}),
  cand AS (SELECT tr.source_id, ch.i, clashes, tr.pos, tr.level, row_number() OVER (PARTITION BY tr.source_id ORDER BY tr.pos, ch.i) AS rn
           FROM tr JOIN ch USING (rule) JOIN cl USING (i) ANTI JOIN has ON has.source_id = tr.source_id AND has.i = ch.i),
  {CHOSEN.format(key='', ckey='', on='')},
  placed AS (SELECT d.source_id, d.i, d.n, c.pos, c.level, ch.d, ch.u, family, family IN ({listed(catalogue.CLOSING_CHILD_FAMILIES)}) AND regexp_matches(key, {quoted(catalogue.CLOSING_CHILD_PATTERN)}) AS waits
         FROM done d JOIN cand c USING (source_id, i) JOIN ch USING (i) JOIN lots USING (source_id)),
  put AS (
    SELECT source_id, pos AS a, 0 AS b, 0 AS c, line_id, designation, level, unit, origin FROM l
    UNION ALL SELECT source_id, CASE WHEN waits THEN coalesce((SELECT min(x.pos) FROM l x WHERE x.source_id = placed.source_id AND x.section AND x.pos > placed.pos),
                                       (SELECT max(x.pos) + 1 FROM l x WHERE x.source_id = placed.source_id)) ELSE pos END,
           CASE WHEN waits THEN -1 ELSE 1 END, n, 'ln_' || left(sha1(source_id || '||' || d || '|' || (900000 + n)), 14), d, level + 1, {LUMP.format(u='u', f='family')}, 'rule-derived' FROM placed)
    SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY a, b, c) AS pos, line_id, designation, CAST(level AS INT) AS level, unit, origin FROM put""",
      "spec_headings", "spec_documents")
ITEMS = ", ".join(
    f"({quoted(family)}, {i}, {chapter}, {quoted(d)}, {quoted(u)})" for family in catalogue.LOT_SKELETONS for i, (chapter, d, u) in enumerate(catalogue.skeleton_items(family))
)
FAMILY_CHAPTERS = ", ".join(f"({quoted(family)}, {i}, {quoted(title)})" for family, chapters in catalogue.LOT_SKELETONS.items() for i, (title, _) in enumerate(chapters))
check("e2_apply_skeleton", f"""WITH RECURSIVE {LOTS},
  it AS (SELECT family, i, chapter, d, u, {words('d', catalogue.SIGNATURE_STOPWORDS)} AS w FROM (VALUES {ITEMS}) v(family, i, chapter, d, u)),
  cl AS (SELECT a.family, a.i, list(b.i ORDER BY b.i) AS clashes FROM it a JOIN it b ON a.family = b.family AND {overlap('a.w', 'b.w')} >= 0.6 GROUP BY ALL),
  cp AS (SELECT family, chapter, {words('title', catalogue.SIGNATURE_STOPWORDS)} AS w FROM (VALUES {FAMILY_CHAPTERS}) v(family, chapter, title)),
  lw AS (SELECT l.*, family, {words('designation', catalogue.SIGNATURE_STOPWORDS)} AS x FROM l JOIN lots USING (source_id)),
  an AS (SELECT source_id, family, chapter, pos, level FROM (SELECT source_id, lw.family, chapter, pos, level, {overlap('w', 'x')} AS score FROM lw JOIN cp ON cp.family = lw.family WHERE section)
         WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY source_id, family, chapter ORDER BY score DESC, pos) = 1),
  has AS (SELECT DISTINCT source_id, i FROM lw JOIN it ON it.family = lw.family WHERE {overlap('w', 'x')} >= 0.6),
  cand AS (SELECT an.source_id, it.i, clashes, an.chapter, an.pos, an.level, row_number() OVER (PARTITION BY an.source_id ORDER BY it.i) AS rn
           FROM an JOIN it USING (family, chapter) JOIN cl USING (family, i) ANTI JOIN has ON has.source_id = an.source_id AND has.i = it.i),
  {CHOSEN.format(key='', ckey='', on='')},
  stop AS (SELECT an.source_id, an.chapter, min(x.pos) AS stop FROM an JOIN l x ON x.source_id = an.source_id AND x.pos > an.pos AND x.level <= an.level GROUP BY ALL),
  placed AS (SELECT d.source_id, d.n, c.chapter, c.level, it.d, it.u, lots.family, coalesce(stop, (SELECT max(x.pos) + 1 FROM l x WHERE x.source_id = d.source_id)) AS stop
         FROM done d JOIN cand c USING (source_id, i) JOIN lots USING (source_id) JOIN it ON it.family = lots.family AND it.i = d.i LEFT JOIN stop ON stop.source_id = d.source_id AND stop.chapter = c.chapter),
  put AS (
    SELECT source_id, pos AS a, 1 AS b, 0 AS c, 0 AS e, 0 AS f, line_id, designation, level, unit, origin FROM l
    UNION ALL SELECT source_id, stop, 0, -level, chapter, n, 'ln_' || left(sha1(source_id || '|skeleton|' || d || '|' || n), 14), d, level + 1, {LUMP.format(u='u', f='family')}, 'skeleton' FROM placed)
    SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY a, b, c, e, f) AS pos, line_id, designation, CAST(level AS INT) AS level, unit, origin FROM put""",
      "spec_headings", "spec_documents")
check("e3_fill_missing_units", """SELECT line_id,
        CASE WHEN hit THEN CASE WHEN s = 'Ens' AND source_id LIKE '%1' THEN 'Ft' ELSE s END ELSE unit END AS unit,
        CASE WHEN hit THEN 'llm' ELSE unit_source END AS unit_source, CASE WHEN hit THEN 0.7::DOUBLE ELSE unit_confidence END AS unit_confidence
    FROM (SELECT t.*, CASE WHEN p_size > 20 THEN 'Ens' ELSE 'kg' END AS s, kind = 'item' AND unit_source = 'default' AND p_size <= 40 AS hit
          FROM typed_lines t JOIN part ON p_partkey = pos)""", "typed_lines")
check("e5_merge_refinements", """WITH r AS (SELECT *, CASE WHEN p_size > 10 THEN 'Ens' END AS au FROM part),
  tl AS (SELECT source_id, lower(designation) AS k, arg_max(line_id, pos) AS line_id FROM typed_lines GROUP BY ALL),
  aim AS (
    SELECT 'ln_' || p_partkey AS line_id, p_partkey AS seq, 'Précisé ' || p_name AS d, au, p_size, p_name FROM r WHERE p_size <= 25
    UNION ALL SELECT tl.line_id, p_partkey, upper(p_name) || ' ' || lower(p_type), au, p_size, p_name FROM r JOIN tl ON tl.source_id = p_brand AND tl.k = lower(p_name || ' ' || p_type) WHERE p_size > 25),
  m AS (SELECT line_id, arg_max(d, seq) AS d, arg_max(au, seq) FILTER (au IS NOT NULL) AS u, max(least(0.99::DOUBLE, CAST(p_size AS DOUBLE) / 40)) AS c,
        max(CASE WHEN p_size > 45 THEN 'À revoir' END) AS rr, arg_max(p_name, seq) FILTER (p_size < 5) AS x, true AS hit FROM aim GROUP BY line_id)
    SELECT t.line_id, coalesce(d, designation) AS designation, coalesce(CASE WHEN u = 'Ens' AND source_id LIKE '%1' THEN 'Ft' ELSE u END, unit) AS unit,
           CASE WHEN u IS NOT NULL THEN 'llm' ELSE unit_source END AS unit_source, CASE WHEN u IS NOT NULL THEN 0.7::DOUBLE ELSE unit_confidence END AS unit_confidence,
           CASE WHEN hit THEN greatest(confidence, c) ELSE confidence END AS confidence,
           CASE WHEN hit THEN CASE WHEN coalesce(rr, review_reason) <> '' THEN 'to_review' ELSE 'validated' END ELSE review_status END AS review_status,
           coalesce(rr, review_reason) AS review_reason, coalesce(x, source_excerpt) AS source_excerpt, CASE WHEN hit THEN 'deterministic+llm' ELSE origin END AS origin
    FROM typed_lines t LEFT JOIN m USING (line_id)""", "typed_lines")

# ---------------------------------------------------------------------- joins


def inserted(lines_: str, new: str, columns: str) -> str:
    """Ranks after putting ``new`` before the first line of a greater code."""
    key = "list_transform(string_split(code, '.'), lambda p: CAST(p AS INT))"
    return f"""lk AS (SELECT *, {key} AS key FROM {lines_}), nk AS (SELECT *, {key} AS key FROM {new}),
  spots AS (SELECT n.line_id, min(l.pos) AS spot FROM nk n LEFT JOIN lk l ON l.source_id = n.source_id AND l.key > n.key GROUP BY n.line_id),
  laid AS (SELECT {columns}, pos AS a, 1 AS b, key, pos AS c FROM lk UNION ALL
           SELECT {columns}, coalesce(spot, 9000000000000000000) AS a, 0 AS b, key, pos AS c FROM nk JOIN spots USING (line_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY a, b, key, c, line_id) AS pos FROM laid)"""


check("j1_overlay_edits", f"""WITH ed AS (SELECT line_id, struct_pack(k := code, d := designation, u := unit, i := included) AS e FROM previous_lines WHERE user_edited),
  laid0 AS (SELECT t.line_id, source_id, pos, coalesce(e.k, code) AS code, coalesce(e.d, designation) AS designation, CASE WHEN e IS NULL THEN unit ELSE e.u END AS unit,
            CASE WHEN e IS NULL THEN included ELSE e.i END AS included, e IS NOT NULL OR user_edited AS user_edited,
            CASE WHEN e IS NULL THEN origin ELSE 'deterministic-v2+manual-edit' END AS origin FROM typed_lines t LEFT JOIN ed USING (line_id)),
  man AS (SELECT line_id, source_id, pos, code, designation, unit, included, user_edited, origin FROM previous_lines p
          WHERE origin LIKE 'manual%' AND NOT EXISTS (SELECT 1 FROM typed_lines t WHERE t.line_id = p.line_id)),
  {inserted('laid0', 'man', 'line_id, source_id, designation, unit, included, user_edited, origin')}
    SELECT line_id, source_id, pos, designation, unit, included, user_edited, origin FROM ranked""", "typed_lines", "previous_lines")
check("j2_detect_edits", """SELECT t.line_id, CASE WHEN p.line_id IS NULL OR t.origin LIKE 'manual%' THEN t.user_edited ELSE p.user_edited OR t.designation IS DISTINCT FROM p.designation
        OR t.unit IS DISTINCT FROM p.unit OR t.included IS DISTINCT FROM p.included END AS user_edited
    FROM typed_lines t LEFT JOIN previous_lines p USING (line_id)""", "typed_lines", "previous_lines")
VISIBLE = """SELECT d.*, s.permission AS shared_permission FROM dossiers d LEFT JOIN shares s ON s.dossier_id = d.dossier_id AND s.email = 'user3@example.com'
    WHERE (owner_sub = '42' OR s.email IS NOT NULL)"""
check("j3_visible_dossiers", f"SELECT dossier_id, owner_sub, shared_permission, updated_at FROM ({VISIBLE})", "dossiers", "shares")
check("j3_searched_dossiers", f"""SELECT dossier_id, project_name FROM ({VISIBLE}) WHERE project_name ILIKE '%projet 1%' OR project_reference ILIKE '%projet 1%'
    OR client_name ILIKE '%projet 1%'""", "dossiers", "shares")
SIDES = f"""g AS (SELECT DISTINCT pair, {norm('designation')} AS gen_text, {words('designation', catalogue.COMPARISON_STOPWORDS)} AS a FROM gen_lines),
  r AS (SELECT DISTINCT pair, {norm('designation')} AS ref_text, {words('designation', catalogue.COMPARISON_STOPWORDS)} AS b FROM ref_lines)"""
check("j4_shared_vocabulary", f"""WITH {SIDES}, j AS (SELECT pair, gen_text, ref_text, {overlap('a', 'b')} AS overlap FROM g JOIN r USING (pair))
    SELECT * FROM j WHERE overlap >= 0.24 - 1e-9""", "gen_lines", "ref_lines")
check("j5_match_by_vocabulary", f"""WITH RECURSIVE {SIDES},
  j AS (SELECT * FROM (SELECT pair, gen_text, ref_text, {overlap('a', 'b')} AS overlap FROM g JOIN r USING (pair)) WHERE overlap >= 0.4 - 1e-9),
  gl AS (SELECT pair, gen_index, {norm('designation')} AS gen_text FROM gen_lines), rl AS (SELECT pair, ref_index, {norm('designation')} AS ref_text FROM ref_lines),
  e AS (SELECT pair, gen_index, ref_index, overlap + CAST((length(gen_text) * 7 + length(ref_text) * 13) % 101 AS DOUBLE) / 1000 AS score
        FROM j JOIN gl USING (pair, gen_text) JOIN rl USING (pair, ref_text)),
  m(pair, gs, rs, gen_index, ref_index, score) AS (
    SELECT DISTINCT pair, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM e
    UNION ALL SELECT pair, list_append(gs, g), list_append(rs, r), g, r, s FROM (
      SELECT m.pair, gs, rs, e.gen_index AS g, e.ref_index AS r, e.score AS s, row_number() OVER (PARTITION BY m.pair ORDER BY e.score DESC, e.gen_index DESC, e.ref_index DESC) AS n
      FROM m JOIN e ON e.pair = m.pair WHERE NOT list_contains(gs, e.gen_index) AND NOT list_contains(rs, e.ref_index)) WHERE n = 1)
    SELECT pair, gen_index, ref_index, score FROM m WHERE gen_index IS NOT NULL""", "gen_lines", "ref_lines")
KEYED = """km AS (SELECT pair, g.gen_index, r.ref_index FROM (SELECT pair, designation, max(gen_index) AS gen_index FROM gen_lines GROUP BY ALL) g
    JOIN (SELECT pair, designation, max(ref_index) AS ref_index FROM ref_lines GROUP BY ALL) r USING (pair, designation))"""
check("j6_unmatched", f"""WITH {KEYED} SELECT pair, 'generated' AS side, gen_index AS line_index, designation FROM gen_lines ANTI JOIN km USING (pair, gen_index)
    UNION ALL SELECT pair, 'reference', ref_index, designation FROM ref_lines ANTI JOIN km USING (pair, ref_index)""", "gen_lines", "ref_lines")
check("j7_following_heading", f"""WITH {NUMBERED} SELECT source_id, pos, lead(pos) OVER w AS next_pos, lead(code) OVER w AS next_code FROM numbered
    WINDOW w AS (PARTITION BY source_id ORDER BY pos)""", "spec_blocks")

# --------------------------------------------------------------- aggregations

check("a1_quality_stats", """WITH c AS (
    SELECT project, count(DISTINCT source_id) AS lots, count(*) FILTER (kind = 'section') AS sections, count(*) FILTER (kind = 'item') AS items,
           count(*) FILTER (kind = 'item' AND review_status <> 'validated') AS to_review,
           count(*) FILTER (kind = 'item' AND (unit_source IN ('explicit', 'rule', 'skeleton') OR origin = 'manual')) AS trusted,
           count(*) FILTER (kind = 'item' AND (quantity_source = 'explicit' OR (origin = 'manual' AND quantity IS NOT NULL))) AS measured,
           CAST(sum(CAST(confidence AS DECIMAL(20, 6))) FILTER (kind = 'item') AS DOUBLE) AS cs,
           CAST(sum(CAST(CASE WHEN unit_confidence = 0 THEN 1 ELSE unit_confidence END AS DECIMAL(20, 6))) FILTER (kind = 'item') AS DOUBLE) AS us
    FROM typed_lines GROUP BY project)
    SELECT project, lots, sections, items, to_review, items - to_review AS validated, CAST(round_even(trusted / items * 100, 0) AS INT) AS unit_coverage,
           CAST(round_even(measured / items * 100, 0) AS INT) AS quantity_coverage, round_even(cs / items, 2) AS classification_confidence,
           round_even((items - to_review) / items, 2) AS accepted_ratio,
           round_even(least(0.99::DOUBLE, cs / items * 0.58::DOUBLE + (items - to_review) / items * 0.27::DOUBLE + us / items * 0.15::DOUBLE), 2) AS average_confidence FROM c""", "typed_lines")
SUMMARY = """per AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS lc, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus <> 'O') AS rc FROM lineitem GROUP BY ALL),
  s AS (SELECT CAST(c_custkey AS VARCHAR) AS dossier_id, count(o_orderkey) AS document_count, count(o_orderkey) AS lot_count,
        CAST(coalesce(sum(lc), 0) AS BIGINT) AS line_count, CAST(coalesce(sum(rc), 0) AS BIGINT) AS review_count
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN per ON l_orderkey = o_orderkey GROUP BY c_custkey)"""
check("a2_dossier_summary", f"WITH {SUMMARY} SELECT * FROM s")
check("a3_dossier_status", f"""WITH {SUMMARY}, t AS (SELECT *, CASE WHEN document_count % 3 = 0 THEN document_count // 2 ELSE document_count END AS done FROM s)
    SELECT dossier_id, CASE WHEN done < document_count THEN 'processing' WHEN lot_count = 0 THEN 'failed' WHEN review_count > 0 THEN 'needs_review' ELSE 'ready' END AS status,
           CAST(CASE WHEN done < document_count THEN 10 + round_even(done / greatest(1, document_count) * 78, 0) ELSE 100 END AS INT) AS progress FROM t""")
TOTALS = """t AS (SELECT source_id, sum(CASE WHEN kind = 'item' AND included THEN CAST(quantity * unit_price AS DECIMAL(38, 4)) ELSE 0 END) AS ht FROM bill_lines GROUP BY source_id),
  m AS (SELECT source_id, CAST(ht AS DECIMAL(28, 8)) AS ht, CAST(ht * 0.015 AS DECIMAL(28, 8)) AS pr FROM t),
  w AS (SELECT source_id, ht, pr, ht + pr AS hp, CAST((ht + pr) * 0.2 AS DECIMAL(28, 8)) AS vat FROM m)"""
check("a4_bill_totals", f"""WITH {TOTALS} SELECT source_id, CAST(round(ht, 2) AS DOUBLE) AS total_ht, CAST(round(pr, 2) AS DOUBLE) AS prorata,
    CAST(round(hp, 2) AS DOUBLE) AS total_with_prorata, CAST(round(vat, 2) AS DOUBLE) AS vat, CAST(round(hp + vat, 2) AS DOUBLE) AS total_ttc FROM w""", "bill_lines")
check("a4_bill_rollup", f"""WITH {TOTALS}
    SELECT source_id, 'subtotal' AS row_kind, left(code, 3) AS code, CAST(round(sum(CAST(quantity * unit_price AS DECIMAL(38, 4))), 2) AS DOUBLE) AS amount
    FROM bill_lines WHERE kind = 'item' AND included AND code NOT LIKE '4.3%' GROUP BY source_id, left(code, 3)
    UNION ALL SELECT source_id, k, '', CAST(round(a, 2) AS DOUBLE) FROM (
        SELECT source_id, unnest(['total_ht', 'prorata', 'total_with_prorata', 'vat', 'total_ttc']) AS k, unnest([ht, pr, hp, vat, hp + vat]) AS a FROM w)""", "bill_lines")
BILL = """l AS (SELECT *, CASE WHEN code = '' THEN greatest(1, level) ELSE len(string_split(code, '.')) END AS depth,
         CAST(quantity * unit_price AS DECIMAL(28, 8)) AS amount FROM priced_lines),
  br AS (SELECT source_id, pos, code, level, (SELECT min(b.pos) FROM l b WHERE b.source_id = a.source_id AND b.pos > a.pos AND b.level <= a.level) AS leave
         FROM l a WHERE kind = 'section' AND depth = 2 AND NOT contains(lower(designation), 'descriptif des ouvrages')),
  bs AS (SELECT br.source_id, br.pos, br.code, br.leave, sum(coalesce(l.amount, 0)) AS amount FROM br JOIN l ON l.source_id = br.source_id AND l.pos > br.pos
         AND (br.leave IS NULL OR l.pos < br.leave) AND l.kind = 'item' AND l.included GROUP BY ALL),
  tt AS (SELECT source_id, CAST(coalesce(sum(amount) FILTER (kind = 'item' AND included), 0) AS DECIMAL(28, 4)) AS ht FROM l GROUP BY source_id),
  tw AS (SELECT source_id, CAST(ht AS DECIMAL(28, 8)) AS ht, CAST(ht * 0.015 AS DECIMAL(28, 8)) AS pr FROM tt),
  tv AS (SELECT source_id, ht, pr, ht + pr AS hp, CAST((ht + pr) * 0.2 AS DECIMAL(28, 8)) AS vat FROM tw),
  put AS (
    SELECT source_id, pos AS spot, 1 AS step, 0 AS back, kind AS row_kind, pos, code,
           CASE WHEN depth <= 2 THEN upper(CASE WHEN kind = 'item' AND NOT included THEN designation || ' (OPTION / VARIANTE)' ELSE designation END)
                WHEN kind = 'item' AND NOT included THEN designation || ' (OPTION / VARIANTE)' ELSE designation END AS designation,
           CASE WHEN kind = 'item' THEN CASE WHEN unit = '' THEN 'Ens' ELSE unit END END AS unit,
           CASE WHEN kind = 'item' THEN CAST(quantity AS DOUBLE) END AS quantity, CASE WHEN kind = 'item' THEN CAST(unit_price AS DOUBLE) END AS unit_price,
           CASE WHEN kind = 'item' THEN amount END AS amount FROM l
    UNION ALL SELECT source_id, coalesce(leave, 1000000000), 0, -pos, 'subtotal', pos, code, trim('Sous-total ' || code), NULL, NULL, NULL, amount FROM bs
    UNION ALL SELECT source_id, pos, 2, -pos, 'subtotal', pos, code, trim('Sous-total ' || code), NULL, NULL, NULL, CASE WHEN included THEN coalesce(amount, 0) ELSE 0 END
    FROM l WHERE kind = 'item' AND depth = 2
    UNION ALL SELECT source_id, 1000000000, 3, k, ['total_ht', 'prorata', 'total_with_prorata', 'vat', 'total_ttc'][k], NULL, '',
           ['TOTAL € H.T. hors prorata', 'Prorata 1.5%', 'TOTAL € H.T. compris prorata', 'TVA à 20.00 %', 'TOTAL € T.T.C.'][k], NULL, NULL, NULL, [ht, pr, hp, vat, hp + vat][k]
    FROM tv, (SELECT unnest(range(1, 6)) AS k)),
  bill AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY spot, step, back) AS row_no, row_kind, pos, code, designation, unit, quantity, unit_price,
           CAST(round(amount, 2) AS DOUBLE) AS amount FROM put)"""
check("a4_bill_rows", f"WITH {BILL} SELECT * FROM bill", "priced_lines")
UNIT_CLASS = """CASE lower({c}) WHEN 'm2' THEN 'surface' WHEN 'm²' THEN 'surface' WHEN 'ml' THEN 'longueur' WHEN 'm' THEN 'longueur' WHEN 'ens' THEN 'forfait' ELSE 'forfait' END"""
COUNTS = f"""{KEYED}, mk AS (SELECT km.pair, {UNIT_CLASS.format(c='g.unit')} = {UNIT_CLASS.format(c='r.unit')} AS ok
    FROM km JOIN gen_lines g USING (pair, gen_index) JOIN ref_lines r USING (pair, ref_index)),
  ev AS (SELECT pair, count(DISTINCT r.ref_index) AS reference_items FROM ref_lines r GROUP BY pair),
  gn AS (SELECT pair, count(*) AS generated_items, count(*) FILTER (review_status <> 'validated') AS flagged FROM gen_lines GROUP BY pair),
  mt AS (SELECT pair, count(*) AS matched, count(*) FILTER (ok) AS unit_ok FROM mk GROUP BY pair),
  ct AS (SELECT pair, coalesce(reference_items, 0) AS reference_items, coalesce(generated_items, 0) AS generated_items, coalesce(matched, 0) AS matched,
         coalesce(unit_ok, 0) AS unit_ok, coalesce(flagged, 0) AS flagged FROM ev FULL JOIN gn USING (pair) LEFT JOIN mt USING (pair))"""
RATIOS = """SELECT * EXCLUDE (rc, pc), rc AS recall, pc AS precision, CASE WHEN matched > 0 THEN unit_ok / matched ELSE 0.0::DOUBLE END AS unit_accuracy,
    CASE WHEN rc + pc > 0 THEN 2 * rc * pc / (rc + pc) ELSE 0.0::DOUBLE END AS f1 FROM (
    SELECT *, CASE WHEN reference_items > 0 THEN matched / reference_items ELSE 0.0::DOUBLE END AS rc,
           CASE WHEN generated_items > 0 THEN matched / generated_items ELSE 0.0::DOUBLE END AS pc FROM {source})"""
check("a5_evaluate_pairs", f"WITH {COUNTS} {RATIOS.format(source='ct')}", "gen_lines", "ref_lines")
check("a6_evaluate_total", f"""WITH {COUNTS}, al AS (SELECT CAST(sum(reference_items) AS BIGINT) AS reference_items, CAST(sum(generated_items) AS BIGINT) AS generated_items,
    CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(unit_ok) AS BIGINT) AS unit_ok, CAST(sum(flagged) AS BIGINT) AS flagged FROM ct) {RATIOS.format(source='al')}""", "gen_lines", "ref_lines")
check("a7_unit_source_counts", "SELECT pair, coalesce(unit_source, '?') AS unit_source, count(*) AS n FROM gen_lines GROUP BY ALL", "gen_lines")
check("a8_portfolio_totals", """WITH p AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS lc, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT o_custkey, count(*) AS projects, count(*) FILTER (o_orderstatus = 'F') AS ready, CAST(coalesce(sum(lc), 0) AS BIGINT) AS lots,
           CAST(coalesce(sum(n), 0) AS BIGINT) AS lines FROM orders LEFT JOIN p ON l_orderkey = o_orderkey GROUP BY o_custkey""")
check("a9_lot_counters", """SELECT CAST(l_orderkey AS VARCHAR) AS source_id, count(*) FILTER (l_returnflag <> 'N') AS items,
    count(*) FILTER (l_returnflag <> 'N' AND l_linestatus <> 'O') AS to_review FROM lineitem GROUP BY l_orderkey""")

# ------------------------------------------------------------- sorts, outputs

check("o1_order_lots", f"""WITH d AS (SELECT *, {norm('lot_title')} AS t FROM spec_documents)
    SELECT source_id, CAST(lot_code AS INT) AS code_number, CAST({first_rule('t', [(p, r) for _, r, p in catalogue.LOT_FAMILY_RULES], "'99'")} AS INT) AS family_rank,
           lower(lot_title) AS title_key,
           CAST(rank() OVER (ORDER BY CAST(lot_code AS INT), CAST({first_rule('t', [(p, r) for _, r, p in catalogue.LOT_FAMILY_RULES], "'99'")} AS INT), lower(lot_title)) AS INT) AS place
    FROM d""", "spec_documents")
check("o2_insert_by_code", f"""WITH known AS (SELECT * FROM typed_lines WHERE kind = 'item'), fresh AS (SELECT * REPLACE ('new_' || line_id AS line_id) FROM typed_lines WHERE kind = 'section'),
    {inserted('known', 'fresh', 'line_id, source_id')} SELECT line_id, source_id, pos FROM ranked""", "typed_lines")
check("o3_newest_first", "SELECT dossier_id, updated_at FROM dossiers", "dossiers")
check("o4_top_examples", f"""WITH {KEYED} SELECT pair, gen_index, designation FROM gen_lines ANTI JOIN km USING (pair, gen_index)
    QUALIFY row_number() OVER (PARTITION BY pair ORDER BY gen_index) <= 25""", "gen_lines", "ref_lines")
check("k1_export_contract", """WITH l AS (SELECT *, replace(source_id, 'src_', '') AS dossier, 'lot_' || left(sha1(source_id), 12) AS lot FROM spec_documents),
    r AS (SELECT 'dossier' AS record, dossier_id, NULL AS lot_id, CAST(NULL AS BIGINT) AS pos, updated_at AS generated_at, NULL AS code, NULL AS title,
            NULL AS source_document_id, NULL AS external_id, CAST(NULL AS INT) AS parent_level, NULL AS kind, NULL AS designation, NULL AS unit,
            CAST(NULL AS BOOLEAN) AS included, CAST(NULL AS INT) AS source_page, project_name AS name, project_reference AS reference, client_name AS client FROM dossiers
        UNION ALL SELECT 'lot', dossier, lot, NULL, NULL, lot_code, lot_title, source_id, lot, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM l
        UNION ALL SELECT 'line', dossier, lot, pos, NULL, code, NULL, NULL, 'ln_' || source_id || '_' || pos, level, CASE WHEN level <= 2 THEN 'section' ELSE 'item' END,
            title, CASE WHEN level > 2 THEN 'Ens' END, true, page, NULL, NULL, NULL FROM spec_headings JOIN l USING (source_id))
    SELECT *, '1.0' AS schema_version, 'metreur' AS source_application, CAST(NULL AS DOUBLE) AS quantity FROM r""", "spec_headings", "spec_documents", "dossiers")
check("k3_snapshot_revision", "SELECT '2024-01-01T00:00:00Z' AS revision, line_id, designation FROM typed_lines", "typed_lines")
check("k2_export_rows", f"""WITH {NAMED}, {BILL} SELECT lot_file, count(*) AS n_rows, max(row_no) AS last_row, count(*) FILTER (row_kind = 'subtotal') AS n_subtotals,
    max(amount) FILTER (row_kind = 'total_ttc') AS total_ttc, count(*) AS listed_rows FROM bill JOIN nm USING (source_id) GROUP BY lot_file""", "spec_documents", "priced_lines")
check("d17_reprocess", """WITH c AS (SELECT source_id, sum(length(text)) AS n FROM spec_blocks GROUP BY source_id), h AS (SELECT source_id, count(*) AS n, count(*) FILTER (pos % 5 = 0) AS e,
      count(*) FILTER (level > 2) AS items FROM spec_headings GROUP BY source_id),
    f AS (SELECT source_id, doc_id % 6 = 0 AS changed, page_count, coalesce(c.n, 0) AS chars, coalesce(h.n, 0) AS n, coalesce(h.e, 0) AS e, coalesce(h.items, 0) AS items
          FROM spec_documents LEFT JOIN c USING (source_id) LEFT JOIN h USING (source_id))
    SELECT source_id, changed, CAST(chars + CASE WHEN changed THEN 8 ELSE 0 END AS BIGINT) AS character_count, page_count, CASE WHEN NOT changed THEN n END AS kept_lines,
           CASE WHEN NOT changed THEN e END AS kept_edits, CASE WHEN NOT changed THEN CASE WHEN items = 0 THEN 'failed' ELSE 'ready' END END AS kept_status FROM f""",
      "spec_documents", "spec_blocks", "spec_headings")
