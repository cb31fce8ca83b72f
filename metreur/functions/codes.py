"""Heading codes such as ``3.1.2`` and the identities built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metreur.functions.text import UNICODE, as_column, clean_title, collapse, trim_blanks

# fixed values: the forms a numbered heading, a lot mention, a contents entry,
# an opening of the works chapter and a heading style take
NUMBERED_HEADING = (
    UNICODE + r"^\s*(?:ARTICLE\s+)?([A-Z]?\d{1,3}(?:[.\-]\d{1,3}){0,6})[.)]?(?:\s*[-–—:]\s*|\s+)(\S.+?)\s*$"
)
CODE_ONLY = UNICODE + r"^\s*(?:ARTICLE\s+)?[A-Z]?\d{1,3}(?:[.\-]\d{1,3}){0,6}[.)]?\s*$"
LOT_MENTION = (
    UNICODE + r"(?=l)\bLOT\s*(?:N[°O]\s*)?([A-Z]?\d{1,3}(?:[.\-]\d{1,3})?)(?:\s*[-–—:]\s*|\s+)([^\n|]{3,100})"
)
FILE_LOT = UNICODE + r"(?s)\bLOT\s*(?:N[°O]\s*)?([A-Z]?\d{1,3}(?:[.\-]\d+)?)(.*)$"
CONTENTS_ENTRY = r"(?Ud)\.{3,}\s*\d+\s*$"
WORK_ANCHOR = (
    UNICODE + r"\b(?:descriptions?|descriptifs?)\b(?:\s+\S+){0,3}?\s+(?:ouvrages?|travaux|prestations?)\b"
)
HEADING_STYLE = r"(?iU)(?:heading|titre)\s*(\d+)"


def is_contents_entry(c) -> Column:
    return F.contains(as_column(c), F.lit("...")) & as_column(c).rlike(CONTENTS_ENTRY)


def mentions_lot(c) -> Column:
    # the plain search spares most texts the pattern
    return F.contains(F.lower(as_column(c)), F.lit("lot")) & as_column(c).rlike(LOT_MENTION)


def opens_work(c) -> Column:
    return F.contains(F.lower(as_column(c)), F.lit("descripti")) & as_column(c).rlike(WORK_ANCHOR)


def normalize_code(c) -> Column:
    return F.regexp_replace(trim_blanks(F.replace(as_column(c), F.lit("-"), F.lit("."))), r"[.\-]+$", "")


def code_parts(c) -> Column:
    return F.filter(F.split(as_column(c), r"[.\-]"), lambda part: part != "")


def code_level(c) -> Column:
    return F.size(code_parts(c))


def first_part(c) -> Column:
    return F.get(code_parts(c), F.lit(0))


def natural_code_key(c) -> Column:
    """Sort key: parts in order, numbers by value and before other texts."""

    def part_key(part):
        number = part.rlike(r"^\d+$")
        return F.struct(
            F.when(number, 0).otherwise(1).alias("kind"),
            F.when(number, F.try_to_number(F.lpad(part, F.lit(38), F.lit("0")), F.lit("9" * 38)))
            .otherwise(F.lit(0))
            .cast("decimal(38,0)")
            .alias("number"),
            F.when(number, F.lit("")).otherwise(F.lower(part)).alias("text"),
        )

    return F.transform(code_parts(c), part_key)


def style_level(style) -> Column:
    """Level 1 to 8 named by a heading style, null for other styles."""
    digits = F.regexp_extract(as_column(style), HEADING_STYLE, 1)
    level = F.coalesce(digits.try_cast("int"), F.lit(8))
    return F.when(digits != "", F.least(F.greatest(level, F.lit(1)), F.lit(8)))


def heading_level(style, code) -> Column:
    code = as_column(code)
    return F.when(code != "", code_level(code)).otherwise(F.coalesce(style_level(style), F.lit(2)))


def pad_lot_code(c) -> Column:
    code = F.upper(F.coalesce(as_column(c), F.lit("")))
    return F.when(code.rlike(r"^\d$"), F.concat(F.lit("0"), code)).otherwise(code)


def line_depth(code, level) -> Column:
    """Depth read from the code where it is one, else from the level."""
    code = F.btrim(trim_blanks(F.coalesce(as_column(code), F.lit(""))), F.lit("."))
    return F.when(
        code.rlike(r"(?iU)^[A-Z]?\d+(?:[.\-]\d+)*$"), F.size(F.split(code, r"[.\-]"))
    ).otherwise(F.greatest(F.lit(1), as_column(level)))


def filename_identity(name) -> Column:
    """(code, title) of the lot a file name announces."""
    stem = F.regexp_replace(as_column(name), r"(?s)^(.+)\.[^.]*$", "$1")
    stem = F.regexp_replace(stem, r"(?iU)\bCCTP\b", "")
    stem = collapse(F.regexp_replace(stem, r"[_\-]+", " "))
    code = F.regexp_extract(stem, FILE_LOT, 1)
    rest = F.substring(clean_title(F.regexp_extract(stem, FILE_LOT, 2)), 1, 100)
    return F.struct(
        F.when(code != "", pad_lot_code(code)).otherwise(F.lit("")).alias("code"),
        F.when(code != "", rest).otherwise(F.substring(stem, 1, 100)).alias("title"),
    )


def stable_line_id(source_id, code, title, index) -> Column:
    text = F.concat_ws("|", as_column(source_id), as_column(code), as_column(title), as_column(index).cast("string"))
    return F.concat(F.lit("ln_"), F.substring(F.sha1(text), 1, 14))


def lot_id(source_id) -> Column:
    return F.concat(F.lit("lot_"), F.substring(F.sha1(as_column(source_id)), 1, 12))


def safe_file_part(c) -> Column:
    return F.btrim(F.regexp_replace(as_column(c), r"(?U)[^\w\-]+", "_"), F.lit("_"))


def output_base(reference, name, code, title) -> Column:
    """File name of a lot without extension, before names are made unique."""
    project = safe_file_part(F.coalesce(F.nullif(as_column(reference), F.lit("")), F.nullif(as_column(name), F.lit("")), F.lit("Projet")))
    project = F.when(project == "", F.lit("Projet")).otherwise(project)
    blank_to_null = lambda c: F.nullif(trim_blanks(F.coalesce(as_column(c), F.lit(""))), F.lit(""))
    label = safe_file_part(F.concat_ws("_", F.lit("LOT"), blank_to_null(code), blank_to_null(title)))
    full = F.concat(F.lit("DPGF_"), project, F.lit("_"), label)
    return F.rtrim(F.substring(full, 1, 170), F.lit("_"))


def safe_sheet_title(c) -> Column:
    text = collapse(F.regexp_replace(as_column(c), r"[\[\]:*?/\\]", " "))
    return F.substring(F.when(text == "", F.lit("LOT")).otherwise(text), 1, 31)


def safe_original_name(path) -> Column:
    """Base name of an upload without reserved letters."""
    base = F.regexp_extract(F.regexp_replace(as_column(path), r"/+$", ""), r"(?s)([^/]*)$", 1)
    base = F.btrim(F.regexp_replace(base, r'[\x00-\x1f<>:"/\\|?*]', "_"), F.lit(" ."))
    base = F.substring(base, 1, 180)
    return F.when(base == "", F.lit("document")).otherwise(base)


