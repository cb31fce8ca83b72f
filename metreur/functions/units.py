"""Units, quantities and the trade family they depend on."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from metreur import catalogue
from metreur.functions.text import EDGE_LEFT, EDGE_RIGHT, UNICODE, as_column, normalize_text, trim_blanks

# fixed values: how a specification states a unit, a quantity and an option. The first letter
# is asked for before the word edge, which is dear at every place of a text.
EXPLICIT_UNIT = (
    UNICODE + "(?=u)" + EDGE_LEFT + r"(?:unité(?:\s+de\s+(?:règlement|mesure|prix))?|u\.o\.)\s*[:=]\s*"
    r"(m[²2]|m[³3]|ml|u(?:nité)?|ens(?:emble)?|forfait|kg|h(?:eure)?|mois)" + EDGE_RIGHT
)
EXPLICIT_QUANTITY = (
    UNICODE + "(?=[qn])" + EDGE_LEFT + r"(?:quantité|qté|nombre)\s*(?:totale?)?\s*(?:[:=]\s*)?(\d+(?:[.,]\d+)?)" + EDGE_RIGHT
)
OPTION = UNICODE + "(?=[ovp])" + EDGE_LEFT + r"(?:option|variante|pse|prestation\s+supplémentaire)" + EDGE_RIGHT


def lookup(table: dict, c) -> Column:
    """Value of a fixed table, null for other keys."""
    return F.element_at(F.create_map(*[F.lit(part) for pair in table.items() for part in pair]), as_column(c))


def canonical_unit(c) -> Column:
    return F.coalesce(lookup(catalogue.CANONICAL_UNITS, normalize_text(c)), F.lit(catalogue.DEFAULT_UNIT[0]))


def family_unit(unit, family) -> Column:
    """A lump sum in the notation of the trade; other units as they are."""
    unit = as_column(unit)
    lump = F.coalesce(lookup(catalogue.FAMILY_LUMP_SUM, family), F.lit("Ens"))
    return F.when(unit == "Ens", lump).otherwise(unit)


def unit_class(c) -> Column:
    raw = trim_blanks(F.coalesce(as_column(c), F.lit("")))
    return F.coalesce(
        lookup(catalogue.UNIT_CLASSES, raw),
        lookup(catalogue.UNIT_CLASSES, F.lower(raw)),
        F.lit(catalogue.OTHER_UNIT_CLASS),
    )


def searched_text(title, context) -> Column:
    return F.concat(as_column(title), F.lit(". "), F.substring(as_column(context), 1, 500))


def explicit_unit(title, context) -> Column:
    """Unit the text states, null when it states none."""
    text = searched_text(title, context)
    # a stated unit stands behind one of these two
    found = F.when(F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), F.regexp_extract(text, EXPLICIT_UNIT, 1))
    return F.when(found != "", canonical_unit(found))


def explicit_quantity(title, context) -> Column:
    """Quantity the text states, null when it states none. Dimensions never count."""
    found = F.regexp_extract(searched_text(title, context), EXPLICIT_QUANTITY, 1)
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")


def is_option(title) -> Column:
    return as_column(title).rlike(OPTION)


def is_generic_title(title, normalized: bool = False) -> Column:
    text = as_column(title) if normalized else normalize_text(title)
    return text.isin(*catalogue.GENERIC_TITLES) | text.rlike("(?i)" + catalogue.GENERIC_PATTERN)


def _runs(parsed) -> list[str] | None:
    """Runs of letters one of which is in every text the pattern matches; None when none are known."""
    best, run = None, ""

    def better(options):
        nonlocal best
        if options and all(options) and (best is None or (min(map(len, options)), -len(options)) > (min(map(len, best)), -len(best))):
            best = options

    for kind, value in parsed:
        if str(kind) == "LITERAL":
            run += chr(value).lower()
            continue
        better([run])
        run = ""
        if str(kind) == "SUBPATTERN":
            better(_runs(value[3]))
        elif str(kind) == "BRANCH":
            each = [_runs(branch) for branch in value[1]]
            better(None if None in each else [r for own in each for r in own])
        elif str(kind) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            better(_runs(value[2]))
    better([run])
    return best


#: Plain searches worth making before a pattern.
MOST_RUNS = 6


@lru_cache(maxsize=4096)
def needed_runs(pattern: str) -> tuple[str, ...]:
    """Few runs of letters one of which is in every normalised text that holds the pattern; none when there are no such."""
    found = _runs(_parser.parse(pattern)) or []
    found = list(dict.fromkeys(found))
    return tuple(found) if len(found) <= MOST_RUNS and all(len(r) > 1 for r in found) else ()


def holds(text: Column, pattern: str) -> Column:
    """The normalised text holds the pattern. A plain search spares most texts the pattern."""
    runs = [F.contains(text, F.lit(run)) for run in needed_runs(pattern)]
    # a normalised text holds no capitals: only a pattern that does needs to fold them
    found = text.rlike(pattern if re.sub(r"\\.", "", pattern).islower() else "(?i)" + pattern)
    return reduce(lambda a, b: a | b, runs) & found if runs else found


def first_match(text: Column, rules, otherwise: Column) -> Column:
    """Value of the first rule whose pattern is found in the normalised text, as one lazy CASE."""
    case = None
    for pattern, value in rules:
        found = holds(text, pattern)
        case = F.when(found, value) if case is None else case.when(found, value)
    return otherwise if case is None else case.otherwise(otherwise)


def classify_family(title, normalized: bool = False, rules=None) -> Column:
    """(family, rank) of a lot title.

    With many rules, normalise into a column first and pass it with
    ``normalized``: one value for all patterns keeps the plan small.
    """
    text = as_column(title) if normalized else normalize_text(title)
    rules = catalogue.LOT_FAMILY_RULES if rules is None else rules

    def pair(family, rank):
        return F.struct(F.lit(family).alias("family"), F.lit(rank).alias("rank"))

    return first_match(text, [(p, pair(f, r)) for f, r, p in rules], pair(*catalogue.DEFAULT_FAMILY))


def infer_unit(title, context, family, normalized_title=None) -> Column:
    """(unit, source, confidence): stated, else by trade rule, else by general rule, else default.

    ``normalized_title`` names a column that already holds the normalised title.
    """
    family = as_column(family)
    text = normalize_text(title) if normalized_title is None else as_column(normalized_title)

    def triple(unit, source, confidence):
        return F.struct(
            family_unit(unit, family).alias("unit"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")
        )

    def ruled(rules, otherwise):
        return first_match(
            text, [(pattern, triple(F.lit(unit), "rule", confidence)) for unit, confidence, pattern in rules], otherwise
        )

    default_unit, default_confidence = catalogue.DEFAULT_UNIT
    general = ruled(catalogue.UNIT_RULES, triple(F.lit(default_unit), "default", default_confidence))
    stated = explicit_unit(title, context)
    case = F.when(stated.isNotNull(), triple(stated, "explicit", catalogue.EXPLICIT_UNIT_CONFIDENCE))
    # one branch per trade: its own rules, then nothing (null falls through to the general rules)
    for name, rules in catalogue.FAMILY_UNIT_OVERRIDES.items():
        matched = first_match(text, [(pattern, F.lit(True)) for _, _, pattern in rules], F.lit(False))
        case = case.when((family == name) & matched, ruled(rules, general_null()))
    return case.otherwise(general)


def general_null() -> Column:
    return F.lit(None).cast("struct<unit:string,source:string,confidence:double>")


def line_amount(quantity, price) -> Column:
    return as_column(quantity) * as_column(price)


def display_designation(designation, included, depth) -> Column:
    text = F.when(as_column(included), as_column(designation)).otherwise(
        F.concat(as_column(designation), F.lit(" (OPTION / VARIANTE)"))
    )
    return F.when(as_column(depth) <= 2, F.upper(text)).otherwise(text)


def unit_note(unit_source) -> Column:
    source = as_column(unit_source)
    # fixed values: notes shown with a line
    return (
        F.when(source == "explicit", "Unité explicitement mentionnée dans le CCTP.")
        .when(source == "rule", "Unité proposée selon la prestation ; à confirmer.")
        .when(source == "default", "Unité forfaitaire proposée par défaut ; à confirmer.")
        .otherwise("Unité renseignée manuellement.")
    )


def source_note(page, excerpt) -> Column:
    """Where a line was read; null when it was read nowhere."""
    page, excerpt = as_column(page), trim_blanks(F.coalesce(as_column(excerpt), F.lit("")))
    paged = page.isNotNull() & (page != 0)
    label = F.when(paged, F.concat(F.lit("Source : page "), page.cast("string"))).otherwise("Source : document Word")
    quoted = F.when(excerpt != "", F.concat(F.lit("\n\n"), F.substring(excerpt, 1, 900))).otherwise("")
    return F.when(paged | (excerpt != ""), F.concat(label, quoted))


def quantity_note(quantity) -> Column:
    return F.when(
        as_column(quantity).isNull(), "Quantité non démontrée par le CCTP : cellule volontairement vide."
    )
