"""Text columns: cleaning, normalising, tokens."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metreur import catalogue

# Flags that give Java patterns the usual Unicode reading: case folding beyond
# ASCII, Unicode classes, and only "\n" as a line end.
UNICODE = "(?iuUd)"
# Word edges. Java's \b does not take "²" for a letter or digit.
EDGE_LEFT = r"(?<![\p{L}\p{N}_])"
EDGE_RIGHT = r"(?![\p{L}\p{N}_])"

BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
APOSTROPHES = "‘’ʼ´`"


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_blanks(c) -> Column:
    return F.btrim(as_column(c), F.lit(BLANKS))


def _one_space(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


#: Blanks but the space. The bounds first, as in :func:`_ranges`.
_ODD_BLANK = r"[\x09-\x1f\x85-\u3000&&[\x09-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"


def single_spaced(c) -> Column:
    """Every run of blanks becomes one space. A table lookup per letter, not a class of 25 to try; most texts need none."""
    text = as_column(c)
    uneven = F.contains(text, F.lit("  ")) | text.rlike(_ODD_BLANK)
    return F.when(uneven, _one_space(F.translate(text, BLANKS, " " * len(BLANKS)))).otherwise(text)


def collapse(c) -> Column:
    """The same, none at the ends."""
    return F.btrim(single_spaced(c), F.lit(" "))


def _fold(text: str) -> str:
    """Accents, ligatures, curly apostrophes and case away; blanks untouched."""
    straight = str.maketrans(dict.fromkeys(APOSTROPHES, "'"))
    # before decomposing, which would take "´" apart, and after, which yields new ones
    text = unicodedata.normalize("NFKD", text.translate(straight)).translate(straight)
    text = "".join(ch for ch in text if not unicodedata.combining(ch))
    for pair, plain in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE")):
        text = text.replace(pair, plain)
    return text.casefold()


FREQUENT = {"œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ß": "ss", "…": "..."}


def _ranges(letters) -> str:
    """Class that holds the letters in few ranges; letters between close ones may get in."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if spans and code - spans[-1][1] <= (96 if code > 0x2FF else 1):
            spans[-1][1] = code
        else:
            spans.append([code, code])
    # the bounds first: a letter outside them, as most are, is not compared with each range
    return f"[\\x{{{spans[0][0]:x}}}-\\x{{{spans[-1][1]:x}}}&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]]"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, dict[str, str]]:
    """What folding does to each letter below U+3000 and the ligature block.

    Returns (letters, replacements, longer): letters past the end of
    ``replacements`` vanish; ``longer`` holds those that become several.
    """
    single, gone, longer = {}, [], {}
    for code in [*range(0x80, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        letter = chr(code)
        folded = _fold(letter)
        if folded == letter:
            continue
        if len(folded) == 1:
            single[letter] = folded
        elif folded:
            longer[letter] = folded
        else:
            gone.append(letter)
    single["`"] = "'"
    single.update(dict.fromkeys(BLANKS, " "))
    # frequent ones have a replacement of their own
    for letter in FREQUENT:
        longer.pop(letter, None)
    return "".join(single) + "".join(gone), "".join(single.values()), longer


def normalize_text(c) -> Column:
    """Comparison form of a text, in built-in expressions.

    Plain ASCII takes a short way of two patterns. Elsewhere one pass of ``translate``
    for letters that map to one letter or none; the rare letters that become several
    are expanded only in rows that hold one.
    """
    letters, replacements, longer = fold_table()
    text = as_column(c)
    # one literal that the optimizer folds into a map, instead of hundreds of nodes
    table = F.str_to_map(
        F.lit("\x01".join(f"{letter}\x02{folded}" for letter, folded in longer.items())), F.lit("\x01"), F.lit("\x02")
    )
    expanded = F.array_join(
        F.transform(F.split(text, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), ""
    )
    # the class may hold a few letters more: they only take the longer way to the same result
    text = F.when(text.rlike(_ranges(longer)), expanded).otherwise(text)
    for letter, folded in FREQUENT.items():
        text = F.replace(text, F.lit(letter), F.lit(folded))
    folded = F.btrim(_one_space(F.lower(F.translate(text, letters, replacements))), F.lit(" "))
    given = as_column(c)
    blank = r"[\x09-\x0d\x1c-\x1f]"
    plain = F.regexp_replace(F.lower(F.replace(given, F.lit("`"), F.lit("'"))), rf"(?:{blank}|\x20){{2,}}|{blank}", " ")
    return F.when(F.octet_length(given) != F.length(given), folded).otherwise(F.btrim(plain, F.lit(" ")))


def reads(c, *phrases: str, ends: str = " ") -> Column:
    """The normalised text, without the letters of ``ends`` behind it, is one of these phrases.

    Printable ASCII never vanishes: a text that begins with more of it than any phrase holds is
    none of them and need not be normalised. Most texts are.
    """
    most = max(len(phrase.replace(" ", "")) for phrase in phrases)
    known = "".join(rf"\x{code:02x}" for code in range(0x21, 0x7F) if chr(code) not in ends)
    text = as_column(c)
    longer = text.rlike(rf"^(?:[^{known}]*+[{known}]){{{most + 1}}}")
    return ~longer & F.rtrim(normalize_text(text), F.lit(ends)).isin(*phrases)


@F.pandas_udf(T.StringType())
def normalize_text_full(values: pd.Series) -> pd.Series:
    """The same over all of Unicode, in Arrow batches, for scripts outside the table."""
    return values.map(lambda text: None if text is None else " ".join(_fold(text).split()))


def clean_block_text(c) -> Column:
    """Text of a block: no hard or zero-width spaces, Word bullets as bullets."""
    text = F.translate(as_column(c), "\u00a0\uf0a7\u200b", " \u2022")
    return trim_blanks(F.regexp_replace(text, "[ \t]+", " "))


def clean_title(c) -> Column:
    """Title without dot leader and page number or stray punctuation, 240 letters at most."""
    text = as_column(c)
    text = F.when(F.contains(text, F.lit("...")), F.regexp_replace(text, r"(?Ud)\.{3,}\s*\d+\s*$", "")).otherwise(text)
    text = single_spaced(text)
    return F.substring(F.btrim(text, F.lit(" \t-–—:.;")), 1, 240)


def repeat_key(c) -> Column:
    """Form of a running header or footer that does not change from page to page."""
    text = F.lower(as_column(c))
    text = F.regexp_replace(text, r"(?U)\b\d+\s*/\s*\d+\b", "#/#")
    text = F.regexp_replace(text, r"(?U)\bpage\s+\d+\b", "page #")
    return F.btrim(single_spaced(text), F.lit(" -–—"))


def _tokens(normalized, stopwords) -> Column:
    # no lambda: what it stands on would be worked out by the interpreter, once for each use
    words = F.regexp_extract_all(normalized, F.lit("([a-z0-9]{2,})"), F.lit(1))
    return F.sort_array(F.array_except(words, F.array(*[F.lit(word) for word in stopwords])))


def signature(c, normalized: bool = False) -> Column:
    """Set of the significant words of a line, sorted."""
    text = as_column(c) if normalized else normalize_text(c)
    return _tokens(text, catalogue.SIGNATURE_STOPWORDS)


def comparison_tokens(c, normalized: bool = False) -> Column:
    """The same with the stop words used when comparing bills."""
    text = as_column(c) if normalized else normalize_text(c)
    return _tokens(text, catalogue.COMPARISON_STOPWORDS)


def jaccard(a, b) -> Column:
    """Shared part of two sets; 0 when either is empty."""
    a, b = as_column(a), as_column(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared)
    )


def is_dossier_id(c) -> Column:
    return as_column(c).rlike("^[0-9a-f]{32}$")


def extract_json_object(c, schema: str) -> Column:
    """Object held in an answer: the fenced part first, then first ``{`` to last ``}``."""
    text = trim_blanks(c)
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    text = F.when(text.rlike(r"(?is)```(?:json)?\s*.*?```"), fenced).otherwise(text)
    start = F.locate("{", text)
    end = F.length(text) - F.locate("}", F.reverse(text)) + 1
    found = (start > 0) & (F.locate("}", text) > 0) & (end > start)
    body = F.when(found, F.substring(text, start, end - start + 1))
    # a broken body gives a row of nulls, never an error
    return F.when(body.isNotNull(), F.from_json(body, schema, {"mode": "PERMISSIVE"}))
