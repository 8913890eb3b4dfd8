"""Line and block classifiers as Column expressions. Each returns a struct whose first field is null where the pattern does not apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import block_key, casefold, collapse, words

#: The patterns of contract structure, for Java regular expressions.
ARTICLE = r"(?i)^ARTICLE(?U:\s)+([IVXLCDM]+|[0-9]+)(?U:\s)*[-:.]?(?U:\s)*(.+)$"
SECTION = r"(?i)^SECTION(?U:\s)+([0-9]+(?:\.[0-9]+)*)(?U:\s)*[-:.]?(?U:\s)*(.+)$"
NUMBERED = r"^([0-9]+)\.(?U:\s)+([A-Z](?U:[\p{L}\p{N}_\s,&/-]){1,80})$"
QUOTED_TERM = "(?i)^[\"“]([^\"”]+)[\"”](?U:\\s)+(?:means|shall mean|means and includes)\\b.+$"
NAMED_TERM = "(?i)^The term(?U:\\s)+[\"“]([^\"”]+)[\"”](?U:\\s)+(?:means|shall mean)\\b.+$"
DECIMAL_CLAUSE = r"^([0-9]+\.[0-9]+(?:\.[0-9]+)*(?:\([A-Za-z0-9]+\))?)(?U:\s)+(.+)$"
MARKER_CLAUSE = r"^(\([A-Za-z]\)|\([ivxlcdmIVXLCDM]+\))(?U:\s)+(.+)$"
ROMAN_MARKER, LETTER_MARKER, BULLET_MARKER = r"^\([ivxlcdmIVXLCDM]+\)$", r"^\([A-Za-z]\)$", r"^[•-]$"
PAGE_OF = r"(?i)^Page(?U:\s)+[0-9]+(?U:\s)+of(?U:\s)+[0-9]+$"
#: Words of contents pages and signature blocks.
NOISE_WORDS = ("page", "signature", "exhibit", "schedule")
UPPER_HEADING = r"^[A-Z](?U:[A-Z0-9\s,&/().'-]){2,80}$"
PAGE_NUMBERS = (r"^[0-9]+$", r"^page\s+[0-9]+$", r"^-\s*[0-9]+\s*-$", r"^[0-9]+\s+of\s+[0-9]+$")
BLOCK_HEADINGS = (r"^[0-9]+(?:\.[0-9]+)*\.?\s+[A-Z][\p{L}\p{N}_ ,/&()-]{2,}$", r"(?i)^section\s+[0-9]+(?:\.[0-9]+)*\s+.+$", r"(?i)^article\s+[IVXLCDM]+(?:\s+.+)?$", r"(?i)^exhibit\s+[A-Z0-9]+(?:\s+.+)?$", r"(?i)^schedule\s+[A-Z0-9]+(?:\s+.+)?$")
BLOCK_LISTS = (r"^[•*-]\s+.+", r"(?i)^\([a-z]\)\s+.+", r"(?i)^\((?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\)\s+.+", r"^[0-9]+[.)]\s+.+")
HEADING_NUMBER = r"(?i)^(?:section\s+)?([0-9]+(?:\.[0-9]+)*)(?:\.|\s)\s*(.*)$"


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends; only a text that has some is searched."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def _begins(text: Column, chars: str) -> Column:
    """Asked before patterns that begin with one of the characters: most lines need no pattern then."""
    return F.substring(text, 1, 1).isin(*chars)


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def is_artifact(text: Column) -> Column:
    """Blank, a page count, or a bare confidential/draft mark."""
    t = strip(text)
    return (t == "") | (_begins(t, "PpCcDd") & (t.rlike(PAGE_OF) | F.lower(t).isin("confidential", "draft")))


def heading(text: Column) -> Column:
    """struct(title, number, style); articles before sections before numbered titles of at most ten words."""
    t = strip(text)
    of = lambda p, style: F.struct(strip(F.regexp_extract(t, p, 2)).alias("title"), F.regexp_extract(t, p, 1).alias("number"), F.lit(style).alias("style"))
    none = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("style"))
    short = F.size(words(F.regexp_extract(t, NUMBERED, 2))) <= 10
    return F.when(~_begins(t, "AaSs0123456789"), none).when(t.rlike(ARTICLE), of(ARTICLE, "article")).when(t.rlike(SECTION), of(SECTION, "section")).when(t.rlike(NUMBERED) & short, of(NUMBERED, "decimal")).otherwise(none)


def definition_term(text: Column) -> Column:
    """D3: the defined term, null if the line defines none."""
    t = strip(text)
    open_to = _begins(t, '"“Tt')
    return F.when(open_to & t.rlike(QUOTED_TERM), strip(F.regexp_extract(t, QUOTED_TERM, 1))).when(open_to & t.rlike(NAMED_TERM), strip(F.regexp_extract(t, NAMED_TERM, 1)))


def _marker_style(marker: Column) -> Column:
    """Roman before letter: (c), (d), (i), (l), (m), (v) and (x) are roman."""
    return F.when(marker.rlike(ROMAN_MARKER), F.lit("roman")).when(marker.rlike(LETTER_MARKER), F.lit("letter"))


def list_item(text: Column) -> Column:
    """struct(marker, body, style) of a line that starts with a bullet, roman or letter marker."""
    t = strip(text)
    marker, body = F.regexp_extract(t, r"^(\S+)", 1), strip(F.regexp_extract(t, r"(?Us)^\S+\s+(.+)$", 1))
    style = F.when(marker.rlike(BULLET_MARKER), F.lit("bullet")).otherwise(_marker_style(marker))
    found = _begins(t, "(•-") & style.isNotNull() & (body != "")
    return F.struct(F.when(found, marker).alias("marker"), F.when(found, body).alias("body"), F.when(found, style).alias("style"))


def clause_number(text: Column) -> Column:
    """struct(number, body, style): a nested decimal number, or a single (letter) or (roman) marker, and what follows."""
    t = strip(text)
    decimal, marked = _begins(t, "0123456789") & t.rlike(DECIMAL_CLAUSE), _begins(t, "(") & t.rlike(MARKER_CLAUSE)
    pick = lambda i: F.when(decimal, F.regexp_extract(t, DECIMAL_CLAUSE, i)).when(marked, F.regexp_extract(t, MARKER_CLAUSE, i))
    style = F.when(decimal, F.lit("nested_decimal")).when(marked, _marker_style(F.regexp_extract(t, MARKER_CLAUSE, 1)))
    return F.struct(pick(1).alias("number"), strip(pick(2)).alias("body"), style.alias("style"))


def upper_heading(text: Column) -> Column:
    """3 to 81 capitals, digits and signs, with a letter in it."""
    return text.rlike(UPPER_HEADING) & text.rlike("[A-Z]")


def page_number_text(text: Column) -> Column:
    """D6"""
    return page_number_key(block_key(text))


def page_number_key(key: Column) -> Column:
    """D6 of a text's block_key."""
    return _any(key, PAGE_NUMBERS)


def block_type(text: Column, lines: Column, margin: Column, flat: Column | None = None) -> Column:
    """Header and footer stay; then noise, heading, list_item, table_candidate, paragraph, unknown. lines: the block's lines; flat: its collapsed text, where that is at hand."""
    t = collapse(text) if flat is None else flat
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    noise = (t == "") | page_number_key(casefold(t)) | (letters == 0) | (F.length(t) <= 2)
    shout = (letters >= 6) & (F.length(t) <= 90) & (F.upper(t) == t) & (F.size(words(t)) <= 10)
    full = F.filter(F.transform(lines, strip), lambda x: x != "")
    short = F.size(F.filter(full, lambda x: F.length(x) <= 35))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) >= 2
    spread = F.when(F.size(full) < 2, text.rlike(r"\S+\s{3,}\S+\s{3,}\S+")).otherwise((F.size(full) >= 3) & (short / F.size(full) >= 0.7))
    return (
        F.when(margin.isin("header", "footer"), margin).when(noise, F.lit("noise")).when(_any(t, BLOCK_HEADINGS) | shout, F.lit("heading"))
        .when(_any(t, BLOCK_LISTS), F.lit("list_item")).when(bars | spread, F.lit("table_candidate")).when(F.length(t) >= 35, F.lit("paragraph")).otherwise(F.lit("unknown"))
    )


def heading_level(text: Column) -> Column:
    """One more than the points in a heading's number; 1 without a number."""
    t = collapse(text)
    number = F.regexp_extract(t, HEADING_NUMBER, 1)
    return F.when(t.rlike(HEADING_NUMBER), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).otherwise(1)


def usable_paragraph(text: Column) -> Column:
    """180 to 1400 characters of prose: letters make up 45 %, 30 spaces, digits no majority, under three words of tables and contents."""
    letters, digits = F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    noise = sum((F.when(F.contains(F.lower(text), F.lit(w)), 1).otherwise(0) for w in NOISE_WORDS), F.lit(0))
    return F.length(text).between(180, 1400) & (digits <= letters) & (noise < 3) & (letters / F.length(text) >= 0.45) & (spaces >= 30)
