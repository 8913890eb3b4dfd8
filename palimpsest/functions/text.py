"""Normalisers, tokenisers and small string operators as Column expressions. They differ on purpose; each keeps its own name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a normaliser maps, and what to.
QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'"}
DASHES = {"‐": "-", "‑": "-", "–": "-", "—": "-"}
ALIGNMENT_MAP = {"\u00ad": "", "\ufffe": "-"} | QUOTES | DASHES
TOKEN_MAP = ALIGNMENT_MAP | {"‒": "-", "−": "-"}
DISPLAY_MAP = {"\u00a0": " ", "–": "-", "—": "-"} | QUOTES

#: Words too common to search for alone.
SEARCH_STOP_WORDS = "a an and are as at be by for from in is it of on or that the to with".split()
EDGE_STOP_WORDS = "the and of in to for with this that using a an".split()
COMMON_WORDS = "a an and are as at be by for from in is it of on or that the this to with".split()
UNIT_WORDS = "day days month months year years percent percentage dollar dollars usd eur gbp".split()
#: What counts as part of a word in any script: letters, numbers of any kind, and _.
WORD = r"\p{L}\p{N}_"
NO_SPACE_BEFORE = list(".,;:!?)]}")
NO_SPACE_AFTER = list("([{")


def _mapped(text: Column, table: dict[str, str]) -> Column:
    kept = [(k, v) for k, v in table.items() if v]
    gone = [k for k, v in table.items() if not v]
    return F.translate(text, "".join(k for k, _ in kept) + "".join(gone), "".join(v for _, v in kept))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda that names an expression would compute it again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What case folding does beyond lower case, by rule: to single characters, and to several."""
    one, several = {}, {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]):
        low, fold = c.lower(), c.casefold()
        if len(low) == 1 and fold != low:
            (one if len(fold) == 1 else several)[low] = fold
    return one, several


FOLD_ONE, FOLD_SEVERAL = _foldings()


def _about(chars, gap: int = 0x40) -> str:
    """A regular expression for one of the characters, none of them ASCII, or one near them: a few ranges, which are tried faster than many characters, and on ASCII characters not at all."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c - runs[-1][1] <= gap and c > 0x2FF:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return r"(?![\x00-\x7F])[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


def casefold(text: Column) -> Column:
    """Full case folding: lower case, ß as ss, and in texts that need it all else that folding changes beyond lower case."""
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    rare = {c: f for c, f in FOLD_SEVERAL.items() if c != "ß"}
    one = F.translate(low, "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
    table = F.map_from_arrays(F.split(F.lit(" ".join(rare)), " "), F.split(F.lit(" ".join(rare.values())), " "))
    apart = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    several = F.when(one.rlike(_about(rare)), apart).otherwise(one)
    # A text of as many bytes as characters is ASCII, whose folding is lower case.
    return F.when((F.octet_length(low) > F.length(low)) & low.rlike(_about([*FOLD_ONE, *rare])), several).otherwise(low)


def display_text(text: Column) -> Column:
    """B1 after the compatibility step (kernels.display_udf has both): white space, quotes and dashes made plain; case kept."""
    return collapse(_mapped(text, DISPLAY_MAP))


def alignment_key(text: Column) -> Column:
    """B2: soft hyphens dropped, quotes and dashes made plain, white space collapsed, case folded."""
    return casefold(render_text(text))


def block_key(text: Column) -> Column:
    """White space collapsed, case folded."""
    return casefold(collapse(text))


def word_key(text: Column) -> Column:
    """As alignment_key, with the figure dash and the minus sign too."""
    return casefold(collapse(_mapped(text, TOKEN_MAP)))


def word_keys(text: Column) -> Column:
    """word_key of each word of a collapsed text, in a text with the same spaces; a word's key may be empty."""
    return casefold(_mapped(text, TOKEN_MAP))


def render_text(text: Column) -> Column:
    """As alignment_key with case kept."""
    return collapse(_mapped(text, ALIGNMENT_MAP))


def visual_text(text: Column) -> Column:
    """B7's variant for visual search: punctuation and spaces stripped at both ends."""
    return F.regexp_replace(render_text(text), r"^[.,;:!? ]+|[.,;:!? ]+$", "")


def words(text: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def clause_key(text: Column) -> Column:
    """Each word by word_key, empty ones dropped, joined by one space. Made of the whole text, as word_key keeps words apart."""
    return F.trim(F.regexp_replace(word_keys(collapse(text)), " +", " "))


def unicode_tokens(text: Column) -> Column:
    """Runs of letters, digits and _ of any script, or single signs."""
    return F.regexp_extract_all(collapse(text), F.lit(rf"(?U)([{WORD}]+|[^{WORD}\s])"), F.lit(1))


def ascii_tokens(text: Column) -> Column:
    """ASCII words with an inner apostrophe, or single signs; other letters and _ are dropped."""
    return F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?|(?U:[^{WORD}\s]))"), F.lit(1))


def number_tokens(text: Column) -> Column:
    """Amounts, numbers, ASCII words, signs. The amount alternative comes first, so 2024 falls into 202 and 4."""
    return F.regexp_extract_all(text, F.lit(rf"(\$?[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\.[0-9]+)?%?|[A-Za-z]+(?:['’][A-Za-z]+)?|(?U:[^{WORD}\s]))"), F.lit(1))


def spaced_tokens(text: Column) -> Column:
    """T4: as T1 but white space is a token of its own, so the tokens spell the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?U)(\s+|[{WORD}]+|[^{WORD}\s])"), F.lit(1))


def spaced_keys(text: Column) -> Column:
    """What T4 tokens are compared by: a space for white space, else word_key."""
    return F.transform(spaced_tokens(text), lambda t: F.when(t.rlike(r"(?U)^\s+$"), F.lit(" ")).otherwise(word_key(t)))


def fragment_words(text: Column, money: bool = False) -> Column:
    sign = "$%" if money else ""
    return F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9{sign}]+(?:['’][A-Za-z0-9]+)?)"), F.lit(1))


def fragment_key(word: Column) -> Column:
    """alignment_key of one of fragment_words: it holds only ASCII and an inner apostrophe, so lower case is all its folding."""
    return F.lower(F.translate(word, "’", "'"))


def detokenise(tokens: Column, money: bool = False) -> Column:
    """Tokens joined by spaces, but none before closing signs or after opening ones."""
    opening = [*NO_SPACE_AFTER, *(["$"] if money else [])]
    tight = lambda acc, t: t.isin(*NO_SPACE_BEFORE) | F.substring(acc, -1, 1).isin(*opening)
    return F.aggregate(tokens, F.lit(""), lambda acc, t: F.when(acc == "", t).when(tight(acc, t), F.concat(acc, t)).otherwise(F.concat(acc, F.lit(" "), t)))


def clean_fragment(text: Column) -> Column:
    """No leading punctuation, no spaces at the ends."""
    return F.trim(F.regexp_replace(F.trim(text), r"^[.,;:!? ]+", ""))


def cut_middle(text: Column, most: int = 500, mark: str = " ... ") -> Column:
    """A longer text keeps its head and tail around a mark, `most` characters in all."""
    head = (most - len(mark)) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.substring(text, -(most - len(mark) - head), most)))


def cut_end(text: Column, most: int = 140) -> Column:
    """A longer text ends in three points."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def first_by_key(items: Column, key=None) -> Column:
    """C11: items whose key has not come before, in order."""
    if key is None:
        return F.array_distinct(items)
    return let(F.transform(items, lambda x: F.struct(x.alias("x"), key(x).alias("k"))), lambda j: F.transform(F.filter(j, lambda e, i: F.array_position(F.transform(j, lambda y: y["k"]), e["k"]) == i + 1), lambda e: e["x"]))


def slug(number: Column) -> Column:
    """Anything but ASCII letters and digits becomes a dash; none at the ends; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(number, "[^0-9A-Za-z]+", "-"), "^-+|-+$", ""))


def safe_stem(name: Column) -> Column:
    """A file name without its folder and ending, with only letters, digits, dots, dashes and underscores."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def number_like(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def punctuation_only(text: Column) -> Column:
    return (F.length(text) > 0) & ~text.rlike(r"(?U)[\p{L}\p{N}]")


def searchable_word(word: Column, key: Column | None = None) -> Column:
    """Two digits or more, or three characters that are no stop word. key: its alignment_key, where that is at hand."""
    key = alignment_key(word) if key is None else key
    return F.when(key.rlike("^[0-9]+$"), F.length(key) >= 2).otherwise((F.length(key) >= 3) & ~key.isin(*SEARCH_STOP_WORDS))


def searchable_phrase(phrase: Column) -> Column:
    of = lambda found: F.when(F.size(found) == 0, F.lit(False)).when(F.size(found) == 1, searchable_word(F.element_at(found, 1))).otherwise((F.length(phrase) <= 96) & F.exists(found, searchable_word))
    return let(fragment_words(phrase), of)


def windows_of(items: Column, size: int) -> Column:
    """Every run of `size` items joined by a space."""
    runs = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - size + 1), lambda i: F.array_join(F.slice(x, i, size), " "))
    return let(items, lambda x: F.when(F.size(x) >= size, runs(x)).otherwise(F.array().cast("array<string>")))


def search_fragments(text: Column, sizes: Sequence[int] = (6, 5, 4, 3, 2)) -> Column:
    """I8: the text itself and its runs of 6 to 2 words, as far as they are worth searching for: 96 characters at most, with a word that is.

    Words are judged once; a run is worth searching if one of its words is.
    """

    none = F.array().cast("array<string>")

    def of(found: Column, plain: Column, ok: Column) -> Column:
        def runs(n: int) -> Column:
            good = F.filter(F.sequence(F.lit(1), F.size(found) - n + 1), lambda i: F.array_contains(F.slice(ok, i, n), True))
            return F.when(F.size(found) >= n, F.transform(good, lambda i: F.array_join(F.slice(found, i, n), " "))).otherwise(none)

        some = F.array_contains(ok, True)
        whole = F.when(some & (F.length(plain) <= 96), F.array(plain)).otherwise(none)
        phrases = F.filter(F.concat(*[runs(n) for n in sizes]), lambda p: F.length(p) <= 96)
        single = F.array_distinct(F.when(some, F.array(plain, F.element_at(found, 1))).otherwise(none))
        return F.when(F.size(found) == 0, none).when(F.size(found) == 1, single).otherwise(F.array_distinct(F.concat(whole, phrases)))

    judged = lambda found: F.transform(found, lambda w: let(fragment_key(w), lambda k: searchable_word(w, k)))
    return let(render_text(text), lambda plain: let(fragment_words(plain), lambda found: let(judged(found), lambda ok: of(found, plain, ok))))


def trim_edges(items: Column, stop: Sequence[str] = EDGE_STOP_WORDS, key: Callable[[Column], Column] = alignment_key) -> Column:
    """Items without stop words at either end. key: fragment_key does for items of fragment_words."""

    def of(x: Column) -> Column:
        places = F.filter(F.transform(x, lambda w, i: F.when(~key(w).isin(*stop), i + 1)), lambda i: i.isNotNull())
        cut = lambda p: F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(F.slice(x, F.element_at(p, 1), F.greatest(F.element_at(p, -1) - F.element_at(p, 1) + 1, F.lit(0))))
        return let(places, cut)

    return let(items, of)


def token_fragments(text: Column) -> Column:
    """I8's variant: stop words off the edges; up to 8 words as they are, else all runs of the longest size from 8 to 3 that has any worth searching for.

    With stop words off both edges the first word is none, so the first run of 8 is always worth it; shorter runs are asked for only where a caller's stop words say otherwise.
    """
    none = F.array().cast("array<string>")
    telling = lambda w: ~fragment_key(w).isin(*EDGE_STOP_WORDS)

    def of(found: Column) -> Column:
        single = F.element_at(found, 1)
        one = number_like(single) | ((F.length(single) >= 3) & telling(single))
        good = lambda told: F.filter(F.sequence(F.lit(1), F.greatest(F.size(found) - 7, F.lit(1))), lambda i: F.array_contains(F.slice(told, i, 8), True))
        runs = let(F.transform(found, telling), lambda told: F.transform(good(told), lambda i: F.array_join(F.slice(found, i, 8), " ")))
        return F.when(F.size(found) == 0, none).when(F.size(found) == 1, F.when(one, found).otherwise(none)).when(F.size(found) <= 8, F.array(F.array_join(found, " "))).otherwise(runs)

    return let(trim_edges(fragment_words(text, money=True), key=fragment_key), of)


def visual_fragment(text: Column) -> Column:
    """A fragment worth a highlight: digits, or 8 characters with a word that is no stop word at its edges."""

    def of(key: Column, found: Column) -> Column:
        edges = ~fragment_key(F.element_at(found, 1)).isin(*EDGE_STOP_WORDS) & ~fragment_key(F.element_at(found, -1)).isin(*EDGE_STOP_WORDS)
        return F.when(F.size(found) == 0, F.lit(False)).when(number_like(key), F.lit(True)).otherwise((F.length(key) >= 8) & edges)

    return let(visual_text(text), lambda key: let(fragment_words(key, money=True), lambda found: of(key, found)))


def common_word(word: Column) -> Column:
    """A word that says nothing by itself."""
    return alignment_key(word).isin(*COMMON_WORDS)


def _highlight_word(word: Column) -> Column:
    key = alignment_key(word)
    return F.when(key.rlike("^[0-9]+$"), F.length(key) >= 2).otherwise((F.length(key) >= 8) & ~key.isin(*COMMON_WORDS))


def highlight_phrase(phrase: Column) -> Column:
    """D13 for highlights by search: 8 to 96 characters without common words at the edges and with a word worth finding, or a lone number of two digits or more."""

    def of(found: Column) -> Column:
        first = alignment_key(F.element_at(found, 1))
        short = (F.size(found) == 1) & first.rlike("^[0-9]{2,}$")
        inner = ~common_word(F.element_at(found, 1)) & ~common_word(F.element_at(found, -1)) & F.exists(found, _highlight_word)
        several = F.when(F.size(found) == 1, _highlight_word(F.element_at(found, 1))).otherwise(inner)
        return F.when(F.size(found) == 0, F.lit(False)).when(F.length(phrase) < 8, short).when(F.length(phrase) > 96, F.lit(False)).otherwise(several)

    return let(fragment_words(phrase), of)


def visual_fragments(text: Column) -> Column:
    """I8 for highlights: common words off the edges; up to four words as they are, else all runs of four words worth finding, or of three if none of four is."""
    none = F.array().cast("array<string>")

    def of(plain: Column, found: Column) -> Column:
        phrase = F.array_join(found, " ")
        runs = lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(found) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(found, i, n), " ")), highlight_phrase)
        best = let(runs(4), lambda four: F.when(F.size(four) > 0, four).otherwise(runs(3)))
        many = let(best, lambda b: F.when(F.size(b) > 0, first_by_key(b, alignment_key)).when(highlight_phrase(plain), F.array(plain)).otherwise(none))
        kept = F.when(highlight_phrase(phrase), F.array(phrase)).otherwise(none)
        single = F.when(_highlight_word(F.element_at(found, 1)), found).otherwise(none)
        return F.when(F.size(found) == 0, none).when(F.size(found) == 1, single).when(F.size(found) <= 4, kept).otherwise(many)

    return let(visual_text(text), lambda plain: let(trim_edges(fragment_words(plain), COMMON_WORDS), lambda found: of(plain, found)))


def render_fragment(fragment: Column) -> Column:
    """D13 for the renderer of word changes: a digit anywhere, or 8 characters and 8 words at most."""
    found = fragment_words(fragment, money=True)
    return (F.size(found) > 0) & (number_like(fragment) | ((F.length(fragment) >= 8) & (F.size(found) <= 8)))


def change_fragments(change_type: Column, revised: Column, fragments: Column, confidence: Column) -> Column:
    """K8: what to search for on the page of a change: an added text, a modified one's fragments, or without any its revised text if the confidence is 0.9 or more."""
    none = F.array().cast("array<string>")
    whole = F.when(F.coalesce(F.length(revised) > 0, F.lit(False)), F.array(revised)).otherwise(none)
    some = F.when(F.size(fragments) > 0, fragments).when(confidence >= 0.9, F.when(revised.isNotNull(), F.array(revised)).otherwise(none)).otherwise(none)
    candidates = F.when(change_type == "added", whole).when(change_type.isin("modified", "uncertain"), some).otherwise(none)

    def of(candidate: Column) -> Column:
        clean = F.regexp_replace(collapse(candidate), r"^[.,;:!? ]+|[.,;:!? ]+$", "")
        return let(clean, lambda c: F.when(c == "", none).otherwise(first_by_key(F.concat(F.when(render_fragment(c), F.array(c)).otherwise(none), visual_fragments(c)), alignment_key)))

    return first_by_key(F.flatten(F.transform(candidates, of)), alignment_key)


def context_markdown(kind: Column, before: Column, deleted: Column, inserted: Column, after: Column) -> Column:
    """The words around a change, deleted text as ~~text~~, inserted text as ++text++, or plain where it replaces."""
    gone = F.when((kind != "insert") & (deleted != ""), F.concat(F.lit("~~"), deleted, F.lit("~~")))
    new = F.when((kind == "insert") & (inserted != ""), F.concat(F.lit("++"), inserted, F.lit("++"))).when((kind == "replace") & (inserted != ""), inserted)
    return F.concat_ws(" ", F.nullif(before, F.lit("")), gone, new, F.nullif(after, F.lit("")))


def context_plain(before: Column, deleted: Column, inserted: Column, after: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (before, deleted, inserted, after)])
