"""Text functions against their golden literals and against Python's re."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import kernels as K
from palimpsest.functions import patterns as P
from palimpsest.functions import text as X


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_number_tokens_golden(spark):
    assert one(spark, "Dues: $2,500 after 12 tides.", X.number_tokens) == ["Dues", ":", "$2,500", "after", "12", "tides", "."]
    assert one(spark, "$7300 by 1987", X.number_tokens) == ["$730", "0", "by", "198", "7"]


TEXTS = ["Straße  “quoted” – it’s fine.", "a_b c-d (e) [f] $5; x²", "", "   ", "日本語 text\n\nnew", "soft­hyphen—dash"]


@pytest.mark.parametrize("text", TEXTS)
def test_tokenisers_against_re(spark, text):
    flat = re.sub(r"\s+", " ", text).strip()
    assert one(spark, text, X.unicode_tokens) == re.findall(r"\w+|[^\w\s]", flat)
    assert one(spark, text, X.spaced_tokens) == re.findall(r"\s+|\w+|[^\w\s]", text)
    assert one(spark, text, X.ascii_tokens) == re.findall(r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?|[^\w\s]", text)
    assert one(spark, text, X.words) == text.split()


@pytest.mark.parametrize("text", TEXTS)
def test_keys(spark, text):
    plain = text.replace("­", "")
    for a, b in {**X.QUOTES, **X.DASHES}.items():
        plain = plain.replace(a, b)
    want = re.sub(r"\s+", " ", plain).strip().casefold()
    assert one(spark, text, X.alignment_key) == want
    assert one(spark, text, X.block_key) == " ".join(text.split()).casefold()
    df = spark.createDataFrame([(text,)], "t string")
    assert one(spark, text, X.casefold) == text.casefold()
    assert df.select(K.compatible(F.col("t"))).first()[0] == unicodedata.normalize("NFKC", text)


def test_small_strings(spark):
    assert one(spark, "x" * 600, X.cut_middle) == "x" * 247 + " ... " + "x" * 248
    assert one(spark, "y" * 150, X.cut_end) == "y" * 137 + "..."
    assert one(spark, "7.1(a)", X.slug) == "7-1-a"
    assert one(spark, ". , Ships sail", X.clean_fragment) == "Ships sail"
    assert one(spark, "Row ( 3 ) boats , please", lambda t: X.detokenise(F.split(t, " "))) == "Row (3) boats, please"
    assert one(spark, "the Captain of ships and", lambda t: X.trim_edges(X.fragment_words(t))) == ["Captain", "of", "ships"]
    assert one(spark, "The a THE b", lambda t: X.first_by_key(F.split(t, " "), X.alignment_key)) == ["The", "a", "b"]


def test_detectors(spark):
    assert one(spark, "ARTICLE IX - Tides", P.heading).asDict() == {"title": "Tides", "number": "IX", "style": "article"}
    assert one(spark, "Section 6.2: Moorings", P.heading)["style"] == "section"
    assert one(spark, "1. HARBOUR DUES", P.heading)["number"] == "1"
    assert one(spark, "1. lower title", P.heading)["title"] is None
    assert one(spark, "“Vessel” means any boat", P.definition_term) == "Vessel"
    assert [one(spark, f"({c}) body text", P.list_item)["style"] for c in "abcdi"] == ["letter", "letter", "roman", "roman", "roman"]
    assert one(spark, "1.2.3(a) The body", P.clause_number)["number"] == "1.2.3(a)"
    assert one(spark, "Page 2 of 9", P.is_artifact) and one(spark, " Draft ", P.is_artifact) and not one(spark, "Page two", P.is_artifact)


def test_kernels_match_difflib(spark):
    import random
    from difflib import SequenceMatcher

    r = random.Random(5)
    rows = [("".join(r.choices("abc ", k=r.randint(0, 300))), "".join(r.choices("abc ", k=r.randint(0, 300)))) for _ in range(30)] + [("tide", "diet"), ("diet", "tide")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", K.share_udf("a", "b").alias("s"), K.exact_ratio_udf("a", "b").alias("e")).collect()
    for x in got:
        if x.a and x.b:
            assert x.s == SequenceMatcher(None, x.a, x.b).ratio() and x.e == SequenceMatcher(None, x.a, x.b, autojunk=False).ratio()
    assert spark.createDataFrame([(2.675,), (0.125,)], "v double").select(K.round2("v")).toPandas().iloc[:, 0].tolist() == [2.67, 0.12]


def test_matching_blocks_are_those_of_difflib():
    r = random.Random(11)
    for case in range(300):
        words = "abcdefgh"[: r.randint(1, 8)]
        a = [r.choice(words) for _ in range(r.randint(0, 60))]
        b = [x if r.random() < 0.8 else r.choice(words) for x in a] if case % 2 else [r.choice(words) for _ in range(r.randint(0, 60))]
        want = SequenceMatcher(None, a, b, autojunk=False)
        for small in (0, 12):
            found = K.matching_blocks(a, b, small)
            assert found == [tuple(x) for x in want.get_matching_blocks() if x.size]
            assert K.edits(found, len(a), len(b)) == want.get_opcodes()


def test_units_keep_leading_digits(spark):
    from palimpsest.sources import fixtures as FX

    docs = spark.createDataFrame([(1, "0997 tides\n1219 moors \n  \n 3 3\n404"), (2, None)], "doc_id int, text string")
    assert [tuple(r) for r in FX.units(docs).orderBy("unit_seq").collect()] == [(1, 1, "0997 tides"), (1, 2, "1219 moors"), (1, 3, "3 3"), (1, 4, "404")]


def test_fragment_key(spark):
    """What fragment_words gives is keyed by fragment_key as by alignment_key."""
    df = spark.createDataFrame([("The CAPTAIN’s 12% of $5, d'Or é Straße x’y’z 7th",)], "t string")
    both = df.select(F.explode(X.fragment_words(F.col("t"), money=True)).alias("w")).select("w", X.fragment_key(F.col("w")).alias("a"), X.alignment_key(F.col("w")).alias("b")).collect()
    assert len(both) > 8 and all(r.a == r.b for r in both) and "captain's" in {r.a for r in both}


def test_folding_tries_no_range_on_ascii_characters():
    """Earlier each letter of a text with one curly quote was held against every range of rare letters."""
    rare = [*X.FOLD_ONE, *X.FOLD_SEVERAL]
    found = X._about(rare)
    assert found.startswith(r"(?![\x00-\x7F])[") and all(re.fullmatch(found, c) for c in rare) and not any(re.search(found, chr(c)) for c in range(128))
