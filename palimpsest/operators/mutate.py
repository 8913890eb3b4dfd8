"""Deterministic mutations of contract paragraphs, and the cases of a quality benchmark built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import text as X
from ..session import stored

#: Terms and names that are exchanged, the first one present in this order.
MONTHS = "January February March April May June July August September October November December".split()
PARTIES = "Company Buyer Seller Supplier Customer Client Licensee Licensor Borrower Lender".split()
JURISDICTIONS = ["Delaware", "California", "New York", "Texas", "England", "India", "Singapore"]
PERIOD_WORDS = "confidential confidentiality termination liability indemnity notice".split()
#: The mutation types of a benchmark in their cycle.
CYCLE = ["amount changed", "date changed", "number changed", "party name changed", "jurisdiction changed", "sentence added", "sentence deleted", "phrase modified", "termination period changed", "liability cap changed"]

#: What an amount, a date, a lone number and a period look like.
AMOUNT = r"(?:US\$|\$|USD\s*)\s?[0-9][0-9,]*(?:\.[0-9]+)?"
DATE = r"\b(?:" + "|".join(MONTHS) + r")\s+[0-9]{1,2},\s+[0-9]{4}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b"
NUMBER = r"(?U)(?<![\w.])(?:[2-9]|[1-9][0-9]|[1-9][0-9]{2})(?![\w.])"
PERIOD = r"(?i)\b[0-9]{1,3}\s+(?:day|days|month|months|year|years)\b"

RESULT = ["mutation_type", "change_type", "revised_text", "expected_highlight"]


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The first place where old stands as plain text."""
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def _result(kind: str, change: str, revised: Column, highlight: Column) -> Column:
    return F.struct(F.lit(kind).alias("mutation_type"), F.lit(change).alias("change_type"), revised.alias("revised_text"), highlight.alias("expected_highlight"))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"({pattern})" if not pattern.startswith("(?") or pattern.startswith("(?:") else pattern[: pattern.index(")") + 1] + "(" + pattern[pattern.index(")") + 1 :] + ")", 1), F.lit(""))


def amount(t: Column) -> Column:
    old = _first(t, AMOUNT)
    new = F.when(F.contains(old, F.lit("$250,000")), "$500,000").otherwise("$250,000")
    return F.when(old.isNotNull(), _result("amount changed", "modified", replace_first(t, old, new), new))


def date(t: Column) -> Column:
    old, new = _first(t, DATE), F.lit("January 1, 2030")
    return F.when(old.isNotNull(), _result("date changed", "modified", replace_first(t, old, new), new))


def number(t: Column) -> Column:
    old = _first(t, NUMBER)
    new = F.when(old == "45", "60").otherwise("45")
    return F.when(old.isNotNull(), _result("number changed", "modified", replace_first(t, old, new), new))


def _term(t: Column, kind: str, terms: list[str], to) -> Column:
    out = None
    for term in terms:
        pattern, new = rf"(?U)\b{term}\b", to(term)
        revised = F.regexp_replace(t, rf"(?Us)^(.*?)\b{term}\b", f"$1{new}")
        hit = _result(kind, "modified", revised, F.lit(new))
        out = F.when(t.rlike(pattern), hit) if out is None else out.when(t.rlike(pattern), hit)
    return out


def party(t: Column) -> Column:
    return _term(t, "party name changed", PARTIES, lambda _: "Counterparty")


def jurisdiction(t: Column) -> Column:
    return _term(t, "jurisdiction changed", JURISDICTIONS, lambda x: "New York" if x == "Delaware" else "Delaware")


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])(?U:\s)+"), P.strip), lambda s: s != "")


def sentence_added(t: Column) -> Column:
    new = "The parties shall cooperate in good faith during review."
    return _result("sentence added", "added", F.concat(t, F.lit(" " + new)), F.lit(new))


def sentence_deleted(t: Column) -> Column:
    s = sentences(t)
    return F.when(F.size(s) >= 2, _result("sentence deleted", "deleted", X.collapse(replace_first(t, F.element_at(s, -1), F.lit(""))), F.lit("")))


def phrase_modified(t: Column) -> Column:
    found, phrase, extra = r"(?i)\breasonable efforts\b", "commercially reasonable efforts", "The obligation is material."
    s = sentences(t)
    first = F.when(F.size(s) > 0, F.element_at(s, 1)).otherwise(t)
    swapped = F.regexp_replace(t, r"(?is)^(.*?)\breasonable efforts\b", f"$1{phrase}")
    return F.when(t.rlike(found), _result("phrase modified", "modified", swapped, F.lit(phrase))).otherwise(_result("phrase modified", "modified", replace_first(t, first, F.concat(first, F.lit(" " + extra))), F.lit(extra)))


def clause_deleted(t: Column) -> Column:
    return _result("clause deleted", "deleted", F.lit(""), F.lit(""))


def _period(t: Column, kind: str) -> Column:
    old, new = _first(t, PERIOD), F.lit("24 months")
    named = F.lower(t).rlike("|".join(PERIOD_WORDS))
    extended = _result(kind, "modified", F.concat(t, F.lit(" The applicable period is extended to 24 months.")), F.lit("extended to 24 months"))
    return F.when(old.isNotNull(), _result(kind, "modified", replace_first(t, old, new), new)).when(named, extended)


def confidentiality_period(t: Column) -> Column:
    return F.when(t.rlike("(?i)confidential"), _period(t, "confidentiality period changed"))


def termination_period(t: Column) -> Column:
    return F.when(t.rlike("(?i)terminat|notice"), _period(t, "termination period changed"))


def liability_cap(t: Column) -> Column:
    a = amount(t)
    renamed = _result("liability cap changed", "modified", a["revised_text"], a["expected_highlight"])
    return F.when(t.rlike("(?i)liability|liable|indemn"), F.when(a.isNotNull(), renamed).otherwise(_period(t, "liability cap changed")))


MUTATIONS = {
    "amount changed": amount, "date changed": date, "number changed": number, "party name changed": party, "jurisdiction changed": jurisdiction, "sentence added": sentence_added,
    "sentence deleted": sentence_deleted, "phrase modified": phrase_modified, "clause deleted": clause_deleted, "confidentiality period changed": confidentiality_period,
    "termination period changed": termination_period, "liability cap changed": liability_cap,
}


def mutate(t: Column, preferred: str | None = None) -> Column:
    """One mutation's result (null if it does not apply), or the first that applies."""
    return MUTATIONS[preferred](t) if preferred else F.coalesce(*[f(t) for f in MUTATIONS.values()])


def quiet_snippets(t: Column) -> Column:
    """The first eight words of ten or more, and eight from the middle of eighteen or more: places that should not be highlighted."""
    w = X.words(t)
    return F.array_compact(F.array(F.when(F.size(w) >= 10, F.array_join(F.slice(w, 1, 8), " ")), F.when(F.size(w) >= 18, F.array_join(F.slice(w, F.floor(F.size(w) / 2).cast("int") + 1, 8), " "))))


def all_mutations(paragraphs: DataFrame, text: str = "paragraph") -> DataFrame:
    """Every mutation of the cycle that applies to each paragraph."""
    every = F.filter(F.array(*[MUTATIONS[k](F.col(text)) for k in CYCLE]), lambda m: m.isNotNull())
    return paragraphs.select("*", F.explode(every).alias("__m")).select("*", "__m.*").drop("__m")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with __k, their number from 0 in this order: sorted by ranges, then numbered within each range beyond the sizes of those before it."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(sorted_.withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = parts.groupBy("__p").agg(F.count("*").alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.withColumn("__at", place).join(base, "__p").withColumn("__k", F.col("__base") + F.col("__at")).drop("__p", "__base", "__at")


def build_cases(paragraphs: DataFrame, wanted: int, order: list[str], text: str = "paragraph") -> DataFrame:
    """Round robin: attempt k takes paragraph k mod n and type k mod 10; the first `wanted` attempts that apply are the cases. At most max(20 * wanted, 10 * n) attempts.

    The round robin is a join on the paragraph's number, so attempts are rows and not a loop. The first paragraphs are tried by themselves,
    more of them as long as too few apply; only then are all of them numbered.
    """
    spark, n = paragraphs.sparkSession, paragraphs.count()
    if not n:
        return spark.createDataFrame([], "case_id string, attempt bigint, original_text string, mutation_type string, change_type string, revised_text string, expected_highlight string")

    def cases(numbered: DataFrame, attempts: int) -> DataFrame:
        tried = spark.range(attempts).withColumnRenamed("id", "attempt").withColumn("__k", F.col("attempt") % n).withColumn("__type", F.col("attempt") % len(CYCLE))
        pick = F.when(F.col("__type") == 0, MUTATIONS[CYCLE[0]](F.col(text)))
        for i, kind in enumerate(CYCLE[1:], 1):
            pick = pick.when(F.col("__type") == i, MUTATIONS[kind](F.col(text)))
        rows = tried.join(numbered, "__k").withColumn("__m", pick).filter(F.col("__m").isNotNull()).orderBy("attempt").limit(wanted)
        case = F.format_string("case_%04d", F.row_number().over(Window.orderBy("attempt")))  # over the wanted cases
        return rows.withColumn("case_id", case).select("case_id", "attempt", F.col(text).alias("original_text"), "__m.*")

    most = max(20 * wanted, 10 * n)
    some = 2 * wanted
    while some < min(n, 32 * wanted):
        first = paragraphs.orderBy(*order).limit(some).withColumn("__k", F.row_number().over(Window.orderBy(*order)) - 1)  # `some` rows
        found = stored(cases(first, some), "cases")
        if found.count() == wanted:
            return found
        some *= 4
    return cases(_numbered(paragraphs, order), most)
