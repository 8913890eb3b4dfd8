"""Structure of documents from ordered lines: windows over one partitioning by document.

Parsing state (open section, open clause, current heading) is carried by running counts and last non-null values, so a document of
any length is one sorted pass and no row is visited twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as K
from ..functions import patterns as P
from ..functions import text as X

LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def _so_far(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def parse_units(units: DataFrame, keys: list[str], seq: str = "unit_seq", text: str = "text", page: str | None = None) -> DataFrame:
    """Units with kind (artifact, heading, definition, list_item, clause, paragraph), ids, and the section and clause they belong to.

    A heading opens a section and closes the clause; definitions and numbered lines open clauses; list markers are list items only while a
    clause is open, else (a) and the like open nested clauses. Numbers count from 1 in each document.
    """
    t = F.col(text)
    base = units.withColumn("__artifact", P.is_artifact(t)).withColumn("__head", P.heading(t)).withColumn("__term", P.definition_term(t)).withColumn("__list", P.list_item(t)).withColumn("__num", P.clause_number(t))
    head = ~F.col("__artifact") & F.col("__head.title").isNotNull()
    live = ~F.col("__artifact") & ~head
    so_far = _so_far(keys, [seq])
    base = base.withColumn("__section", F.sum(head.cast("int")).over(so_far))
    # Within a section, a line that is a definition, or numbered without being a list marker, opens a clause whatever came before;
    # a list marker that is also a number opens one only if none is open yet.
    sure = live & (F.col("__term").isNotNull() | (F.col("__list.marker").isNull() & F.col("__num.number").isNotNull()))
    maybe = live & F.col("__term").isNull() & F.col("__list.marker").isNotNull() & F.col("__num.number").isNotNull()
    inside = Window.partitionBy(*keys, "__section").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("__sure", sure).withColumn("__maybe", maybe)
    base = base.withColumn("__open", F.coalesce(F.max(F.col("__sure") | F.col("__maybe")).over(inside), F.lit(False)))
    kind = (
        F.when(F.col("__artifact"), "artifact").when(head, "heading").when(F.col("__term").isNotNull(), "definition")
        .when(F.col("__list.marker").isNotNull() & F.col("__open"), "list_item").when(F.col("__num.number").isNotNull(), "clause").otherwise("paragraph")
    )
    base = base.withColumn("kind", kind)
    opens = F.col("kind").isin("definition", "clause")
    nth = lambda cond: F.sum(cond.cast("int")).over(so_far)
    base = base.withColumn("__clause", nth(opens)).withColumn("__para", nth(F.col("kind") == "paragraph")).withColumn("__item", nth(F.col("kind") == "list_item"))
    has_clause = (opens | F.col("__open")) & ~F.col("kind").isin("artifact", "heading")
    named = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    own = (
        F.when(F.col("kind") == "heading", named("section-", F.col("__section"))).when(opens, named("clause-", F.col("__clause")))
        .when(F.col("kind") == "list_item", named("list-item-", F.col("__item"))).when(F.col("kind") == "paragraph", named("paragraph-", F.col("__para")))
    )
    number = F.when(F.col("kind") == "heading", F.col("__head.number")).when(F.col("kind") == "clause", F.col("__num.number"))
    title = F.when(F.col("kind") == "heading", F.col("__head.title")).when(F.col("kind") == "definition", F.col("__term"))
    body = F.when(F.col("kind") == "clause", F.col("__num.body")).when(F.col("kind") == "list_item", F.col("__list.body")).when(F.col("kind") == "definition", P.strip(t)).otherwise(t)
    style = F.when(F.col("kind") == "heading", F.col("__head.style")).when(F.col("kind") == "clause", F.col("__num.style")).when(F.col("kind") == "list_item", F.col("__list.style")).otherwise("none")
    clause_type = F.when(F.col("kind") == "definition", "definition").when(F.col("kind") == "clause", F.when(F.startswith(F.col("__num.number"), F.lit("(")), "nested").otherwise("standard"))
    return base.select(
        *keys, F.col(seq).alias("unit_seq"), *([F.col(page).alias("page_number")] if page else []), "kind", own.alias("id"), number.alias("number"), title.alias("title"), body.alias("body"), style.alias("style"), clause_type.alias("clause_type"),
        F.when((F.col("__section") > 0) & (F.col("kind") != "artifact"), named("section-", F.col("__section"))).alias("section_id"),
        F.when(has_clause, named("clause-", F.col("__clause"))).alias("clause_id"),
        F.last(F.when(F.col("kind") == "heading", F.col("__head.title")), ignorenulls=True).over(so_far).alias("section_title"),
    )


def members(parsed: DataFrame, keys: list[str], owner: str, kind: str) -> DataFrame:
    """Ids of one kind of each owner (section_id or clause_id), in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("unit_seq", "id"))), lambda x: x["id"])
    return parsed.filter((F.col("kind") == kind) & F.col(owner).isNotNull()).groupBy(*keys, owner).agg(ids.alias("ids"))


def parse_warnings(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Clauses outside any section and paragraphs outside any clause."""
    clause = F.col("kind").isin("definition", "clause") & F.col("section_id").isNull()
    para = (F.col("kind") == "paragraph") & F.col("clause_id").isNull()
    text = F.when(clause, F.format_string("Clause %s is not attached to a section.", F.col("id"))).when(para, F.format_string("Paragraph %s is not attached to a clause.", F.col("id")))
    return parsed.select(*keys, "unit_seq", text.alias("warning")).filter(F.col("warning").isNotNull())


def _marks(line: Column) -> tuple[Column, Column]:
    """A line's title if it is a heading, and its number if it is a clause."""
    return F.coalesce(P.heading(line)["title"], F.when(P.upper_heading(line), line)), P.clause_number(line)["number"]


def logical_lines(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Keys, page_number, seq, text, title, number: wrapped lines of a paragraph joined, unless a line starts something or the one before ends a sentence.

    pages(keys, page_number, text) are cut into lines; rows that have a line_seq are lines already.
    """
    if "line_seq" in pages.columns:
        raw = pages.select(*keys, "page_number", F.lit(0).alias("__p"), F.col("line_seq").alias("__l"), F.col(text).alias("__raw"))
    else:
        paragraphs = pages.select(*keys, "page_number", F.posexplode(F.split(text, r"\n(?U:\s)*\n+")).alias("__p", "__t"))
        raw = paragraphs.select(*keys, "page_number", "__p", F.posexplode(F.split("__t", LINE_ENDS)).alias("__l", "__raw"))
    raw = raw.withColumn("__raw", X.collapse(F.col("__raw"))).filter("__raw <> ''")
    title, number = _marks(F.col("__raw"))
    raw = raw.withColumn("__title", title).withColumn("__number", number).withColumn("__ends", F.col("__raw").rlike("[.!?:]$"))
    w = Window.partitionBy(*keys).orderBy("page_number", "__p", "__l")
    same = (F.lag("page_number").over(w) == F.col("page_number")) & (F.lag("__p").over(w) == F.col("__p"))
    new = ~F.coalesce(same, F.lit(False)) | F.col("__title").isNotNull() | F.col("__number").isNotNull() | F.coalesce(F.lag("__ends").over(w), F.lit(False))
    grouped = raw.withColumn("seq", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.array_sort(F.collect_list(F.struct("__p", "__l", "__raw", "__title", "__number")))
    got = grouped.groupBy(*keys, "page_number", "seq").agg(lines.alias("__ls"))
    joined = got.withColumn("text", F.array_join(F.transform("__ls", lambda x: x["__raw"]), " "))
    title, number = _marks(F.col("text"))  # asked again only of lines that were joined
    alone, first = F.size("__ls") == 1, F.element_at("__ls", 1)
    return joined.select(*keys, "page_number", "seq", "text", F.when(alone, first["__title"]).otherwise(title).alias("title"), F.when(alone, first["__number"]).otherwise(number).alias("number"))


def clause_candidates(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that are no heading, with their number (null if none) and the heading above them, which carries over pages."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last("title", ignorenulls=True).over(w)).filter(F.col("title").isNull()).drop("title")


def extract_clauses(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Keys, order_index, id, number, heading, text, page_number: numbered clauses, and paragraphs where none is open.

    pages as in logical_lines. A numbered line takes the unnumbered ones after it while the heading stays; once it changes, lines stand
    alone until the next number. Lines that stand alone are joined while page and heading stay and the line before does not end a sentence.
    """
    rows = clause_candidates(logical_lines(pages, keys, text), keys)
    w = Window.partitionBy(*keys).orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__seg", F.sum(F.col("number").isNotNull().cast("int")).over(so_far))
    seg = Window.partitionBy(*keys, "__seg").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__first", F.first("heading").over(seg))
    rows = rows.withColumn("__held", (F.col("__seg") > 0) & F.min(F.col("heading").eqNullSafe(F.col("__first"))).over(seg))
    before = Window.partitionBy(*keys).orderBy("seq")
    title = F.nullif(P.strip(F.col("heading")), F.lit(""))
    rows = rows.withColumn("__title", title)
    joins = (
        (F.lag("__held").over(before) == F.lit(False)) & (F.lag("__seg").over(before) == F.col("__seg")) & (F.lag("page_number").over(before) == F.col("page_number"))
        & F.lag("__title").over(before).eqNullSafe(F.col("__title")) & ~F.lag("text").over(before).rlike("[.!?:;]$")
    )
    opens = F.col("number").isNotNull() | (~F.col("__held") & ~F.coalesce(joins, F.lit(False)))
    rows = rows.withColumn("order_index", F.sum(opens.cast("int")).over(so_far) - 1)
    lines = F.array_sort(F.collect_list(F.struct("seq", "text", "number", "heading", "page_number")))
    out = rows.groupBy(*keys, "order_index").agg(lines.alias("l"))
    first = F.element_at("l", 1)
    stem = X.slug(first["number"])
    name = F.when(first["number"].isNull(), F.format_string("clause-%04d", F.col("order_index") + 1)).when(stem == "", "clause-0000").otherwise(F.concat(F.lit("clause-"), stem))
    return out.select(
        *keys, F.col("order_index").cast("int").alias("order_index"), name.alias("id"), first["number"].alias("number"), F.nullif(P.strip(first["heading"]), F.lit("")).alias("heading"),
        P.strip(F.array_join(F.transform("l", lambda x: x["text"]), " ")).alias("text"), first["page_number"].alias("page_number"),
    )


def candidate_paragraphs(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Keys, seq, paragraph: parts between blank lines, or after a point at a line's end before a capital or digit, that are usable."""
    plain = F.regexp_replace(text, "\r\n|\r", "\n")
    parts = F.split(plain, r"\n(?U:\s)*\n|(?<=\.)\n(?=[A-Z0-9])")
    found = documents.select(*keys, F.posexplode(parts).alias("seq", "__p")).select(*keys, "seq", X.collapse(F.col("__p")).alias("paragraph"))
    return found.filter(P.usable_paragraph(F.col("paragraph")))


def normalized_units(blocks: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Blocks whose normalised text (B1, compatibility step included) is not empty, numbered from 1 over the document as normalized-unit-N."""
    kept = blocks.withColumn("unit_text", X.display_text(K.compatible(F.col(text)))).filter("unit_text <> ''")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return kept.withColumn("unit_seq", n).withColumn("unit_id", F.concat(F.lit("normalized-unit-"), n.cast("string")))
