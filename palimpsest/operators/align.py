"""Alignment of clauses of two versions: scores, the document gate, greedy one-to-one matching, and number-first matching.

Candidates meet by an equi-join on the pair of documents. Only the sequence ratio and the order-dependent matching run in Python, a pair
at a time; pairs that numbers settle never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions import kernels as K
from ..functions import text as X
from ..session import stored

MATCH_THRESHOLD, GATE, FUZZY, RENUMBERED = 60.0, 50.0, 0.72, 0.92
ALIGNED = T.ArrayType(T.StructType([T.StructField("order_index", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("original_order", T.IntegerType()), T.StructField("revised_order", T.IntegerType())]))


def top_level(number: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(number, r"\."), 1), r"\("), 1)


def number_score(a: Column, b: Column, text_score: Column) -> Column:
    """G3. text_score: F1 of the two numbers, asked only where neither rule before it applies."""
    return F.when(a == b, 100.0).when(a.isNull() & b.isNull(), 50.0).when(a.isNull() | b.isNull(), 0.0).when(top_level(a) == top_level(b), 60.0).otherwise(text_score * 0.75)


def position_score(i: Column, j: Column, n: Column, m: Column) -> Column:
    """G5, not rounded: 100 less the distance of the relative places, in percent; a lone clause stands at 0."""
    place = lambda x, c: F.when(c <= 1, 0.0).otherwise(x / (c - 1))
    return F.greatest(F.lit(0.0), 100.0 - F.abs(place(i, n) - place(j, m)) * 100.0)


def likeness(a: Column, b: Column) -> Column:
    """H2, not rounded: 100 * least / greatest, 100 for two zeros."""
    return F.when(F.greatest(a, b) == 0, 100.0).otherwise(F.least(a, b) / F.greatest(a, b) * 100.0)


def _key(side: str, field: str) -> Column:
    return X.block_key(F.coalesce(F.col(f"{side}.{field}"), F.lit("")))


def cell_scores(cells: DataFrame) -> DataFrame:
    """G3 to G5 over cells (o, r) with structs of clause_index, count, number, title, section_title."""
    f1 = lambda f: K.score100_udf(_key("o", f), _key("r", f))
    scored = cells.withColumn("__n", f1("number")).withColumn("__s", f1("section_title")).withColumn("__h", f1("title"))
    o, r = (lambda f: F.col(f"o.{f}")), (lambda f: F.col(f"r.{f}"))
    one_null = lambda f: o(f).isNull() | r(f).isNull()
    scored = scored.withColumn("number_score", K.round2(number_score(o("number"), r("number"), F.col("__n"))))
    scored = scored.withColumn("section_score", F.when(o("section_title").isNull() & r("section_title").isNull(), 50.0).when(one_null("section_title"), 0.0).otherwise(F.col("__s")))
    scored = scored.withColumn("heading_score", F.when(one_null("title"), 0.0).otherwise(F.col("__h")))
    return scored.withColumn("position_score", K.round2(position_score(o("clause_index"), r("clause_index"), o("count"), r("count")))).drop("__n", "__s", "__h")


def overall_score(text: Column) -> Column:
    """G2, not rounded."""
    return F.col("number_score") * 0.30 + text * 0.25 + F.col("section_score") * 0.20 + F.col("heading_score") * 0.15 + F.col("position_score") * 0.10


def match_reason(number: Column, text: Column) -> Column:
    return F.when((number == 100.0) & (text >= 80.0), "Exact clause number and high text similarity.").when(text >= 80.0, "High text similarity exceeded the match threshold.").otherwise("Best deterministic candidate exceeded the match threshold.")


def side_clauses(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Clauses of parse_units with clause_index (from 0) and count, as score inputs."""
    w = Window.partitionBy(*keys)
    clauses = parsed.filter(F.col("kind").isin("clause", "definition"))
    return clauses.withColumn("clause_index", F.row_number().over(w.orderBy("unit_seq")) - 1).withColumn("count", F.count("*").over(w)).withColumn("text", F.col("body"))


def score_matrix(original: DataFrame, revised: DataFrame, pair: str = "pair_id", least: float | None = None) -> DataFrame:
    """G1: (pair, o, r, scores, overall) of every clause of one side with every clause of the other, within a pair.

    Cells carry no texts; those that are scored fetch them. least: cells whose overall score cannot reach it, even with the best text score
    that their lengths allow, are left out before.
    """
    fields = ["clause_index", "count", "id", "number", "title", "section_title"]
    key = X.block_key(F.coalesce("text", F.lit("")))
    side = lambda df, name: df.select(pair, F.struct(*fields, F.length(key).alias("length")).alias(name))
    texts = lambda df, i, name: df.select(pair, F.col("clause_index").alias(i), key.alias(name))
    scored = cell_scores(side(original, "o").join(side(revised, "r"), pair))
    n, m = F.col("o.length"), F.col("r.length")
    if least is not None:
        top = F.when(n + m == 0, 100.0).otherwise(F.least(n, m) * 200.0 / (n + m))
        scored = scored.filter(overall_score(top + 0.01) >= least - 0.01)  # scores are rounded to 2 digits
    scored = scored.withColumns({"__i": F.col("o.clause_index"), "__j": F.col("r.clause_index")})
    scored = scored.join(texts(original, "__i", "__x"), [pair, "__i"]).join(texts(revised, "__j", "__y"), [pair, "__j"])
    if least is not None:
        need = (least - 0.01 - overall_score(F.lit(0.0))) / 0.25
        scored = scored.withColumn("text_score", K.score100_from_udf("__x", "__y", need)).filter(F.col("text_score").isNotNull())
    else:
        scored = scored.withColumn("text_score", K.score100_udf("__x", "__y"))
    return scored.withColumn("overall", K.round2(overall_score(F.col("text_score")))).drop("__i", "__j", "__x", "__y")


def greedy_matches(scores: DataFrame, pair: str = "pair_id", threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """One-to-one matches by falling overall, text and number score; ties go to the earlier original, then the earlier revised clause."""
    found = scores.filter(F.col("overall") >= threshold).select(pair, F.col("o.clause_index").cast("int").alias("i"), F.col("r.clause_index").cast("int").alias("j"), "overall", "text_score", "number_score")

    # Sorted in the JVM by what is preferred; only the two ends of each candidate go to Python.
    prefer = F.struct((-F.col("overall")).alias("o"), (-F.col("text_score")).alias("t"), (-F.col("number_score")).alias("n"), "i", "j")
    listed = found.groupBy(pair).agg(F.array_sort(F.collect_list(prefer)).alias("l")).withColumn("keep", K.first_free_udf("l.i", "l.j"))
    chosen = listed.select(pair, F.explode(F.filter("l", lambda x, k: F.get(F.col("keep"), k))).alias("x"))
    return chosen.select(pair, "x.i", "x.j", (-F.col("x.o")).alias("overall"), (-F.col("x.t")).alias("text_score"), (-F.col("x.n")).alias("number_score"))


class Scored(NamedTuple):
    index: int
    count: int
    number: str | None
    number_key: str
    section: str | None
    title: str | None
    text: str


_kept_score = lru_cache(maxsize=1 << 16)(K.score100)  # of numbers and titles, which recur from pair to pair


@lru_cache(maxsize=1 << 16)
def _kept_number(a: str | None, b: str | None, a_key: str, b_key: str) -> float:
    """G3 of two numbers."""
    level = lambda n: n.split(".")[0].split("(")[0]
    if a is None or b is None:
        return 50.0 if a is None and b is None else 0.0
    if a == b:
        return 100.0
    return 60.0 if level(a) == level(b) else round(_kept_score(a_key, b_key) * 0.75, 2)


@lru_cache(maxsize=1 << 16)
def _kept_position(i: int, n: int, j: int, m: int) -> float:
    """G5 of clause i of n and clause j of m."""
    return round(max(0.0, 100.0 - abs((0.0 if n <= 1 else i / (n - 1)) - (0.0 if m <= 1 else j / (m - 1))) * 100.0), 2)


def _first_choices(originals: list[Scored], revised: list[Scored], threshold: float) -> list[tuple]:
    """G2 to G6 of one pair: (i, j, overall, text, number) of greedy_matches(score_matrix(...)).

    Cells wait in order of what they can score at best, by the lengths of their texts; a text is compared only when its cell comes first and
    both its ends are free. A bound is never below the score, so what is chosen is the same.
    """
    titles = lambda a, b: 0.0 if a is None or b is None else _kept_score(a, b)
    cells, rest = [], {}
    for x in originals:
        n = len(x.text)
        for y in revised:
            number = _kept_number(x.number, y.number, x.number_key, y.number_key)
            section = 50.0 if x.section is None and y.section is None else titles(x.section, y.section)
            terms = number, section, titles(x.title, y.title), _kept_position(x.index, x.count, y.index, y.count)
            same = x.text == y.text
            most = 100.0 if same else min(100.0, 200.0 * min(n, m := len(y.text)) / (n + m) + 0.01)
            if (top := _overall(most, *terms)) >= threshold:
                cells.append((-top, -most, -number, x.index, y.index, same))
                rest[x.index, y.index] = x.text, y.text, terms
    heapify(cells)
    left, right, out = set(), set(), []
    while cells:
        top, most, number, i, j, known = heappop(cells)
        if i in left or j in right:
            continue
        if known:
            left.add(i)
            right.add(j)
            out.append((i, j, -top, -most, -number))
            continue
        a, b, terms = rest[i, j]
        if (score := _overall(text := K.score100(a, b), *terms)) >= threshold:
            heappush(cells, (-score, -text, number, i, j, True))
    return out


def _overall(text: float, number: float, section: float, heading: float, position: float) -> float:
    return round(number * 0.30 + text * 0.25 + section * 0.20 + heading * 0.15 + position * 0.10, 2)


def _chosen(pair: str, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (pair, o, r) to rows of _first_choices. Lists are read flat, a field of a batch at a time, and matches go back flat."""

    def sides(lists: pa.Array) -> Iterator[list[Scored]]:
        clauses = lists.flatten()
        fields = dict(zip((f.name for f in clauses.type), clauses.flatten()))
        flat = [Scored(*x) for x in zip(*[fields[f].to_pylist() for f in Scored._fields])]
        sizes = lists.value_lengths().to_pylist()
        at = 0
        for n in sizes:
            yield flat[at : at + n]
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, (o, r) in enumerate(zip(sides(batch.column("o")), sides(batch.column("r")))):
                new = _first_choices(o, r, threshold)
                found += new
                rows += [k] * len(new)
            columns = list(zip(*found)) or [()] * 5
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(pair).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=[pair, *CHOSEN])

    return run


CHOSEN = ("i", "j", "overall", "text_score", "number_score")


def best_matches(original: DataFrame, revised: DataFrame, pair: str = "pair_id", threshold: float = MATCH_THRESHOLD, most: int = 256) -> DataFrame:
    """What greedy_matches gives of score_matrix, with one row a pair in Python. Pairs with a side of more than `most` clauses go through the matrix, which is dealt out by cells."""
    fields = [F.col("clause_index").cast("int").alias("index"), F.col("count").cast("int").alias("count"), "number", _plain("number").alias("number_key"), X.block_key(F.col("section_title")).alias("section"), X.block_key(F.col("title")).alias("title"), _plain("text").alias("text")]
    listed = lambda df, name: df.select(pair, F.struct(*fields).alias("c")).groupBy(pair).agg(F.collect_list("c").alias(name))
    long = stored(original.select(pair, F.lit(0).alias("s")).unionAll(revised.select(pair, F.lit(1).alias("s"))).groupBy(pair, "s").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(pair).distinct(), "long")
    many = not long.isEmpty()
    few = [df.join(long, pair, "left_anti") if many else df for df in (original, revised)]
    kinds = f"{pair} {original.schema[pair].dataType.simpleString()}, i int, j int, overall double, text_score double, number_score double"
    found = listed(few[0], "o").join(listed(few[1], "r"), pair).mapInArrow(_chosen(pair, threshold), kinds)
    if many:
        found = found.unionByName(greedy_matches(score_matrix(*[df.join(long, pair, "left_semi") for df in (original, revised)], pair, threshold), pair, threshold))
    return found


def _plain(field: str) -> Column:
    return X.block_key(F.coalesce(F.col(field), F.lit("")))


def alignment(original: DataFrame, revised: DataFrame, matches: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Matched and original-only clauses in original order, then revised-only ones; an unmatched original is anchored to the match before it, else after it."""
    o = original.select(pair, F.col("clause_index").cast("int").alias("i"), F.col("id").alias("original_id"))
    r = revised.select(pair, F.col("clause_index").cast("int").alias("j"), F.col("id").alias("revised_id"))
    left = o.join(matches, [pair, "i"], "left").join(r, [pair, "j"], "left")
    w = Window.partitionBy(pair).orderBy("i")
    anchor = F.coalesce("revised_id", F.last("revised_id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("revised_id", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    left = left.withColumn("anchor_id", anchor).withColumn("status", F.when(F.col("j").isNotNull(), "matched").otherwise("original_only"))
    right = r.join(matches.select(pair, "j"), [pair, "j"], "left_anti").select(pair, "j", "revised_id", F.lit("revised_only").alias("status"), F.col("revised_id").alias("anchor_id"))
    both = left.unionByName(right, allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(pair).orderBy(F.col("i").isNull(), "i", "j"))
    reason = F.when(F.col("status") == "matched", match_reason(F.col("number_score"), F.col("text_score"))).when(F.col("status") == "original_only", "No revised clause exceeded the match threshold.").otherwise("No original clause matched this revised clause.")
    warning = F.when((F.col("status") == "original_only") & F.col("anchor_id").isNull(), F.array(F.lit("NO_REVISED_ANCHOR_FOUND"))).otherwise(F.array().cast("array<string>"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return both.select(pair, F.concat(F.lit("align-"), n.cast("string")).alias("id"), n.alias("seq"), "status", "i", "j", "original_id", "revised_id", "anchor_id", zero("overall"), zero("text_score"), zero("number_score"), reason.alias("reason"), warning.alias("warnings"))


def average_best(a: DataFrame, b: DataFrame, pair: str, text: str) -> DataFrame:
    """H1: (pair, score): mean over both directions of each text's best F1 score on the other side; 100 if neither side has any, 0 if one has none."""
    side = lambda df, name: df.groupBy(pair).agg(F.collect_list(X.block_key(F.col(text))).alias(name))
    return side(a, "__x").join(side(b, "__y"), pair, "full").select(pair, K.round2(K.average_best_udf("__x", "__y")).alias("score"))


def document_gate(pairs: DataFrame, sections_o: DataFrame, sections_r: DataFrame, clauses_o: DataFrame, clauses_r: DataFrame, pair: str = "pair_id", least: float = GATE) -> DataFrame:
    """H3 over pairs(pair): heading, text, count and length scores, overall, status, reason and message."""
    heads = average_best(sections_o, sections_r, pair, "title").withColumnRenamed("score", "heading_score")
    texts = average_best(clauses_o, clauses_r, pair, "text").withColumnRenamed("score", "clause_text_score")
    size = lambda df, s: df.groupBy(pair).agg(F.count("*").alias(f"n_{s}"), F.sum(F.length("text")).alias(f"len_{s}"))
    out = pairs.select(pair).distinct().join(heads, pair, "left").join(texts, pair, "left").join(size(clauses_o, "o"), pair, "left").join(size(clauses_r, "r"), pair, "left").fillna(0, ["n_o", "n_r", "len_o", "len_r"]).fillna(100.0, ["heading_score", "clause_text_score"])
    out = out.withColumn("clause_count_score", K.round2(likeness(F.col("n_o"), F.col("n_r")))).withColumn("document_length_score", K.round2(likeness(F.col("len_o"), F.col("len_r"))))
    out = out.withColumn("overall", K.round2(F.col("heading_score") * 0.40 + F.col("clause_text_score") * 0.40 + F.col("clause_count_score") * 0.10 + F.col("document_length_score") * 0.10))
    low = F.col("overall") < least
    message = f"The uploaded documents appear to be less than {least:g}% similar. Please make sure you uploaded two versions of the same contract."
    return out.withColumn("status", F.when(low, "rejected").otherwise("accepted")).withColumn("reason", F.when(low, "LOW_DOCUMENT_SIMILARITY")).withColumn("message", F.when(low, message))


def number_matches(original: DataFrame, revised: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Each revised clause with the last original of its number (null if none): r.*, o.*, same (keys equal)."""
    cols = ["order_index", "id", "number", "heading", "text", "page_number"]
    o = original.filter(F.col("number").isNotNull()).groupBy(pair, "number").agg(F.max_by(F.struct(*cols), "order_index").alias("o"))
    r = revised.select(pair, "number", F.struct(*cols).alias("r"))
    met = r.join(o, [pair, "number"], "left")
    return met.withColumn("same", F.col("o").isNotNull() & (X.clause_key(F.col("o.text")) == X.clause_key(F.col("r.text"))))


class Clause(NamedTuple):
    order_index: int
    id: str
    number: str | None
    key: str
    head: str | None


def _align_pair(originals: list[Clause], revised: list[Clause]) -> list[dict]:
    """G15 to G18 of one pair, both sides in order: revised clauses take the original of their number, else the likest original not yet taken."""
    by_number = {c.number: c for c in originals if c.number is not None}
    taken: set[str] = set()
    rows = []

    def likest(c):
        best, top = None, 0.0
        m = SequenceMatcher(None, "", c.key, autojunk=False)  # what it knows of c serves all originals
        for x in originals:
            if x.id in taken:
                continue
            bonus = 0.05 if x.head is not None and c.head is not None and x.head == c.head else 0.0
            other = x.number is not None and c.number is not None and x.number != c.number
            least = max(RENUMBERED if other else 0.0, max(top, FUZZY) - bonus - 1e-9)  # below it x cannot be taken
            m.set_seq1(x.key)
            if m.real_quick_ratio() < least or m.quick_ratio() < least:
                continue
            score = m.ratio()
            if other and score < RENUMBERED:
                continue
            if score + bonus > top:
                best, top = x, score + bonus
        return (best, min(top, 0.99)) if best is not None and top >= FUZZY else (None, 0.0)

    for c in revised:
        x, confidence = by_number.get(c.number) if c.number is not None else None, 0.0
        if x is not None:
            confidence = 1.0 if x.key == c.key else max(0.85, SequenceMatcher(None, x.key, c.key, autojunk=False).ratio())
        else:
            x, confidence = likest(c)
        if x is not None:
            taken.add(x.id)
        rows.append(("added" if x is None else "unchanged" if x.key == c.key else "modified", confidence, None if x is None else x.order_index, c.order_index))
    for x in originals:
        if x.id not in taken:
            at = next((k for k, row in enumerate(rows) if row[3] is not None and row[3] > x.order_index), len(rows))
            rows.insert(at, ("deleted", 1.0, x.order_index, None))
    return [dict(zip(("order_index", "status", "confidence", "original_order", "revised_order"), (k, *row))) for k, row in enumerate(rows)]


@pandas_udf(ALIGNED)
def _align_udf(oi: pd.Series, oid: pd.Series, on: pd.Series, ok: pd.Series, oh: pd.Series, ri: pd.Series, rid: pd.Series, rn: pd.Series, rk: pd.Series, rh: pd.Series) -> pd.Series:
    side = lambda i, *rest: [] if i is None else [Clause(*x) for x in zip(i.tolist(), *rest)]
    return pd.Series([_align_pair(side(*x[:5]), side(*x[5:])) for x in zip(oi, oid, on, ok, oh, ri, rid, rn, rk, rh)])


def align_clauses(original: DataFrame, revised: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, order_index, status, confidence, original_order, revised_order) over clauses of extract_clauses. One row a pair goes to Python."""
    fields = [F.col("order_index").cast("int").alias("order_index"), "id", "number", X.clause_key(F.col("text")).alias("key"), X.word_key(F.col("heading")).alias("head")]
    listed = lambda df, name: df.select(pair, F.struct(*fields).alias("c")).groupBy(pair).agg(F.array_sort(F.collect_list("c")).alias(name))
    both = listed(original, "o").join(listed(revised, "r"), pair, "full")
    args = [F.col(f"{s}.{f}") for s in ("o", "r") for f in Clause._fields]
    return both.select(pair, _align_udf(*args).alias("a")).select(pair, F.inline("a"))


def open_pairs(met: DataFrame, original: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Pairs in which some revised clause without an original of its number is like enough to some original: those that numbers do not settle."""
    new = met.filter(F.col("o").isNull()).select(pair, F.col("r.number").alias("n"), X.clause_key(F.col("r.text")).alias("k"), X.word_key(F.col("r.heading")).alias("h"))
    old = original.select(pair, F.col("number").alias("m"), X.clause_key(F.col("text")).alias("l"), X.word_key(F.col("heading")).alias("g"))
    same_head = F.coalesce(F.col("h") == F.col("g"), F.lit(False))
    least = F.when(F.coalesce(F.col("n") != F.col("m"), F.lit(False)), RENUMBERED).when(same_head, FUZZY - 0.051).otherwise(FUZZY)
    longer = F.greatest(F.length("k") + F.length("l"), F.lit(1))
    met_by_size = new.join(old, pair).withColumn("least", least).filter(F.least(F.length("k"), F.length("l")) * 2.0 / longer >= F.col("least"))
    return met_by_size.filter(K.alike_udf("l", "k", "least")).select(pair).distinct()


def clause_status(original: DataFrame, revised: DataFrame, pair: str = "pair_id") -> DataFrame:
    """The rows that status counts need: (pair, status, id, number, original_text, revised_text, pages).

    Joins on numbers give them for every pair in which no clause is left to likeness; only the pairs of open_pairs go through align_clauses.
    """
    met = number_matches(original, revised, pair)
    unsettled = stored(open_pairs(met, original, pair), "open")
    cols = ["order_index", "id", "number", "heading", "text", "page_number"]
    used = met.filter(F.col("o").isNotNull()).select(pair, F.col("o.id").alias("id")).distinct()
    gone = original.join(used, [pair, "id"], "left_anti").select(pair, F.lit("deleted").alias("status"), F.struct(*cols).alias("o"))
    rows = met.select(pair, F.when(F.col("o").isNull(), "added").when(F.col("same"), "unchanged").otherwise("modified").alias("status"), "o", "r")
    rows = rows.unionByName(gone, allowMissingColumns=True).join(unsettled, pair, "left_anti")
    if not unsettled.isEmpty():
        pick = lambda df, s: df.select(pair, F.col("order_index").alias(f"{s}_order"), F.struct(*cols).alias(s[0]))
        left, right = (df.join(unsettled, pair, "left_semi") for df in (original, revised))
        full = align_clauses(left, right, pair).join(pick(left, "original"), [pair, "original_order"], "left").join(pick(right, "revised"), [pair, "revised_order"], "left")
        rows = rows.unionByName(full.select(pair, "status", "o", "r"))
    base = F.coalesce("r", "o")
    return rows.select(pair, "status", base["id"].alias("id"), base["number"].alias("number"), F.col("o.text").alias("original_text"), F.col("r.text").alias("revised_text"), F.col("o.page_number").alias("page_number_original"), F.col("r.page_number").alias("page_number_revised"))


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """H8: clauses by status for each pair."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total_clauses"), n("unchanged").alias("unchanged_clauses"), n("modified", "added", "deleted").alias("changed_clauses"),
        n("added").alias("added_clauses"), n("deleted").alias("deleted_clauses"), n("modified").alias("modified_clauses"),
    )


def best_unused_titles(original: DataFrame, revised: DataFrame, pair: str, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """G10 (dormant): each original section title in order takes the best revised title not yet taken, the first of equals, at the threshold or more."""

    def run(key: tuple, o: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        free, out = list(r.sort_values("seq").itertuples()), []
        for x in o.sort_values("seq").itertuples():
            scored = [(K.score100(x.key, y.key), -k) for k, y in enumerate(free)]
            if scored and max(scored)[0] >= threshold:
                y = free.pop(-max(scored)[1])
                out.append((key[0], x.seq, y.seq))
        return pd.DataFrame(out, columns=[pair, "original_seq", "revised_seq"])

    keyed = lambda d: d.select(pair, "seq", X.block_key(F.col("title")).alias("key"))
    return keyed(original).groupBy(pair).cogroup(keyed(revised).groupBy(pair)).applyInPandas(run, f"{pair} {original.schema[pair].dataType.simpleString()}, original_seq int, revised_seq int")
