"""Pages, blocks and words with geometry: headers, columns, reading order, section paths, tokens, rectangles, and document profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as K
from ..functions import patterns as P
from ..functions import text as X

PAGE = ["doc_id", "page_index"]
BLOCK = [*PAGE, "block_index"]


def merged_box(x0="x0", y0="y0", x1="x1", y1="y1") -> list[Column]:
    """The smallest box around a group's boxes."""
    return [F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1")]


def valid_box() -> Column:
    return (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: written as a plain column, a filter on it or on what follows from it would compute it again, in lambdas for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def gathered(words: DataFrame) -> DataFrame:
    """Words with those of a block in an array ws, in no order."""
    return words.groupBy(*BLOCK, "width", "height").agg(F.collect_list(F.struct("line_index", "word_index", "text", "x0", "y0", "x1", "y1")).alias("ws"))


def blocks_of(words: DataFrame) -> DataFrame:
    """Blocks with their lines' texts, box and page size from words; words with an invalid box are left out. Words may come gathered (ws); blocks then keep them."""
    own = ["ws"] if "ws" in words.columns else []
    valid = F.filter("ws", lambda w: (w["x1"] >= w["x0"]) & (w["y1"] >= w["y0"]))
    row = lambda w: F.struct(*[w[c].alias(c) for c in ("line_index", "x0", "word_index", "text", "y0", "x1", "y1")])
    b = once(words if own else gathered(words), "__s", F.sort_array(F.transform(valid, row))).filter(F.size("__s") > 0)
    line = lambda k: F.array_join(F.transform(F.filter("__s", lambda w: w["line_index"].eqNullSafe(k)), lambda w: w["text"]), " ")
    box = [F.array_min("__s.x0").alias("x0"), F.array_min("__s.y0").alias("y0"), F.array_max("__s.x1").alias("x1"), F.array_max("__s.y1").alias("y1")]
    got = once(b, "lines", F.transform(F.array_distinct("__s.line_index"), line)).select(*BLOCK, "width", "height", "lines", *box, *own)
    return once(got, "text", F.array_join("lines", "\n")).filter(F.trim("text") != "")


def margins(blocks: DataFrame) -> DataFrame:
    """Blocks with margin: footer for page numbers anywhere, header or footer for texts that stand in the top or bottom 12 % of two pages or more, else null."""
    b = blocks.withColumn("__key", X.block_key(F.col("text"))).withColumn("__number", P.page_number_key(F.col("__key"))).withColumn("__top", F.col("y0") <= F.col("height") * 0.12).withColumn("__low", F.col("y1") >= F.col("height") * 0.88)
    same = Window.partitionBy("doc_id", "__key")  # windows, not joins: blocks keep to their document's partition

    def again(edge: str) -> Column:
        page = F.when(F.col(edge) & ~F.col("__number") & (F.col("__key") != ""), F.col("page_index"))
        return F.min(page).over(same) < F.max(page).over(same)

    b = b.withColumns({"__top_again": again("__top"), "__low_again": again("__low")})
    margin = F.when(F.col("__number"), "footer").when(F.col("__top") & F.col("__top_again"), "header").when(F.col("__low") & F.col("__low_again"), "footer")
    return b.withColumn("margin", margin).drop("__key", "__number", "__top", "__low", "__top_again", "__low_again")


def columns(blocks: DataFrame, least_blocks: int = 4, gap: float = 0.18) -> DataFrame:
    """E5: blocks with column_index (0, 1; null for margins): a page is split in the middle of its widest step in x0 if that is 18 % of its width and the halves do not overlap."""
    body = F.col("margin").isNull() & (X.collapse(F.col("text")) != "")
    b = blocks.withColumn("__body", body)
    b = b.withColumn("__next", F.lead("x0").over(Window.partitionBy(*PAGE, "__body").orderBy("x0")))
    page = Window.partitionBy(*PAGE)
    step = F.when(F.col("__body") & F.col("__next").isNotNull(), F.struct((F.col("__next") - F.col("x0")).alias("gap"), F.col("x0").alias("l"), F.col("__next").alias("r")))
    b = b.withColumns({"__n": F.count(F.when(F.col("__body"), 1)).over(page), "__g": F.max(step).over(page)})
    b = b.withColumn("__split", F.when((F.col("__n") >= least_blocks) & (F.col("__g.gap") >= F.col("width") * gap), (F.col("__g.l") + F.col("__g.r")) / 2))
    body = F.col("__body")
    left_edge = F.max(F.when(body & (F.col("x0") <= F.col("__split")), F.col("x1"))).over(page)
    right_edge = F.min(F.when(body & (F.col("x0") > F.col("__split")), F.col("x0"))).over(page)
    two = F.coalesce((left_edge <= right_edge), F.lit(False))
    return b.withColumn("column_index", F.when(body, F.when(two & (F.col("x0") > F.col("__split")), 1).otherwise(0))).drop("__body", "__next", "__n", "__g", "__split")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with place (from 1 on each page): headers, then columns from left to right and top to bottom, then footers."""
    rank = F.when(F.col("margin") == "header", -1).when(F.col("margin") == "footer", 99).otherwise(F.coalesce("column_index", F.lit(0)))
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(rank, "y0", "x0", "block_index")))


def typed(blocks: DataFrame) -> DataFrame:
    """Blocks with block_type."""
    flat = blocks.withColumn("__flat", X.collapse(F.col("text")))
    return flat.withColumn("block_type", P.block_type(F.col("text"), F.col("lines"), F.col("margin"), F.col("__flat"))).drop("__flat")


def section_paths(blocks: DataFrame) -> DataFrame:
    """Blocks with section_path: headings above, one for each level, carried over pages; margins and noise have none."""
    body = ~F.col("block_type").isin("header", "footer", "noise")
    head = body & (F.col("block_type") == "heading")
    run = Window.partitionBy("doc_id").orderBy("page_index", "place").rowsBetween(Window.unboundedPreceding, 0)
    level = F.greatest(P.heading_level(F.col("text")).cast("int"), F.lit(1))
    # A heading of level k stands at depth d = min(k, depth before + 1), which is its number n plus the least of 0 and all levels less numbers so far.
    b = blocks.withColumns({"__level": F.when(head, level), "__title": F.when(head, X.collapse(F.col("text")))}).withColumn("__n", F.count("__level").over(run))
    b = b.withColumn("__m", F.min(F.col("__level") - F.col("__n")).over(run)).withColumn("__d", F.when(F.col("__level").isNotNull(), (F.col("__n") + F.least(F.lit(0), "__m")).cast("int")))
    at = {f"__t{k}": F.last(F.when(F.col("__d") == k, F.col("__title")), ignorenulls=True).over(run) for k in range(1, FLAT_DEPTH + 1)}
    b = b.withColumns(at | {"__depth": F.coalesce(F.last("__d", ignorenulls=True).over(run), F.lit(0)), "__g": F.count(F.when(F.col("__d") <= FLAT_DEPTH, 1)).over(run)})
    deep = Window.partitionBy("doc_id", "__g").orderBy("page_index", "place").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("__deep", F.collect_list(F.when(F.col("__d") > FLAT_DEPTH, F.struct(F.col("__d").alias("d"), F.col("__title").alias("t")))).over(deep))
    none = F.array().cast("array<string>")
    below = F.aggregate("__deep", none, lambda p, x: F.concat(F.slice(p, 1, x["d"] - FLAT_DEPTH - 1), F.array(x["t"])))
    path = F.concat(F.slice(F.array(*at), F.lit(1), F.least(F.col("__depth"), F.lit(FLAT_DEPTH))), below)
    return b.withColumn("section_path", F.when(body, path).otherwise(none)).drop(*at, "__level", "__title", "__n", "__m", "__d", "__depth", "__g", "__deep")


#: Section paths to this depth are kept by windows; what stands deeper is gathered, within one heading of this depth.
FLAT_DEPTH = 4


def processed_blocks(words: DataFrame) -> DataFrame:
    """Blocks in order with column, type and section path."""
    return section_paths(typed(reading_order(columns(margins(blocks_of(words))))))


def word_tokens(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tokens numbered from 0 through a document in reading order, without margins and noise; a page that has no such token gives its words that belong to no block."""
    heading = F.when(F.size("section_path") > 0, F.element_at("section_path", -1)).alias("section_heading")
    inside = ~F.col("block_type").isin("header", "footer", "noise")
    b = blocks.filter(" and ".join(f"{c} is not null" for c in BLOCK)).select(*BLOCK, F.struct("place", "block_type", heading, inside.alias("inside")).alias("__b"))
    fields = [*BLOCK, "line_index", "word_index", "text", "x0", "y0", "x1", "y1"]
    w = words.select(*fields, X.word_key(F.col("text")).alias("normalized")).filter("normalized <> ''")
    # Words meet their blocks by a union and a window, not a join, so that words dealt by document are not dealt again.
    met = w.withColumn("__word", F.lit(True)).unionByName(b, allowMissingColumns=True).withColumn("__b", F.max("__b").over(Window.partitionBy(*BLOCK)))
    met = met.filter("__word and coalesce(__b.inside, true)").withColumn("__any", F.count("__b").over(Window.partitionBy(*PAGE)))
    every = met.filter("__b is not null or __any = 0").select(*fields, "normalized", "__b.*")
    order = Window.partitionBy("doc_id").orderBy("page_index", F.coalesce("place", F.lit(0)), F.coalesce("line_index", F.lit(10**9)), "y0", "x0", "word_index")
    name = F.when(F.col("block_type").isNotNull(), F.format_string("page-%d-block-%d", "page_index", "block_index"))
    out = every.withColumn("token_index", F.row_number().over(order) - 1)
    return out.select(
        "doc_id", "token_index", F.concat(F.lit("token-"), F.col("token_index").cast("string")).alias("id"), "text", "normalized", (F.col("page_index") + 1).alias("page_number"), "x0", "y0", "x1", "y1",
        name.alias("block_id"), F.when(F.col("line_index").isNotNull(), F.concat(name, F.lit("-line-"), F.col("line_index").cast("string"))).alias("line_id"),
        F.when(F.col("block_type").isin("paragraph", "list_item", "table_candidate"), name).alias("paragraph_id"), "section_heading",
    )


def token_lists(blocks: DataFrame) -> DataFrame:
    """E8, E9 over processed blocks of gathered words: one row a block that has tokens, with their number before it (start) and ts, its tokens in order. A block without text has none; words have a line."""
    w = blocks.filter(~F.col("block_type").isin("header", "footer", "noise"))
    order = ("line_index", "y0", "x0", "word_index", "text", "x1", "y1")
    w = once(w, "__s", F.sort_array(F.transform("ws", lambda x: F.struct(*[x[c].alias(c) for c in order])))).drop("ws")
    # Keys are made of a block's whole text, as long as its words hold no white space.
    w = once(w, "__flat", F.array_join("__s.text", " ", ""))
    w = once(w, "__keys", F.split(X.word_keys(F.col("__flat")), " "))
    plain = (F.size("__keys") == F.size("__s")) & ~F.col("__flat").rlike(r"(?U)[\s&&[^ ]]")
    w = w.withColumn("__k", F.when(plain, F.col("__keys")).otherwise(F.transform("__s", lambda x: X.word_key(x["text"]))))
    token = lambda x, k: F.struct(k.alias("normalized"), *[x[c].alias(c) for c in ("line_index", "x0", "y0", "x1", "y1", "text")])
    w = once(w, "ts", F.filter(F.zip_with("__s", "__k", token), lambda x: x["normalized"] != "")).filter(F.size("ts") > 0)
    before = Window.partitionBy("doc_id").orderBy("page_index", "place").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.when(F.size("section_path") > 0, F.element_at("section_path", -1)).alias("section_heading")
    return w.select(*BLOCK, "block_type", "place", heading, "ts").withColumn("start", F.coalesce(F.sum(F.size("ts")).over(before), F.lit(0)).cast("int"))


def listed_tokens(lists: DataFrame) -> DataFrame:
    """word_tokens of token_lists: a row for each token."""
    name = F.format_string("page-%d-block-%d", "page_index", "block_index")
    each = lists.select(*BLOCK, "block_type", "section_heading", "start", F.posexplode("ts").alias("__k", "t"))
    index = F.col("start") + F.col("__k")
    return each.select(
        "doc_id", index.alias("token_index"), F.concat(F.lit("token-"), index.cast("string")).alias("id"), "t.text", "t.normalized", (F.col("page_index") + 1).alias("page_number"), "t.x0", "t.y0", "t.x1", "t.y1",
        name.alias("block_id"), F.concat(name, F.lit("-line-"), F.col("t.line_index").cast("string")).alias("line_id"), F.when(F.col("block_type").isin("paragraph", "list_item", "table_candidate"), name).alias("paragraph_id"), "section_heading",
    )


def list_rects(lists: DataFrame, gap: float = 4.0, pad: float = 1.25) -> DataFrame:
    """token_rects by document of all tokens of token_lists: lines lie within blocks, so rectangles are joined a block at a time and numbered a page at a time."""
    t = lists.withColumn("__t", F.sort_array(F.transform("ts", lambda x: F.struct(*[x[c].alias(c) for c in ("line_index", "x0", "y0", "x1", "y1")]))))
    t = t.withColumn("__r", K.joined_boxes_udf("__t.line_index", "__t.x0", "__t.y0", "__t.x1", "__t.y1", F.lit(gap), F.lit(pad)))
    pages = t.groupBy("doc_id", (F.col("page_index") + 1).alias("page_number")).agg(F.sort_array(F.flatten(F.collect_list("__r"))).alias("rs"))
    return pages.select("doc_id", "page_number", F.posexplode("rs").alias("__k", "r")).select("doc_id", "page_number", "r.x0", "r.y0", "r.x1", "r.y1", (F.col("__k") + 1).alias("rect"))


def adapted_documents(blocks: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10: pages (doc_id, page_number, text) and documents (doc_id, title, full_text) of processed blocks.

    A page is its blocks' texts in order with a blank line between them, or where it has none the raw page text of raw(doc_id, page_number,
    text). The title is the first heading; without one it is null.
    """
    text = P.strip(F.array_join("lines", "\n"))
    full = blocks.withColumn("__t", text).filter("__t <> ''").groupBy("doc_id", (F.col("page_index") + 1).alias("page_number"))
    joined = full.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "__t"))), lambda x: x["__t"]), "\n\n").alias("__text"))
    pages = raw.select("doc_id", "page_number", "text").join(joined, ["doc_id", "page_number"], "full")
    pages = pages.select("doc_id", "page_number", F.coalesce("__text", P.strip(F.col("text")), F.lit("")).alias("text"))
    whole = P.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n\n"))
    title = F.min(F.when((F.col("block_type") == "heading") & (P.strip(F.col("text")) != ""), F.struct("page_index", "place", P.strip(F.col("text")).alias("title"))))
    titles = blocks.groupBy("doc_id").agg(title.alias("h")).select("doc_id", F.col("h.title").alias("title"))
    return pages, pages.groupBy("doc_id").agg(whole.alias("full_text")).join(titles, "doc_id", "left").select("doc_id", "title", "full_text")


def page_info(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each page's first token and the one after its last; null for pages without tokens."""
    pages = words.select("doc_id", (F.col("page_index") + 1).alias("page_number")).distinct()
    got = tokens.groupBy("doc_id", "page_number").agg(F.min("token_index").alias("start"), (F.max("token_index") + 1).alias("end"))
    return pages.join(got, ["doc_id", "page_number"], "left")


def nearest_anchor(index: Column, surviving: Column, most: int | None = None) -> Column:
    """The surviving index nearest to `index`; of two as near, the one before."""
    far = lambda x: F.struct(F.abs(x - index).alias("d"), x.alias("x"))
    best = F.array_min(F.transform(surviving, far))
    return F.when(best["d"] <= most, best["x"]) if most is not None else best["x"]


# Profiles

def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def half_even_tens(x: Column) -> Column:
    return F.bround(x / 10) * 10


def line_table(words: DataFrame) -> DataFrame:
    return words.filter(valid_box()).groupBy(*BLOCK, "line_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_index", "text"))), lambda x: x["text"]), " ").alias("line"), F.min("x0").alias("x0"))


def profile(words: DataFrame) -> DataFrame:
    """One row for each document with counts, table, column and scanned likelihood and warnings. Images, drawings and annotations are not part of a word table and count as none."""
    lines = line_table(words)
    xs = lines.groupBy(*BLOCK).agg(F.min("x0").alias("x0"))
    counts = words.groupBy("doc_id").agg(F.count_distinct("page_index").alias("page_count"), F.count("*").alias("word_count"), (F.sum(F.length("text") + 1) - 1).alias("text_char_count"))
    short = lines.groupBy("doc_id").agg(F.count("*").alias("line_count"), F.count(F.when(F.length("line") <= 28, 1)).alias("short_lines"))
    tens = xs.groupBy(*PAGE, half_even_tens(F.col("x0")).alias("x")).agg(F.count("*").alias("n"))
    repeated = tens.groupBy(*PAGE).agg(F.when(F.count("*") < 2, 0.0).otherwise(F.sum(F.when(F.col("n") >= 3, F.col("n")).otherwise(0)) / F.sum("n")).alias("s")).groupBy("doc_id").agg(F.sum("s").alias("repeated_x"))
    place = xs.select(*PAGE, "x0").unionAll(lines.select(*PAGE, "x0"))
    step = place.withColumn("__next", F.lead("x0").over(Window.partitionBy(*PAGE).orderBy("x0")))
    gap = F.max(F.when(F.col("__next") - F.col("x0") >= 90.0, F.struct((F.col("__next") - F.col("x0")).alias("gap"), F.col("x0").alias("l"), F.col("__next").alias("r"))))
    wide = step.groupBy(*PAGE).agg(F.count("*").alias("n"), gap.alias("g"))
    left = place.join(wide, PAGE).groupBy(*PAGE, "n", "g").agg(F.count(F.when(F.col("x0") <= (F.col("g.l") + F.col("g.r")) / 2, 1)).alias("l"))
    column = left.select("doc_id", F.when((F.col("n") < 4) | F.col("g").isNull(), 0.0).otherwise(clamp(F.least(F.lit(1.0), F.col("g.gap") / 180.0) * 0.7 + F.least("l", F.col("n") - F.col("l")) / F.col("n") * 0.6)).alias("c"))
    column = column.groupBy("doc_id").agg(F.avg("c").alias("column_likelihood"))
    out = counts.join(short, "doc_id").join(repeated, "doc_id").join(column, "doc_id")
    out = out.withColumn("table_likelihood", table_likelihood(F.col("line_count"), F.col("short_lines"), F.col("repeated_x"), F.lit(0), F.col("page_count")))
    out = out.withColumn("image_count", F.lit(0)).withColumn("annotation_count", F.lit(0)).withColumn("scanned_likelihood", scanned_likelihood(F.col("page_count"), F.col("text_char_count"), F.col("word_count"), F.col("image_count")))
    return out.withColumn("warnings", quality_warnings(F.col("page_count"), F.col("text_char_count"), F.col("word_count"), F.col("annotation_count"), F.col("table_likelihood"), F.col("column_likelihood"), F.col("scanned_likelihood")))


def table_likelihood(lines: Column, short: Column, repeated: Column, drawings: Column, pages: Column) -> Column:
    """J1"""
    n = F.greatest(pages, F.lit(1))
    return F.when(lines == 0, 0.0).otherwise(clamp(short / lines / 0.45 * 0.45 + repeated / n / 0.35 * 0.4 + F.least(F.lit(1.0), drawings / (n * 20)) * 0.15))


def scanned_likelihood(pages: Column, chars: Column, words: Column, images: Column) -> Column:
    """J3"""
    cpp, wpp, ipp = chars / pages, words / pages, images / pages
    low = (1.0 - F.least(F.lit(1.0), cpp / 80)) * 0.45 + (1.0 - F.least(F.lit(1.0), wpp / 15)) * 0.25 + F.least(F.lit(1.0), ipp) * 0.3
    return F.when((pages <= 0) | (images <= 0), 0.0).when((cpp >= 500) & (wpp >= 80), 0.0).otherwise(clamp(low))


def quality_warnings(pages: Column, chars: Column, words: Column, annotations: Column, table: Column, column: Column, scanned: Column) -> Column:
    """J4"""
    return F.array_compact(F.array(
        F.when(scanned >= 0.65, "PDF appears scanned or image-heavy"), F.when((pages > 0) & ((chars < pages * 80) | (words < pages * 15)), "PDF has very little extractable text"),
        F.when(annotations > 0, "PDF has existing annotations"), F.when(table >= 0.55, "PDF may contain tables"), F.when(column >= 0.55, "PDF may contain multiple columns"),
    ))


# Rectangles

def token_rects(tokens: DataFrame, keys: list[str], gap: float = 4.0, pad: float = 1.25) -> DataFrame:
    """K1: (keys, page_number, rect, x0, y0, x1, y1): changed tokens of a line merged while the space between them is 4 or less, padded, numbered by y0, x0."""
    line = F.coalesce("line_id", F.concat(F.lit("bbox-y-"), F.bround("y0", 1).cast("string")))
    t = tokens.withColumn("__line", line)
    w = Window.partitionBy(*keys, "page_number", "__line").orderBy("x0", "y0")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("__new", F.coalesce(F.col("x0") - reach > gap, F.lit(True)).cast("int")).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rects = t.groupBy(*keys, "page_number", "__line", "__g").agg(*merged_box())
    low = lambda c: F.greatest(F.lit(0.0), F.col(c) - pad).alias(c)
    rects = rects.select(*keys, "page_number", low("x0"), low("y0"), (F.col("x1") + pad).alias("x1"), (F.col("y1") + pad).alias("y1"))
    return rects.withColumn("rect", F.row_number().over(Window.partitionBy(*keys, "page_number").orderBy("y0", "x0", "x1")))


def merge_nearby(rects: Column, line: float = 2.0, gap: float = 2.0) -> Column:
    """K2: an array of rectangles, in order of y0 and x0, each joined to the merged one before it if y0 and y1 differ by 2 at most and it begins no more than 2 beyond its end."""
    order = F.transform(F.array_sort(F.transform(rects, lambda r, i: F.struct(r["y0"].alias("y0"), r["x0"].alias("x0"), i.alias("i"), r["x1"].alias("x1"), r["y1"].alias("y1")))), lambda r: F.struct(r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1")))

    def join(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = (F.abs(last["y0"] - r["y0"]) <= line) & (F.abs(last["y1"] - r["y1"]) <= line) & (r["x0"] - last["x1"] <= gap)
        grown = F.struct(F.least(last["x0"], r["x0"]).alias("x0"), F.least(last["y0"], r["y0"]).alias("y0"), F.greatest(last["x1"], r["x1"]).alias("x1"), F.greatest(last["y1"], r["y1"]).alias("y1"))
        return F.when(F.coalesce(near, F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(order, F.slice(order, 1, 0), join)


def distinct_rects(rects: Column, near: float = 2.0) -> Column:
    """K3: rectangles of an array, in order, that differ by more than 2 somewhere from every one kept before."""
    alike = lambda a, b: (F.abs(a["x0"] - b["x0"]) <= near) & (F.abs(a["y0"] - b["y0"]) <= near) & (F.abs(a["x1"] - b["x1"]) <= near) & (F.abs(a["y1"] - b["y1"]) <= near)
    return F.aggregate(rects, F.slice(rects, 1, 0), lambda kept, r: F.when(F.exists(kept, lambda k: alike(k, r)), kept).otherwise(F.concat(kept, F.array(r))))


def shrunk(y0: Column, y1: Column, by: float = 0.75) -> list[Column]:
    """K4: a rectangle of some height loses 0.75 above and below."""
    tall = y1 - y0 > 2.25
    return [F.when(tall, y0 + by).otherwise(y0), F.when(tall, y1 - by).otherwise(y1)]


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def deletion_marker(x0: Column, y0: Column, version: int = 2) -> Column:
    """K5: the marker beside a deletion: in the margin (1), or left of the word (2)."""
    box = (F.lit(24.0), y0 + 2, F.lit(44.0), y0 + 7) if version == 1 else (F.greatest(x0 - 18, F.lit(0.0)), y0 + 2, F.greatest(x0 - 6, F.lit(0.0)), y0 + 7)
    return F.struct(*[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))])


def overlaps(a: Column, b: Column) -> Column:
    """Do two boxes meet?"""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def span_boxes(annotations: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each annotation's span ids with their boxes; a missing span gives a warning."""
    each = annotations.select(*keys, "annotation_id", F.explode("span_ids").alias("span_id"))
    got = each.join(spans.select(*keys, "span_id", "x0", "y0", "x1", "y1"), [*keys, "span_id"], "left")
    return got.withColumn("warning", F.when(F.col("x0").isNull(), F.concat_ws(":", "annotation_id", F.lit("MISSING_SPAN"), "span_id")))


def capped_highlights(rects: DataFrame, keys: list[str], per_page: int = 25, per_change: int = 6) -> DataFrame:
    """At most 6 rectangles of a change on a page, and 25 changes on a page in change order: the renderer's limits, not a sample."""
    own = F.row_number().over(Window.partitionBy(*keys, "page_number", "change_seq").orderBy("y0", "x0"))
    rank = F.dense_rank().over(Window.partitionBy(*keys, "page_number").orderBy("change_seq"))
    return rects.withColumn("__own", own).withColumn("__rank", rank).filter((F.col("__own") <= per_change) & (F.col("__rank") <= per_page)).drop("__own", "__rank")


def search_pages(wanted: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """K7, search: wanted(keys, doc_id, page_number, place, fragment) with rects: boxes (x0, y0, x1, y1), one for each line, of every place on the page where the fragment's words stand, compared by alignment_key."""
    row = F.struct("block_index", "line_index", "x0", "word_index", X.alignment_key(F.col("text")).alias("k"), "y0", "x1", "y1")
    pages = words.filter(valid_box()).groupBy("doc_id", (F.col("page_index") + 1).alias("page_number")).agg(F.array_sort(F.collect_list(row)).alias("__ws"))
    met = wanted.join(pages, ["doc_id", "page_number"], "left").withColumn("__f", F.transform(X.words(F.col("fragment")), X.alignment_key)).withColumn("__ks", F.transform("__ws", lambda w: w["k"]))
    n = F.size("__f")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("__ks") - n + 1, F.lit(1))), lambda i: F.slice("__ks", i, n) == F.col("__f"))
    met = met.withColumn("__at", F.when((n > 0) & F.col("__ws").isNotNull(), starts)).drop("__ks")
    each = met.select(*keys, "place", F.explode("__at").alias("__s"), "__f", "__ws").select(*keys, "place", "__s", F.explode(F.slice("__ws", F.col("__s"), F.size("__f"))).alias("w"))
    lines = each.groupBy(*keys, "place", "__s", "w.block_index", "w.line_index").agg(*merged_box("w.x0", "w.y0", "w.x1", "w.y1"))
    rects = lines.groupBy(*keys, "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("__s", "block_index", "line_index", "x0", "y0", "x1", "y1"))), lambda r: F.struct(r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1"))).alias("rects"))
    return wanted.join(rects, [*keys, "place"], "left").withColumn("rects", F.coalesce("rects", F.array().cast(RECTS)))


RECTS = "array<struct<x0: double, y0: double, x1: double, y1: double>>"


def _shrunk_all(rects: Column) -> Column:
    def one(r: Column) -> Column:
        y0, y1 = shrunk(r["y0"], r["y1"])
        return F.struct(r["x0"].alias("x0"), y0.alias("y0"), r["x1"].alias("x1"), y1.alias("y1"))

    return F.transform(rects, one)


def highlight_by_search(annotations: DataFrame, words: DataFrame, spans: DataFrame, keys: list[str], prepared: bool = False) -> DataFrame:
    """K7: (keys, annotation_id, rects, warnings) of annotations(keys, annotation_id, annotation_type, target_id, doc_id, page_number, texts, span_ids).

    Fragments of the changed texts are searched on the target page; places that touch the target's spans count (all, if it has none). Rectangles
    are shrunk, told apart, joined along lines, and limited in number by the annotation's style: the renderer's limit, not a sample. An
    addition that is found nowhere takes its spans instead. Removals, and annotations without a target or page, have no rectangles.
    prepared: texts are fragments already (K8).
    """
    marked = annotations.filter(F.col("annotation_type").isin("added", "modified"))
    most = style_of(F.col("annotation_type"), 2)
    id = [*keys, "annotation_id"]
    fragments = X.first_by_key(F.col("texts") if prepared else F.flatten(F.transform("texts", X.visual_fragments)))
    wanted = marked.select(*id, "doc_id", "page_number", F.posexplode(fragments).alias("place", "fragment"))
    found = search_pages(wanted, words, id)
    boxes = span_boxes(marked, spans, keys)
    target = boxes.groupBy(*id).agg(F.array_sort(F.collect_list(F.when(F.col("x0").isNotNull(), F.struct("x0", "y0", "x1", "y1")))).cast(RECTS).alias("boxes"), F.array_sort(F.collect_list("warning")).alias("lost"))
    near = lambda r: (F.size("boxes") == 0) | F.exists("boxes", lambda b: overlaps(r, b))
    none = F.array().cast(RECTS)
    found = found.join(target, id, "left").withColumn("boxes", F.coalesce("boxes", none)).withColumn("rects", merge_nearby(distinct_rects(_shrunk_all(F.filter("rects", near)))))
    listed = found.groupBy(*id).agg(F.array_sort(F.collect_list(F.struct("place", "fragment", "rects"))).alias("fs"))
    pages = words.select("doc_id", (F.col("page_index") + 1).alias("page_number")).distinct().withColumn("__page", F.lit(True))
    rows = marked.join(listed, id, "left").join(target, id, "left").join(pages, ["doc_id", "page_number"], "left").withColumn("__most", most)
    rows = rows.withColumn("fs", F.coalesce("fs", F.array().cast("array<struct<place: int, fragment: string, rects: " + RECTS + ">>")))
    every = distinct_rects(F.flatten(F.transform("fs", lambda f: f["rects"])))
    rows = rows.withColumn("__all", every)
    # Rectangles of fragments beyond the one that fills the limit are never looked at, nor are their misses reported.
    used = F.filter(F.transform("fs", lambda f, i: F.struct(f.alias("f"), F.size(distinct_rects(F.flatten(F.transform(F.slice("fs", 1, i), lambda g: g["rects"])))).alias("before"))), lambda x: x["before"] < F.col("__most"))
    name = lambda *x: F.concat_ws(":", "annotation_id", *x)
    missing = F.transform(F.filter(used, lambda x: F.size(x["f"]["rects"]) == 0), lambda x: name(F.lit("MISSING_FRAGMENT"), x["f"]["fragment"]))
    limited = F.when(F.size("__all") >= F.col("__most"), F.array(name(F.lit("HIGHLIGHT_RECTS_LIMITED"), F.col("__most").cast("string")))).otherwise(F.array().cast("array<string>"))
    span_rects = F.slice(merge_nearby(distinct_rects(_shrunk_all(F.coalesce("boxes", none)))), F.lit(1), F.col("__most"))
    empty = F.array().cast("array<string>")
    hit, added = F.size("__all") > 0, F.col("annotation_type") == "added"
    nothing = F.when(F.size("fs") > 0, F.array(name(F.lit("NO_CHANGED_FRAGMENT_HIGHLIGHTED")))).otherwise(F.array(name(F.lit("NO_VISUAL_FRAGMENTS"))))
    rest = F.when(hit, limited).when(added, F.coalesce("lost", empty)).otherwise(nothing)
    ready = F.col("target_id").isNotNull() & F.col("page_number").isNotNull() & F.col("__page").isNotNull()
    warnings = F.when(F.col("target_id").isNull() | F.col("page_number").isNull(), F.array(name(F.lit("SKIPPED_HIGHLIGHT_WITHOUT_TARGET")))).when(F.col("__page").isNull(), F.array(name(F.lit("MISSING_RENDER_TARGET_PAGE")))).otherwise(F.concat(missing, rest))
    rects = F.when(~ready, none).when(hit, F.slice("__all", F.lit(1), F.col("__most"))).when(added, span_rects).otherwise(none)
    return rows.select(*id, rects.alias("rects"), warnings.alias("warnings"))


#: Kinds of annotation that a comparison never writes.
UNWANTED = ["Text", "Square", "FreeText", "Rect"]


def page_diagnostics(annotations: DataFrame, keys: list[str], dense_count: int = 25, dense_area: float = 0.18) -> DataFrame:
    """H12, J7 over annotations(keys, page_number, kind, area, page_area): highlights and their area for each page, and whether it is dense. kind: highlight, or another annotation's."""
    mark = F.lower("kind") == "highlight"
    got = annotations.groupBy(*keys, "page_number").agg(
        F.count("*").alias("annotations"), F.count(F.when(mark, 1)).alias("highlights"), F.count(F.when(F.col("kind").isin(*UNWANTED), 1)).alias("unwanted"), F.sum(F.when(mark, F.col("area")).otherwise(0.0)).alias("__area"), F.max("page_area").alias("__page")
    )
    dense = (F.col("highlights") > dense_count) | ((F.col("highlights") > 0) & (F.col("area_ratio") > dense_area))
    return got.withColumn("area_ratio", F.col("__area") / F.greatest("__page", F.lit(1.0))).withColumn("dense", dense).drop("__area", "__page")


def render_totals(annotations: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """H12 over annotations(keys, kind) and their page_diagnostics: annotations by kind, unwanted ones, dense pages, and the most highlights on a page."""
    kinds = annotations.groupBy(*keys, "kind").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("annotation_counts"))
    dense = F.array_sort(F.collect_list(F.when(F.col("dense"), F.col("page_number"))))
    return kinds.join(pages.groupBy(*keys).agg(F.sum("unwanted").alias("unwanted"), dense.alias("dense_pages"), F.max("highlights").alias("max_highlights_on_page")), keys)


#: J8, the look of each change: colour (red, green, blue), opacity, most rectangles.
STYLES = {"added": ((0.55, 0.90, 0.55), 0.28, 6), "modified": ((1.0, 0.82, 0.35), 0.28, 6), "removed": ((1.0, 0.35, 0.35), 0.60, 1), "deleted": ((1.0, 0.35, 0.35), 0.28, 1), "uncertain": ((0.65, 0.75, 1.0), 0.28, 6)}


def style_of(change: Column, field: int) -> Column:
    """Colour (an array), opacity or most rectangles of a change type; unknown ones look uncertain."""
    value = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
    out = value(STYLES["uncertain"][field])
    for kind, style in STYLES.items():
        out = F.when(change == kind, value(style[field])).otherwise(out)
    return out
