"""Scans of files: format detection, a registry of readers, text files as pages, and corpora with safe, unique names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

FORMATS = ("pdf", "docx", "txt", "unknown")
PAGE_TEXTS = "doc_id string, page_number int, text string"


class UnsupportedFormat(ValueError):
    """No reader is registered for a format."""


def detect_format(content: Column) -> Column:
    """A1: %PDF is pdf, a ZIP start is docx, any other valid UTF-8 is txt, else unknown; an empty file is txt."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head == "504B0304", "docx").when(F.is_valid_utf8(content.cast("string")), "txt").otherwise("unknown")


class Readers:
    """A2: readers by format. A reader takes binary files (path, content) and returns PAGE_TEXTS."""

    def __init__(self) -> None:
        self._by_format: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self._can_read: dict[str, Callable[[Column], Column]] = {}

    def register(self, format: str, reader: Callable[[DataFrame], DataFrame], can_read: Callable[[Column], Column] | None = None) -> None:
        """can_read: whether the reader takes a file's content; any content by default."""
        if format in self._by_format:
            raise ValueError(f"a reader for {format} is registered already")
        self._by_format[format] = reader
        self._can_read[format] = can_read or (lambda content: F.lit(True))

    def can_read(self, format: str) -> Callable[[Column], Column]:
        self.get(format)
        return self._can_read[format]

    def get(self, format: str) -> Callable[[DataFrame], DataFrame]:
        if format not in self._by_format:
            raise UnsupportedFormat(format)
        return self._by_format[format]

    def supports(self, format: str) -> bool:
        return format in self._by_format

    def formats(self) -> list[str]:
        return sorted(self._by_format)


def read_txt(files: DataFrame) -> DataFrame:
    """A4: a whole text file is one page."""
    return files.select(F.col("path").alias("doc_id"), F.lit(1).alias("page_number"), F.col("content").cast("string").alias("text"))


def default_readers(pdf: Callable[[DataFrame], DataFrame] | None = None) -> Readers:
    """Text files; and PDF files if a kernel (binary files to PAGE_TEXTS, as by mapInPandas) is given. Word files are detected but have no reader."""
    found = Readers()
    found.register("txt", read_txt, lambda content: F.is_valid_utf8(content.cast("string")))
    if pdf:
        found.register("pdf", pdf, lambda content: F.hex(F.substring(content, 1, 4)) == "25504446")
    return found


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    return files.withColumn("format", detect_format(F.col("content")))


def extract(files: DataFrame, readers: Readers) -> tuple[DataFrame, DataFrame]:
    """A3: page texts of all files that a reader takes, and (path, format, reason) of the others: no reader for the format, or a reader that cannot read the file."""
    taken = F.lit(False)
    for f in readers.formats():
        taken = F.when(F.col("format") == f, readers.can_read(f)(F.col("content"))).otherwise(taken)
    files = files.withColumn("__ok", F.coalesce(taken, F.lit(False)))
    pages = None
    for f in readers.formats():
        got = readers.get(f)(files.filter((F.col("format") == f) & F.col("__ok")).drop("__ok"))
        pages = got if pages is None else pages.unionByName(got)
    reason = F.when(F.col("format").isin(readers.formats()), "UNREADABLE_FILE").otherwise("UNSUPPORTED_FORMAT")
    errors = files.filter(~F.col("__ok")).select("path", "format", reason.alias("reason"))
    return pages, errors


#: The second name under which each side of a pair may come.
ALIASES = {"original": "original_file", "revised": "revised_file"}


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of binary contents, under original and revised or their aliases, as original and revised with a reason and its HTTP status: a missing or empty side, or one that is no PDF; null and 200 if both are fine."""
    side = lambda c: F.coalesce(*[F.col(n) for n in (c, ALIASES[c]) if n in pairs.columns], F.lit(None).cast("binary"))
    rows = pairs.withColumns({f"__{c}": side(c) for c in ALIASES}).drop(*ALIASES, *ALIASES.values()).withColumnsRenamed({f"__{c}": c for c in ALIASES})
    bad = lambda c: F.when(F.col(c).isNull(), f"MISSING_{c.upper()}").when(F.length(c) == 0, f"EMPTY_{c.upper()}").when(detect_format(F.col(c)) != "pdf", f"NOT_A_PDF_{c.upper()}")
    rows = rows.withColumn("reason", F.coalesce(bad("original"), bad("revised")))
    return rows.withColumn("status", F.when(F.col("reason").isNull(), 200).otherwise(422))


def corpus(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(name, text) of the text files below a folder: in path order the first of each safe name counts, and of those the blank ones are skipped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").option("wholetext", "true").text(path).select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))
    named = raw.withColumn("name", X.safe_stem(F.col("path")))
    first = named.withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy("path"))).filter("__n = 1").filter(F.col("text").rlike(r"(?U)\S")).select("name", "text", "path")
    return (first.orderBy("path").limit(most) if most else first).select("name", "text")


def unique_names(files: DataFrame, name: str = "path") -> DataFrame:
    """Each file with a safe name; later ones of the same name get a four-digit prefix."""
    stem = files.withColumn("__stem", X.safe_stem(F.col(name)))
    n = F.row_number().over(Window.partitionBy("__stem").orderBy(name))
    return stem.withColumn("safe_name", F.when(n == 1, F.col("__stem")).otherwise(F.concat(F.format_string("%04d_", n), F.col("__stem")))).drop("__stem")


def write_metadata(corpus_: DataFrame, path: str) -> None:
    """The corpus's records as JSON lines."""
    corpus_.select("name", F.length("text").alias("characters"), X.text_hash(F.col("text")).alias("sha256")).write.json(path)
