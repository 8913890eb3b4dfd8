"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Every stage reads nothing but its docs and side tables, so its result can be written and read again before the next one.
Empty tables pass through every stage; clashing extra columns are handled by the operators and come out unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import pii, quality
from palimpsest.llm.common import stored, table
from palimpsest.llm.decontamination import decontaminate
from palimpsest.llm.packing import TOKENIZER, pack
from palimpsest.llm.simhash import near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, scores 0.3 or more. Null and empty texts are judged like any."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _verdict(docs, lambda d: quality.score(d, model, keep=d.columns), F.col("predicted") == 1)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one of smallest doc_id; of different texts under that id the one of least hash, and
    of repeated rows the least by its columns.

    Documents without a doc_id cannot be told apart and are neither compared nor dropped.
    """
    text_key = F.xxhash64(F.lit(8), F.coalesce("text", F.lit("")))
    named = docs.filter(F.col("doc_id").isNotNull())
    grouped = near_duplicates(named.select("doc_id", "text", text_key.alias("text_key")), keep=["doc_id", "text_key"])
    first = stored(grouped.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.*"), "first")
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    keyed = named.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("doc_id"), text_key.alias("text_key"))
    out = stored(keyed.join(first.hint("shuffle_hash"), ["doc_id", "text_key"], "left_semi"), "kept")
    back = [F.col(n).alias(c) for c, n in names.items()]
    if out.count() > first.count():  # repeated rows of a kept document
        out = out.groupBy("doc_id", "text_key").agg(F.min(F.struct(*names.values())).alias("r")).select("r.*")
    return out.select(*back).unionByName(docs.filter(F.col("doc_id").isNull()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return _verdict(docs, lambda d: decontaminate(d, table(spark, sf_dir, "benchmark"), keep=d.columns), ~F.col("contaminated"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind, and n_chars counted again. Null texts stay null."""
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 1024."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


def _verdict(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep) -> DataFrame:
    """Rows of docs for which judge() adds a verdict that keep holds. Columns travel under numbers, so none can clash with judge's."""
    names = {c: c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)}
    judged = judge(docs.select(*[F.col(c).alias(n) for c, n in names.items()]))
    return judged.filter(keep).select(*[F.col(n).alias(c) for c, n in names.items()])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express none of the trained stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
