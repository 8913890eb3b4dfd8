"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import decontaminate
from .licenses import scan_licenses
from .oracle import ORACLE_SQL  # noqa: F401
from .packing import TOKENIZER, pack, packed_digest
from . import pii
from .quality import fit, held_out, score
from .reputation import judge_urls
from .sharding import shard_digest, two_pass_shuffle
from .simhash import near_duplicates
from .substrings import remove_repeats
from .topk import hamming_topk, sign_codes


def op1_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op2_patience_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids")


def op4_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that a rule fits has the rule's verdict as its labelled outcome; no other table says anything about pages."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(two_pass_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_multi_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming_topk(codes, codes.filter("id % 20 = 0"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_lstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.fit(docs), keep=["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bin_slack_packing": op1_bin_slack_packing,
    "op2_patience_license_scan": op2_patience_license_scan,
    "op3_wu_manber_decontamination": op3_wu_manber_decontamination,
    "op4_byte_cnn_quality": op4_byte_cnn_quality,
    "op5_host_reputation": op5_host_reputation,
    "op6_two_pass_shuffle": op6_two_pass_shuffle,
    "op7_multi_index_topk": op7_multi_index_topk,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_phrase_automata": op9_phrase_automata,
    "op10_lstm_crf_pii": op10_lstm_crf_pii,
}
