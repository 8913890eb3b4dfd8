"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters whole records into memory-sized buckets by a seeded hash of the record, a partition for each bucket. Pass two shuffles
each bucket (Spark's shuffle() is an inside-out Fisher-Yates) and lays the buckets end to end. The place of a record in that order deals
it out: place modulo the number of shards is its shard, the quotient its slot. So shard counts are at most one apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, stored, without

#: Rows of the tables (bucket, offset) and (hash) that may be broadcast: 16 bytes each.
BROADCAST_ROWS = 1 << 17


def two_pass_shuffle(df: DataFrame, shards: int = 8, seed: int = 2029, bucket_bytes: int = 64 << 20, least_buckets: int = 64, key: str = "doc_id", text: str = "text", most_copies: int = 4096) -> DataFrame:
    """Every record of df with `shard` (int, from 0) and `slot` (long, gapless from 0 in each shard).

    Null keys and texts are hashed like any other; an empty table gives an empty table. Input columns named shard or slot are replaced. Map
    columns cannot be ordered and are not accepted. Repeated rows are separate records, each with a place of its own; rows that are equal in
    every column are numbered and scattered one by one where there are more than most_copies of them. The order depends on the records,
    their number of bytes, the seed and the bounds alone, not on the session's settings or on how the input is partitioned: a task that
    runs again after a lost executor yields the same places.
    """
    df = without(df, ["shard", "slot"])
    rest = [c for c in df.columns if c not in (key, text)]
    total = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0] or 0
    buckets = max(least_buckets, math.ceil(total / bucket_bytes))
    records = _scattered(df.withColumn("__h", F.xxhash64(F.lit(seed), key, text, *rest)), most_copies)
    records = records.withColumn("__bucket", F.pmod("__h", F.lit(buckets)).cast("int")).drop("__h")

    counts = stored(records.groupBy("__bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr("__bucket div 1024")), "buckets")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 1024 buckets
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(blocks, "block").select("__bucket", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("__offset"))
    if buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)

    # A partition for each bucket, so that the generator of shuffle(), which is seeded by the partition's number, serves one bucket.
    filled = records.repartitionById(buckets, F.col("__bucket")).groupBy("__bucket").agg(F.sort_array(F.collect_list(F.struct(key, text, *rest))).alias("records"))
    shuffled = filled.select("__bucket", F.shuffle("records", F.lit(seed)).alias("records")).join(offsets, "__bucket")
    placed = shuffled.select("__offset", F.posexplode("records").alias("__at", "r")).withColumn("__place", F.col("__offset") + F.col("__at"))
    return placed.select(*[F.col("r")[c].alias(c) for c in df.columns], F.pmod(F.col("__place"), F.lit(shards)).cast("int").alias("shard"), F.expr(f"__place div {shards}").alias("slot"))


def _scattered(marked: DataFrame, most_copies: int) -> DataFrame:
    """marked(.., __h) where rows of which there are more than most_copies have a hash of their own each: they are counted, and written out again by number."""
    often = stored(marked.groupBy("__h").agg(F.count("*").alias("n")).filter(F.col("n") > most_copies).select("__h"), "often")
    n = often.count()
    if not n:
        discard(often)
        return marked
    side = F.broadcast(often) if n <= BROADCAST_ROWS else often
    counted = marked.join(side, "__h", "left_semi").groupBy(*marked.columns).agg(F.count("*").alias("__n"))
    parts = counted.withColumn("__from", F.explode(F.expr(f"sequence(0L, __n - 1, {most_copies}L)"))).repartition("__h", "__from")
    copies = parts.withColumn("__copy", F.explode(F.expr(f"sequence(__from, least(__from + {most_copies - 1}, __n - 1))"))).withColumn("__h", F.xxhash64("__h", "__copy"))
    return marked.join(side, "__h", "left_anti").unionByName(copies.drop("__n", "__from", "__copy"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes the shuffled records as Parquet, a folder for each shard, rows in slot order within each file."""
    two_pass_shuffle(df, **options).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(df: DataFrame) -> DataFrame:
    """The digest of shuffled documents under the law `rows`: counts at most one apart."""
    return df.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
