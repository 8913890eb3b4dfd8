"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments of about log2(codes) bits; the index holds every distinct code under each segment's value. Round r
probes, for every open query, the values at distance r of its segments. After it every code at distance m * (r + 1) - 1 or less has been
seen (were it farther than r in all segments, it would be at m * (r + 1) or more), so a query closes once k verified neighbours lie within that.

Codes and probes meet by cells, the high bits of a segment's value. A cell that many codes share (a frequent value) or that many queries
probe is cut into blocks, and every block of codes meets every block of queries; only such cells are copied.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, release, stored

#: Codes of the index that a cell has on average, and codes and queries that meet at a time.
CELL_CODES, BLOCK_CODES, BLOCK_QUERIES = 1 << 14, 1 << 16, 1 << 15
#: Cells of which a table may be broadcast: 24 bytes each.
BROADCAST_CELLS = 1 << 17


def sign_codes(vectors: DataFrame, vector: str = "embedding", id: str = "vec_id") -> DataFrame:
    """(id, code): bit i says that component i is above 0; components beyond 64 are folded by exclusive or. Rows without a vector or id have no code and are left out."""

    def run(batches):
        for b in batches:
            codes = []
            for v in b.column(1).to_pylist():
                c = 0
                for i in np.flatnonzero(np.array([x or 0.0 for x in v]) > 0):
                    c ^= 1 << (int(i) % 64)
                codes.append(c - 2**64 if c >> 63 else c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.int64())], names=["id", "code"])

    return vectors.filter(F.col(vector).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("bigint"), vector).mapInArrow(run, "id bigint, code bigint")


def edges_for(codes: int) -> list[int]:
    """Where segments begin and end: about log2(codes) bits each, from 8 to 2 of them."""
    m = min(8, max(2, round(64 / math.log2(codes + 2))))
    return [round(64 * i / m) for i in range(m + 1)]


def _masks(bits: int) -> list[np.ndarray]:
    every = np.arange(1 << bits)
    ones = np.bitwise_count(every)
    return [every[ones == t] for t in range(bits + 1)]


def _values(codes: np.ndarray, edges: list[int], seg: int) -> np.ndarray:
    return ((codes.view(np.uint64) >> np.uint64(edges[seg])) & np.uint64((1 << edges[seg + 1] - edges[seg]) - 1)).astype(np.int64)


def _best(queries: np.ndarray, code, least, n, value, asked, r: int, cell: int, low: int, masks, k: int):
    """(query, code, distance, least, n) of the best k codes of a cell for each query, among those whose value is r off; code and the rest in order of value."""
    edge = np.searchsorted(value, np.arange((1 << low) + 1)) if 1 << low <= len(code) else None
    for q, v in zip(queries, asked):
        t = r - (int(v) >> low ^ cell).bit_count()
        if not 0 <= t <= low:
            continue
        inner = int(v) & (1 << low) - 1
        if edge is None or len(masks[t]) > len(code):
            rows = np.flatnonzero(np.bitwise_count(value ^ inner) == t)
        else:
            at = masks[t] ^ inner
            a, b = edge[at], edge[at + 1]
            a, size = a[b > a], (b - a)[b > a]
            rows = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        if len(rows):
            d = np.bitwise_count((code[rows] ^ q).view(np.uint64)).astype(np.int64)
            if len(rows) > k:
                near = d <= np.partition(d, k - 1)[k - 1]
                rows, d = rows[near], d[near]
            order = np.lexsort((least[rows], d))[:k]
            rows = rows[order]
            yield np.full(len(rows), q), code[rows], d[order], least[rows], n[rows]


def _prober(edges: list[int], high: int, r: int, k: int):
    def probe(index: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if index.num_rows and queries.num_rows:
            seg, cell = index.column("seg")[0].as_py(), index.column("cell")[0].as_py()
            low = edges[seg + 1] - edges[seg] - high
            code, least, n = (index.column(c).to_numpy() for c in ("code", "least", "n"))
            value = _values(code, edges, seg) & ((1 << low) - 1)
            order = np.argsort(value, kind="stable")
            q = queries.column("qcode").to_numpy()
            masks = _masks(low) if 1 << low <= len(code) else [()] * (low + 1)
            found = list(_best(q, code[order], least[order], n[order], value[order], _values(q, edges, seg), r, cell, low, masks, k))
        out = [np.concatenate(c) for c in zip(*found)] or [np.empty(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["qcode", "code", "d", "least", "n"])

    return probe


def _placed(codes: DataFrame, edges: list[int], high: int, r: int | None = None) -> DataFrame:
    """codes (first column a code) with seg and cell: their own cells, or with r those that hold values at distance r."""
    masks = _masks(high)

    def run(batches):
        for batch in batches:
            code = batch.column(0).to_numpy(zero_copy_only=False)
            for seg in range(len(edges) - 1):
                low = edges[seg + 1] - edges[seg] - high
                cell = _values(code, edges, seg) >> low
                near = masks[0] if r is None else np.concatenate([masks[t] for t in range(max(0, r - low), min(r, high) + 1)] or [masks[0][:0]])
                for at in range(0, len(near), 256):
                    part = near[at : at + 256]
                    rows = pa.array(np.repeat(np.arange(len(code)), len(part)))
                    cells = (cell[:, None] ^ part[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], pa.array(np.full(len(cells), seg, np.int32)), pa.array(cells.astype(np.int32))], names=[*batch.schema.names, "seg", "cell"])

    return codes.mapInArrow(run, T.StructType([*codes.schema.fields, T.StructField("seg", T.IntegerType()), T.StructField("cell", T.IntegerType())]))


def hamming_topk(codes: DataFrame, queries: DataFrame, k: int = 10, block_codes: int = BLOCK_CODES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, neighbour_id, distance) of the k nearest rows of codes(id, code) for each row of queries(id, code), itself left out.

    Ties go to the smaller id; repeated rows count once, whatever their other columns hold; rows without an id or code are left out; with
    fewer than k others all are returned, and nothing for an empty table. Copies of a code share one index entry with their k + 1 smallest
    ids, which is all that any query can need.
    """
    spark, need = codes.sparkSession, k + 1  # the query itself may be among them
    codes, queries = (t.select(F.col("id").cast("bigint").alias("id"), F.col("code").cast("bigint").alias("code")).na.drop().distinct() for t in (codes, queries))
    first = Window.partitionBy("code").orderBy("id")
    ids = codes.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= need)
    distinct = stored(ids.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    open_ = stored(queries.select(F.col("code").alias("qcode")).distinct(), "open")
    total = distinct.count()
    if not total or open_.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, neighbour_id bigint, distance int")
    edges = edges_for(total)
    m, bits = len(edges) - 1, min(b - a for a, b in zip(edges, edges[1:]))
    high = min(bits, max(3, math.ceil(math.log2(max(1, total / CELL_CODES)))))  # bits of a segment that name a cell
    index = _placed(distinct.select("code", F.element_at("ids", 1).alias("least"), F.size("ids").cast("bigint").alias("n")), edges, high)
    index = stored(index, "index")
    held = stored(index.groupBy("seg", "cell").agg(F.count("*").alias("codes")), "cells")

    best, r = None, 0
    while True:
        probes = _placed(open_, edges, high, r)
        cells = held.join(probes.groupBy("seg", "cell").agg(F.count("*").alias("asked")), ["seg", "cell"])
        cells = cells.select("seg", "cell", F.ceil(F.col("codes") / block_codes).cast("int").alias("rows"), F.ceil(F.col("asked") / block_queries).cast("int").alias("columns"))
        cells = F.broadcast(cells) if m << high <= BROADCAST_CELLS else cells
        keys, every = ["seg", "cell", "i", "j"], lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        near = index.join(cells, ["seg", "cell"]).withColumn("i", F.pmod(F.xxhash64("code"), F.col("rows")).cast("int")).withColumn("j", every("columns")).drop("rows", "columns")
        probes = probes.join(cells, ["seg", "cell"]).withColumn("j", F.pmod(F.xxhash64("qcode"), F.col("columns")).cast("int")).withColumn("i", every("rows")).drop("rows", "columns")
        found = near.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(_prober(edges, high, r, need), "qcode bigint, code bigint, d bigint, least bigint, n bigint")
        found = found.distinct() if best is None else found.union(best).distinct()
        nearest = Window.partitionBy("qcode").orderBy("d", "least")
        before, best = best, stored(found.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= need).drop("r"), "best")
        closed = best.filter(F.col("d") <= m * (r + 1) - 1).groupBy("qcode").agg(F.sum("n").alias("n")).filter(F.col("n") >= need)
        asked, open_ = open_, stored(open_.join(closed, "qcode", "left_anti"), "open")
        discard(asked, *([before] if before is not None else []))
        release(spark)
        r += 1
        if open_.isEmpty() or r > max(b - a for a, b in zip(edges, edges[1:])):
            break
    discard(index, held, open_)
    listed = best.join(distinct, "code").groupBy("qcode").agg(F.collect_list(F.struct("d", "ids")).alias("near"))
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["d"].alias("d"), i.alias("id")))))
    answers = queries.select(F.col("id").alias("query_id"), F.col("code").alias("qcode")).join(listed.select("qcode", F.array_sort(flat).alias("near")), "qcode")
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(own).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.col("x.d").cast("int").alias("distance"))
