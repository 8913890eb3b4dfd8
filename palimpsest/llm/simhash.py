"""SimHash near-duplicates: fingerprints, a grid join over segment popcounts, exact verification, connected components.

Cut a 64-bit fingerprint into 32 segments of 2 bits and count each segment's bits. The Manhattan distance of two such vectors is at
most the Hamming distance of the fingerprints, so links (3 bits or fewer) have vectors at distance 3 or less. The 32 coordinates are
dealt into G groups; a distance of 3 touches at most 3 groups, so linked vectors agree exactly in some G-3 groups: they share that
cell of the integer grid. Each fingerprint goes to the cells of all C(G, 3) choices; in a cell the Manhattan distance is checked
first and the Hamming distance then. Copies are collapsed to one fingerprint before that.

So the range join on the grid is an equality join on masked coordinates: a range of 3 in 32 dimensions has thousands of neighbouring
cells, the choices of groups are 20 to 120, and both find every pair within the range. With segments of 2 bits the bound is nearly tight.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_texts, release, stored

LINK = 3
#: Fingerprints of one cell that are compared in one task at a time; a fuller cell is cut into blocks and its pairs of blocks are spread.
CELL = 1024


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and splits at \x20 \x09-\x0D
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    hashes = np.array([digest(whole[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, keep=("doc_id",)) -> DataFrame:
    """docs' kept columns and `fp`, the fingerprint as a signed long."""

    def make():
        def work(texts):
            return [pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))]

        return work

    return map_texts(docs, make, "fp bigint", keep)


def popcounts(fps: np.ndarray) -> np.ndarray:
    """Bits set in each of 32 segments of 2 bits, a row of 32 small counts for each fingerprint."""
    x = fps.astype(np.uint64)
    x = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))  # 2-bit fields hold the counts 0 to 2
    return ((x[:, None] >> (np.arange(32, dtype=np.uint64) * np.uint64(2))) & np.uint64(3)).astype(np.int8)


def groups_for(n: int) -> int:
    """Groups of coordinates: more of them make cells finer and cells a fingerprint more numerous (20, 56, 120)."""
    return 6 if n < 1 << 22 else 8 if n < 1 << 28 else 10


def _cells(fps: np.ndarray, groups: int) -> list[np.ndarray]:
    """For each choice of groups that agree, the cell of each fingerprint: the counts of those groups, mixed with the choice to 64 bits."""
    x = fps.astype(np.uint64)
    x = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    masks = [sum(3 << (2 * s) for s in range(edges[g], edges[g + 1])) for g in range(groups)]
    out = []
    for k, free in enumerate(combinations(range(groups), LINK)):
        y = (x & np.uint64(sum(m for g, m in enumerate(masks) if g not in free))) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append((y ^ (y >> np.uint64(31))).view(np.int64))
    return out


def _forest(a: np.ndarray, b: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links between a and b (within a if same) that join what earlier ones have not: a spanning forest of all links."""
    va, vb = popcounts(a), popcounts(b)
    label = np.arange(len(a) if same else len(a) + len(b))
    side, out = 0 if same else len(a), []
    for p in range(len(a)):
        least = p + 1 if same else 0
        q = np.flatnonzero(np.abs(vb[least:] - va[p]).sum(axis=1, dtype=np.int16) <= LINK) + least  # the lower bound
        q = q[np.bitwise_count((b[q] ^ a[p]).view(np.uint64)) <= LINK]
        q = q[label[side + q] != label[p]]
        if len(q):
            joined, first = np.unique(label[side + q], return_index=True)
            out += [(int(a[p]), int(b[x])) for x in q[first]]
            label[np.isin(label, joined)] = label[p]
    return out


def links(fps: DataFrame, groups: int | None = None, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints of fps(fp): every pair at 3 bits or fewer is joined by a path of these."""
    g = groups or groups_for(fps.count())

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for cells in _cells(fp, g):
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fp)], names=["cell", "fp"])

    dealt = fps.select("fp").mapInArrow(deal, "cell bigint, fp bigint")
    full = dealt.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / cell).cast("int"))
    # A cell in one block is compared as a whole. In a fuller one, block i meets every block j >= i; a row of (i, j) holds at most two blocks.
    held = dealt.join(full, "cell").withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    pairs = held.select("cell", "fp", "block", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) as i, greatest(x, block) as j))")).alias("p")).select("cell", "fp", "block", "p.i", "p.j")
    packed = pairs.groupBy("cell", "i", "j").agg(F.collect_list(F.when(F.col("block") == F.col("i"), F.col("fp"))).alias("a"), F.collect_list(F.when(F.col("block") != F.col("i"), F.col("fp"))).alias("b"))

    def compare(batches):
        for batch in batches:
            i, j, a, b = (batch.column(k) for k in (1, 2, 3, 4))
            va, vb, oa, ob = (x.to_numpy(zero_copy_only=False) for x in (a.values, b.values, a.offsets, b.offsets))
            alone = i.to_numpy(zero_copy_only=False) == j.to_numpy(zero_copy_only=False)
            two = alone & (np.diff(oa) == 2)
            x, y = va[oa[:-1][two]], va[oa[:-1][two] + 1]
            near = np.abs(popcounts(x) - popcounts(y)).sum(axis=1) <= LINK
            x, y = x[near], y[near]
            true = np.bitwise_count((x ^ y).view(np.uint64)) <= LINK
            got = list(zip(x[true].tolist(), y[true].tolist()))
            for k in np.flatnonzero(~two):
                one = va[oa[k] : oa[k + 1]]
                got += _forest(one, one if alone[k] else vb[ob[k] : ob[k + 1]], bool(alone[k]))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)], names=["a", "b"])

    return packed.mapInArrow(compare, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that is not the smallest of its component: label is that smallest node. Alternates large-star and small-star steps until nothing changes.

    Every step is a groupBy with partial minimum and one join on the node, stored in the shared folder; rounds grow with the logarithm of the size.
    """
    spark = edges.sparkSession
    edges, before = stored(edges.filter("a <> b"), "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a node go to the smallest one around it
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(m, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        old, edges = edges, stored(small, "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(spark)
        if now == before:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            out._stored_at = edges._stored_at
            return out
        before = now


def near_duplicates(docs: DataFrame, shingle: int = 3, keep=("doc_id",)) -> DataFrame:
    """docs' kept columns with `fingerprint` (16 hex digits) and `component_id` (the smallest doc_id reachable by links, its own included).

    Null texts are empty; texts without words have fingerprint zero and are linked like any other. Null doc_ids take part and get a
    component, but never name it (null if the component holds no other). Repeated rows and copies share one fingerprint. Columns of those names give way.
    """
    spark = docs.sparkSession
    keep = list(dict.fromkeys(["doc_id", *[c for c in keep if c.lower() not in ("fingerprint", "component_id", "fp")]]))
    marked = stored(fingerprints(docs, shingle, keep), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(links(distinct))
    named = distinct.join(label, distinct.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = stored(named, "named")
    release(spark)
    discard(distinct, label)
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = named.join(ids, "label").select("fp", "component_id")
    return marked.join(ids, "fp").select(*keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
