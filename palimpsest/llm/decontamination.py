"""Benchmark decontamination by Wu-Manber multi-pattern search over whole texts.

A text becomes its words (A-Z lower-cased) with one space before, between and after them, as UTF-8 bytes. The patterns are the
benchmark's windows of 13 words in the same form, space to space, so an occurrence starts and ends at word edges.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_texts, split_batch, stored

WINDOW = 13
#: Bytes of benchmark text of which one search structure is built and sent out (about 40 bytes of memory for each). A larger benchmark is
#: searched in several blocks, of which at most BLOCKS_AT_ONCE run in one stage.
BLOCK_BYTES, BLOCKS_AT_ONCE = 4 << 20, 4
#: Words of a part of a benchmark item; parts overlap by a window less a word.
PART_WORDS = 4096

_SEPARATORS = {*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)} - {*range(0x41, 0x5B)}
_NORMAL = bytes(32 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(_NORMAL).split()


_MIX, _M64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _hashes(buffer: bytes, block: int) -> np.ndarray:
    """64-bit hash of the block of bytes at each place of the buffer: the bytes as a little-endian number, times an odd constant."""
    raw = np.frombuffer(buffer + bytes(8), np.uint8)
    value = np.zeros(len(buffer), np.uint64)
    for k in range(block):
        value |= raw[k : k + len(buffer)].astype(np.uint64) << np.uint64(8 * k)
    return value * np.uint64(_MIX)


class WuManber:
    """Finds all occurrences of many patterns, which are given by their places in one buffer.

    Tables are arrays: a byte of shift for each hash of a block (a collision only makes a shift shorter), and the patterns in order of the
    hashes of their last block and their first. Patterns of much different lengths get tables of their own, so that a short one does not
    shorten every shift.
    """

    def __init__(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        self.buffer, self.starts, self.ends = buffer, starts.tolist(), ends.tolist()
        kind = np.array([min(int(n).bit_length(), 6) for n in ends - starts], int)
        self.tables = [self._table(starts, ends, np.flatnonzero(kind == k)) for k in np.unique(kind)]

    def _table(self, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple:
        starts, m = starts[which], int((ends - starts)[which].min())
        block = max(1, min(m, 8, round(math.log(2 * m * len(which) + 2, 4))))
        bits = min(22, max(8, (m * len(which)).bit_length()))
        mixed = _hashes(self.buffer, block)
        place = mixed >> np.uint64(64 - bits)
        shift = np.full(1 << bits, min(255, m - block + 1), np.uint8)
        for k in range(m - block + 1):  # from far to near: the least shift stays
            shift[place[starts + k]] = min(255, m - block - k)
        last, first = place[starts + m - block], mixed[starts] >> np.uint64(32)
        order = np.lexsort((first, last))
        edge = np.searchsorted(last[order], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return m, block, 64 - bits, shift.tobytes(), memoryview(edge), memoryview(first[order].astype(np.uint32)), memoryview(which[order].astype(np.int32))

    def find(self, text: bytes) -> list[tuple[int, int]]:
        """(position, pattern) of every occurrence, overlapping ones too."""
        found: list[tuple[int, int]] = []
        n, number = len(text), int.from_bytes
        for m, block, down, shift, edge, first, which in self.tables:
            end = m
            while end <= n:
                h = (number(text[end - block : end], "little") * _MIX & _M64) >> down
                if s := shift[h]:
                    end += s
                    continue
                start, hi = end - m, edge[h + 1]
                head = (number(text[start : start + block], "little") * _MIX & _M64) >> 32
                i = bisect_left(first, head, edge[h], hi)
                while i < hi and first[i] == head:
                    k = which[i]
                    if text.startswith(self.buffer[self.starts[k] : self.ends[k]], start):
                        found.append((start, k))
                    i += 1
                end += 1
        return found


class Windows:
    """The windows of some benchmark items, and a search for them. Equal windows are one pattern with several items."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> None:
        parts, at = [], 0
        starts: list[int] = []
        ends: list[int] = []
        self.items: list[set[str]] = []
        self.words: list[int] = []
        known: dict[int, int] = {}
        sets: dict[str, set[str]] = {}
        for item, text in items:
            words = normal_words(text)
            if not words:
                continue
            plain, size = b" %b " % b" ".join(words), min(window, len(words))
            space = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
            own = sets.setdefault(item, {item})
            for a, b in zip(space[: len(space) - size].tolist(), (space[size:] + 1).tolist()):
                h = xxhash.xxh64_intdigest(plain[a:b])
                while (k := known.setdefault(h, len(starts))) < len(starts) and self._text(parts, plain, at, starts[k], ends[k]) != plain[a:b]:
                    h += 1  # two windows of one hash
                if k == len(starts):
                    starts.append(at + a)
                    ends.append(at + b)
                    self.items.append(own)
                    self.words.append(size)
                elif item not in self.items[k]:
                    self.items[k] = self.items[k] | own
            parts.append((at, plain))
            at += len(plain)
        buffer = b"".join(p for _, p in parts)
        self.search = WuManber(buffer, np.array(starts, np.int64), np.array(ends, np.int64))

    @staticmethod
    def _text(parts: list[tuple[int, bytes]], last: bytes, at: int, start: int, end: int) -> bytes:
        if start >= at:
            return last[start - at : end - at]
        base, plain = parts[bisect_left(parts, start + 1, key=lambda p: p[0]) - 1]
        return plain[start - base : end - base]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of hit words, and the items whose windows occur."""
        text = b" %b " % b" ".join(words)
        items: set[str] = set()
        spans = []
        at = seen = 0
        for start, k in sorted(self.search.find(text)):
            seen += text.count(b" ", at, start)
            at = start
            spans.append((seen, seen + self.words[k]))
            items |= self.items[k]
        return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: Sequence[str] | None = None) -> DataFrame:
    """docs with n_words, n_hit, hit_words (ranges start:end, comma-joined), item_ids (comma-joined), n_items, items_sha256 and contaminated.

    A word is hit inside any occurrence of a benchmark window; a document is contaminated if n_hit > 0 and 20 * n_hit >= n_words.
    Null and empty texts have no words and are never contaminated; items without words have no window; repeated items and rows count as such;
    a null item_id is written as an empty one, and one with commas as it stands. Input columns with the names above give way. Items are cut
    into overlapping parts and reach the tasks in blocks of about block_bytes of text; each block scans what the one before returned, and
    however many blocks there are, the result is the same.
    """
    names = ["n_words", "n_hit", "hit_words", "item_ids", "n_items", "items_sha256", "contaminated"]
    own = [c for c in (keep or docs.columns) if c.lower() not in names]
    parts = stored(_parts(benchmark, window).distinct(), "benchmark")
    size = parts.agg(F.sum(F.octet_length("part") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(own)], F.col("text").alias("__doc"))
    steps = []
    for k in range(blocks):
        rows = parts.filter(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == k).collect()  # one block; no part is longer than PART_WORDS words
        out = _scan(out, [(r["item"], bytes(r["part"])) for r in rows], window, k)
        if k % BLOCKS_AT_ONCE == BLOCKS_AT_ONCE - 1 and k < blocks - 1:
            out = stored(out, "scanned")
            discard(*steps)
            steps = [out]
    discard(parts)
    gathered = lambda kind: F.concat(*[F.col(f"__{kind}{k}") for k in range(blocks)])
    out = out.withColumns({"__items": F.array_sort(F.array_distinct(gathered("i"))), "__spans": F.col("__r0") if blocks == 1 else _merged(gathered("r"))})
    out = out.withColumn("__hit", F.aggregate("__spans", F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"])).withColumn("__ids", F.array_join("__items", ","))
    return out.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(own)],
        F.col("__n0").alias("n_words"),
        F.col("__hit").alias("n_hit"),
        F.array_join(F.transform("__spans", lambda x: F.concat_ws(":", x["a"], x["b"])), ",").alias("hit_words"),
        F.col("__ids").alias("item_ids"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2("__ids", 256).alias("items_sha256"),
        ((F.col("__hit") > 0) & (20 * F.col("__hit") >= F.col("__n0"))).alias("contaminated"),
    )


def _parts(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, part): the words of every item in parts that hold each of its windows once."""

    def cut(batches):
        for batch in batches:
            for rows in split_batch(batch):
                out = []
                for item, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    words, step = normal_words(text), max(PART_WORDS, 2 * window)
                    out += [(item, b" ".join(words[i : i + step])) for i in range(0, max(1, len(words) - window + 1) if words else 0, step - window + 1)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary()))], names=["item", "part"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")).cast("binary")).mapInArrow(cut, "item string, part binary")


def _merged(spans):
    """Ranges a, b in order and without overlaps."""
    start = F.expr("cast(array() as array<struct<a: int, b: int>>)")

    def join(done, x):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (x["a"] <= last["b"]), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, join)


_COMPILED: dict[str, Windows] = {}


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], window: int, k: int) -> DataFrame:
    """docs with ranges __r{k} and items __i{k} found by the windows of one block of the benchmark; the first also counts words, __n0."""
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def make():
        if name not in _COMPILED:  # built once in each Python worker, which holds one block
            _COMPILED.clear()
            _COMPILED[name] = Windows(sent.value, window)
        windows = _COMPILED[name]

        def work(texts: list[bytes]):
            counts, spans, items = [], [], []
            for t in texts:
                words = normal_words(t)
                found, ids = windows.hits(words) if words else ([], set())
                counts.append(len(words))
                spans.append(found)
                items.append(sorted(ids))
            return [spans, items, *([counts] if k == 0 else [])]

        return work

    return map_texts(docs, make, f"__r{k} array<struct<a: int, b: int>>, __i{k} array<string>" + (", __n0 bigint" if k == 0 else ""), None, "__doc")
