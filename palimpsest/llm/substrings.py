"""Substring dedup by repeated-phrase automata: words covered by windows of 35 words that occur more than once are removed.

1. Nominate. In each run of 20 phrases of 16 words (all that one window holds) the phrase of the least hash is an anchor. Equal windows
   have equal anchors, so a window whose anchor occurs once in the corpus occurs once. Windows that share an anchor form a piece of 35
   to 54 words; pieces with recurring anchors are what is left to look at.
2. Confirm. The windows of those pieces are counted by anchor and hash (128 bits together), summed up before they are shuffled. Each
   window that recurs has one representative, the least place that holds it: these are the confirmed passages.
3. Compile. Passages are dealt into shards by anchor. Each shard builds an Aho-Corasick automaton of its passages' anchor phrases, over words.
4. Locate. Every document is streamed, piece by piece, through the shards that its recurring anchors reach. Around each phrase that the
   automaton finds, the windows are compared with the shard's passages, word for word. A window is removed where its words stand at a
   place other than its representative's, and there the representative is removed as well: so counts only nominate, and words
   decide. A shard that many pieces or passages reach is cut into blocks of both.

Copies of a text are streamed once, with their number; a piece of a text with copies stands for as many places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, split_batch, stored

WINDOW, PHRASE = 35, 16
#: Pieces that a shard has on average, and at most in one of its blocks; windows of the passages of one automaton.
SHARD_PIECES, BLOCK_PIECES, BLOCK_PASSAGES = 1 << 12, 1 << 14, 1 << 17
#: Pieces that are words at the same time while they are streamed.
STREAMED = 1 << 9
#: Shards in several blocks of which a table may be broadcast: 24 bytes each.
BROADCAST_SHARDS = 1 << 17
_M = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_M, n, 2**64))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, from the words' hashes: runs of doubling lengths, joined by the bits of n."""
    out, length, run, size = None, 0, h, 1
    while size <= n:
        if n & size:
            if out is None:
                out, length = run, size
            else:  # out covers the last `length` words, run the `size` words before them
                out = run[: len(run) - length] * _power(length) + out[size:]
                length += size
        if size * 2 <= n:
            run = run[:-size] * _power(size) + run[size:]
        size *= 2
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_places(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in every run of `width` values."""
    at, size = np.arange(len(v)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at, size = np.where(v[a] <= v[b], a, b), size + step
    return at


class Pieces:
    """The pieces of some texts, given as words: the text each is of, its first window, number of windows, place of the anchor phrase in it, and anchor. All texts are hashed as one array."""

    def __init__(self, texts: list[list[bytes]], window: int, phrase: int) -> None:
        n = np.array([len(t) for t in texts], np.int64)
        count = np.maximum(n - window + 1, 0)  # windows of each text
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(texts)), np.uint64, n.sum())
        begin, total = np.cumsum(n) - n, int(count.sum())
        text = np.repeat(np.arange(len(texts)), count)
        self.starts = np.arange(total) + np.repeat(begin - (np.cumsum(count) - count), count)
        if total:
            value = mixed(rolling(self.words, phrase))
            place = least_places(value, window - phrase + 1)[self.starts]
            new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
        else:
            value, place, new = np.empty(0, np.uint64), self.starts, self.starts
        self.text, start = text[new], self.starts[new]
        self.first, self.at = start - begin[self.text], place[new] - start
        self.size = np.diff(np.append(new, total))
        self.anchors = value[place[new]].view(np.int64)
        self.base = np.searchsorted(self.text, np.arange(len(texts)))  # each text's first piece

    def hashes(self, window: int) -> np.ndarray:
        """Hash of every window, in order."""
        return mixed(rolling(self.words, window))[self.starts].view(np.int64) if len(self.starts) else np.empty(0, np.int64)


def _texts(batches, at: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        for part in split_batch(batch, 2 << 20):
            yield part, [t.split() for t in part.column(at).to_pylist()]


def _columns(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _lists(values: np.ndarray, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


def nominated(texts: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(piece, a, b, anchor, start, at, copies, hashes) of texts (a, b, t): the pieces with recurring anchors, once for copies of a text.

    piece: a number of its own; at: place of the anchor phrase in the piece; hashes: of its windows, of which there are at most 32.
    """
    if window - phrase + 1 > 32:
        raise ValueError("a window holds at most 32 phrases")
    spark = texts.sparkSession

    def anchors(batches):
        for part, found in _texts(batches, 2):
            p = Pieces(found, window, phrase)
            if len(p.text):
                rows = pa.array(p.text)
                yield _columns("anchor a b place", p.anchors, part.column(0).take(rows), part.column(1).take(rows), (np.arange(len(p.text)) - p.base[p.text]).astype(np.int32))

    met = texts.mapInArrow(anchors, "anchor bigint, a bigint, b bigint, place int").groupBy("anchor").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("a", "b", "place")])
    alone = met.filter("n = 1").groupBy("a", "b").agg(F.collect_list("place").alias("alone"))
    marks = stored(texts.groupBy("a", "b").agg(F.count("*").alias("copies")).join(alone, ["a", "b"], "left"), "anchors")
    release(spark)

    def pieces(batches):
        seen, number = set(), TaskContext.get().partitionId() << 36
        for part, found in _texts(batches, 2):
            fresh = np.ones(len(found), bool)  # one of a text's copies
            for k, copies in enumerate(part.column(3).to_pylist()):
                if copies > 1:
                    key = (part.column(0)[k].as_py(), part.column(1)[k].as_py())
                    fresh[k] = key not in seen
                    seen.add(key)
            p = Pieces(found, window, phrase)
            again = fresh[p.text]
            alone = part.column(4)
            once = np.diff(alone.offsets.to_numpy(zero_copy_only=False))
            flat = alone.values.to_numpy(zero_copy_only=False)[alone.offsets[0].as_py() : alone.offsets[-1].as_py()]
            again[np.repeat(p.base, once) + flat] = False
            if again.any():
                rows = pa.array(p.text[again])
                a, b, copies = (part.column(k).take(rows) for k in (0, 1, 3))
                hashes = _lists(p.hashes(window)[np.repeat(again, p.size)], p.size[again])
                yield _columns("piece a b anchor start at copies hashes", np.arange(number, number + len(rows)), a, b, p.anchors[again], p.first[again].astype(np.int32), p.at[again].astype(np.int32), copies, hashes)
                number += len(rows)

    joined = texts.join(marks.hint("shuffle_hash"), ["a", "b"]).select("a", "b", "t", "copies", F.coalesce("alone", F.array().cast("array<int>")).alias("alone"))
    out = stored(joined.mapInArrow(pieces, "piece bigint, a bigint, b bigint, anchor bigint, start int, at int, copies bigint, hashes array<bigint>"), "pieces")
    discard(marks)
    release(spark)
    return out


def representatives(pieces: DataFrame) -> DataFrame:
    """(piece, own) of the pieces that hold representatives of recurring windows: bit i of own says that its window i is one."""
    each = pieces.select("piece", "anchor", "copies", F.posexplode("hashes").alias("i", "hash"))
    counted = each.groupBy("anchor", "hash").agg(F.sum("copies").alias("n"), F.min(F.shiftleft("piece", 5) + F.col("i")).alias("at")).filter("n > 1")
    return counted.groupBy(F.shiftright("at", 5).alias("piece")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("own"))


def locate(rows: pa.Table, window: int = WINDOW, phrase: int = PHRASE) -> list[tuple[int, int, int, int]]:
    """(a, b, first word, end) of the words that a window found elsewhere covers, in the pieces of one block and at its passages' representatives.

    rows: a, b, start, at (place of the anchor phrase), copies, words (joined by a space); own: the bits of the windows that a passage stands
    for, null for none; stream: whether the piece is streamed. A piece's windows overlap, so what they cover is one range. Only passages are
    held as Python objects; streamed pieces become words some at a time.
    """
    import ahocorasick

    number: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    passages: dict[bytes, tuple[int, int]] = {}  # a window's words: its passage, and its place there
    places: list[tuple[int, int, int]] = []
    columns = lambda part, *names: zip(*[part.column(c).to_pylist() for c in names])
    for own, a, b, start, at, raw in columns(rows.filter(rows.column("own").is_valid()), "own", "a", "b", "start", "at", "words"):
        words = raw.split()
        automaton.add_word(tuple([number.setdefault(w, len(number) + 1) for w in words[at : at + phrase]]))
        edge = list(accumulate(map(len, words), initial=0))
        for i in range(own.bit_length()):
            if own >> i & 1:
                passages[raw[edge[i] + i : edge[i + window] + i + window - 1]] = (len(places), i)
        places.append((a, b, start))
    if not passages:
        return []
    automaton.make_automaton()
    met = [0] * len(places)
    out = []
    get, known, find = number.get, passages.get, automaton.iter
    streamed = rows.filter(rows.column("stream")).to_batches(STREAMED)
    for a, b, start, copies, raw in chain.from_iterable(columns(part, "a", "b", "start", "copies", "words") for part in streamed):
        words, edge, seen, mask = raw.split(), None, 0, 0
        for end, _ in find(tuple([get(w, 0) for w in words])):
            edge = edge or list(accumulate(map(len, words), initial=0))
            first, last = max(seen, end + 1 - window), min(end + 1 - phrase, len(words) - window)
            for i in range(first, last + 1):
                found = known(raw[edge[i] + i : edge[i + window] + i + window - 1])
                if found is not None:
                    k, j = found
                    if copies > 1 or i != j or places[k] != (a, b, start):
                        mask |= 1 << i
                        met[k] |= 1 << j
            seen = max(seen, last + 1)
            if seen > len(words) - window:
                break
        if mask:
            out.append((a, b, start + (mask & -mask).bit_length() - 1, start + mask.bit_length() - 1 + window))
    out += [(a, b, start + (m & -m).bit_length() - 1, start + m.bit_length() - 1 + window) for (a, b, start), m in zip(places, met) if m]
    return out


def repeats(texts: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_pieces: int = SHARD_PIECES, block_pieces: int = BLOCK_PIECES, block_passages: int = BLOCK_PASSAGES) -> DataFrame:
    """(a, b, ranges) of texts (a, b, t) with recurring windows: word ranges (lo, hi) that they cover."""
    spark = texts.sparkSession
    pieces = nominated(texts, window, phrase)
    own = stored(representatives(pieces), "passages")
    release(spark)
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    shard = F.pmod("anchor", F.lit(shards))
    places = pieces.select("piece", "a", "b", "anchor", "start", "at", "copies", F.size("hashes").cast("byte").alias("size"))
    places = stored(places.join(own, "piece", "left"), "places")
    discard(pieces, own)
    release(spark)
    load = places.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.sum(F.bit_count(F.coalesce("own", F.lit(0)))).alias("p"))
    load = load.select("shard", F.ceil(F.col("n") / block_pieces).alias("rows"), F.ceil(F.col("p") / block_passages).alias("columns"))
    full = stored(load.filter("rows > 1 or columns > 1"), "shards")
    n_full = full.count()

    held = places.groupBy("a", "b").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("start", "size", "anchor", "at", "own")).alias("pieces"))

    def cut(batches):
        seen = set()
        for part, found in _texts(batches, 2):
            lists = part.column(4)
            ends, flat = lists.offsets.to_numpy(zero_copy_only=False), lists.values
            start, size = (flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("start", "size"))
            rows, kept, pieces = [], np.zeros(len(flat), bool), []
            for k, (a, b, copies, words) in enumerate(zip(*[part.column(k).to_pylist() for k in (0, 1, 3)], found)):
                if copies > 1:
                    if (a, b) in seen:
                        continue
                    seen.add((a, b))
                own = slice(ends[k], ends[k + 1])
                rows.append((a, b, copies, ends[k + 1] - ends[k]))
                kept[own] = True
                raw, edge = b" ".join(words), list(accumulate(map(len, words), initial=0))
                pieces += [raw[edge[i] + i : edge[j] + j - 1] for i, j in zip(start[own].tolist(), (start[own] + size[own] + window - 1).tolist())]
            if rows:
                spread = lambda c: np.repeat(np.array([r[c] for r in rows], np.int64), [r[3] for r in rows])
                field = lambda c: flat.field(flat.type.get_field_index(c)).filter(pa.array(kept))
                yield _columns("a b anchor start at copies words own", spread(0), spread(1), field("anchor"), field("start"), field("at"), spread(2), pa.array(pieces, pa.binary()), field("own"))

    streamed = texts.join(held.hint("shuffle_hash"), ["a", "b"]).select("a", "b", "t", "copies", "pieces")
    streamed = streamed.mapInArrow(cut, "a bigint, b bigint, anchor bigint, start int, at int, copies bigint, words binary, own bigint").withColumn("shard", shard)
    if n_full:  # every block of pieces meets every block of passages
        streamed = streamed.join(F.broadcast(full) if n_full <= BROADCAST_SHARDS else full, "shard", "left").withColumns({"rows": F.coalesce("rows", F.lit(1)), "columns": F.coalesce("columns", F.lit(1))})
    else:
        streamed = streamed.withColumns({"rows": F.lit(1), "columns": F.lit(1)})
    dealt = F.pmod(F.xxhash64("a", "b", "start"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("b", "a", "start"), F.col("columns")).cast("int")
    cell = lambda i, j, own, stream: f"struct({i} as i, {j} as j, {own} as own, {stream} as stream)"
    as_piece = F.expr(f"transform(sequence(0, cast(columns as int) - 1), j -> {cell('__i', 'j', 'cast(null as bigint)', 'true')})")
    as_passage = F.expr(f"transform(sequence(0, cast(rows as int) - 1), i -> {cell('i', '__j', 'own', 'false')})")
    whole = F.array(F.expr(cell("0", "0", "own", "true")))
    cells = F.when((F.col("rows") == 1) & (F.col("columns") == 1), whole).when(F.col("own").isNull(), as_piece).otherwise(F.concat(as_piece, as_passage))
    streamed = streamed.withColumns({"__i": dealt[0], "__j": dealt[1]}).withColumn("x", F.explode(cells))
    streamed = streamed.select("shard", "x.i", "x.j", "a", "b", "start", "at", "copies", "words", "x.own", "x.stream")

    def search(rows: pa.Table) -> pa.Table:
        out = locate(rows, window, phrase)
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["a", "b", "lo", "hi"])

    found = streamed.groupBy("shard", "i", "j").applyInArrow(search, "a bigint, b bigint, lo int, hi int")
    out = stored(found.groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "repeats")
    discard(places, full)
    release(spark)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, keep=None, text: str = "text", **bounds: int) -> DataFrame:
    """docs with n_words, n_removed and kept (the words that stay, joined by one space).

    Words are [^\\x20\\x09-\\x0D]+. A word goes if a window of `window` words over it has the same words as a window that starts anywhere else,
    in the same text or another; copies of a text are other texts (equal 128-bit hashes say that texts are copies). Null and empty texts
    have no words, and shorter texts than a window no window. Input columns with those names give way. bounds: those of repeats().
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "n_removed", "kept")]
    base = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    base = base.withColumn("a", F.xxhash64("t")).withColumn("b", F.xxhash64(F.lit(1), "t"))
    found = repeats(base.select("a", "b", "t"), window, phrase, **bounds)
    whole = base.join(found.hint("shuffle_hash"), ["a", "b"], "left").select(*[f"k{i}" for i in range(len(keep))], "t", "ranges")
    schema = ", ".join([*[f"k{i} {whole.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))], "n_words bigint, n_removed bigint, kept string"])
    at = len(keep)

    def remove(batches):
        for part, texts in _texts(batches, at):
            kept, removed = [], []
            for words, ranges in zip(texts, part.column(at + 1).to_pylist()):
                stay, n, end = [], 0, 0
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                    if hi > end:
                        stay += words[end:lo] if lo > end else []
                        n += hi - max(lo, end)
                        end = hi
                kept.append(b" ".join(stay + words[end:]).decode())
                removed.append(n)
            yield _columns(" ".join([*part.schema.names[:at], "n_words n_removed kept"]), *part.columns[:at], pa.array([len(w) for w in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()))

    out = whole.mapInArrow(remove, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", "kept")
