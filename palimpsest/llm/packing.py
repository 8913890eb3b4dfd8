"""Packing token ids into sequences by minimum bin slack.

Documents longer than a sequence give whole sequences and a remainder. Remainders are packed by lengths: a sequence takes the longest
one left, and a subset-sum bitset over the multiset of the other lengths finds the filling closest to capacity; the stages of the
bitset are walked back for the count of each length. A filling is used again as often as the counts allow.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import split_batch

SEQUENCE = 1024
TOKENIZER = "byte_bpe_50k.json"
#: Ids that a task holds before it packs what it has; unfilled remainders stay for the next block, at most this share of them.
BLOCK_IDS = 4 << 20
#: Fixed value: how byte-level BPE cuts a text into the pieces that it merges within.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Count of each length (counts[length] of them left) whose sum is as close to capacity as possible, not above it.

    Bit s of `reach` says that a subset sums to s. Copies of a length are added in powers of two; lengths go from long to short, and the
    search ends early once the capacity itself is reached, as nothing can be closer.
    """
    mask, reach, stages = (1 << capacity + 1) - 1, 1, []
    for length in range(min(capacity, len(counts) - 1), 0, -1):
        left, copies = min(int(counts[length]), capacity // length), 1
        while left:
            take = min(copies, left)
            stages.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            copies *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(stages):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def minimum_bin_slack(counts: np.ndarray, capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(lengths with their counts in one bin, number of such bins) until no item is left; counts is used up."""
    for longest in range(len(counts) - 1, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            used = fill(counts, capacity - longest)
            counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            times = min(int(counts[k]) // n for k, n in used.items())
            for k, n in used.items():
                counts[k] -= n * times
            yield used, times


class Ids:
    """Token ids as little-endian 32-bit bytes, as the tokenizers library gives them for the file at `path` with its defaults.

    Texts of ASCII and Latin letters, where the split into pieces is beyond doubt, run the file's own merges in tiktoken, several times faster;
    any other text, any that holds an added token's string (which is that token), and any file that is not a byte-level BPE whose ids are
    ranks, goes to tokenizers. Tests hold the two against each other.
    """

    simple = re.compile("[\t-\r -~\u00a1-\u00a8\u00ab-\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u017f]*")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self._merges(path)

    @staticmethod
    def _merges(path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            return None
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        if self.merges is not None and self.simple.fullmatch(text) and not any(t in text for t in self.added):
            return array("I", self.merges.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_IDS: dict[str, Ids] = {}


class Packer:
    """Takes documents' ids, gives back pieces placed in sequences; bounded by BLOCK_IDS."""

    def __init__(self, length: int, first_sequence: int) -> None:
        self.length, self.next = length, first_sequence
        self.left: list[list] = [[] for _ in range(length)]  # remainders by length
        self.out: list[tuple] = []
        self.held = 0

    def add(self, key, ids: bytes) -> None:
        total, whole = len(ids) // 4, len(ids) // 4 // self.length * self.length
        for at in range(0, whole, self.length):
            self.out.append((key, at, ids[4 * at : 4 * (at + self.length)], total, self.next, 0))
            self.next += 1
        if whole < total:
            self.left[total - whole].append((key, whole, ids[4 * whole :], total))
        self.held += total

    def pack(self, last: bool) -> list[tuple]:
        """Pieces placed since the last call. Unless it is the last, bins that are not full wait for more remainders if there are few of them."""
        counts, out = np.array([len(x) for x in self.left]), self.out
        held = 0
        for used, times in minimum_bin_slack(counts, self.length):
            size = sum(k * n for k, n in used.items())
            if not last and size < self.length and 4 * (held + size * times) <= BLOCK_IDS:
                held += size * times  # these stay at the front of the lists
                continue
            for _ in range(times):
                at = 0
                for k, n in used.items():
                    for _ in range(n):
                        key, start, ids, total = self.left[k].pop()
                        out.append((key, start, ids, total, self.next, at))
                        at += k
                self.next += 1
        self.out, self.held = [], held
        return out


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end: int = 0, text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all docs, each followed by the id `end`, in sequences of at most `length`.

    ids holds little-endian 32-bit ids. A sequence's pieces lie at offsets without gaps from 0; what is missing to `length` is padding.
    A null or empty text has the id `end` alone. doc_id may be of any plain type. Null doc_ids and repeated rows are documents of their own. Other columns are not read, so
    clashing names do not matter. Each task packs its own rows in blocks of bounded size: nothing is shuffled, and a task that runs again
    packs the same rows alike. sequence_id is unique: the task's number times 2^40 plus a count.
    """
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        if tokenizer not in _IDS:
            _IDS[tokenizer] = Ids(tokenizer)
        ids = _IDS[tokenizer]
        packer = Packer(length, TaskContext.get().partitionId() << 40)

        def rows(last: bool):
            pieces = packer.pack(last)
            for i in range(0, len(pieces), 4096):
                key, start, raw, total, sequence, at = zip(*pieces[i : i + 4096])
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, to_arrow_type(kind)), long(start), long([len(x) // 4 for x in raw]), pa.array(raw, pa.binary()), long(total), long(sequence), long(at)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        for batch in batches:
            for part in split_batch(batch):
                for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packer.add(key, ids.of(t) + tail)
                    if packer.held >= BLOCK_IDS:
                        yield from rows(False)
        yield from rows(True)

    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
