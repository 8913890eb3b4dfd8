"""Sequence comparison as Arrow-vectorised functions over difflib: what Column expressions cannot say.

Every kernel takes its arguments in the order (original, revised), as the ratio is not symmetric, and says whether popular elements
of the revised side are ignored as anchors (difflib's autojunk).
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache
from textwrap import wrap

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("a0", "a1", "b0", "b1")]]))
CHUNKS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))


def ratio(a, b, autojunk: bool = True) -> float:
    return SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


def opcodes(a, b, autojunk: bool) -> list[tuple[str, int, int, int, int]]:
    """(op, a0, a1, b0, b1). Equal ends are not cut off first: that would change which of several equal matches is chosen."""
    if autojunk and len(b) >= 200:  # popular elements are ignored from this length on
        return SequenceMatcher(None, list(a), list(b), autojunk=True).get_opcodes()
    a, b = list(a), list(b)
    return edits(one_edit(a, b) or matching_blocks(a, b), len(a), len(b))


def one_edit(a: list, b: list) -> list[tuple[int, int, int]] | None:
    """The equal runs of sequences that differ in one run, between equal ends, whose elements stand nowhere on the other side; else None.

    Matching elements then lie in the ends only, and no match is longer than the longer end. If both runs hold elements, matches keep within an
    end on both sides, so the ends match each other. If one run is empty, the ends meet on its side, and a match as long as the second end
    might begin before it there: that is settled only if the first end is no shorter, as the first of the longest matches is then that end.
    """
    most = min(len(a), len(b))
    p = next((i for i in range(most) if a[i] != b[i]), most)
    s = next((i for i in range(most - p) if a[-1 - i] != b[-1 - i]), most - p)
    gone, new = a[p : len(a) - s], b[p : len(b) - s]
    if not (gone and new or p >= s) or not set(gone).isdisjoint(b) or not set(new).isdisjoint(a):
        return None
    return [x for x in ((0, 0, p), (len(a) - s, len(b) - s, s)) if x[2]] if gone or new else None


SMALL = 400  # elements of both sides up to which difflib is faster


class PhraseRanks:
    """Numbers for all phrases of two sequences, by doubling: equal phrases of 2^p elements have equal ranks, and two overlapping ranks name any length.

    Exact: ranks stand for the phrases themselves, not for hashes of them. Takes n log n room and time, however often elements recur.
    """

    def __init__(self, a: list, b: list):
        ids: dict = {}
        self.shift = len(a) + 1
        both = [ids.setdefault(x, len(ids) + 1) for x in a] + [0] + [ids.setdefault(x, len(ids) + 1) for x in b]
        self.levels = [np.array(both, dtype=np.int64)]

    def level(self, p: int) -> np.ndarray:
        while len(self.levels) <= p:
            r, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.unique(r[: len(r) - half] * (int(r.max()) + 1) + r[half:], return_inverse=True)[1].reshape(-1))
        return self.levels[p]

    def phrases(self, lo: int, hi: int, k: int) -> np.ndarray:
        """Names of the phrases of k elements within [lo, hi)."""
        p = k.bit_length() - 1
        r = self.level(p)
        return r[lo : hi - k + 1] * len(self.levels[0]) + r[lo + k - (1 << p) : hi - (1 << p) + 1]

    def longest(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """(i, j, k) of the longest common phrase of a[a0:a1] and b[b0:b1]: of equal ones the first in a, then the first in b."""
        best, low, high = (a0, b0, 0), 0, min(a1 - a0, b1 - b0) + 1
        step = 1
        while high - low > 1:  # a common phrase of k elements holds one of k - 1
            k = min(low + step, high - 1) if step else (low + high) // 2
            x, y = self.phrases(a0, a1, k), self.phrases(b0 + self.shift, b1 + self.shift, k)
            met = np.isin(x, y)
            if met.any():
                i = int(met.argmax())
                best, low, step = (a0 + i, b0 + int((y == x[i]).argmax()), k), k, step * 2
            else:
                high, step = k, 0
        return best


def matching_blocks(a: list, b: list, small: int = SMALL) -> list[tuple[int, int, int]]:
    """(i, j, k) of the equal runs that difflib finds when every element is an anchor, neighbours joined."""
    ranks = PhraseRanks(a, b) if len(a) + len(b) > small else None
    found, open_ranges = [], [(0, len(a), 0, len(b))]
    while open_ranges:
        a0, a1, b0, b1 = open_ranges.pop()
        if a0 == a1 or b0 == b1:
            continue
        if ranks is None or a1 - a0 + b1 - b0 <= small:
            found += [(a0 + i, b0 + j, k) for i, j, k in SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_matching_blocks() if k]
            continue
        i, j, k = ranks.longest(a0, a1, b0, b1)
        if k:
            found.append((i, j, k))
            open_ranges += [(a0, i, b0, j), (i + k, a1, j + k, b1)]
    out: list[tuple[int, int, int]] = []
    for i, j, k in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out


def edits(blocks: list[tuple[int, int, int]], n: int, m: int) -> list[tuple[str, int, int, int, int]]:
    """Opcodes between and over equal runs."""
    out, i, j = [], 0, 0
    for x, y, k in [*blocks, (n, m, 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if k:
            out.append(("equal", x, x + k, y, y + k))
        i, j = x + k, y + k
    return out


@pandas_udf(T.StringType())
def nfkc_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def compatible(text: Column) -> Column:
    """B1's compatibility step: NFKC. ASCII texts never go to Python."""
    return F.coalesce(nfkc_udf(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _half_even(value: float | None, digits: int) -> float | None:
    return None if value is None or value != value else round(value, digits)


@pandas_udf(T.DoubleType())
def round2(value: pd.Series) -> pd.Series:
    """Rounded to 2 digits as the binary number is: half to even, 2.675 to 2.67."""
    return value.map(lambda v: _half_even(v, 2))


@pandas_udf(T.DoubleType())
def round4(value: pd.Series) -> pd.Series:
    return value.map(lambda v: _half_even(v, 4))


def _pairwise(f: Callable) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """f for each row; equal pairs of arguments are computed once in a batch."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict = {}
        out = []
        for x, y in zip(a, b):
            key = (x, y)
            if key not in seen:
                seen[key] = None if x is None or y is None else f(x, y)
            out.append(seen[key])
        return pd.Series(out, dtype="float64")

    return run


def score100(a: str, b: str) -> float:
    """100 for two empty texts, 0 if one is empty, else the ratio in percent, 2 digits."""
    if not a and not b:
        return 100.0
    return round(ratio(a, b) * 100, 2) if a and b else 0.0


def share(a: str, b: str) -> float:
    """1 for two empty texts, 0 if one is empty, else the ratio."""
    if not a and not b:
        return 1.0
    return ratio(a, b) if a and b else 0.0


_letters = lru_cache(maxsize=1 << 12)(Counter)


def share_from(a: str, b: str, least: float) -> float:
    """share where it can be `least` or more, else 0: lengths, then the characters in common, bound it."""
    if not a or not b or a == b:
        return 1.0 if a == b or not a and not b else 0.0
    both = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) / both < least:
        return 0.0
    x, y = _letters(a), _letters(b)
    return ratio(a, b) if 2.0 * sum(min(n, y[c]) for c, n in x.items()) / both >= least else 0.0


@pandas_udf(T.DoubleType())
def score100_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of texts already normalised by block_key."""
    return _pairwise(score100)(a, b)


@pandas_udf(T.DoubleType())
def share_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of texts already normalised by alignment_key or block_key."""
    return _pairwise(share)(a, b)


@pandas_udf(T.DoubleType())
def exact_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """every element is an anchor. Of texts already normalised by clause_key."""
    return _pairwise(lambda x, y: ratio(x, y, False))(a, b)


@pandas_udf(T.DoubleType())
def score100_from_udf(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """F1 where it can be `least` or more, else null: the characters in common bound it."""

    def run(x: str, y: str, at: float) -> float | None:
        if x and y and SequenceMatcher(None, x, y).quick_ratio() * 100 < at - 0.01:
            return None
        return score100(x, y)

    seen: dict = {}
    out = []
    for key in zip(a, b, least):
        if key not in seen:
            seen[key] = run(*key)
        out.append(seen[key])
    return pd.Series(out, dtype="float64")


@pandas_udf(T.BooleanType())
def alike_udf(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Is F12's ratio at `least` or more? Most rows are settled by a bound: the characters in common, then the ratio itself."""

    def alike(x: str, y: str, at: float) -> bool:
        m = SequenceMatcher(None, x, y, autojunk=False)
        return m.real_quick_ratio() >= at and m.quick_ratio() >= at and m.ratio() >= at

    return pd.Series([x is not None and y is not None and alike(x, y, at) for x, y, at in zip(a, b, least)], dtype=bool)


def _best_of(texts: list[str], others: list[str]) -> list[float]:
    """score100 of each text and the other it is likest to. Others are tried by falling bound (characters in common) until none can be better."""
    others = list(dict.fromkeys(others))
    met = set(others)
    known: dict[str, float] = {t: 100.0 for t in texts if t and t in met}  # equal texts need no counts
    open_to = [t for t in dict.fromkeys(texts) if t not in known]
    if not open_to:
        return [known[t] for t in texts]
    letters = {c: k for k, c in enumerate(sorted({c for t in (*open_to, *others) for c in t}))}

    def counted(rows: list[str]) -> np.ndarray:
        out = np.zeros((len(rows), len(letters)), np.int32)
        for n, t in enumerate(rows):
            out[n] = np.bincount([letters[c] for c in t], minlength=len(letters)) if t else 0
        return out

    size, have = np.array([len(t) for t in others]), counted(others)
    for text, own in zip(open_to, counted(open_to)):
        bound = 200.0 * np.minimum(have, own).sum(axis=1) / np.maximum(size + len(text), 1)
        best = 0.0
        for k in np.argsort(-bound, kind="stable"):
            if text and round(float(bound[k]), 2) <= best:
                break
            best = max(best, score100(text, others[k]))
            if best == 100.0:
                break
        known[text] = best
    return [known[t] for t in texts]


@pandas_udf(T.DoubleType())
def average_best_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """H1 over arrays of texts already normalised by block_key: mean of both directions' mean best score, not rounded; 0 if a side has none."""
    out = []
    for x, y in zip(a, b):
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        if not x or not y:
            out.append(0.0)
            continue
        there, back = _best_of(x, y), _best_of(y, x)
        out.append((math.fsum(there) / len(there) + math.fsum(back) / len(back)) / 2)
    return pd.Series(out, dtype="float64")


def _ops(autojunk: bool):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [{"op": o, "a0": i, "a1": j, "b0": k, "b1": n} for o, i, j, k, n in opcodes(x, y, autojunk)] for x, y in zip(a, b)])

    return run


@pandas_udf(OPS)
def ops_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Opcodes of two key arrays, popular elements ignored."""
    return _ops(True)(a, b)


@pandas_udf(OPS)
def exact_ops_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Opcodes of two key arrays, every element an anchor."""
    return _ops(False)(a, b)


def settle_edges(chunks: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """white space at an edge of a changed chunk moves to its neighbour; chunks left empty go. Walks left to right, so a chunk may pass on what it was given."""
    out = [list(c) for c in chunks]
    blank = " \n\t"
    for i, (kind, _) in enumerate(chunks):
        if kind == "equal":
            continue
        if i + 1 < len(out):
            bare = out[i][1].rstrip(blank)
            out[i + 1][1] = out[i][1][len(bare) :] + out[i + 1][1]
            out[i][1] = bare
        if i:
            bare = out[i][1].lstrip(blank)
            out[i - 1][1] += out[i][1][: len(out[i][1]) - len(bare)]
            out[i][1] = bare
    return [(k, t) for k, t in out if t]


def clause_chunks(a: list[str], a_keys: list[str], b: list[str], b_keys: list[str]) -> list[tuple[str, str]]:
    """F10 before F11: equal, delete and insert texts from token arrays and their keys; equal text is the revised one, neighbours of one kind are joined."""
    out: list[tuple[str, str]] = []

    def add(kind: str, tokens) -> None:
        text = "".join(tokens)
        if text and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + text)
        elif text:
            out.append((kind, text))

    for op, i, j, k, n in opcodes(a_keys, b_keys, False):
        if op == "equal":
            add("equal", b[k:n])
        else:
            add("delete", a[i:j])
            add("insert", b[k:n])
    return out


def _chunks(settle: bool):
    def run(a: pd.Series, ak: pd.Series, b: pd.Series, bk: pd.Series) -> pd.Series:
        rows = []
        for x, xk, y, yk in zip(a, ak, b, bk):
            if x is None or len(x) == 0:
                found = [("insert", "".join(y))] if y is not None and len(y) else []
            elif y is None or len(y) == 0:
                found = [("delete", "".join(x))]
            else:
                found = clause_chunks(list(x), list(xk), list(y), list(yk))
                found = settle_edges(found) if settle else found
            rows.append([{"type": k, "text": t} for k, t in found])
        return pd.Series(rows)

    return run


@pandas_udf(CHUNKS)
def raw_chunks_udf(a: pd.Series, ak: pd.Series, b: pd.Series, bk: pd.Series) -> pd.Series:
    return _chunks(False)(a, ak, b, bk)


@pandas_udf(CHUNKS)
def clause_chunks_udf(a: pd.Series, ak: pd.Series, b: pd.Series, bk: pd.Series) -> pd.Series:
    """F10 and F11 over spaced_tokens and spaced_keys of both sides; a side that is null or empty gives one insert or delete."""
    return _chunks(True)(a, ak, b, bk)


@pandas_udf(T.ArrayType(T.BooleanType()))
def first_free_udf(i: pd.Series, j: pd.Series) -> pd.Series:
    """Of candidates in order of preference, those whose both ends are still free."""

    def choose(left_ends, right_ends) -> list[bool]:
        left, right, keep = set(), set(), []
        for x, y in zip(left_ends.tolist(), right_ends.tolist()):
            keep.append(x not in left and y not in right)
            if keep[-1]:
                left.add(x)
                right.add(y)
        return keep

    return pd.Series([choose(x, y) for x, y in zip(i, j)])


@pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def section_paths_udf(levels: pd.Series, titles: pd.Series) -> pd.Series:
    """The path at each heading of a document: a heading of level k follows the first k - 1 titles of the path before it."""

    def of(ks, ts):
        path, out = [], []
        for k, t in zip(ks, ts):
            path = [*path[: max(k - 1, 0)], t]
            out.append(path)
        return out

    return pd.Series([of(k, t) for k, t in zip(levels, titles)])


@pandas_udf(T.ArrayType(T.StringType()))
def wrapped_udf(text: pd.Series, width: pd.Series) -> pd.Series:
    """Lines of a paragraph, broken at white space, hyphens or, in longer words, anywhere, at most `width` characters each."""
    return pd.Series([None if t is None else wrap(t, int(w)) for t, w in zip(text, width)])


@pandas_udf(T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("y", T.DoubleType())])))
def pages_of_udf(rows: pd.Series, margin: pd.Series, pitch: pd.Series, height: pd.Series) -> pd.Series:
    """Page and height of each written row of a document; a row that begins below the bottom margin starts a page at the top margin."""

    def of(places, top, step, size):
        page, shift, out = 0, 0, []
        for k in places:
            if top + step * (k - shift) > size - top:
                page, shift = page + 1, k
            out.append({"page": page, "y": top + step * (k - shift)})
        return out

    return pd.Series([of(*x) for x in zip(rows, margin, pitch, height)])


@arrow_udf(T.ArrayType(T.LongType()))
def phrases_udf(words: pa.Array, size: pa.Array) -> pa.Array:
    """The distinct runs of `size` words of each text, as 64-bit hashes of the hashes of its words, sorted; texts of fewer words have none."""
    k = int(size[0].as_py()) if len(size) else 1
    at, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False).view(np.uint64)
    factors = np.random.default_rng(k).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = max(len(flat) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(k if n else 0):
        h += flat[i : n + i] * factors[i]
    h = ((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    found = [np.unique(h[s : max(e - k + 1, s)]) for s, e in zip(at[:-1], at[1:])]
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))


BOXES = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("y0", "x0", "x1", "y1")]))


@arrow_udf(BOXES)
def joined_boxes_udf(line: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, gap: pa.Array, pad: pa.Array) -> pa.Array:
    """Boxes of each row's words, which stand in order of line, x0 and y0: words of a line are joined while the space after all before them is `gap` or less; padded."""
    least, by = (c[0].as_py() if len(c) else 0.0 for c in (gap, pad))
    at = line.offsets.to_numpy() - (line.offsets[0].as_py() if len(line) else 0)
    n, a, b, c, d = (x.flatten().to_numpy(zero_copy_only=False) for x in (line, x0, y0, x1, y1))
    first = np.zeros(len(n), bool)
    first[at[:-1][at[:-1] < len(n)]] = True
    first[1:] |= n[1:] != n[:-1]
    values, rank = np.unique(c, return_inverse=True)
    base = (np.cumsum(first) - 1) * len(values)
    reach = values[np.maximum.accumulate(base + rank) - base] if len(n) else c  # the furthest end so far on the line
    first[1:] |= a[1:] - reach[:-1] > least
    start = np.flatnonzero(first)
    made = [np.maximum(np.minimum.reduceat(b, start) - by, 0.0), np.maximum(np.minimum.reduceat(a, start) - by, 0.0), np.maximum.reduceat(c, start) + by, np.maximum.reduceat(d, start) + by] if len(start) else [b, a, c, d]
    boxes = pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in made], names=["y0", "x0", "x1", "y1"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, at).astype(np.int32)), boxes)
