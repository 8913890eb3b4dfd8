"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF layer on top, trained in numpy.

The network reads windows of WINDOW characters that overlap by WINDOW - STRIDE. Each window is decoded by Viterbi; a span is taken from
a window that holds it away from its edges, or put together from windows that each hold a part, and what windows say about one place is
settled over the whole text. The patterns' spans always stay; the network adds spans where no pattern of any kind matched, and none of
its own kind matched and failed its test.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, EDGE = 128, 80, 4
#: The bound of the training sample: documents that are read for it, whole, and windows of them that are trained on, again and again with
#: other variants set in until there are TRAINED.
SAMPLE, TRAINED = 4800, 2400
EMBED, HIDDEN = 12, 20
TAGS = 1 + 2 * len(KINDS)  # outside; then first and further characters of each kind
CODES = 131  # ASCII, other letters, anything else, padding

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ outwards: linear in the text, however long its words are."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def matches(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns by kind and start, and the matches that failed their test."""
    good: list[Span] = emails(text) if "@" in text else []
    bad: list[Span] = []
    if _DIGIT.search(text):
        # A match of these begins at the first digit of a run, which the look-behind says at once; this keeps long runs linear.
        for kind, pattern, test in (("ip", _IP, _small_parts), ("card", _CARD, _card), ("phone", _PHONE, _phone)):
            if kind == "phone" and "+" not in text:
                continue
            for m in pattern.finditer(text):
                (good if test(m.group()) else bad).append((kind, m.start(), m.end()))
    return good, bad


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small_parts(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def _card(s: str) -> bool:
    return len(s) <= 40 and 16 <= len(d := _digits(s)) <= 19 and luhn(d)


def _phone(s: str) -> bool:
    return 8 <= len(_digits(s)) <= 15


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(raw < 128, raw, np.where(raw < 0x2000, 128, 129))


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit or @.

    A span without either is never plausible (_plausible), and a span that runs from one of these windows into another has that read too, so
    reading every window gives the same spans.
    """
    last = max(0, -(-(len(text) - WINDOW) // STRIDE)) if len(text) > WINDOW else 0
    found: list[int] = []
    done = -1
    for m in _SIGN.finditer(text):
        p = m.start()
        for k in range(max(done + 1, 0, -(-(p - WINDOW + 1) // STRIDE)), min(last, p // STRIDE) + 1):
            found.append(k * STRIDE)
            done = k
    return found


def _cut(c: np.ndarray, starts: Sequence[int]) -> np.ndarray:
    out = np.full((len(starts), WINDOW), CODES - 1)
    for i, s in enumerate(starts):
        part = c[s : s + WINDOW]
        out[i, : len(part)] = part
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, an LSTM in each direction, emissions, CRF transitions. Parameters are numpy arrays in `p`."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"embed": n(CODES, EMBED) * 4, "out": n(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for side in ("f", "b"):
            self.p |= {f"w{side}": n(EMBED, 4 * HIDDEN), f"u{side}": n(HIDDEN, 4 * HIDDEN), f"c{side}": np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)}
        for to in range(2, TAGS, 2):  # a further character follows the same kind only; fixed, never trained
            self.p["trans"][:, to] = -20
            self.p["trans"][to - 1, to] = self.p["trans"][to, to] = 0

    def _lstm(self, x: np.ndarray, side: str, keep: bool):
        w, u, c = (self.p[k + side] for k in ("w", "u", "c"))
        n, t = x.shape[:2]
        gates = x @ w + c
        h, s = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, trace = np.empty((n, t, HIDDEN), np.float32), []
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            g = gates[:, k] + h @ u
            ifo = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            z = np.tanh(g[:, 3 * HIDDEN :])
            before, s = s, f * s + i * z
            th = np.tanh(s)
            if keep:
                trace.append((k, i, f, o, z, before, th, h))
            h = o * th
            out[:, k] = h
        return out, trace

    def _lstm_back(self, x, trace, d_out, side, grads):
        w, u = self.p["w" + side], self.p["u" + side]
        dh = ds = np.zeros((len(x), HIDDEN), np.float32)
        dx = np.zeros_like(x)
        for k, i, f, o, z, before, th, h in reversed(trace):
            dh = dh + d_out[:, k]
            ds = ds + dh * o * (1 - th**2)
            dg = np.concatenate([ds * z * i * (1 - i), ds * before * f * (1 - f), dh * th * o * (1 - o), ds * i * (1 - z**2)], axis=1)
            grads["w" + side] += x[:, k].T @ dg
            grads["u" + side] += h.T @ dg
            grads["c" + side] += dg.sum(axis=0)
            dx[:, k] = dg @ w.T
            dh, ds = dg @ u.T, ds * f
        return dx

    def emissions(self, x: np.ndarray, keep: bool = False):
        e = self.p["embed"][x]
        f, tf = self._lstm(e, "f", keep)
        b, tb = self._lstm(e, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["out"] + self.p["bias"], (e, both, tf, tb)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest tags of each window."""
        e, _ = self.emissions(x)
        score, back = e[:, 0].copy(), []
        score[:, 2::2] -= 20
        for t in range(1, x.shape[1]):
            total = score[:, :, None] + self.p["trans"]
            back.append(total.argmax(axis=1))
            score = total.max(axis=1) + e[:, t]
        out = np.empty(x.shape, np.int64)
        out[:, -1] = score.argmax(axis=1)
        for t in range(x.shape[1] - 2, -1, -1):
            out[:, t] = back[t][np.arange(len(x)), out[:, t + 1]]
        return out

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the CRF's negative log-likelihood, by the forward-backward sums."""
        e, (emb, both, tf, tb) = self.emissions(x, True)
        n, t, trans = len(x), x.shape[1], self.p["trans"]
        alpha, beta = np.empty((t, n, TAGS)), np.zeros((t, n, TAGS))
        alpha[0] = e[:, 0]
        for k in range(1, t):
            alpha[k] = e[:, k] + _lse(alpha[k - 1][:, :, None] + trans, 1)
        for k in range(t - 2, -1, -1):
            beta[k] = _lse(trans + (beta[k + 1] + e[:, k + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
        rows, at = np.arange(n)[:, None], np.arange(t)
        de[rows, at, y] -= 1
        d_trans = np.zeros_like(trans)
        for k in range(1, t):
            d_trans += np.exp(alpha[k - 1][:, :, None] + trans + (beta[k] + e[:, k])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(d_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        de = (de / n).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["trans"] = np.where(trans < -10, 0, d_trans / n).astype(np.float32)
        grads["out"], grads["bias"] = np.einsum("nth,ntk->hk", both, de), de.sum(axis=(0, 1))
        d_both = de @ self.p["out"].T
        dx = self._lstm_back(emb, tf, d_both[:, :, :HIDDEN], "f", grads) + self._lstm_back(emb, tb, d_both[:, :, HIDDEN:], "b", grads)
        np.add.at(grads["embed"], x.ravel(), dx.reshape(-1, EMBED))
        return grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 7, batch: int = 48, rate: float = 0.01, seed: int = 9) -> Tagger:
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(order), batch):
                take, step = order[i : i + batch], step + 1
                for k, g in self.step(x[take], y[take]).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g**2
                    pace = rate * (0.3 if epoch >= epochs * 3 // 4 else 1)
                    self.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def variants(r: np.random.Generator) -> tuple[str, str]:
    """A written form that the patterns do not match, with its kind: what the network is to add."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(r.choice(list("abcdefghijklmnoprstuvw"), r.integers(3, 9)))
    choice = r.integers(0, 6)
    if choice == 0:
        return f"({d(3)}) {d(3)}-{d(4)}", "phone"
    if choice == 1:
        return f"00{d(2)} {d(3)} {d(3)} {d(4)}", "phone"
    if choice == 2:
        return f"{word()}.{d(2)} @ {word()}{d(1)}.example.com", "email"
    if choice == 3:
        return f"{word()}{d(2)}@{word()} dot com", "email"
    if choice == 4:
        return ":".join(f"{int(x):x}" for x in r.integers(256, 65536, 8)), "ip"
    return f"{word()}.{word()}@{word()}", "email"


def _tags(length: int, spans: Sequence[Span], start: int) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        a, b, k = a - start, b - start, KINDS.index(kind)
        if b > 0 and a < length:
            y[max(a, 0) : b] = 2 + 2 * k
            if a >= 0:
                y[a] = 1 + 2 * k
    return y


def fit(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> Tagger:
    """Trains on windows labelled by the patterns' spans, over half of them with a variant set in.

    The windows are those of about `sample` whole documents with a digit or @, chosen by a hash of id and text; of their distinct windows
    the TRAINED first by a hash count. Texts never leave their tasks. The same rows give the same model, however they are partitioned.
    """
    signed = docs.filter(F.col(text).rlike("[0-9@]"))
    n = signed.count()
    key = F.pmod(F.xxhash64(F.lit(17), *[F.col(c) for c in ("doc_id",) if c in docs.columns], F.col(text)), F.lit(1 << 30))
    some = signed.filter(key < math.ceil(min(1, sample / max(1, n)) * (1 << 30)))

    def make():
        return lambda raw: [[[s[k : k + WINDOW] for k in windows(s)] for s in (b.decode() for b in raw)]]

    each = map_texts(some, make, "windows array<string>", [], text).select(F.explode("windows").alias("w")).distinct()
    got = [r["w"] for r in each.orderBy(F.xxhash64("w"), "w").limit(TRAINED).collect()]
    r = np.random.default_rng(13)
    got = got or ["".join(r.choice(list("abcdef ,."), WINDOW)) for _ in range(64)]
    xs, ys = [], []
    for k in range(TRAINED):
        w = got[k % len(got)]
        spans = matches(w)[0]
        if r.random() < 0.6:
            free = [i for i, c in enumerate(w) if c == " " and not any(a <= i < b for _, a, b in spans)]
            form, kind = variants(r)
            at = free[r.integers(0, len(free))] + 1 if free else len(w)
            shift = len(form) + 1
            spans = [(n, a + shift * (a >= at), b + shift * (a >= at)) for n, a, b in spans] + [(kind, at, at + len(form))]
            w = w[:at] + form + " " + w[at:]
        xs.append(_cut(codes(w), [0])[0])
        ys.append(_tags(WINDOW, spans, 0))
    return Tagger().train(np.array(xs), np.array(ys))


def _plausible(kind: str, s: str) -> bool:
    n = len(_digits(s))
    return {"email": "@" in s and len(s) >= 6, "ip": n >= 4 and (s.count(":") >= 3 or s.count(".") >= 3), "card": 16 <= n <= 19 and luhn(_digits(s)), "phone": 9 <= n <= 15}[kind]


def _pieces(tags: np.ndarray) -> list[Span]:
    """Spans of one window's tags, by start."""
    out, inner = [], np.flatnonzero(tags)
    for a in inner[tags[inner] % 2 == 1]:
        b = a + 1
        while b < len(tags) and tags[b] == tags[a] + 1:
            b += 1
        out.append((KINDS[(tags[a] - 1) // 2], int(a), int(b)))
    return out


def _whole(length: int, read: dict[int, list[Span]]) -> tuple[set[Span], set[int]]:
    """Spans of one text from the pieces of its windows by start, and the windows that a piece goes on into but that are not read yet.

    A piece that runs into the edge of its window goes on in the next window with the piece that it overlaps there.
    """
    spans: set[Span] = set()
    missing: set[int] = set()
    begun: list[Span] = []  # cut on the right by the window at `last`
    last = None
    for s in sorted(read):
        if last != s - STRIDE:
            begun = []
        on: list[Span] = []
        for kind, a, b in read[s]:
            a, b = s + a, min(s + b, length)
            if a < s + EDGE and s > 0:
                if s - STRIDE not in read:
                    missing.add(s - STRIDE)
                starts = [x for k, x, y in begun if k == kind and x < b and a < y]
                if not starts:
                    continue
                a = min(starts)
            if b > s + WINDOW - EDGE and s + WINDOW < length:
                if s + STRIDE not in read:
                    missing.add(s + STRIDE)
                on.append((kind, a, b))
            else:
                spans.add((kind, a, b))
        begun, last = on, s
    return spans, missing


def decode_all(model: Tagger, texts: Sequence[str], first=windows) -> list[list[Span]]:
    """The network's spans of each text, settled over its windows: of overlapping ones the longer stays, then the first. first: windows to begin with."""
    read: list[dict[int, list[Span]]] = [{} for _ in texts]
    found: list[set[Span]] = [set() for _ in texts]
    jobs = [(i, s) for i, t in enumerate(texts) for s in first(t)]
    while jobs:
        for k in range(0, len(jobs), 512):
            part = jobs[k : k + 512]
            x = np.concatenate([_cut(codes(texts[i][s : s + WINDOW]), [0]) for i, s in part])
            for (i, s), tags in zip(part, model.decode(x)):
                read[i][s] = _pieces(tags)
        touched, jobs = sorted({i for i, _ in jobs}), []
        for i in touched:
            found[i], missing = _whole(len(texts[i]), read[i])
            jobs += [(i, s) for s in sorted(missing)]
    out = []
    for text, spans in zip(texts, found):
        kept: list[Span] = []
        for x in sorted((x for x in spans if _plausible(x[0], text[x[1] : x[2]])), key=lambda x: (x[1] - x[2], x[1], x[0])):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
                kept.append(x)
        out.append(kept)
    return out


def find(model: Tagger, texts: Sequence[str]) -> list[tuple[list[Span], list[Span]]]:
    """(patterns' spans, all spans) of each text, by kind and start."""
    out = []
    for text, more in zip(texts, decode_all(model, texts)):
        base, bad = matches(text)
        extra = [x for x in more if all(x[2] <= a or b <= x[1] for _, a, b in base) and not any(k == x[0] and a <= x[1] and x[2] <= b for k, a, b in bad)]
        order = lambda x: (KINDS.index(x[0]), x[1])
        out.append((sorted(base, key=order), sorted(base + extra, key=order)))
    return out


def _joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, model: Tagger, keep=None, text: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (patterns' spans), base and spans (kind:start:end in code points, comma-joined).

    Null and empty texts have none. Repeated rows are judged alike; columns of those names give way.
    """

    def make():
        def work(raw):
            rows = find(model, [b.decode() for b in raw])
            return [*[[sum(x[0] == k for x in base) for base, _ in rows] for k in KINDS], [_joined(b) for b, _ in rows], [_joined(s) for _, s in rows]]

        return work

    return map_texts(docs, make, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string", keep, text)


def redact(docs: DataFrame, model: Tagger, text: str = "text") -> DataFrame:
    """docs with every span of personal data written as <kind>; where spans of two kinds overlap, the first covers both. Null texts stay null."""

    def clean(t: str, spans: Sequence[Span]) -> str:
        out, at = [], 0
        for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
            if a >= at:
                out += [t[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def make():
        def work(raw):
            texts = [b.decode() for b in raw]
            return [[clean(t, s) for t, (_, s) in zip(texts, find(model, texts))]]

        return work

    out = map_texts(docs, make, "__clean string", None, text)
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.col("__clean"))).drop("__clean")
