"""Each operator against a brute-force version or an exact round trip, and on null, empty, long, repeated and clashing input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from palimpsest.llm import licenses, packing, pii, quality, reputation, sharding, simhash, substrings, topk  # noqa: E402
from palimpsest.llm import decontamination as dec  # noqa: E402

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(20000))


def corpus(seed=1, n=40):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta.", "été", "straße", "x", "42", "the", "of"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 60)))) for i in range(n)]
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, rows[5][1] + " tail"), (n + 3, None), (n + 4, ""), (n + 5, " \n\t"), (n + 6, "De " * 90), (n + 7, LONG), (None, rows[4][1]), (n + 8, "a\u00a0b\u3000c")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows] + [(3, rows[3][1], "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Packing

def test_fill_is_closest_to_capacity():
    r = random.Random(2)
    for _ in range(200):
        items = [r.randint(1, 12) for _ in range(r.randint(0, 9))]
        capacity = r.randint(0, 40)
        used = packing.fill(np.bincount(items, minlength=14) if items else np.zeros(14, int), capacity)
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= capacity)
        have = Counter(items)
        assert sum(k * n for k, n in used.items()) == best and all(n <= have[k] for k, n in used.items())


def test_packing_round_trip(spark, docs, empty):
    path = public_tokenizers.path(packing.TOKENIZER)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    pieces = packing.pack(docs.withColumn("start", F.lit(1)).withColumn("ids", F.lit("x")), path, length=64).toPandas()
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids) + (0,)) for i, x, *_ in corpus())
    got = Counter()
    for key, rows in pieces.groupby(pieces.doc_id.fillna(-1)):
        rows = rows.sort_values(["start", "sequence_id"])
        copies = (rows.start == 0).sum()
        for c in range(copies):
            ids, at = [], 0
            for start in sorted(rows.start.unique()):
                raw = rows[rows.start == start].iloc[c].ids
                assert start == at
                ids += np.frombuffer(raw, "<u4").tolist()
                at += len(raw) // 4
            got[(None if key == -1 else int(key), tuple(ids))] += 1
    assert got == want
    for _, rows in pieces.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 64
    assert packing.pack(empty, path).count() == 0
    named = packing.pack(spark.createDataFrame([("x-1", "one <|endoftext|> two")], "doc_id string, text string"), path).first()
    assert named.doc_id == "x-1" and np.frombuffer(named.ids, "<u4").tolist() == [*t.encode("one <|endoftext|> two", add_special_tokens=False).ids, 0] and 50256 in np.frombuffer(named.ids, "<u4")


def test_fast_ids_equal_tokenizers():
    from tokenizers import Tokenizer

    ids, plain, r = packing.Ids(public_tokenizers.path(packing.TOKENIZER)), Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), random.Random(7)
    assert ids.merges is not None
    bits = [" ", "  ", "\n", "\t", "a", "b's", "é", "1", ".", "!?", "<|endoftext|>", "\x1c", "日本", "\x00", "\x85", "ſt", "²", "\xa0", "ß", "Don't", "½", "\x7f"]
    for _ in range(3000):
        x = "".join(r.choices(bits, k=r.randint(0, 14)))
        assert np.frombuffer(ids.of(x), "<u4").tolist() == plain.encode(x, add_special_tokens=False).ids, repr(x)


# Licenses

def test_patience_alignment():
    assert licenses.longest_rising([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]
    r = random.Random(4)
    for _ in range(200):
        a, b = [r.choices(b"abcdefgh", k=r.randint(0, 12)) for _ in range(2)]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert licenses.align(list(b"abc"), list(b"abc")) == [(0, 0), (1, 1), (2, 2)]


def test_license_scan(spark, docs, empty):
    mit = "Released under the MIT License."
    rows = [(1, f"some words {mit} more"), (2, f"{mit} {mit}"), (3, "released by the MIT"), (4, None), (5, LONG + " Licensed under CC BY-NC 4.0. " + LONG)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string").withColumn("license", F.lit("mine"))).collect()}
    assert [got[i].license for i in range(1, 6)] == ["MIT", "MIT", None, None, "CC-BY-NC-4.0"] and got[1].start == 2 and got[1].coverage == 1.0
    assert licenses.scan_licenses(docs, keep=["doc_id"]).filter("license is not null").count() == 0 and licenses.scan_licenses(empty).count() == 0


def longest_common(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_alignment_by_brute_force():
    r = random.Random(15)
    for _ in range(400):
        a, b = (r.sample(range(30), r.randint(0, 20)) for _ in range(2))
        assert len(licenses.align(a, b)) == longest_common(a, b)  # where no word recurs, nothing longer exists
        a, b = (r.choices(range(12), k=r.randint(0, 20)) for _ in range(2))
        assert len(licenses.align(a, b)) <= longest_common(a, b)
        pairs = [(i, y) for i, y in enumerate(r.choices(range(9), k=r.randint(0, 9)))]
        rising = max((k for k in range(len(pairs) + 1) for c in itertools.combinations(pairs, k) if all(p[1] < q[1] for p, q in zip(c, c[1:]))), default=0)
        assert len(licenses.longest_rising(pairs)) == rising


def test_scan_by_brute_force():
    """Every stretch of every length, aligned: no better place is missed than the scan finds; and what lies between a license's words does not matter."""
    r, template = random.Random(16), "one two three four five six seven eight"
    scanner = licenses.Scanner({"x": template}, 0.75)
    for _ in range(150):
        inner = [w.encode() for w in template.split() if r.random() < 0.9]
        for _ in range(r.choice([0, 0, 2, 30])):
            inner.insert(r.randrange(len(inner) + 1), b"pad%d" % r.randrange(40))
        words = [b"w%d" % r.randrange(20) for _ in range(r.randint(0, 9))] + inner + [b"w%d" % r.randrange(20) for _ in range(r.randint(0, 9))]
        best = max(len(licenses.align(words[i:j], template.encode().split())) for i in range(len(words)) for j in range(i + 1, len(words) + 1))
        found = scanner.scan(words)
        assert (found[0][4] if found else 0) == (best if best >= 6 else 0)


def test_license_ties_and_repeats(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "c d a b")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string"), {"y": "a b", "x": "c d", "z": "..."}, keep=["doc_id"]).collect()
    assert [(r.doc_id, r.license, r.licenses) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, "x", "x,y"), (1, "x", "x,y"), (2, "x", "x,y")]
    whole = {n: t for n, t in licenses.TEMPLATES.items()}
    out = licenses.Scanner(licenses.TEMPLATES, 1.0)
    assert all(n in [x[0] for x in out.scan(dec.normal_words(t.encode()))] for n, t in whole.items())


# Decontamination

def brute_hits(text, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(window, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[k : k + n]:
                    hit |= set(range(j, j + n))
                    ids.add(str(i) if i is not None else "")
    joined = ",".join(sorted(ids))
    return len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block,part", [(4 << 20, 4096), (300, 4096), (700, 26)])
def test_decontamination(spark, empty, block, part, monkeypatch):
    monkeypatch.setattr(dec, "PART_WORDS", part)
    r = random.Random(6)
    word = lambda: r.choice(["one", "two", "été", "x9", "Straße", "the"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 5, 14, 20])))) for i in range(8)] + [(8, None), (9, "..."), (10, "The the, the"), (None, "zz yy"), (3, "again one two")]
    items = [(str(i) if i is not None else None, t) for i, t in items] + [("a,b", "one two, the"), ("c", "one two the"), ("b", " ".join(word() for _ in range(90)))]
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 50))) + (f" ({items[i % 8][1].upper()})! " if i % 3 else "")) for i in range(30)] + [(30, None), (31, ""), (32, LONG)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_hit", F.lit("clash"))
    out = dec.decontaminate(df, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block, keep=["doc_id"]).collect()
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in out}
    assert got == {i: brute_hits(t, items) for i, t in rows}
    assert dec.decontaminate(empty, spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert dec.decontaminate(df, spark.createDataFrame([], "item_id bigint, text string")).filter("contaminated").count() == 0


# Quality

def test_quality_held_out(spark, empty):
    r = random.Random(8)
    good = lambda: " ".join(r.choices(["the", "house", "stands", "near", "a", "river"], k=r.randint(5, 200)))
    bad = lambda: " | ".join(r.choices(["the", "house", "stands", "near"], k=r.randint(5, 200)))
    rows = [(i, (bad if i % 4 == 0 else good)()) for i in range(400)] + [(900, None), (901, ""), (902, LONG)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(0, 1, 0), (None, 1, 0), (5000, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(df, labels, sample=150)
    out = {x.doc_id: x for x in quality.score(df, model, keep=["doc_id"]).withColumn("h", quality.held_out()).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].h for i in held) and len(out) == 403
    assert np.mean([(out[i].score >= 0.3) == (i % 4 != 0) for i in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out.values())
    assert quality.score(empty, model).count() == 0
    assert quality.score(df, quality.fit(empty, labels), keep=["doc_id"]).filter("predicted = 1").count() == 403


def small_model(seed=1):
    r = np.random.default_rng(seed)
    return quality.Model(r.normal(size=(256, quality.SIZE)), r.normal(size=(quality.WIDTH, quality.SIZE, quality.FILTERS)), r.normal(size=quality.FILTERS), r.normal(size=2 * quality.FILTERS) / 9, -0.3)


def brute_score(m, text):
    """Every filter at every place of the text by loops, the largest of each chunk, then largest and mean over chunks."""
    n = max(1, -(-len(text) // quality.CHUNK))
    raw = text + bytes(n * quality.CHUNK + quality.WIDTH - 1 - len(text))
    pooled = []
    for c in range(n):
        best = [0.0] * quality.FILTERS
        for i in range(c * quality.CHUNK, (c + 1) * quality.CHUNK):
            total = m.bias.copy()
            for k in range(quality.WIDTH):
                total += m.embed[raw[i + k]] @ m.filters[k]
            best = [max(a, b) for a, b in zip(best, total)]
        pooled.append(best)
    z = [max(col) for col in zip(*pooled)] + [sum(col) / n for col in zip(*pooled)]
    return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(z, m.top)) + m.shift)))


def test_quality_by_brute_force(spark):
    m, r = small_model(), random.Random(5)
    texts = [None, "", "short", "é" * 300, "".join(chr(r.randrange(32, 400)) for _ in range(700)), "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for x in quality.score(df, m, keep=["doc_id"]).collect():
        want = brute_score(m, (texts[x.doc_id] or "").encode())
        assert abs(x.score - want) < 1e-4 and x.predicted == int(want >= 0.3)


def test_quality_gradients():
    m, r = small_model(4), random.Random(6)
    rows = [quality.chunks(bytes(r.randrange(97, 110) for _ in range(n))) for n in (5, 400, 900)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.scores([bytes(x[:, : quality.CHUNK].ravel()) for x in rows])
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())

    got = quality.gradients(m, rows, labels)
    for name, at in (("embed", (100, 3)), ("filters", (2, 1, 5)), ("bias", (7,)), ("top", (3,)), ("top", (20,))):
        p, old = getattr(m, name), getattr(m, name)[at]
        slopes = []
        p[at] = old + 1e-4
        up = loss()
        p[at] = old - 1e-4
        slopes.append((up - loss()) / 2e-4)
        p[at] = old
        assert abs(slopes[0] - got[name][at]) < 2e-2 * max(1, abs(got[name][at])), (name, slopes, got[name][at])


def test_quality_repeated_labels_and_rows(spark):
    rows = [(i, ("good words here " if i % 2 else "|| || ||") * 9) for i in range(80)]
    df = spark.createDataFrame(rows + rows[:9] + [(3, "another text of id 3")], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] * 2 + [(4, 1, 0)], "doc_id int, quality int, toxic int")
    one, two = (quality.fit(d, labels) for d in (df, df.repartition(5)))
    assert all(np.array_equal(getattr(one, n), getattr(two, n)) for n in vars(one))


def test_quality_sees_every_byte():
    m = quality.Model(np.eye(256, quality.SIZE), np.random.default_rng(1).normal(size=(quality.WIDTH, quality.SIZE, quality.FILTERS)), np.zeros(quality.FILTERS), np.ones(2 * quality.FILTERS), 0.0)
    m.embed[:] = 0
    m.embed[7] = 5
    plain = m.scores([b"a" * 3000])[0]
    assert all(m.scores([b"a" * k + b"\x07" + b"a" * (2999 - k)])[0] != plain for k in range(0, 3000, 37))


# Reputation

def test_rules_and_reputation(spark):
    urls = ["http://WWW.Example.com/en/x?q", "https://a.example.com/en/1", "https://b.com", "http://q.net/es/z#f", "http://q.net/de/z", None, "no scheme", "http://other.org/", "x://h?a/b", "http://q.net/es"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judge_urls(df).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[1][2:] == ("example.com/en/", "block")
    assert got[2] == ("b.com", "", None, got[2][3]) and got[3][1:] == ("/es/z", "net/es/", "block") and got[4][2] is None
    assert got[5][:3] == got[6][:3] == ("", "", None) and got[8][:2] == ("h", "") and got[9][:3] == ("q.net", "/es", None)
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    assert reputation.judge_urls(df.limit(0)).count() == 0
    long = "http://" + "sub." * 3000 + "net/fr/" + "x/" * 50000
    more = spark.createDataFrame([(1, long), (1, long), (2, "http://a.org/"), (2, "http://a.org/")], "page_id int, url string")
    rows = reputation.judge_urls(more).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in rows)[(1, "net/fr/", "block")] == 2 and len(rows) == 4


def brute_reputation(outcomes, z=reputation.Z):
    """Mean and bound of every host by plain loops over the levels."""
    def up(table, name):
        out = defaultdict(list)
        for key, (k, n) in table.items():
            out[name(key)].append((k, n))
        return out

    def strength(children, prior):
        known = [(k, n) for k, n in children if n]
        pages, noise = sum(n for _, n in known), prior * (1 - prior)
        room = pages - sum(n * n for _, n in known) / pages if pages else 0
        between = (sum(n * (k / n - prior) ** 2 for k, n in known) - (len(known) - 1) * noise) / room if room > 0 else 0
        return min(max(noise / between - 1 if between > 0 else reputation.MOST_STRENGTH, reputation.LEAST_STRENGTH), reputation.MOST_STRENGTH)

    total = lambda rows: (sum(k for k, _ in rows), sum(n for _, n in rows))
    suffix = lambda h: ".".join(h.split(".")[-2:]) if ".".join(h.split(".")[-2:]) in reputation.LONG_SUFFIXES and "." in h else h.split(".")[-1]
    domain = lambda h: h if len(h.split(".")) <= len(suffix(h).split(".")) + 1 else ".".join(h.split(".")[-len(suffix(h).split(".")) - 1 :])
    hosts = {h: (sum(g is True for g in gs), sum(g is not None for g in gs)) for h, gs in outcomes.items()}
    in_domain = up(hosts, domain)
    domains = {d: total(rows) for d, rows in in_domain.items()}
    in_suffix = up(domains, suffix)
    suffixes = {s: total(rows) for s, rows in in_suffix.items()}
    k, n = total(suffixes.values())
    prior = (k + 1) / (n + 2)
    weight = strength(suffixes.values(), prior)
    mean_s = {s: (k + weight * prior) / (n + weight) for s, (k, n) in suffixes.items()}
    weight_s = {s: strength(in_suffix[s], mean_s[s]) for s in suffixes}
    mean_d = {d: (k + weight_s[suffix(d)] * mean_s[suffix(d)]) / (n + weight_s[suffix(d)]) for d, (k, n) in domains.items()}
    weight_d = {d: strength(in_domain[d], mean_d[d]) for d in domains}
    out = {}
    for h, (k, n) in hosts.items():
        w, m = weight_d[domain(h)], mean_d[domain(h)]
        mean = (k + w * m) / (n + w)
        out[h] = (mean, mean - z * (mean * (1 - mean) / (n + w + 1)) ** 0.5)
    return out


def test_reputation_by_brute_force(spark):
    r, outcomes = random.Random(14), defaultdict(list)
    hosts = [f"{a}{d}.{s}" for s in ("com", "org", "co.uk", "uk") for d in ("a", "b", "c") for a in ("", "x.", "y.", "z.w.")] + ["", "com", "co.uk", "localhost"]
    for h in hosts:
        for _ in range(r.randint(1, 40)):
            outcomes[h].append(r.choice([True, False, None] if "a." in h else [True, True, True, None, False]))
    got = reputation.reputation(spark.createDataFrame([(h, g) for h, gs in outcomes.items() for g in gs], "host string, good boolean")).collect()
    want = brute_reputation(outcomes)
    assert len(got) == len(want) and all(abs(x.mean - want[x.host][0]) < 1e-9 and abs(x.bound - want[x.host][1]) < 1e-9 for x in got)


def test_reputation_shrinks(spark):
    rows = [("good.a.org", True)] * 50 + [("bad.a.org", False)] * 50 + [("new.a.org", None)] + [("one.b.org", False)] + [("two.b.org", True)] * 30
    got = {r.host: r for r in reputation.reputation(spark.createDataFrame(rows, "host string, good boolean")).collect()}
    assert got["good.a.org"].good and not got["bad.a.org"].good
    assert 0.2 < got["new.a.org"].mean < 0.8 and got["one.b.org"].mean > got["bad.a.org"].mean and got["new.a.org"].n == 0


# Sharding

def test_two_pass_shuffle(spark, docs, empty, tmp_path):
    out = sharding.two_pass_shuffle(docs.withColumn("Shard", F.lit("clash")), shards=3, bucket_bytes=4000)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t, *_ in corpus())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.two_pass_shuffle(docs.repartition(5), shards=3, bucket_bytes=4000).collect()
    key = lambda rs: Counter((r.doc_id, r.text, r.shard, r.slot) for r in rs)
    assert key(rows) == key(again)
    digest = sharding.shard_digest(out).collect()
    assert Counter((r.doc_id, r.size) for r in digest) == Counter((i, len((t or "").encode()) + 1) for i, t, *_ in corpus())
    assert {(r.doc_id, r.text_crc32) for r in digest} == {(i, zlib.crc32((t or "").encode())) for i, t, *_ in corpus()}
    assert sharding.two_pass_shuffle(empty).count() == 0
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(corpus())


def brute_order(rows, seed, buckets):
    """Records of (key, text) in the order of the shuffle: hash, bucket, sorted bucket, Fisher-Yates by a Mersenne Twister seeded with seed + bucket."""
    def mixed(key, text):
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        h = h if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little"), h)
        return h if text is None else xxhash.xxh64_intdigest(text.encode(), h)

    held = defaultdict(list)
    for row in rows:
        h = mixed(*row)
        held[(h - 2**64 if h >> 63 else h) % buckets].append(row)
    for b in sorted(held):
        r = np.random.MT19937()
        r._legacy_seeding([0, seed + b])
        records, order = sorted(held[b], key=lambda x: (x[0] is not None, x[0], x[1] is not None, (x[1] or "").encode())), []
        for i in range(len(records)):
            n = i + 1
            if n & -n == n:
                j = n * (int(r.random_raw()) >> 1) >> 31
            else:
                while True:
                    bits = int(r.random_raw()) >> 1
                    j = bits % n
                    if bits - j + n - 1 < 2**31:
                        break
            order.append(None)
            order[i] = order[j]
            order[j] = i
        yield from (records[k] for k in order)


@pytest.mark.parametrize("partitions", ["3", "9"])
def test_shuffle_places_by_brute_force(spark, docs, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # places do not depend on it
    got = sharding.two_pass_shuffle(docs.select("doc_id", "text"), shards=3, seed=11, least_buckets=8).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    want = list(brute_order([(i, t) for i, t, *_ in corpus()], 11, 8))
    assert {r.slot * 3 + r.shard: (r.doc_id, r.text) for r in got} == dict(enumerate(want)) and len(got) == len(want)


def test_shuffle_scatters_equal_rows(spark):
    rows = [(1, "same")] * 500 + [(2, None)] * 30 + [(i, f"text {i}") for i in range(3, 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    places = lambda d, **b: sorted((r.shard, r.slot, r.doc_id, r.text or "") for r in sharding.two_pass_shuffle(d, shards=4, least_buckets=16, **b).collect())
    got = places(df, most_copies=25)
    assert Counter((i, t) for _, _, i, t in got) == Counter((i, t or "") for i, t in rows) and got == places(df.repartition(7), most_copies=25)
    assert sorted(s * 4 + k for k, s, *_ in got) == list(range(len(rows)))
    at = sorted(s * 4 + k for k, s, i, _ in got if i == 1)
    assert max(b - a for a, b in zip(at, at[1:])) < 60 and places(df)[0] is not None


# Top-k

def test_hamming_topk(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(20)]
    codes = {i: base[i % 20] ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 6))) & (2**64 - 1) for i in range(300)}
    codes |= {i: 5 for i in range(300, 360)}
    rows = [(i, c - 2**64 if c >> 63 else c) for i, c in codes.items()] + [(7, codes[7] - 2**64 if codes[7] >> 63 else codes[7])]
    df = spark.createDataFrame(rows, "id bigint, code bigint")
    got = defaultdict(list)
    for x in topk.hamming_topk(df, df.filter("id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.distance, x.neighbour_id))
    want = {q: sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:5] for q in codes if q % 20 == 0}
    assert dict(got) == want
    wide = df.union(df).withColumn("note", F.monotonically_increasing_id())  # extra columns make repeated rows differ
    blocks = topk.hamming_topk(wide, wide.filter("id % 20 = 0"), 5, block_codes=20, block_queries=3)
    assert Counter(tuple(x) for x in blocks.collect()) == Counter((q, k + 1, i, d) for q, near in want.items() for k, (d, i) in enumerate(near))
    odd = df.union(spark.createDataFrame([(None, 5), (900, None)], "id bigint, code bigint"))
    assert topk.hamming_topk(odd, odd.filter("id is null or id % 300 = 0"), 5).count() == 5 * 2
    few = spark.createDataFrame([(0, 1), (20, 3), (1, 0)], "id bigint, code bigint")
    assert topk.hamming_topk(few, few.filter("id % 20 = 0")).count() == 4
    assert topk.hamming_topk(df.limit(0), df).count() == 0


def test_sign_codes(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 0.0, 2.0]), (2, None), (None, [1.0]), (3, [])], "vec_id bigint, embedding array<double>")
    assert {r.id: r.code for r in topk.sign_codes(df).collect()} == {1: 0b1001, 3: 0}


# SimHash

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_groups(spark, docs, empty):
    rows = corpus()
    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = Counter((rows[i][0], format(fp[i], "016x"), least[group[i]]) for i in range(len(rows)))
    got = simhash.near_duplicates(docs.withColumn("fingerprint", F.lit("clash")))
    assert Counter(tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("groups", [6, 8])
def test_links_connect_all_close_pairs(spark, groups):
    r = random.Random(10)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        b = r.getrandbits(64)
        fps |= {b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (2**64 - 1) for _ in range(15)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp bigint")
    label = {f: f for f in fps}  # tiny cells: hot ones are cut into blocks
    label |= {x.node % 2**64: x.label % 2**64 for x in simhash.components(simhash.links(df, groups, cell=4)).collect()}
    root = {f: {f} for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3 and root[a] is not root[b]:
                both = root[a] | root[b]
                for x in both:
                    root[x] = both
    for a, b in itertools.combinations(fps, 2):
        assert (label[a] == label[b]) == (b in root[a])


def test_popcounts_bound_hamming():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**64, 500, np.uint64), r.integers(0, 2**64, 500, np.uint64)
    assert (np.abs(simhash.popcounts(a) - simhash.popcounts(b)).sum(axis=1) <= np.bitwise_count(a ^ b)).all()


# Substrings

@pytest.mark.parametrize("window,phrase", [(35, 16), (6, 3), (5, 5)])
def test_repeats_removed(spark, docs, empty, window, phrase):
    rows = corpus()
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    want = Counter()
    for (i, *_), w in zip(rows, words):
        gone = {j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        want[(i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    got = substrings.remove_repeats(docs.withColumn("kept", F.lit("clash")), window, phrase, keep=["doc_id"])
    assert Counter(tuple(r) for r in got.collect()) == want
    assert substrings.remove_repeats(empty).count() == 0


def test_full_shards_are_cut_into_blocks(spark, docs):
    few = {"shard_pieces": 10**9, "block_pieces": 6000, "block_passages": 9000}  # one shard for all, in blocks
    rows = lambda **b: Counter(tuple(r) for r in substrings.remove_repeats(docs, 6, 3, keep=["doc_id"], **b).collect())
    assert rows() == rows(**few) == rows(shard_pieces=500)


def test_words_decide_not_hashes():
    """A passage nominated by a colliding hash is not removed: no other place holds its words."""
    row = lambda a, words, own, copies=1: {"a": a, "b": 0, "start": 0, "at": 1, "copies": copies, "words": words, "own": own, "stream": own is None}
    table = lambda *rows: pa.Table.from_pylist(list(rows))
    one, two = b"a b c d e f", b"a b c x e f"
    assert substrings.locate(table(row(1, one, 1), row(1, one, None), row(2, two, None)), 5, 3) == []
    assert sorted(substrings.locate(table(row(1, one, 1), row(1, one, None), row(2, b"z a b c d e", None)), 5, 3)) == [(1, 0, 0, 5), (2, 0, 1, 6)]
    assert substrings.locate(table(row(1, one, 1) | {"stream": True}, row(2, two, None)), 5, 3) == []
    assert set(substrings.locate(table(row(1, one, 2), row(1, one, None, 2)), 5, 3)) == {(1, 0, 1, 6)}


def test_streamed_pieces_are_not_held_as_words():
    import tracemalloc

    texts = [b" ".join(b"w%d" % (7 * k + i) for i in range(40)) for k in range(20000)]
    n = len(texts)
    numbers = lambda v, t: pa.array([v] * n, t)
    rows = pa.table({"a": pa.array(range(n), pa.int64()), "b": numbers(0, pa.int64()), "start": numbers(0, pa.int32()), "at": numbers(0, pa.int32()), "copies": numbers(1, pa.int64()), "words": pa.array(texts, pa.binary()), "own": pa.array([1] + [None] * (n - 1), pa.int64()), "stream": numbers(True, pa.bool_())})
    tracemalloc.start()
    assert substrings.locate(rows, 35, 16) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 << 20  # 800,000 words would take more than 30 MB


def test_rolling_and_least_places():
    r = np.random.default_rng(2)
    h = r.integers(0, 2**64, 60, np.uint64)
    for n in (1, 2, 3, 16, 35):
        direct = np.array([sum(int(h[i + j]) * pow(substrings._M, n - 1 - j, 2**64) for j in range(n)) % 2**64 for i in range(60 - n + 1)], np.uint64)
        assert (substrings.rolling(h, n) == direct).all()
    v = r.integers(0, 5, 40)
    assert substrings.least_places(v, 7).tolist() == [i + int(np.argmin(v[i : i + 7])) for i in range(34)]


# Personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_patterns_match_brute_force():
    r = random.Random(11)
    bits = ["a", "b@", "@", "1", "12", "300", ".", "-", " ", "+", "(", ")", "4111111111111111", "é", "x.y", "0001", "@a.b"]
    for _ in range(4000):
        t = "".join(r.choices(bits, k=r.randint(0, 18)))
        assert pii.matches(t)[0] == brute_spans(t), repr(t)


def test_crf_gradient():
    m = pii.Tagger(1)
    r = np.random.default_rng(3)
    x, y = r.integers(0, pii.CODES, (2, 6)), np.array([[0, 1, 2, 0, 3, 4], [0, 0, 5, 6, 6, 0]])

    def loss():
        e, _ = m.emissions(x)
        a = e[:, 0].astype(float)
        gold = a[np.arange(2), y[:, 0]]
        for t in range(1, 6):
            a = e[:, t] + pii._lse(a[:, :, None] + m.p["trans"], 1)
            gold = gold + e[np.arange(2), t, y[:, t]] + m.p["trans"][y[:, t - 1], y[:, t]]
        return float((pii._lse(a, 1) - gold).mean())

    grads = m.step(x, y)
    for name, at in (("out", (3, 4)), ("uf", (2, 5)), ("wb", (1, 7)), ("bias", (2,)), ("cb", (9,)), ("embed", (int(x[0, 2]), 1))):
        m.p[name] = m.p[name].astype(float)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-3
        up = loss()
        m.p[name][at] = old - 1e-3
        down = loss()
        m.p[name][at] = old
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3, name


def test_windows_cover_every_sign():
    r = random.Random(12)
    for _ in range(200):
        t = "".join(r.choices("abc 1@", weights=[30, 30, 30, 30, 1, 1], k=r.randint(0, 700)))
        starts = pii.windows(t)
        assert starts == sorted(set(starts)) and all(any(s <= i < s + pii.WINDOW for s in starts) for i, c in enumerate(t) if c in "1@")


def test_personal_data(spark, docs, empty):
    text = "Write to ann.b@mail.example.com or +1 (017) 555-7713, from 10.0.0.7, card 4111 1111 1111 1111."
    rows = [(1, text), (2, None), (3, ""), (4, "é" * 50 + text), (5, LONG)] + [(i, f"note {i} {text}") for i in range(6, 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("clash"))
    model = pii.fit(df, sample=10)
    got = {x.doc_id: x for x in pii.find_personal_data(df, model, keep=["doc_id"]).collect()}
    for i, t in rows:
        base = [f"{k}:{a}:{b}" for k, a, b in brute_spans(t or "")]
        assert got[i].base == ",".join(base) and set(base) <= set(got[i].spans.split(",") if got[i].spans else [])
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    clean = {x.doc_id: x.text for x in pii.redact(df.select("doc_id", "text"), model).collect()}
    assert "@" not in clean[1] and "<email>" in clean[1] and "<card>" in clean[1] and clean[2] is None and clean[3] == ""
    assert pii.find_personal_data(empty, model).count() == 0 and pii.redact(docs, model).count() == docs.count()


def test_written_variants_are_found(spark):
    rows = [(i, f"note {i}: write to ann.b{i}@mail.example.com or +1 (017) 555-77{i % 90 + 10}, from 10.0.0.{i % 250}, on page {i * 37}.") for i in range(60)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id bigint, text string"))
    r, cases = np.random.default_rng(77), []
    for _ in range(180):
        form, kind = pii.variants(r)
        head = "Please write to the office at "
        look = "(" if "(" in form else " @ " if " @ " in form else " dot " if " dot " in form else "00" if kind == "phone" else kind
        cases.append((look, f"{head}{form} and wait for an answer.", (kind, len(head), len(head) + len(form))))
    texts = [t + " nothing here " * 30 + t for _, t, _ in cases[:60]] + [t for _, t in rows[:20]] + ["no sign in here at all " * 30]
    every = lambda t: [*range(0, max(0, -(-(len(t) - pii.WINDOW) // pii.STRIDE)) * pii.STRIDE + 1, pii.STRIDE)]
    assert pii.decode_all(model, texts) == pii.decode_all(model, texts, every)  # windows without a sign add nothing
    found, total = Counter(), Counter(look for look, _, _ in cases)
    for (look, _, span), (base, spans) in zip(cases, pii.find(model, [t for _, t, _ in cases])):
        assert span not in base
        found[look] += span in spans
    assert len(total) == 6 and all(found[look] * 2 >= n for look, n in total.items()), (found, total)


class Marks:
    """A network that tags a to w after one x as an email, as far as a window shows it."""

    def decode(self, x):
        inner = (x >= ord("a")) & (x <= ord("w")) | (x == ord("@"))
        first = inner & ~np.pad(inner, ((0, 0), (1, 0)))[:, :-1]
        return np.where(first, 1, np.where(inner, 2, 0))


def test_spans_longer_than_windows_are_whole():
    for n in (20, 49, 60, 127, 128, 300, 700):
        for lead in (0, 3, 77, 81, 200):
            text = "X" * lead + "a" * n + "@" + "b" * n + "X" * 90 + "1"
            assert pii.decode_all(Marks(), [text]) == [[("email", lead, lead + 2 * n + 1)]], (n, lead)


def test_failed_matches_block_their_own_kind_only():
    model = type("M", (), {"decode": lambda self, x: np.array([[0] * 3 + [1 + 2 * self.kind] + [2 + 2 * self.kind] * 15 + [0] * (pii.WINDOW - 19)] * len(x))})()
    text = "at 0044 123 4567890 x"  # a run of digits that is no card
    model.kind = pii.KINDS.index("phone")
    assert pii.find(model, [text])[0][1] == [("phone", 3, 19)]
    assert pii.matches("at 4111 1111 1111 1112 x")[1] == [("card", 3, 22)]
