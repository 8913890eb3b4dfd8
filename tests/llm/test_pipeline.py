"""The pipeline on a small corpus, stage by stage against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from palimpsest.llm import packing, pii, quality  # noqa: E402
from tests.llm.test_operators import DOCS, brute_fingerprint, brute_hits, brute_spans  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    words = ["house", "river", "stands", "near", "Brücke", "the", "of", "a", "field", "tree", "road"]
    good = lambda n: " ".join(r.choices(words, k=n))
    item = "which river flows past the old house that stands near the long road of trees and fields today"
    rows = [(i, good(r.randint(30, 120))) for i in range(120)]
    rows += [(200 + i, " | ".join(r.choices(words, k=60))) for i in range(60)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, rows[1][1]), (303, f"{good(20)} {item} {good(20)}"), (304, f"{good(40)} mail ann.{r.randint(1, 9)}@mail.example.com now"), (305, None), (306, "")]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(120), *range(200, 260)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), item


def test_stages(spark, folder):
    at, item = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    steps = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "personal data", "packing"]

    one = steps["quality classifier"](spark, docs, at).cache()
    model = quality.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    rows = docs.collect()
    want = {x.doc_id for x, s in zip(rows, model.scores([(x.text or "").encode() for x in rows])) if s >= quality.THRESHOLD}
    assert {x.doc_id for x in one.collect()} == want and one.columns == COLUMNS
    assert len([i for i in want if 200 <= i < 260]) <= 3 and len([i for i in want if i < 120]) >= 117

    two = steps["near duplicates"](spark, one, at).cache()
    fp = {x.doc_id: brute_fingerprint(x.text) for x in one.collect()}
    group = {i: i for i in fp}
    for a in sorted(fp):
        for b in sorted(fp):
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3 and group[a] != group[b]:
                x, y = sorted((group[a], group[b]))
                group = {k: x if g == y else g for k, g in group.items()}
    assert Counter(x.doc_id for x in two.collect()) == Counter(set(group.values())) and two.columns == COLUMNS

    three = steps["benchmark decontamination"](spark, two, at).cache()
    assert {x.doc_id for x in three.collect()} == {x.doc_id for x in two.collect() if not brute_hits(x.text, [(0, item)])[4]}
    assert 303 not in {x.doc_id for x in three.collect()} and three.columns == COLUMNS

    four = steps["personal data"](spark, three, at).cache()
    before = {x.doc_id: x.text for x in three.collect()}
    for x in four.collect():
        spans = brute_spans(before[x.doc_id] or "")
        assert (x.text == before[x.doc_id]) or spans or pii.matches(before[x.doc_id])
        assert not brute_spans(x.text or "") and (x.text is None or x.n_chars == len(x.text))
    assert four.count() == three.count() and four.columns == COLUMNS

    five = steps["packing"](spark, four, at).toPandas()
    ids = packing.Ids(public_tokenizers.path(packing.TOKENIZER))
    for x in four.collect():
        mine = five[five.doc_id == x.doc_id].sort_values("start")
        assert b"".join(mine.ids) == ids.of(x.text or "") + np.array([0], "<u4").tobytes()


def test_run_and_empty(spark, folder, tmp_path):
    at, _ = folder
    assert pipeline.run(spark, at).count() > 100
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, "no id here", 1), (None, "no id here", 2), (7, "with id", 3), (7, "with id", 3)], "doc_id bigint, text string, predicted int")
    for _, stage in pipeline.STAGES[:4]:
        odd = stage(spark, odd, at).cache()
        assert odd.columns == ["doc_id", "text", "predicted"]
    assert sorted((x.doc_id or 0) for x in odd.collect()) == [0, 0, 7]


def test_one_document_of_each_group_stays(spark):
    x, y = "the river runs past the old house near the road", "a quite different text about trees and fields in spring"
    rows = [(1, x, 1), (5, x, 2), (5, y, 3), (5, y, 4), (5, y, 4), (6, y, 5), (None, x, 6), (7, None, 7), (8, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    stage = dict(pipeline.STAGES)["near duplicates"]
    for parts in (1, 5):
        out = stage(spark, docs.repartition(parts), "")
        assert out.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text or "", r.component_id) for r in out.collect()) == [(0, x, 6), (1, x, 1), (5, y, 3), (7, "", 7)]
