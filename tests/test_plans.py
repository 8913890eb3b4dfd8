"""The three pipelines end to end on small pairs, readers, and the stream."""

import json

from pyspark.sql import functions as F

from palimpsest.plans import compare as C
from palimpsest.plans import service as SV
from palimpsest.sources import fixtures as FX
from palimpsest.sources import readers as RD
from palimpsest.streaming import ingest

PAIRS = "pair_id string, original_doc_id int, revised_doc_id int"


def test_v3(spark):
    pages = spark.createDataFrame([(1, 1, "1. TIDES\n1.1 Sail within 30 hours.\n1.2 Old lantern rules."), (2, 1, "1. TIDES\n1.1 Sail within 45 hours.\n1.3 Wholly different beacons shine.")], "doc_id int, page_number int, text string")
    out = C.compare_v3(spark.createDataFrame([("p", 1, 2)], PAIRS), pages)
    s = out["summary"].first()
    assert (s.total_clauses, s.modified_clauses, s.added_clauses, s.deleted_clauses) == (3, 1, 1, 1)
    chunks = out["clauses"].filter("status = 'modified'").first().chunks
    assert [(c["type"], c["text"]) for c in chunks if c["type"] != "equal"] == [("delete", "30"), ("insert", "45")]


def test_v1_gate_fallback(spark):
    text = {1: ["1. TIDES", "1.1 The pilot boards the ship within 30 hours."], 2: ["1. TIDES", "1.1 The pilot boards the ship within 45 hours."], 3: ["Loose line one", "Loose line two"], 4: ["Loose line one", "Loose line two", "Loose line three"], 5: ["9. ZOO", "9.9 Quick brown foxes jump."]}
    units = spark.createDataFrame([(d, i + 1, t) for d, ls in text.items() for i, t in enumerate(ls)], "doc_id int, unit_seq int, text string")
    out = C.compare_v1(spark.createDataFrame([("a", 1, 2), ("b", 3, 4), ("c", 1, 5)], PAIRS), units)
    result = {r.pair_id: r for r in out["result"].collect()}
    assert result["a"].status == "success" and result["c"].status == "rejected" and result["c"].reason == "LOW_DOCUMENT_SIMILARITY" and "less than 50% similar" in result["c"].message
    assert result["b"].warning == "LINE_LEVEL_FALLBACK_COMPARISON"
    assert [r.change_type for r in out["compared"].filter("pair_id = 'a'").collect()] == ["modified"]
    assert [r.change_type for r in out["fallback"].filter("pair_id = 'b'").collect()] == ["added"]
    assert out["annotations"].filter("pair_id = 'a'").first().annotation_id == "ANN-1"


def test_v2(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(700))  # two pages, so that headers repeat
    docs = spark.createDataFrame([(1, base), (2, base.replace("word60 ", "other "))], "doc_id int, text string")
    out = C.compare_v2(spark.createDataFrame([("p", 1, 2)], PAIRS), FX.layout(docs))
    c = out["changes"].collect()
    assert [(x.original_text, x.revised_text, x.markdown) for x in c] == [("word60", "other", "word59 ~~word60~~ other word61")]
    assert c[0].revised_location.page_index == 0 and out["rects"].count() == 1
    assert out["report"].first().modified_count == 1 and out["report"].first().original_quality.page_count == 2
    assert c[0].content == "CHG-0001 | REPLACE | Page 1\nContext: word59 [DELETED: word60] other word61"
    assert C.write_debug(out, spark) is None
    at = C.write_debug(out, spark, path=str(tmp_path / "debug"))
    debug = json.loads(spark.read.json(at).first().debug)
    assert (debug["total_original_tokens"], debug["total_changes"], debug["warnings"]) == (700, 1, [])
    assert debug["changes"][0]["type"] == "REPLACE" and debug["changes"][0]["highlight_rect_count"] == 1 and debug["changes"][0]["page"] == 1 and debug["changes"][0]["anchor_bbox"]["x0"] > 0
    assert C.compare(spark, spark.createDataFrame([("p", 1, 2)], PAIRS), FX.layout(docs))["engine"].first()[:] == ("v2", None)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "d.bin").write_bytes(b"\xff\xfe\x00\x80")
    files = RD.binary_files(spark, str(tmp_path))
    assert {r.path[-5:]: r.format for r in files.collect()} == {"a.txt": "txt", "b.pdf": "pdf", ".docx": "docx", "d.bin": "unknown"}
    pages, errors = RD.extract(files, RD.default_readers())
    assert [r.text for r in pages.collect()] == ["hello"] and errors.count() == 3
    assert RD.corpus(spark, str(tmp_path)).collect()[0].name == "a"
    sub = tmp_path / "corpus"
    sub.mkdir()
    for name, text in (("x y.txt", " \n\t"), ("x_y.TXT", "shadowed by the blank one"), ("z.txt", "kept"), ("w.txt", "\u2003\n")):
        (sub / name).write_text(text)
    assert [(r.name, r.text) for r in RD.corpus(spark, str(sub)).collect()] == [("z", "kept")]
    import pytest

    with pytest.raises(RD.UnsupportedFormat):
        RD.default_readers().get("docx")
    with pytest.raises(ValueError):
        RD.default_readers().register("txt", RD.read_txt)


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "x.txt").write_text("1.1 one clause here")
    q = ingest.compare_stream(ingest.text_stream(spark, str(src)), lambda b: {"texts": b.select("text")}, str(tmp_path / "out"), str(tmp_path / "cp"), ["texts"])
    q.awaitTermination(60)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out/texts")).select("text").collect()] == ["1.1 one clause here"]


def test_engine_choice(spark):
    assert C.engine_version(spark) == ("v2", None)
    assert spark.range(1).select(C.http_status(F.lit("rejected"))).first()[0] == 422


def test_service(spark):
    pdf = b"%PDF-1.7"
    rows = [(1, pdf, pdf), (2, None, pdf), (3, b"", pdf), (4, pdf, b"text")]
    for names in ("original binary, revised binary", "original_file binary, revised_file binary"):
        good, bad = SV.accepted(spark.createDataFrame(rows, "pair_id int, " + names))
        assert [x.pair_id for x in good.collect()] == [1]
        assert {x.pair_id: (x.status, x.reason) for x in bad.collect()} == {2: (422, "MISSING_ORIGINAL"), 3: (422, "EMPTY_ORIGINAL"), 4: (422, "NOT_A_PDF_REVISED")}
    assert SV.health()["status"] == "ok" and SV.engine_info(spark) == {"compare_engine": "v2"}
    pages = spark.createDataFrame([(1, 1, "1.1 Ships sail."), (2, 1, "1.1 Ships wait.")], "doc_id int, page_number int, text string")
    pairs = spark.createDataFrame([("p", 1, 2)], PAIRS)
    assert set(SV.compare_clauses(pairs, pages)) == {"clauses", "summary"}
    lists = SV.compare_clauses(pairs, pages, debug=True)["debug_lists"].first()
    assert (lists.modified_clause_ids, lists.original_clause_count, lists.revised_clause_count) == (["clause-1-1"], 1, 1)
    spark.conf.set(C.ENGINE_KEY, "v1")
    units = spark.createDataFrame([(1, 1, "1.1 Ships sail."), (2, 1, "1.1 Ships wait.")], "doc_id int, unit_seq int, text string")
    out = SV.compare_documents(spark, pairs, units, units)
    spark.conf.unset(C.ENGINE_KEY)
    assert out["engine"].first().engine == "v1" and SV.answers(out["result"]).first().http_status == 200


def test_alignment_counts_without_the_score_matrix(spark, monkeypatch):
    from palimpsest.operators import align as A
    from palimpsest.operators import report as R

    rows = [(1, i, 2, f"c{i}", f"1.{i + 1}", None, "terms", f"clause {i} says {i}") for i in range(2)]
    schema = "pair_id int, clause_index int, count int, id string, number string, title string, section_title string, text string"
    o, r = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:1], schema)
    monkeypatch.delattr(A, "score_matrix")  # a pair of few clauses never needs the matrix
    monkeypatch.delattr(A, "greedy_matches")
    a = A.alignment(o, r, A.best_matches(o, r))
    assert R.alignment_counts(a, ["pair_id"]).count() == 1
    assert sorted((x.status, x.original_id, x.revised_id) for x in a.collect()) == [("matched", "c0", "c0"), ("original_only", "c1", None)]


def test_only_documents_of_pairs_are_laid_out(spark, tmp_path):
    """Token tables of pairs held every document of the corpus before."""
    from palimpsest.plans import queries as Q

    body = lambda seed: " ".join(f"{seed}word{i}" for i in range(40))
    rows = [(1, body("a")), (2, body("a") + " and more"), (3, body("b")), (4, body("c"))]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    assert {x.doc_id for x in Q.pair_tokens(spark, d).select("doc_id").distinct().collect()} == {1, 2}
    assert not {"id", "text", "paragraph_id"} & set(Q.pair_tokens(spark, d).columns)
    assert {x.doc_id for x in Q.pair_words(spark, d, "revised", kind="near").select("doc_id").distinct().collect()} == {2}
    assert [x.pair_id for x in Q.token_rects(spark, d).select("pair_id").distinct().collect()] == ["1-2"]


def test_profiles_have_one_row_a_document(spark):
    """54 rows a document before: words, headers and footers were grouped apart, as their union passed for dealt by document."""
    from collections import Counter

    from palimpsest.operators import layout as L
    from palimpsest.session import reachable
    from palimpsest.sources import fixtures as FX

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(20)], "doc_id int, text string")
    assert set(Counter(x.doc_id for x in L.profile(FX.layout(reachable(docs.sparkSession).createDataFrame(docs.collect(), docs.schema))).collect()).values()) == {1}
