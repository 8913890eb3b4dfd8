"""The registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["norm_alignment", "tok_numbers", "detokenise", "parse_units", "compared_clause_summary", "v3_clause_summary", "v3_single_edit_tokens", "v2_roundtrip_revised", "mutate_amount", "candidate_paragraphs"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    found = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["detokenise", "paragraph_hash", "trim_stop_edges", "search_fragments"])
def test_lines_that_begin_with_digits(spark, tmp_path, name):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, "0997 tides, and 0\n1 moors\n  \n 3 ports of 3\n4"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall())


def test_stored_opcodes_hold_no_words_and_phrases_go(spark, tmp_path):
    from palimpsest.plans import queries as Q
    from palimpsest.session import shared_dir

    base = [f"word{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join([*base[:30], "other", *base[31:]])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith(("phrases-", "held-"))}
    before = held()
    got = {r.pair_id: (r.original_tokens, r.revised_tokens) for r in Q.v2_op_lengths(spark, str(tmp_path)).collect()}
    assert got == {"0-1": (60, 60), "0-2": (60, 60)} and held() == before
    table = Q._ops_of(spark, str(tmp_path), "ops", Q.doc_pairs(spark, str(tmp_path)))
    assert table.columns == ["pair_id", "original_text", "revised_text", "ops"] and table.filter("revised_text is null").count() == 1
