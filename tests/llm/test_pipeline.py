"""Registered queries against their SQL, and the pipeline's stages against brute force."""

import os
import re

import pytest
from compare import compare, connect

import __spark_entry__ as entry
import corpus_pipeline as C
from foretrace.llm import catalogue
from foretrace.llm.near_dup import near_duplicates

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], FOLDER) is None


def test_registration():
    queries = entry.queries()
    assert "pipeline" in queries
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries if re.match(r"op\d+_", n)) == list(range(1, 14))
    assert 4 <= len(C.STAGES) <= 5


def test_stages(spark, con):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = C.quality_rules(spark, docs, FOLDER)
    verdicts = {r.doc_id: r.kept for r in catalogue.QUERIES["op1_quality_rules"](spark, FOLDER).collect()}
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdicts.items() if k}
    single = C.near_duplicate_groups(spark, kept, FOLDER)
    groups = near_duplicates(kept).collect()
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {r.component_id for r in groups}
    clean = C.benchmark_decontamination(spark, single, FOLDER)
    marks = {r.doc_id for r in catalogue.QUERIES["op2_benchmark_decontamination"](spark, FOLDER).where("contaminated").collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - marks
    masked = C.personal_data(spark, clean, FOLDER)
    before = {r.doc_id: r.text for r in clean.collect()}
    rows = masked.collect()
    assert masked.columns == columns and len(rows) == len(before)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for r in rows:
        assert not email.search(r.text) and r.n_chars == len(r.text)
        assert ("<" in r.text) or r.text == before[r.doc_id]
    assert {r.doc_id for r in C.token_ids(spark, masked, FOLDER).collect()} == set(before)


def test_stages_with_edge_rows(spark, make_docs):
    long = " ".join(f"word{i} goes here" for i in range(40))
    docs = make_docs([None, "", long, long, long, long + " mail a@b.com", "x"], [1, None, 5, 5, 3, None, 2])
    docs = docs.withColumnsRenamed({"n": "n_chars", "key": "__stage_id"})
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        rows = out.collect()
        empty = stage(spark, docs.limit(0), FOLDER)
        assert empty.count() == 0, name
        if name == "near_duplicates":
            assert sorted((str(r.doc_id), r.text and r.text[:5]) for r in rows) == sorted([("1", None), ("3", "word0"), ("2", "x")])
        if name == "personal_data":
            assert any(r.text and r.text.endswith("mail <email>") for r in rows) and len(rows) == 7
