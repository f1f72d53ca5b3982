"""The registered queries and the pipeline on the smallest tables."""

import re

import corpus_pipeline
import pytest
from compare import connect, differences
from moltabula.llm import langid, pii
from moltabula.llm.queries import QUERIES
from moltabula.llm.sql import SQL
from test_llm_pairs import plain_components, plain_removal
from test_llm_text import check_packing
from test_llm_whole import plain_fit, plain_identify

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER).sql(SQL[name])) is None


def test_near_duplicates_and_repeats(spark):
    docs = documents(spark)
    assert sorted(map(tuple, QUERIES["op8_minhash"](spark, FOLDER).collect())) == sorted(plain_components(docs).elements())
    got = [tuple(r)[:5] for r in QUERIES["op9_repeated_strings"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(plain_removal(docs).elements())


def test_packing_query(spark):
    check_packing(QUERIES["op7_packing"](spark, FOLDER).collect(), documents(spark), 2048)


def test_language_query(spark):
    rows = QUERIES["op1_language_id"](spark, FOLDER).collect()
    assert len(rows) == len(documents(spark)) and {r.held_out for r in rows} == {True, False}


def test_pipeline(spark):
    """Each stage against a plain version of it on its own input, then the whole."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stage(spark, docs, FOLDER).cache()
        if name == "language_id":
            learned = plain_fit([(r.doc_id, r.text, r.lang) for r in docs.collect()])
            judged = [(i, plain_identify(t, *learned)) for i, t in before]
            want = sorted(i for i, (lang, _, _, known) in judged if lang != "und" and known >= langid.MIN_SCORE)
            assert sorted(r.doc_id for r in after.collect()) == want
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())
        elif name == "near_dedup":
            assert {r.doc_id for r in after.collect()} == {i for i, _, _, kept in plain_components(before) if kept}
        elif name == "personal_data":
            anchors = pii.automaton()
            assert {(r.doc_id, r.text) for r in after.collect()} == {(i, pii.masked_text(t, anchors)) for i, t in before}
        else:
            check_packing(after.collect(), before, 2048)
            break
        assert after.columns == columns
        docs = after
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
