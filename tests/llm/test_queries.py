"""Registered queries against their SQL, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tests.oracle_check import connect  # noqa: E402
from vocara.llm.ngram_jaccard import shingles  # noqa: E402
from vocara.llm.pii import base_spans  # noqa: E402
from vocara.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, name, folder):
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    cursor = connect(folder).execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(r) for r in frame.select(*columns).collect()) == theirs


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder).cache()
    assert clean.columns == columns and 0 < clean.count() <= len(rows)
    single = stages["ngram_jaccard_join"](spark, clean, folder).cache()
    kept = {r["doc_id"]: set(shingles(r["text"]).tolist()) for r in single.collect()}
    assert single.columns == columns and len(kept) == single.count()
    for x, a in enumerate(kept.values()):
        for b in list(kept.values())[:x]:
            assert not a or not b or len(a & b) < 0.8 * len(a | b)
    blank = stages["pii"](spark, single, folder).cache()
    assert blank.columns == columns and blank.count() == single.count()
    for r in blank.collect():
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    mixed = stages["mixing"](spark, blank, folder).cache()
    assert mixed.columns == columns and 0 < mixed.count() < blank.count()
    packed = stages["packing"](spark, mixed, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}
