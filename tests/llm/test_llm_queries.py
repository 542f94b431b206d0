"""The registered queries against their SQL, and the pipeline."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from foliospark.llm import queries
from foliospark.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE[name])
    columns = sorted(c[0] for c in result.description)
    at = [c[0] for c in result.description]
    want = sorted(repr([r[at.index(c)] for c in columns]) for r in result.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want


def test_eleven_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in names}


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pieces":
            assert out.columns == docs.columns
            seen[name] = {r.doc_id: r.text for r in out.collect()}
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert set(seen["lines"]) == set(seen["toxicity"]) < set(before)
    assert set(seen["near_dups"]) <= set(seen["lines"]) and set(seen["leaks"]) == set(seen["near_dups"])
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} == set(seen["leaks"]) and all(r.lossless for r in last)


def test_pipeline_of_odd_rows(spark):
    """Nulls, empty texts, repeated rows and an empty table go through every stage but the first, which needs labels."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", None, None, 13), (None, "x", "en", "s", 1)]
    for data, ids in ((rows, [1, 2, 3, None]), ([], [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "pieces":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
                docs = spark.createDataFrame(docs.collect(), schema)
        assert sorted((r.doc_id or 0) for r in docs.collect()) == sorted(i or 0 for i in ids)
        assert all(r.lossless for r in docs.collect())
