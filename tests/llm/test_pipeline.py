"""The stages of corpus_pipeline.py on rough rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

import corpus_pipeline as cp

from .conftest import ROWS
from .test_documents import SPLIT, brute_substrings, check_packing

EXTRA = ("score", "_score", "key", "_kept", "__n_removed", "kept", "n_words", "stays", "piece")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels as tables; the labels mark nothing as toxic, so only one class is there."""
    path = tmp_path_factory.mktemp("sf")
    names = "doc_id long, text string, n_chars int, " + ", ".join(f"{c} string" for c in EXTRA)
    docs = spark.createDataFrame([(d, t, len(t or ""), *EXTRA) for d, t in ROWS], names)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_on_rough_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.schema.names == schema.names and [f.dataType for f in got.schema] == [f.dataType for f in schema], name
        rows = got.collect()
        assert all(tuple(r[c] for c in EXTRA) == EXTRA for r in rows), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        if name == "toxicity":
            assert len(rows) == len(ROWS)
        elif name == "ngram_jaccard_join":
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, [1, 5, 6, 7, 8, 10, 11, 13, None, None, 15, 16, 17, 18]))
        else:
            want = sorted((str(d), n - gone) for d, n, gone, _ in brute_substrings(ROWS))
            assert sorted((str(r["doc_id"]), len(SPLIT.findall((r["text"] or "").encode()))) for r in rows) == want
            texts = {(d, t) for d, t in ROWS}
            assert all((r["doc_id"], r["text"]) in texts or r["n_chars"] == len(r["text"]) for r in rows)
    check_packing(cp.STAGES[-1][1](spark, docs, folder), ROWS)


def test_the_whole_pipeline_on_rough_rows(spark, folder):
    got = cp.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {1, 5, 6, 7, 8, 10, 11, 13, 15, 16, 17, 18, None} and all(0 < r["length"] <= 1024 for r in got)
