"""The queries' SQL, and the pipeline against plain Python."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from lexmill.llm import queries, quality, simhash
from lexmill.llm.common import Scratch

from ..oracle import DATA, connect, rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = connect().execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = scratch.save(stage(spark, docs, DATA), name)
        after = docs.collect()
        kept[name] = {r.doc_id for r in after}
        if name != "sharding":
            assert docs.columns == columns
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "quality":
            label = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            assert all((i in kept[name]) == bool(q) for i, q in label.items())
            assert quality.LABELLERS
        elif name == "near_dedup":
            sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in before}
            low = {i: i for i in sets}
            for _ in range(4):
                for i, x in sets.items():
                    for j, y in sets.items():
                        if i < j and (x == y or x and len(x & y) >= 0.8 * len(x | y)):
                            low[i] = low[j] = min(low[i], low[j])
            assert kept[name] == {i for i, m in low.items() if m == i}
        elif name == "decontamination":
            words = lambda t: re.findall(r"[^\W_]+", t.lower())
            shingles = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
            items = [shingles(words(t)) for t in bench]
            leaked = {r.doc_id for r in before if any(len(s & shingles(words(r.text))) >= 0.8 * len(s) for s in items)}
            assert kept[name] == {r.doc_id for r in before} - leaked
        elif name == "sharding":
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)


def test_stages_of_nothing(spark):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").where("false").withColumnRenamed("lang", "lexmill_copies")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_stages_take_nulls_and_repeats(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lexmill_quality double, _tk long"
    text = "Plain words of a text that is long enough to be kept by all of the stages here."
    docs = spark.createDataFrame([(1, text, "en", "a", 1, 0.1, 5), (1, text, "en", "a", 1, 0.1, 5), (None, None, None, None, None, None, None), (3, "", "en", None, 0, 0.2, 6), (None, text + " more of them", "en", None, 1, 0.3, 7)], schema)
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, DATA), name)
    assert docs.count() >= 1
