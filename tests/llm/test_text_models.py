"""Held-out accuracy of the learned operators, and the pipeline stage by stage on the smallest tables."""

import pytest

import corpus_pipeline
from ocspark.llm import quality_classifier, toxicity
from ocspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    got = QUERIES[name](spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in got)
    return sum(r.predicted == r[label] for r in got) / len(got)


def test_quality(spark):
    assert held_out(spark, "op5_quality_classifier", "quality") >= 0.95


def test_toxicity(spark):
    assert held_out(spark, "op10_toxicity", "toxic") >= 0.95


@pytest.mark.parametrize("make", [lambda d, n: quality_classifier.score_texts(d, *quality_classifier.fit(d, n)), lambda d, n: toxicity.score_toxicity(d, toxicity.fit(d, n.withColumnRenamed("quality", "toxic")))])
def test_scores_of_odd_rows(spark, make):
    """Null, empty and very long texts, repeated rows, null ids, no rows, no labels, a column with the result's name."""
    rows = [(i, ("good plain words here " if i % 2 else "vile nasty junk words ") + str(i), "x") for i in range(60)]
    rows += [(None, None, "y"), (70, "", "y"), (71, "vile nasty " * 100_000, "y"), (72, "same", "y"), (72, "same", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = make(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and set(got[0].asDict()) == {"doc_id", "text", "score"}
    by = {}
    for r in got:
        by.setdefault(r.text or "", set()).add(r.score)
    assert all(len(x) == 1 for x in by.values())
    again = {(r.doc_id, r.text): r.score for r in make(docs.repartition(5), labels.repartition(2)).collect()}
    assert again == {(r.doc_id, r.text): r.score for r in got}  # whatever the layout
    assert make(docs.limit(0), labels).count() == 0
    assert len({r.score for r in make(docs, labels.limit(0)).collect()}) == 1


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No rows, and rows with nulls and repeats, go through all stages."""
    bench = spark.createDataFrame([(1, "one two three " * 9), (None, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    word = lambda i, end: "abcdefgh"[i % 8] + "lmnopqrs"[i // 8] + end
    prose = lambda end, n: ". ".join(" ".join(word(i, end) for i in range(k, k + 10)).capitalize() for k in range(0, n, 10)) + "."
    body = prose("ing", 60)
    rows = [(1, body, "en", None, 7), (1, body, "en", None, 7), (None, None, None, None, None), (2, "", "en", "s", 0), (None, body + " more", None, "s", 1), (3, "one two three " * 9 + body, "en", "s", 5), (4, prose("ous", 40) + " To a@b.org.", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for some in (rows, []):
        path = str(tmp_path / f"in{len(some)}")
        spark.createDataFrame(some, schema).write.parquet(f"{path}/documents.parquet")
        bench.write.parquet(f"{path}/benchmark.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        assert sorted({r.doc_id for r in got}) == ([1, 4] if some else [])


def test_pipeline(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").persist()
    names, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, small).persist()
        assert docs.columns == names, name
        rows = docs.collect()
        left = {r.doc_id for r in rows}
        assert len(rows) == len(left) and left <= ids and len(left) > 0.5 * len(ids), name
        ids = left
        if name == "quality rules":
            assert all(len(r.text.split()) >= 20 for r in rows)
        if name == "near duplicates":
            assert len({r.text for r in rows}) == len(rows)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == ids and max(r.offset + r.length for r in packed) <= 2048
