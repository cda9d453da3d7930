import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lakeloom.llm import pii

from .test_jaccard import brute as components
from .test_pii import brute as base_spans


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_on_small_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    first = stage("language_id")(spark, docs, sf_dir)
    assert first.columns == docs.columns and first.count() == docs.count()
    assert rows(first.select("doc_id", "text", "source")) == rows(docs.select("doc_id", "text", "source"))

    second = stage("exact_dedup")(spark, docs, sf_dir)
    least = {}
    for r in docs.collect():
        least[r.text] = min(least.get(r.text, r.doc_id), r.doc_id)
    assert rows(second) == sorted((tuple(r) for r in docs.collect() if least[r.text] == r.doc_id), key=repr)

    texts = [(r.doc_id, r.text) for r in second.collect()]
    third = stage("near_dedup")(spark, second, sf_dir)
    assert {r.doc_id for r in third.collect()} == {i for i, _, c in components(texts, 5, 8, 10) if i == c}

    fourth = stage("personal_data")(spark, third, sf_dir)
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    before = {r.doc_id: r.text for r in third.collect()}
    for r in fourth.collect():
        assert r.n_chars == len(r.text)
        if not base_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id] or any(f"[{k.upper()}]" in r.text for k in pii.KINDS)
        else:
            for _, a, b in base_spans(before[r.doc_id]):
                assert before[r.doc_id][a:b] not in r.text
    last = stage("packing")(spark, fourth, sf_dir)
    assert last.count() == fourth.count()


def test_run_is_the_stages_in_order(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == out.select("doc_id").distinct().count() > 0


def test_edge_rows_and_empty_table(spark, edge_docs, no_docs):
    left = []
    for docs in (edge_docs.select(*corpus_pipeline.COLUMNS), no_docs.select(*corpus_pipeline.COLUMNS)):
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, "").cache()
        left.append(sorted(r.doc_id for r in docs.collect()))
    # ids 3, 4, 5, 10, 11 and one null have no letter; the other null is a copy of 1
    assert left == [[1, 6, 7, 9, 12], []]


def test_documents_without_letters_go(spark):
    data = [(1, "one two three"), (2, "12 34"), (3, None), (4, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert [r.doc_id for r in stage("language_id")(spark, docs, "").collect()] == [1]


def test_rows_are_told_apart_by_more_than_their_ids(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(3, near), (5, near + " more"), (5, "an unrelated text of the same id"), (7, near + " more"), (None, near + " less"), (None, "nothing like the others at all"), (None, None), (None, ""), (9, "an unrelated text of the same id")]
    rows += [(None, f"own text {i} of a row without id {i * 7} {i * 11} {i * 13}") for i in range(10000)]
    docs = spark.createDataFrame([(*r, "en", "s", i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    second = stage("exact_dedup")(spark, docs, "")
    assert second.columns == corpus_pipeline.COLUMNS
    few = [(r.doc_id, r.text) for r in second.where("text is null or text not like 'own text%'").collect()]
    assert second.count() == 10000 + len(few)
    assert len([x for x in few if not x[1]]) == 1
    assert {x for x in few if x[1]} == {(3, near), (5, near + " more"), (5, rows[2][1]), (None, near + " less"), (None, rows[5][1])}
    third = stage("near_dedup")(spark, docs, "")
    left = [(r.doc_id, r.text) for r in third.where("text is null or text not like 'own text%'").collect()]
    assert sorted(left, key=repr) == sorted([(3, near), (5, rows[2][1]), (None, rows[5][1]), (None, None), (None, "")], key=repr)
    assert third.count() == 10000 + len(left)


def test_scratch_of_a_stage_is_cleared(spark, sf_dir):
    import os

    from lakeloom.llm import common

    mark = common.scratch_mark()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = [p for p in common._scratch_paths[mark:] if os.path.exists(p.removeprefix("file://"))]
    assert len(left) == len(common._scratch_paths[mark:]) <= len(corpus_pipeline.STAGES) + 1
    common.clear_scratch(mark)
    assert not any(os.path.exists(p.removeprefix("file://")) for p in left)
