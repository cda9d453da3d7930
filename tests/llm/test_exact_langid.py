import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from lakeloom.llm import exact, langid
from lakeloom.llm.queries import op1_language_id


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = (max if keep == "max" else min)(known) if known else None
        kept = 0
        for i in ids:
            stays = i == top and not kept
            kept += stays
            out.append((i, top, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edge_rows_both_ways(edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    for keep in ("max", "min"):
        assert got(exact.exact_dedup(edge_docs, keep=keep, memtable_rows=3)) == brute(rows, keep)


def test_colliding_digests_are_told_apart_by_bytes(small_docs):
    docs = small_docs.limit(120).cache()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(exact.exact_dedup(docs.repartition(4), digest_bytes=1, memtable_rows=10)) == brute(rows, "max")


def test_normalized_texts_and_empty_table(spark, no_docs):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    out = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_dedup(docs, normalize=F.lower).collect()}
    assert out == {1: (2, False), 2: (2, True), 3: (3, True)}
    assert exact.exact_dedup(no_docs).count() == 0


def test_language_held_out_accuracy(spark, sf_dir):
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    out = op1_language_id(spark, sf_dir).join(truth, "doc_id").where("held_out and n > 60").collect()
    assert len(out) > 20
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edge_rows(edge_docs, no_docs, small_docs):
    prototypes = langid.train(small_docs)
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(edge_docs, prototypes).collect()]
    assert len(out) == 16
    for i, lang, score in out:
        if i in (3, 4, 5, 10, 11):
            assert (lang, score) == ("und", 0.0)
    assert langid.train(no_docs) == {}
    assert langid.identify(no_docs, prototypes).count() == 0
    assert {r.lang_pred for r in langid.identify(edge_docs, {}).collect()} == {"und"}


def test_prediction_does_not_depend_on_the_batch(small_docs):
    prototypes = langid.train(small_docs)
    one = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in langid.identify(small_docs.coalesce(1), prototypes).collect()}
    many = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in langid.identify(small_docs.repartition(7), prototypes).collect()}
    assert one == many


def test_many_rows_of_one_id_and_text(spark):
    docs = spark.range(12000).selectExpr("if(id % 3 = 0, null, 7L) as doc_id", "if(id % 3 = 1, concat('t', id % 50), 'same') as text").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(exact.exact_dedup(docs, memtable_rows=64)) == brute(rows, "max")
    assert got(exact.exact_dedup(docs, memtable_rows=500, digest_bytes=1)) == brute(rows, "max")


def plain_profile(text):
    """Bundle of bound trigrams, letter by letter."""
    import numpy as np

    letters = [ord(c.lower()[0]) if c.isalpha() else 0 for c in "\n" + text + "\n"]
    folded = [c for i, c in enumerate(letters) if c or not i or letters[i - 1]]
    blank = langid.letter_vector(0, langid.DIM)
    total = np.zeros(langid.DIM)
    for a, b, c in zip(folded, folded[1:], folded[2:], strict=False):
        if b:
            bound = [np.roll(langid.letter_vector(x, langid.DIM) if x else blank, k).astype(float) for x, k in ((a, 2), (b, 1), (c, 0))]
            total += bound[0] * bound[1] * bound[2]
    return total


def test_against_plain_python(spark):
    import numpy as np

    texts = [("el", "καλημέρα κόσμε πώς είσαι σήμερα"), ("ru", "доброе утро как у вас дела"), ("zh", "今天天气很好 我们去公园"), ("en", "good morning how are you today"), ("el", "ευχαριστώ πολύ φίλε μου"), ("ru", "большое спасибо мой друг"), ("zh", "谢谢你 我的朋友"), ("en", "thank you very much my friend")]
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    prototypes = langid.train(docs)
    want = {k: sum(plain_profile(t) for q, t in texts if q == k) for k, _ in texts}
    assert {k: np.array(v).tolist() for k, v in prototypes.items()} == {k: v.tolist() for k, v in want.items()}
    asked = spark.createDataFrame([(1, "σήμερα φίλε"), (2, "мой друг дела"), (3, "我们的朋友"), (4, "good friend"), (None, "how much"), (6, "12")], "doc_id long, text string")
    for r in langid.identify(asked, prototypes, keep=[F.col("text").alias("own")]).collect():
        v = plain_profile(r.own)
        cosines = {k: float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)) if v.any() else 0.0 for k, w in want.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r.lang_pred == (best if v.any() else "und") and abs(r.score - max(0.0, cosines[best])) < 1e-4
    assert [r.lang_pred for r in langid.identify(asked, prototypes).orderBy("doc_id").collect()] == ["en", "el", "ru", "zh", "en", "und"]


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "good morning to you all", "en"), (3, "guten Morgen euch allen", "de"), (None, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op1_language_id(spark, str(tmp_path)).collect()
    assert all(r.held_out is False for r in out if r.doc_id is None) and {r.lang_pred for r in out if r.doc_id is None} == {"en", "und"}
