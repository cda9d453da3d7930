import math
import re

from pyspark.sql import functions as F

from lakeloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def base(df):
    rows = quality.base_rules(df.select("doc_id", "text")).collect()
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=repr)


def test_base_rules(edge_docs, no_docs, small_docs):
    for df in (edge_docs, small_docs):
        assert base(df) == sorted(((r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect()), key=repr)
    assert quality.quality(no_docs, {}).count() == 0


def test_repeats_overlap_and_lines(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n \n\nx", "a b c d e f a b c d e g b c d e f", "1 2 3 4", "|#| $ & <>", " ".join("ab" * 40), "\r\n\x0b w \x0c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert base(df) == sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=repr)


def distance(p, q):
    out = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(out, 0))


def test_divergence_against_plain_python(small_docs, edge_docs):
    references = quality.learn_references(small_docs)
    assert set(references) >= {"en"}
    for df in (small_docs, edge_docs):
        rows = {}
        for r in quality.quality(df, references, keep=[F.col("text").alias("own_text"), F.col("lang").alias("own_lang")]).collect():
            rows.setdefault((r.doc_id, r.own_text), r)
        for r in rows.values():
            text = r.own_text or ""
            letters = WORD.findall(text)
            near = [references[r.own_lang]] if r.own_lang in references else []
            if len(text) < quality.MIN_CHARS or not near:
                assert r.char_distance is None
            elif text.isascii():
                white, punctuation = " \t\n\x0b\x0c\r", quality.PUNCTUATION
                n = [sum(c.islower() for c in text), sum(c.isupper() for c in text), sum(c.isdigit() for c in text), *(sum(c in s for c in text) for s in (white, punctuation, quality.SYMBOLS))]
                shares = [x / len(text) for x in (*n, len(text) - sum(n))]
                assert math.isclose(r.char_distance, min(distance(shares, ref.chars) for ref in near), abs_tol=1e-6)
            if len(letters) >= quality.MIN_WORDS and text.isascii() and near:
                def by_words(ref):
                    p = [letters.count(w) / len(letters) for w in ref.words]
                    return distance([*p, max(0, 1 - sum(p))], [*ref.shares, max(0, 1 - sum(ref.shares))])
                assert math.isclose(r.word_distance, min(map(by_words, near)), abs_tol=1e-6)
            elif len(letters) < quality.MIN_WORDS or not near:
                assert r.word_distance is None
            far = (r.char_distance or 0) > quality.MAX_CHAR_DISTANCE or (r.word_distance or 0) > quality.MAX_WORD_DISTANCE
            assert r.kept == (not r.base_failed and not far)


def test_without_references(edge_docs, no_docs):
    assert quality.learn_references(no_docs) == {}
    for r in quality.quality(edge_docs, {}).collect():
        assert r.kept == (not r.base_failed) and r.char_distance is None


def test_labelled_quality(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(docs, quality.learn_references(docs)).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in rows}
    assert share[1] > 0.99 and share[0] < 0.35


def test_texts_without_the_common_words_are_dropped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    references = quality.learn_references(docs)
    good = docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id")
    odd = spark.range(40).selectExpr("id as doc_id", "array_join(transform(sequence(1, 120), i -> translate(substr(md5(concat(id, ' ', i)), 1, 4 + cast(i % 6 as int)), '0123456789', 'ghiklmnoqr')), ' ') as text", "'en' as lang")
    german = good.where("lang = 'de'").selectExpr("doc_id", "text", "'en' as lang")
    share = lambda df: df.where("n_words >= 60 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert share(quality.quality(odd, references)) == 0
    assert share(quality.quality(german, references)) < 0.1
    assert share(quality.quality(good, references)) > 0.99
    for reference in references.values():
        assert all(re.search(r"[^\W\d_]", w) for w in reference.words)
        none = distance([0] * len(reference.words) + [1], [*reference.shares, 1 - sum(reference.shares)])
        assert none > quality.MAX_WORD_DISTANCE


def test_references_count_all_labelled_rows(spark, small_docs):
    """Against plain counts; rare languages have a reference like others, and rows of other languages are left to the base rules."""
    rows = [(r.doc_id, r.text, r.lang) for r in small_docs.collect()]
    rows += [(9000 + i, f"wort{i % 7} und noch ein satz der seltenen sprache mit vielen worten {i} heute", f"x{i % 3}") for i in range(400)] + [(9999, "kurz", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    references = quality.learn_references(df)
    assert {"x0", "x1", "x2"} < set(references) and "y" not in references
    for lang, ref in references.items():
        words = [w for _, t, k in rows if k == lang and t for w in WORD.findall(t)]
        counts = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        want, total = [], 0.0
        for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if re.search(r"[^\W\d_]", w) and n >= quality.LEAST_SHARE * len(words) and (len(want) < quality.COMMON_WORDS or total < quality.COMMON_SHARE):
                want.append(w)
                total += n / len(words)
        assert ref.words == want and math.isclose(sum(ref.shares), total)
    odd = spark.createDataFrame([(1, "中文字 " * 100, "zz"), (2, "qx zy " * 3 + " ".join(f"k{i}" for i in range(90)), None)], "doc_id long, text string, lang string")
    for r in quality.quality(odd, references).collect():
        assert r.char_distance is None and r.word_distance is None and r.kept == (not r.base_failed)


def test_labelled_quality_by_kind(spark):
    """What the method adds to the base rules on texts marked as bad."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(docs, quality.learn_references(docs)).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"), F.avg((~F.col("base_failed")).cast("int")).alias("base")).collect()
    share = {r.quality: (r.share, r.base) for r in rows}
    assert share[1][0] > 0.95 and share[0][0] < share[0][1]
