import random
import re

import numpy as np

from lakeloom.llm import jaccard
from lakeloom.llm.jaccard import Rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ngrams(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, num, den):
    sets = [ngrams(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n, edits, words=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of"] * 30
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocab) for _ in range(rng.randrange(5, words))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows[:n]


def test_edge_rows(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    for k, num, den in ((3, 90, 100), (5, 8, 10), (1, 5, 10)):
        assert got(jaccard.jaccard_components(edge_docs, words=k, num=num, den=den)) == brute(rows, k, num, den)
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_near_copies_against_brute_force(spark):
    rows = corpus(1, 300, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k, num, den in ((3, 90, 100), (5, 8, 10), (2, 6, 10)):
        assert got(jaccard.jaccard_components(df, words=k, num=num, den=den)) == brute(rows, k, num, den)


def test_blocks_against_blocks(spark):
    """A group of near copies larger than a block: chains across blocks are found."""
    rng = random.Random(3)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(70):
        base = list(base)
        base[rng.randrange(60)] = f"n{i}"
        rows.append((100 - i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (8, 1000):
        assert got(jaccard.jaccard_components(df, words=3, num=90, den=100, block=block)) == brute(rows, 3, 90, 100)


def test_sides_of_the_threshold():
    rule = Rule(3, 90, 100)
    assert rule.linked(np.array([9, 8]), np.array([10, 9])).tolist() == [True, False]
    assert rule.prefix(10) == 2 and rule.prefix(1) == 1
    assert rule.share_bits == 2 and Rule(5, 8, 10).share_bits == 1 and Rule(1, 5, 10).share_bits == 0


def test_hashing_ignores_place_and_batch():
    texts = [b"Alpha beta\tGAMMA delta", b"", b"one two", b" alpha  beta gamma\x0bdelta "]
    together, plain, clash = jaccard.shingles(texts, 3)
    alone = [jaccard.shingles([t], 3)[0][0] for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone, strict=True)) and not clash
    assert (together[0] == together[3]).all() and together[1].size == 0 and together[2].size == 1
    assert plain[0] == plain[3] == b"alpha beta gamma delta"


def test_colliding_hashes_change_nothing(spark):
    """With few bits texts have n-grams of one hash (all starts anew) or share hashes with others (words decide)."""
    rows = corpus(8, 120, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 3, 90, 100)
    for bits in (1, 3, 6):
        assert got(jaccard.jaccard_components(df, words=3, num=90, den=100, hash_bits=bits)) == want
    assert jaccard.shingles([b"a b c d e f g h"], 1, (0, 1))[2] and not jaccard.shingles([b"a b a b a b"], 1, (0, 64))[2]


def test_words_that_collide_in_polynomial_hashes(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} x y"), (2, f"{other} x y"), (3, f"{word} x y"), (4, f"{word}{other} x"), (5, f"{other}{word} x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.jaccard_components(df, words=3, num=90, den=100)) == brute(rows, 3, 90, 100) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4), (5, 1, 5)]


def test_elements_shared_by_unlinked_texts(spark):
    """A passage in all texts, short ones of near sizes among them: more pools than one and several components in each."""
    rng = random.Random(12)
    rows = []
    for i in range(120):
        own = [f"u{i}x{j}" for j in range(rng.randrange(1, 8))]
        rows.append((i, " ".join(["same", "few", "words", "here", "now", "again"] + own)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(["same", "few", "words", "here", "now", "again"] + own + ["x"] * (i % 2))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (4, 16, 1000):
        assert got(jaccard.jaccard_components(df, words=2, num=6, den=10, block=block)) == brute(rows, 2, 6, 10)
