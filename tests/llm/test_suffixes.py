import hashlib
import random

from lakeloom.llm import segments, suffixes


def brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            key = float("inf") if i is None else i
            first[s] = min(first.get(s, key), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (float("inf") if i is None else i):
                gone[p : p + length] = b"\x01" * length
        spans, p = [], 0
        while p < len(b):
            q = p
            while q < len(b) and gone[q] == gone[p]:
                q += 1
            if gone[p]:
                spans.append((p, q))
            p = q
        out.append((i, len(b), tuple(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.lo, s.hi) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


def test_edge_rows(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert got(suffixes.remove_repeats(edge_docs)) == brute(rows, 50)
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_random_texts_with_shared_passages(spark, monkeypatch):
    rng = random.Random(4)
    shared = ["".join(rng.choice("abé ") for _ in range(rng.randrange(40, 200))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(shared)[rng.randrange(20) :] if rng.random() < 0.5 else "".join(rng.choice("abcdefé") for _ in range(rng.randrange(80))) for _ in range(rng.randrange(5))]
        texts.append("".join(parts))
    texts += ["z" * 700, "y" + "z" * 300, "zz" * 90 + "q"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for length in (30, 50):
        assert got(suffixes.remove_repeats(df, length=length)) == brute(rows, length)


def test_many_segments_and_slices(spark):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(100)) + passage + str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = segments.SEGMENT_BYTES
    made = segments.Segments(df, "doc_id", "text", segment_bytes=1000)
    assert made.count >= 3 and segments.SEGMENT_BYTES == old
    assert got(suffixes.remove_repeats(df)) == brute(rows, 50)


def test_window_keys_depend_on_the_window_alone():
    import numpy as np

    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    keys = suffixes.window_keys(data, 50)
    assert keys.size == data.size - 49
    for p in rng.integers(0, 3950, 50):
        assert suffixes.window_keys(data[p : p + 50], 50)[0] == keys[p]


def test_kept_bytes_hash(edge_docs):
    for r in suffixes.remove_repeats(edge_docs).collect():
        assert len(hashlib.sha256(r.kept).hexdigest()) == 64


def test_snippets_are_told_apart_by_bytes(monkeypatch):
    """A hash that is the same for all snippets changes nothing. (Both keys are in one array, so they do not matter here.)"""
    import numpy as np

    rng = random.Random(3)
    base = ["".join(rng.choice("abc") for _ in range(60)) for _ in range(4)]
    snippets = [(rng.choice(base) if rng.random() < 0.7 else rng.choice(base)[:55] + "xyzzy", rng.randrange(9), rng.randrange(2)) for _ in range(200)]
    data = np.frombuffer("".join(s for s, _, _ in snippets).encode(), np.uint8)
    size = np.full(len(snippets), 60)
    start, doc, key = np.arange(len(snippets)) * 60, np.array([d for _, d, _ in snippets]), np.array([k for *_, k in snippets], np.uint64)

    def covered():
        who, lo, hi = suffixes._shown(data, start, size, key, doc, suffixes._Groups(data, start, size, key, doc), 50, False)
        out = np.zeros((len(snippets), 60), bool)
        for w, a, b in zip(who, lo, hi, strict=True):
            out[w, a:b] = True
        return out

    want = np.zeros((len(snippets), 60), bool)
    for i, (s, d, _) in enumerate(snippets):
        for p in range(11):
            if any(s[p : p + 50] in t for t, e, _ in snippets if e < d):
                want[i, p : p + 50] = True
    assert (covered() == want).all()
    monkeypatch.setattr(suffixes, "_content", lambda data, at, n: np.zeros(at.size, np.uint64))
    assert (covered() == want).all()
