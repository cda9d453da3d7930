import hashlib
import itertools
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from lakeloom.llm import packing, separators, sequences, wordbpe
from lakeloom.llm.queries import END_ID, END_OF_TEXT, op3_bpe, op4_packing, op5_token_counts, op6_sequences, word_vocabulary


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_vocabulary())


def test_edge_rows_as_the_library(edge_docs, no_docs, library):
    out = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in wordbpe.encode_documents(edge_docs, word_vocabulary()).collect()]
    want = []
    for r in edge_docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert wordbpe.encode_documents(no_docs, word_vocabulary()).count() == 0


def test_query_digests(spark, sf_dir, small_docs, library):
    want = {}
    for r in small_docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in op3_bpe(spark, sf_dir).collect()} == want


def test_forgetting_and_runs_of_one_letter(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "MAX_KNOWN", 50)
    enc = wordbpe.WordEncoder(wordbpe.WordVocabulary(word_vocabulary()))
    texts = ["a" * k + " " + "ab" * k + " !" * k for k in range(60)] + ["", "ha" * 500]
    for lo in range(0, len(texts), 7):
        ids, counts = enc.encode(texts[lo : lo + 7])
        ends = np.cumsum(counts)
        for t, a, b in zip(texts[lo : lo + 7], ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_careful_merges_match_plain_bpe():
    """Merges whose result takes part in an earlier one, against piece-by-piece BPE."""
    vocab = wordbpe.WordVocabulary.__new__(wordbpe.WordVocabulary)
    merges = [(0, 0, 3), (3, 1, 4), (4, 0, 5), (1, 0, 6), (3, 6, 5), (0, 6, 7), (7, 3, 8), (2, 2, 9), (9, 2, 10), (5, 5, 11), (0, 1, 4)]
    keys = np.array([a << 32 | b for a, b, _ in merges])
    vocab._order = np.argsort(keys)
    vocab._keys = keys[vocab._order]
    vocab.merged = np.array([m for _, _, m in merges])
    vocab.inner = vocab.last = np.arange(256)
    vocab.tokens = [b""] * 256
    ranks = np.arange(len(merges))
    lowest = np.full(256, len(merges))
    for k in (0, 1):
        np.minimum.at(lowest, np.array([m[k] for m in merges]), ranks)
    vocab.careful = lowest[vocab.merged] < ranks
    vocab.doubled = np.array([a == b for a, b, _ in merges])
    table = {(a, b): (r, m) for r, (a, b, m) in enumerate(merges)}

    def plain(symbols):
        symbols = list(symbols)
        while True:
            found = [(table[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in table]
            if not found:
                return symbols
            _, i = min(found)
            symbols[i : i + 2] = [table[symbols[i], symbols[i + 1]][1]]

    words = [bytes(w) for n in range(1, 8) for w in itertools.product((0, 1, 2), repeat=n)]
    ids, counts = wordbpe.encode_pieces(vocab, words)
    ends = np.cumsum(counts)
    for w, a, b in zip(words, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == plain(w), w


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 40, 9))
        counts = rng.integers(1, 20, lengths.size)
        for k in (1, 2, 3, 5):
            padding = lambda ends: sum(int(c) * (min(e for e in ends if e >= x) - int(x)) for x, c in zip(lengths, counts))  # noqa: E731, B023
            found = packing.optimal_boundaries(lengths, counts, k)
            assert len(found) <= k and found[-1] == lengths[-1]
            rest = [int(x) for x in lengths[:-1]]
            best = min(padding([*c, int(lengths[-1])]) for n in range(min(k, lengths.size)) for c in itertools.combinations(rest, n))
            assert padding(found) == best


def check_packed(rows, budget):
    slots = {(r.bucket, r.batch, r.slot) for r in rows}
    assert len(slots) == len(rows)
    by_bucket = {}
    for r in rows:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        capacity = max(1, budget // max(1, r.bucket_tokens))
        assert 0 <= r.slot < capacity
        by_bucket.setdefault(r.bucket, []).append((r.batch * capacity + r.slot, r.n_tokens))
    for places in by_bucket.values():
        assert sorted(p for p, _ in places) == list(range(len(places)))
    return by_bucket


def test_packing(spark, small_docs, edge_docs, no_docs):
    from pyspark.sql import functions as F

    rows = packing.pack(small_docs, buckets=6, token_budget=20000).collect()
    sizes = {r.doc_id: len(r.text.encode()) + 1 for r in small_docs.collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == sizes
    by_bucket = check_packed(rows, 20000)
    assert len(by_bucket) <= 6
    lengths, counts = np.unique(list(sizes.values()), return_counts=True)
    assert {r.bucket_tokens for r in rows} <= set(packing.optimal_boundaries(lengths, counts, 6))
    assert len(check_packed(packing.pack(edge_docs, token_budget=100).collect(), 100)) >= 1
    assert packing.pack(edge_docs).count() == 16
    assert packing.pack(edge_docs, length=F.lit(None).cast("long")).count() == 16
    assert packing.pack(no_docs).count() == 0


def test_packing_counts_tokens(spark, sf_dir, small_docs, library):
    rows = op4_packing(spark, sf_dir).collect()
    check_packed(rows, packing.TOKEN_BUDGET)
    assert {r.doc_id: r.n_tokens for r in rows} == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in small_docs.collect()}
    lengths, counts = np.unique([r.n_tokens for r in rows], return_counts=True)
    assert {r.bucket_tokens for r in rows} <= set(packing.optimal_boundaries(lengths, counts, packing.BUCKETS))


def test_rows_without_an_id_are_spread(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "if(id % 2 = 0, 'same text', concat('text ', id)) as text").repartition(3)
    check_packed(packing.pack(docs, token_budget=64, vocabulary=word_vocabulary()).collect(), 64)
    files = sequences.write_sequences(docs, word_vocabulary(), END_ID, partitions=4)
    assert len(files) == 4 and max(n for *_, n in files) < 2500 and sum(n for *_, n in files) == 4000
    out = sorted((r.start, r.n_tokens) for r in sequences.read_documents(spark, files).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(out, out[1:], strict=False))


def test_every_code_point_as_the_library(library):
    encoders = [wordbpe.WordEncoder(wordbpe.WordVocabulary(word_vocabulary())), wordbpe.encoder(word_vocabulary(), library=True)]
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(5)
    texts = [f"a{c}b1 {c}{c}'s{c} x" for c in points] + ["".join(rng.choice(points[:600], 12)) for _ in range(3000)] + ["".join(rng.choice(points, 9)) for _ in range(3000)]
    texts += ["e\u0301 \u0301x \x1c\x85\u2028y ΟΔΟΣ Σ. İI <|endoftext|>\u0301 <|ENDOFTEXT|> a<|startoftext|>b"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for enc in encoders:
        for lo in range(0, len(texts), 5000):
            part = texts[lo : lo + 5000]
            ids, counts = enc.encode(part)
            assert enc.count(part).tolist() == counts.tolist()
            ends = np.cumsum(counts)
            wrong = [t for t, a, b, w in zip(part, ends - counts, ends, want[lo : lo + 5000], strict=True) if ids[a:b].tolist() != w]
            assert not wrong, wrong[:5]


def test_one_long_text_does_not_coarsen_the_buckets(spark):
    from pyspark.sql import functions as F

    sizes = [*(i * i % 3001 + 1 for i in range(600)), *range(40000, 40300, 7), 5_000_000, 20_000_003]
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, size long")
    rows = packing.pack(docs.withColumn("text", F.lit("")), length=F.col("size"), buckets=8, token_budget=20000).collect()
    check_packed(rows, 20000)
    assert {r.doc_id: r.n_tokens for r in rows} == dict(enumerate(sizes))
    lengths, counts = np.unique(sizes, return_counts=True)
    upto = np.r_[0, np.cumsum(counts)]
    best = lengths * upto[1:]  # plain dynamic programming over exact lengths
    for _ in range(7):
        best = np.array([min([best[j], *(best[i] + lengths[j] * (upto[j + 1] - upto[i + 1]) for i in range(j))]) for j in range(lengths.size)])
    optimum = int(best[-1]) - sum(sizes)
    assert optimum <= sum(r.padding for r in rows) <= optimum + sum(x for x in sizes if x >= packing.EXACT) / packing.PER_OCTAVE
    assert {r.bucket_tokens for r in rows} <= set(sizes)


def test_one_length_is_spread(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'same' as text")
    check_packed(packing.pack(docs, token_budget=64).collect(), 64)


def test_token_counts_against_plain_encoding(spark, sf_dir, small_docs, library):
    library.encode_special_tokens = True
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in small_docs.collect()}
    library.encode_special_tokens = False
    rows = op5_token_counts(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)
    assert all(r.ended for r in rows)


def test_small_blocks_and_files(spark, edge_docs, no_docs, library):
    want = sorted(((r.doc_id, len(wordbpe.encoder(word_vocabulary(), special=False).encode([r.text or ""])[0])) for r in edge_docs.select("doc_id", "text").collect()), key=repr)
    files, listing = separators.write_flat(edge_docs, word_vocabulary(), END_OF_TEXT, file_bytes=3000)
    assert files.count() > 3
    for block in (64, 1000, 1 << 20):
        counted = separators.count_tokens(spark, files, END_OF_TEXT, block_bytes=block)
        rows = listing.join(counted, ["path", "ordinal"], "full").select("doc_id", "n_tokens").collect()
        assert sorted((tuple(r) for r in rows), key=repr) == want
    files, _ = separators.write_flat(no_docs, word_vocabulary(), END_OF_TEXT)
    assert separators.count_tokens(spark, files, END_OF_TEXT).count() == 0


def test_unterminated_and_hand_made_file(spark, tmp_path):
    stream = [9, 9, 5, 5, 9, 1, 2, 3, 5, 7, 7]
    path = tmp_path / "t.u16"
    path.write_bytes(np.array(stream, "<u2").tobytes() + b"\x01")
    files = spark.createDataFrame([(f"file://{path}", 2 * len(stream) + 1), (f"file://{tmp_path}/none", 0)], "path string, n_bytes long")
    for block in (2, 4, 6, 100):
        rows = sorted((r.ordinal, r.start, r.n_tokens, r.ended) for r in separators.count_tokens(spark, files, 5, block_bytes=block).collect())
        assert rows == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 4, True), (3, 9, 2, False)]


def test_sequences_query(spark, sf_dir, small_docs, library):
    at, want = 0, []
    for r in sorted(small_docs.collect(), key=lambda r: r.doc_id):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [END_ID]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in op6_sequences(spark, sf_dir).collect()) == want


def test_sequences_edge_rows_and_random_access(spark, edge_docs, no_docs, library):
    files = sequences.write_sequences(edge_docs, word_vocabulary(), END_ID, length=16, batch=3, partitions=3)
    out = sorted((tuple(r) for r in sequences.read_documents(spark, files).collect()), key=lambda r: r[1])
    rows = edge_docs.select("doc_id", "text").collect()
    assert sorted((r[0] for r in out), key=repr) == sorted((r.doc_id for r in rows), key=repr)
    sizes = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sorted(r[2] for r in out) == sizes
    assert [r[1] for r in out] == list(np.cumsum([0, *[r[2] for r in out[:-1]]]))
    reader = sequences.open_sequences(files[0][1])
    batch = reader.get_batch(0)
    assert batch.column("ids").type.list_size == 16 and batch.num_rows <= 3
    batch.column("ids").flatten().to_numpy(zero_copy_only=True)
    assert sequences.write_sequences(no_docs, word_vocabulary(), END_ID) == []
    assert sequences.read_documents(spark, []).count() == 0
