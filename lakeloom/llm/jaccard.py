"""Jaccard join of word n-grams, as a grouped prefix join.

A document is the set of its distinct word n-grams, held as 64-bit hashes. Sets are ordered by rarity; two sets of a Jaccard
similarity of at least t share one of the first ``n - ceil(t n) + 1`` elements, the *prefix*. Documents with equal
words in a segment are one *class*; classes with the same prefix and size are collapsed into one *group*. Classes whose
prefixes share an element and whose sizes allow the similarity meet in a *pool*: there pairs of groups are filtered by size
and shared prefix elements, the groups that remain are expanded and their members verified on their words.

Rarity: how many classes hold an element is counted over all documents by the exchange of ``segments``, for a fixed
share of the hash range that comes first in the order (an order is all that the prefix needs). A class whose prefix
no other class shares leaves the join there.

Hashes never decide: words have keyed hashes, each document's distinct hashes are checked to stand for distinct n-grams (else
all starts anew with another key, so set sizes are exact and no link can be missed), and what is linked is compared by words.

Pools: classes with the same smallest prefix element, the *home*, and about the same size form a *chunk* (split by class id
beyond half a block). The holders of an element and size level meet in the pool of their smallest chunk, the pivot, in blocks
of bounded size which each hold the whole pivot. So a cluster of near copies meets around one pivot and is joined in
pools that are linear in its size. Only where blocks of one pivot share an element and are still of different
components are the holders of that element compared block with block.

Scale: no pair of documents is ever sent anywhere, nor is a component gathered. Texts move once for each pool they are in.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import flat_gather, frugal, written
from .segments import NO_ID, Segments, fingerprints, gathered, read_segment, shared_keys, unpack_answer

_R = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Classes of a pool, about, and their n-grams.
BLOCK = 1024
BLOCK_ELEMENTS = 1 << 20
SPREAD = 64
#: Classes of a segment, as a power of two.
CLASS_BITS = 24
#: Words that a worker remembers with their hashes.
MAX_WORDS = 300_000
#: Labels of classes up to this many rows are broadcast (some 50 bytes each); beyond, the texts are shuffled to them.
BROADCAST_LABELS = 200_000


@dataclass(frozen=True)
class Rule:
    """Words per shingle and the similarity num/den."""

    words: int
    num: int
    den: int

    @property
    def share_bits(self) -> int:
        """The first elements of the order are those whose lowest bits of the hash are zero: a share of at least 2.5 prefixes."""
        share, bits = self.den - self.num, 0
        while (1 << (bits + 1)) * 5 * share <= 2 * self.den:
            bits += 1
        return bits

    def linked(self, common: np.ndarray, union: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * union

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """Word -> its number; ``hashes`` holds the keyed hash of each number."""

    def __init__(self, key: int, bits: int):
        super().__init__()
        self._key, self._mask = key.to_bytes(8, "little"), (1 << bits) - 1
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.hashes.append(int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self._key).digest(), "little") & self._mask)
        return number


_words: dict[tuple[int, int], Words] = {}


def _known_words(key: tuple[int, int]) -> Words:
    if key not in _words or len(_words[key]) > MAX_WORDS:
        _words.clear()
        _words[key] = Words(*key)
    return _words[key]


def shingles(texts: list[bytes], words: int, key: tuple[int, int] = (0, 64)) -> tuple[list[np.ndarray], list[bytes], bool]:
    """The sorted distinct n-gram hashes of each text, its words joined by blanks (A-Z in lower case), and whether any text
    has two n-grams of one hash. ``key`` is that of the words' hashes and their bits."""
    known = _known_words(key)
    parts = [t.lower().split() for t in texts]
    sizes = [len(p) for p in parts]
    number = np.fromiter((i for p in parts for i in map(known.__getitem__, p)), np.int64, sum(sizes))
    word = np.array(known.hashes, np.uint64)[number]
    gram = np.full(max(0, word.size - words + 1), words, np.uint64)
    for k in range(words):
        gram = _mix(gram * _R + word[k : k + gram.size])
    out, clash, a = [], False, 0
    for n in sizes:
        if n >= words:
            own = gram[a : a + n - words + 1]
            order = np.argsort(own)
            own = own[order]
            same = own[1:] == own[:-1]
            if same.any():
                x, y = order[1:][same] + a, order[:-1][same] + a
                clash = clash or any((number[x + k] != number[y + k]).any() for k in range(words))
                own = own[np.r_[True, ~same]]
            out.append(own)
        elif n:
            one = np.full(1, n, np.uint64)
            for k in range(a, a + n):
                one = _mix(one * _R + word[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        a += n
    return out, [b" ".join(p) for p in parts], clash


def _first(own: np.ndarray, bits: int) -> np.ndarray:
    """Which elements come first in the order."""
    return own & np.uint64((1 << bits) - 1) == 0


def _class_keys(rule: Rule, key: tuple[int, int]):
    """The elements, from the share that is counted, of a segment's classes and how many classes hold each."""

    def keys(path: str) -> tuple[np.ndarray, np.ndarray]:
        seen: set[bytes] = set()
        found = [np.zeros(0, np.uint64)]
        for _, texts in read_segment(path):
            for own, plain in zip(*shingles(texts, rule.words, key)[:2], strict=True):
                if own.size and plain not in seen:
                    seen.add(plain)
                    found.append(fingerprints(own[_first(own, rule.share_bits)]))
        return np.unique(np.concatenate(found), return_counts=True)

    return keys


def _level(sizes: np.ndarray, rule: Rule) -> np.ndarray:
    """Sizes that allow a link are in the same or in neighbouring levels."""
    return np.floor(np.log(sizes) / np.log(rule.den / rule.num) + 1e-9).astype(np.int64)


DOC, CLASS, OWN, CLASH = range(4)
_SCHEMA = "kind byte, doc_id long, n long, cid long, own long, level int, home long, tokens array<long>, prefix binary, words binary"
_NAMES = ["kind", "doc_id", "n", "cid", "own", "level", "home", "tokens", "prefix", "words"]
_KINDS = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def _rows(kind: int, count: int, **columns) -> pa.RecordBatch:
    data = [pa.array(np.full(count, kind, np.int8))]
    for name, type_ in zip(_NAMES[1:], _KINDS[1:], strict=True):
        if name not in columns:
            data.append(pa.nulls(count, type_))
        else:
            data.append(columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], type_))
    return pa.RecordBatch.from_arrays(data, names=_NAMES)


def _index_segment(seg: int, path: str, blocks: list[bytes], rule: Rule, key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """A segment's documents, and the classes that may have partners with their open prefix elements and their words."""
    bits = rule.share_bits
    classes: dict[bytes, int] = {}
    least: list[int] = []
    found: list[np.ndarray] = []
    doc_ids, doc_sizes, doc_classes = [], [], []
    for ids, texts in read_segment(path):
        sets, plains, clash = shingles(texts, rule.words, key)
        if clash:
            yield _rows(CLASH, 1)
        for doc, own, plain in zip(ids.tolist(), sets, plains, strict=True):
            c = -1
            if own.size:
                c = classes.setdefault(plain, len(classes))
                if c == len(least):
                    least.append(doc)
                    found.append(own)
                else:
                    least[c] = min(least[c], doc)
            doc_sizes.append(own.size)
            doc_classes.append(c)
        doc_ids.append(ids)
    if not doc_ids:
        return
    own_keys, own_counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(fingerprints(x[_first(x, bits)]) for x in found)]), return_counts=True)
    many = own_counts > 1
    elsewhere, totals = unpack_answer(blocks)
    # counts over all classes: what several segments hold is answered, the rest only this segment knows
    shared = np.union1d(elsewhere, own_keys[many])
    df = np.zeros(shared.size, np.int64)
    df[np.searchsorted(shared, own_keys[many])] = np.minimum(own_counts[many], 255)
    df[np.searchsorted(shared, elsewhere)] = totals
    candidates: list[int] = []
    plains = iter(classes)
    for lo in range(0, len(found), 4096):
        kept = []
        for c, own in enumerate(found[lo : lo + 4096], lo):
            plain = next(plains)
            first = _first(own, bits)
            ranked = own[first]
            prints = fingerprints(ranked)
            at = np.minimum(np.searchsorted(shared, prints), max(0, shared.size - 1))
            held = np.where(shared[at] == prints, df[at], 1) if shared.size else np.ones(ranked.size, np.int64)
            order = np.lexsort((ranked, held))
            p = rule.prefix(own.size)
            prefix, held = ranked[order][:p], held[order][:p]
            open_ = held > 1
            if prefix.size < p:
                rest = own[~first][: p - prefix.size]
                prefix, open_ = np.r_[prefix, rest], np.r_[open_, np.ones(rest.size, bool)]
            if open_.any():
                kept.append((c, own.size, prefix[open_].view(np.int64), plain))
        if kept:
            offsets = np.r_[0, np.cumsum([k[2].size for k in kept])]
            sizes = np.array([k[1] for k in kept], np.int64)
            yield _rows(
                CLASS, len(kept), cid=[seg << CLASS_BITS | k[0] for k in kept], n=sizes, level=_level(sizes, rule).astype(np.int32), home=[int(k[2].min()) for k in kept],
                tokens=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([k[2] for k in kept]))), prefix=[k[2].tobytes() for k in kept], words=[k[3] for k in kept],
            )
            candidates += [k[0] for k in kept]
    ids, c, least = np.concatenate(doc_ids), np.array(doc_classes, np.int64), np.array([*least, NO_ID], np.int64)
    for lo in range(0, ids.size, 1 << 16):
        part, own = ids[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)]
        yield _rows(
            DOC, part.size, doc_id=pa.array(part, mask=part == NO_ID), n=np.array(doc_sizes[lo : lo + (1 << 16)], np.int64),
            cid=pa.array(seg << CLASS_BITS | np.maximum(own, 0), mask=own < 0), own=pa.array(least[own], mask=own < 0),
        )
    if candidates:
        at = np.array(candidates, np.int64)
        yield _rows(OWN, at.size, cid=seg << CLASS_BITS | at, own=least[at])


def _exact_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The distinct n-grams of each text as numbers: equal numbers are equal n-grams, without hashing."""
    numbers: dict[bytes, int] = {}
    parts = [t.split() for t in texts]
    sizes = [len(p) for p in parts]
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for p in parts for w in p), np.int64, sum(sizes))
    gram, span = word[: max(0, word.size - words + 1)], len(numbers)
    for k in range(1, words):
        if span * len(numbers) >= 1 << 62:
            values, gram = np.unique(gram, return_inverse=True)
            span = values.size
        gram, span = gram * len(numbers) + word[k : k + gram.size], span * len(numbers)
    gram = np.unique(gram, return_inverse=True)[1]
    out, a, alone = [], 0, gram.size
    for n in sizes:
        if n >= words:
            out.append(np.unique(gram[a : a + n - words + 1]))
        else:
            out.append(np.full(1, alone))  # a sequence of fewer words equals no other text's that is not equal as a whole
            alone += 1
        a += n
    return out


def verify(ns: list[int], prefixes: list[np.ndarray], texts: list[bytes], rule: Rule) -> list[tuple[int, int]]:
    """Links among the classes of a pool, by places: enough of the linked pairs to connect all that are connected."""
    links: list[tuple[int, int]] = []
    same: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        if same.setdefault(t, i) != i:
            links.append((same[t], i))
    # groups of equal prefix and size, in order of size; pairs of groups filtered by size and shared prefix elements
    groups: dict[tuple, list[int]] = {}
    for i in same.values():
        groups.setdefault((ns[i], prefixes[i].tobytes()), []).append(i)
    order = sorted(groups)
    members = [groups[g] for g in order]
    size = np.array([g[0] for g in order], np.int64)
    tokens = [prefixes[m[0]] for m in members]
    counts = np.array([t.size for t in tokens])
    start = np.r_[0, np.cumsum(counts)]
    values, flat = np.unique(np.concatenate(tokens), return_inverse=True)
    upto = np.searchsorted(rule.num * size, rule.den * size, side="right")
    mark = np.zeros(values.size, bool)
    partners: list[np.ndarray] = []
    for g in range(len(members)):
        lo, hi = g + 1, int(upto[g])
        if hi <= lo:
            partners.append(np.zeros(0, np.int64))
            continue
        own = flat[start[g] : start[g + 1]]
        mark[own] = True
        met = np.logical_or.reduceat(mark[flat[start[lo] : start[hi]]], start[lo:hi] - start[lo])
        partners.append(lo + np.flatnonzero(met))
        mark[own] = False
    asked = {h for g, p in enumerate(partners) if p.size for h in (g, *p.tolist())} | {g for g, m in enumerate(members) if len(m) > 1}
    if not asked:
        return links
    # members, verified on their words; what is connected already is not compared again
    use = sorted(asked)
    who = [i for g in use for i in members[g]]
    sets = _exact_sets([texts[i] for i in who], rule.words)
    first = dict(zip(use, np.r_[0, np.cumsum([len(members[g]) for g in use])].tolist(), strict=False))
    n = np.array([x.size for x in sets], np.int64)
    start = np.cumsum(n) - n
    flat = np.concatenate(sets)
    mark = np.zeros(int(flat.max()) + 1, bool)
    label = np.arange(len(who))
    for g in use:
        others = np.concatenate([np.arange(first[h], first[h] + len(members[h])) for h in (g, *partners[g].tolist())])
        for i in range(first[g], first[g] + len(members[g])):
            js = others[others > i]
            js = js[label[js] != label[i]]
            if not js.size:
                continue
            mark[sets[i]] = True
            hits = mark[flat_gather(flat, start[js], n[js])]
            common = np.add.reduceat(hits.astype(np.int64), np.cumsum(n[js]) - n[js])
            mark[sets[i]] = False
            for j in js[rule.linked(common, n[i] + n[js] - common)].tolist():
                if label[i] != label[j]:
                    links.append((who[i], who[j]))
                    label[label == label[j]] = label[i]
    return links


def _verify_pools(rule: Rule):
    """Rows ``pool, cid, n, prefix, words``, sorted by pool: links between classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src: list[int] = []
        dst: list[int] = []

        def close(rows: list[tuple]) -> None:
            if len(rows) > 1:
                for i, j in verify([r[2] for r in rows], [np.frombuffer(r[3], np.int64) for r in rows], [r[4] for r in rows], rule):
                    src.append(rows[i][1])
                    dst.append(rows[j][1])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    close(held)
                    held = []
                held.append(row)
            if len(src) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
                src, dst = [], []
        close(held)
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _links(sets: DataFrame, asked: DataFrame, rule: Rule, partitions: int, name: str) -> DataFrame:
    """Links in the pools that ``asked`` (``pool, cid``) deals the classes to."""
    asked = written(asked.select("pool", "cid").distinct(), f"{name}-asked")
    if asked.count() <= BROADCAST_LABELS:
        asked = F.broadcast(asked)
    dealt = sets.select("cid", "n", "prefix", "words").join(asked, "cid").select("pool", "cid", "n", "prefix", "words")
    return written(dealt.repartition(partitions, "pool").sortWithinPartitions("pool", "cid").mapInArrow(frugal(_verify_pools(rule)), "src long, dst long"), name)


def _link_classes(sets: DataFrame, rule: Rule, partitions: int, block: int) -> DataFrame:
    """``src, dst``: links between classes (``cid, n, level, home, tokens, prefix, words``)."""
    chunk = ["level", "home", "salt"]
    amount = lambda c, e, part: F.greatest(F.lit(1), F.ceil(F.col(c) / (block / part)), F.ceil(F.col(e) / (BLOCK_ELEMENTS / part))).cast("long")
    salts = sets.groupBy("level", "home").agg(F.count("*").alias("c"), F.sum("n").alias("e")).select("level", "home", amount("c", "e", 2).alias("salts")).where("salts > 1")
    salted = sets.select("cid", "n", "level", "home", "tokens").join(salts, ["level", "home"], "left").withColumn("salt", F.expr("pmod(xxhash64(cid), coalesce(salts, 1))")).drop("salts")
    light = written(salted, "jaccard-light")

    # the holders of an element in a level, and those a level higher, meet in the pool of the smallest chunk of that level
    holders = light.select(F.explode("tokens").alias("token"), *chunk).distinct()
    pivots = holders.groupBy("token", "level").agg(F.min(F.struct("home", "salt")).alias("p"))
    asked_by = pivots.select("token", "level", F.col("level").alias("p_level"), "p").unionByName(pivots.select("token", (F.col("level") + 1).alias("level"), F.col("level").alias("p_level"), "p"))
    pivot = ["p_level", "p_home", "p_salt"]
    meet = written(holders.join(asked_by, ["token", "level"]).select("p_level", F.col("p.home").alias("p_home"), F.col("p.salt").alias("p_salt"), *chunk).distinct(), "jaccard-meet")
    sizes = light.groupBy(*chunk).agg(F.count("*").alias("c"), F.sum("n").alias("e"))
    pools = meet.join(sizes, chunk).groupBy(*pivot).agg(F.sum("c").alias("c"), F.sum("e").alias("e")).where("c > 1").select(*pivot, amount("c", "e", 1).alias("blocks"))
    is_pivot = F.expr("p_level = level and p_home = home and p_salt = salt")
    own_block = F.expr("pmod(xxhash64(level, home, salt), blocks)")
    dealt = written(meet.join(pools, pivot).withColumn("block", own_block), "jaccard-dealt")
    every = dealt.withColumn("block", F.explode(F.when(is_pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))))
    pool = F.concat_ws(":", *pivot, "block").alias("pool")
    found = _links(sets, light.select("cid", *chunk).join(every, chunk).select(pool, "cid"), rule, partitions, "jaccard-links")

    # blocks of one pivot that hold an element and are of several components yet: its holders, block with block
    wide = dealt.where("blocks > 1")
    if wide.isEmpty():
        return found
    labels = connected_components(found)
    now = light.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("component", "cid"))
    spread = F.expr(f"cast(pmod(xxhash64(cid), {SPREAD}) as int)").alias("s")  # an element that very many hold is dealt to SPREAD tasks
    each = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("s")
    of = written(
        now.select("cid", "label", *chunk, F.explode("tokens").alias("token"))
        .join(asked_by.select("token", "level", "p_level", F.col("p.home").alias("p_home"), F.col("p.salt").alias("p_salt")), ["token", "level"])
        .join(wide.select(*pivot, *chunk, "block"), [*pivot, *chunk])
        .where(~is_pivot)
        .select("cid", "label", "token", *pivot, "block", spread),
        "jaccard-of",
    )
    doubt = of.groupBy(*pivot, "token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("block").alias("b0"), F.max("block").alias("b1")).where("l0 <> l1 and b0 <> b1").select(*pivot, "token", each)
    rest = written(of.join(doubt, [*pivot, "token", "s"]).select(*pivot, "token", "s", "block", "cid"), "jaccard-rest")
    blocks = rest.select(*pivot, "token", F.col("block").alias("with")).distinct().select("*", each)
    pairs = rest.join(blocks, [*pivot, "token", "s"]).where("block <> with").select(F.concat_ws(":", *pivot, F.least("block", "with"), F.greatest("block", "with")).alias("pool"), "cid")
    return found.unionByName(_links(sets, pairs, rule, partitions, "jaccard-rest-links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the size of its set and the smallest id reachable by links.

    Two documents link when ``den * |intersection| >= num * |union|`` of their sets of distinct word n-grams. Words are runs
    without ASCII white space, A-Z in lower case; a text with fewer words than ``words`` has its whole sequence as one element.

    Defined cases: a null text or one without words has an empty set and no links; a null id counts as larger than any
    other and its row is labelled with the smallest id of its component, null if there is none; repeated rows link with each
    other; an empty input gives no rows; other columns are ignored. ``hash_bits`` shortens the first key's word hashes (for
    tests of collisions).
    """
    rule = Rule(words, num, den)
    segments = Segments(docs, id_col, text_col)
    if not segments.count:
        return segments.spark.createDataFrame([], "doc_id long, n_shingles long, component_id long")
    key = 0, hash_bits
    while True:

        def index(batches: Iterator[pa.RecordBatch], key: tuple[int, int] = key) -> Iterator[pa.RecordBatch]:
            for seg, path, blocks in gathered(batches):
                yield from _index_segment(seg, path, blocks, rule, key)

        known = shared_keys(segments, _class_keys(rule, key))
        indexed = written(segments.with_blocks(known).mapInArrow(frugal(index), _SCHEMA), "jaccard-index", compression="zstd")
        if indexed.where(f"kind = {CLASH}").isEmpty():
            break
        key = key[0] + 1, 64
    sets = indexed.where(f"kind = {CLASS}").select("cid", "n", "level", "home", "tokens", "prefix", "words")
    linked = connected_components(_link_classes(sets, rule, segments.buckets, block)).select(F.col("node").alias("cid"), "component")

    # from classes back to documents
    own = indexed.where(f"kind = {OWN}").select("cid", "own")
    smallest = linked.join(own, "cid").groupBy("component").agg(F.min("own").alias("least"))
    found = linked.join(smallest, "component").select("cid", "least")
    rows = indexed.where(f"kind = {DOC}").select("doc_id", "n", "cid", "own")
    least = F.coalesce("least", "own")
    label = F.when(F.col("n") == 0, F.col("doc_id")).when(least != int(NO_ID), least)
    return rows.join(found, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"))
