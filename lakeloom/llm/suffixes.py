"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

Every window of ``length`` bytes has a key: the smallest hash of the 24-byte strings in it. Equal windows have equal
keys, so only windows whose key occurs in two documents can repeat; the exchange of ``segments`` finds these keys.
Runs of windows with such a key go, as short snippets, to the key's bucket. There suffix arrays of the snippets are
built: the suffixes smaller than their successors are sorted directly, the others are induced from them by scans
over the buckets of first bytes. Adjacent suffixes with a common prefix of ``length`` bytes or more repeat each
other, and what starts in a document with a smaller id is removed. Every removal comes from such an array. Hashes only
choose what is compared: snippets with equal hashes are compared byte by byte, and of equal ones one, of the smallest
document, goes through the array for all: the smallest document found there beside its windows decides for each.

Scale: per input byte about 0.07 keys of six bytes are shuffled, and the snippets of what may repeat. A passage that a
third of all documents share is one snippet per segment, the one of the segment's smallest document; its other
documents repeat that one, which the segment sees on its own. Texts are cut into slices, so a very long one needs
no more memory than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import Segments, fingerprints, gathered, read_segment, shared_keys, unpack_answer

GRAM = 24
SLICE = 1 << 20
#: Windows of one snippet at most.
RUN = 64
#: Text of a segment, which a task holds with the snippets cut from it.
SEGMENT = 16 << 20
#: Bytes of snippets in one suffix array, roughly (a key's snippets stay together), and compared at once.
CUT = 2 << 20
#: Suffix arrays built one after another in a partition; bounds what is sorted at once.
PARTS = 16
#: The first bytes of a big-endian number.
_TOP = np.array([0, *((1 << 64) - (1 << 64 - 8 * k) for k in range(1, 8))], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number (zeros beyond the end)."""
    n = data.size
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n + 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (n + 15 - k) // 8 * 8].view(">u8")
        m = out[k::8].size
        out[k::8] = part[:m]
    return out[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """The key of each window: as many as ``data.size - length + 1``."""
    w = _words(data)
    n = data.size - GRAM + 1
    h = _mixed(w[:n] * _M1 + _mixed(w[8 : 8 + n] * _M3 + _mixed(w[16 : 16 + n])))
    span, least = 1, h
    want = length - GRAM + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = want - span
    return np.minimum(least[: least.size - rest], least[rest:]) if rest else least


def runs_of(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with one key inside one text: (key, first window, number of windows), slice by slice.

    ``data`` holds the texts one after another and ``ends`` where each ends.
    """
    bounds = np.r_[0, ends]
    for lo in range(0, data.size - length + 1, SLICE):
        hi = min(lo + SLICE, data.size - length + 1)
        key = window_keys(data[lo : hi + length - 1], length)
        a, b = np.searchsorted(ends, [lo, hi + length], side="right")
        crossing = np.zeros(hi - lo, bool)
        for e in ends[a : b + 1].tolist():
            crossing[max(0, e - length + 1 - lo) : max(0, e - lo)] = True
        at = np.flatnonzero(~crossing)
        if not at.size:
            continue
        key = key[at]
        new = np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)]
        start = np.flatnonzero(new)
        sizes = np.diff(np.r_[start, at.size])
        if (sizes > RUN).any():
            within = np.arange(at.size) - np.repeat(start, sizes)
            start = np.flatnonzero(within % RUN == 0)
            sizes = np.diff(np.r_[start, at.size])
        yield key[start], at[start] + lo, sizes
    del bounds


def _read(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes and text ends, a few megabytes at a time."""
    for ids, texts in read_segment(path):
        yield ids, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def segment_keys(length: int):
    """Distinct fingerprints of a segment's window keys and in how many of its texts each occurs."""

    def keys(path: str) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for _, data, ends in _read(path):
            if data.size < length:
                continue
            parts = [(fingerprints(k), np.searchsorted(ends, at, side="right")) for k, at, _ in runs_of(data, ends, length)]
            if not parts:
                continue
            k, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((text, k))
            k, text = k[order], text[order]
            found.append(k[np.r_[True, (k[1:] != k[:-1]) | (text[1:] != text[:-1])]])
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)

    return keys


def two_stage_suffixes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of short texts held one after another; a suffix ends with its text, equal ones in any order.

    Suffixes smaller than their successors are sorted directly, by seven bytes at a time; each of the others stands
    in the bucket of its first byte in the order of its successor, and the buckets are scanned upwards.
    """
    n = data.size
    if not n:
        return np.zeros(0, np.int64)
    last = np.zeros(n, bool)
    last[ends[np.diff(np.r_[0, ends]) > 0] - 1] = True
    # smaller than its successor: the next different byte of the text is larger; at the end of the text nothing follows, which is smaller
    nearest = np.full(n, n - 1, np.int32)
    turns = np.flatnonzero(np.r_[data[:-1] != data[1:], True] | last).astype(np.int32)
    nearest[turns] = turns
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    rises = (np.r_[data[:-1] < data[1:], False] & ~last)[nearest]
    direct = np.flatnonzero(rises).astype(np.int32)
    text_end = np.repeat(ends.astype(np.int32), np.diff(np.r_[0, ends]))
    words = _words(data)
    # order and groups by seven bytes and how many of them there are, packed in one number; only what is still equal is compared further
    def packed(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        have = np.clip(left, 0, 7)
        return words[np.minimum(at, n - 1)] & _TOP.take(have) | have.astype(np.uint64)

    value = packed(direct, text_end[direct] - direct)
    order = np.argsort(value)
    tied, value, offset = np.arange(direct.size), value[order], 7
    group = np.zeros(direct.size, np.int64)
    while True:
        g = group[tied]
        new = np.r_[True, (g[1:] != g[:-1]) | (value[1:] != value[:-1])]
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(tied.size), 0))]
        tied = tied[(np.r_[~new[1:], False] | ~new) & (value & np.uint64(0xFF) == 7)]
        if not tied.size:
            break
        at = direct[order[tied]]
        value = packed(at + np.int32(offset), text_end[at] - at - np.int32(offset))
        by = np.lexsort((value, group[tied]))
        order[tied], value = order[tied][by], value[by]
        offset += 7
    direct = direct[order]

    # buckets by first byte: first the induced suffixes, then the direct ones
    first_direct = data[direct]
    direct_cut = np.searchsorted(first_direct, np.arange(257))
    out: list[np.ndarray] = []
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # texts end in a suffix whose successor is empty, the smallest: they come first in their buckets
    finals = np.flatnonzero(last & ~rises).astype(np.int32)
    for c in np.unique(data[finals]).tolist():
        waiting[c].append(finals[data[finals] == c])

    induced = ~rises & ~last  # these follow from their successors

    def induce(sorted_: np.ndarray) -> None:
        before = sorted_ - 1  # -1 is the last place, which ends a text
        before = before[induced[before]]
        if not before.size:
            return
        bytes_ = data[before]
        if before.size > 64:
            by = np.argsort(bytes_, kind="stable")
            before, counts = before[by], np.bincount(bytes_, minlength=256)
            at = 0
            for b in np.flatnonzero(counts).tolist():
                waiting[b].append(before[at : at + int(counts[b])])
                at += int(counts[b])
            return
        for b in set(bytes_.tolist()):
            waiting[b].append(before[bytes_ == b])

    for c in range(256):
        while waiting[c]:
            part = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(part)
            induce(part)
        part = direct[direct_cut[c] : direct_cut[c + 1]]
        out.append(part)
        induce(part)
    return np.concatenate(out)


def smallest_owners(data: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """The smallest owner of a text that holds the window at each place; the largest number where no window starts."""
    sa = two_stage_suffixes(data, ends)
    sizes = np.diff(np.r_[0, ends])
    room = np.repeat(ends, sizes) - np.arange(data.size) >= length
    sa = sa[room[sa]]
    smallest = np.full(data.size, np.iinfo(np.int64).max)
    if sa.size:
        words = _words(data)
        equal = np.ones(sa.size - 1, bool)
        for k in [*range(0, length - 7, 8), length - 8]:
            w = words[sa + k]
            equal &= w[1:] == w[:-1]
        first = np.flatnonzero(np.r_[True, ~equal])
        owners = np.repeat(owner, sizes)[sa]
        smallest[sa] = np.repeat(np.minimum.reduceat(owners, first), np.diff(np.r_[first, sa.size]))
    return smallest


def _pack_ranges(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.stack([row, lo, hi], axis=1).astype("<i8")).tobytes()


def _merge(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching ranges of a row joined."""
    if not row.size:
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    shift = row * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.r_[True, (lo + shift)[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return row[at], lo[at], np.r_[reach[at[1:] - 1], reach[-1]] - shift[at]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row: removed byte ranges (start, end) and the bytes that remain.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Texts are
    UTF-8 bytes, matches never cross documents, and all is judged on the input.

    Defined cases: a null text counts as empty; a text shorter than ``length`` stays whole; a null id is larger than any
    other, and rows of one id never remove each other; an empty input gives no rows; other columns are ignored.
    """
    if length < GRAM + 1:
        raise ValueError(f"length is {GRAM + 1} at least")
    segments = Segments(docs, id_col, text_col, SEGMENT)
    buckets = segments.buckets * PARTS
    schema = "doc_id long, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary"
    if not segments.count:
        return segments.spark.createDataFrame([], schema)
    known = shared_keys(segments, segment_keys(length))

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, path, blocks in gathered(batches):
            yield from _candidates(seg, path, unpack_answer(blocks)[0], length, buckets)

    sent = segments.with_blocks(known).mapInArrow(snippets, "bucket int, seg long, ranges binary, meta binary, lens binary, text binary")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = -1
        for batch in batches:
            for bucket, seg, ranges, meta, lens, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ranges is not None:
                    yield _answer(seg, ranges)
                    continue
                if bucket != now:
                    yield from _matched(held, length)
                    held, now = [], bucket
                held.append((seg, meta, lens, text))
        yield from _matched(held, length)

    dealt = sent.repartitionById(segments.buckets, F.expr(f"bucket % {segments.buckets}")).sortWithinPartitions("bucket")
    found = dealt.mapInArrow(match, "seg long, block binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, path, blocks in gathered(batches):
            ranges = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(b, "<i8").reshape(-1, 3) for b in blocks)])
            row, lo, hi = _merge(*ranges.T)
            first = 0
            for ids, texts in read_segment(path):
                cuts = np.searchsorted(row, np.arange(first, first + len(texts) + 1))
                spans, kept = [], []
                for text, a, b in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own = list(zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True))
                    spans.append([{"lo": x, "hi": y} for x, y in own])
                    kept.append(b"".join(text[x:y] for x, y in zip([0, *(h for _, h in own)], [*(x for x, _ in own), len(text)], strict=True)))
                kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
                ids = pa.array(ids, mask=ids == np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
                first += len(texts)

    return segments.with_blocks(found).mapInArrow(cut, schema)


def _content(data: np.ndarray, at: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[a : a + n]``; places ascend."""
    out = np.zeros(at.size, np.uint64)
    for lo in range(0, at.size, 1 << 16):
        here = slice(lo, lo + (1 << 16))
        a, n = at[here], n_bytes[here]
        base = int(a.min())
        words = _words(data[base : int((a + n).max())])
        a = a - base
        part = np.zeros(a.size, np.uint64)
        for k in range(0, int(n.max()), 8):
            live = n > k
            left = (n[live] - k).clip(0, 8)
            shift = np.uint64(8) * (8 - left).astype(np.uint64)
            part[live] = _mixed(part[live] * _M1 + (words[a[live] + k] >> shift << shift) + _M3)
        out[here] = part
    return out


def _answer(seg: int, ranges: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([ranges], pa.binary())], names=["seg", "block"])


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether ``data[a : a + n]`` and ``data[b : b + n]`` are equal, for each entry (``n`` above 0)."""
    same = np.ones(a.size, bool)
    step = max(1, CUT // max(1, int(n.max()))) if n.size else 1
    for lo in range(0, a.size, step):
        x, y, m = a[lo : lo + step], b[lo : lo + step], n[lo : lo + step]
        first = np.cumsum(m) - m
        within = np.arange(int(m.sum()))
        equal = data[np.repeat(x - first, m) + within] == data[np.repeat(y - first, m) + within]
        same[lo : lo + step] = np.logical_and.reduceat(equal, first)
    return same


class _Groups:
    """Equal snippets of one key, found by a hash and told apart by their bytes; one of the smallest document leads."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray):
        order = np.lexsort((doc, size, _content(data, start, size), key))
        k, s, at, d = key[order], size[order], start[order], doc[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
        maybe = np.flatnonzero(~new)
        new[maybe] = ~_same_bytes(data, at[maybe - 1], at[maybe], s[maybe])
        first = np.flatnonzero(new)
        self.leader = order[first]
        #: A snippet's group, and the largest document of each group.
        self.of = np.empty(doc.size, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.largest = d[np.r_[first[1:] - 1, d.size - 1]]
        #: Whether a snippet equals one of a smaller document.
        self.repeats = doc > doc[self.leader][self.of]


def _shown(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray, groups: _Groups, length: int, only_repeated: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated ranges by suffix arrays: (snippet, from, to) inside each snippet of each group.

    The arrays hold one snippet for each group and are built for whole keys at a time: what equals a window is next to it,
    in its own group or in another. With ``only_repeated``, groups of several documents only.
    """
    several = groups.largest > doc[groups.leader]
    group = np.flatnonzero(several) if only_repeated else np.arange(groups.leader.size)
    nothing = np.zeros(0, np.int64)
    if not group.size:
        return nothing, nothing, nothing
    entry = groups.leader[group]  # by key, as groups are
    k, n = key[entry], size[entry]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    before = (np.cumsum(n) - n)[head]
    cuts = [*head[np.r_[True, np.diff(before // CUT) > 0]].tolist(), entry.size]
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own, m = entry[a:b], n[a:b]
        ends = np.cumsum(m)
        gather = np.repeat(start[own] - (ends - m), m) + np.arange(int(ends[-1]))
        smallest = smallest_owners(data[gather], ends, doc[own], length)
        for follows in (False, True):  # for the smallest document's snippets, and for those of the others
            flagged = smallest <= np.repeat(doc[own], m) if follows else smallest < np.repeat(doc[own], m)
            if follows:
                flagged &= np.repeat(several[group[a:b]], m)
            # windows never cross snippets, so runs of flagged places do not either
            step = np.diff(np.r_[False, flagged, False].astype(np.int8))
            lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            of = np.searchsorted(ends, lo, side="right")
            first = (ends - m)[of]
            found.append((2 * group[a:b][of] + follows, lo - first, hi - first + length - 1))
    shown, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    # from a group to its snippets
    place = np.argsort(shown, kind="stable")
    shown, lo, hi = shown[place], lo[place], hi[place]
    asked = 2 * groups.of + groups.repeats
    a, b = np.searchsorted(shown, asked, "left"), np.searchsorted(shown, asked, "right")
    n = b - a
    who = np.repeat(np.arange(doc.size), n)
    at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return who, lo[at], hi[at]


_META = np.dtype([("key", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("at", "<i4")])


def _matched(held: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """What a bucket's snippets show, by segment."""
    if not held:
        return
    meta = np.concatenate([np.frombuffer(m, _META) for _, m, _, _ in held])
    size = np.concatenate([np.frombuffer(n, "<u2") for _, _, n, _ in held]).astype(np.int64)
    seg = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) // _META.itemsize for x in held])
    data = np.concatenate([np.frombuffer(t, np.uint8) for *_, t in held])
    ends = np.cumsum(size)
    start = ends - size
    key, doc, row, place = (meta[n] for n in ("key", "doc", "row", "at"))
    doc, row, place = doc.astype(np.int64), row.astype(np.int64), place.astype(np.int64)
    who, lo, hi = _shown(data, start, size, key, doc, _Groups(data, start, size, key, doc), length, False)
    seg, row, lo, hi = seg[who], row[who], place[who] + lo, place[who] + hi
    order = np.argsort(seg, kind="stable")
    seg, row, lo, hi = seg[order], row[order], lo[order], hi[order]
    for s in np.unique(seg).tolist():
        a, b = np.searchsorted(seg, [s, s + 1])
        yield _answer(s, _pack_ranges(*_merge(row[a:b], lo[a:b], hi[a:b])))


def _candidates(seg: int, path: str, elsewhere: np.ndarray, length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A segment's snippets by bucket, and what its own texts already show."""
    names = ["bucket", "seg", "ranges", "meta", "lens", "text"]
    found, texts = [], []
    first = offset = 0
    for doc_ids, data, ends in _read(path):
        if data.size >= length:
            begins = np.r_[0, ends[:-1]]
            for k, at, n in runs_of(data, ends, length):
                text = np.searchsorted(ends, at, side="right")
                found.append((k, doc_ids[text], first + text, at - begins[text], at + offset, n + length - 1))
        texts.append(data)
        offset += data.size
        first += ends.size
    if not found:
        return
    key, doc, row, at, place, size = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    data = np.concatenate(texts)
    del texts
    # keys that several texts of this segment hold, or other segments
    print_ = fingerprints(key)
    order = np.lexsort((row, print_))
    k, r = print_[order], row[order]
    group = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    sizes = np.diff(np.r_[group, k.size])
    several = np.empty(k.size, bool)
    several[order] = np.repeat(r[group] != r[group + sizes - 1], sizes)
    if elsewhere.size:
        near = np.minimum(np.searchsorted(elsewhere, print_), elsewhere.size - 1)
        several |= elsewhere[near] == print_
    yes = np.flatnonzero(several)
    if not yes.size:
        return
    key, doc, row, at, place, size = (x[yes] for x in (key, doc, row, at, place, size))
    # what equal snippets of this segment show is known here; those of the smallest document go on
    groups = _Groups(data, place, size, key, doc)
    who, lo, hi = _shown(data, place, size, key, doc, groups, length, True)
    if who.size:
        ranges = _pack_ranges(*_merge(row[who], at[who] + lo, at[who] + hi))
        yield pa.RecordBatch.from_arrays([pa.array([seg % buckets], pa.int32()), pa.array([seg], pa.int64()), pa.array([ranges], pa.binary()), *(pa.nulls(1, pa.binary()),) * 3], names=names)
    go = np.flatnonzero(~groups.repeats)
    to = (_mixed(key[go]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    go, to = go[order], to[order]
    cuts = np.searchsorted(to, np.arange(buckets + 1))
    meta = np.empty(go.size, _META)
    meta["key"], meta["doc"], meta["row"], meta["at"] = key[go], doc[go], row[go], at[go]
    for b in range(buckets):
        lo, hi = int(cuts[b]), int(cuts[b + 1])
        if hi > lo:
            own = go[lo:hi]
            n = size[own]
            gather = np.repeat(place[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([seg], pa.int64()), pa.nulls(1, pa.binary()), pa.array([meta[lo:hi].tobytes()], pa.binary()), pa.array([n.astype("<u2").tobytes()], pa.binary()), pa.array([data[gather].tobytes()], pa.binary())],
                names=names,
            )
