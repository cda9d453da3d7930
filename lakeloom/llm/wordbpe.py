"""BPE with word ends: encoding by a pair occurrence index, and decoding.

The vocabulary file is one of the ``tokenizers`` library: NFC, white space folded, lower case, pieces by a
pattern, byte-level symbols, ``</w>`` on the last symbol of a piece, no decoder. Its path is a parameter; a file with
another normaliser or pre-tokeniser is refused.

Text within Latin-1 is cut into pieces by a pattern of literal ranges, whatever Unicode version Python has. Any stretch
between ASCII white space that holds another character goes through the library's own normaliser and pre-tokeniser;
neither reaches across white space, so stretches do not depend on each other.

A task gathers the distinct pieces of a few megabytes of text and encodes those it has not met: all symbols lie
in one array, an index maps each mergeable pair (by its rank) to all its positions, the active ranks are
applied in ascending order to all positions at once, and only the lists of the neighbours change.

Scale: no shuffle; memory is bounded by the chunk of text and by the cap on remembered pieces.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, flat_gather, frugal, only

#: Pieces a worker remembers between chunks before it starts anew.
MAX_KNOWN = 400_000

_WHITE = r"\t-\r \x85\xa0"
_NUMBERS = "0-9²³¹¼½¾"
_LETTERS = "a-zªµºß-öø-ÿ"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The piece pattern for lower-case text within Latin-1.
LATIN_PIECES = re.compile(f"{_CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_WHITE}{_LETTERS}{_NUMBERS}]+")
_BEYOND_LATIN = re.compile("[^\x00-\xff]")
_STRETCHES = re.compile("[^\t-\r ]+")
#: Stretches beyond Latin-1 that a worker remembers, and how long a remembered one may be.
MAX_STRETCHES, STRETCH = 100_000, 256

#: What the vocabulary file must say (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class WordVocabulary:
    """The vocabulary file: ids, merges as pair -> (rank, new id), special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER:
            raise ValueError(f"{path}: another normaliser or pre-tokeniser than this module's")
        self.path = path
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.ids.update(self.special)
        self.suffix = model["end_of_word_suffix"]
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token.encode()
        symbols = byte_symbols()
        self.inner = np.array([self.ids[s] for s in symbols], np.int64)
        self.last = np.array([self.ids[s + self.suffix] for s in symbols], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in pairs], np.int64)
        right = np.array([self.ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        self._order = np.argsort(key, kind="stable")
        self._keys = key[self._order]
        # ranks whose new symbol takes part in a pair of lower rank: such a merge is done one position a piece at a time
        lowest = np.full(len(self.tokens), len(pairs), np.int64)
        ranks = np.arange(len(pairs))
        np.minimum.at(lowest, left, ranks)
        np.minimum.at(lowest, right, ranks)
        self.careful = lowest[self.merged] < ranks
        self.doubled = left == right

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where a pair does not merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), self._keys.size - 1)
        return np.where(self._keys[at] == key, self._order[at], -1)


def encode_pieces(vocab: WordVocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and the number of ids of each."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = data.size
    ends = np.cumsum(sizes)
    final = np.zeros(n, bool)
    final[ends[sizes > 0] - 1] = True
    symbol = np.where(final, vocab.last[data], vocab.inner[data])
    piece = np.repeat(np.arange(sizes.size), sizes)
    following = np.where(final, -1, np.arange(1, n + 1))
    first = np.zeros(n, bool)
    first[(ends - sizes)[sizes > 0]] = True
    before = np.where(first, -1, np.arange(-1, n - 1))
    alive = np.ones(n, bool)
    rank_at = np.full(n, -1, np.int64)
    open_ = np.flatnonzero(~final)
    rank_at[open_] = vocab.rank(symbol[open_], symbol[open_ + 1])

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(positions: np.ndarray) -> None:
        ranks = rank_at[positions]
        positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
        if not positions.size:
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), ranks.size]
        for lo, hi in zip(bounds, bounds[1:]):
            r = int(ranks[lo])
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(positions[lo:hi])

    add(open_)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank_at[at] == r]
        if not at.size:
            continue
        if vocab.careful[r]:
            _, one = np.unique(piece[at], return_index=True)
            rest = np.delete(at, one)
            at = at[one]
            if rest.size:
                index[r] = [rest]
                heapq.heappush(active, r)
        elif vocab.doubled[r] and at.size > 1:
            # in a run x x x every second pair merges, from the left
            starts = np.r_[True, at[1:] != following[at[:-1]]]
            run = np.flatnonzero(starts)
            within = np.arange(at.size) - np.repeat(run, np.diff(np.r_[run, at.size]))
            at = at[within % 2 == 0]
        gone = following[at]
        after = following[gone]
        symbol[at] = vocab.merged[r]
        alive[gone] = False
        rank_at[gone] = -1
        following[at] = after
        before[after[after >= 0]] = at[after >= 0]
        prior = before[at]
        touched = np.unique(np.r_[prior[prior >= 0], at])
        rank_at[touched] = -1
        paired = touched[following[touched] >= 0]
        rank_at[paired] = vocab.rank(symbol[paired], symbol[following[paired]])
        add(paired)
    return symbol[alive], np.bincount(piece[alive], minlength=sizes.size)


class _Numbers(dict):
    """Piece -> its number; pieces that were not known are numbered and listed as ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class WordEncoder:
    """Whole texts to ids. ``pieces_encoder`` maps a list of pieces to (ids, counts); pieces are remembered.

    ``special``: the strings of special tokens in a text become their ids (the library's default); else they are
    ordinary text.
    """

    def __init__(self, vocab: WordVocabulary, pieces_encoder: Callable | None = None, special: bool = True):
        self.vocab = vocab
        self._encode = pieces_encoder or (lambda pieces: encode_pieces(vocab, [p.encode() for p in pieces]))
        self._special = re.compile("|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True)))) if special and vocab.special else None
        self._library = None
        self._stretches: dict[str, list[str]] = {}
        self._forget()

    def _forget(self) -> None:
        self._known = _Numbers()
        self._flat = np.zeros(1 << 16, np.uint32)
        self._used = 0
        self._start = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int64)
        if self._special:
            for token, i in self.vocab.special.items():
                self._known[token]
                self._learn(np.array([i]), np.array([1]))

    def _learn(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """The ids of the fresh pieces, in the order of their numbers."""
        need = self._used + ids.size
        if need > self._flat.size:
            self._flat = np.concatenate([self._flat[: self._used], np.zeros(max(need, 2 * self._flat.size) - self._used, np.uint32)])
        self._flat[self._used : need] = ids
        self._start = np.append(self._start, self._used + np.cumsum(counts) - counts)
        self._size = np.append(self._size, counts)
        self._known.fresh.clear()
        self._used = need

    def _ordinary(self, text: str) -> list[str]:
        if _BEYOND_LATIN.search(text) is None:
            return LATIN_PIECES.findall(text.lower())
        out = []
        for stretch in _STRETCHES.findall(text):
            out += LATIN_PIECES.findall(stretch.lower()) if _BEYOND_LATIN.search(stretch) is None else self._beyond(stretch)
        return out

    def _beyond(self, stretch: str) -> list[str]:
        """The pieces that the library's own normaliser and pre-tokeniser make of a stretch."""
        found = self._stretches.get(stretch)
        if found is None:
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.vocab.path)
                self._bytes = {s: b for b, s in enumerate(byte_symbols())}
            own = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(stretch))
            found = [bytes(map(self._bytes.__getitem__, piece)).decode() for piece, _ in own]
            if len(stretch) <= STRETCH:
                if len(self._stretches) >= MAX_STRETCHES:
                    self._stretches.clear()
                self._stretches[stretch] = found
        return found

    def pieces(self, text: str) -> list[str]:
        if self._special is None or "<|" not in text:
            return self._ordinary(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._ordinary(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._ordinary(text[at:])

    def _known_pieces(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' pieces one after another, and the text each belongs to."""
        if len(self._known) > MAX_KNOWN:
            self._forget()
        parts = [self.pieces(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        which = np.fromiter(map(self._known.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        if self._known.fresh:
            self._learn(*self._encode(self._known.fresh))
        return which, sizes

    def _sizes(self, which: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(self._size[which])]
        ends = np.cumsum(pieces)
        return upto[ends] - upto[ends - pieces]

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and the number of ids of each text."""
        which, pieces = self._known_pieces(texts)
        return flat_gather(self._flat, self._start[which], self._size[which]), self._sizes(which, pieces)

    def count(self, texts: Iterable[str]) -> np.ndarray:
        """The number of ids of each text."""
        return self._sizes(*self._known_pieces(texts))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids (UTF-8), special tokens included; without a decoder tokens are joined by blanks."""
        return b" ".join(map(self.vocab.tokens.__getitem__, ids.tolist()))


def library_pieces_encoder(path: str) -> tuple[WordVocabulary, Callable]:
    """The vocabulary and an encoder of pieces that asks the ``tokenizers`` library for each."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    table = {b: ord(s) for b, s in enumerate(byte_symbols())}

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(table))] for p in pieces]
        counts = np.array([len(f) for f in found], np.int64)
        return np.fromiter((i for f in found for i in f), np.int64, int(counts.sum())), counts

    return WordVocabulary(path), encode


_encoders: dict = {}


def encoder(path: str, library: bool = False, special: bool = True) -> WordEncoder:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    key = path, library, special
    if key not in _encoders:
        if library:
            vocab, pieces_encoder = library_pieces_encoder(path)
            _encoders[key] = WordEncoder(vocab, pieces_encoder, special)
        else:
            _encoders[key] = WordEncoder(WordVocabulary(path), None, special)
    return _encoders[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row: ids as little-endian unsigned 32-bit integers, and their text.

    Defined cases: a null text counts as empty and has no ids; repeated rows each get a row, null ids included; an
    empty input gives none; other columns are ignored. The whole text is encoded, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in chunks(batches, 8 << 20):
            ids, counts = enc.encode(batch.column(1).to_pylist())
            wide = ids.astype("<u4")
            ends = np.cumsum(counts)
            cuts = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
            decoded = [enc.decode(wide[a:b]) for a, b in cuts] if decode else [None] * len(cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array([wide[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return only(docs, id_col, text_col).mapInArrow(frugal(run), "doc_id long, n_tokens long, ids binary, decoded string")


def count_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` for every row: how many ids its whole text has. Cases as in ``encode_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc.count(batch.column(1).to_pylist()))], names=["doc_id", "n_tokens"])

    return only(docs, id_col, text_col).mapInArrow(frugal(run), "doc_id long, n_tokens long")
