"""Language identification with hyperdimensional profiles.

Every letter of any script, lower case, has its own random vector of +1/-1, drawn with its code point as seed. A trigram is *bound* by multiplying the vectors of its
letters, each permuted (rotated) by its place; a text is the *bundle* (sum) of its trigrams and a language
the bundle of its training texts. A text goes to the language whose prototype has the largest cosine.

Scale: training sums one vector per language and task, prediction needs no shuffle at all. What is
sent to the driver and back is (languages x dimensions) numbers, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, frugal, only

DIM = 512
SEED = 20240229
#: Trigrams bound at once; bounds the memory of a batch.
BLOCK = 4096
UNDETERMINED = "und"

_state: dict = {}


def _folded() -> np.ndarray:
    """Code point -> the code point of its lower-case letter, 0 where it is no letter."""
    if "folded" not in _state:
        table = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                table[cp] = ord(c.lower()[0])
        _state["folded"] = table
    return _state["folded"]


def letter_vector(code_point: int, dim: int) -> np.ndarray:
    """The +1/-1 vector of a letter, from its code point as seed; 0 stands for a word break."""
    known = _state.setdefault(("letters", dim), {})
    if code_point not in known:
        known[code_point] = np.random.default_rng([SEED, code_point]).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)
    return known[code_point]


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters that occur (the word break first), trigrams of their places around each letter, the text of each trigram."""
    parts = ["\n" + (t or "") for t in texts]
    code = _folded()[np.frombuffer(("".join(parts) + "\n").encode("utf-32-le"), np.uint32)]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    owner = np.append(owner, len(parts) - 1)
    stay = np.ones(code.size, bool)
    stay[1:] = (code[1:] != 0) | (code[:-1] != 0)
    # a break between two texts must not vanish: both neighbours of a text's letters are breaks either way
    code, owner = code[stay], owner[stay]
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    seen[0] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[letters] = np.arange(letters.size)
    code = place[code]
    if code.size < 3:
        return letters, np.zeros(0, np.int64), np.zeros(0, np.int64)
    tri = (code[:-2] * letters.size + code[1:-1]) * letters.size + code[2:]
    middle = code[1:-1] != 0
    return letters, tri[middle], owner[1:-1][middle]


def _bundle(letters: np.ndarray, tri: np.ndarray, owner: np.ndarray, n: int, dim: int) -> np.ndarray:
    """One vector per owner: the sum of its bound trigrams."""
    out = np.zeros((n, dim), np.float32)
    if not tri.size:
        return out
    base = np.stack([letter_vector(c, dim) for c in letters.tolist()])
    rotated = [np.roll(base, k, axis=1) for k in (2, 1, 0)]
    size = letters.size
    if size**3 <= 1 << 21:
        present = np.flatnonzero(np.bincount(tri, minlength=size**3))
        place = np.zeros(size**3, np.int64)
        place[present] = np.arange(present.size)
        at = place[tri]
    else:
        present, at = np.unique(tri, return_inverse=True)
    for lo in range(0, present.size, BLOCK):
        own = present[lo : lo + BLOCK]
        bound = rotated[0][own // size**2] * rotated[1][own // size % size] * rotated[2][own % size]
        here = (at >= lo) & (at < lo + BLOCK) if present.size > BLOCK else slice(None)
        counts = np.bincount(owner[here] * own.size + (at[here] - lo), minlength=n * own.size)
        out += counts.reshape(n, own.size).astype(np.float32) @ bound.astype(np.float32)
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, list[float]]:
    """Language -> prototype, from every row whose text and language are not null.

    Texts without letters add nothing. No labelled rows give an empty dictionary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in chunks(batches, 2 << 20):
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            index = {k: i for i, k in enumerate(names)}
            letters, tri, owner = _trigrams(batch.column(0).to_pylist())
            of = np.array([index[k] for k in langs], np.int64)
            for k, v in zip(names, _bundle(letters, tri, of[owner], len(names), dim), strict=True):
                sums[k] = sums.get(k, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"]
        )

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").mapInArrow(frugal(run), "lang string, sums array<double>")
    total = rows.select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found: dict[str, list[float]] = {}
    for lang, at, x in total.collect():  # languages x dimensions
        found.setdefault(lang, [0.0] * dim)[at] = x
    return {k: v for k, v in sorted(found.items()) if any(v)}


def identify(docs: DataFrame, prototypes: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` (then the columns of ``keep``) for every row; the score is the cosine, cut to 0..1.

    Defined cases: ``und`` and score 0 for a null text, a text without a letter, or no prototypes. Of equal
    cosines the language that sorts first wins. Repeated rows each get a row; an empty input gives none.
    """
    names = list(prototypes)
    dim = len(next(iter(prototypes.values()))) if names else DIM
    unit = np.array([prototypes[k] for k in names], np.float64).reshape(len(names), dim)
    unit = (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-30)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2 << 20):
            n = batch.num_rows
            letters, tri, owner = _trigrams(batch.column(1).to_pylist())
            lettered = np.bincount(owner, minlength=n) > 0
            pred, score = [UNDETERMINED] * n, np.zeros(n)
            if names and tri.size:
                vectors = _bundle(letters, tri, owner, n, dim)
                cosine = vectors @ unit.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
                top = cosine.argmax(axis=1)
                score = np.where(lettered, np.clip(cosine[np.arange(n), top], 0, 1), 0).astype(np.float64)
                pred = [names[t] if yes else UNDETERMINED for t, yes in zip(top, lettered, strict=True)]
            columns = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", *batch.schema.names[2:]])

    rows = only(docs, id_col, text_col, None) if not keep else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    rest = rows.drop("doc_id", "text").schema
    schema = "doc_id long, lang_pred string, score double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    return rows.mapInArrow(frugal(run), schema)
