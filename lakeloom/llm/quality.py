"""Quality rules with distribution divergence, in DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated five-word windows. The method compares
a document's histograms with references of its language by the Jensen-Shannon distance: the classes of its
characters, and its most common words. Guards leave short texts, and texts whose language has no reference, to the base rules.

References are counted over all labelled rows; everything else covers each row alone.

Scale: counts are added up before they are shuffled, by language and by language and word. What comes to the driver and returns
in the plan is one reference a language, with at most 1 / ``LEAST_SHARE`` words whatever the number of documents. Windows are
compared inside a row by sorting 64-bit hashes of their words' hashes, so a long text costs n log n; that two different windows of
one text have equal hashes (a chance of about 1 in 10^13 for a text of a thousand words) is not told apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: A language's common words: the most frequent words with a letter, as many as make up this share of its words and this many at
#: least, of those with this share or more each. A text that holds none of them is then 0.346 or more away, beyond ``MAX_WORD_DISTANCE``.
COMMON_SHARE = 0.22
COMMON_WORDS = 24
LEAST_SHARE = 0.0005
#: Guard: words that a language's labelled rows must hold for a reference.
MIN_REFERENCE_WORDS = 1000
#: Guards: characters and words from which the histograms are compared.
MIN_CHARS = 200
MIN_WORDS = 60
#: Jensen-Shannon distances (0 to 1) beyond which a document is dropped.
MAX_CHAR_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.33

_WHITE = " \t\n\u000b\f\r"
_WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
_OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
_CLASSES = ["lower", "upper", "digit", "white", "punctuation", "symbol", "other"]


@dataclass
class Reference:
    """A language's shares of character classes, its common words (as they stand between white space) and their shares of all words."""

    chars: list[float]
    words: list[str] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)


def _count(text: Column, chars: str) -> Column:
    """How many of these (ASCII) characters the text holds: what the bytes lose when each is taken out."""
    total = F.lit(0)
    for c in chars:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total


def _class_counts(text: Column, white: Column, symbols: Column) -> list[Column]:
    of = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", ""))
    known = [of("\\p{Ll}"), of("\\p{Lu}"), of("0-9"), white, of(PUNCTUATION.replace("-", "\\-")), symbols]
    total = known[0]
    for c in known[1:]:
        total = total + c
    return [*known, F.length(text) - total]


def base_rules(docs: DataFrame, text_col: str = "text", common: list[str] | None = None) -> DataFrame:
    """The rows with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` added.

    With ``common`` also ``_common``: the text's words that are among these.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD[:-1]))
    rows = rows.withColumn("_lines", lines).withColumn("n_words", F.size("_words").cast("long"))
    # each word is hashed once, also where a filter on the result makes the optimizer write this out in place
    windows = lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)]))
    rows = rows.withColumn("_grams", let(F.transform("_words", lambda w: F.xxhash64(w)), windows))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(F.transform("_grams", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    near = F.arrays_zip(
        F.col("_sorted").alias("own"),
        F.expr("concat(array(cast(null as struct<h: bigint, i: int>)), slice(_sorted, 1, size(_sorted) - 1))").alias("before"),
        F.expr("slice(_sorted, 2, size(_sorted))").alias("after"),
    )
    twice = F.transform(F.filter(near, lambda z: F.coalesce(z["own"]["h"] == z["before"]["h"], F.lit(False)) | F.coalesce(z["own"]["h"] == z["after"]["h"], F.lit(False))), lambda z: z["own"]["i"])
    covered = F.aggregate(
        F.sort_array(twice),
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"]).cast("long")).alias("n")),
        lambda acc: acc["n"],
    )
    if common:
        rows = rows.withColumn("_common", F.filter("_words", lambda w: w.isin(common)))
    return (
        rows.withColumn("word_chars", (F.length(text) - _count(text, _WHITE)).cast("long"))
        .withColumn("n_symbols", _count(text, SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0).cast("long")).otherwise(covered))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("_words", "_lines", "_grams", "_sorted")
    )


def learn_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, Reference]:
    """References from all rows with a text and a language; languages of fewer than ``MIN_REFERENCE_WORDS`` words have none."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    chars = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    by_word = written(rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("word")).groupBy("lang", "word").count(), "quality-words")
    # the characters of all texts are those of their words, each as often as its word, and white space
    word, times = F.col("word"), F.col("count")
    classes = _class_counts(word, F.lit(0), _count(word, SYMBOLS))
    summed = by_word.groupBy("lang").agg(F.sum("count").alias("n"), *[F.sum(times * c).alias(n) for c, n in zip(classes, _CLASSES, strict=True)]).where(F.col("n") >= MIN_REFERENCE_WORDS).collect()
    totals, counts = {r["lang"]: r["n"] for r in summed}, {}
    for r in summed:
        counts[r["lang"]] = [r[c] if c != "white" else chars[r["lang"]] - sum(r[k] for k in _CLASSES) for c in _CLASSES]
    if not totals:
        return {}
    least = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, LEAST_SHARE * n)])
    found = {lang: Reference([c / sum(counts[lang]) for c in counts[lang]]) for lang in sorted(totals)}
    # words with a letter (signs are the classes' matter), 1 / LEAST_SHARE a language at most
    common = by_word.where(F.col("count") >= least[F.col("lang")]).where(F.col("word").rlike("\\p{L}")).collect()
    for r in sorted(common, key=lambda r: (-r["count"], r["word"])):
        own = found[r["lang"]]
        if len(own.words) < COMMON_WORDS or math.fsum(own.shares) < COMMON_SHARE:
            own.words.append(r["word"])
            own.shares.append(r["count"] / totals[r["lang"]])
    return found


def _distance(shares: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance (square root of the divergence in bits) of two arrays of shares."""
    term = lambda p, q: (F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)) / 2
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(shares, reference, term), F.lit(0.0), lambda a, t: a + t), F.lit(0.0)))


def _literal(references: dict[str, Reference]) -> Column:
    """The references as an array; the shares of words end with that of all other words."""
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    return F.array(*[
        F.struct(
            F.lit(k).alias("lang"), numbers(r.chars).alias("chars"),
            F.array(*[F.lit(w) for w in r.words]).cast("array<string>").alias("words"),
            numbers([*r.shares, max(0.0, 1 - math.fsum(r.shares))]).alias("shares"),
        )
        for k, r in references.items()
    ])


def quality(docs: DataFrame, references: dict[str, Reference], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[Column] | None = None) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance``.

    ``kept`` is false where a base rule fails or a distance exceeds its bound. Distances are null under their guard, and
    without references; such a row is judged by the other rules.

    Defined cases: a null text has no words, so the base rule fails; a null language, or one without a reference, leaves a row
    to the base rules; repeated rows each get a row; an empty input gives none; other columns are ignored but for ``keep``, whose
    names must not be those above.
    """
    names = docs.select(*keep).columns if keep else []
    if len({*names, *_OUT}) < len(names) + len(_OUT):
        raise ValueError(f"names of columns to keep: {names} must differ from each other and from {_OUT}")
    kept = [c.alias(f"_keep_{i}") for i, c in enumerate(keep or [])]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"), *kept)
    extra = [F.col(f"_keep_{i}").alias(n) for i, n in enumerate(names)]
    rows = base_rules(rows, common=sorted({w for r in references.values() for w in r.words}))
    none = F.lit(None).cast("double")
    if references:
        size = F.greatest(F.length("text"), F.lit(1))
        rows = rows.withColumn("_chars", F.array(*[c / size for c in _class_counts(F.col("text"), F.length("text") - F.col("word_chars"), F.col("n_symbols"))]))
        own = F.filter(_literal(references), lambda r: F.coalesce(r["lang"] == F.col("lang"), F.lit(False)))
        rows = rows.withColumn("_refs", own)  # of the row's language, or none

        def word_distance(r: Column) -> Column:
            shares = F.transform(r["words"], lambda w: (F.size("_common") - F.size(F.array_remove("_common", w))) / F.col("n_words"))
            with_rest = F.transform(F.array(shares), lambda s: F.concat(s, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(s, F.lit(0.0), lambda a, x: a + x)))))
            return _distance(with_rest[0], r["shares"])

        rows = rows.withColumn("char_distance", F.when(F.length("text") >= MIN_CHARS, F.array_min(F.transform("_refs", lambda r: _distance(F.col("_chars"), r["chars"])))))
        distance = F.array_min(F.transform("_refs", word_distance)) if "_common" in rows.columns else none
        rows = rows.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, distance))
    else:
        rows = rows.withColumn("char_distance", none).withColumn("word_distance", none)
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return rows.withColumn("kept", ~F.col("base_failed") & ~far).select(*_OUT, *extra)
