"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from four base patterns and from looser ones. Labelers vote on each candidate: the base pattern, the
format, a gazetteer (top-level domains, calling codes, card issuers, address ranges), the context before it and its
borders. Expectation-maximisation estimates how reliable each labeler is from the counts of vote patterns, and a
logistic span classifier is trained on the posteriors. Valid base matches are known examples, base matches that fail their
test (octets over 255, a bad Luhn sum, a wrong count of digits) known counterexamples; looser candidates are a class with a
prior of its own. Base spans stay in any case; a looser candidate becomes a span where the classifier is sure.

Long texts: places are prefix sums over blocks of matches, a match carries the text around it, and redaction cuts the text in
blocks once, so time grows with the text (times the square root of its matches at worst), not with its square.

Scale: no shuffle but the counts of vote patterns, which are at most a few thousand rows whatever the input; the
fitted weights return as literals. Patterns are possessive, so long texts need no backtracking and no deep stack.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ["email", "ip", "card", "phone"]

# The base patterns. A match starts where a run of its first characters starts or where the last match ended, which is
# what leftmost non-overlapping search finds, without trying every place of a long run.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Looser candidates, and what a text must hold for them (and for the base patterns) to be searched at all.
LOOSE = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\\[(] ?(?:at|AT) ?[\\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\\[(] ?(?:dot|DOT) ?[\\])] ?[A-Za-z0-9-]{1,63}+|\\.[A-Za-z0-9-]{1,63}+)++",
    "ip": "(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])",
    "card": "(?<![0-9])3[47][0-9]{2}[\\x20-]?[0-9]{6}[\\x20-]?[0-9]{5}(?![0-9])",
    "phone": "(?<![0-9+(.-])\\(?[2-9][0-9]{2}\\)?[\\x20.-][2-9][0-9]{2}[\\x20.-][0-9]{4}(?![0-9])",
}
_NEEDS = {
    "email": "@",
    "ip": "[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]",
    "card": "(?:[0-9][\\x20-]?){15}[0-9]",
    "phone": "+",
}
_NEEDS_LOOSE = {"email": "[\\[(] ?(?:at|AT) ?[\\])]", "ip": "(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]", "card": "3[47][0-9]{2}[\\x20-]?[0-9]{6}", "phone": "[0-9][\\x20.-][0-9]{4}"}

# Gazetteers (fixed values).
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "be", "us", "ca", "au", "jp", "cn", "in", "br", "ru", "pl", "se"]
CALLING_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98"]
CUES = {
    "email": "(?i)(?:e-?mail|contact|write|reach|correo|courriel|adresse)",
    "ip": "(?i)(?:\\bip\\b|address|host|server|client|from|login|addr)",
    "card": "(?i)(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment)",
    "phone": "(?i)(?:phone|\\btel\\b|call|mobile|cell|fax|whatsapp|telefon|t\\u00e9l)",
}
AGAINST = "(?i)(?:version|\\bv\\.|section|isbn|figure|license|\\border\\b|serial|build|chapter|page)"
#: Elements of an array that are worked on one after another; longer arrays go by such blocks.
BLOCK = 256
#: Characters of a text that redaction cuts at once.
CUT = 4096
#: Characters before a candidate, since the last match of its pattern, that the context labeler reads.
CONTEXT = 32
LABELERS = ["pattern", "format", "gazetteer", "context", "border"]
#: Probability from which a looser candidate becomes a span.
SURE = 0.9
#: The prior of a looser candidate is at most even, so the classifier's bias for one is at most 0.
MOST_LOOSE = 0.5
_MATCH = "struct<lo: int, hi: int, hit: string, loose: boolean, before: string, left: string, right: string>"


def _blocks(items: Column) -> Column:
    """An array cut into arrays of at most ``BLOCK`` elements."""
    of = lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK))
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), of)).otherwise(F.array(items))


def _earlier(numbers: Column, merge) -> Column:
    """For each element of an array of integers the ``merge`` (sum, or maximum of what is not negative) of all before it, 0 for the first."""
    start = F.struct(F.lit(0).alias("acc"), F.array().cast("array<int>").alias("out"))
    step = lambda s, x: F.struct(merge(s["acc"], x).alias("acc"), F.concat(s["out"], F.array(s["acc"])).alias("out"))
    inner = F.transform(_blocks(numbers), lambda block: F.aggregate(block, start, step))
    offsets = lambda done: F.aggregate(F.transform(done, lambda d: d["acc"]), start, step)["out"]
    return let(inner, lambda done: F.flatten(F.zip_with(done, offsets(done), lambda d, o: F.transform(d["out"], lambda x: merge(o, x)))))


def _matches(text: Column, pattern: str, loose: bool) -> Column:
    """Places (code points), strings and surroundings of all matches, from the pieces between them."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(pieces, F.concat(hits, F.array(F.lit(None).cast("string"))), lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))

    def placed(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda z: F.length(z["piece"]) + F.coalesce(F.length(z["hit"]), F.lit(0)))
        after = F.concat(F.slice(F.transform(pairs, lambda z: F.left(z["piece"], F.lit(1))), F.lit(2), F.greatest(F.size(pairs) - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
        of = lambda z: F.struct(
            (z["at"] + F.length(z["pair"]["piece"])).alias("lo"),
            (z["at"] + F.length(z["pair"]["piece"]) + F.length(z["pair"]["hit"])).alias("hi"),
            z["pair"]["hit"].alias("hit"),
            F.lit(loose).alias("loose"),
            F.right(z["pair"]["piece"], F.lit(CONTEXT)).alias("before"),
            F.right(z["pair"]["piece"], F.lit(1)).alias("left"),
            z["after"].alias("right"),
        )
        zipped = F.arrays_zip(pairs.alias("pair"), _earlier(sizes, lambda a, b: a + b).alias("at"), after.alias("after"))
        return F.transform(F.filter(zipped, lambda z: z["pair"]["hit"].isNotNull()), of)

    return F.coalesce(let(pairs, placed), F.lit(None).cast(f"array<{_MATCH}>"))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits (19 at most) pass the Luhn test."""
    value = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """The base test of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        small = lambda x: F.when(F.length(part(x)) <= 3, part(x).cast("int") <= 255).otherwise(False)
        return F.forall(F.split(hit, "\\."), small)
    digits = _digits(hit)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _fails(kind: str, hit: Column) -> Column:
    """Whether a match is a counterexample: it looks like the kind and fails the base test."""
    if kind == "email":
        return F.lit(False)
    fails = ~_valid(kind, hit)
    return F.length(_digits(hit)).between(16, 19) & fails if kind == "card" else fails


def _loose_valid(kind: str, hit: Column) -> Column:
    return _luhn(_digits(hit)) if kind == "card" else F.lit(True)


def _found(text: Column, kind: str, failed: bool) -> Column:
    """``own``: the base spans and, with ``failed``, the base matches that are counterexamples, from one search; ``loose``: looser ones."""
    none = F.array().cast(f"array<{_MATCH}>")
    needs = F.contains(text, F.lit(_NEEDS[kind])) if kind in ("email", "phone") else text.rlike(_NEEDS[kind])
    of = lambda found, test: F.filter(found, lambda m: test(kind, m["hit"]))
    both = lambda found: F.struct(of(found, _valid).alias("base"), (of(found, _fails) if failed else none).alias("failed"))
    own = F.when(needs, let(_matches(text, BASE[kind], False), both)).otherwise(F.struct(none.alias("base"), none.alias("failed")))
    loose = F.when(text.rlike(_NEEDS_LOOSE[kind]), F.filter(_matches(text, LOOSE[kind], True), lambda m: _loose_valid(kind, m["hit"]))).otherwise(none)
    return F.struct(own.alias("own"), loose.alias("loose"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, m: Column, base: int) -> dict[str, Column]:
    hit, digits = m["hit"], _digits(m["hit"])
    before, left, right = m["before"], m["left"], m["right"]
    form = {
        "email": _vote(hit.rlike("\\.[A-Za-z]{2,24}$"), hit.rlike("^[._%+-]|\\.\\.|-$|\\.[0-9]+$")),
        "ip": _vote(~hit.rlike("(?:^|[.:])0[0-9]"), hit.rlike("(?:^|\\.)0[0-9]")),
        "card": _vote(hit.rlike("^[0-9]+$|^[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}|^[0-9]{4}([ -])[0-9]{6}\\2[0-9]{5}$"), hit.rlike("(?:^| )[0-9] ")),
        "phone": _vote(hit.rlike("[0-9]{3}[) .-]+[0-9]{3,4}[ .-][0-9]{4}$|^\\+[0-9]{8,15}$"), hit.rlike("[.-]{2}|\\(\\)|[(][^)]*$")),
    }[kind]
    domain, code = F.lower(F.regexp_extract(hit, "([A-Za-z0-9-]+)[\\])]?$", 1)), F.regexp_extract(hit, "^\\+([0-9]{1,3})", 1)
    gazetteer = {
        "email": _vote(domain.isin(TOP_DOMAINS), domain.rlike("^[0-9]+$")),
        "ip": _vote(~hit.rlike("^(?:0|127|255)\\.|^(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\\."), hit.rlike("^(?:0|127|255)\\.")),
        "card": _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^0")),
        "phone": _vote(code.isin(CALLING_CODES) | F.substr(code, F.lit(1), F.lit(2)).isin(CALLING_CODES) | F.substr(code, F.lit(1), F.lit(1)).isin(["1", "7"]), code.startswith("0")),
    }[kind]
    return {
        "pattern": F.when(m["loose"], 0).otherwise(base),
        "format": form,
        "gazetteer": gazetteer,
        "context": _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)),
        "border": _vote(~left.rlike("[\\p{L}0-9]") & ~right.rlike("[\\p{L}0-9]"), left.rlike("[\\p{L}0-9]") & right.rlike("[\\p{L}0-9]")),
    }


def _labelled(kind: str) -> Column:
    """The candidates of a kind, looser ones apart from base ones, and the counterexamples, with their votes."""
    base, loose = F.col(f"_{kind}")["own"]["base"], F.col(f"_{kind}")["loose"]
    meets = lambda b, m: (b["lo"] < m["hi"]) & (m["lo"] < b["hi"])
    ranges = F.transform(_blocks(base), lambda block: F.struct(F.element_at(block, 1)["lo"].alias("lo"), F.element_at(block, -1)["hi"].alias("hi"), block.alias("block")))
    apart_from = lambda ranges: F.filter(loose, lambda m: ~F.exists(ranges, lambda r: meets(r, m) & F.exists(r["block"], lambda b: meets(b, m))))
    apart = F.when((F.size(base) > 0) & (F.size(loose) > 0), let(ranges, apart_from)).otherwise(loose)

    def labelled(m: Column, base_vote: int = 1) -> Column:
        votes = _votes(kind, m, base_vote)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["lo"].alias("lo"), m["hi"].alias("hi"), m["loose"].alias("loose"), F.array(*[votes[v] for v in LABELERS]).alias("votes"))

    return F.concat(F.transform(F.concat(base, apart), lambda m: labelled(m)), F.transform(F.col(f"_{kind}")["own"]["failed"], lambda m: labelled(m, -1)))


def _kept(docs: DataFrame, keep: list[Column] | None, taken: list[str]) -> tuple[list[Column], list[str]]:
    """The columns of ``keep`` under names of no other meaning, and their names."""
    names = docs.select(*keep).columns if keep else []
    if len({*names, *taken}) < len(names) + len(taken):
        raise ValueError(f"names of columns to keep: {names} must differ from each other and from {taken}")
    return [c.alias(f"_keep_{i}") for i, c in enumerate(keep or [])], names


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None, failed: bool = False) -> DataFrame:
    """``doc_id, text, found``: all candidates as an array of structs (kind, lo, hi, loose, votes), ordered by kind and place.

    With ``failed`` the counterexamples too; the pattern labeler votes -1 on them. Columns of ``keep`` follow.
    """
    kept, names = _kept(docs, keep, ["doc_id", "text", "found"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *kept)
    rows = rows.select("*", *[_found(F.col("text"), k, failed).alias(f"_{k}") for k in KINDS])
    lists = [_labelled(kind) for kind in KINDS]
    return rows.select("doc_id", "text", F.concat(*lists).alias("found"), *[F.col(f"_keep_{i}").alias(n) for i, n in enumerate(names)])


@dataclass
class Model:
    """Reliabilities (kind -> labeler -> accuracy) and the span classifier's weights (kind -> bias, then a labeler's votes for, then its votes against)."""

    reliability: dict[str, list[float]]
    weights: dict[str, list[float]]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, known: list[float | None] | None = None) -> tuple[list[float], list[float]]:
    """Accuracies of the labelers and the posterior of each vote pattern, from patterns with their counts.

    A labeler that does not abstain (vote 0) is right with one rate on spans and with another on what is none. Rates are
    kept between 0.01 and 0.99 by a prior of 8 right and 2 wrong votes each; accuracies between 0.55 and 0.99. Patterns with
    a ``known`` posterior keep it and, where that list is given, alone set the rates; the others share a prior, then at most ``MOST_LOOSE``.
    """
    accuracy, posterior, _, _ = _label_model(patterns, rounds, known)
    return accuracy, posterior


def _label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int, known: list[float | None] | None) -> tuple[list[float], list[float], float, list[tuple[float, float]]]:
    """Accuracies, posteriors, the prior of patterns that are not known, and the evidence (log odds) of each labeler's votes for and against."""
    n = len(LABELERS)
    fixed = known or [None] * len(patterns)
    most = 0.95 if known is None else MOST_LOOSE
    accuracy, share, posterior = [0.8] * n, min(0.7, most), [0.0] * len(patterns)
    evidence = [(math.log(4), -math.log(4))] * n
    for _ in range(rounds):
        for i, (votes, _) in enumerate(patterns):
            posterior[i] = _pattern_posterior(votes, share, evidence) if fixed[i] is None else fixed[i]
        right, seen = [[8.0] * n, [8.0] * n], [[10.0] * n, [10.0] * n]  # on what is no span, on spans
        total = found = 0.0
        for (votes, count), p, k in zip(patterns, posterior, fixed, strict=True):
            if k is None:
                total += count
                found += count * p
            if k is None and known is not None:
                continue  # rates come from what is known; candidates in doubt would otherwise wear away what could confirm them
            for j, v in enumerate(votes):
                if v:
                    for truth, part in ((0, 1 - p), (1, p)):
                        seen[truth][j] += count * part
                        right[truth][j] += count * part * (v > 0 if truth else v < 0)
        before = accuracy
        rate = [[min(0.99, max(0.01, a / b)) for a, b in zip(right[t], seen[t], strict=True)] for t in (0, 1)]
        # a vote for is never evidence against, nor the other way
        evidence = [(max(0.0, math.log(hit / (1 - miss))), min(0.0, math.log((1 - hit) / miss))) for miss, hit in zip(*rate, strict=True)]
        accuracy = [min(0.99, max(0.55, (right[0][j] + right[1][j]) / (seen[0][j] + seen[1][j]))) for j in range(n)]
        share = min(most, max(0.05, (found + 7) / (total + 10)))
        if max(abs(a - b) for a, b in zip(before, accuracy, strict=True)) < 1e-6:
            break
    return accuracy, posterior, share, evidence


def _pattern_posterior(votes: tuple[int, ...], share: float, evidence: list[tuple[float, float]]) -> float:
    return _sigmoid(math.log(share / (1 - share)) + sum(e[0] if v > 0 else e[1] for v, e in zip(votes, evidence, strict=True) if v))


def train_classifier(patterns: list[tuple[tuple[int, ...], int]], posterior: list[float], steps: int = 3000, ridge: float = 0.0001) -> list[float]:
    """Logistic weights (bias, then one for each labeler's vote for, then one for each vote against) for the posteriors, by gradient steps on the pattern counts."""
    votes, counts = np.array([v for v, _ in patterns]), np.array([c for _, c in patterns], np.float64)
    x = np.hstack([np.ones((len(patterns), 1)), votes > 0, votes < 0])
    w, shrink = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(x @ w))) - posterior) * counts / counts.sum()
        w -= 2.0 * (x.T @ error + shrink * w)
    return w.tolist()


def fit(found: DataFrame) -> Model:
    """Reliabilities and weights from all candidates of ``candidates``, best with the counterexamples; without candidates of a kind its weights accept none.

    The classifier learns the posterior of every pattern that a looser candidate can have, seen or not, beside those of the
    candidates seen: valid base matches would otherwise be all it learns from.
    """
    spans = found.where(F.size("found") > 0).select(F.explode("found").alias("m"))
    counts = spans.groupBy(F.col("m.kind").alias("kind"), *[F.col("m.votes")[j].alias(f"v{j}") for j in range(len(LABELERS))]).count()
    by_kind: dict[str, list] = {k: [] for k in KINDS}
    for r in counts.orderBy("kind", *[f"v{j}" for j in range(len(LABELERS))]).collect():  # 4 x 3^5 rows at most
        by_kind[KINDS[r["kind"]]].append((tuple(r[f"v{j}"] for j in range(len(LABELERS))), r["count"]))
    model = Model({}, {})
    for kind, patterns in by_kind.items():
        known = [{1: 1.0, -1: 0.0}.get(votes[0]) for votes, _ in patterns]
        accuracy, posterior, share, evidence = _label_model(patterns, 50, known)
        model.reliability[kind] = accuracy
        if not patterns:
            model.weights[kind] = [-9.0] + [0.0] * (2 * len(LABELERS))
            continue
        seen = sum(count for _, count in patterns)
        every = [(0, *votes) for votes in itertools.product((-1, 0, 1), repeat=len(LABELERS) - 1)]
        examples = [(votes, count / seen) for votes, count in patterns] + [(votes, 4 / len(every)) for votes in every]
        model.weights[kind] = train_classifier(examples, [*posterior, *(_pattern_posterior(votes, share, evidence) for votes in every)])
    return model


def detect(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``doc_id, text, spans`` for every row: spans (kind, lo, hi, loose, score) in code points, end exclusive, by kind and start.

    Without a model one is fitted on all candidates of ``docs``. Defined cases: a null text counts as empty; spans of
    different kinds may overlap; repeated rows each get a row; an empty input gives none; other columns are ignored but for ``keep``, whose names must not be those above. A text of very many
    spans takes time in proportion to its length and to the number of spans to the power 1.5 at most.
    """
    kept, names = _kept(docs, keep, ["doc_id", "text", "spans"])
    found = candidates(docs, id_col, text_col, kept)
    if model is None:
        model = fit(candidates(docs, id_col, text_col, failed=True))
    weights = F.array(*[F.array(*[F.lit(float(w)) for w in model.weights[k]]) for k in KINDS])
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def scored(m: Column) -> Column:
        w = F.element_at(weights, m["kind"] + 1)
        part = lambda v, at: F.when(v > 0, F.element_at(w, at + 2)).when(v < 0, F.element_at(w, at + len(LABELERS) + 2)).otherwise(0.0)
        logit = F.aggregate(F.transform(m["votes"], part), F.element_at(w, 1), lambda acc, x: acc + x)
        return F.struct(m["kind"].alias("rank"), m["lo"].alias("lo"), m["hi"].alias("hi"), F.element_at(kinds, m["kind"] + 1).alias("kind"), m["loose"].alias("loose"), (1 / (1 + F.exp(-logit))).alias("score"))

    spans = F.sort_array(F.filter(F.transform("found", scored), lambda s: ~s["loose"] | (s["score"] >= SURE)))
    return found.select("doc_id", "text", spans.alias("spans"), *[F.col(f"_keep_{i}").alias(n) for i, n in enumerate(names)])


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["lo"], s["hi"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), s["kind"].alias("kind"))))

    def cut(blocks: Column, lo: Column, hi: Column) -> Column:
        """Characters from ``lo`` to ``hi``, from the blocks that hold them."""
        first, last = F.floor(lo / CUT).cast("int"), F.floor((hi - 1) / CUT).cast("int")
        whole = F.when(first == last, F.element_at(blocks, first + 1)).otherwise(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""))
        return F.when(hi > lo, F.substr(whole, lo - first * CUT + 1, hi - lo)).otherwise("")

    def over(z: Column) -> Column:
        """Spans in order with the end of all before: each that starts behind that end, and those reaching beyond it, cut the text."""
        outer = F.filter(F.arrays_zip(z["s"].alias("s"), _earlier(F.transform(z["s"], lambda s: s["hi"]), F.greatest).alias("end")), lambda x: x["s"]["lo"] >= x["end"])
        length = F.length(text)
        ends = F.concat(F.transform(outer, lambda x: x["end"]), F.array(F.aggregate(z["s"], F.lit(0), lambda a, s: F.greatest(a, s["hi"]))))
        starts = F.concat(F.transform(outer, lambda x: x["s"]["lo"]), F.array(length))
        marks = F.concat(F.transform(outer, lambda x: F.concat(F.lit("["), F.upper(x["s"]["kind"]), F.lit("]"))), F.array(F.lit("")))
        parts = F.transform(F.arrays_zip(ends.alias("lo"), starts.alias("hi"), marks.alias("mark")), lambda p: F.concat(cut(z["b"], p["lo"], p["hi"]), p["mark"]))
        return F.array_join(parts, "")

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(F.struct(order.alias("s"), blocks.alias("b")), over)).otherwise(text)
