"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, less exceptions.

Folding lower-cases and turns homoglyphs and digits inside words into the letters they imitate.
The lexicon's words and word beginnings and their weights are learned from a bounded labelled sample; the model
is a few hundred strings whatever the input. A match inside an exception phrase counts nothing, all others do.
Null texts are empty; a text without a match gets the base score. Repeated rows get one score each; with no labelled
toxic row the lexicon is empty, with no document there is no row. Texts are scored whole, however long. Terms of one
weight rank by length, then in their own order; a word that is both a term and begins with one counts twice. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import held_out, keep_rows, labelled_sample, map_rows

# Letters of other scripts and signs that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "ν": "v", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ｏ": "o",
}
# Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Harmless phrases that hold a word of the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "pathetic fallacy", "sore loser rule", "not stupid")

SAMPLE_ROWS, MIN_DOCS, MIN_SHARE, MIN_WEIGHT, MAX_TERMS, THRESHOLD = 12_000, 3, 0.02, 4.0, 400, 0.7
STEM = range(4, 8)
_LETTERS = str.maketrans({k: v for k, v in HOMOGLYPHS.items()})
_SPACE = re.compile(r"[\s]+")
_WORDISH = re.compile(r"[^\W_]*[0-9@$!][\w@$!]*")
_SWAP = str.maketrans(DIGITS)
_LETTER = re.compile(r"[^\W\d_]")


def _respell(found: re.Match) -> str:
    word = found[0]
    body = word.rstrip("!")
    return body.translate(_SWAP) + word[len(body):] if _LETTER.search(body) else word


def fold(text: str) -> str:
    """Lower case, look-alike letters to Latin ones, digits and signs inside words to letters; accents stay as
    they tell words of other languages apart."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_LETTERS)
    if _DIGIT.search(low):
        low = _WORDISH.sub(_respell, low)
    return low


_DIGIT = re.compile(r"[0-9@$!]")
_WORD = re.compile(r"[^\W\d_]+")


def _end(span: tuple[int, int]) -> int:
    return span[1]


@dataclass
class Lexicon:
    """``terms``: weight by term; a term that ends in ``*`` stands for every word that begins with it."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    line: tuple[float, float, float] = (-3.0, 1.5, 0.5)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "line": self.line, "_automaton": None}

    def automaton(self):
        """Terms and phrases by their letters: one key may be a word, a beginning of words and a phrase at once."""
        if self._automaton is None and self.terms:
            held: dict[str, list[tuple[bool, float | None]]] = {}
            for term, weight in self.terms.items():
                held.setdefault(term.rstrip("*"), []).append((term.endswith("*"), weight))
            for phrase in self.exceptions:
                held.setdefault(fold(phrase), []).append((False, None))
            made = ahocorasick.Automaton()
            for key, uses in held.items():
                made.add_word(key, (len(key), uses))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def weigh(self, text: str) -> tuple[float, int]:
        """Summed weights of matches at word boundaries that lie in no exception phrase, and the text's length."""
        total = 0.0
        if (automaton := self.automaton()) is not None and text:
            folded = fold(text)
            n, found, spared = len(folded), [], []
            for last, (length, uses) in automaton.iter(folded):
                start, end = last - length + 1, last + 1
                if start and folded[start - 1].isalpha():
                    continue
                whole = end == n or not folded[end].isalpha()
                for stem, weight in uses:
                    if weight is None:
                        if whole:
                            spared.append((start, end))
                    elif stem or whole:
                        found.append((start, end, weight))
            widest = max((e - s for s, e in spared), default=0)
            for start, end, weight in found:
                at = bisect_left(spared, end, key=_end)  # phrases come in order of their ends
                while at < len(spared) and spared[at][1] <= start + widest and spared[at][0] > start:
                    at += 1
                if at == len(spared) or spared[at][1] > start + widest:
                    total += weight
        return total, len(text)

    def inputs(self, text: str) -> tuple[float, float]:
        """Log of the weight, and the weight in a thousand characters, damped."""
        weight, length = self.weigh(text)
        return math.log1p(weight), math.log1p(1000.0 * weight / (200.0 + length))

    def score(self, text: str) -> float:
        a, b, c = self.line
        x, y = self.inputs(text)
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, a + b * x + c * y))))


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return words | {w[:n] + "*" for w in words for n in STEM if len(w) >= n}


def learn(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon of a bounded sample: document counts of terms by label meet on the executors, and only terms
    over ``MIN_WEIGHT`` in ``MIN_SHARE`` of the toxic rows, at most ``MAX_TERMS``, come to the driver; then a line through two inputs is fitted."""

    sample = sample.dropDuplicates(["text", "label"])  # words of a text with many copies are no evidence

    def count(source: Iterator[dict]) -> Iterator[tuple]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        docs = [0, 0]
        for r in source:
            y = int(r["label"] > 0)
            docs[y] += 1
            seen[y].update(_terms(r["text"]))
        yield ("", docs[1], docs[0])
        for term in seen[1]:
            yield (term, seen[1][term], seen[0][term])
        for term in seen[0].keys() - seen[1].keys():
            yield (term, 0, seen[0][term])

    counted = map_rows(sample, "term string, toxic long, clean long", count).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = counted.where("term = ''").collect()
    toxic, clean = (total[0].toxic, total[0].clean) if total else (0, 0)
    if not toxic:
        return Lexicon({}, exceptions)
    weight = F.log((F.col("toxic") + 0.1) / F.lit(toxic + 0.2)) - F.log((F.col("clean") + 0.1) / F.lit(clean + 0.2))
    best = (
        counted.where((F.col("term") != "") & (F.col("toxic") >= max(MIN_DOCS, MIN_SHARE * toxic))).withColumn("weight", weight).where(F.col("weight") > MIN_WEIGHT)
        .orderBy(F.desc(F.round("weight", 6)), F.desc(F.length(F.rtrim("term", F.lit("*")))), "term").limit(MAX_TERMS).collect()
    )
    kept: dict[str, float] = {}
    uses: dict[str, int] = {}
    for r in best:  # the longest form that says as much stands for shorter ones, and a beginning for the words it covers
        stem = r.term.rstrip("*")
        longer = sum(n for t, n in uses.items() if t.startswith(stem))
        if longer < 0.9 * r.toxic and not any(stem[:n] + "*" in kept for n in range(1, len(stem) + 1)):
            kept[r.term], uses[stem] = float(min(r.weight, 6.0)), r.toxic
    lexicon = Lexicon(kept, exceptions)

    def inputs(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            yield (*lexicon.inputs(r["text"]), int(r["label"] > 0))

    data = np.array([tuple(r) for r in map_rows(sample, "x double, y double, label int", inputs).collect()])
    lexicon.line = fit_line(data[:, :2], data[:, 2])
    return lexicon


def fit_line(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> tuple[float, float, float]:
    """Logistic regression on two inputs by Newton's method; the bias moves the middle to the 0.7 threshold's use."""
    z = np.column_stack((np.ones(len(x)), x))
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    z, y, w = z[order], y[order], np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.diag([0.01, 1, 1])
        w = w - np.linalg.solve(hess, z.T @ (p - y) + ridge * np.array([0.01, 1, 1]) * w)
    return tuple(float(v) for v in w)


def toxicity(docs: DataFrame, lexicon: Lexicon, columns: str, keep: list[str], name: str = "score") -> DataFrame:
    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            yield (*(r[c] for c in keep), lexicon.score(r["text"] or ""))

    return map_rows(docs.select(*dict.fromkeys([*keep, "text"])), f"{columns}, {name} double", rows)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; learns from ``labels.toxic``."""
    lexicon = learn(labelled_sample(docs, labels, "toxic", sample_rows))
    scored = toxicity(docs, lexicon, "doc_id long", ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, lexicon: Lexicon, most: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``most``."""
    return keep_rows(docs, lambda text: lexicon.score(text) < most)
