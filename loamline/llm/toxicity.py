"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: compatibility forms, lower case, letters of other scripts that look like Latin ones, and digits
and signs that stand for letters inside a word. The lexicon holds words and beginnings of words with a weight (how much
likelier they are in toxic documents), learned from labelled rows by counting documents; an entry has to be too frequent
in toxic ones for chance, given how many candidates there are, and copies of a document count once. Of related entries
the most specific one that covers as much stays. Phrases in which an entry is harmless are learned as exceptions and cancel the
hits they cover. The sum of the weights, by itself and normalised by the length in words, goes through a logistic curve.

Learning takes a bounded sample of labelled rows (``SAMPLE``, by hash of the id); entries and exceptions are as many as pass their
tests. Defined results: null and empty texts have no hits and get the curve's value there; long texts are scored whole, in time that
grows with their length; without labels of both sorts a text's score is the share of toxic labels
(a half without any); a document labelled both ways counts as both; of equally good entries the longer comes first, then by the
alphabet; repeated rows are each scored; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize
from .near_dup import shingles
from .pii import fit_logistic

#: Labelled rows that the lexicon and the curve are learned from, at most.
SAMPLE = 20_000
#: An entry must be in this share of the toxic rows (and in so many), this much likelier there (natural logarithm).
SHARE, LEAST, ODDS = 0.02, 3, 2.0
#: Chance entries that may be expected in the whole lexicon.
CHANCE = 0.01
#: Beginnings of words that may be entries.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A phrase seen this often with at most this share of toxic rows is an exception.
PHRASE_ROWS, PHRASE_TOXIC = 5, 0.1

# Letters that look like Latin ones, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "օ": "o", "ո": "n", "ս": "u",
}
SIGNS = str.maketrans("013457@$!|€", "oieastasile")

_TABLE = str.maketrans(LOOKALIKES | {c: " " for c in ".,;:?\"'()[]{}<>/\\\n\r\t\v\f_-*#%&=~^`«»“”„‘’…–—"} | {c: None for c in "​‌‍⁠﻿­"})
_LETTER = re.compile(r"[^\W\d_]")
_ONLY = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"[0-9@$!|€]")


def _unsign(word: str) -> str:
    """The word with digits and signs that stand for letters read as letters, if it has two letters or more."""
    if not _SIGN.search(word):
        return word
    inner = word.lstrip("!|@$€")
    head = word[: len(word) - len(inner)]
    if head and head[-1] not in "@$€":
        head = " "
    bare = inner.rstrip("!|")
    word = head + bare + (" " if len(bare) < len(inner) else "")
    return word.translate(SIGNS) if len(_LETTER.findall(word)) >= 2 else word


def fold(text: str | None) -> str:
    """The words of a text as the lexicon sees them, with spaces between, before and after."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    words = text.lower().translate(_TABLE).split()
    if any(c in text for c in "0123456789@$!|€"):
        words = " ".join(map(_unsign, words)).split()
    return f" {' '.join(words)} "


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def entries_of(folded: str) -> Counter:
    """How often each candidate for the lexicon occurs: words (with a space at both ends) and beginnings of words (with
    one before)."""
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        if len(w) > 2 and _ONLY.fullmatch(w):
            out[f" {w} "] += n
            for k in BEGINNINGS:
                if len(w) > k:
                    out[f" {w[:k]}"] += n
    return out


def surprise(t: int, n: int, share: float) -> float:
    """A lower bound of -log of the chance that t or more of n rows are toxic when the share of toxic rows is as given."""
    p = t / n
    return n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def _sketch(text: str | None) -> int:
    """The same for most near copies of a text, hardly ever for others: the least hash of its five-word runs."""
    found = shingles(text)
    return int(found[0] >> np.uint64(1)) if len(found) else 0


def choose_entries(counts: list[tuple[str, int, int, int, int]], toxic: int, clean: int, toxic_words: int, clean_words: int, among: int) -> dict[str, float]:
    """Entries and weights from (candidate, toxic rows with it, other rows with it, its occurrences in either). among: how many
    candidates are tried."""
    good, share = [], toxic / (toxic + clean)
    needed = math.log(max(1, among) / CHANCE)
    for entry, t, c, t_n, c_n in counts:
        odds = math.log((t_n + 0.5) / (toxic_words + 1)) - math.log((c_n + 0.5) / (clean_words + 1))
        if t >= max(LEAST, SHARE * toxic) and odds >= ODDS and t / toxic > c / max(clean, 1) and surprise(t, t + c, share) >= needed:
            good.append((-round(math.log(t_n * odds) * 10), -len(entry.strip()) - (entry[-1] == " "), entry, odds))
    out: dict[str, float] = {}
    inner: set[str] = set()  # beginnings of the chosen ones
    for _, _, entry, odds in sorted(good):
        if entry not in inner and not any(entry[:k] in out for k in range(1, len(entry))):
            out[entry] = odds
            inner.update(entry[:k] for k in range(1, len(entry) + 1))
    return out


class Matcher:
    """The automaton of entries and exceptions."""

    def __init__(self, entries: dict[str, float], exceptions: list[str] = ()):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for e, w in entries.items():
            self.machine.add_word(e, (len(e), w, e))
        for e in exceptions:
            self.machine.add_word(e, (len(e), None, e))
        self.empty = not entries
        self.machine.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float, str]]:
        """start, end, weight and entry of what is not inside an exception."""
        if self.empty:
            return []
        found, safe = [], []
        for end, (n, w, e) in self.machine.iter(folded):
            if w is None:
                safe.append((end + 1 - n, end + 1))
            else:
                found.append((end + 1 - n, end + 1, w, e))
        if not safe:
            return found
        safe.sort()
        begins, reach = [a for a, _ in safe], np.maximum.accumulate([b for _, b in safe]).tolist()
        return [h for h in found if not (k := bisect_right(begins, h[0])) or reach[k - 1] < h[1]]

    def measures(self, folded: str) -> list[float]:
        total = sum(h[2] for h in self.hits(folded))
        return [1.0, float(total > 0), math.log1p(total), math.log1p(100 * total / (len(folded.split()) + 20))]


def _phrases(folded: str, start: int, end: int) -> list[str]:
    """The hit's whole word with the word before it, and with the word after."""
    word_end = folded.index(" ", max(start + 1, end - 1))
    word = folded[start:word_end].strip()
    before, after = folded[folded.rfind(" ", 0, start) + 1 : start] if start else "", folded[word_end + 1 : folded.find(" ", word_end + 1)] if word_end + 1 < len(folded) else ""
    return [f" {before} {word} "] * bool(before) + [f" {word} {after} "] * bool(after)


class Model:
    def __init__(self, entries: dict[str, float], exceptions: list[str], weights: list[float]):
        self.entries, self.exceptions, self.weights = entries, exceptions, weights

    def scorer(self):
        matcher = Matcher(self.entries, self.exceptions)
        return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(self.weights, matcher.measures(fold(text)), strict=True))))))


def learn(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, sample: int = SAMPLE) -> Model:
    """labels: doc_id, toxic. train_rows: a condition on doc_id; rows that don't meet it are never looked at.

    The labelled rows, ``sample`` at most, are folded and written once; what is learned from them is read from there.
    """
    known = labels.filter(train_rows) if train_rows is not None else labels
    doc_key, bad_key = fresh(docs, 2)
    chosen = known.select(F.col("doc_id").cast("bigint").alias(doc_key), (F.col("toxic") == 1).alias(bad_key)).dropna().distinct().orderBy(F.xxhash64(doc_key), doc_key, bad_key).limit(sample)
    every = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col(doc_key)).select(F.col(doc_key).alias("doc"), F.col("text").cast("string").alias("text"), F.col(bad_key).alias("bad"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([_sketch(t) for t in texts], pa.int64()), pa.array([fold(t) for t in texts], pa.string())], ["doc", "bad", "sketch", "folded"])

    sampled = materialize(every.mapInArrow(folded, "doc bigint, bad boolean, sketch bigint, folded string"), "toxicity-sample")
    first = sampled.groupBy("sketch", "bad").agg(F.min("doc").alias("doc"))  # at most SAMPLE rows
    rows = materialize(sampled.join(F.broadcast(first), ["sketch", "bad", "doc"]).dropDuplicates(["sketch", "bad"]).select("folded", "bad"), "toxicity-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, times = (Counter(), Counter()), (Counter(), Counter())
            for text, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = entries_of(text)
                found[bad].update(own.keys())
                times[bad].update(own)
                found[bad][""] += 1
                times[bad][""] += len(text.split())
            keys = list(found[1].keys() | found[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([x[k] for k in keys], pa.int64()) for x in (found[1], found[0], times[1], times[0]))], ["entry", "t", "c", "t_n", "c_n"])

    counted = rows.mapInArrow(count, "entry string, t bigint, c bigint, t_n bigint, c_n bigint").groupBy("entry").agg(*(F.sum(x).alias(x) for x in ("t", "c", "t_n", "c_n")))
    counted = materialize(counted, "toxicity-counts")
    toxic, clean, toxic_words, clean_words = (counted.filter("entry = ''").select("t", "c", "t_n", "c_n").first() or (0, 0, 0, 0))
    if not toxic or not clean:
        share = min(0.99, max(0.01, toxic / (toxic + clean))) if toxic + clean else 0.5
        discard(sampled, rows, counted)
        return Model({}, [], [math.log(share / (1 - share)), 0.0, 0.0, 0.0])
    # what can't be an entry isn't sent to the driver: rare ones, and those no likelier in toxic rows
    likely = counted.filter((F.col("entry") != "") & (F.col("t") >= max(LEAST, SHARE * toxic)) & (F.log((F.col("t_n") + 0.5) / (toxic_words + 1)) - F.log((F.col("c_n") + 0.5) / (clean_words + 1)) >= ODDS))
    entries = choose_entries([tuple(r) for r in likely.collect()], toxic, clean, toxic_words, clean_words, counted.filter((F.col("entry") != "") & (F.col("t") >= LEAST) & (F.col("t_n") > F.col("c_n") / 4)).count())

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries)
        for b in batches:
            found = {True: Counter(), False: Counter()}
            for text, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[bad].update({p for a, e, _, _ in matcher.hits(text) for p in _phrases(text, a, e)})
            keys = list(found[True].keys() | found[False].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[True][k] for k in keys], pa.int64()), pa.array([found[False][k] for k in keys], pa.int64())], ["entry", "t", "c"])

    seen = rows.mapInArrow(phrases, "entry string, t bigint, c bigint").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    safe = seen.filter((F.col("t") + F.col("c") >= PHRASE_ROWS) & (F.col("t") <= PHRASE_TOXIC * (F.col("t") + F.col("c"))))
    exceptions = sorted(r["entry"] for r in safe.collect())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, exceptions)
        for b in batches:
            m = [matcher.measures(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(m, pa.list_(pa.float64()))], ["bad", "m"])

    got = sorted((r["bad"], r["m"]) for r in rows.mapInArrow(measure, "bad boolean, m array<double>").collect())  # at most SAMPLE
    x, y = np.array([m for _, m in got]), np.array([float(bad) for bad, _ in got])
    discard(sampled, rows, counted)
    return Model(entries, exceptions, fit_logistic(x, y, np.ones(len(y)), ridge=0.5).tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([value(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")
