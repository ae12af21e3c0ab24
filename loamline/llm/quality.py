"""Quality rules: text statistics, and decision lists learned from labelled statistics.

Statistics are computed for every whole text. The list is learned by sequential covering: a conjunction of thresholds is
grown on one part of the labelled rows by information gain, pruned on the other part, and kept if it is precise enough
there; the rows it covers are taken away and the next one is grown. What comes out is an ordered list of conjunctions,
emitted as one Spark conditional expression, so that the verdicts are computed inside the JVM.

Learning takes a bounded sample of labelled rows (``SAMPLE``, by hash of the id); rules and conditions are as many as pass their
tests. Defined results: null and empty texts have no words and fail the base rule; texts are counted whole; with no or one-sided labels
the list is empty and only the base rule rejects; a document labelled both ways counts as both; of conditions with equal
gain the one on the feature listed first, at most before at least, with the lower threshold, is taken;
repeated rows are each judged; an empty table gives no rows; other columns, whatever their names, stay untouched in ``reject_rows``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Labelled rows used for learning, at most.
SAMPLE = 20_000
#: A rule needs this precision and so many covered rows in its pruning part.
PRECISION, SUPPORT = 0.9, 5

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
LONG_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "distinct", "line_words", "ended", "lone_symbols", "top_word")
STATS_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in LONG_FIELDS) + ", " + ", ".join(f"f_{c} double" for c in FEATURES)


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    k = int(ids.max()) + 1
    pairs = ids[:-1] * k + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, which, count = np.unique(pairs[:-1].astype(np.int64) * k + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    if not twice.any():
        return 0
    inside = np.zeros(n, dtype=bool)
    for j in range(3):
        inside[j : n - 2 + j] |= twice
    return int(inside.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    text = text or ""
    words = WORD.findall(text)
    n, known = len(words), {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    chars, repeats, seen, dups, lines, ended = sum(map(len, words)), repeated_words(ids), set(), 0, 0, 0
    for line in text.split("\n"):
        bare = line.strip("\x20\x09\x0a\x0b\x0c\x0d")
        if bare:
            lines += 1
            dups += line in seen
            seen.add(line)
            ended += bare[-1] in ".!?…:;\"'»”"
    symbols = len(SYMBOL.findall(text))
    per = 1 / max(n, 1)
    top = float(np.bincount(ids).max()) if n else 0.0
    values = [float(n), chars * per, symbols * per, dups / max(lines, 1), repeats * per, len(UPPER.findall(text)) / max(chars, 1), len(known) * per, n / max(lines, 1), ended / max(lines, 1), sum(map(words.count, "|#*")) * per if symbols else 0.0, top * per]
    return [n, chars, symbols, dups, repeats], values


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t) for t in b.column(1).to_pylist()]
            longs = [pa.array([s[0][i] for s in stats], pa.int64()) for i in range(len(LONG_FIELDS))]
            doubles = [pa.array([s[1][i] for s in stats], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, *doubles], ["doc_id", *LONG_FIELDS, *(f"f_{c}" for c in FEATURES)])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, STATS_SCHEMA)


def base_failed(mark: str = "") -> Column:
    words = F.col(f"{mark}n_words")
    return (words < 50) | (100 * F.col(f"{mark}n_repeat_words") > 50 * words)


Rule = list[tuple[int, bool, float]]  # feature, whether at least (else at most), threshold


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for f, least, v in rule:
        hit &= x[:, f] >= v if least else x[:, f] <= v
    return hit


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    rule: Rule = []
    inside = np.ones(len(x), dtype=bool)
    while True:  # each condition leaves fewer rows
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        if not p or not n:
            break
        had, best, gain = np.log2(p / (p + n)), None, 1e-9
        xi, yi = x[inside], y[inside]
        for f in range(x.shape[1]):
            order = np.argsort(xi[:, f], kind="stable")
            v, good = xi[order, f], yi[order]
            cum_p, cum_n = np.cumsum(good), np.cumsum(~good)
            cuts = np.flatnonzero(np.diff(v) > 0)
            for least in (False, True):
                ps, ns = (p - cum_p[cuts], n - cum_n[cuts]) if least else (cum_p[cuts], cum_n[cuts])
                ok = ps > 0
                if not ok.any():
                    continue
                g = np.where(ok, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - had), 0)
                i = int(np.argmax(g))
                if g[i] > gain:
                    gain, best = g[i], (f, least, float((v[cuts[i]] + v[cuts[i] + 1]) / 2))
        if not best:
            break
        rule.append(best)
        inside &= covers([best], x)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        hit = covers(r, x)
        p, n = int(y[hit].sum()), int((~y[hit]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn_list(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Ordered conjunctions for y (rejected rows). x: rows by features; rows in an order that says nothing."""
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    while y[left & ~part].any():  # each rule takes rows away
        grow, prune = left & ~part, left & part
        rule = _grow(x[grow], y[grow])
        if not rule:
            break
        rule = _prune(rule, x[prune], y[prune])
        hit = covers(rule, x)
        p, n = int(y[hit & prune].sum()), int((hit & prune).sum())
        if n < SUPPORT or p / n < PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule], mark: str = "") -> Column:
    """The list as one conditional: whether a row is kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        cond = F.lit(True)
        for f, least, v in rule:
            c = F.col(f"{mark}f_{FEATURES[f]}")
            cond = cond & (c >= F.lit(v) if least else c <= F.lit(v))
        out = F.when(cond, False).otherwise(out)
    return out


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from at most ``sample`` labelled rows (doc_id, quality: 0 is rejected)."""
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 0).alias("bad")).dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = text_statistics(texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")).join(F.broadcast(chosen), "doc_id")
    values = [f"f_{c}" for c in FEATURES]
    # rows of one document that say the same count once
    got = found.filter(~base_failed()).select("doc_id", "bad", *values).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "bad", *values).limit(2 * sample).collect()
    if not got:
        return []
    x = np.array([r[2:] for r in got], dtype=float)
    y = np.array([r[1] for r in got], dtype=bool)
    return learn_list(x, y)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed and kept of every row."""
    rules = learn_rules(docs, labels)
    return text_statistics(docs).select("doc_id", *LONG_FIELDS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def reject_rows(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that are rejected; all columns stay as they are, whatever their names."""
    rules = learn_rules(docs, labels)
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name clashes with those of the statistics
    at, names = docs.columns.index(text_col), [*LONG_FIELDS, *(f"f_{c}" for c in FEATURES)]
    schema = StructType([*own.schema.fields, *(StructField(f"_{c}", DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [[*s[0], *s[1]] for s in map(statistics, b.column(at).to_pylist())]
            columns = [pa.array([float(s[i]) for s in stats], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *(f"_{c}" for c in names)])

    judged = own.mapInArrow(run, schema).filter(~base_failed("_") & verdict(rules, "_"))
    return judged.select(*own.columns).toDF(*docs.columns)
