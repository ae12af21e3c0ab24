"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence about a page's language are combined as if independent given the language: the likelihood of its
text under character trigrams (tempered, since trigrams of a text aren't independent), the language its markup declares,
the languages its address suggests (top-level domain, first directory of the path), and a prior from the other pages of
its host. How far declarations and addresses can be trusted is estimated from the pages themselves, by grouped counts of
what texts say against what is declared. Host priors are smoothed toward the registered domain's, those toward the
top-level domain's, and those toward all pages'; a page never counts in its own prior.

The trigram model is learned from a sample of labelled documents, bounded for each language (``SAMPLE``, by hash of the
id), so that no language is missing. Defined results: pages without text are judged by the other evidence, long ones by their whole
text; without a url the prior is that of the other pages without one; without any
labelled document there are no languages and every page gets null; of equally likely languages the first in the alphabet is named;
repeated rows are each judged; nulls count as missing; an empty table of pages gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_uneven, materialize
from .html_text import RAW, Scanner, main_text
from .url_filters import host_of, path_of

#: Labelled documents of a language for the trigram model (about, where it has more), buckets for trigrams.
SAMPLE, BUCKETS = 8_000, 1 << 14
#: A text of n trigrams counts like this many independent ones at most.
INDEPENDENT = 40.0
#: Pages of the wider group that count in a narrower one's prior.
SMOOTH = 5.0

_LETTERS = re.compile(r"[^\W\d_]+")
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z]{2,3})", re.I)


def declared_language(page: str | None) -> str | None:
    """What the page's first html tag with a language says, wherever it stands."""
    scanner = Scanner(page or "")
    for _, tag, closing, attrs in scanner:
        if closing:
            continue
        if tag == "html" and (m := _LANG.search(attrs)):
            return m.group(1).lower()
        if tag in RAW and not attrs.rstrip().endswith("/") and not scanner.skip(tag) and tag not in ("option", "button", "object"):
            return None
    return None


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the character trigrams of a text's words."""
    words = _LETTERS.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(f"  {' '.join(words)} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return ((h * np.uint64(0x27D4EB2F) >> np.uint64(15)) % np.uint64(BUCKETS)).astype(np.int64)


def learn_trigrams(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and logarithms of their trigram chances, from documents (doc_id, text, lang)."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = given.filter("lang IS NOT NULL")
    rates = labelled.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("rate"))  # as many as languages
    place = F.pmod(F.xxhash64(F.coalesce("doc", F.xxhash64("text"))), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.join(F.broadcast(rates), "lang").filter(place < F.col("rate")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_bucket = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("n"))  # at most BUCKETS of each
    got = sorted(by_bucket.collect(), key=lambda r: r["lang"])
    table = np.full((len(got), BUCKETS), 0.5)
    for i, r in enumerate(got):
        for bucket, n in r["n"]:
            table[i, bucket] += n
    return [r["lang"] for r in got], np.log(table / table.sum(axis=1, keepdims=True)) if got else table


def text_evidence(text: str, table: np.ndarray) -> np.ndarray:
    """Tempered log-likelihoods of a text, the best one 0."""
    t = trigrams(text)
    if not len(t) or not len(table):
        return np.zeros(len(table))
    logs = table[:, t].mean(axis=1) * min(float(len(t)), INDEPENDENT)
    return logs - logs.max()


def posterior(logs: np.ndarray) -> np.ndarray:
    """Rows of chances from rows of logarithms that may lack a constant."""
    likely = np.exp(logs - logs.max(axis=1, keepdims=True))
    return likely / likely.sum(axis=1, keepdims=True)


def _sums(n: int, own: str) -> list[Column]:
    return [F.sum(F.get(F.col(own), F.lit(i))).alias(f"s{i}") for i in range(n)]


def _array(n: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(n)])


def _lists(column: pa.Array, n: int) -> np.ndarray:
    """An array column as a matrix; rows without a value become zeros."""
    return np.array([v if v is not None else [0.0] * n for v in column.to_pylist()], dtype=float).reshape(-1, n)


def _trust(rows: DataFrame, column: str, langs: list[str]) -> np.ndarray:
    """For each value of a clue (none, another, each language) the logarithms of its chance given each language, from what texts say."""
    known = F.when(F.col(column).isNull(), F.lit("")).when(F.array_contains(F.array(*[F.lit(x) for x in langs]), F.col(column)), F.col(column)).otherwise(F.lit("?"))
    got = {r["v"]: [r[f"s{i}"] or 0.0 for i in range(len(langs))] for r in rows.groupBy(known.alias("v")).agg(*_sums(len(langs), "said")).collect()}  # as many as languages, and two
    values = ["", "?", *langs]
    count = np.array([got.get(v, [0.0] * len(langs)) for v in values]) + 0.5
    for i in range(len(langs)):
        count[2 + i, i] += 2  # a clue more likely tells the truth
    return np.log(count / count.sum(axis=0, keepdims=True))


CLUES = ("declared", "folder", "top")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, lang (null without languages), probability, and text_lang (by text alone) of every page."""
    langs, table = learn_trigrams(docs)
    n = len(langs)
    needed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if not n:
        empty = F.lit(None).cast("string")
        return needed.select("page_id", host_of(F.col("url")).alias("host"), empty.alias("declared"), empty.alias("lang"), F.lit(None).cast("double").alias("probability"), empty.alias("text_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                html = b.column(2).to_pylist()
                logs = np.array([text_evidence(main_text(page), table) for page in html])
                lists = [pa.array(list(m), pa.list_(pa.float64())) for m in (logs, posterior(logs))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(declared_language, html), pa.string()), *lists], ["page_id", "url", "declared", "logs", "said"])

    rows = needed.mapInArrow(run, "page_id bigint, url string, declared string, logs array<double>, said array<double>")
    labels = F.split("host", r"\.")
    size = F.size(labels)
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.select("page_id", "host", "declared", "logs", "said", F.nullif(ascii_lower(F.regexp_extract("path", r"^/([A-Za-z]{2})(?:/|$)", 1)), F.lit("")).alias("folder"), F.element_at(labels, -1).alias("top"), F.when(size > 1, F.array_join(F.slice(labels, F.greatest(size - F.when((size > 2) & (F.length(F.element_at(labels, -2)) <= 3), 2).otherwise(1), F.lit(1)), size), ".")).otherwise(F.col("host")).alias("domain"))
    rows = materialize(rows, "page-evidence")
    total = rows.count()
    trust = [_trust(rows, c, langs) for c in CLUES]

    # Sums of posteriors: all pages, top-level domains, domains, hosts.
    hosts = rows.groupBy("host", "domain", "top").agg(F.count(F.lit(1)).alias("pages"), *_sums(n, "said"))
    hosts = materialize(hosts.select("host", "domain", "top", "pages", _array(n).alias("had")), "hosts")

    def summed(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("below"), *_sums(n, "had")).select(*keys, "below", _array(n).alias("had"))

    domains = materialize(summed(hosts, "domain", "top"), "domains")
    tops = materialize(summed(domains, "top"), "tops")
    whole = np.array([r or 0.0 for r in tops.agg(*_sums(n, "had")).first()]) + 1.0
    base = F.array(*[F.lit(float(x)) for x in whole / whole.sum()])

    def share(had: Column, wider: Column) -> Column:
        size = F.aggregate(had, F.lit(0.0), lambda a, x: a + x) + F.lit(SMOOTH)
        return F.transform(F.zip_with(had, wider, lambda h, w: h + F.lit(SMOOTH) * w), lambda x: x / size)

    top_prior = tops.select("top", "below", share(F.col("had"), base).alias("prior"))
    domain_prior = join_uneven(domains.select("domain", "top", F.col("below").alias("hosts"), "had"), top_prior, "top", "below", max(1, domains.count()))
    domain_prior = materialize(domain_prior.select("domain", "hosts", share(F.col("had"), F.col("prior")).alias("prior")), "domain-priors")
    host_prior = join_uneven(hosts, domain_prior, "domain", "hosts", max(1, hosts.count())).select("host", "pages", "had", F.col("prior").alias("wider"))
    evidence = join_uneven(rows, host_prior, "host", "pages", total).select("page_id", "host", *CLUES, "logs", "said", "had", "wider")
    at = {lang: 2 + i for i, lang in enumerate(langs)}

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            logs, said, had, wider = (_lists(b.column(c), n) for c in ("logs", "said", "had", "wider"))
            others = np.maximum(had - said, 0.0)  # the page itself doesn't count in its prior
            logs = logs + np.log(np.maximum((others + SMOOTH * wider) / (others.sum(axis=1, keepdims=True) + SMOOTH), 1e-6))
            for clue, chances in zip(CLUES, trust, strict=True):
                logs += chances[[0 if v is None else at.get(v, 1) for v in b.column(clue).to_pylist()]]
            post = posterior(logs)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("declared"), pa.array([langs[i] for i in post.argmax(axis=1)], pa.string()), pa.array(np.round(post.max(axis=1), 9)), pa.array([langs[i] for i in said.argmax(axis=1)], pa.string())], ["page_id", "host", "declared", "lang", "probability", "text_lang"])

    return evidence.mapInArrow(fuse, "page_id bigint, host string, declared string, lang string, probability double, text_lang string")
