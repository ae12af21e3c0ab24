"""Personal data by aggregation of weak labelers.

Candidates come from patterns. Each candidate is voted on by labelers of three sorts: patterns (formats and checksums),
gazetteers (key names, vendor prefixes, given names) and context (words before it, the look of its characters).
Expectation-maximisation over the votes of all candidates, counted by equal votes, estimates how far each labeler can be trusted,
without any true labels; its posteriors then train a logistic classifier on features of the span, which decides about
every candidate. The four base kinds (email, ip, card, phone) are facts of a format and always stay; the classifier
decides about the other kinds: secret, ssn, iban, mac, ipv6, name.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive, of any length, and are found in
time that grows with the text's length; of candidates that overlap the one listed first stays (base kinds, then the order
of candidates); a score of exactly 0 adds the span; repeated rows each get their spans; an empty table gives no rows and
trains to the untrained weights; other columns, whatever their names, aren't read by ``find_spans`` and stay as they are in ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban", "mac", "ipv6", "name")

# The base patterns, and what labelers look for. None of them goes back over a text more than once: runs of
# characters are possessive, and an address is looked for from its @, a number from its first digit.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MORE = {
    "secret": re.compile(r"\b(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{12,}+)\b|\b(?P<git>gh[pousr]_[A-Za-z0-9]{20,}+|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}+|AIza[A-Za-z0-9_-]{30,})\b|\b(?P<hex>[0-9a-f]{32,}+)\b"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"),
    "mac": re.compile(r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b"),
    "ipv6": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra?)\.? [A-ZÀ-Þ][a-zß-ÿ]++(?: [A-ZÀ-Þ][a-zß-ÿ]++){0,2}"),
}
#: A value that is given to something, from the sign on; and names of things that hold secrets.
GIVEN_VALUE = re.compile(r"[:=]\s{0,3}[\"']?(?P<key>[^\s\"',;]{6,}+)")
CUE = re.compile(r"(?i)passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth")
NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-"
HINTS = {
    "secret": "password passwort passwd pwd secret token key apikey api_key credential credentials login contraseña clave motdepasse auth",
    "ssn": "ssn social security tax id",
    "iban": "iban account bank konto compte cuenta bic",
    "mac": "mac hardware device ethernet adapter address",
    "ipv6": "ip ipv6 address host server",
    "name": "name named called dear sincerely contact author by from",
}
HINTS = {k: frozenset(v.split()) for k, v in HINTS.items()}
GIVEN = frozenset(
    (
        "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Timothy Stephanie Ronald Rebecca Jason Sharon Edward Laura Jeffrey Cynthia Ryan Kathleen Jacob Amy Gary Angela "
        "Anna Maria Peter Hans Klaus Ursula Jürgen Sabine Wolfgang Monika Heinz Petra Uwe Renate Dieter Helga Manfred Karin Günter Brigitte Horst Ingrid Bernd Erika Frank Andrea Stefan Claudia Matthias Gisela Andreas Susanne Markus Birgit Ralf Heike Sebastian Katrin Tobias Julia "
        "Jean Marie Pierre Michel Nathalie Philippe Isabelle Alain Sylvie Patrick Catherine Nicolas Martine Christophe Christine Laurent Françoise Sébastien Valérie Julien Sandrine Frédéric Véronique Stéphane Céline Olivier Chantal Thierry Sophie Jacques Monique Antoine Camille Mathieu Aurélie "
        "José Carmen Antonio Juan Francisco Ana Luis Carlos Isabel Manuel Dolores Javier Pilar Miguel Teresa Ángel Rosa Rafael Josefa Fernando Cristina Sergio Elena Alberto Lucía Alejandro Mercedes Jorge Raquel Diego Beatriz Pablo Rocío Ramón Marta Enrique Alicia Andrés"
    ).split()
)

_NEAR = re.compile(r"[^\W\d]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind by start, then kind as listed."""
    out: list[tuple[int, int, str]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        part = text[done:at]  # no part of a local name lies before the @ before this one, or inside the address before
        begin = done + len(part.rstrip(LOCAL))
        done, m = at + 1, HOST.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end(), "email"))
            done = m.end()
        at = text.find("@", done)
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = "".join(_DIGIT.findall(m.group()))
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def given_values(text: str) -> Iterator[tuple[int, int]]:
    """Values that follow a sign of assignment after the name of something that holds secrets."""
    done, m = 0, GIVEN_VALUE.search(text)
    while m:
        # the name ends at the sign, but for up to three spaces and a quote, and begins after the sign before
        name = text[done : m.start()]
        bare = name.rstrip()
        named = bare[:-1] if bare.endswith(("'", '"')) else bare
        if len(name) - len(bare) <= 3 and CUE.search(named[len(named.rstrip(NAME)) :]):
            yield m.span("key")
            done = m.end()
        else:
            done = m.start() + 1
        m = GIVEN_VALUE.search(text, done)


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and form of every candidate of the kinds beyond the base."""
    out = []
    digits = bool(_DIGIT.search(text))
    if CUE.search(text):
        out += [(a, b, "secret", "key") for a, b in given_values(text)]
    for kind, pattern in MORE.items():
        if kind != "name" and not digits:
            continue
        for m in pattern.finditer(text):
            form = m.lastgroup or kind
            if form != "hex" or _DIGIT.search(m.group()) and not m.group().isdecimal():
                out.append((*m.span(), kind, form))
    return out


#: The labelers: a vote of 1 for personal, 0 against, -1 for none.
LABELERS = ("format", "checksum", "gazetteer", "context", "entropy", "mixture", "length")


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, a: int, b: int, kind: str, form: str) -> list[int]:
    span, near = text[a:b], [w.lower() for w in _NEAR.findall(text[max(0, a - 60) : a])[-6:]]
    out = [-1] * len(LABELERS)
    if form in ("aws", "git", "mac", "ipv6", "ssn"):
        out[0] = 1
    elif form == "key":
        out[0] = 1 if re.search(r"\d", span) else 0
    if kind == "iban":
        out[1] = int(iban_ok(span))
    elif kind == "ssn":
        out[1] = int(span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000")
    if kind == "name":
        out[2] = 1 if any(w in GIVEN for w in span.split()) else -1
    elif kind == "secret":
        out[2] = 1 if form in ("key", "aws", "git") else -1
    hit = any(any(w == h or len(h) > 4 and h in w for h in HINTS[kind]) for w in near)
    out[3] = 1 if hit else -1 if kind == "name" else (-1 if form in ("aws", "git") else 0)
    if kind == "secret":
        p = np.array(list(Counter(span).values())) / len(span)
        bits = float(-(p * np.log2(p)).sum())
        out[4] = 1 if bits >= 3 else 0 if bits < 2.3 else -1
        sorts = sum(bool(re.search(x, span)) for x in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^\w]"))
        out[5] = 1 if sorts >= 2 else 0
        out[6] = 1 if len(span) >= 12 else -1 if len(span) >= 8 else 0
    elif kind == "name":
        out[5] = 1 if len(span.split()) >= 2 else 0
    return out


def features(kind: str, form: str, vote: list[int], length: int) -> list[float]:
    return [1.0, *[float(v == 1) - float(v == 0) for v in vote], *[float(kind == k) for k in KINDS[len(BASE) :]], float(form == "hex"), min(length, 80) / 40]


def label_model(table: np.ndarray, n: np.ndarray | None = None, prior: float = 0.7, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for labelers that vote independently given the truth. Returns posteriors, and each labeler's rate of votes for,
    given yes and given no. Row i of the table stands for n[i] candidates (1 by default). Smoothing pulls toward labelers that are right more often than not."""
    yes, cast = (table == 1).astype(float), (table >= 0).astype(float)
    hit, false, share = np.full(table.shape[1], 0.8), np.full(table.shape[1], 0.2), prior
    post = np.full(len(table), prior)
    n = np.ones(len(table)) if n is None else n.astype(float)
    for _ in range(rounds):
        up = yes @ np.log(hit) + (cast - yes) @ np.log(1 - hit) + math.log(share)
        down = yes @ np.log(false) + (cast - yes) @ np.log(1 - false) + math.log(1 - share)
        new = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
        up, down = n * new, n * (1 - new)
        hit = (up @ yes + 8) / (up @ cast + 10)
        false = (down @ yes + 2) / (down @ cast + 10)
        hit, false = np.maximum(hit, 0.5), np.minimum(false, 0.5)
        share = float((up.sum() + 7) / (n.sum() + 10))
        done, post = np.abs(new - post).max(initial=0) < 1e-6, new
        if done:
            break
    return post, hit, false


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge * (w @ w) / 2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w)), grad)
        while loss(w + step) > loss(w) and np.abs(step).max() >= 1e-8:  # large counts can make a whole step too long
            step /= 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Used where there are no candidates; the same form as a trained one.
def untrained() -> np.ndarray:
    n = len(features("secret", "key", [-1] * len(LABELERS), 0))
    w = np.zeros(n)
    w[1 : 1 + len(LABELERS)] = 1.0
    return w


def train(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier, from all rows. Equal votes are counted together before they are sent to the
    driver: forms, votes and lengths up to 80 have some thousands of values together, whatever the input's size."""
    rows = docs.select(F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for t in b.column(0).to_pylist():
                for a, e, kind, form in candidates(t or ""):
                    found[(kind, form, ",".join(map(str, votes(t, a, e, kind, form))), min(80, e - a))] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array([k[2] for k in found], pa.string()), pa.array([k[3] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["kind", "form", "votes", "length", "n"])

    counted = rows.mapInArrow(run, "kind string, form string, votes string, length bigint, n bigint").groupBy("kind", "form", "votes", "length").agg(F.sum("n").alias("n"))
    got = counted.orderBy("kind", "form", "votes", "length").collect()
    if not got:
        return untrained()
    table = np.array([[int(v) for v in r["votes"].split(",")] for r in got])
    n = np.array([r["n"] for r in got], dtype=float)
    post, _, _ = label_model(table, n)
    x = np.array([features(r["kind"], r["form"], [int(v) for v in r["votes"].split(",")], r["length"]) for r in got])
    return fit_logistic(x, post, n)


def all_spans(text: str, weights: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Base spans and the spans that the classifier adds; what overlaps a span already there isn't added."""
    out, begins, ends = list(base), [], []
    for a, b, _ in base:  # what is taken, without overlaps, by start
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    for a, b, kind, form in candidates(text):
        at = bisect_right(ends, a)  # the first that ends after a
        if at < len(begins) and begins[at] < b:
            continue
        if float(np.dot(weights, features(kind, form, votes(text, a, b, kind, form), b - a))) >= 0:
            out.append((a, b, kind))
            begins.insert(at, a)
            ends.insert(at, b)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_spans(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, number of each base kind, base (the base spans, joined) and spans (all of them) of every row."""
    w = train(docs) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base = base_spans(t or "")
                count = Counter(k for _, _, k in base)
                rows.append([*(count[k] for k in BASE), joined(base), joined(all_spans(t or "", w, base))])
            kinds = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *kinds, pa.array([r[4] for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind; spans that overlap are masked together under the first one's kind."""
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """docs with personal data in text masked; n_chars, where there is one, follows. Nulls stay null."""
    w = train(docs) if weights is None else weights
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [None if t is None else masked(t, all_spans(t, w, base_spans(t))) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if count is not None:
                had = columns[count].to_pylist()
                columns[count] = pa.array([h if t == n or n is None else len(n) for h, t, n in zip(had, old, new, strict=True)], b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
