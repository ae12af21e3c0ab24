"""The same awkward tables for every operator and stage: nulls, empty and long texts, repeats, ties, no rows, clashing names."""

import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from test_dedup import exact_expected, near_expected

import corpus_pipeline
from loamline.llm import exact_dedup, html_text, language_id, near_dup, packing, pii, quality, sentencepiece_fst, toxicity, url_filters

P = pytest.importorskip("public_tokenizers")
WORDS = "the quick brown fox jumps over the lazy dog and runs".split()
LONG = " ".join(f"{w}{i % 97}" for i in range(3000) for w in WORDS)
ROWS = [(1, None), (2, ""), (3, " \n"), (4, LONG), (5, LONG), (6, LONG + " end"), (7, "mail a@b.co now"), (7, "mail a@b.co now"), (8, "a b c d e f"), (9, "a b c d e f"), (10, "x" * 100_000), (None, "no id"), (11, None), (12, "Zonk zonk!")]
CLASH = "_0 int, _1 string, digest string, row int, batch int, kept string, seen int, node int, root int, class_id int, bad int, _n_words int, n_words int, f_symbols int, doc int, sketch int, folded int, bucket int, part int, ids string, key int, place int, start int, spans int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"
EXTRA = tuple("s" if c.endswith("string") else 3 for c in CLASH.split(", "))
PAGES = [(1, "http://a.net/x", "<html lang=de><article><p>Guten Tag</p></article>"), (2, None, None), (3, "", ""), (None, "https://b.example.net/en/", "<p>" + "wort " * 20_000), (4, "http://a.net/x", "<html lang=de><article><p>Guten Tag</p></article>"), (5, "x" * 100_000, "<" * 50_000)]
PAGE_CLASH = "host string, path string, rule int, verdict int, said int, had int, wider int, prior int, logs int, top int, domain int, folder int, declared int, urls int, stack int, best int, text string, pages int, _keep0 int"
PAGE_SCHEMA = f"page_id bigint, url string, html string, {PAGE_CLASH}"
PAGE_EXTRA = tuple("s" if c.endswith("string") else 3 for c in PAGE_CLASH.split(", "))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 8 else "s", None if t is None else len(t), *EXTRA) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 12), int(i == 12), "x") for i in range(2, 13)] + [(None, 1, None, "x"), (4, 0, 1, "x")], "doc_id bigint, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, *PAGE_EXTRA) for r in PAGES], PAGE_SCHEMA)


def test_exact_dedup(docs, none):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs)[0].collect())
    assert got == exact_expected(ROWS)
    kept = exact_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in rows) == sorted((i or 0, len(t or "")) for i, t in {(t or ""): (i, t) for i, t in ROWS if i != 2 and i != 1}.values())
    assert all(tuple(r)[5:] == EXTRA for r in rows) and exact_dedup.drop_repeats(none).count() == 0


def test_near_duplicates(docs, none):
    rows = near_dup.near_duplicates(docs).collect()
    want = near_expected([(i, t) for i, t in ROWS if i not in (None, 7)])
    got = {r.doc_id: (r.class_id, r.text_links, r.links) for r in rows if r.doc_id not in (None, 7)}
    assert got == want and [tuple(r) for r in rows if r.doc_id is None] == [(None, None, 0, 0)]
    assert [tuple(r) for r in rows if r.doc_id == 7] == [(7, 7, 0, 1)] * 2
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 1, 2, 3, 6, 7, 9, 10, 11, 12] and all(tuple(r)[5:] == EXTRA for r in found)
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.one_of_each(none).count() == 0


def test_url_filters(pages, spark):
    rules = url_filters.rule_table(spark)
    got = url_filters.filter_urls(pages, rules, keep=("page_id", "host", "verdict", "stack", "_keep0"))
    assert got.columns == ["page_id", "stack", "_keep0", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == [(0, "b.example.net", "/en/", "example.net/en/", "allow"), (1, "a.net", "/x", "net/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.net", "/x", "net/", "block"), (5, "", "", None, "allow")]
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0


def test_sentencepiece(docs, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r.doc_id, tuple(r.ids)) for r in sentencepiece_fst.encode_rows(docs, path).collect())
    assert got == Counter((i, tuple(library.encode(t or ""))) for i, t in ROWS)
    assert sentencepiece_fst.encode_rows(none, path).count() == 0


def test_toxicity(docs, none, labels):
    model = toxicity.learn(docs, labels)
    score = model.scorer()
    assert Counter((r.doc_id, round(r.score, 12)) for r in toxicity.score(docs, model).collect()) == Counter((i, round(score(t), 12)) for i, t in ROWS)
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.learn(none, labels).scorer()
    assert empty("zonk") == empty(None) == 0.5


def test_extract_text(pages):
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert got[1].text == got[4].text == "Guten Tag" and got[2].text == got[3].text == "" and got[None].text == ("wort " * 20_000).strip()
    assert all(r.n_chars == len(r.text) for r in got.values()) and html_text.extract_text(pages.limit(0)).count() == 0


def test_quality(docs, none, labels):
    got = Counter((r.doc_id, *(r[c] for c in quality.LONG_FIELDS), r.base_failed) for r in quality.judge(docs, labels).collect())
    want = Counter()
    for i, t in ROWS:
        own = quality.statistics(t)[0]
        want[(i, *own, own[0] < 50 or 100 * own[4] > 50 * own[0])] += 1
    assert got == want
    kept = quality.reject_rows(docs, labels)
    assert kept.columns == docs.columns and all(tuple(r)[5:] == EXTRA for r in kept.collect())
    assert quality.reject_rows(none, labels).count() == 0 and quality.judge(none, labels).count() == 0


def test_packing(docs, none):
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path, with_ids=False).collect()
    want = Counter()
    for i, t in ROWS:
        want[i] += len(packing.encode(path, [t or ""])[0]) + 1
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want and packing.pack(none, path).count() == 0


def test_personal_data(docs, none):
    weights = pii.train(docs)
    got = Counter((r.doc_id, r.n_email, r.spans) for r in pii.find_spans(docs, weights).collect())
    assert got == Counter((i, int(i == 7), "email:5:11" if i == 7 else "") for i, t in ROWS)
    masked = pii.redact(docs, weights)
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert tuple(r)[5:] == EXTRA and r.text == ("mail [EMAIL] now" if r.doc_id == 7 else next(t for i, t in ROWS if i == r.doc_id)) and r.n_chars == (None if r.text is None else len(r.text))
    assert pii.find_spans(none).count() == 0 and pii.redact(none).count() == 0


def test_language(pages, docs, spark):
    texts = spark.createDataFrame([(i, "guten tag das ist ein text", "de", *EXTRA) for i in range(5)] + [(9, "good day this is some text", "en", *EXTRA), (None, "tag", "de", *EXTRA), (8, None, "de", *EXTRA), (7, "nothing", None, *EXTRA)], f"doc_id bigint, text string, lang string, {CLASH}")
    got = language_id.identify(pages, texts).collect()
    assert sorted(r.page_id or 0 for r in got) == [0, 1, 2, 3, 4, 5] and {r.lang for r in got if r.page_id in (1, 4)} == {"de"} and all(r.lang in ("de", "en") for r in got)
    assert language_id.identify(pages.limit(0), texts).count() == 0


def test_languages_of_any_number(spark):
    """Eighty languages: nothing in the plan grows with the square of their number."""
    langs = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"]
    texts = spark.createDataFrame([(i, f"{k * 3} {k}a " * 20, k) for i, k in enumerate(langs)], "doc_id bigint, text string, lang string")
    rows = spark.createDataFrame([(i, f"http://{k}.example.com/", f"<p>{k * 3} {k}a {k * 3}") for i, k in enumerate(langs)], "page_id bigint, url string, html string")
    began = time.time()
    got = {r.page_id: r.lang for r in language_id.identify(rows, texts).collect()}
    assert got == dict(enumerate(langs)) and time.time() - began < 75


def test_no_documents_through_the_pipeline(spark, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_documents_through_the_pipeline(spark, docs, labels, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.filter("doc_id IS NULL").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i for i, t in ROWS if t and len(t.split()) >= 50 and 100 * quality.statistics(t)[0][4] <= 50 * quality.statistics(t)[0][0]}
    classes = near_expected([(i, t) for i, t in ROWS if i in kept])
    assert {r.doc_id for r in rows} == {c[0] for c in classes.values()}


MEGABYTE = 1_000_000
AWKWARD = {
    "one letter": "a" * MEGABYTE,
    "digits": "7" * MEGABYTE,
    "letters, one sign": "a" * MEGABYTE + "@1",
    "dashes": "a-" * (MEGABYTE // 2),
    "addresses without end": "a@" * (MEGABYTE // 2),
    "dots": "1." * (MEGABYTE // 2),
    "assignments": "token=" * (MEGABYTE // 6),
    "cues": "token" * (MEGABYTE // 5) + "9",
    "plus signs": "+1-" * (MEGABYTE // 3),
    "exclamations": "x!!!!" * (MEGABYTE // 5),
    "open quotes": '<a "' * (MEGABYTE // 4),
    "open buttons": "<button>" * (MEGABYTE // 8),
    "open tags": "<" * MEGABYTE,
    "stray ends": "<ul><table>" + "<div>" * 50_000 + "</ul>" * 100_000,
    "html tags": "<html " * (MEGABYTE // 6),
    "spaces": " " * MEGABYTE,
    "lines": "\n" * MEGABYTE,
    "entities": "&amp" * (MEGABYTE // 4),
    "base 64": "aB3+/9xQ" * (MEGABYTE // 8),
}


@pytest.mark.parametrize("name", AWKWARD)
def test_long_awkward_texts(name):
    """No operator takes more than time in proportion: a megabyte is done in seconds, whole."""
    text, weights = AWKWARD[name], pii.untrained()
    matcher = toxicity.Matcher({" tok": 1.0, " a ": 1.0}, [" a a "])
    fst, path = sentencepiece_fst.transducer(P.path("piece_bpe_32k.model")), P.path("byte_bpe_50k.json")
    steps = {
        "shingles": lambda: near_dup.shingles(text),
        "encode": lambda: fst.encode(text),
        "fold": lambda: matcher.measures(toxicity.fold(text)),
        "main text": lambda: html_text.main_text(text),
        "statistics": lambda: quality.statistics(text),
        "tokens": lambda: packing.encode(path, [text]),
        "spans": lambda: pii.all_spans(text, weights, pii.base_spans(text)),
        "language": lambda: (language_id.declared_language(text), language_id.trigrams(text)),
    }
    for step, run in steps.items():
        began = time.time()
        run()
        assert time.time() - began < 30, step


# Brute force.


class Article(HTMLParser):
    """The blocks of a page's article by another parser: nothing but the elements' nesting decides."""

    BREAKS = frozenset("p div br h1 h2 h3 li ul ol article section blockquote tr td table pre figure".split())
    DROPPED = frozenset("script style nav aside form footer header".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.dropped = 0
        self.blocks = [[]]

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "input", "img", "hr", "meta", "link"):
            self.blocks.append([])
            return
        if tag in self.BREAKS:
            self.blocks.append([])
        self.inside += tag == "article"
        if self.dropped or self.inside and (tag in self.DROPPED or tag == "div" and dict(attrs).get("class")):
            self.dropped += tag in self.DROPPED or tag == "div"

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.blocks.append([])
        if self.dropped and (tag in self.DROPPED or tag == "div"):
            self.dropped -= 1
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside > 0 and not self.dropped:
            self.blocks[-1].append(data)


def test_main_texts_by_another_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract_text(pages).collect():
        other = Article()
        other.feed(html[r.page_id])
        blocks = [" ".join("".join(b).split()) for b in other.blocks]
        assert r.text == " ".join(b for b in blocks if b)


def test_windows_decide_every_page(spark, sf_dir, monkeypatch):
    page = spark.read.parquet(f"{sf_dir}/pages.parquet").first().html
    assert html_text.main_text(page)
    monkeypatch.setattr(html_text, "surge_and_dive", lambda heavy: [False] * len(heavy))
    assert html_text.main_text(page) == ""


def test_text_beside_an_article():
    """What lies outside of an article is text only where it surges by far; short lines inside are kept."""
    page = "<p>Short before.</p><article><p>One.</p><p>Two.</p><ul><li><a href=/>Three</a></li></ul></article><p>Short after.</p><p>{}</p>"
    assert html_text.main_text(page.format("word " * 40)) == "One. Two. Three"
    assert html_text.main_text(page.format("word " * 2000)).endswith("word")


def test_scores_by_plain_search(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables hold too few toxic rows for an entry
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels)
    assert model.entries
    texts = {r.doc_id: r.text for r in docs.collect()}

    def places(folded, what):
        at = folded.find(what)
        while at >= 0:
            yield at, at + len(what)
            at = folded.find(what, at + 1)

    for r in toxicity.score(docs, model).collect():
        folded = toxicity.fold(texts[r.doc_id])
        safe = [p for e in model.exceptions for p in places(folded, e)]
        total = sum(w for e, w in model.entries.items() for a, b in places(folded, e) if not any(c <= a and b <= d for c, d in safe))
        x = [1.0, float(total > 0), np.log1p(total), np.log1p(100 * total / (len(folded.split()) + 20))]
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(np.dot(model.weights, x), -30, 30))), abs=1e-9)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, least, most in (("card", CARD, 12, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if least <= len(digits) <= most and (kind == "phone" or pii.luhn(digits)):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_spans_by_plain_patterns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, weights = {r.doc_id: r.text for r in docs.collect()}, pii.train(docs)
    for r in pii.find_spans(docs, weights).collect():
        text = texts[r.doc_id] or ""
        found = plain_base(text)
        assert r.base == pii.joined(found) and r.n_email == sum(k == "email" for _, _, k in found)
        for a, b, kind, form in pii.candidates(text):
            score = np.dot(weights, pii.features(kind, form, pii.votes(text, a, b, kind, form), b - a))
            if score >= 0 and not any(a < e and s < b for s, e, _ in found):
                found.append((a, b, kind))
        assert r.spans == pii.joined(sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2]))))


def test_base_spans_of_random_texts():
    import random

    rnd = random.Random(1)
    for _ in range(30_000):
        text = "".join(rnd.choice(["a", "b", "@", ".", "1", "2", "0", "-", "+", " ", "(", ")", "4", "é", "_", "256", "4111", "1111", "@a.b"]) for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain_base(text), text


def test_languages_by_plain_loops(spark, sf_dir):
    pages, docs = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, table = language_id.learn_trigrams(docs)
    plain = np.full(table.shape, 0.5)
    for r in docs.collect():  # fewer than the sample
        np.add.at(plain[langs.index(r.lang)], language_id.trigrams(r.text), 1)
    assert np.allclose(table, np.log(plain / plain.sum(axis=1, keepdims=True)))
    rows = []
    for r in pages.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.split("[/?#]", rest)[0].lower()
        path = re.split("[?#]", rest[len(host) :])[0]
        parts = host.split(".")
        keep = 3 if len(parts) > 2 and len(parts[-2]) <= 3 else 2
        folder = re.match(r"/([A-Za-z]{2})(/|$)", path)
        logs = language_id.text_evidence(html_text.main_text(r.html), table)
        said = np.exp(logs - logs.max())
        rows.append((r.page_id, host, ".".join(parts[-keep:]), parts[-1], language_id.declared_language(r.html), folder.group(1).lower() if folder else None, logs, said / said.sum()))

    def share(had, wider):
        return (had + language_id.SMOOTH * wider) / (had.sum() + language_id.SMOOTH)

    def trust(clue):
        known = lambda v: 0 if v is None else 2 + langs.index(v) if v in langs else 1
        count = np.full((len(langs) + 2, len(langs)), 0.5)
        for r in rows:
            count[known(r[clue])] += r[7]
        for i in range(len(langs)):
            count[2 + i, i] += 2
        chances = np.log(count / count.sum(axis=0))
        return lambda v: chances[known(v)]

    trusts = [(4, trust(4)), (5, trust(5)), (3, trust(3))]
    base = 1 + sum(r[7] for r in rows)
    base /= base.sum()
    got = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    for page_id, host, domain, top, _, _, logs, said in rows:
        prior = base
        for k, v in ((3, top), (2, domain)):
            prior = share(sum(r[7] for r in rows if r[k] == v and (k == 3 or r[3] == top)), prior)
        own = sum(r[7] for r in rows if r[1] == host) - said
        prior = share(np.maximum(own, 0), prior)
        total = logs + np.log(np.maximum(prior, 1e-6)) + sum(f(r[k]) for r in [next(r for r in rows if r[0] == page_id)] for k, f in trusts)
        post = np.exp(total - total.max())
        post /= post.sum()
        assert got[page_id].lang == langs[int(post.argmax())] and got[page_id].probability == pytest.approx(post.max(), abs=1e-6)
        assert got[page_id].host == host and got[page_id].text_lang == langs[int(said.argmax())]
