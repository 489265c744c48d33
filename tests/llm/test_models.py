import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qanat.llm import html, language_id, toxicity, urls
from qanat.llm.ftrl import Ftrl
from qanat.llm.queries import URL_RULES


def test_languages_held_out(spark, documents, docs_of):
    found = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score"), F.count("*")).head()
    assert right[0] > 0.97 and right[1] >= 0 and right[2] <= 1 and right[3] == documents.count()
    held = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0]
    assert held > 0.95


def test_language_cases(docs_of, documents):
    odd = docs_of([(1000, None), (1001, ""), (1002, "12 34 !?"), (None, "the and of")])
    got = {r["doc_id"]: r for r in language_id.identify(documents.unionByName(odd)).filter("doc_id is null or doc_id >= 1000").collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002)) and got[None]["lang_pred"] != "und"
    alone = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in alone} == {"und"} and language_id.identify(odd.limit(0)).count() == 0


def test_language_never_reads_held_out_labels(documents):
    wrong = documents.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = (sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(d).collect()) for d in (documents, wrong))
    assert a == b


def toxic_table(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, 40))
        bad = i % 4 == 0
        if bad:
            for _ in range(int(rng.integers(2, 9))):
                text[int(rng.integers(40))] = str(rng.choice(["vilestuff", "vilething", "grosso"]))
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    from tests.llm.conftest import DOCS

    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_table(spark)
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels.filter("doc_id < 300")).collect()}
    unseen = [found[i] for i in range(300, 400)]
    assert sum(r["toxic"] == (r["doc_id"] % 4 == 0) for r in unseen) >= 98
    assert all(0 <= r["severity"] <= 3 and r["grade"] in range(4) for r in found.values())
    few, many = (docs.sparkSession.createDataFrame([(1, "w1 " * 30 + "grosso " * 1), (2, "w1 w2 vilestuff vilething grosso")], "doc_id long, text string"), None)
    s = {r["doc_id"]: r["severity"] for r in toxicity.toxicity(few, labels.limit(0)).collect()}
    assert s == {1: 0.0, 2: 0.0} and many is None
    stay = toxicity.clean_rows(docs, labels)
    assert stay.columns == docs.columns and 290 <= stay.count() <= 310


def test_toxicity_cases(spark, docs_of):
    docs, labels = toxic_table(spark)
    odd = docs_of([(1000, None), (1001, ""), (None, "w1 w2"), (1002, "grosso vilestuff " * 5000), (1003, "w3"), (1003, "w3")]).withColumnRenamed("lang", "toxic").withColumnRenamed("source", "severity")
    model = toxicity.train(docs, labels.unionByName(labels.filter("doc_id = 4")))
    got = {r["doc_id"]: r["_toxic"] for r in toxicity.score(odd, model).collect()}
    assert got == {1000: False, 1001: False, None: False, 1002: True, 1003: False}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_texts_without_words_are_clean_at_any_cut(spark, docs_of):
    w = np.zeros(toxicity.FEATURES, np.float32)
    odd = docs_of([(1, None), (2, ""), (3, "12 ?!"), (4, "word"), (5, "\u0301 1")])
    got = {r["doc_id"]: (r["_toxic"], r["_severity"] > 0, r["_grade"]) for r in toxicity.score(odd, (w, np.array([-3.0, -2.0, -1.0]), -2.5)).collect()}
    assert got == {1: (False, False, 0), 2: (False, False, 0), 3: (False, False, 0), 4: (True, True, 3), 5: (True, True, 3)}


def test_the_cut_covers_all_labelled_rows():
    bins = np.array([-200, -100, -50, 30, 40, 90])
    assert toxicity.set_cut(bins, np.array([0, 0, 0, 1, 1, 1]), np.array([5, 5, 5, 1, 1, 1])) == (-50 + 30 + 1) / 2 / toxicity.BINS
    assert toxicity.set_cut(bins, np.array([0, 0, 0, 1, 1, 1]), np.array([5, 5, 5, 0, 0, 1])) == ((-50 + 30 + 1) / 2 + (40 + 90 + 1) / 2) / 2 / toxicity.BINS
    both = np.array([7, 7])
    assert toxicity.set_cut(both, np.array([0, 1]), np.array([100, 1])) > 7 / toxicity.BINS


def plain_ftrl(rows, alpha, beta, l1, l2, slope):
    """Weights by feature after the rows, coordinate by coordinate; slope(weighted sum, row) is the loss's slope."""
    z, n, w = {}, {}, {}
    for x, y in rows:
        for f in x:
            zf, nf = z.get(f, 0.0), n.get(f, 0.0)
            w[f] = 0.0 if abs(zf) <= l1 else -(zf - math.copysign(l1, zf)) / ((beta + math.sqrt(nf)) / alpha + l2)
        g = slope(sum(w[f] * v for f, v in x.items()), y)
        for f, v in x.items():
            nf, gf = n.get(f, 0.0), g * v
            z[f] = z.get(f, 0.0) + gf - (math.sqrt(nf + gf * gf) - math.sqrt(nf)) / alpha * w[f]
            n[f] = nf + gf * gf
    return {f: 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2) for f in z}


def test_follow_the_leader_against_plain_loops():
    rnd = random.Random(3)
    rows = [({f: rnd.choice((0.5, 1.0, 2.0)) for f in rnd.sample(range(30), 6)}, rnd.random() < 0.4) for _ in range(200)]
    logistic = lambda s, y: 1 / (1 + math.exp(-s)) - y
    want = plain_ftrl(rows, 0.3, 1.0, 0.4, 0.2, logistic)
    model = Ftrl((30,), 0.3, 1.0, 0.4, 0.2)
    for x, y in rows:
        at, v = np.array(list(x)), np.array(list(x.values()))
        w = model.at(at)
        model.update(at, w, logistic(float(w @ v), y) * v)
    got = model.at(slice(None))
    assert all(abs(got[f] - want.get(f, 0.0)) < 1e-9 for f in range(30)) and (got == 0).any() and (got != 0).any()


def plain_hash(points):
    h = points
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> shift)) * factor % 2**64
    return h ^ (h >> 31)


def plain_folded(text):
    out = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text)
    return out


def plain_ngrams(text):
    """The features of a text, n-gram by n-gram."""
    base, flat = 0x9E3779B97F4A7C15, re.sub(" +", " ", plain_folded(text) + " ")
    for n in language_id.LENGTHS:
        for i in range(len(flat) - n + 1):
            if flat[i] != " " or flat[i + n - 1] != " ":
                h = n
                for c in flat[i : i + n]:
                    h = (h * base + ord(c)) % 2**64
                yield plain_hash(h) % language_id.FEATURES


ODD_TEXTS = ["The cat, the DOG.", "Ünï çode ß — 中文 字", "a", "  x  y ", "İstanbul 12 e\u0301te\u0301", "12 \u0301 34", "", None, "word " * 3000]


def test_languages_against_plain_softmax(spark, documents, docs_of):
    model = language_id.train(documents.filter("lang is not null and text is not null"))
    langs, w, b, temperature = model
    got = {r["doc_id"]: r for r in language_id.predict(docs_of(list(enumerate(ODD_TEXTS))), model).collect()}
    for i, text in enumerate(ODD_TEXTS):
        found = list(plain_ngrams(text or ""))
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        logits = [(sum(float(w[f, k]) for f in found) / len(found) + b[k]) / temperature for k in range(len(langs))]
        top = max(logits)
        p = [math.exp(x - top) for x in logits]
        best = max(range(len(langs)), key=p.__getitem__)
        assert got[i]["lang_pred"] == langs[best] and abs(got[i]["score"] - p[best] / sum(p)) < 1e-6


def test_document_frequencies_against_plain_counts(docs_of):
    texts = [*[t for t in ODD_TEXTS if t is not None], "a", "a"]
    counts = language_id.frequencies(docs_of(list(enumerate(texts))))
    want = Counter(f for t in texts for f in set(plain_ngrams(t)))
    assert counts[-1] == len(texts) and {f: n for f, n in enumerate(counts[:-1].tolist()) if n} == dict(want)


def plain_words(text):
    """The features of a text: its words and the beginnings of longer ones."""
    base, flat = 0x9E3779B97F4A7C15, plain_folded(text)
    found = set()
    for word in flat.split(" "):
        for salt in (0, *toxicity.PREFIXES):
            if word and (not salt or len(word) > salt):
                h = 0
                for k, c in enumerate(word[: salt or None]):
                    h = (h + ord(c) * pow(base, k, 2**64)) % 2**64
                found.add(plain_hash(h ^ (salt << 56)) % toxicity.FEATURES)
    return found


def test_severity_against_plain_cumulative_links(spark, docs_of):
    docs, labels = toxic_table(spark)
    w, cuts, cut = model = toxicity.train(docs, labels)
    texts = [*ODD_TEXTS, "w1 grosso", "Grosso GROSSO vilestuff vilething", *[r["text"] for r in docs.collect()]]
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        found = plain_words(text or "")
        if not found:
            assert (got[i]["_severity"], got[i]["_grade"], got[i]["_toxic"]) == (0.0, 0, False)
            continue
        s = sum(float(w[f]) for f in found)
        above = [1.0, *(1 / (1 + math.exp(c - s)) for c in cuts), 0.0]
        p = [a - b for a, b in zip(above, above[1:], strict=False)]
        assert abs(got[i]["_severity"] - sum(k * v for k, v in enumerate(p))) < 1e-5 and got[i]["_toxic"] == (s >= cut) and p[got[i]["_grade"]] > max(p) - 1e-6


def test_url_parts_and_rules(spark):
    rows = [(1, "https://A.Example.ORG/es/1?x#y"), (2, "http://example.org/en/12"), (3, "http://badexample.org/es/1"), (4, "http://x.com/fr/2"), (5, "http://x.com/de/2"), (6, None), (7, "no scheme"), (8, "http://org"), (9, "http://a.net?q=/es/")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    want = {1: ("a.example.org", "/es/1", "example.org/es/"), 2: ("example.org", "/en/12", "example.org/en/1"), 3: ("badexample.org", "/es/1", "org/"), 4: ("x.com", "/fr/2", "com/fr/"), 5: ("x.com", "/de/2", "com/de/"), 6: ("", "", None), 7: ("", "", None), 8: ("org", "", None), 9: ("a.net", "", None)}
    assert {i: (r["host"], r["path"], r["rule"]) for i, r in got.items()} == want
    assert [got[i]["verdict"] for i in range(1, 6)] == ["block", "block", "allow", "allow", "block"]
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert urls.judge(spark.createDataFrame(rows, "page_id long, url string").limit(0), URL_RULES).count() == 0


def test_url_models_tell_kinds_apart(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'cheap'}{i % 17}.net/{'a' if i % 2 else 'pills'}/{i}") for i in range(400)]
    rules = [(f"good{k}.net", "/", "allow") for k in range(12)] + [(f"cheap{k}.net", "/", "block") for k in range(12)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).filter("rule is null").collect()
    assert got and np.mean([(r["verdict"] == "allow") == (r["page_id"] % 2 == 1) for r in got]) > 0.95


def test_url_likelihood_is_smoothed():
    ((own, row),) = urls.keys(["ab", None, "b"])
    assert own.shape == (urls.ORDER + 1, 6) and row.tolist() == [0, 0, 0, 1, 2, 2]
    assert urls.Model(np.zeros(0, np.int64), np.zeros((2, 0))).log_ratio(own).tolist() == [0.0] * 6


def test_long_urls_are_read_in_pieces(monkeypatch):
    asked = ["a", "http://x.org/" + "abcé" * 50, None, "b" * 33]
    whole = [np.concatenate(x, -1) for x in zip(*urls.keys(asked), strict=True)]
    monkeypatch.setattr(urls, "STEP", 7)
    parts = list(urls.keys(asked))
    assert len(parts) > 30 and all((np.concatenate(x, -1) == y).all() for x, y in zip(zip(*parts, strict=True), whole, strict=True))


def kinds(n, seed):
    """URLs of two kinds that differ in one word, among many words."""
    rng = random.Random(seed)
    words = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for k in range(3000)]
    return [(f"http://{rng.choice(words)}{rng.randrange(10**6)}.net/{rng.choice(words)}/{'garden' if good else 'casino'}-{rng.choice(words)}/{rng.randrange(10**6)}", good) for good in (True, False) for _ in range(n)]


@pytest.mark.parametrize("most", [1 << 21, 20_000])
def test_rare_contexts_go_first_and_kinds_stay_apart(spark, monkeypatch, most):
    """The smaller model holds a fraction of the counts and tells the kinds apart as well."""
    known, counts = urls.counted(spark.createDataFrame([(u, g, False) for u, g in kinds(4000, 1)], "url string, good boolean, held boolean").repartition(3), most)
    assert 0.5 * min(most, 100_000) < (counts > 0).sum() <= most
    model, asked = urls.Model(known, counts[:2]), kinds(500, 2)
    score = np.zeros(len(asked))
    for own, row in urls.keys([u for u, _ in asked]):
        score += np.bincount(row, model.log_ratio(own), len(asked))
    good = np.array([g for _, g in asked])
    assert np.mean((score > np.median(score)) == good) > 0.97


def test_url_scores_use_all_counts_however_few_are_broadcast(spark, monkeypatch):
    asked = [(i, u if i % 3 else f"http://a.{'org' if good else 'de'}/{u[7:]}") for i, (u, good) in enumerate(kinds(300, 3))] + [(-1, None), (-2, "http://a.org/" + "xyé" * 900)]
    rules = [("a.org", "/", "allow"), ("a.de", "/", "block")]
    rows = spark.createDataFrame(asked, "page_id long, url string").repartition(3)
    want = {r["page_id"]: r for r in urls.judge(rows, rules).collect()}
    monkeypatch.setattr(urls, "SPREAD", 20_000)
    monkeypatch.setattr(urls, "STEP", 2_000)
    for most in (0, 5_000):
        monkeypatch.setattr(urls, "KNOWN", most)
        got = {r["page_id"]: r for r in urls.judge(rows, rules).collect()}
        assert {i: r["score"] for i, r in got.items()} == pytest.approx({i: r["score"] for i, r in want.items()}, abs=1e-9)
        assert {i: r[:5] for i, r in got.items()} == {i: r[:5] for i, r in want.items()}


def test_url_table_cases(spark):
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (2, None), (None, "http://b.net/y"), (3, "")]
    more = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("z").alias(c) for c in ("host", "path", "rule", "verdict", "score", "good", "held")])
    got = [tuple(r) for r in urls.judge(more, URL_RULES).collect()]
    assert len(got) == 5 and got[0] == got[1] and {g[0] for g in got} == {1, 2, 3, None}
    assert all(g[4] == "allow" and g[5] > 0 or g[4] in ("allow", "block") for g in got)
    one_kind = urls.judge(spark.createDataFrame([(i, f"http://a{i}.org/") for i in range(30)] + [(99, None)], "page_id long, url string"), URL_RULES).collect()
    assert {r["verdict"] for r in one_kind if r["page_id"] != 99} == {"allow"}


def long_texts():
    rnd = random.Random(6)
    parts = [*"aB é.,!?-1 \t\n中 \u0301", "word ", "  ", "Straße", "...", " . ", "İ", "x" * 12]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(3, 90))) for _ in range(120)] + ["   " * 30, "1 2 3 " * 20, "a" * 300, " a" * 60]


@pytest.mark.parametrize("step", [1, 5, 40])
def test_long_texts_in_pieces_have_the_same_features(monkeypatch, step):
    from qanat.llm import words

    for text in long_texts():
        one = pa.array([text])
        monkeypatch.setattr(words, "STEP", 1 << 20)
        at, _, chars = language_id.features(one)
        want, tox = np.bincount(at, minlength=language_id.FEATURES), toxicity.features(one)
        used = np.arange(toxicity.FEATURES) % 3 > 0
        scores = toxicity.scores(one, [np.arange(toxicity.FEATURES, dtype=float)], used)
        monkeypatch.setattr(words, "STEP", step)
        counts, letter = language_id.long_counts(one)
        assert (counts == want).all() and letter == chars.has_letter()[0]
        assert all((a == b).all() for a, b in zip(toxicity.features(one), tox, strict=True))
        assert all((a == b).all() for a, b in zip(toxicity.scores(one, [np.arange(toxicity.FEATURES, dtype=float)], used), scores, strict=True))


def test_folds_that_lack_a_label(spark, docs_of):
    """One toxic row: without its fold there is no model, and the fold takes no part in setting the cut."""
    rows = [(i, f"plain words number {i} of this text") for i in range(60)] + [(100, "vile hate " * 5)]
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(100, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs_of(rows), labels).collect()}
    assert len(got) == 61 and not any(got[i]["toxic"] for i in range(60))
    two = spark.createDataFrame([(1, 0), (100, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs_of(rows[1:2] + rows[-1:]), two).count() == 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home, sweet home.</a></li></ul></nav>
<div class="ad">Buy this, now. And that, too.</div><div id="cookie-notice"><p>We use cookies, as all do.</p></div>
<article><h1>Title &amp; more</h1><p>First   paragraph,<br>with a break. <b>Bold<p>Second paragraph, after a missing end, and &eacute;.</p>
<ul><li>One item, listed.</li><li>Two.</li></ul><form><p>Sign up, please.</p></form><!-- <p>hidden</p> --></article>
<section class="comments"><p>A reader writes, at length, that this is all wrong.</p></section><aside><p>More, elsewhere.</p></aside><footer>&copy; us, 2024.</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE).split("\n") == ["Title & more", "First paragraph, with a break. Bold", "Second paragraph, after a missing end, and é.", "One item, listed.", "Two."]
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav><a>x</a></nav>") == ""
    plain = "<body><div><a>Home</a></div><div><p>A long text, with much to say, and to read.</p><p>More of it, also long, and as full of commas.</p></div><div>Go</div>"
    assert html.main_text(plain) == "A long text, with much to say, and to read.\nMore of it, also long, and as full of commas."
    assert html.main_text("<p>" + "word, " * 50_000 + "</p>").count("word") == 50_000
    assert html.main_text("<p>a < b and \"c\" <1></p><p class='x>broken, markup.</p>").startswith('a < b and "c" <1>')


ARTICLE = "<h1>Title</h1><p>A long text, with much to say, and to read.</p><p>More of it, also long, and as full of commas.</p>"
ARTICLE_TEXT = "Title\nA long text, with much to say, and to read.\nMore of it, also long, and as full of commas."


@pytest.mark.parametrize("head", ["<head><title>T</title><body>", "<head><meta charset=utf-8><title>a <p> b</title><link rel=x>", "<head><title>T<body>"])
def test_head_that_is_left_open(head):
    assert html.main_text(f"<!DOCTYPE html><html>{head}<div>{ARTICLE}</div>") == ARTICLE_TEXT
    assert html.main_text("<head><title>T</title>Some text, no tag.") == "Some text, no tag."


@pytest.mark.parametrize("wrapper", ['div class="has-sidebar"', 'div id="content-sidebar-wrap"', 'div class="ad-free"', 'section class="discussion"'])
def test_marks_on_a_wrapper_of_the_article(wrapper):
    tag = wrapper.split()[0]
    page = f'<body><{wrapper}><div>{ARTICLE}</div><div class="comments"><p>A reader writes, at length.</p></div></{tag}><div class="ad">Buy this, now.</div></body>'
    assert html.main_text(page) == ARTICLE_TEXT
    assert html.main_text(f"<body><article><h2>Top</h2><{wrapper}>{ARTICLE}</{tag}></article></body>").endswith(ARTICLE_TEXT)
    parts = "".join(f"<{wrapper}><p>Part {i}, of a text.</p></{tag}>" for i in range(3))
    assert html.main_text(f"<body>{parts}</body>").count("of a text.") == 3


def test_pages_cut_to_their_article(spark, sf):
    import re
    from html import unescape

    for r in html.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_path_ratios_against_brute_force(spark, sf):
    from tests.llm import brute

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = html.extract(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert found and all(r["text"] == brute.page_text(r["html"]) for r in found)
    loose = "<body><ul><li>One</li><li>Two</li></ul><p>A text, of some length, with signs; and more.</p><p>Short.</p><h1>x</h1><ul><li>Three</li></ul>"
    assert html.main_text(loose) == brute.page_text(loose) == "A text, of some length, with signs; and more.\nShort."


def article_of(page):
    """The main text of a generated page, from its article element."""
    from html import unescape

    article = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.S)[1]
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(p for p in parts if p)


def untold(page):
    """The page without a telling tag or word: menu, advert, article and footer are plain divs."""
    return re.sub(r"<(/?)(?:article|footer|nav)>", r"<\1div>", page).replace('<div class="ad">', "<div>")


def test_pages_without_a_telling_tag_or_word(spark, monkeypatch):
    """There the ratios alone find the article: mostly to the letter, always all of it; without them nothing is left out."""
    from tests.llm import brute

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    got = [html.main_text(untold(p)) for p in pages]
    want = [article_of(p) for p in pages]
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.85
    assert all(set(b.split("\n")) <= set(a.split("\n")) for a, b in zip(got, want, strict=True))
    assert got == [brute.page_text(untold(p)) for p in pages]
    monkeypatch.setattr(html, "KEEP", 0.0)
    assert all(len(html.main_text(untold(p))) > len(b) for p, b in zip(pages, want, strict=True))


PROSE = "A long text, with much to say, and to read. It goes on, and on; for a while."


@pytest.mark.parametrize("name", "replies responses reader-feedback reply-list cookiebar topnav promo modal subscribe-box toc related-posts site-header disqus_thread cookie-bar".split())
@pytest.mark.parametrize("holder", ["article", 'div class="post"'])
def test_dense_text_beside_the_article(name, holder):
    page = f'<body><div class="{name}"><p>{PROSE} One.</p><p>{PROSE} Two.</p></div><{holder}><h1>Head</h1><p>{PROSE}</p><p>{PROSE} More.</p><p>{PROSE} End.</p></{holder.split()[0]}></body>'
    assert html.main_text(page) == f"Head\n{PROSE}\n{PROSE} More.\n{PROSE} End."
    assert html.main_text(f'<body><div class="{name}"><p>{PROSE}</p></div></body>') == PROSE


def test_links_headers_banners_and_sections():
    links = "".join(f'<li><a href="/{i}">A headline, of some length, to be read elsewhere.</a></li>' for i in range(4))
    assert html.main_text(f"<body><div><ul>{links}</ul></div><div><p>{PROSE}</p><p>{PROSE}</p></div></body>") == f"{PROSE}\n{PROSE}"
    assert html.main_text(f'<body><div class="post"><header><h1>Head</h1></header><p>{PROSE}</p><p>{PROSE}</p></div></body>') == f"Head\n{PROSE}\n{PROSE}"
    assert html.main_text(f'<body><div role="banner"><p>{PROSE}</p></div><div><p>{PROSE} A</p><p>{PROSE} B</p></div></body>') == f"{PROSE} A\n{PROSE} B"
    assert html.main_text(f"<p>{PROSE}</p><![CDATA[x > y]]><p>{PROSE}</p>") == f"{PROSE}\n{PROSE}"
    assert html.main_text(f'<div><a href="#">Open link<p>{PROSE}</p></div><div><p>{PROSE}</p></div>').endswith(PROSE)


def test_what_the_ratios_decide():
    long = "A long text, with much to say, and to read."
    page = f'<body><header><p>Site, of ours.</p></header><article><header><h1>Head line</h1></header><p>{long}</p><p class="search-results">{long}</p><p hidden>{long}</p><div class="share">Share</div><p>{long}</p></article></body>'
    assert html.main_text(page).split("\n") == ["Head line", long, long, long, long]
    assert html.main_text("<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, so it is.</p>") == "As x=2, so it is."
    comments = f'<article><p>{long}</p></article><div id="comments"><p>{long}</p><p>{long}</p><p>{long}</p></div>'
    assert html.main_text(comments) == long
    assert html.main_text(f"<form id=all><div><article><p>{long}</p></article></div></form>") == long
    assert html.main_text(f"<article><p>{long}</p><form><p>{long}</p></form></article>") == long
    assert html.main_text(f'<p>{long} <span class="ad">Buy <span>it</span> now.</span> {long}</p>') == f"{long} {long}"


@pytest.mark.parametrize(
    ("part", "times", "rest"),
    [("<div>a ", 40_000, ""), ("<center>a ", 40_000, ""), ("<b>", 60_000, "</i>" * 60_000), ("<div>", 40_000, "</b></p>" * 40_000), ('<a "', 90_000, ""), ('<a href="', 40_001, ">x"), ("<p class='x>", 40_000, ""), ("<title>", 60_000, ""), ("<", 300_000, ">"), ("<!--", 80_000, ""), ("<p ", 1, "= " * 200_000 + ">"), ("<li>a", 60_000, "")],
)
def test_hostile_markup_takes_linear_time(part, times, rest):
    import time

    took = []
    for n in (times // 4, times):
        began = time.process_time()
        html.main_text(part * n + rest)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_html_table_cases(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string").withColumnRenamed("url", "url")
    assert [r["text"] for r in html.extract(rows).collect()] == ["", "", ""] and html.extract(rows.limit(0)).count() == 0
    more = spark.createDataFrame([(1, "u", "<p>a, b</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html.extract(more).collect()] == [(1, "u", "a, b")]


def test_url_scores_equal_plain_ones(spark):
    good = ["https://a.org/one", "https://a.org/one", "https://b.org/é?x=1", "", None]
    bad = ["http://spam.de/win", "http://spam.de/win/now"]
    asked = ["https://a.org/win", None, "", "http://spam.de/" + "x" * 300, "é"]

    def places(url):
        data = bytes(urls.ORDER) + (url or "").encode() + b"\n"
        return [[(k, data[i - k : i], data[i]) for k in range(urls.ORDER + 1)] for i in range(urls.ORDER, len(data))]

    def model(known):
        n, full = {}, {}
        for u in known:
            for k, context, byte in (x for at in places(u) for x in at):
                n[k, context] = n.get((k, context), 0) + 1
                full[k, context, byte] = full.get((k, context, byte), 0) + 1

        def log_p(at):
            p = 1 / 256
            for k, context, byte in at:
                p = (full.get((k, context, byte), 0) + urls.PRIOR * p) / (n.get((k, context), 0) + urls.PRIOR)
            return np.log(p)

        return log_p

    known, counts = urls.counted(spark.createDataFrame([(u, True, False) for u in good] + [(u, False, False) for u in bad], "url string, good boolean, held boolean"))
    got = {r["i"]: r["score"] for r in urls.scored(spark.createDataFrame(list(enumerate(asked)), "i int, url string"), urls.Model(known, counts[:2])).collect()}
    accepted, rejected = model(good), model(bad)
    want = {i: np.mean([accepted(at) - rejected(at) for at in places(u)]) for i, u in enumerate(asked)}
    assert got == pytest.approx(want, abs=1e-9)
