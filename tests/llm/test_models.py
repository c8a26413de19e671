"""Main text, language, toxicity and audio: fixtures, held-out accuracy and brute force."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import audio_fingerprint as audio
from tessera.llm import html_extract, language_id, toxicity

PAGE = """<!DOCTYPE html><html lang="de"><head><title>T &amp; t</title><style>p {{}}</style></head><body>
<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Fish &amp;   chips</h1><p>First <b>bo</b>ld&nbsp;one<br>two <!-- no --></p><script>var x = "<p>no</p>";</script><p>Last {n}
<aside>Read also</aside><div class="advert">Buy</div><ul><li>a<li>b</ul></article>
<div class="comments"><p>Nice!</p></div><form>Name <input></form><div>Site {site} slogan</div><footer>(c)</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE.format(n=1, site=2)) == "Fish & chips First bold one two Last 1 a b"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("plain &lt;text&gt; <p>one<p>two") == "plain <text> one two"
    assert html_extract.main_text("<p>open <b>bold <i>both</b> tail") == "open bold both tail"
    assert html_extract.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_templates_of_a_host_go(spark, broadcast_rows):
    body = "<html><body><div>Join our {s} club</div><div><p>Story {n}</p></div></body></html>"
    rows = [(n, "https://A.example:80/x" if n < 8 else "https://b.example/", body.format(s="reading", n=n), "x", 1) for n in range(10)]
    rows += [(20, None, "<p>no host</p>", "x", 1), (21, "https://a.example/", None, "x", 1), (None, "https://a.example/", "", "x", 1), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, row_id int")
    got = html_extract.extract_pages(pages, broadcast_rows=broadcast_rows)
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in got.collect()]
    want = [(n, f"Story {n}" if n < 8 else f"Join our reading club Story {n}") for n in [*range(10), 0]] + [(20, "no host"), (21, ""), (None, "")]
    assert sorted(found, key=str) == sorted(((n, t, len(t)) for n, t in want), key=str)
    assert html_extract.extract_pages(pages.limit(0)).collect() == []


def test_a_block_without_a_telling_class_goes_from_inside_articles(spark):
    """By recurrence on its host alone: the same block on one page of another host stays, as do an article
    published many times and a sentence on a minority of pages."""
    block = "<div class=x9><p>Every morning in your letter box</p><p>Free of charge</p></div>"
    story = "<html><body><article><h1>Title {n}</h1><p>Story {n} of {n}</p>{block}<p>{quote}</p><p>End of {n}</p></article></body></html>"
    rows = [(n, "https://a.example/x", story.format(n=n, block=block, quote="A saying" if n % 4 == 0 else f"Saying {n}")) for n in range(20)]
    rows += [(100, "https://b.example/", story.format(n=100, block=block, quote="q"))] + [(101 + n, "https://b.example/", story.format(n=101 + n, block="", quote="q")) for n in range(3)]
    rows += [(200 + n, "https://c.example/", story.format(n="one", block=block, quote="same")) for n in range(30)]
    long = "".join(f"<p>Paragraph {k} of a long article</p>" for k in range(200))
    rows += [(300 + n, "https://d.example/", f"<article>{long}<p>Edited {n}</p></article>") for n in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    off = {i: html_extract.main_text(h) for i, _, h in rows}
    letter = "Every morning in your letter box Free of charge"
    assert all(letter in off[n] for n in range(20)) and got[100] == off[100] and letter in off[100]
    assert all(got[n] == " ".join(off[n].replace(letter, "").split()) for n in range(20)) and "A saying" in got[4]
    assert all(got[n] == off[n] for n in [*range(101, 104), *range(200, 230), *range(300, 312)])


def brute_templates(pages):
    """Host and text of recurring blocks, by comparing the rests of pages whole."""
    seen, per_host = {}, {}
    for _, url, page in pages:
        host = html_extract.host_of(url)
        body, subtrees = html_extract.article(page or "")
        per_host.setdefault(host, set()).add(body)
        for key, lo, hi in subtrees:
            seen.setdefault((host, key), set()).add(" ".join((body[:lo] + " " + body[hi:]).split()))
    return {k for k, rests in seen.items() if len(rests) >= max(html_extract.MIN_PAGES, html_extract.MIN_SHARE * len(per_host[k[0]]))}


def test_templates_match_whole_comparison(spark):
    rng = np.random.default_rng(8)
    blocks = [f"<div>Block {k} of the site</div>" for k in range(4)]
    rows = []
    for host in range(3):
        for n in range(30):
            parts = [f"<p>{' '.join(f'w{x}' for x in rng.integers(0, 5000, 12))}</p>" for _ in range(8)] + [b for k, b in enumerate(blocks) if rng.random() < (0.9, 0.7, 0.3, 0.1)[(k + host) % 4]]
            rng.shuffle(parts)
            rows.append((host * 100 + n, f"https://h{host}.example/{n}", "<article>" + "".join(parts) + "</article>"))
    parsed = html_extract.parsed_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {tuple(r) for r in html_extract.templates(parsed).collect()} == brute_templates(rows) and len(brute_templates(rows)) >= 6


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p data-x=it's>Hello big world</p><p>We don't know</p><p>end</p></article>", "Hello big world We don't know end"),
    ("<p title='a > b'>one</p><p title=\"it's\">two</p>", "one two"),
    ("<p class=\"open>one</p><p>two</p>", "one two"),
    ("a < b and c<d>e</d> 1 <2", "a < b and c e 1 <2"),
    ("x<!-->y<!-- z --!>w<!-- never closed <p>no", "xyw"),
    ("<p>kept</p><script>a</scripty></script ><p>too</p><a href=", "kept too"),
    ("<b>a</x>b<p>c</b>d</p>e", "ab cd e"),
])
def test_signs_of_tags(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("part", ["<a \"", "<a ='", "</script ", "<script></script ", "<div>", "<p><i>", "<!--", "<!", "</a", "<li><div>", "</x>", "<i>", "<div></div>"])
def test_long_pages_take_time_in_proportion(part):
    began = time.perf_counter()
    html_extract.main_text(part * 60_000)
    assert time.perf_counter() - began < 20


def test_pages_keep_their_articles(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = html_extract.extract_pages(pages).collect()
    assert len(rows) == pages.count()
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"][:1] for r in rows)


def test_language_accuracy_on_held_out_texts(documents):
    rows = documents.where("length(text) > 40 and lang in ('en', 'de', 'fr', 'es')")
    model = language_id.train(rows.where("doc_id % 2 = 0"))
    got = language_id.identify(rows.where("doc_id % 2 = 1"), model, F.col("text")).select("row.lang", F.col("text_lang")).collect()
    assert sum(r["lang"] == r["text_lang"] for r in got) >= 0.95 * len(got)


def test_host_priors_match_the_formula(spark):
    rows = [("a.b.example", [4.0, 1.0]), ("c.b.example", [0.0, 2.0]), ("example", [1.0, 0.0]), ("", [0.5, 0.5]), ("v.w.x.y.z.example", [0.0, 3.0])]
    got = {r["host"]: [math.exp(x) for x in r["prior"]] for r in language_id.host_priors(spark.createDataFrame(rows, "host string, counts array<double>"), 2).collect()}
    total = np.sum([c for _, c in rows], axis=0)
    top = (total + 1) / (total.sum() + 2)
    for host, _ in rows:
        labels = host.split(".")
        p = top
        for d in range(1, len(labels) + 1):
            name = ".".join(labels[-d:])
            own = np.sum([c for h, c in rows if h == name or ("." + h).endswith("." + name) and name] or [[0.0, 0.0]], axis=0)
            p = (own + 5 * p) / (own.sum() + 5)
        assert got[host] == pytest.approx(list(p)), host


def brute_language(rows, model):
    """Every row's outcome and probability from scratch: evidence by evidence in plain Python."""
    outcomes = [*model.languages, language_id.OTHER]
    texts = []
    for r in rows:
        words = [w for w in (r["text"] or "").lower().split() if not any(c.isdigit() or c in "@/\\=_#<>|{}" for c in w)]
        flat = " " + " ".join("".join(c if c.isalpha() else " " for c in " ".join(words)).split()) + " "
        total = np.zeros(len(outcomes))
        for k in range(len(flat) - 2):
            a, b, c = map(ord, flat[k : k + 3])
            mix = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % (1 << 32)
            total += model.table[(mix ^ mix >> 15) % language_id.BUCKETS]
        total *= language_id.TEMPER
        texts.append(np.maximum(total - total.max(), -language_id.MOST_TEXT))
    soft = [np.exp(e) / np.exp(e).sum() for e in texts]
    hosts = [(r["host"] or "").lower() for r in rows]
    top = (sum(soft) + 1) / (len(rows) + len(outcomes))

    def prior(host):
        p, labels = top, host.split(".")
        for d in range(1, len(labels) + 1):
            name = ".".join(labels[-d:])
            own = sum((s for s, h in zip(soft, hosts, strict=True) if ("." + h).endswith("." + name)), np.zeros(len(outcomes)))
            p = (own + language_id.SMOOTHING * p) / (own.sum() + language_id.SMOOTHING)
        return p

    def told(code, right):
        if not code:
            return np.ones(len(outcomes))
        said = code if code in model.languages else language_id.OTHER
        return np.array([right if o == said else (1 - right) / len(model.languages) for o in outcomes])

    out = []
    for r, e, h in zip(rows, texts, hosts, strict=True):
        p = np.exp(e) * prior(h) * told(r["declared"], language_id.DECLARED_RIGHT) * told(r["address"], language_id.ADDRESS_RIGHT)
        p /= p.sum()
        out.append((outcomes[int(np.argmax(p))], float(p.max())))
    return out


def test_fused_evidence_matches_brute_force(spark, documents):
    model = language_id.train(documents)
    words = [r["text"].split()[: 3 + i % 9] for i, r in enumerate(documents.where("length(text) > 200").limit(60).collect())]
    hosts = ["a.b.example", "b.example", "c.b.example", "Example", "x.de", None]
    rows = [{"id": i, "text": " ".join(w) if i % 7 else None, "host": hosts[i % 6], "declared": (None, "de", "fr", "it", "en")[i % 5], "url": (None, "https://x.de/", "https://x.com/fr/a")[i % 3], "address": (None, "de", "fr")[i % 3]} for i, w in enumerate(words)]
    df = spark.createDataFrame([(r["id"], r["text"], r["host"], r["declared"], r["url"]) for r in rows], "id long, text string, host string, declared string, url string")
    got = sorted(language_id.identify(df, model, F.col("text"), host=F.col("host"), declared=F.col("declared"), url=F.col("url"), keep=["id"]).collect(), key=lambda r: r["row"]["id"])
    assert [(r["lang"], pytest.approx(r["confidence"])) for r in got] == brute_language(rows, model)


def test_texts_in_none_of_the_languages_are_other(spark, make):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(documents)
    texts = ["Questa è una frase scritta in lingua italiana che parla del tempo e delle stagioni", "Dit is een Nederlandse zin over het weer en de jaargetijden op het platteland", "これは日本語の文章です。天気と季節について書いています。", "Это предложение на русском языке о погоде"]
    got = language_id.identify(make(list(enumerate(texts))), model, F.col("text")).collect()
    assert all(r["lang"] == language_id.OTHER and not r["accepted"] for r in got)
    kept = language_id.identify(documents.where("length(text) > 60"), model, F.col("text"), keep=["doc_id"])
    assert kept.where("not accepted").count() == 0


def test_language_edge_cases(make, edge, documents):
    model = language_id.train(documents)
    df = make(edge)
    got = language_id.identify(df, model, F.col("text"), host=F.col("digest"), declared=F.col("body")).collect()
    assert len(got) == len(edge)
    assert not any(r["accepted"] for r in got if not (r["row"]["text"] or "").strip())
    assert all(r["row"].asDict().keys() == set(df.columns) for r in got)
    assert language_id.identify(make([]), model, F.col("text")).collect() == []
    assert language_id.train(make([]).withColumn("lang", F.lit("en"))).evidence(["abc"]).shape == (1, 5)


def test_declared_and_addressed_languages(spark):
    rows = [("https://x.de/", "de"), ("https://x.com/fr/a", "fr"), ("https://x.es:80/en?x", "en"), ("https://x.com/den", None), (None, None), ("https://x.co/", "es"), ("https://x.com/a?lang=de", "de"), ("https://x.de/a?q=1&hl=FR#x", "fr"), ("https://x.com/?lang=den", None)]
    got = spark.createDataFrame(rows, "url string, want string").select("want", language_id.address_language(F.col("url")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    page = spark.createDataFrame([('<HTML class=x lang="de-AT"><p lang=fr>',), ("<p>",), (None,)], "html string").select(language_id.declared_language(language_id.markup_language(F.col("html"))).alias("l")).collect()
    assert [r["l"] for r in page] == ["de", "", None]


@pytest.mark.parametrize("unit", ["<", "<html ", "<html lang", "<script ", "<!--", "</script ", "&a", "<a href='", "lang =", "<html>", "&", "<style></style"])
def test_long_pages_take_time_in_proportion(spark, unit):
    page = unit * (1_000_000 // len(unit))
    df = spark.createDataFrame([(page,)], "html string")
    began = time.perf_counter()
    df.select(F.length(language_id.page_words(F.col("html"))), language_id.markup_language(F.col("html")), language_id.address_language(F.col("html"))).collect()
    assert time.perf_counter() - began < 10


def test_evidence_outweighs_a_wrong_declaration(make, documents):
    model = language_id.train(documents)
    text = documents.where("lang = 'de' and length(text) > 400").first()["text"]
    df = make([(1, text), (2, "")]).withColumn("lang", F.lit("fr"))
    got = {r["row"]["doc_id"]: r for r in language_id.identify(df, model, F.col("text"), declared=F.col("lang")).collect()}
    assert got[1]["lang"] == "de" and got[2]["lang"] == "fr" and not got[2]["accepted"]


def test_toxicity_on_held_out_labels(spark):
    where = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score_documents(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("want")), "doc_id").collect()
    toxic = [r["toxic"] for r in got if r["want"] == 1]
    clean = [r["toxic"] for r in got if r["want"] == 0]
    assert sum(toxic) >= 0.88 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_ordinal_gradient_recovers_an_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    score = x @ np.array([2.0, -1.0, 0.0])
    grades = np.digitize(score + rng.logistic(size=900) * 0.3, [-1.0, 1.0, 2.5])
    rows, cols = np.nonzero(np.ones_like(x))
    w, cut = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, 3, 3)
    assert w[0] > 1 > -0.5 > w[1] and abs(w[2]) < 0.4 and (np.diff(cut) > 0).all()


def planted_severities(rng, n, first):
    """Texts of 60 words with none, one, three or nine vile ones, in turn."""
    plain, vile = [f"word{k}" for k in range(400)], [f"vile{k}" for k in range(30)]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, 60))
        for k in rng.choice(60, (0, 1, 3, 9)[i % 4], replace=False):
            words[k] = rng.choice(vile)
        rows.append((first + i, " ".join(words), i % 4))
    return rows


@pytest.mark.parametrize("binary", [True, False])
def test_severity_orders_planted_severities(make, spark, binary):
    rng = np.random.default_rng(12)
    seen, new = planted_severities(rng, 400, 0), planted_severities(rng, 200, 1000)
    labels = spark.createDataFrame([(i, min(g, 1) if binary else g) for i, _, g in seen], "doc_id long, toxic int")
    model = toxicity.train(make([r[:2] for r in seen]), labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(make([r[:2] for r in new]), model).collect()}
    pairs = [(got[a]["severity"], got[b]["severity"]) for a, _, g in new for b, _, h in new if g < h]
    assert sum(x < y for x, y in pairs) >= 0.97 * len(pairs)
    assert sum(got[i]["toxic"] == (g > 0) for i, _, g in new) >= 0.97 * len(new)
    if not binary:
        assert sum(got[i]["grade"] == g for i, _, g in new) >= 0.85 * len(new)


def test_probabilities_match_the_formula():
    """Grades' probabilities as differences of sigmoids, one by one."""
    model = toxicity.OrdinalModel({"vile": 0, "vil*": 1, "kind": 2}, np.array([1.5, 0.5, -1.0]), np.array([-0.5, 0.75, 2.0]))
    for text in ("vile words", "a kind villain kind", "", "nothing at all"):
        words = text.split()
        counts = [words.count("vile"), 0, words.count("kind")]
        score = sum(w * min(4.0, math.log1p(100 * c / (len(words) + 20))) for w, c in zip(model.weights, counts, strict=True) if c)
        below = [1 / (1 + math.exp(score - t)) for t in model.thresholds]
        want = [b - a for a, b in zip([0, *below], [*below, 1], strict=True)]
        assert model.probabilities(np.array([model.score(text)]))[0] == pytest.approx(want)


def test_toxicity_edge_cases(make, edge, spark):
    none = toxicity.train(make(edge), spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score_documents(make(edge), none).collect()
    assert len(rows) == len(edge) and not any(r["toxic"] for r in rows)
    model = toxicity.train(make([(i, "vile slur" if i % 2 else "kind word") for i in range(40)]), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(make([(1, "vile slur"), (2, "kind word"), (3, None)]), model).collect()}
    assert got[1]["toxic"] and not got[2]["toxic"] and got[1]["severity"] > got[2]["severity"]
    assert toxicity.score_documents(make([]), model).collect() == []


def brute_stretch(a, b):
    """Best stretch of two recordings, offset by offset and place by place."""
    least, found = min(len(a), len(b)), []
    for offset in range(-len(b) + 1, len(a)):
        equal = [i for i in range(len(b)) if 0 <= i + offset < len(a) and a[i + offset] == b[i]]
        while equal:
            k = 1
            while k < len(equal) and equal[k] - equal[k - 1] <= audio.GAP:
                k += 1
            first, last = equal[0], equal[k - 1]
            n = last - first + 1
            wrong = sum((a[i + offset] ^ b[i]).bit_count() for i in range(first, last + 1)) / (32 * n)
            if k >= min(audio.MIN_VOTES, least) and n >= min(audio.MIN_OVERLAP, least) and wrong <= audio.MAX_ERROR:
                found.append((wrong, -n, offset, k))
            equal = equal[k:]
    return min(found, default=None)


def brute_links(docs, every):
    """Everything that ``linked`` returns, pair by pair."""
    prints = {i: audio.fingerprint(audio.text_frames(t or "")).tolist() for i, t in docs}
    out = {}
    for i, b in prints.items():
        same = [j for j, a in prints.items() if a == b and b]
        found = []
        for q in prints:
            if q % every == 0 and q != i and prints[q] and b and set(prints[q]) & set(b) and (best := brute_stretch(prints[q], b)):
                equal = [j for j in prints if prints[j] == prints[q] and j % every == 0]
                found.append((*best[:2], max(equal) if min(equal) == i else min(equal), *best[2:]))
        best = min(found, default=None)
        out[i] = (min(same, default=i), len(found), *((best[2], best[3], best[4], -best[1], pytest.approx(best[0])) if best else (None,) * 5))
    return out


@pytest.mark.parametrize("block", [1 << 21, 4000, 150])
def test_links_match_brute_force(make, documents, block):
    rng = np.random.default_rng(3)
    rows = [(r["doc_id"], " ".join((r["text"] or "").split()[:220])) for r in documents.where("doc_id < 70").collect()]
    passage = " ".join(f"p{x}" for x in rng.integers(0, 900, 60))
    rows += [(100 + k, " ".join(f"q{x}" for x in rng.integers(0, 900, 50)) + f" {passage} tail{k} " + " ".join(f"r{x}" for x in rng.integers(0, 900, 30))) for k in range(12)]
    rows += [(130 + k, passage) for k in range(12)] + [(150 + k, " ".join(f"s{j}" for j in range(16 + k))) for k in range(3)] + [(155, "s0 s1"), (160, " ".join(f"s{j}" for j in range(16)))]
    short = [" ".join(f"u{(j * j + 3) % 17}v{j}" for j in range(n)) for n in range(1, 16)]
    rows += [(170 + 10 * k, t) for k, t in enumerate(short)] + [(171 + 10 * k, t) for k, t in enumerate(short)] + [(172 + 10 * k, t + " more") for k, t in enumerate(short)]
    got = {r["doc_id"]: tuple(r)[1:] for r in audio.linked(make(rows), is_query=lambda c: c % 10 == 0, block_integers=block).collect()}
    assert got == brute_links(rows, 10)
    assert all(got[171 + 10 * k][:2] == got[170 + 10 * k][:1] + (got[171 + 10 * k][1],) and got[171 + 10 * k][1] >= 1 and got[171 + 10 * k][6] == 0 for k in range(15))
    pairs = {(r["query_id"], r["match_id"]) for r in audio.align(make(rows), is_query=lambda c: c % 10 == 0, block_integers=block).collect()}
    assert (130, 141) in pairs and (130, 105) in pairs and not any(q == m for q, m in pairs)


@pytest.mark.parametrize("block", [1 << 21, 20])
def test_a_large_group_of_copies_stays_linear(make, monkeypatch, block):
    """500 equal recordings: one class, a row each and no pairs; their integers and their block are dealt out."""
    monkeypatch.setattr(audio, "PART_ROWS", 100)
    rows = [(i, " ".join(f"w{k}" for k in range(60))) for i in range(500)] + [(601 + i, " ".join(f"w{(k * 7 + i * 13) % 400}" for k in range(60))) for i in range(5)]
    got = {r["doc_id"]: r for r in audio.linked(make(rows), block_integers=block).collect()}
    assert len(got) == 505 and all(r["class_id"] == 0 for i, r in got.items() if i < 500)
    assert all(r["n_links"] == (4 if i % 100 == 0 else 5) and r["best_id"] == (400 if i == 0 else 0) and r["best_error"] == 0 for i, r in got.items() if i < 500)


def test_recordings_are_shuffled_once_for_all_blocks(spark, make):
    """A passage in all recordings, so each is to be searched in every one of about twelve blocks."""
    def total():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    rng = np.random.default_rng(8)
    passage = " ".join(f"p{x}" for x in rng.integers(0, 900, 40))
    rows = [(i, " ".join(f"q{x}" for x in rng.integers(0, 9000, 300)) + " " + passage) for i in range(300)]
    integers = sum(len(audio.fingerprint(audio.text_frames(t))) for _, t in rows)
    before = total()
    got = audio.linked(make(rows), is_query=lambda c: c % 10 == 0, block_integers=integers // 120).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: 30 - (i % 10 == 0) for i in range(300)}
    assert total() - before < 3 * 4 * integers


def test_joined_recordings_have_their_own_integers():
    rng = np.random.default_rng(4)
    whole = [rng.integers(0, 5, (n, 12)).astype(float) for n in (40, 3, 16, 0, 15, 90)]
    mixed = [*whole[:2], rng.random((30, 12)), *whole[2:], rng.random((5, 12)), np.zeros((20, 12))]
    assert [p.tolist() for p in audio.fingerprint_all(mixed)] == [audio.fingerprint(f).tolist() for f in mixed]
    # ratios are cut where their logarithms are
    near = np.concatenate([np.exp(c) + np.arange(-4, 5) * 2.0**-53 for c in audio.CUTS])
    assert (np.digitize(np.log(near), audio.CUTS) == sum((near >= r).astype(int) for r in audio._RATIOS)).all()


def test_long_and_common_recordings_are_searched_whole(monkeypatch):
    """Integers of few kinds throughout, so a row has more matches than are counted at a time."""
    rng = np.random.default_rng(5)
    # no integer follows itself, as held ones vote once
    walk = lambda n, kinds: (np.cumsum(rng.integers(1, kinds, n)) % kinds).astype(np.uint32)
    prints = [walk(n, 3) for n in (60, 200, 1, 4, 17)] + [np.arange(40, dtype=np.uint32)]
    rows = [np.concatenate([walk(7, 3) + 50, p]) for p in prints] + prints + [np.zeros(0, dtype=np.uint32)]
    block = audio.QueryBlock(prints)
    whole = [(k, sorted(found)) for k, found in block.search_all(rows)]
    assert [k for k, _ in whole] == list(range(12))
    for k, found in whole:
        want = {q: b for q, a in enumerate(prints) if (b := brute_stretch(a.tolist(), rows[k].tolist()))}
        assert {q: (wrong, -n, o, v) for q, o, v, n, wrong in found} == want
    for name in ("_CHUNK", "_MATCHES", "_LOOKED_UP"):
        monkeypatch.setattr(audio, name, 50)
    assert [(k, sorted(found)) for k, found in block.search_all(rows)] == whole


def test_integral_image_sums_areas():
    frames = np.random.default_rng(2).random((40, 12))
    whole = audio.fingerprint(frames)
    assert len(whole) == 25
    # a frame's integer depends on its own window alone
    assert [int(audio.fingerprint(frames[k : k + 16])[0]) for k in range(25)] == whole.tolist()


def test_a_shifted_tone_aligns():
    rate = 11025
    t = np.arange(rate * 20) / rate
    rng = np.random.default_rng(6)
    notes = 220 * 2 ** (rng.integers(0, 24, 40) / 12)
    sound = np.sin(2 * np.pi * np.cumsum(np.repeat(notes, len(t) // 40)) / rate)
    full, part = audio.fingerprint(audio.pcm_frames(sound)), audio.fingerprint(audio.pcm_frames(sound[1365 * 20 :] + 0.01 * rng.normal(size=len(sound) - 1365 * 20)))
    found = list(audio.QueryBlock([full]).search(part))
    assert found and found[0][1] == 20 and found[0][4] < 0.05 and found[0][3] > 60


def test_audio_edge_cases(make, edge):
    got = audio.linked(make(edge), is_query=lambda c: c.isin(1, 9)).collect()
    assert len(got) == len(edge)
    by_id = {r["doc_id"]: r for r in got}
    assert {i: (r["class_id"], r["n_links"], r["best_id"]) for i, r in by_id.items() if i in (1, 5, 9, 10, 11)} == {1: (1, 0, None), 5: (4, 0, None), 9: (9, 0, None), 10: (9, 1, 9), 11: (11, 0, None)}
    pairs = audio.align(make(edge), is_query=lambda c: c.isin(1, 9)).collect()
    assert [(r["query_id"], r["match_id"], r["offset"], r["bit_error"]) for r in pairs] == [(9, 10, 0, 0.0)]
    assert audio.linked(make([])).collect() == audio.align(make([])).collect() == []
