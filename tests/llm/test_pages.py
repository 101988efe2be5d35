"""Main text of pages, media sequences, url verdicts."""

import hashlib
import math
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import html, media, urls
from graphloom.llm.queries import URL_RULES, op6_media_sequences, op9_html_extraction, op10_url_reputation

SENTENCE = "Rivers carve stone, slowly and without haste; the valley remembers each flood."


def page(body, head="<title>T</title><style>p{}</style><script>var a='<p>no</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


ARTICLE = f"<h1>On rivers</h1><p>{SENTENCE}</p><p>{SENTENCE} And &amp; more.</p><p>Short.</p>"
TEXT = f"On rivers\n{SENTENCE}\n{SENTENCE} And & more.\nShort."


@pytest.mark.parametrize("body", [
    f"<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News, all of it</a></li></ul></nav><article>{ARTICLE}</article><footer>&copy; Site, all rights.</footer>",
    f"<header><h2>Site, a name.</h2></header><div class='content'>{ARTICLE}</div><aside><p>{SENTENCE}</p></aside>",
    f"<div id=sidebar><p>{SENTENCE}</p></div><main>{ARTICLE}</main><section class='comments'><p>{SENTENCE} I agree.</p><p>{SENTENCE}</p></section>",
    f"<div class='cookie-notice'>We use cookies, you know; accept them.</div><div class=\"ad\">Buy, now!</div><article>{ARTICLE}</article><form><p>{SENTENCE}</p><input value=x></form>",
    f"<div role=navigation><p>{SENTENCE}</p></div><article>{ARTICLE}<!-- {SENTENCE} --><div class='share'>Share this, please.</div></article>",
    f"<article>{ARTICLE.replace('<p>Short.</p>', '<p>Short.<br>')}</article><div class='related-posts'><a href=x>{SENTENCE}</a></div>",
    f"<article>{ARTICLE.replace('<p>', '<p><b>', 1)}</article>",
    f"<article><h1>On  rivers\n</h1><p>{SENTENCE}<p>{SENTENCE} And <i>&#38;</i> more.<p>Short.</article>",
    f"<div id=siteHeader><p>{SENTENCE}</p></div><article><div class='entry-header'><h1>On rivers</h1></div>{ARTICLE.replace('<h1>On rivers</h1>', '')}</article><div class=cookieBanner><p>{SENTENCE}</p></div>",
    f"<article>{ARTICLE}<section id=comments><h2>Comments</h2><div class=comment><p>{SENTENCE} Me too.</p></div></section></article>",
    f"<div class=wrap><div class=menu-left><ul><li>{SENTENCE}</li></ul></div><div class=post>{ARTICLE}</div><div class='newsletter signup'><p>Join us, today.</p></div></div>",
    f"<article>{ARTICLE.replace('Short.', 'Sh<span>o</span>rt<span class=ad> buy</span>.')}</article>",
])
def test_templates(body):
    assert html.content(page(body)) == TEXT


@pytest.mark.parametrize("body", [
    f"<div class='content has-sidebar'><article>{ARTICLE}</article><div class=sidebar><p>{SENTENCE}</p></div></div>",
    f"<div class='with-sidebar'><div class=post>{ARTICLE}</div></div><footer>All rights.</footer>",
    f"<div id='page-header-layout'><div class='content has-sidebar'><main>{ARTICLE}</main></div></div><p>Elsewhere.</p>",
    f"<section class='post tags-visible'>{ARTICLE}</section><div class=related><p>{SENTENCE}</p></div>",
    f"<div class=has-sidebar><div class=sidebar><article><p>{SENTENCE}</p></article></div><article>{ARTICLE}</article></div>",
])
def test_layout_names_do_not_hide_the_article(body):
    assert html.content(page(body)) == TEXT


def test_odd_pages():
    assert html.content(None) == html.content("") == html.content("<html><body></body></html>") == html.content(page("<nav>Menu</nav>")) == ""
    assert html.content("just text, no markup") == "just text, no markup"
    assert html.content(f"<article><p>{SENTENCE}</p><p>cut &am") == f"{SENTENCE}\ncut &am"
    assert html.content(f"<article><p>{SENTENCE}</p><p>cut <a hre") == f"{SENTENCE}\ncut"
    long = "<article>" + f"<p>{SENTENCE}</p>" * 5000 + "</article>"
    assert html.content(page(long)).count("\n") == 4999
    assert html.content(page("<form><p>Search.</p></form>")) == ""
    assert html.content(page(f"<article></article><div class=ad>{SENTENCE}</div>")) == ""
    assert html.content(page(f"<p hidden>{SENTENCE}</p><p>A <span style='display: none'>b <i>c</i></span>d.</p>")) == "A d."


@pytest.mark.parametrize("body", [
    "<{0}>" * 200_000 + SENTENCE + "</{0}>" * 200_000, "<{0}>" * 200_000 + SENTENCE,
    "<p>" + "<{0}>" * 50_000 + f"<p>{SENTENCE}" * 100, "<{0}><li>" * 50_000 + SENTENCE,
])
@pytest.mark.parametrize("tag", ["div", "span", "section"])
def test_deep_pages_take_linear_time(tag, body):
    start = time.process_time()
    assert SENTENCE in html.content(page(body.format(tag)))
    assert time.process_time() - start < 5


# No element says what it is: only the ratios tell the article from what surrounds it.
PLAIN = "<div><div><ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8)) + "</ul></div><div>{}</div><div><b>Call us</b></div></div><table><tr><td>Contact</td><td>Imprint</td></tr></table>"


@pytest.mark.parametrize("body", [
    PLAIN.format(ARTICLE),
    f"<table><tr><td><a href=/>Home</a></td><td><a href=/n>News</a></td></tr></table><div><div>{ARTICLE}</div></div><div><span>All rights reserved</span></div>",
    f"<ul><li>One</li><li>Two</li><li>Three</li></ul><div><section>{ARTICLE}</section><section><a href=/more>More</a></section></div>",
])
def test_ratios_decide_without_telling_names(body, monkeypatch):
    assert html.content(page(body)) == TEXT
    monkeypatch.setattr(html, "path_ratios", lambda at, chars, marks: np.ones(at.max() + 1))
    assert html.content(page(body)) != TEXT


def test_ratios_decide_on_the_pages_table(monkeypatch):
    """Neither lists nor names are needed for most pages; without the ratios, no page comes out right."""
    import pyarrow.parquet as pq

    pages = [h for h in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if h]
    want = [html.content(h) for h in pages]
    with monkeypatch.context() as m:
        m.setattr(html, "_weights", lambda p: np.ones(len(p.texts)))
        assert sum(html.content(h) == w for h, w in zip(pages, want)) > 0.9 * len(pages)
    monkeypatch.setattr(html, "path_ratios", lambda at, chars, marks: np.ones(at.max() + 1))
    assert sum(html.content(h) == w for h, w in zip(pages, want)) == 0


@pytest.mark.parametrize("name", ["social notice", "tags-of-war", "share", "related header"])
def test_names_do_not_outweigh_an_articles_paragraph(name):
    body = f"<nav><a href=/>Home</a></nav><article>{ARTICLE.replace('<p>', f'<p class={chr(39)}{name}{chr(39)}>', 1)}</article>"
    assert html.content(page(body)) == TEXT
    short = f"<nav><a href=/>Home</a></nav><article>{ARTICLE}<p class='{name}'>Rivers</p></article>"
    assert html.content(page(short)) == TEXT


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pab \"'=&;!-", max_size=80))
def test_any_markup(text):
    html.content(text)
    media.sequence(text)


def test_extract_columns(spark):
    df = spark.createDataFrame([(1, "u", page(f"<article>{ARTICLE}</article>"), "mine", 3), (2, None, None, "x", 4), (2, None, None, "x", 4)], "page_id long, url string, html string, Text string, text_no int")
    out = html.extract(df)
    assert out.columns == ["page_id", "url", "text_no", "text", "n_chars"]
    assert sorted(out.select("page_id", "text", "n_chars").collect()) == [(1, TEXT, len(TEXT)), (2, "", 0), (2, "", 0)]
    assert html.extract(df.limit(0)).collect() == []


def test_pages_table(spark):
    sf = "/root/testdata/sf0.001"
    import re
    from html import unescape

    got = {r.page_id: r for r in op9_html_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        a = r.html[r.html.find("<article>") + 9 :].split("</article>")[0].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>?", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", a)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_sequence():
    s = media.sequence('<p>One &amp; two</p><figure><img src="sha256:aa" alt="x"><figcaption>A <b>caption</b></figcaption></figure>mid<img src=plain.png alt=Alt><p>end')
    assert [(e["position"], e["kind"], e["text"], e["digest"], e["caption"]) for e in s] == [
        (0, "text", "One & two", None, None), (1, "media", None, "aa", "A caption"), (2, "text", "mid", None, None), (3, "media", None, None, "Alt"), (4, "text", "end", None, None)]
    assert media.sequence(None) == media.sequence("") == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_stored_form(raw):
    back = media.decode(media.encode(raw))
    assert back[: len(raw)] == raw and set(back[len(raw) :]) <= {0} and len(back) % 64 == 0 and len(back) > 0


def test_resolve(spark):
    pay = spark.createDataFrame([(1, b"abc"), (2, b"abc"), (3, b""), (4, None)], "k int, p binary")
    stored = media.store(pay, "p")
    dig = hashlib.sha256(b"abc").hexdigest()
    pages = spark.createDataFrame([(7, f'a<img src="sha256:{dig}">b<img src="sha256:00">'), (8, None)], "doc_id long, html string")
    got = sorted(media.resolve(media.sequences(pages), stored).select("doc_id", "position", "n_bytes", "media").collect())
    assert got == [(7, 1, 3, media.encode(b"abc")), (7, 3, None, None)]
    assert media.measured(stored.limit(0)).collect() == media.resolve(media.sequences(pages.limit(0)), stored).collect() == []


def test_measures_come_from_the_stored_bytes(spark):
    pay = spark.createDataFrame([(b"abc",), (b"x" * 65,), (b"",)], "p binary")
    stored = {r.digest: r for r in media.store(pay, "p").collect()}
    changed = spark.createDataFrame([(r.digest, r.n_bytes, bytearray(media.encode(b"other"))) for r in stored.values()], "digest string, n_bytes long, media binary")
    for r in media.measured(changed).collect():
        p = b"other".ljust(64, b"\0")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) == (64, hashlib.sha256(p).hexdigest(), zlib.crc32(p), hashlib.sha256(media.encode(b"other")).hexdigest())


def test_order_and_captions_of_many_media(spark):
    """Pages of many media of which some share payloads: every position keeps its own caption and its own payload."""
    pays = [f"payload {i % 7}".encode() for i in range(40)]
    stored = media.store(spark.createDataFrame([(p,) for p in pays], "p binary"), "p")
    html_of = lambda k: "".join(f'<p>Text {k}-{i}</p><figure><img src="sha256:{hashlib.sha256(pays[(k + i) % 40]).hexdigest()}"><figcaption>{k}/{i}</figcaption></figure>' for i in range(5))
    pages = spark.createDataFrame([(k, html_of(k)) for k in range(30)], "doc_id long, html string").repartition(5)
    got = media.resolve(media.sequences(pages), stored).select("doc_id", "position", "caption", "media").collect()
    assert sorted((r.doc_id, r.position, r.caption, media.decode(r.media).rstrip(b"\0")) for r in got) == sorted((k, 2 * i + 1, f"{k}/{i}", pays[(k + i) % 40]) for k in range(30) for i in range(5))


def test_media_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op6_media_sequences(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        b = r.text.encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        m = media.encode(b)
        assert (g.media_bytes, g.media_sha256, g.feature) == (len(m), hashlib.sha256(m).hexdigest(), media.feature(p))
        assert (g.position, g.caption) == (4, f"payload of document {r.doc_id}")


def brute_rule(host, path):
    best = None
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def brute_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


URLS = ["http://A.Example.COM/en/77?x#y", "https://example.net/de/8", "http://x.net/de/8", "http://com/en/", "http://xcom/en/1", "ftp://h.org/es/#z", None, "", "no scheme", "://", "http://É.com/En/", "http://u://v/w", "http://h?a/b", "http://a.example.com/en/7\n/x"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    none = spark.createDataFrame([], "id long, bad boolean")
    for r in urls.judge_urls(df, none, URL_RULES).collect():
        host, path = brute_host(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        want = brute_rule(host, path)
        assert r.rule == (want and want[1]) and r.verdict == (want[0] if want else "allow")


def test_reputation(spark):
    rows = [(f"h{i}.good.com", False) for i in range(30) for _ in range(10)] + [("bad.evil.net", True)] * 60 + [("few.good.com", True)] * 2 + [("odd.evil.net", None), ("", None)]
    df = spark.createDataFrame(rows, "host string, bad boolean")
    got = {r.host: r for r in urls.reputation(df).collect()}
    assert got["bad.evil.net"].low > urls.MAX_BAD > got["few.good.com"].low
    assert got["odd.evil.net"].n == 0 and got["odd.evil.net"].mean > got["h1.good.com"].mean
    assert urls.reputation(df.limit(0)).collect() == []


def test_registered_parts(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "shop.example.co.uk": ("example.co.uk", "co.uk"), "x.org.au": ("x.org.au", "org.au"), "co.uk": ("co.uk", "co.uk"), "user:pw@h.example.net:8080": ("example.net", "net"),
             "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[2001:db8::1]:443": ("[2001:db8::1]", "[2001:db8::1]"), "localhost": ("localhost", "localhost"), "": ("", ""), "a.com.example": ("com.example", "example")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: (r.d, r.s) for r in df.select("host", urls.domain_of(F.col("host")).alias("d"), urls.suffix_of(F.col("host")).alias("s")).collect()} == hosts


def test_reputation_by_hand(spark):
    """The same shrinkage in plain arithmetic, level by level."""
    rows = [(f"{'abcd'[i % 4]}.{'xy'[i % 2]}.{'com' if i % 3 else 'org'}", i % 5 == 0 or i % 4 == 1 and i % 3 == 0) for i in range(240)]
    got = {r.host: r for r in urls.reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}

    def count(key):
        out = {}
        for h, b in rows:
            n, k = out.get(key(h), (0, 0))
            out[key(h)] = (n + 1, k + b)
        return out

    def strength(groups, prior):
        spread = sum(n * (k / n - prior[g]) ** 2 for g, (n, k) in groups.items())
        one = sum(prior[g] * (1 - prior[g]) for g in groups)
        many = sum(n * prior[g] * (1 - prior[g]) for g, (n, _) in groups.items())
        return 1000.0 if spread <= one or many <= one else min(1000.0, max(1.0, (many - one) / (spread - one) - 1))

    overall = (sum(b for _, b in rows) + 0.5) / (len(rows) + 1)
    sfx, dom, hosts = count(lambda h: h.split(".")[-1]), count(lambda h: h.split(".", 1)[1]), count(lambda h: h)
    prior = {g: overall for g in sfx}
    s = strength(sfx, prior)
    up = {g: (k + s * prior[g]) / (n + s) for g, (n, k) in sfx.items()}
    prior = {g: up[g.split(".")[-1]] for g in dom}
    s = strength(dom, prior)
    up = {g: (k + s * prior[g]) / (n + s) for g, (n, k) in dom.items()}
    prior = {g: up[g.split(".", 1)[1]] for g in hosts}
    s = strength(hosts, prior)
    for h, (n, k) in hosts.items():
        a, b = k + s * prior[h], n - k + s * (1 - prior[h])
        m = a / (a + b)
        assert math.isclose(got[h].mean, m, rel_tol=1e-9) and math.isclose(got[h].low, m - urls.Z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))), rel_tol=1e-9)


def test_url_query(spark):
    sf = "/root/testdata/sf0.001"
    for r in op10_url_reputation(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), "page_id").collect():
        assert (r.host, r.path) == brute_host(r.url)
        want = brute_rule(r.host, r.path)
        assert (r.rule, r.verdict) == ((want[1], want[0]) if want else (None, "block" if r.bad_rate_low > urls.MAX_BAD else "allow"))
    assert F  # the query's columns are judged above


def test_comments_under_untelling_names_are_not_the_article():
    """What stands in an element of its own again and again, like comments, is not one text; longer or not."""
    body = [f"Article paragraph {i} with some words, and others. It goes on for a while, too." for i in range(6)]
    says = [f"Reader comment number {i}, which is long and has many words, too. It never ends, does it? No, it goes on and on." for i in range(20)]
    article = "".join(f"<p>{x}</p>" for x in body)
    comments = "".join(f"<div><b>Ann</b><p>{x}</p></div>" for x in says)
    for page in (f"<body><div>{article}</div><div class='x3'>{comments}</div></body>", f"<body><h1>Title</h1><div>{article}</div><div class='x3'>{comments}</div></body>"):
        assert html.content(page) == "\n".join(body)


def test_deep_announcements_take_linear_time():
    began = time.time()
    html.content("<body>" + "<div class=ad>" * 3000 + "<p>word word, word.</p>" * 3000)
    html.content("<svg>" * 20_000)
    assert time.time() - began < 3


def test_malformed_media_pages_take_linear_time():
    began = time.time()
    for page in ("<a x " * 20_000, '<a b="' * 8000, "<img " + "a" * 100_000, "<img " + "a " * 50_000 + ">", "<script>" * 10_000, "<img a" + " " * 100_000):
        media.sequence(page)
    assert time.time() - began < 3


def test_scripts_and_styles_are_no_text():
    got = media.sequence("<style>p{}</style>a<script>var x = '<p>1';</script>b<p>c <img src='sha256:ab' alt='x'> d</p><noscript>n</noscript><title>t</title><textarea><p>u</textarea>")
    assert [x["text"] for x in got] == ["ab", "c", None, "d", "n"] and got[2]["digest"] == "ab"
