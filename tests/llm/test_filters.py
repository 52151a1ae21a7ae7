"""URL rules, benchmark passages and page text against plain versions."""

import fnmatch
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import decontamination as D
from kindred.llm import html_text as H
from kindred.llm.queries import URL_GLOBS, URL_RULES
from kindred.llm.url_filter import Rule, filter_urls


def plain_verdict(url):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", tail, re.S)[0]
    path = re.match(r"[^?#]*", tail[len(host) :], re.S)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    return host, path, None, "block" if any(fnmatch.fnmatchcase(host + path, g) for g in URL_GLOBS) else "allow"


def test_urls_equal_plain_version(spark):
    r = random.Random(4)
    hosts = ["Example.NET", "a.example.net", "net", "x.net", "xnet", "example.com", "b.example.com", "org", "q.org", "casino-1.io", "m.adult-x.de", "", "ü.org", "example.net.evil.com"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/", "/fr/casino", "/x.net/en/", "/EN/", "/a/ads/b", "/é"]
    urls = [f"{r.choice(['http', 'HTTPS', ''])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?a=/en/', '#net/', '?x://y'])}" for _ in range(500)]
    urls += [None, "", "no scheme/net/", "http:/x.net/", "://net/", "http://a.net/" + "y" * 5000]
    rows = [(i, u, "z") for i, u in enumerate(urls)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), URL_RULES, URL_GLOBS).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g.host, g.path, g.rule, g.verdict) == plain_verdict(g.url), g.url
    many = [Rule("block", f"h{i}.net", "/") for i in range(40)]  # several machine words
    got = filter_urls(spark.createDataFrame([(1, "http://a.h39.net/x"), (2, "http://h40.net/")], "page_id long, url string"), many, []).orderBy("page_id").collect()
    assert [g.rule for g in got] == ["h39.net/", None]
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES, URL_GLOBS).count() == 0


def edits(a, b):
    """Edit distance of a to the best substring of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_alignment_equals_full():
    r = np.random.default_rng(2)
    for _ in range(60):
        item = r.integers(97, 101, r.integers(20, 60)).astype(np.uint8)
        text = list(item)
        for _ in range(r.integers(0, 4)):
            p = int(r.integers(len(text)))
            text[p : p + int(r.integers(0, 2))] = r.integers(97, 101, int(r.integers(0, 2))).tolist()
        text = np.array([*r.integers(97, 101, 10), *text, *r.integers(97, 101, 10)], np.uint8)
        assert D.banded_alignment(item, text, None)[1] == edits(item.tolist(), text.tolist())


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghiké") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randint(8, 40))) for i in range(12)] + [(90, "short"), (91, None), (92, "")]
    docs, planted = [], {}
    for d in range(96):
        t = text(r.randint(0, 120))
        if d % 3 == 0:
            i, s = items[r.randrange(12)]
            size = len(s.lower().encode())
            budget = int(size * D.EDIT_RATE)
            s = list(s)
            n = r.choice([0, 1, budget, budget * 3 + 4])
            for p in sorted(r.sample(range(len(s)), min(n, len(s))), reverse=True):
                s[p] = r.choice(["", "Z", s[p] + "q"])
            s = "".join(s).replace(" ", r.choice([" ", "\n ", " \t"])).upper() if d % 2 else "".join(s)
            t = t + " " + s + " " + text(5)
            planted[d] = i
        docs.append((d, t))
    docs += [(100, None), (101, ""), (0, docs[0][1])]
    norm = lambda t: " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()).encode()
    want = set()
    for d, t in docs:
        for i, s in items:
            a = norm(s)
            if len(a) >= 32 and edits(a, norm(t)) <= int(len(a) * D.EDIT_RATE):
                want.add((d, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(df, bench, block_bytes=400).collect()
    assert {(g.doc_id, g.item_id) for g in got} == want and 8 < len(want) < len(planted) + 5
    for g in got:
        a = norm(dict(items)[g.item_id])
        assert edits(a, norm(dict(docs)[g.doc_id].encode()[g.start : g.end].decode("utf-8", "ignore"))) <= int(len(a) * D.EDIT_RATE)
    kept = D.drop_leaks(df, bench).collect()
    assert sorted(k.doc_id for k in kept) == sorted(d for d, _ in docs if d not in {w[0] for w in want})
    assert D.find_leaks(df.limit(0), bench).count() == 0 and D.find_leaks(df, bench.limit(0)).count() == 0
    long = text(400_000)
    found = D.find_leaks(spark.createDataFrame([(1, long[:1_100_000] + items[0][1] + long[1_100_000:])], "doc_id long, text string"), bench).collect()
    assert [(g.item_id, g.edits) for g in found] == [(0, 0)]


def test_short_items_match_as_whole_words(spark):
    rows = [(1, "Say  HELLO\nworld, now"), (2, "say hello worlds"), (3, "othello world"), (4, "hello world"), (5, "hello"), (6, "hello world hello world"), (7, None)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, "hello world,"), (1, "Hello world"), (1, "hello World"), (2, "")], "item_id long, text string")
    got = sorted((g.doc_id, g.item_id, g.start, g.end, g.edits) for g in D.find_leaks(df, bench).collect())
    assert got == [(1, 0, 5, 17, 0), (4, 1, 0, 11, 0), (6, 1, 0, 11, 0), (6, 1, 12, 23, 0)]
    for rate, least in ((0.2, 32), (-0.1, 32), (0.05, 8)):
        with pytest.raises(ValueError):
            D.find_leaks(df, bench, edit_rate=rate, min_bytes=least)


def test_leaks_with_clashing_columns_and_many_blocks(spark):
    r = random.Random(5)
    items = [(i, " ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(12))) for i in range(6)]
    rows = [(i, f"before {items[i][1]} after" if i < 6 else f"clean {i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id + 1 AS _text", "'x' AS _id", "7 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (100, 1 << 20):
        kept = D.drop_leaks(df, bench, block_bytes=size)
        assert kept.columns == df.columns
        assert sorted((k.doc_id, k._text, k._id) for k in kept.collect()) == [(i, i + 1, "x") for i in range(6, 12)]
        assert sorted((g.doc_id, g.item_id) for g in D.find_leaks(df, bench, block_bytes=size).collect()) == [(i, i) for i in range(6)]
    assert D.drop_leaks(df.limit(0), bench).count() == 0 and D.drop_leaks(df, bench.limit(0)).count() == 12


def test_urls_keep_clashing_columns(spark):
    rows = [(1, "HTTP://Sub.Example.com/de/x?y", "h", "p"), (2, None, "h", "p"), (3, "x://a/" + "ads/" * 50_000, "h", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string").selectExpr("*", "5 AS _url")
    got = filter_urls(df, URL_RULES, URL_GLOBS)
    assert got.columns == ["page_id", "url", "_url", "host", "path", "rule", "verdict"]
    assert [(g._url, g.host, g.rule, g.verdict) for g in sorted(got.collect())] == [(5, "sub.example.com", "example.com/de/", "block"), (5, "", None, "allow"), (5, "a", None, "block")]
    named = filter_urls(df.select("page_id", F.col("url").alias("host")), URL_RULES, URL_GLOBS, url="host")
    assert sorted(g.host for g in named.collect()) == ["", "a", "sub.example.com"]
    assert filter_urls(df.limit(0), URL_RULES, URL_GLOBS).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x">
<header><a href="/">Site name which is long enough to count</a></header><nav><ul><li><a>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies and other things here, accept them please.</div>
<main><article class="post post-%d"><h1>Head &amp; line</h1><p>First  paragraph<br>with <b>bold</b> text &lt;here&gt; and more of it.
<p>Second paragraph, unclosed, caf&eacute; and a <a href="#">link</a> inside it.</p><ul><li>one<li>two</ul>
<div class="ad-box">Buy now, buy this great thing today for less!</div><script>var a = "</p>";</script></article>
<aside>Related things to read on this site.</aside><section class="comments"><p>A reader says that this is a comment that is long.</p></section></main>
<form><label>Mail</label><input></form><footer>&copy; somebody</footer></body></html>"""
TEXT = "Head & line\nFirst paragraph with bold text <here> and more of it.\nSecond paragraph, unclosed, café and a link inside it.\none\ntwo"


def test_pages(spark):
    rows = [(i, f"https://h{i % 2}.example.org/{i}", PAGE % i) for i in range(8)]
    rows += [(20, None, None), (21, "x", ""), (22, "https://h0.example.org/", "just text & more"), (23, "https://h0.example.org/t", (PAGE % 3)[: PAGE.index("Second") + 40] + "<p cl"), (24, "https://h1.example.org", "<p>" * 3000 + "deep")]
    got = {g.page_id: g for g in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i].text == TEXT and got[i].n_chars == len(TEXT) for i in range(8))
    assert got[20].text == got[21].text == "" and got[22].text == "just text & more" and got[24].text == "deep"
    assert got[23].text == TEXT[: got[23].n_chars] or TEXT.startswith(got[23].text.rstrip())
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_host_consensus_overrides_a_page(spark):
    body = "<body><div class='c%d'><p>" + "main words here and there " * 8 + "</p></div><div class='extra'><p>%s</p></div></body>"
    rows = [(i, f"http://h/{i}", body % (i, "side text " * (60 if i == 0 else 3))) for i in range(6)]
    got = {g.page_id: g.text for g in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {("main words here and there " * 8).strip()}


def test_article_parts_stay_and_its_surroundings_go():
    page = """<body><header><h1>Site header of some length</h1></header><article class="a"><header><h1>Head</h1></header><h2 id="search">Find it</h2>
    <p class="alert">A paragraph of the article, whatever its class is called.</p><div class="ad">Buy this now, really.</div>
    <section id="comments"><p>A reader's comment that is quite long.</p></section><footer>Tags</footer></article>
    <article class="b"><p>Second part of the text, beside the first.</p></article><aside>Side</aside></body>"""
    want = "Head\nFind it\nA paragraph of the article, whatever its class is called.\nSecond part of the text, beside the first."
    assert H.extract(page, "body>article.a") == H.extract(page, None) == H.extract(page, "body>div.elsewhere") == want


def brute_extract(html, winner):
    """The same by a plain tree: well-formed pages of div, article and p with unique classes."""
    import xml.etree.ElementTree as ET

    found = []

    def walk(e, path):
        path = [*path, e.tag + ("." + e.get("class") if e.get("class") else "")] if e.tag in ("body", "div", "article") else path
        if e.text and e.text.strip():
            found.append((path, " ".join(e.text.split())))
        for c in e:
            walk(c, path)
            if c.tail and c.tail.strip():
                found.append((path, " ".join(c.tail.split())))

    walk(ET.fromstring(html), [])
    top = winner.split(">") if winner else None
    if not top or not any(p[: len(top)] == top for p, _ in found):
        score = {}
        for p, t in found:
            points = len(t) * (1.0 if len(t) >= 25 else 0.25)
            for q, part in ((tuple(p), points), (tuple(p[:-1]), points / 3)):
                if q:
                    score[q] = score.get(q, 0) + part
        top = list(max(score, key=lambda k: score[k])) if score else []
    same = lambda p: p[: len(top)] == top or (top[-1:] and top[-1].startswith("article") and len(p) >= len(top) and p[: len(top) - 1] == top[:-1] and p[len(top) - 1].startswith("article"))
    return "\n".join(t for p, t in found if same(p))


def test_extraction_equals_brute_force():
    r = random.Random(12)
    for n in range(150):
        names = iter(range(1000))

        def part(depth, names=names):
            tag = r.choice(["div", "article", "p"]) if depth < 4 else "p"
            if tag == "p":
                return "<p>" + " ".join(r.choice(["word", "other", "longer-one"]) for _ in range(r.randint(1, 12))) + f" {r.random()}</p>"
            return f'<{tag} class="{chr(97 + next(names) % 26)}x">' + "".join(part(depth + 1) for _ in range(r.randint(0, 4))) + f"</{tag}>"

        html = "<body>" + "".join(part(0) for _ in range(r.randint(1, 4))) + "</body>"
        page = H.Page(html)
        paths = [page.path(k) for k in range(1, len(page.parent))]
        for winner in (None, r.choice(paths) if paths else None, "body>none"):
            assert H.extract(html, winner) == brute_extract(html, winner), (n, winner, html)


def test_deep_and_long_pages_take_linear_time():
    start = time.time()
    deep = "<body>" + "<div>" * 20_000 + "the text at the bottom of it all" + "</div>" * 20_000
    assert H.extract(deep, None) == "the text at the bottom of it all"
    H.extract("<body><article>" + "<div>text <p>" * 20_000, None)
    H.extract("<body>" + "<b><article>" + "<i></b>" * 20_000, None)
    assert len(H.extract("<body><article>" + "<p>words and more words</p>" * 100_000, None)) > 2_000_000
    assert time.time() - start < 10


def test_ties_clashing_columns_and_repeated_pages(spark):
    page = "<body><article><p>One text, as long as the other is.</p></article><div><p>Two text, as long as the other is.</p></div></body>"
    rows = [(1, "http://h/1", page, "x", 0, 7), (1, "http://h/1", page, "x", 0, 7), (2, None, None, None, 0, 7)]
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, _path int").selectExpr("*", "1 AS _host", "2 AS _html", "3 AS _salt"))
    assert got.columns == ["page_id", "url", "html", "_path", "_host", "_html", "_salt", "text", "n_chars"]
    found = sorted((g.page_id, g.text, g._path, g._host, g._html, g._salt) for g in got.collect())
    assert found == [(1, "One text, as long as the other is.", 7, 1, 2, 3)] * 2 + [(2, "", 7, 1, 2, 3)]
    renamed = spark.createDataFrame([(1, "http://h/1", page)], "page_id long, url string, text string")
    assert [tuple(g) for g in H.extract_main_text(renamed, html="text").collect()] == [(1, "http://h/1", "One text, as long as the other is.", 34)]


@pytest.mark.parametrize("bad", ["<", "<p", "</", "<!--", "<script>", "&#xZZ;", "<p class=", "<a href='", "<p/><br/><div/>x"])
def test_broken_markup_does_not_crash(bad):
    H.extract("<body><p>some text that is fine</p>" + bad, None)
