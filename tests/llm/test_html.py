import html as stdlib
import re
import time

from conftest import SF

from pyspark.sql import functions as F

from footing.llm import html
from footing.llm.queries import op5_html_extraction


def simple(page):
    """Of the generator's own pages: the article's h1 and p blocks, by plain patterns."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)
    if not article:
        return ""
    blocks = re.split(r"<h1>|</h1>|<p>|</p>", article[1])
    texts = [" ".join(stdlib.unescape(re.sub(r"<(?:b|br)>", " ", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op5_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == simple(pages[r["page_id"]]["html"]), r["page_id"]
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body>
<header>Site name</header><nav><ul><li><a href=/a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div>
<article class="post"><header><h1>Head&shy;line &#233; &lt;b&gt;</h1></header>
<p>One <i>two</i>
 three<br>four<p>Five <a href="x">link</a>
<ul><li>item one<li>item two</ul>
<script>var x = "</p>";</script><div class="ad">Buy</div>
<form><input name=q><label>Mail</label></form>
<!-- a > comment --><blockquote>Quote &copy;</blockquote>
<table><tr><td>a<td>b<tr><td>c</table>
<section id="comments"><article><p>Nice post</p></article></section>
</article><aside>Side</aside><div role="contentinfo">Foot</div><footer>F</footer></body></html>"""


def test_page_with_everything():
    blocks, _ = html.parse(PAGE)
    assert blocks == ["Head\xadline é <b>", "One two three four", "Five link", "item one", "item two", "Quote ©", "a b", "c"]


def test_templates_are_found_by_host(spark):
    def page(k, host_box):
        return f"<html><body><div>{host_box}</div><div><p>Text number {k}</p><p>Shared line</p></div></body></html>"

    rows = [(k, f"http://{'a.example' if k % 2 else 'b.example'}/x{k}", page(k, "Follow us here" if k % 2 else f"Box {k}")) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Text number 1"
    assert got[2] == "Box 2\n\nText number 2"
    article = [(k, "http://c.example/", f"<article><p>Shared line</p><p>Own {k}</p><div class='box'><a href=/>More</a></div></article>") for k in range(9)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(article, "page_id long, url string, html string")).collect()}
    assert got[3] == "Shared line\n\nOwn 3"


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "::::", "just text &amp; < more"), (2, "::::", "just text &amp; < more"), (3, "http://h/", "<p>open <b>never closed" + "<div>" * 3000 + "x"), (4, "http://h/", "<!-- never ends <p>x")]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = sorted(((r["page_id"], r["text"]) for r in html.extract_pages(frame).collect()), key=str)
    assert got == [(1, ""), (2, "just text & < more"), (2, "just text & < more"), (3, "open never closed\n\nx"), (4, ""), (None, "")]
    assert html.extract_pages(frame.limit(0)).count() == 0


def test_an_article_is_an_element_not_a_string():
    body = "<div><p>The text</p></div>"
    for other in ("<main-nav></main-nav>", "<article-card></article-card>", "<script>var t='<article>'</script>", "<!-- <main> -->", "<aside><article>Side</article></aside>"):
        assert html.parse(other + body)[0] == ["The text"], other
    assert html.parse("<p>Outside</p><ARTICLE><p>The text</p></ARTICLE>")[0] == ["The text"]


def test_characters_that_lower_to_two():
    odd = "\u0130" * 30
    assert html.parse(f"<p>{odd}</p><SCRIPT>'</scripts>'</Script ><article><p>The text</p></article>")[0] == ["The text"]
    assert html.parse(f"<article><p>{odd}</p><style>p{{}}</STYLE><p>The text</p></article>")[0] == [odd, "The text"]


def site(hosts=6, pages=40):
    """Pages whose site parts carry no telling mark, within an article element or without one; text shared by some articles.

    Returns rows (page_id, url, html), and per page its own blocks and its site's.
    """
    rows, own, chrome = [], {}, {}
    for h in range(hosts):
        top = [f"Site {h} all day", f"Section {h} one"]
        box = [f"Members of {h} read more", f"Write to desk {h}", f"Printed in town {h}"]
        for k in range(pages):
            n = h * 1000 + k
            text = [f"Headline {n}", f"First words of {n}", f"Last words of {n}"]
            if k % 3 == 0:
                text.append(f"A passage that a third of the articles of {h} quote")
            body = f"<h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:])
            inner = f"<div class=x{h}>{body}<div><a href=/m>{box[0]}</a> </div><p>{box[1]}</p></div>"
            inner = f"<article>{inner}</article>" if h % 2 else inner
            page = f"<html><body><div><b>{top[0]}</b></div><ul><li><a href=/s>{top[1]}</a></ul>{inner}<div>{box[2]}</div></body></html>"
            rows.append((n, f"https://h{h}.example/{k}", page))
            own[n], chrome[n] = text, top + box
    return rows, own, chrome


def test_templates_do_the_removing(spark):
    """Recall and precision of the removal with templates and without, on hosts with an article element and without."""
    rows, own, chrome = site()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")

    def measured(often):
        got = {r["page_id"]: r["text"].split("\n\n") for r in html.extract_pages(frame, often).collect()}
        out = {}
        for kind in (0, 1):
            pages = [n for n in got if n // 1000 % 2 == kind]
            gone = sum(c not in got[n] for n in pages for c in chrome[n]) / sum(len(chrome[n]) for n in pages)
            kept = sum(t in got[n] for n in pages for t in own[n]) / sum(len(own[n]) for n in pages)
            out[kind] = (gone, kept, sum(got[n] != own[n] for n in pages) / len(pages))
        return out

    on, off = measured(html.Often()), measured(html.Often(least=10**6))
    assert on == {0: (1.0, 1.0, 0.0), 1: (1.0, 1.0, 0.0)}
    # without the templates the site's parts stay; an article element saves only from those outside
    assert off[0] == (0.0, 1.0, 1.0) and off[1] == (0.6, 1.0, 1.0)


def test_copies_of_a_page_are_no_template(spark):
    page = "<article><h1>One</h1><p class=lead>Two</p><p>Three <a href=x>four</a></p><div>Five</div></article>"
    rows = [(k, "http://h.example/", page) for k in range(30)] + [(99, "http://h.example/", "<article><p>Other</p></article>")]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "One\n\nTwo\n\nThree four\n\nFive" and got[99] == "Other"


def test_sections_of_a_large_host(spark):
    """A box on a small share of a large host's pages is a template by its number."""
    rows = [(k, "http://h.example/", f"<div><p>Own {k}</p></div>" + ("<div>Part of the magazine</div>" if k % 7 == 0 else "")) for k in range(420)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Own 7"


def test_hostile_pages_take_linear_time():
    for part in ("<a ", '<a ">" ', "<b>", "<div>", "<li>", "<!--", "<a b='", "<p "):
        began = time.time()
        html.parse(part * 200_000 + '"' + "<hr>" * 50_000 + "</x>" * 50_000)
        assert time.time() - began < 20, part
    began = time.time()
    html.parse("<a " * 200_000)
    assert time.time() - began < 1


def test_a_form_around_the_page_is_no_form():
    page = (
        "<html><body><form id=aspnetForm action=x><input type=hidden value=1><nav>Site</nav><h1>Title</h1><p>Real text.</p>"
        "<form><label>Search</label><input></form><div><p>More.</p></div><button>Send</button><footer>Legal</footer></form></body></html>"
    )
    blocks, _ = html.parse(page)
    assert "Title" in blocks and "Real text." in blocks and not {"Site", "Legal", "Send", "Search"} & set(blocks)
    # a form that is filled in has no such parts
    assert html.parse("<body><p>Text.</p><form><p>Your name</p><input></form></body>")[0] == ["Text."]
    # in an article, too, and never closed
    assert html.parse("<form><article><p>Inside.</p></article>")[0] == ["Inside."]


def test_many_open_forms_take_no_time():
    import time

    began = time.time()
    html.parse("<form>" * 20_000 + "<p>x</p>" + "<nav>" * 2000)
    assert time.time() - began < 5


def test_templates_by_page_equal_templates_by_host(spark, monkeypatch):
    """A large host with as many templates as it likes: no list is longer than a page, and texts are the same."""
    rows = []
    for k in range(600):
        section = f"<div class=box{k % 10}><a href=/s{k % 10}>Section {k % 10}</a> words of it</div>"
        rows.append((k, f"http://big.example/{k}", f"<html><body><div><a href=/>Home</a></div>{section}<p>Text {k} of its own.</p></body></html>"))
    rows += [(1000 + k, None, None) for k in range(3)] + [(2000, "http://small.example/", "<p>alone</p>"), rows[5]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    shared = sorted(map(tuple, html.extract_pages(pages).collect()), key=str)
    monkeypatch.setattr(html, "BROADCAST_HASHES", 0)
    assert sorted(map(tuple, html.extract_pages(pages).collect()), key=str) == shared
    assert dict((r[0], r[2]) for r in shared)[17] == "Text 17 of its own."
    templates = html.recurring(pages)
    assert templates.where("host = 'big.example'").count() >= 10
    keyed = html._hosted(pages).withColumn("key", F.xxhash64("host", "html"))
    assert html._own_templates(keyed, templates).agg(F.max(F.size("hashes"))).first()[0] <= 4
