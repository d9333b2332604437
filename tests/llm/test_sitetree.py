from __future__ import annotations

import html
import random
import re
import time

from oddlines.llm import sitetree
from oddlines.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, text int"


def test_documents_of_the_test_pages(spark, sf_dir):
    """Their articles are flat, so a plain reading of the markup gives the same."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op3_html_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = re.sub("</?(p|h1|b)>|<br>", lambda m: "\0" if m[1] in ("p", "h1") else " ", article).split("\0")
        want = "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)
        assert (r.text, r.n_chars) == (want, len(want))


def test_one_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <header>Site</header><nav><a href=/x>Menu</a></nav><div class="cookie-notice">Accept</div>
    <article><h1>A &amp; B</h1><!-- <p>no</p> --><p>One  <b>two</b>
    &lt;three&gt; x < y</p><script>document.write("</p>")</script><ul><li>a<li>b</ul>loose<p>last<p>open <i>end
    <div class="ad">buy</div><form>f</form><section class="comments"><p>nice</p></section></article>
    <aside>side</aside><footer>&copy;</footer></body></html>"""
    assert sitetree.main_text(page) == "A & B\nOne two <three> x < y\na\nb\nloose\nlast\nopen end"


def test_odd_pages():
    assert sitetree.main_text(None) == sitetree.main_text("") == sitetree.main_text("<p></p><!-- x") == ""
    assert sitetree.main_text("plain &amp; text <") == "plain & text <"
    assert sitetree.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert sitetree.main_text("<main><p>m</p></main><p>out</p>") == "m"
    assert sitetree.main_text("<p>a</p></div></p><p title='>'>b") == "a\nb"
    assert sitetree.host_of("HTTPS://u@WWW.Example.com:80/x") == "www.example.com" and sitetree.host_of(None) == ""


def test_names_that_ban_and_names_that_do_not():
    body = "<p>" + "the text of the page " * 9 + "</p>"
    text = ("the text of the page " * 9).strip()
    for opening in ('<div class="content has-sidebar">', '<div id="post-comments-count-wrapper">', '<div class="share">'):
        assert sitetree.main_text(f"<body>{opening}{body}</div></body>") == text
    inside = '<article><header><h1>T</h1></header><p class="share-price">p</p><section id="menu-of-the-day">s</section>%s</article>'
    assert sitetree.main_text(inside % body) == f"T\np\ns\n{text}"
    remark = '<article class="comment"><p>nice</p></article>'
    assert sitetree.main_text(f"<article>{body}{remark}</article>") == text
    assert sitetree.main_text(f"<article>{body}</article><article><a>teaser</a></article>") == text
    for name in ("cookie-notice", "sidebar-left", "ad", "site-footer", "nav-item", "comment-list"):
        assert sitetree.main_text(f'{body}<div class="{name}">x</div>') == text


def test_broken_pages_take_no_longer():
    begin = time.process_time()
    n = 1 << 20
    for page in ("<a " * (n // 3), '<a x="' * (n // 6), "<div>" * (n // 20) + "</span>" * (n // 14), "<![CDATA[>" * (n // 10), "<b>" * (n // 8) + "x<hr>" * (n // 10)):
        sitetree.main_text(page)
    assert time.process_time() - begin < 30


def site(rng, n, host, frame="Share this story with friends"):
    rows, want = [], {}
    for i in range(n):
        words = [" ".join(f"w{rng.randrange(9999)}" for _ in range(20)) for _ in range(3)]
        body = "".join(f"<p>{w}</p>" for w in words)
        rows.append((f"http://{host}/{i}", f"<body><div class='x1'><span>{frame}</span></div><div class='x2'>{body}</div></body>"))
        want[rows[-1][0]] = "\n".join(words)
    return rows, want


def test_repeated_branches_go_and_content_stays(spark):
    rng = random.Random(1)
    big, want = site(rng, 30, "big.example")
    small = []
    for n in range(2, 8):
        rows, told = site(rng, n, f"small{n}.example")
        small, want = small + rows, want | told
    same = [(f"http://copies.example/{i}", "<article><div><p>all the same text</p></div></article>") for i in range(12)]
    rows = [(k, *r, 0) for k, r in enumerate(big + small + same + [(None, None), ("x", ""), ("http://big.example/0", big[0][1])])]
    found = sitetree.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.url in want:
            assert r.text == want[r.url]
        elif r.url and "copies" in r.url:
            assert r.text == "all the same text"
        else:
            assert r.text == ""
    assert sitetree.extract(spark.createDataFrame([], SCHEMA)).count() == 0
