"""Extraction on templates whose article is known."""

import html as entities
import re

import pytest

from tableloom.llm import html
from tableloom.llm.queries import op5_html


def of(page):
    found = html.votes(page)
    return html.extract(page, max(sorted(found), key=found.get) if found else None)


def test_article_without_furniture():
    page = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
    <header><p>Site header text</p></header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><div id="sidebar"><p>Side text.</p></div>
    <div class="post-12 entry-content"><h1>A &amp; B</h1><p>First   para&eacute; <b>bold</b>er.<br>more
    <p>Second <a href="y">link</a> para.<ul><li>one<li>two</ul><pre>a   b</pre>
    <form><p>Sign up</p></form><!-- hidden --><script>if (a < b) "</p>"</script>
    <div class="ad-slot">Buy</div><section class="comments"><p>Great!</p></section></div>
    <aside>x</aside><footer>&copy; 2024</footer>"""
    assert of(page) == "A & B\nFirst paraé bolder. more\nSecond link para.\none\ntwo\na b"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just  text &lt;here", "just text <here"), ("<p>a<p>b", "a\nb"), ("<div>a</span>b</div>", "ab"),
    ("<article>x<div>y", "x\ny"), ("<p>a</p><scr", "a"), ("<!-- never closed <p>a</p>", ""), ("</div></p>z", "z"),
    ("<body><nav>only menu</nav></body>", ""), ("<td>1<td>2", "1\n2"), ("<P>A&nbsp;b&#x41;</P>", "A bA"),
])
def test_small_pages(page, text):
    assert of(page) == text


def test_hosts_agree_on_their_path(spark):
    body = "<p>" + "long article text of this page " * 6 + "</p>"
    misled = "<p>" + "a very long promotion without any class " * 20 + "</p>"
    rows = [(i, f"http://h.org/{i}", f'<div class="x"><p>short teaser</p></div><div class="story n{i}">{body}</div>', "k") for i in range(9)]
    rows.append((50, "http://H.org/50", f'<div class="x">{misled}</div><div class="story n50">{body * 3}</div>', "k"))
    rows += [(60, "http://other.net/", "<main><p>hello</p></main>", "k"), (61, None, "<p>no url</p>", "k"), (62, "x", None, "k"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    out = [(r.page_id, r.text, r.host) for r in html.main_text(df).collect()]
    text = {i: t for i, t, _ in out}
    assert len(out) == len(rows) and all(h == "k" for *_, h in out)
    one = " ".join(re.sub("<[^>]*>", "", body).split())
    assert all(text[i] == one for i in range(9))
    assert text[50] == "\n".join([one] * 3)  # the page alone would choose the promotion
    assert (text[60], text[61], text[62]) == ("hello", "no url", "")
    assert html.main_text(df.limit(0)).count() == 0


LONG = "<p>" + "running text of the article " * 220 + "</p>"


@pytest.mark.parametrize("beside", [
    "<h1>A heading of fifty characters over the long text</h1>", "<p>By a writer</p>",
    "<p>" + "<a href=x>See the earlier report on this</a> " * 8 + "</p>",
])
def test_heading_and_lead_stay_on_long_pages(beside):
    page = f"<body><div class=post>{beside}<div class=text>{LONG}</div><ul><li><a href=y>Other</a></ul></div>"
    lines = [" ".join(re.sub("<[^>]*>", "", t).split()) for t in (beside, LONG)]
    assert of(page) == "\n".join(lines)
    assert html.extract(page, "/body/div.post/div.text") == "\n".join(lines)


def test_host_path_does_not_cut_an_article():
    page = "<body><div class=post><div class=text><p>" + "one " * 500 + "</div><div class=more><p>" + "two " * 450 + "</div></div>"
    found = html.extract(page, "/body/div.post/div.text")
    assert found.count("one") == 500 and found.count("two") == 450


def test_long_page():
    page = "<body><article>" + "<p>word " * 30_000 + "</article>" + "<div>" * 5_000
    assert of(page) == "\n".join(["word"] * 30_000)


def test_query_against_article(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op5_html(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(entities.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article))
        want = "\n".join(p for p in parts if p)
        assert (r.text, r.n_chars) == (want, len(want))


STORY = "<p>" + "The article goes on in plain running text. " * 12 + "</p>"
KEPT = " ".join(("The article goes on in plain running text. " * 12).split())


@pytest.mark.parametrize("piece", [
    '<div class="comment-body"><p>Reader words.</p></div>', '<div class="article-footer"><p>Footer words.</p></div>',
    '<div class="story-ad">Buy this.</div>', '<div class="main-sidebar"><p>Side words.</p></div>',
    '<div id="cookie-text"><p>We use cookies.</p></div>', '<section class="post-comments"><p>Great!</p></section>',
    '<article class="comment"><p>A reader says so.</p></article>', '<span class="ad">Buy now</span>',
    '<h3 class="related">More like this</h3>', '<div class="related-posts"><p>Other posts.</p></div>',
    '<p class="newsletter-signup">Subscribe to us.</p>', '<ul class="share-buttons"><li>Share</ul>',
])
def test_furniture_inside_the_article_goes(piece):
    for page in (f"<article>{STORY}{piece}{STORY}</article>", f'<div class="content">{STORY}{piece}{STORY}</div>'):
        assert of(page) == f"{KEPT}\n{KEPT}"


@pytest.mark.parametrize("piece,text", [
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>", "Let x=2 hold."),
    ('<section id="related-work"><h2>Related work</h2><p>Others did so.</p></section>', "Related work\nOthers did so."),
    ('<div class="content-with-sidebar"><p>Inner text.</p></div>', "Inner text."),
    ('<div class="entry-header"><h1>The title</h1></div>', "The title"), ('<h2 class="section-header">Part</h2>', "Part"),
    ('<div class="elementor-widget-text"><p>Built text.</p></div>', "Built text."),
    ('<pre><span class="comment"># code</span> x = 1</pre>', "# code x = 1"),
    ('<p>An <em class="has-ads">odd</em> word</p>', "An odd word"), ('<span class="ad">Buy<p>Text after an open advert.</p>', "Text after an open advert."),
])
def test_article_parts_that_look_like_furniture_stay(piece, text):
    assert of(f"<article>{STORY}{piece}{STORY}</article>") == f"{KEPT}\n{text}\n{KEPT}"


TEMPLATES = {
    "a.org": '<div class="top-nav">Menu</div><div class="post n{i}"><h1>T{i}</h1>{text}<div class="post-comments">C</div></div>',
    "b.org": '<table><tr><td class="menu"><a href=x>Home</a></td><td class="text"><h1>T{i}</h1>{text}</td></tr></table>',
    "c.org": '<div id="wrap"><div class="col-8"><h2>T{i}</h2>{text}</div><div class="col-4 sidebar"><p>Side side side.</p></div></div>',
    "d.org": '<main class="page"><h1>T{i}</h1>{text}</main><div class="footer">Imprint</div>',
    "e.org": '<section class="story-{i}"><div class="story-ad">Buy</div><h1>T{i}</h1>{text}</section><div class="newsletter">Join</div>',
}


def test_templates_without_article_elements(spark):
    rows, want = [], {}
    for h, (host, page) in enumerate(TEMPLATES.items()):
        for i in range(6):
            words = [f"Paragraph {k} of page {i} tells some more of it." for k in range(3 + i)]
            key = 100 * h + i
            rows.append((key, f"https://{host}/{i}", page.replace("{i}", str(i)).replace("{text}", "".join(f"<p>{w}</p>" for w in words))))
            want[key] = "\n".join([f"T{i}", *words])
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(df).collect()} == want
