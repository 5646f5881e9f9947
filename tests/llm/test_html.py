import re
from html import unescape

from conftest import FOLDER

from lodegraph.llm import queries
from lodegraph.llm.html_extract import Page, extract


def test_query(spark):
    """The pages' articles have headings, paragraphs, bold type and line breaks only."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = queries.op6_main_text(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(x for x in blocks if x)
        assert r["n_chars"] == len(r["text"])


LAYOUT = """<html><body class="has-sidebar"><div id="page"><div class="site-header"><h1>Site</h1></div>
<div class="cookie-notice">We use cookies</div><div class="layout with-sidebar"><div class="post-{n} content">
<h2>T&eacute;st &amp; x</h2><p>One <a href=x>two</a> three &lt;b&gt; {text}<p>Four<br>five&nbsp;six<ul><li>a<li>b</ul>
<table><tr><td>c1<td>c2</table><div class="share">share me</div><div class="comments"><p>reader says hello</p></div>
</div><div class="sidebar"><p>side text</p></div></div></div><form><p>form text</p></form><footer>f</footer></body></html>"""


def test_layouts_and_votes(spark):
    main = "Tést & x\n\nOne two three <b> {}\n\nFour five six\n\na\n\nb\n\nc1\n\nc2"
    rows = [(i, f"http://h.example/{i}", LAYOUT.format(n=i, text="word " * 30)) for i in range(4)]
    # the sidebar of this page is longer than its text: its host's path tells what is what
    short = LAYOUT.format(n=9, text="w").replace('<div class="sidebar"><p>side text', f"<div class='extra'><p>{'more ' * 90}")
    rows.append((9, "http://h.example/9", short))
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got[0] == main.format(("word " * 30).strip())
    assert got[9] == main.format("w")


def test_large_and_small_hosts(spark):
    """Paths of large hosts are sent to their pages, those of the others are joined; both decide alike."""
    main = "Tést & x\n\nOne two three <b> {}\n\nFour five six\n\na\n\nb\n\nc1\n\nc2"
    long, bare = LAYOUT.format(n=1, text="word " * 30), "<nav><p>only a menu</p></nav>"
    short = LAYOUT.format(n=9, text="w").replace('<div class="sidebar"><p>side text', f"<div class='extra'><p>{'more ' * 90}")
    # 1,200 pages: a host with more than one of them is large
    hosts = ["big.example"] * 150 + ["bare.example"] * 50 + [f"h{i}.example" for i in range(1000)]
    rows = [(i, f"http://{h}/{i}", bare if h == "bare.example" else short if i == 149 else long) for i, h in enumerate(hosts)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert len(got) == len(rows)
    want = main.format(("word " * 30).strip())
    for i, h in enumerate(hosts):
        assert got[i] == ("" if h == "bare.example" else main.format("w") if i == 149 else want)


def test_odd_pages(spark):
    pages = [
        None, "", "plain text only", "<p>a<p>b", "<div><p>unclosed <b>bold", "<!-- never closed", '<article><p a="1>x</p></article>',
        "<" * 500 + 'a "' * 500, "<article><script>var a='</p>';</script><p>x &#x41;&notit; y</p></article>", "<table><tr><td>1<td>2<tr><td>3</table>",
        "<article>" + "<p>block</p>" * 3000 + "</article>", "<nav><p>only a menu</p></nav>", "<div>" * 2000 + "deep",
    ]
    rows = [(i, None if i % 2 else "no address", x, "t") for i, x in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in extract(df, ["page_id", "url"]).collect()}
    assert len(got) == len(pages)
    assert (got[0], got[1], got[2], got[3], got[4]) == ("", "", "plain text only", "a\n\nb", "unclosed bold")
    assert got[8] == "x A¬it; y" and got[9] == "1\n\n2\n\n3" and got[11] == "" and got[12] == "deep"
    assert got[10] == "\n\n".join(["block"] * 3000)
    assert extract(df.limit(0), ["page_id"]).collect() == []


def test_names_that_hold_most_of_a_page():
    assert Page("<div class='page-header'><p>" + "x " * 99 + "</p></div>").main_text(None) == ("x " * 99).strip()
    assert Page("<div class='ad'><p>buy this</p></div>").main_text(None) == ""
