import pyarrow as pa
import pytest

from strandwise.llm import extraction as X

ART = "Here is a paragraph of the article, with commas, and of some length, so that it scores well among others."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just words", "just words"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{ART}<br>more<p>{ART}</article><footer>f</footer>", f"T & U\n{ART} more\n{ART}"),
        (f"<body><div class='sidebar'><p>{ART}</p></div><div id=content><p>{ART}</p><p>Second, {ART}</p></div><div class=comments><p>I say, {ART}</p></div>", f"{ART}\nSecond, {ART}"),
        (f"<article><p>a&nbsp;b &#x41;&eacute;\n  c</p><script>x()</script><style>p</style><form><p>no</p></form><p>{ART}</p><div class='ad'>buy</div></article>", f"a b Aé c\n{ART}"),
        (f"<header><h1>Site</h1></header><main><p>{ART}</p><ul><li>one</li><li>two</li></ul><table><tr><td>x<td>y</table></main>", f"{ART}\none\ntwo\nx\ny"),
        (f"<div><div><p>{ART}</p><p>short</p></div><div><a href=1>l1</a> <a href=2>l2</a> <a href=3>l3</a></div></div>", f"{ART}\nshort"),
        ("<p>un<b>closed <i>tags", "unclosed tags"),
        (f"<article><p>{ART}<!-- hidden --></p><aside>no</aside><div role='navigation'>no</div><p hidden>no</p></article>", ART),
        (f"<article><pre>a  b\n c</pre><blockquote>{ART}</blockquote></article>", f"a b c\n{ART}"),
    ],
)
def test_pages(html, text):
    assert X.extract(html) == text


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + ART + "</div>" * 20_000
    assert X.extract(deep) == ART
    body = "".join(f"<p>{ART} {i}</p>" for i in range(5000))
    assert X.extract(f"<article>{body}</article>").count("\n") == 4999


def test_query(spark, tmp_path):
    import pyarrow.parquet as pq

    html = [f"<article><p>{ART}</p></article>", None, "", "<p>x", f"<article><p>{ART}</p></article>", "<article>naïve 日本</article>"]
    pq.write_table(pa.table({"page_id": pa.array([1, 2, 3, None, 1, 6]), "url": ["u", None, "v", "w", "u", "z"], "html": html, "text": ["t"] * 6, "n_chars": ["n"] * 6}), tmp_path / "pages.parquet")
    got = sorted(map(tuple, X.op5_extraction(spark, str(tmp_path)).collect()), key=str)
    want = [(1, "u", ART, len(ART))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", "x", 1), (6, "z", "naïve 日本", 8)]
    assert got == sorted(want, key=str)
    assert X.op5_extraction(spark, str(tmp_path)).where("false").count() == 0


def test_empty_table(spark, tmp_path):
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), tmp_path / "pages.parquet")
    assert X.op5_extraction(spark, str(tmp_path)).collect() == []


def test_article_text_stays():
    html = (
        f"<article><p>{ART}</p><p class='related'>Related work is this.</p><p class='notice'>A notice in law is this.</p><section class='discussion'><h2>Discussion</h2><p>We discuss.</p></section>"
        "<h2>References</h2><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>"
        "<div class='related'><a href=1>More like this</a></div><div class='notice'>We use storage.</div><div class='comments'><p>I say</p></div></article>"
    )
    assert X.extract(html).split("\n") == [ART, "Related work is this.", "A notice in law is this.", "Discussion", "We discuss.", "References", "One", "Two", "Three"]
    menu = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>"
    assert X.extract(f"<div>{menu}<p>{ART}</p><p>{ART}</p></div>") == f"{ART}\n{ART}"


@pytest.mark.parametrize("piece", ["<b>x ", "<li><b>x ", "<p><i>x ", "<td><span>x ", "</i><b>x "])
def test_unclosed_tags_cost_linear_time(piece):
    import time

    def seconds(n):
        t = time.process_time()
        assert X.extract(piece * n).count("x") == n
        return time.process_time() - t

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.02)


def second_reading(html):
    """The article of a page by patterns alone; for pages with one article whose inner parts are not nested."""
    import html as H
    import re

    body = re.sub(r"(?is)<!--.*?-->|<(script|style|aside|form|nav|noscript|button)\b.*?</\1>", " ", html)
    body = re.search(r"(?is)<article\b[^>]*>(.*?)(</article>|<footer\b|</body>|$)", body)[1]
    body = re.sub(r"""(?is)<div class=["']?ad["']?[^>]*>.*?</div>""", " ", body)
    blocks = re.split(r"(?i)</?(?:p|h[1-6]|ul|ol|li|blockquote|pre|table|tr|td|th|div|section|header|figure|figcaption|article)\b[^>]*>", re.sub(r"(?i)<br\s*/?>", " ", body))
    lines = (" ".join(H.unescape(re.sub(r"(?s)<[^>]+>", "", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_given_pages_by_a_second_reading():
    from pathlib import Path

    import pyarrow.parquet as pq

    path = Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("no given tables")
    pages = [h for h in pq.read_table(path).column("html").to_pylist() if h and h.count("<article") == 1]
    assert len(pages) > 100
    wrong = [h for h in pages if X.extract(h) != second_reading(h)]
    assert not wrong, (len(wrong), X.extract(wrong[0]), second_reading(wrong[0]))
