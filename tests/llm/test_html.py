import html as std
import random
import re

from keystrata.llm import html as H

PAGES = {
    "": "",
    "plain text only": "plain text only",
    "<p>a<br>b &nbsp; c</p>": "a\nb c",
    "<article>a < b and c > d <!-- x --> e<script>var a='</p>';</script> f</article>": "a < b and c > d e f",
    '<div class="cookie-notice">We use cookies here to make it all work and more</div><div id="menu"><a>a</a></div><div class="content"><h2>Head</h2>'
    '<p>Text one two three four five &eacute;.</p><div class="ad">buy now</div><p>Text two.</p></div><div class="sidebar"><p>side text long long long</p></div>': "Head\nText one two three four five é.\nText two.",
    "<body><header>Site name</header><main><h1>Title</h1><p title='a>b'>Hello <i>w</i>orld &amp; all &lt;tag&gt; words.<p>Second <b>para.<br><p>Third.<form>name<input></form></main>"
    "<section id='comments'><article class='comment'>" + "many words here " * 30 + "</article></section><footer>f</footer>": "Title\nHello world & all <tag> words.\nSecond para.\nThird.",
    "<nav><ul><li>Home<li>News</ul><article><h1>Own</h1><p>own words in the article here</article><section class='comments'><article><p>" + "a comment " * 50 + "</article></section>": "Own\nown words in the article here",
    "<div class='ad'>buy<article><p>unclosed advert before this text</p></article>": "unclosed advert before this text",
}


def test_known_pages():
    for page, want in PAGES.items():
        assert H.extract(page, dict(H.DEFAULT)) == want
    assert H.extract(None, dict(H.DEFAULT)) == ""


def test_best_run_against_all_runs():
    r = random.Random(1)
    for _ in range(200):
        s = [r.choice([-3.0, -1.0, 1.0, 2.0]) for _ in range(r.randrange(9))]
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        run = H.best_run(s)
        assert (sum(s[run[0] : run[1]]) == best) if best > 0 else run is None


def test_never_fails_on_broken_markup():
    r = random.Random(2)
    bits = ["<p", ">", "</", "<div class='ad'>", "</div>", "<!--", "-->", '"', "=", "<a href=", "x", " ", "<script>", "</script>", "&amp", "<article>", "</article>", "<", "<li>", "<?", "]]>"]
    for _ in range(3000):
        H.extract("".join(r.choice(bits) for _ in range(r.randrange(25))), dict(H.DEFAULT))
    H.extract("<b><i><p " * 20000 + "x", dict(H.DEFAULT))


def test_whole_table_against_markup(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = (" ".join(std.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|div)>", inner))
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = H.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in H.main_text(df).collect()) == [(0, "a", 1), (1, "", 0), (1, "", 0)]
    assert H.main_text(df.limit(0)).count() == 0


def inner_text(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    blocks = (" ".join(std.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|div)>", inner))
    return "\n".join(b for b in blocks if b)


def test_the_run_decides(spark, sf, monkeypatch):
    """Pages whose article is hidden in a div have the same text; without the best run every text is another."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = H.train(pages)
    html = [r.html for r in pages.collect()]
    want = [inner_text(h) for h in html]
    hidden = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in html]
    assert [H.extract(h, weights) for h in hidden] == want
    monkeypatch.setattr(H, "best_run", lambda scores: (0, len(scores)))
    assert not any(H.extract(h, weights) == w for h, w in zip(html, want)) and not any(H.extract(h, weights) == w for h, w in zip(hidden, want))


UNDECLARED = {
    "<div class='x1'><a href=/>Home</a> <a href=/n>News and views</a></div><div><h1>Title</h1><p>Some words of the text are here, <a href=/a>with a link</a> in it.</p>"
    "<p><a href=/b>Link first</a> then many more words of this text.</p></div><div class='x2'><a href=/1>one</a><a href=/2>two</a></div>": "Title\nSome words of the text are here, with a link in it.\nLink first then many more words of this text.",
    "<table><tr><td><ul><li><a>a</a><li><a>b</a></ul></td><td><p>The cell with the text has words.</p><p>And more of them.</p></td></tr></table>": "The cell with the text has words.\nAnd more of them.",
    "<div role=navigation>Menu one two</div><div><p>Text before the notice has words.</p><div class='promo'>Buy this thing now</div><p>Text after it too, and some more.</p></div><footer>f</footer>": "Text before the notice has words.\nText after it too, and some more.",
    "<p>x <math><mi>a</mi></math> y <object>fallback words</object> z": "x a y fallback words z",
    "<p>Words before it<select><option>one</select> after the form field<svg><text>drawn": "Words before it\nafter the form field",
}


def test_pages_that_declare_nothing(spark, sf):
    weights = H.train(spark.read.parquet(f"{sf}/pages.parquet"))
    for page, want in UNDECLARED.items():
        assert H.extract(page, weights) == want, page
        assert H.extract(page, dict(H.DEFAULT)) == want, page
