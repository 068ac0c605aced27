import html
import math
import re

import pytest

from halyard.llm import html_main as H
from tests.conftest import SF_SMALL


def test_generated_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(pages, ["page_id", "url"]).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt; &amp; more&nbsp;&#233;", "plain <text> & more é"),
        ("<nav><p>m</p></nav><p>a<br>b <b>c</b>d</p>", "a b cd"),
        ("<header>h</header><main><p>one<p>two</main><footer>f</footer>", "one\ntwo"),
        ("<article><h1>T</h1><ul><li>a<li>b</ul><aside>x</aside><form>y<p>z</form></article><p>out", "T\na\nb"),
        ("<div class='cookie-notice'>c</div><div id=sidebar>s</div><p>kept</p><div class=ad>a</div>", "kept"),
        ("<article><p>in</p></article><section id='comments'><article class='comment'><p>reader</p></article></section>", "in"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p title='a>b'>x</p><!-- <p>no</p> -->", "x"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<p>cut off <b", "cut off <b"),
        ("<p hidden>x</p><div style='display: none'>y</div><div role=navigation>z</div><p>seen", "seen"),
        ("</div></p><p>stray ends", "stray ends"),
        ("<p>" + "long " * 50000, ("long " * 50000).strip()),
    ],
)
def test_blocks(source, text):
    assert H.main_text(source) == text


def site(n, host="site.example"):
    page = "<body><div class='top'>Welcome to us</div><div class='box'><p>Buy {k3}</p></div><div class='txt'><p>text {k} here</p><p>common passage</p></div></body>"
    return [(k, f"http://{host}/p{k}", page.format(k=k, k3="now")) for k in range(n)]


KIND = "page_id long, url string, html string"


def test_low_branches_go(spark):
    rows = site(8) + [(100, None, "<p>no host</p>"), (101, "http://one.example/", site(1)[0][2]), (102, "http://site.example/x", None)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, KIND), ["page_id"]).collect()}
    assert all(got[k] == f"text {k} here\ncommon passage" for k in range(8))
    assert got[100] == "no host" and got[101].startswith("Welcome to us\nBuy now") and got[102] == ""


def test_importance_is_the_entropy_formula(spark):
    got = {r["path"]: r["importance"] for r in H.importance(spark.createDataFrame(site(8), KIND)).collect()}
    assert got["/body/div.top"] == pytest.approx(0)
    texts = 1 - (8 * 0 + 1) / 9  # eight texts of one page each, one of all eight: mean entropy 1 / 9
    assert got["/body/div.txt/p"] == pytest.approx(texts)
    assert got["/body/div.txt"] == pytest.approx(0.9 * texts)  # one child style: (1 - 0.9) * 0 + 0.9 * content


def test_copies_are_one_page(spark):
    rows = [(k, "http://a.example/", site(1)[0][2]) for k in range(30)]
    assert all(r["text"].startswith("Welcome") for r in H.extract(spark.createDataFrame(rows, KIND), ["page_id"]).collect())


def test_articles_are_kept_however_often_they_repeat(spark):
    rows = [(k, "http://a.example/", f"<article><h1>Title {k}</h1><p>the same words</p></article>") for k in range(20)]
    assert all(r["text"] == f"Title {r['page_id']}\nthe same words" for r in H.extract(spark.createDataFrame(rows, KIND), ["page_id"]).collect())


def test_empty_table_and_clashing_names(spark):
    assert H.extract(spark.createDataFrame([], KIND), ["page_id"]).count() == 0
    clash = spark.createDataFrame([(*r, "x") for r in site(6)], KIND + ", host string")
    assert H.extract(clash, ["page_id", "host"]).count() == 6


def test_entropy_of_styles():
    assert math.isclose(sum(-p * math.log(p, 4) for p in [0.25] * 4), 1)


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article><p>a</p><svg viewBox='0 0 1 1'/><p>b</p></article><p><svg></svg></p>", "a\nb"),
        ("<article><div>a<select><option>x</div><p>b</p></article><form><select></select></form>", "a\nb"),
        ("<article><p>a</p><div><iframe src='x'></div><p>b</p></article>", "a\nb"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", "so x=2 holds"),
        ("<h1>Headline</h1><article><p>the body text</p></article>", "Headline\nthe body text"),
        ("<div><p>a whole body of many words</p></div><article><p>small</p></article>", "a whole body of many words\nsmall"),
    ],
)
def test_article_text_isnt_cut(source, text):
    assert H.main_text(source) == text


def test_lead_beside_the_article_stays_in_a_site(spark):
    rows = [(k, "http://a.example/", f"<p class='lead'>lead {k}</p><article><p>body {k} has more text than its lead</p></article>") for k in range(20)]
    found = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()
    assert all(r["text"] == f"lead {r['page_id']}\nbody {r['page_id']} has more text than its lead" for r in found) and len(found) == 20
