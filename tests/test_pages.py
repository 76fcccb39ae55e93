"""Page readers: broken, nested and empty pages; the column form against the tree of nodes."""

import pytest
from pyspark.sql import functions as F

from flagstone.sources import markup, pages

BROKEN = (
    "<h1>N &amp; Co &#8377;&#x41; &eacute; &bogus; R&amp;lt;</h1><section><h2>Quarterly  Results</h2><table class='x data-table'>"
    "<thead><tr><th></th><th>Q1</th></tr></thead><tbody><tr><td>Sales +<td>5<tr><td>Tax</td><td></td></tr></tbody></table></div></section>"
    "<section id=peers><table><tr><th>Name<th>P/E</tr><tr><td>A<td>1</tr><tr><td><td></tr></table></section>"
    '<section id="shareholding"><div id="yearly-shp"><table class="data-table"><tbody><tr><td>No<td>1</table></div><div id="quarterly-shp">'
    '<table class="data-table"><thead><tr><th><th>Jun</thead><tbody><tr><td>Promoters<td>50%</table></div></section>'
    '<ul id="top-ratios"><li><span class="name">PE</span><span class="value"><span class=number>4</span> x</span><li>'
    '<span class="name">ROE</span><span class="number">5</span></ul><div class="company-profile"><p>About it.<br>More<p>x</div>'
    '<div class="pros"><ul><li>a<li>b</ul></div><div><h3>Concalls</h3><ul><li><div>Jan</div><a href="/x?a=1&amp;b=2">T</a><a>no</a></ul></div>'
)
NESTED = (
    '<section id="quarters"><table class="data-table"><tbody><tr><td>Sales<table><tbody><tr><td>in</td><td>9</td></tr></tbody></table></td>'
    "<td>5</td></tr></tbody></table></section>"
)
PAGES = [
    BROKEN, NESTED, None, "", "<", "<p", "a<b>c</b", "</p>x", '<script>var t="</p>"</script><h1>x<script>y</script></h1><!-- <h1>no</h1> -->',
    "<div><section>a</div>b</section>", "<ul><li/>a<li>b</ul>", "<div>" * 700 + "deep" + "</div>" * 300,
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate([*PAGES], 1)), "company_id int, html string").withColumn("url", F.lit("u"))


def test_broken_and_nested_pages(df):
    got = {r["company_id"]: r for r in pages.structure_pages(df).collect()}
    page = got[1]
    assert page["name"] == "N & Co ₹A é &bogus; R&lt;" and page["markup_error"] == "1 end tags without a start, 0 elements without an end"
    assert page["quarters"].asDict(True) == {"periods": ["Q1"], "rows": [{"label": "Sales", "values": ["5"]}, {"label": "Tax", "values": [None]}]}
    assert page["peers"].asDict() == {"columns": ["Name", "P/E"], "rows": [["A", "1"]]}
    assert page["shareholding"].asDict(True) == {"periods": ["Jun"], "rows": [{"label": "Promoters", "values": ["50%"]}]}
    assert page["ratios"] == {"PE": "4 x", "ROE": "5"} and page["about"] == "About it.More" and page["pros"] == ["a", "b"]
    assert [(x["category"], x["group_label"], x["label"], x["href"]) for x in page["links"]] == [("concall", "Jan", "T", "/x?a=1&b=2")]
    assert got[2]["quarters"].asDict(True)["rows"] == [{"label": "Salesin9", "values": ["5"]}]
    for empty in (3, 4):
        assert got[empty]["name"] is None and got[empty]["links"] == [] and got[empty]["markup_error"] is None


def _tree(html):
    tree = pages._Tree(html or "")
    return [(n.tag, n.attrs.get("id", ""), " ".join(n.classes), n.text()) for n in tree.nodes[1:] if n.tag not in ("script", "style")], tree.error


def _columns(df):
    read = markup.with_elements(df)
    text = F.transform("elements", lambda e: F.struct(e["tag"], e["id"], F.trim(e["classes"]), markup.text_of(F.col("tokens"), e)))
    return [([tuple(e) for e in r["e"]], r["markup_error"], r["html"]) for r in read.select(text.alias("e"), "markup_error", "html").collect()]


def test_column_form_has_the_elements_of_the_tree(df):
    for elements, error, html in _columns(df.filter(~F.col("company_id").isin(6, 7))):
        assert (elements, error) == _tree(html), html[:80]


def test_column_form_reads_the_raw_pages_like_the_tree(tables):
    rows = _columns(tables.raw("pages"))
    assert rows
    for elements, error, html in rows:
        assert (elements, error) == _tree(html), html[:80]


def test_comment_without_an_end_goes_to_the_end_of_the_page(spark):
    """The library's parser reads on behind such a comment, so the tree is not asked here."""
    ((elements, error, _),) = _columns(spark.createDataFrame([("<h1>x</h1><!-- <h1>no</h1>",)], "html string"))
    assert elements == [("h1", "", "", "x")] and error is None


def test_many_elements(spark):
    html = "<ul>" + "<li>a <b>b</b>" * 3000 + "</ul>"
    assert [len(e) for e, _, _ in _columns(spark.createDataFrame([(html,)], "html string"))] == [6001]
