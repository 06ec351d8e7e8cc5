import pytest
from pyspark.sql import functions as F

from curata.functions.html import section_text

PAGE = ('<html><script>var t="</p>";</script><div class="row x" id="abstractSection"><p>Hello <b>big</b>'
        '</p><div>world &amp; all</div><style>p{}</style></div><div class="row">no</div></html>')


@pytest.mark.parametrize("html,tag,attributes,want", [
    (PAGE, "div", {"class": "row", "id": "abstractSection"}, "Hello big world & all"),
    (PAGE, "div", {"id": "abstract"}, None),
    (PAGE, "section", None, None),
    (PAGE, "b", None, "big"),
    (None, "div", None, None),
    ("", "div", None, None),
    ("<DIV><div>a</div>b</DIV>c", "div", None, "a b"),
    ("<p><article id=q>open <i>end", "article", {"id": "q"}, "open end"),
    ('<div title="a > b" class=\'x "main" y\'>no</div><div data-a="</div>>" class="row main"><p title="1>2">in <div>er</div></p>t</div>out', "div", {"class": "main"}, "in er t"),
    ('<div id="a" title="<div><div>">one<div/>two</div>three</div>four', "div", {"id": "a"}, "one two three"),
    ("<p>&#233;t&#xE9; &#8217;q&#x1F600; &#0;&#xD800; &amp;#65; &lt;b&gt; &nbsp;&#160;x &#; &#99999999;</p>", "p", None,
     "\u00e9t\u00e9 \u2019q\U0001F600 \ufffd\ufffd &#65; <b> x &#; &#99999999;"),
    ("<p>a < b and c > d</p>", "p", None, "a d"),
    ("</div><div>x</div>", "div", None, "x"),
    ("<articles>no</articles><article>yes</article>", "article", None, "yes"),
])
def test_section_text(spark, html, tag, attributes, want):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(section_text("h", tag, attributes).alias("t")).first().t == want


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000 + "<p>no</p>"
    many = "<div id='m'>" + "<div>a</div> " * 20_000 + "</div><div>no</div>"
    df = spark.createDataFrame([(1, deep), (2, many)], "id int, h string")
    got = {r.id: r.t for r in df.select("id", section_text("h", "div").alias("t")).collect()}
    assert got[1] == "x" and got[2] == " ".join(["a"] * 20_000)
