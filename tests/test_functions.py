import pytest
from pyspark.sql import functions as F

from newsloom.functions import links, markup, text


def evaluate(spark, column, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r[0] for r in df.select("i", column.alias("y")).orderBy("i").select("y").collect()]


def test_first_img(spark):
    got = evaluate(
        spark,
        markup.first_img(F.col("x")),
        '<div><img width=9 src="https://pics.test/a.png" height="4"><img src="https://pics.test/b.png"></div>',
        '<figure><img alt="čez cesto" class="wide" src=\'/c/1,2;3.webp\'/><figcaption>Pot čez goro</figcaption></figure>',
        "text <b>with tags</b> and no picture",
        "",
        '<img alt="no source"><img src="second.jpg">',
        '<!-- <img src="hidden.jpg"> --><img alt="a src=x > b" SRC=\'real.jpg?a=1&amp;b=2\'>',
        '<img data-src="lazy.jpg" src=plain.jpg>',
    )
    assert got == [
        "https://pics.test/a.png",
        "/c/1,2;3.webp",
        None,
        None,
        None,
        "real.jpg?a=1&b=2",
        "plain.jpg",
    ]


def test_all_imgs(spark):
    got = evaluate(spark, markup.all_imgs(F.col("x")), '<img src="a"><img><IMG src="b"/><img src="">', "none")
    assert got == [["a", "b"], []]


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://news.test/a/b.html?utm=1", "http://news.test/a/b.html"),
        ("http://news.test/?x=1&y=&z", "http://news.test/"),
        ("http://news.test/plain/", "http://news.test/plain/"),
        ("http://news.test/s?q=a%20b#part", "http://news.test/s"),
        ("http://user@news.test:81/p?q", "http://user@news.test:81/p"),
        ("HTTPS://Example.com/a;b/c;d=1?x", "https://Example.com/a;b/c"),
        ("/relative path/x?y", "/relative path/x"),
    ],
)
def test_remove_query_params(spark, url, want):
    assert evaluate(spark, links.remove_query_params(F.col("x")), url) == [want]


def test_slugify(spark):
    got = evaluate(
        spark,
        text.slugify(F.col("x")),
        "Žetev na Šentjurskem: čas & delo!",
        "a–b",
        "Đuro łączy",
        "ﬁnale ½ … Ⅻ",
        "  --Hello--  ",
        "🎉 party 🎉",
        "",
        None,
    )
    assert got == ["zetev-na-sentjurskem-cas-delo", "ab", "uro-aczy", "finale-12-xii", "hello", "party", "", None]


def test_normalize_link(spark):
    got = evaluate(spark, links.normalize_link(F.col("x"), F.lit("https://b.si")), "/a//", "http://c.si/", "x")
    assert got == ["https://b.si/a", "http://c.si", "https://b.six"]


def test_replace_first_is_literal(spark):
    got = evaluate(spark, text.replace_first(F.col("x"), F.lit("a.b"), F.lit("$1")), "xa.ba.b", "axb", "a.b", "")
    assert got == ["x$1a.b", "axb", "$1", ""]


def test_first_srcset(spark):
    got = evaluate(spark, links.first_srcset(F.col("x")), " big.jpg 900w, small.jpg 90w", "only.jpg", " , b 1x")
    assert got == ["big.jpg", "only.jpg", None]


def test_main_text(spark):
    words = "one two three four five six seven eight nine ten"
    page = (
        f"<html><head><title>T</title><script>var t='<p>{words}</p>';</script></head><body>"
        f"<nav><p>{words}</p></nav><p>{words} &amp; more<br>short</p>"
        f'<div><a href="#">{words}</a></div><!-- <p>{words}</p> --><p>{words} <a>link</a></p></body></html>'
    )
    assert evaluate(spark, markup.main_text(F.col("x")), page, "<p>short</p>") == [
        f"{words} & more\n{words} link",
        None,
    ]


def test_meta_content(spark):
    page = '<meta charset="utf-8"><META Property="Article:Published_Time" content="2024-01-01"><meta name=author content="A &amp; B">'
    assert evaluate(spark, markup.meta_content(F.col("x"), "author"), page, "<p>") == ["A & B", None]
    assert evaluate(spark, markup.meta_content(F.col("x"), "nothing", "article:published_time"), page) == ["2024-01-01"]


def test_references_that_were_cut_off_stay_when_strict(spark):
    words = "word " * 12
    html = f"<title>A &amp; B&amp</title><p>{words}&lt;b&#62; &#6 &amp &copyx &nbsp;end&amp</p>"
    row = spark.createDataFrame([(html,)], "html string").select(
        markup.page_title(F.col("html"), strict=True).alias("strict"), markup.page_title(F.col("html")).alias("loose"),
        markup.main_text(F.col("html"), strict=True).alias("text"),
    ).first()
    assert (row.strict, row.loose) == ("A & B&amp", "A & B&")
    assert row.text == f"{words}<b> &#6 &amp &copyx end&amp"
