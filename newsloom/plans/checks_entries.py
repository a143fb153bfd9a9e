"""Checks: feed parsing, links, dates, recency, exclusion, de-duplication, images."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from newsloom.functions import links, markup, text
from newsloom.operators import entries as E
from newsloom.operators import images, store
from newsloom.plans.driver_views import DriverViews
from newsloom.plans.registry import as_text, check, text_sql
from newsloom.sources import catalog, feeds, tables

ITEMS_PER_FEED = 50

# Entries are taken relative to the newest published time of the scale in use.
PUBLISHED = text_sql("published_at")


def xml_escape(col):
    return F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def raw_feeds(v: DriverViews):
    """RSS bodies written from the articles: up to 50 items per feed; every third item has an
    enclosure, every fifth a relative link, every seventh no date, every eleventh a bad one."""
    a = v.articles().withColumn("k", F.col("id"))
    img = F.concat(F.lit("https://cdn.example/medium/"), F.col("id").cast("string"), F.lit("/medium.jpg"))
    date = F.when(F.col("id") % 11 == 0, F.lit("<pubDate>yesterday</pubDate>")).otherwise(
        F.concat(F.lit("<pubDate>Mon, "), F.date_format("published_at", "d MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>"))
    )
    link = F.when(F.col("id") % 5 == 0, F.concat(F.lit("/"), F.col("id").cast("string"), F.lit("//"))).otherwise(F.col("url"))
    item = F.concat(
        F.lit("<item><title>"), xml_escape(F.col("title")),
        F.lit("</title><link>"), link, F.lit("</link>"),
        F.when(F.col("id") % 7 == 0, F.lit("")).otherwise(date),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit('<enclosure url="'), img, F.lit('" type="image/jpeg"/>'))).otherwise(F.lit("")),
        F.lit('<description>&lt;img src="'), img, F.lit('"&gt;</description></item>'),
    )
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))), lambda s: s["x"]), "")
    return (
        a.groupBy(F.col("news_provider_key").alias("provider_key"), F.floor(F.col("id") / ITEMS_PER_FEED).alias("feed_no"))
        .agg(items.alias("items"))
        .select(
            "provider_key",
            F.concat(F.lit("https://"), "provider_key", F.lit(".example/rss/"), F.col("feed_no").cast("string")).alias("feed_url"),
            F.lit("2024-02-01 00:00:00").cast("timestamp").alias("fetched_at"),
            # Every thirteenth feed is cut off and must not hurt the others.
            F.when(F.col("feed_no") % 13 == 12, F.concat(F.lit("<rss><channel>"), "items"))
            .otherwise(F.concat(F.lit('<rss version="2.0"><channel><title>feed</title>'), "items", F.lit("</channel></rss>")))
            .alias("body"),
        )
    )


FEED_ITEMS_SQL = r"""
, items AS (
  SELECT *, trim(title) AS feed_title,
         'https://cdn.example/medium/' || id || '/medium.jpg' AS img,
         CASE WHEN id % 5 = 0 THEN '/' || id || '//' ELSE url END AS feed_link
  FROM articles WHERE (id // 50) % 13 <> 12)
"""


@check("parse_feeds", "articles clock", FEED_ITEMS_SQL + """
SELECT news_provider_key AS provider_key, nullif(feed_title, '') AS title, feed_link AS link,
       CASE WHEN id % 3 = 0 THEN img END AS enclosure,
       CASE WHEN id % 7 = 0 THEN 'none' WHEN id % 11 = 0 THEN 'bad' ELSE 'dated' END AS date_kind
FROM items""")
def parse_feeds(v):
    items = feeds.parse_feeds(raw_feeds(v))
    return items.select(
        "provider_key",
        F.nullif(F.trim("title"), F.lit("")).alias("title"),
        "link",
        F.get("enclosures", F.lit(0))["_url"].alias("enclosure"),
        F.when(F.col("published").isNull(), "none").when(F.col("published") == "yesterday", "bad").otherwise("dated").alias("date_kind"),
    )


@check("quarantined_feeds", "articles", """
SELECT news_provider_key AS provider_key, 'https://' || news_provider_key || '.example/rss/' || (id // 50) AS feed_url
FROM articles WHERE (id // 50) % 13 = 12 GROUP BY ALL""")
def quarantined_feeds(v):
    return feeds.quarantined_feeds(raw_feeds(v)).select("provider_key", "feed_url")


@check("dated_entries", "articles clock", FEED_ITEMS_SQL + f"""
SELECT regexp_replace(CASE WHEN id % 5 = 0 THEN 'https://' || news_provider_key || '.example' || feed_link
                           ELSE feed_link END, '/+$', '') AS link,
       {text_sql("CASE WHEN id % 7 = 0 THEN now WHEN id % 11 = 0 THEN NULL ELSE published_at END")} AS published_at
FROM items, clock""")
def dated_entries(v):
    items = feeds.parse_feeds(raw_feeds(v))
    out = E.dated(items, v.providers(), v.now())
    return out.select("link", as_text("published_at").alias("published_at"))


@check("quarantined_items", "articles", FEED_ITEMS_SQL + """
SELECT news_provider_key AS provider_key, count(*) AS bad_dates FROM items
WHERE id % 7 <> 0 AND id % 11 = 0 GROUP BY 1""")
def quarantined_items(v):
    dated = E.dated(feeds.parse_feeds(raw_feeds(v)), v.providers(), v.now())
    return feeds.quarantined_items(dated).groupBy("provider_key").agg(F.count("*").alias("bad_dates"))


IMAGE_RULES = [
    ("src0", "enclosures", None, "medium", "large", True, None, 1),
    ("src1", "summary_first", None, None, None, False, None, 1),
    ("src2", "summary_all", None, "medium", "large", False, None, 1),
    ("src2", "enclosures", None, None, None, False, None, 2),
    ("src3", "media", None, None, None, False, None, 1),
]


@check("feed_images", "articles", FEED_ITEMS_SQL + """
SELECT news_provider_key AS provider_key, feed_link AS link,
  coalesce(CASE news_provider_key
    WHEN 'src0' THEN CASE WHEN id % 3 = 0 THEN replace(img, '/medium/', '/large/') END
    WHEN 'src1' THEN img
    WHEN 'src2' THEN replace(img, 'medium', 'large') || CASE WHEN id % 3 = 0 THEN ' ' || img ELSE '' END
    WHEN 'src3' THEN NULL
    ELSE CASE WHEN id % 3 = 0 THEN img END END, '') AS images
FROM items""")
def feed_images(v):
    rules = catalog.image_rules(v.spark, IMAGE_RULES)
    items = images.feed_images(feeds.parse_feeds(raw_feeds(v)), rules)
    return items.select("provider_key", "link", F.array_join("image_urls", " ").alias("images"))


@check("process_entries", "articles providers clock", FEED_ITEMS_SQL + f"""
, dated AS (
  SELECT id, news_provider_key AS provider_key,
         regexp_replace(CASE WHEN id % 5 = 0 THEN p.url || feed_link ELSE feed_link END, '/+$', '') AS link,
         CASE WHEN id % 7 = 0 THEN now WHEN id % 11 = 0 THEN NULL ELSE published_at END AS published_at,
         window_days, now, feed_title
  FROM items JOIN providers p ON p.key = news_provider_key, clock)
SELECT provider_key, link, {PUBLISHED} AS published_at FROM dated
WHERE published_at > now - window_days * INTERVAL 1 DAY
  AND NOT (provider_key = 'src7' AND starts_with(feed_title, 'T'))
  AND link NOT IN (SELECT url FROM articles WHERE id % 4 = 0)""")
def process_entries(v):
    rules = catalog.exclusion_rules(v.spark, [("src7", "title", "T")])
    stored = v.articles().where("id % 4 = 0")
    out = E.process_entries(feeds.parse_feeds(raw_feeds(v)), v.providers(), rules, stored, v.now())
    return out.select("provider_key", "link", as_text("published_at").alias("published_at"))


@check("normalize_link", "", r"""
SELECT page_id, regexp_replace(CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://host.example' || url END, '/+$', '') AS link
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '//' ELSE regexp_replace(url, '^https?://[^/]+', '') END AS url FROM pages)""")
def normalize_link(v):
    relative = F.regexp_replace("url", "^https?://[^/]+", "")
    link = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("//"))).otherwise(relative)
    return v.table("pages").select("page_id", links.normalize_link(link, F.lit("https://host.example")).alias("link"))


@check("remove_query_params", "", r"""
SELECT page_id, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))
       || substr(bare, length(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) + 1) AS url
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', '') AS bare FROM pages)""")
def remove_query_params(v):
    return v.table("pages").select("page_id", links.remove_query_params(F.col("url")).alias("url"))


@check("slugify_titles", "articles", r"""
SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g'),
       '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM articles""")
def slugify_titles(v):
    return v.articles().select("id", text.slugify(F.col("title")).alias("slug"))


# Page markup with images, written from the page tables (the pages hold none of their own).
IMG_HTML_SQL = """(SELECT page_id, html || '<p><img alt="a>b" class="x" SRC=''' || url || '?a=1&amp;b=2''><img alt="src=no">'
  || '<img src="' || url || '/two.jpg"></p>' AS doc, url FROM pages)"""


def img_html():
    return F.concat(
        "html", F.lit('<p><img alt="a>b" class="x" SRC=\''), "url", F.lit("?a=1&amp;b=2'><img alt=\"src=no\">"),
        F.lit('<img src="'), "url", F.lit('/two.jpg"></p>'),
    )


@check("first_img", "", f"SELECT page_id, url || '?a=1&b=2' AS img FROM {IMG_HTML_SQL}")
def first_img(v):
    return v.table("pages").select("page_id", markup.first_img(img_html()).alias("img"))


@check("all_imgs", "", f"SELECT page_id, url || '?a=1&b=2 ' || url || '/two.jpg' AS imgs FROM {IMG_HTML_SQL}")
def all_imgs(v):
    return v.table("pages").select("page_id", F.array_join(markup.all_imgs(img_html()), " ").alias("imgs"))


@check("replace_text", "", """
SELECT doc_id, CASE WHEN strpos(text, 'on') > 0
         THEN left(text, strpos(text, 'on') - 1) || 'ON' || substr(text, strpos(text, 'on') + 2) ELSE text END AS first_only,
       replace(text, 'on', 'ON') AS everywhere FROM documents""")
def replace_text(v):
    find, repl = F.lit("on"), F.lit("ON")
    return v.table("documents").select(
        "doc_id",
        text.replace_first(F.col("text"), find, repl).alias("first_only"),
        text.replace_all(F.col("text"), find, repl).alias("everywhere"),
    )


@check("first_srcset", "", """
SELECT page_id, url AS src FROM pages""")
def first_srcset(v):
    srcset = F.concat(F.lit("  "), "url", F.lit(" 8192w, "), "url", F.lit("/s 300w"))
    return v.table("pages").select("page_id", links.first_srcset(srcset).alias("src"))


@check("absolutize", "", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://host.example/img/' || page_id END AS src FROM pages""")
def absolutize(v):
    src = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/img/"), F.col("page_id").cast("string")))
    return v.table("pages").select("page_id", links.absolutize(src, F.lit("https://host.example")).alias("src"))


@check("media_urls", "", """
SELECT page_id, url || '/e.jpg' AS enclosures, url || '/m.jpg ' || url || '/m.mp4' AS media, url || '/m.jpg' AS media_images FROM pages""")
def media_urls(v):
    def item(suffix, kind):
        return F.struct(F.concat("url", F.lit(suffix)).alias("_url"), F.lit(kind).alias("_type"))

    media = F.array(item("/m.jpg", "image/jpeg"), item("/m.mp4", "video/mp4"))
    return v.table("pages").select(
        "page_id",
        F.array_join(images.enclosure_urls(F.array(item("/e.jpg", "image/jpeg"))), " ").alias("enclosures"),
        F.array_join(images.media_urls(media), " ").alias("media"),
        F.array_join(images.media_image_urls(media), " ").alias("media_images"),
    )


@check("page_images", "", """
SELECT url, CASE page_id % 4 WHEN 0 THEN url || '/lead.jpg' WHEN 1 THEN 'https://host.example/box/' || page_id
                             WHEN 2 THEN url || '/big.jpg' ELSE '' END AS images FROM pages""")
def page_images(v):
    """Whole pages through the selector rules; the figure is appended to each page."""
    n = F.col("page_id").cast("string")
    figure = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<figure class="a lead"><br><img src="'), "url", F.lit('/lead.jpg"></figure>')))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit('<div class="box"><i data-href="/box/'), n, F.lit('"></i></div>')))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit('<img class="thumb" srcset="'), "url", F.lit('/big.jpg 900w, small.jpg 90w">')))
        .otherwise(F.lit('<figure class="lead"></figure><img src="outside.jpg">'))
    )
    pages = v.table("pages").select(
        "url", F.concat(F.lit("kind"), (F.col("page_id") % 4).cast("string")).alias("provider_key"), F.concat("html", figure).alias("html")
    )
    rules = [
        ("kind0", "page", "figure.lead >> img@src", None, None, False, None, 1),
        ("kind1", "page", ".box >> i@data-href | .box >> img@src", None, None, False, "https://host.example", 1),
        ("kind2", "page", "img.thumb@srcset:first", None, None, False, None, 1),
        ("kind3", "page", "figure.lead >> img@src", None, None, False, None, 1),
    ]
    frame = catalog.image_rules(v.spark, rules)
    return images.page_images(pages, frame).select("url", F.array_join("image_urls", " ").alias("images"))


@check("page_image_rules", "", """
SELECT url, 'https://host.example/small/' || page_id || '/small.jpg https://host.example/big/' || page_id || '/small.jpg'
            || CASE WHEN page_id % 2 = 0 THEN ' ' || url || '/lead.jpg' ELSE '' END AS images FROM pages""")
def page_image_rules(v):
    """Four rules of one provider on each page: in order, rewritten everywhere or once, made absolute, repeated."""
    n = F.col("page_id").cast("string")
    figure = F.concat(
        F.lit('<div class="box"><i data-href="/big/'), n, F.lit('/big.jpg"></i></div>'),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<figure class="lead"><img src="'), "url", F.lit('/lead.jpg"></figure>'))).otherwise(F.lit("")),
    )
    pages = v.table("pages").select("url", F.lit("kind0").alias("provider_key"), F.concat("html", figure).alias("html"))
    rules = [
        ("kind0", "page", "figure.lead >> img@src", None, None, False, None, 3),
        ("kind0", "page", ".box >> i@data-href", "/big.jpg", "/small.jpg", True, "https://host.example", 2),
        ("kind0", "page", ".box >> i@data-href", "big", "small", False, "https://host.example", 1),
        ("kind0", "page", "figure.lead >> img@src", None, None, False, None, 4),
    ]
    return images.page_images(pages, catalog.image_rules(v.spark, rules)).select("url", F.array_join("image_urls", " ").alias("images"))


@check("parse_published", "articles", f"SELECT id, {PUBLISHED} AS published_at FROM articles")
def parse_published(v):
    zone = F.when(F.col("id") % 2 == 0, F.lit("%a, %d %b %Y %H:%M:%S %z")).otherwise(F.lit("%a, %d %b %Y %H:%M:%S %Z"))
    written = F.concat(
        F.lit("Thu, "), F.date_format("published_at", "d MMM yyyy HH:mm:ss"),
        F.when(F.col("id") % 2 == 0, F.lit(" +0000")).otherwise(F.lit(" GMT")),
    )
    return v.articles().select("id", as_text(E.parse_published(written, zone, F.col("published_at"))).alias("published_at"))


@check("is_recent", "articles providers entries clock", f"""
SELECT e.id, link, {text_sql("e.published_at")} AS published_at FROM entries e JOIN providers p ON p.key = provider_key, clock
WHERE e.published_at > now - window_days * INTERVAL 1 DAY""")
def is_recent(v):
    out = E.is_recent(v.entries(), v.providers(), v.now())
    return out.select("id", "link", as_text("published_at").alias("published_at"))


@check("provider_plugins", "articles entries", """
SELECT id, CASE provider_key WHEN 'src1' THEN title || ' (src1)' WHEN 'src2' THEN 'src2: ' || title ELSE title END AS title,
       CASE WHEN provider_key = 'src1' THEN replace(link, 'https:', 'http:') ELSE link END AS link
FROM entries WHERE NOT (provider_key = 'src2' AND starts_with('src2: ' || title, 'src2: T'))""")
def provider_plugins(v):
    """Column functions of two providers, and a condition that sees what they made."""
    own = {
        "src1": {"title": F.concat("title", F.lit(" (src1)")), "link": F.replace("link", F.lit("https:"), F.lit("http:"))},
        "src2": {"title": F.concat(F.lit("src2: "), "title")},
    }
    out = E.exclude_where(E.rewrite_where(v.entries(), own), {"src2": F.startswith(F.col("title"), F.lit("src2: T"))})
    return out.select("id", "title", "link")


@check("exclude_entries", "articles entries", """
SELECT id, link FROM entries
WHERE NOT ((provider_key = 'src1' AND (starts_with(title, 'T') OR starts_with(title, 'A')))
        OR (provider_key = 'src2' AND starts_with(link, 'https://')))""")
def exclude_entries(v):
    rules = catalog.exclusion_rules(v.spark, [("src1", "title", "T"), ("src1", "title", "A"), ("src2", "link", "https://")])
    return E.exclude(v.entries(), rules).select("id", "link")


@check("exclude_where", "articles entries", """
SELECT id, link FROM entries WHERE NOT (provider_key = 'src3' AND length(title) < 40)""")
def exclude_where(v):
    return E.exclude_where(v.entries(), {"src3": F.char_length("title") < 40}).select("id", "link")


@check("clamp_future", "articles entries clock", f"""
SELECT id, {text_sql("least(published_at, now - INTERVAL 3 DAY)")} AS published_at FROM entries, clock""")
def clamp_future(v):
    out = E.clamp_future(v.entries(), v.now() - F.lit(timedelta(days=3)))
    return out.select("id", as_text("published_at").alias("published_at"))


@check("select_providers", "providers", "SELECT key, rank FROM providers WHERE key IN ('src2', 'src5')")
def select_providers(v):
    return E.select_providers(v.providers(), ["src5", "src2", "src5"]).select("key", "rank")


@check("distinct_links", "articles entries", f"""
SELECT link, first.p AS provider_key, {text_sql("first.t")} AS published_at
FROM (SELECT link, min({{'t': published_at, 'p': provider_key}}) AS first FROM entries GROUP BY link)""")
def distinct_links(v):
    out = E.distinct_links(v.entries())
    return out.select("link", "provider_key", as_text("published_at").alias("published_at"))


@check("new_only", "articles entries", """
SELECT id, link FROM entries e
WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = e.link AND p.page_id % 3 = 0)""")
def new_only(v):
    stored = v.table("pages").where("page_id % 3 = 0").select("url")
    return E.new_only(v.entries(), stored).select("id", "link")


@check("with_provider", "articles providers entries", """
SELECT e.id, e.link, p.rank AS provider_rank, p.bias_rating AS provider_bias_rating
FROM entries e JOIN providers p ON p.key = e.provider_key""")
def with_provider(v):
    return E.with_provider(v.entries(), v.providers()).select("id", "link", "provider_rank", "provider_bias_rating")


@check("url_difference", "articles entries", """
SELECT link FROM entries EXCEPT SELECT url FROM pages WHERE page_id % 3 = 0""")
def url_difference(v):
    return E.url_difference(v.entries(), v.table("pages").where("page_id % 3 = 0"))


@check("read_pages", "", "SELECT url, html FROM pages")
def read_pages(v):
    return tables.read_pages(v.spark, f"{v.dir}/pages.parquet")


@check("scan_articles", "articles clock", f"""
SELECT id, title, {PUBLISHED} AS published_at FROM articles, clock WHERE published_at > now - INTERVAL 5 DAY
ORDER BY articles.published_at DESC, id LIMIT 100""")
def scan_articles(v):
    out = tables.scan_articles(v.articles(), ("id", "title", "published_at"), v.now() - F.lit(timedelta(days=5)), 100)
    return out.withColumn("published_at", as_text("published_at"))


@check("read_parquet", "", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents")
def read_parquet(v):
    docs = tables.read_parquet(v.spark, f"{v.dir}/documents.parquet")
    return docs.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@check("changed_objects", "", """
SELECT 'doc/' || doc_id AS key, md5(text) AS md5 FROM documents
WHERE doc_id % 5 = 0 OR doc_id % 3 = 0""")
def changed_objects(v):
    """Hashed rows against a remote listing: every fifth object is missing, every third is stale."""
    key = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key")
    local = v.table("documents").select(key, F.md5("text").alias("md5"))
    etag = F.when(F.col("doc_id") % 3 == 0, F.lit("stale")).otherwise(F.md5("text"))
    remote = v.table("documents").where("doc_id % 5 <> 0").select(key, F.concat(F.lit('"'), etag, F.lit('"')).alias("etag"))
    return tables.changed_objects(local, remote).select("key", "md5")


@check("service_name", "", """
SELECT event_id, regexp_extract('/' || event_type || '/' || user_id, '^/(.*)$', 1) AS service FROM events""")
def service_name(v):
    from newsloom.operators.monitor import service_name as capture

    container = F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    return v.table("events").select("event_id", capture(container).alias("service"))


@check("json_field", "", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(v):
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@check("publishing_frequency", "articles", """
SELECT news_provider_key, strftime(date_trunc('day', published_at), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS articles
FROM articles GROUP BY 1, 2""")
def publishing_frequency(v):
    return store.publishing_frequency(v.articles()).withColumn("bucket", as_text("bucket"))
