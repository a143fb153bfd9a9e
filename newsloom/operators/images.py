"""Image rules: which image URLs belong to a feed entry or a page, driven by a rule table."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.links import absolutize, remove_query_params
from newsloom.functions.markup import all_imgs, first_img
from newsloom.functions.text import replace_first

# Elements that never have an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


def enclosure_urls(enclosures: Column) -> Column:
    return F.filter(F.transform(enclosures, lambda e: e["_url"]), lambda u: u.isNotNull())


def media_urls(media: Column) -> Column:
    return F.filter(F.transform(media, lambda m: m["_url"]), lambda u: u.isNotNull())


def media_image_urls(media: Column) -> Column:
    """URLs of the media items whose type starts with ``image``."""
    return media_urls(F.filter(media, lambda m: m["_type"].startswith("image")))


def rewritten(urls: Column, find: Column, repl: Column, first_only: Column) -> Column:
    """Literal rewrite of every URL: all occurrences, or the first one only."""
    return F.transform(
        urls,
        lambda u: F.when(find.isNull(), u)
        .when(first_only, replace_first(u, find, repl))
        .otherwise(F.replace(u, find, repl)),
    )


def _single(url: Column) -> Column:
    return F.filter(F.array(url), lambda u: u.isNotNull() & (u != ""))


def feed_images(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``image_urls`` to feed items; providers without a feed rule use their enclosures.

    A provider's rules fold into one ordered array, so each item is joined once and its rules run
    inside one expression.
    """
    fields = ["order", "source", "find", "repl", "first_only", "prefix"]
    folded = (
        rules.where("source <> 'page'")
        .groupBy("provider_key")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rules"))
    )
    enclosures, media = F.col("enclosures"), F.col("media")

    def urls_of(rule: Column) -> Column:
        source = rule["source"]
        found = (
            F.when(source == "enclosures", enclosure_urls(enclosures))
            .when(source == "media", media_urls(media))
            .when(source == "media_images", media_image_urls(media))
            .when(source == "summary_all", all_imgs(F.col("summary")))
            .when(source == "summary_first", _single(first_img(F.col("summary"))))
            .when(source == "content_first", _single(remove_query_params(first_img(F.col("content")))))
        )
        found = rewritten(F.coalesce(found, F.array()), rule["find"], rule["repl"], rule["first_only"])
        return F.when(rule["prefix"].isNull(), found).otherwise(
            F.transform(found, lambda u: absolutize(u, rule["prefix"]))
        )

    untyped = F.exists(media, lambda m: m["_type"].isNull()) & F.exists(
        "_rules", lambda r: r["source"] == "media_images"
    )
    urls = (
        F.when(F.col("_rules").isNull(), enclosure_urls(enclosures))
        .when(untyped, F.array().cast("array<string>"))
        .otherwise(F.flatten(F.transform("_rules", urls_of)))
    )
    return items.join(folded, "provider_key", "left").withColumn("image_urls", urls).drop("_rules")


class _Elements(HTMLParser):
    """Flat element list with parent links; enough for first-match selectors."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, dict[str, str | None], int]] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.nodes.append((tag, dict(attrs), self.open[-1] if self.open else -1))
        if tag not in VOID_TAGS:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.nodes.append((tag, dict(attrs), self.open[-1] if self.open else -1))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]][0] == tag:
                del self.open[depth:]
                return

    def first(self, step: str, scope: int) -> int:
        tag, _, css_class = step.partition(".")
        for at in range(scope + 1, len(self.nodes)):
            name, attrs, parent = self.nodes[at]
            if scope >= 0 and parent < scope:
                return -1
            if (not tag or name == tag) and (
                not css_class or css_class in (attrs.get("class") or "").split()
            ):
                return at
        return -1


def _picked(page: _Elements, selector: str) -> str | None:
    for alternative in selector.split(" | "):
        path, _, attr = alternative.strip().partition("@")
        attr, _, first_of_set = attr.partition(":")
        at = -1
        for step in path.split(" >> "):
            at = page.first(step.strip(), at)
            if at < 0:
                break
        if at >= 0:
            value = page.nodes[at][1].get(attr) or None
            if value and first_of_set:
                value = (value.split(",")[0].split() or [None])[0]
            return value
    return None


def select_image(html: str, selector: str) -> str | None:
    """Value picked by ``a >> b@attr | c@attr``: ``>>`` narrows to the first match inside the
    previous one, the first alternative whose element exists decides, ``:first`` takes the first
    URL of a srcset."""
    page = _Elements()
    page.feed(html)
    return _picked(page, selector)


def page_images(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, image_urls`` of pages[url, provider_key, html] whose provider has page rules.

    A provider's page rules fold into one ordered list, so a page is joined, sent to Python (in Arrow
    batches) and parsed once, and gives one row with the images of its rules in their ``order``. What a
    rule picks is rewritten (``find``, ``repl``, ``first_only``) and then made absolute (``prefix``), as
    with feed rules; rules that pick nothing add nothing, and an image that several pick is listed once.
    """
    fields = ["order", "selector", "find", "repl", "first_only", "prefix"]
    wanted = rules.where("source = 'page'").groupBy("provider_key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rules"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            picked = []
            for html, selectors in zip(batch["html"], batch["selectors"]):
                page = _Elements()
                page.feed(html or "")
                picked.append([_picked(page, s) for s in selectors])
            yield pd.DataFrame({"url": batch["url"], "provider_key": batch["provider_key"], "picked": picked})

    found = (
        pages.join(wanted, "provider_key")
        .select("url", "provider_key", "html", F.col("_rules.selector").alias("selectors"))
        .mapInPandas(pick, "url string, provider_key string, picked array<string>")
    )

    def image(pair: Column) -> Column:
        rule = pair["_rules"]
        url = F.get(rewritten(_single(pair["picked"]), rule["find"], rule["repl"], rule["first_only"]), F.lit(0))
        return F.when(rule["prefix"].isNull(), url).otherwise(absolutize(url, rule["prefix"]))

    # The rules are few and were folded for the join already; they come back by the provider.
    images = F.transform(F.arrays_zip("_rules", "picked"), image)
    urls = F.array_distinct(F.filter(images, lambda u: u.isNotNull() & (u != "")))
    return found.join(wanted, "provider_key").select("url", urls.alias("image_urls"))
