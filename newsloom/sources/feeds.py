"""Feed bodies to entries: RSS 2.0, Atom and RSS 1.0, told apart by their root element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name spaces are ignored: ``content`` is media:content (in Atom also the entry's own), ``encoded``
# content:encoded, ``date`` dc:date and ``group`` media:group. Elements that may come twice that way are
# arrays, of which the first with a text counts.
FILE = "struct<_url: string, _type: string>"
GROUP = f"group: array<struct<content: array<{FILE}>>>"
RSS_SCHEMA = f"""
channel struct<item: array<struct<
  title: array<string>, link: array<string>, pubDate: string, date: string, description: array<string>, encoded: string,
  enclosure: array<{FILE}>, content: array<{FILE}>, {GROUP}>>>
"""
ATOM_SCHEMA = f"""
entry array<struct<
  title: array<string>, link: array<struct<_href: string, _rel: string, _type: string>>,
  published: string, updated: string, summary: array<string>,
  content: array<struct<_VALUE: string, _url: string, _src: string, _type: string>>, {GROUP}>>
"""
RDF_SCHEMA = f"""
item array<struct<
  title: array<string>, link: array<string>, date: string, description: array<string>, encoded: string,
  content: array<{FILE}>, {GROUP}>>
"""
OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
#: Local name of the root element and the format that it stands for.
ROOTS = {"rss": "rss", "feed": "atom", "rdf": "rdf"}
PROLOGUE = r"(?s)^\s*﻿?(?:\s+|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>)*+"
NO_FILES = f"array<{FILE}>"


def feed_format(body: Column) -> Column:
    """``rss``, ``atom`` or ``rdf`` by the root element of a body, null for anything else."""
    root = F.lower(F.regexp_extract(body, PROLOGUE + r"<(?:[\w.-]+:)?([\w.-]+)[\s>/]", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ROOTS.items() for x in pair]), root)


def _first(texts: Column) -> Column:
    """First text that isn't blank; else the first one (null when the element is absent)."""
    return F.coalesce(F.get(F.filter(texts, lambda t: F.trim(t) != ""), F.lit(0)), F.get(texts, F.lit(0)))


def _files(files: Column, groups: Column) -> Column:
    """Media files of an item and of its media groups."""
    none = F.array().cast(NO_FILES)
    grouped = F.flatten(F.transform(F.coalesce(groups, F.array().cast(f"array<struct<content: {NO_FILES}>>")), lambda g: F.coalesce(g["content"], none)))
    return F.concat(F.coalesce(files, none), grouped)


def _item(title, link, published, summary, content, enclosures, media) -> Column:
    return F.struct(
        title.alias("title"), link.alias("link"), published.alias("published"), summary.alias("summary"), content.alias("content"),
        F.coalesce(enclosures, F.array().cast(NO_FILES)).alias("enclosures"), media.alias("media"),
    )


def _rss_item(i: Column) -> Column:
    return _item(
        _first(i["title"]), _first(i["link"]), F.coalesce(i["pubDate"], i["date"]), _first(i["description"]), i["encoded"],
        i["enclosure"], _files(i["content"], i["group"]),
    )


def _atom_item(i: Column) -> Column:
    """An entry's link is its first alternate one (no ``rel`` means that), its files are the others."""
    page = F.filter(i["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    attached = F.transform(F.filter(i["link"], lambda x: x["_rel"] == "enclosure"), lambda x: F.struct(x["_href"].alias("_url"), x["_type"].alias("_type")))
    text = F.filter(i["content"], lambda c: c["_url"].isNull() & c["_VALUE"].isNotNull())
    files = F.transform(F.filter(i["content"], lambda c: c["_url"].isNotNull()), lambda c: F.struct(c["_url"].alias("_url"), c["_type"].alias("_type")))
    return _item(
        _first(i["title"]), F.get(page, F.lit(0))["_href"], F.coalesce(i["published"], i["updated"]), _first(i["summary"]),
        F.get(text, F.lit(0))["_VALUE"], attached, _files(files, i["group"]),
    )


def _rdf_item(i: Column) -> Column:
    none = F.array().cast(NO_FILES)
    return _item(_first(i["title"]), _first(i["link"]), i["date"], _first(i["description"]), i["encoded"], none, _files(i["content"], i["group"]))


def parsed_feeds(raw: DataFrame) -> DataFrame:
    """Raw feeds with their ``format`` and ``items``; items are null when the body is not a feed, and
    empty when it is one without entries. Each body is read once, by the schema of its format."""
    known = raw.withColumn("format", feed_format(F.col("body")))

    def read(name: str, schema: str) -> Column:
        return F.when(F.col("format") == name, F.from_xml("body", schema, OPTIONS))

    known = known.withColumns({"_rss": read("rss", RSS_SCHEMA), "_atom": read("atom", ATOM_SCHEMA), "_rdf": read("rdf", RDF_SCHEMA)})
    # A body that is cut off parses to nulls. An RSS body needs a channel; the others are closed if their root is.
    whole = F.col("body").rlike(r"(?s)</(?:[\w.-]+:)?(?:feed|RDF)\s*>(?:\s+|<!--.*?-->)*$|<(?:[\w.-]+:)?(?:feed|RDF)\b[^>]*/>\s*$")
    rss = F.when(F.col("_rss.channel").isNotNull(), F.coalesce(F.transform("_rss.channel.item", _rss_item), F.array()))
    atom = F.when((F.col("format") == "atom") & whole, F.coalesce(F.transform("_atom.entry", _atom_item), F.array()))
    rdf = F.when((F.col("format") == "rdf") & whole, F.coalesce(F.transform("_rdf.item", _rdf_item), F.array()))
    return known.withColumn("items", F.coalesce(rss, atom, rdf)).drop("_rss", "_atom", "_rdf")


def feed_rows(raw: DataFrame) -> DataFrame:
    """One row per item, and one with ``readable`` false for each body that is not a feed; so both come
    from one pass over the bodies."""
    rows = parsed_feeds(raw).select(
        "provider_key", "feed_url", "fetched_at", "format", F.col("items").isNotNull().alias("readable"),
        F.posexplode_outer("items").alias("item_no", "item"),
    )
    return rows.where("item_no IS NOT NULL OR NOT readable").select(
        "provider_key", "feed_url", "fetched_at", "format", "readable", "item_no", "item.title", "item.link", "item.published", "item.summary",
        "item.content", F.coalesce("item.enclosures", F.array().cast(NO_FILES)).alias("enclosures"),
        F.coalesce("item.media", F.array().cast(NO_FILES)).alias("media"),
    )


def parse_feeds(raw: DataFrame) -> DataFrame:
    """One row per feed item, text fields as they stand in the feed."""
    return feed_rows(raw).where("readable").drop("readable", "format")


def quarantined_feeds(raw: DataFrame) -> DataFrame:
    """Bodies that could not be read as a feed; the other feeds of the batch are unaffected."""
    return parsed_feeds(raw).where(F.col("items").isNull()).drop("items", "format")


def quarantined_items(items: DataFrame) -> DataFrame:
    """Items that carry a date text which did not parse (see ``operators.entries.dated``)."""
    return items.where(F.col("published").isNotNull() & F.col("published_at").isNull())
