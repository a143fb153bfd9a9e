"""Markup functions: image tags, attributes, and main-text selection on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import decode_references, non_blank, unescape_entities

COMMENT = "(?s)<!--.*?-->"
IMG_TAG = r"""(?is)<img\b((?:[^>"']+|"[^"]*"|'[^']*')*+)>"""
ATTRIBUTE = r"""(?s)([^\s=>"'/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""

# Elements whose whole content is never article text: code first, as it may quote any markup.
CODE = ("script", "style", "noscript")
FURNITURE = ("nav", "header", "footer", "aside", "title")
BLOCK_TAGS = (
    "p|div|article|section|main|body|html|head|h1|h2|h3|h4|h5|h6|ul|ol|li|table|tr|td|th|"
    "blockquote|pre|figure|figcaption|br|hr|title"
)
LINK = "(?is)<a\\b[^>]*>(.*?)</a>"
MIN_BLOCK_WORDS = 10
MAX_LINK_DENSITY = 0.33


def attribute(tag_body: Column, name: str, decode: bool = True) -> Column:
    """Value of one attribute inside a tag body; null when absent, '' when blank.

    Attributes are read as whole name/value tokens, so a name inside another quoted value is
    never mistaken for the attribute itself. Character references are decoded unless the caller does
    that (``decode``).
    """
    names = F.transform(F.regexp_extract_all(tag_body, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(tag_body, F.lit(ATTRIBUTE), F.lit(2))
    value = F.get(values, (F.array_position(names, F.lit(name)) - 1).cast("int"))
    value = F.regexp_replace(value, "^[\"']|[\"']$", "")
    return decode_references(value, attribute=True) if decode else value


def _without_comments(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def first_img(html: Column) -> Column:
    """``src`` of the first image tag; that tag decides even when it has no ``src``."""
    tags = F.regexp_extract_all(_without_comments(html), F.lit(IMG_TAG), F.lit(1))
    return attribute(F.try_element_at(tags, F.lit(1)), "src")


def all_imgs(html: Column) -> Column:
    """Every non-empty image ``src``, in document order."""
    tags = F.regexp_extract_all(_without_comments(html), F.lit(IMG_TAG), F.lit(1))
    return F.filter(F.transform(tags, lambda t: attribute(t, "src")), lambda s: s.isNotNull() & (s != ""))


def page_title(html: Column, strict: bool = False) -> Column:
    """Text of the title; ``strict`` as in ``decode_references``."""
    raw = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    text = F.trim(unescape_entities(F.regexp_replace(raw, r"\s+", " "), strict=strict))
    return non_blank(text)


def meta_content(html: Column, *names: str) -> Column:
    """``content`` of the first meta tag whose name/property is one of ``names`` (in that order)."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1))

    def content_of(name: str) -> Column:
        def named(tag: Column) -> Column:
            key = F.lower(F.coalesce(attribute(tag, "name", False), attribute(tag, "property", False)))
            return F.coalesce(key == F.lit(name), F.lit(False))

        value = attribute(F.try_element_at(F.filter(tags, named), F.lit(1)), "content", False)
        return non_blank(value)

    found = [content_of(name) for name in names]
    return unescape_entities(F.coalesce(*found), attribute=True)


def visible_text(markup: Column, strict: bool = False) -> Column:
    """Text of a fragment: tags become blanks, entities are decoded, runs of blanks collapse."""
    text = unescape_entities(F.regexp_replace(markup, "(?s)<[^>]*>", " "), strict=strict)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def main_blocks(html: Column, strict: bool = False) -> Column:
    """Article text by shallow text features: keep blocks that are long and not mostly links.

    Code and furniture go first, then the page is cut at block-level tags. A block stays when it
    has at least ``MIN_BLOCK_WORDS`` words and less than ``MAX_LINK_DENSITY`` of them are link text.
    Blocks have their position on the page (``pos``), their ``text`` and that of their ``links``.
    """
    body = _without_comments(html)
    for tags in (CODE, FURNITURE):
        body = F.regexp_replace(body, rf"(?is)<({'|'.join(tags)})\b[^>]*>.*?</\1>", " ")
    blocks = F.split(body, f"(?i)</?(?:{BLOCK_TAGS})\\b[^>]*>")
    measured = F.transform(
        blocks,
        lambda b, pos: F.struct(
            pos.alias("pos"),
            visible_text(b, strict).alias("text"),
            visible_text(F.array_join(F.regexp_extract_all(b, F.lit(LINK), F.lit(1)), " "), strict).alias("links"),
        ),
    )
    return F.filter(
        measured,
        lambda m: (_word_count(m["text"]) >= MIN_BLOCK_WORDS)
        & (_word_count(m["links"]) < MAX_LINK_DENSITY * _word_count(m["text"])),
    )


def main_text(html: Column, strict: bool = False) -> Column:
    """The texts of ``main_blocks``, a line each; null if there are none."""
    return non_blank(F.array_join(main_blocks(html, strict).getField("text"), "\n"))
