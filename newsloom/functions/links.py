"""Link functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolutize(url: Column, base: Column) -> Column:
    """Prefix ``base`` unless the link already starts with ``http``."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(base, url))


def normalize_link(link: Column, base: Column) -> Column:
    """Absolute link with every trailing slash removed."""
    return F.regexp_replace(absolutize(link, base), "/+$", "")


def remove_query_params(url: Column) -> Column:
    """Drop ``?query``, ``#fragment`` and the ``;params`` of the last segment; lower the scheme."""
    bare = F.regexp_replace(url, "(?s)[?#].*$", "")
    bare = F.regexp_replace(bare, "(?s);[^/]*$", "")
    scheme = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.concat(F.lower(scheme), F.substr(bare, F.char_length(scheme) + 1))


def first_srcset(srcset: Column) -> Column:
    """First URL listed in a ``srcset`` attribute (null when the first candidate is blank)."""
    first = F.trim(F.element_at(F.split(srcset, ","), 1))
    url = F.element_at(F.split(first, r"\s+"), 1)
    return F.when(url != "", url)
