"""Date texts by strptime formats, read on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime directives and the pattern letters that read the same text.
DIRECTIVES = {
    "%d": "d",
    "%m": "M",
    "%b": "MMM",
    "%B": "MMMM",
    "%y": "yy",
    "%Y": "yyyy",
    "%j": "D",
    "%H": "H",
    "%I": "h",
    "%p": "a",
    "%M": "m",
    "%S": "s",
    "%f": "SSSSSS",
    "%z": "[XXX][XX]",
    "%Z": "z",
}
PERCENT = chr(0xE0FF)
WEEKDAYS = r"(?i)\b(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?\b[,.]? *"


def date_reader(date_format: Column) -> Column:
    """``struct<pattern, weekday>`` of a strptime format, which may vary by row.

    ``weekday`` says where the format has the name of the day, which the JVM's reader does not take:
    ``first``, ``inside`` or null. A directive without an equivalent is an error when the row is read.
    Work it out on the table of providers, not on their items.
    """
    bare = F.regexp_replace(date_format, r"%[aA][,.]?\s*", "")
    # Directives stand aside as single characters while the letters between them are quoted.
    marked = F.replace(bare, F.lit("%%"), F.lit(PERCENT))
    for k, directive in enumerate(DIRECTIVES):
        marked = F.replace(marked, F.lit(directive), F.lit(chr(0xE000 + k)))
    unknown = F.regexp_extract(marked, "%.?", 0)
    quoted = F.regexp_replace(F.replace(marked, F.lit("'"), F.lit("''")), r"([A-Za-z\[\]{}#']+)", "'$1'")
    for k, pattern in enumerate(DIRECTIVES.values()):
        quoted = F.replace(quoted, F.lit(chr(0xE000 + k)), F.lit(pattern))
    quoted = F.trim(F.regexp_replace(F.replace(quoted, F.lit(PERCENT), F.lit("%")), r"\s+", " "))
    error = F.raise_error(F.concat(F.lit("unknown directive "), unknown, F.lit(" in date format "), date_format))
    weekday = F.when(date_format.rlike("^%[aA]"), "first").when(date_format.rlike("%[aA]"), "inside")
    return F.struct(F.when(unknown != "", error).otherwise(quoted).alias("pattern"), weekday.alias("weekday"))


def read_date(text: Column, reader: Column) -> Column:
    """Timestamp of a text; null when it is not in the reader's format."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    bare = (
        F.when(reader["weekday"] == "first", F.regexp_replace(plain, r"^[^\d\s,]+[,.]? *", ""))
        .when(reader["weekday"] == "inside", F.trim(F.regexp_replace(plain, WEEKDAYS, "")))
        .otherwise(plain)
    )
    return F.try_to_timestamp(bare, reader["pattern"])
