"""Text functions."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _ascii_folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII: one letter, or several."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if ord(c) < 128)
        if len(folded) == 1:
            single[char] = folded
        elif folded:
            several[char] = folded
    return single, several


def fold_to_ascii(text: Column) -> Column:
    """Compatibility-decompose, then delete whatever is still not ASCII."""
    single, several = _ascii_folds()
    text = F.translate(text, "".join(single), "".join(single.values()))
    # One literal that folds to a constant array; hundreds of column nodes would slow the planner.
    listed = json.dumps([{"c": k, "f": v} for k, v in several.items()])
    pairs = F.from_json(F.lit(listed), "array<struct<c: string, f: string>>")
    spelled_out = F.reduce(pairs, text, lambda acc, p: F.replace(acc, p["c"], p["f"]))
    # Few texts still hold a non-ASCII character here; only those pay for the longer test.
    odd = text.rlike(r"[^\x00-\x7F]") & text.rlike("[" + "".join(several) + "]")
    return F.regexp_replace(F.when(odd, spelled_out).otherwise(text), r"[^\x00-\x7F]", "")


def slugify(text: Column) -> Column:
    """Lower-case ASCII words joined by single hyphens."""
    dashed = F.regexp_replace(fold_to_ascii(text), "[^a-zA-Z0-9]+", "-")
    return F.lower(F.regexp_replace(dashed, "^-+|-+$", ""))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def non_blank(text: Column) -> Column:
    """As ``blank_to_null``, but a costly ``text`` expression is evaluated once, not twice."""
    return F.get(F.filter(F.array(text), lambda t: t != ""), F.lit(0))


def replace_first(text: Column, find: Column, repl: Column) -> Column:
    """Replace the first occurrence only; ``find`` is literal text and may vary by row."""
    at = F.position(find, text)
    head = F.substr(text, F.lit(1), at - 1)
    tail = F.substr(text, at + F.char_length(find))
    return F.when(at > 0, F.concat(head, repl, tail)).otherwise(text)


def replace_all(text: Column, find: Column, repl: Column) -> Column:
    return F.replace(text, find, repl)


@lru_cache(maxsize=4)
def _decoder(attribute: bool, strict: bool) -> str:
    """SQL lambda that decodes the references of a text. One expression text instead of a hundred column
    nodes: it is parsed on the JVM in one go.

    The names are HTML's, from the standard library, in a map by first letter, which keeps look-ups short;
    names that need no semicolon are tried with the longest first.
    """
    table: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        table.setdefault(name[0], {})[name] = value
    loose = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    # C1 controls are read as Windows-1252.
    western = [bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)]

    def literal(value: object) -> str:
        return "r'" + json.dumps(value).replace("'", "\\u0027") + "'"

    def named(pattern: str) -> str:
        """The part with its name decoded; null if there is no such name."""
        found = f"regexp_extract(p, r'{pattern}', 1)"
        names = f"from_json({literal(table)}, 'map<string, map<string, string>>')"
        decoded = f"try_element_at(try_element_at({names}, left(n, 1)), n)"
        return f"get(transform(array({found}), n -> concat({decoded}, substr(p, length(n) + 2))), 0)"

    number = "regexp_extract(p, r'^&#(?:[xX][0-9a-fA-F]+|[0-9]+);?', 0)"
    sixteen, ten = "regexp_extract(p, r'^&#[xX]0*([0-9a-fA-F]*)', 1)", "regexp_extract(p, r'^&#0*([0-9]*)', 1)"
    # Codes too long for a character are none; they would not fit a number either.
    code = f"""CASE WHEN p RLIKE r'^&#[xX]' THEN CASE WHEN length({sixteen}) BETWEEN 1 AND 6 THEN int(conv({sixteen}, 16, 10)) ELSE 0 END
                    WHEN length({ten}) BETWEEN 1 AND 7 THEN int({ten}) ELSE 0 END"""
    character = f"""CASE WHEN c = 0 OR c > 1114111 OR c BETWEEN 55296 AND 57343 THEN '\ufffd'
                         WHEN c BETWEEN 128 AND 159 THEN get(from_json({literal(western)}, 'array<string>'), c - 128)
                         ELSE decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') END"""
    after = "(?![A-Za-z0-9=])" if attribute else ""
    if strict:
        number = "regexp_extract(p, r'^&#(?:[xX][0-9a-fA-F]+|[0-9]+);', 0)"
    part = f"""CASE WHEN NOT startswith(p, '&') THEN p
                    WHEN {number} <> '' THEN concat(get(transform(array({code}), c -> {character}), 0), substr(p, length({number}) + 1))
                    ELSE coalesce({named("^&([A-Za-z][A-Za-z0-9]*;)")}, {"NULL" if strict else named(f"^&({loose}){after}")}, p) END"""
    return f"t -> CASE WHEN contains(t, '&') THEN array_join(transform(split(t, '(?=&)'), p -> {part}), '') ELSE t END"


def decode_references(text: Column, attribute: bool = False, strict: bool = False) -> Column:
    """Decode named and numeric character references, each once, the longest name first.

    A name without its semicolon counts where HTML allows that. In an attribute (``attribute``) it does
    not if a letter, a digit or ``=`` follows, so ``?a=1&copy=2`` stays. ``strict``: only references with
    their semicolon count, so one that was cut off stays as written. What is no character is U+FFFD.
    Texts without ``&`` are passed on as they are.
    """
    # The text is an expression: as an array element it is worked out once.
    return F.get(F.call_function("transform", F.array(text), F.expr(_decoder(attribute, strict))), F.lit(0))


def unescape_entities(text: Column, attribute: bool = False, strict: bool = False) -> Column:
    """Decoded text of a page; a no-break space becomes a blank."""
    return F.replace(decode_references(text, attribute, strict), F.lit("\xa0"), F.lit(" "))
