"""Column functions over text: tokens, clean-up, small labels. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}-]+"


def literal_strings(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def tokens(text: Column, stops: Iterable[str] = (), synonyms: Mapping[str, str] | None = None) -> Column:
    """Ordered tokens, duplicates kept: runs of letters, digits and hyphens, taken before lower-casing; outer hyphens go,
    inner runs become one; tokens of one byte and of digits only go; then synonyms, then stop words."""
    # most tokens have no hyphen and begin with a plain letter: a look at their bytes spares them the regular expressions
    out = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.when(F.contains(x, F.lit("-")), F.regexp_replace(F.regexp_replace(F.lower(x), r"^-+|-+$", ""), "-{2,}", "-")).otherwise(F.lower(x)))
    out = F.filter(out, lambda x: (F.octet_length(x) > 1) & (((x >= "a") & (x < "{")) | ~x.rlike(r"^[\p{Nd}-]+$")))
    if synonyms:
        table = F.create_map(*[F.lit(s.lower()) for pair in synonyms.items() for s in pair])
        out = F.transform(out, lambda x: F.coalesce(F.element_at(table, x), x))
    listed = sorted({w.lower() for w in stops})
    if listed:
        out = F.filter(out, lambda x: ~x.isin(listed))
    return out


def without_links(text: Column) -> Column:
    """Source marks, author lines and links go, in that order."""
    out = F.regexp_replace(text, r"(?i)\[source:[^\]]*\]", "")
    out = F.regexp_replace(out, r"(?i)author\(s\):[^\n]*", "")
    return F.regexp_replace(out, r"https?://[^\s\"'<>]+", "")


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


#: Comments, and tags whose quoted attributes may hold a >.
TAGS = r"""<!--(?s:.*?)-->|</?[A-Za-z!?](?:[^<>"']|"[^"]*"|'[^']*')*>"""
#: Named entities; &amp; comes last, so that what it makes isn't decoded again.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "hellip": "\u2026", "mdash": "\u2014", "ndash": "\u2013", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb", "bull": "\u2022", "middot": "\u00b7", "times": "\u00d7", "euro": "\u20ac", "pound": "\u00a3", "sect": "\u00a7", "deg": "\u00b0", "amp": "&"}
SPACES = r"[ \t\n\x0B\f\r\x{0085}\x{00A0}]"


def _numbered(text: Column, digits: str, base: int) -> Column:
    """Numeric entities of one base as their characters; U+FFFD for what is none."""
    mark = "x" if base == 16 else ""
    found = F.regexp_extract_all(text, F.lit(f"&#{mark}({digits});"), F.lit(1))

    def char(e: Column) -> Column:
        n = F.coalesce(F.conv(e, base, 10).try_cast("long"), F.lit(0))
        good = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(good, n).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    parts = F.split(text, f"&#{mark}{digits};", -1)
    return F.array_join(F.zip_with(parts, F.transform(found, char), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def stripped_html(html: Column) -> Column:
    """The text nodes joined as they stand, comments and tags gone, entities decoded, ends trimmed; script and style text
    is included as it is."""
    out = F.regexp_replace(html, TAGS, "")
    out = _numbered(_numbered(out, "[0-9]{1,9}", 10), "[0-9A-Fa-f]{1,8}", 16)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(out, f"^{SPACES}+|{SPACES}+$", "")


def labelled(text: Column, rules: Mapping[str, Iterable[str]], default: str) -> Column:
    """The labels of which any keyword is inside the lower-cased text, in the order of the rules; else the default."""
    low = F.lower(text)
    hits = F.filter(F.array(*[F.when(_any(low, words), F.lit(name)) for name, words in rules.items()]), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def _any(low: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def coded(code: Column, prefixes: Mapping[str, str]) -> Column:
    """The name of the first prefix that the code begins with, else the part before its first dot."""
    out = F.element_at(F.split(code, r"\."), 1)
    for prefix, name in reversed(prefixes.items()):
        out = F.when(code.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def story_title(text: Column) -> Column:
    """The first sentence where it ends within 120 characters, else the text."""
    head = F.regexp_extract(text, r"^[^.!?]{1,119}[.!?]", 0)
    return F.when(head != "", head).otherwise(text)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def distinct_words(words: Column) -> Column:
    """The first of each, in order; empty ones go."""
    return F.array_distinct(F.filter(words, lambda x: x != ""))


def digit_share(token: Column) -> Column:
    return F.length(F.regexp_replace(token, r"\P{Nd}", "")) / F.octet_length(token)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def card_id(*parts: Column) -> Column:
    """26 characters that depend on the parts alone."""
    return F.upper(F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(26)))
