"""Text functions on Columns, with ECMAScript's notions of white space and of length where they differ from the JVM's and Spark's.

Patterns that look for the end of a text start where a run starts and give nothing back, so long runs inside a text cost no more than others.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ECMAScript's white space, as the inside of a character class.
JS_SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{JS_SPACE}]"
_OTHER_SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def plain_spaces(x: Column) -> Column:
    """With a plain space for each white space that the JVM's regular expressions do not count as such; one for one."""
    return F.translate(x, _OTHER_SPACES, " " * len(_OTHER_SPACES))


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"\A{S}++|(?<!{S}){S}++\z", "")


def units(x: Column) -> Column:
    """The length in UTF-16 units: characters beyond the basic plane are two."""
    plain = F.octet_length(x) == F.length(x)
    return F.when(plain, F.length(x)).otherwise((F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int"))


def first_units(x: Column, most: int) -> Column:
    """The first so many UTF-16 units; half a character is left out."""
    code = F.encode(x, "UTF-16BE")
    # The last unit's first byte tells whether it is the first half of a character.
    half = F.hex(F.substring(code, 2 * most - 1, 1)).between("D8", "DB")
    cut = F.substring(code, 1, F.when(half, 2 * most - 2).otherwise(2 * most)) if most else F.substring(code, 1, 0)
    return F.when(F.octet_length(x) <= most, x).when(F.octet_length(x) == F.length(x), F.substring(x, 1, most)).otherwise(F.decode(cut, "UTF-16BE"))


def clean_phrase(x: Column) -> Column:
    """Trims, drops closing punctuation and opening quotes or brackets, and makes each run of white space one space."""
    x = F.regexp_replace(js_trim(x), r"(?<![.,!?;:()\"'])[.,!?;:()\"']++\z", "")
    x = F.regexp_replace(x, r"\A['\"(]+", "")
    return js_trim(F.regexp_replace(x, f"{S}+", " "))


def title_case(x: Column) -> Column:
    """Lower case, then the first character of each part between single spaces in upper case."""
    return F.initcap(x)


def contains_either(a: Column, b: Column) -> Column:
    """Whether one of two texts holds the other, whatever their case."""
    a, b = F.lower(a), F.lower(b)
    return F.contains(a, b) | F.contains(b, a)


def answer_text(raw: Column, most: int = 80) -> Column:
    """A model's answer: its first line, cut after so many UTF-16 units and trimmed; null if that is empty or says null."""
    line = F.substring_index(js_trim(F.coalesce(raw, F.lit(""))), "\n", 1)
    text = js_trim(first_units(line, most))
    return F.when((text != "") & (F.lower(text) != "null"), text)


def mime_type(content_type: Column, default: str = "image/jpeg") -> Column:
    kind = js_trim(F.split_part(F.coalesce(content_type, F.lit(default)), F.lit(";"), F.lit(1)))
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit(default))


def one_of(words: Sequence[str]) -> str:
    """A pattern for any of some words, the longest at a place: they share their beginnings, so a place that none starts at costs one look."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        parts = [re.escape(c) + pattern(below) for c, below in sorted(at.items()) if c]
        if not parts:
            return ""
        whole = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return f"(?:{whole})?" if "" in at else whole

    first = "".join(re.escape(c) for c in sorted(tree) if c)
    return f"(?=[{first}]){pattern(tree)}"


def numbered(items: Column) -> Column:
    """The items as lines "1. item"."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def uri_component(x: Column) -> Column:
    """Percent-encoded as a URI component: unlike form encoding, a space is %20, and ! ' ( ) ~ stay."""
    x = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def query_param(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; null if there is none."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    found = F.regexp_extract(F.concat(F.lit("&"), query), rf"&{name}=([^&]*)", 1)
    has = F.concat(F.lit("&"), query, F.lit("&")).rlike(rf"&{name}[=&]")
    return F.when(has, F.coalesce(F.try_url_decode(found), found))


#: Where a dish is named in a sentence, most telling first; case does not matter from the third on.
CAPTION_PATTERNS = (
    '"([^"]+)"',
    "'([^']+)'",
    rf"(?i)the{S}+([a-z{JS_SPACE}]{{3,30}}){S}+(?:was|is|are|were)\b",
    rf"(?i)ordered{S}+(?:the{S}+)?([a-z{JS_SPACE}]{{3,30}})(?:\.|,|!|{S}+and)",
    rf"(?i)tried{S}+(?:the{S}+)?([a-z{JS_SPACE}]{{3,30}})(?:\.|,|!|{S}+and)",
    rf"(?i)had{S}+(?:the{S}+)?([a-z{JS_SPACE}]{{3,30}})(?:\.|,|!|{S}+and)",
    rf"(?i)got{S}+(?:the{S}+)?([a-z{JS_SPACE}]{{3,30}})(?:\.|,|!|{S}+and)",
    rf"(?i)their{S}+([a-z{JS_SPACE}]{{3,30}})(?:\.|,|!|{S}+is|{S}+was)",
)


def caption_name(text: Column, patterns: Sequence[str] = CAPTION_PATTERNS) -> Column:
    """The name in a caption or sentence: a short text without a period is one itself, less its article; else the first pattern whose capture, trimmed, has 3 to 39 characters."""
    fits = lambda x: units(x).between(3, 39)
    short = F.regexp_replace(js_trim(text), rf"(?i)\A(the|a|an){S}+", "")
    own = F.when((units(text) < 50) & ~F.contains(text, F.lit(".")) & fits(short), short)
    found = [js_trim(F.regexp_extract(text, p, 1)) for p in patterns]
    return F.when(units(text) >= 3, title_case(F.coalesce(own, *[F.when(fits(x), x) for x in found])))
