"""Scalar text functions as column expressions; Arrow functions where offsets or sequence matching are needed."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token, as a CJK character and as an icon marker.
CJK = r"\x{3400}-\x{9fff}"
TOKEN_PATTERN = rf"[{CJK}]|[A-Za-z0-9_]+|[^\s\p{{Z}}\x1c-\x1f\x{{85}}A-Za-z0-9_{CJK}]"
PYTHON_TOKEN = re.compile(r"[㐀-鿿]|[A-Za-z0-9_]+|[^\sA-Za-z0-9_㐀-鿿]")
ICON_PATTERN = r"(?i)\[icon\s*:[^\]]+\]"
NO_MISSING = "NO_MISSING_SAFE"
NOTE_LABELS = "Breadcrumb|Section|Table|Table caption|Table footnote|Image with illustration|Image caption|Image description|Image VLM description|Image footnote|Image answering policy|Footnote"
TRUNCATION_MARKER = "\n[...truncated...]\n"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_field(parts: Column | str) -> Column:
    """A list joined by newlines; null is empty (B1)."""
    return F.array_join(F.coalesce(col(parts), F.array().cast("array<string>")), "\n")


def token_estimate(text: Column | str) -> Column:
    """CJK characters, ASCII word runs and other non-blank characters, one each (B2)."""
    return F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(TOKEN_PATTERN)).cast("long")


def approx_tokens(text: Column | str) -> Column:
    """CJK characters and a quarter of all others, rounded up."""
    t = F.coalesce(col(text), F.lit(""))
    cjk = F.regexp_count(t, F.lit(f"[{CJK}]"))
    return (cjk + F.ceil((F.char_length(t) - cjk) / 4)).cast("long")


def context_tokens(text: Column | str, chars_per_token: float = 4.0) -> Column:
    """Characters by characters per token, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(F.coalesce(col(text), F.lit(""))) / F.lit(max(1.0, chars_per_token)))).cast("long")


def tail_of(text: str | None, n: int) -> str:
    """The last n estimated tokens, without blanks before them; all of a text that fits."""
    text = text or ""
    if n <= 0:
        return ""
    starts = [m.start() for m in PYTHON_TOKEN.finditer(text)]
    return text if len(starts) <= n else text[starts[-n] :].lstrip()


def token_tail(text: Column | str, n: int) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: tail_of(t, n))

    return run(col(text))


def approx_count(text: str) -> int:
    cjk = sum("㐀" <= c <= "鿿" for c in text)
    return cjk + -(-(len(text) - cjk) // 4)


def truncate(text: str, budget: int, *, from_tail: bool, marker: str = TRUNCATION_MARKER) -> str:
    """The longest head (or tail) whose cost with the marker fits; nothing without room for the marker."""
    if approx_count(text) <= budget:
        return text
    room = budget - approx_count(marker)
    if room <= 0:
        return ""
    lo, hi = 0, len(text)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if approx_count(text[len(text) - mid :] if from_tail else text[:mid]) <= room:
            lo = mid
        else:
            hi = mid - 1
    return marker + text[len(text) - lo :] if from_tail else text[:lo] + marker


def truncated(text: Column | str, budget: int, *, from_tail: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: truncate(t or "", budget, from_tail=from_tail))

    return run(col(text))


def normalize_path(path: Column | str) -> Column:
    """Forward slashes, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(path), F.lit("")), r"\\", "/"), "^/+|/+$", "")


def breadcrumb(path: Column | str, section: Column | None = None) -> Column:
    """Non-empty path parts, then the section path, joined by ' > '."""
    parts = F.filter(F.split(normalize_path(path), "/"), lambda x: x != "")
    return F.array_join(parts if section is None else F.concat(parts, section), " > ")


def source_name(path: Column | str, root: str | None = None) -> Column:
    """The path below root, else below a source-pdfs or pdfs/source folder, else the file's name."""
    p = normalize_path(path)
    found = [F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")) for pattern in (r"(?:^|.*/)source-pdfs/(.+)$", r"(?:^|.*/)pdfs/source/(.+)$")]
    if root:
        base = root.replace("\\", "/").strip("/") + "/"
        found = [F.when(F.startswith(p, F.lit(base)), F.substr(p, F.lit(len(base) + 1))), *found]
    return F.coalesce(*found, F.substring_index(p, "/", -1))


def display_title(text: Column | str) -> Column:
    """No-break spaces become blanks, runs of blanks one."""
    return F.btrim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\s\x{a0}]+", " "))


def normalized_title(text: Column | str) -> Column:
    """display_title() in lower case; casefold() differs for a few characters such as ß."""
    return F.lower(display_title(text))


def heading_number(text: Column | str) -> Column:
    """The dotted number that a heading starts with, null without one."""
    return F.nullif(F.regexp_extract(col(text), r"^\s*(\d+(?:\.\d+)*)\b", 1), F.lit(""))


def similarity(a: str, b: str, most_chars: int = 260) -> float:
    """Matching-blocks ratio of two normalized titles, zero where lengths or leading numbers rule it out."""
    if len(b) > most_chars or len(b) > max(3 * len(a), len(a) + 100):
        return 0.0
    x, y = (re.match(r"\d+(?:\.\d+)*", t) for t in (a, b))
    if x and y and x[0] != y[0]:
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


def fuzzy_ratio(a: Column | str, b: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(i or "", j or "") for i, j in zip(x, y, strict=True)])

    return run(normalized_title(a), normalized_title(b))


# The namespace of domain names in RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column | str) -> Column:
    """The version-5 UUID of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(col(name), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80)).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def page_list(pages: Column, start: Column, end: Column) -> Column:
    """Sorted distinct pages of a list, else of the range between start and end in either order."""
    span = F.sequence(F.least(start, end), F.greatest(start, end))
    return F.when(F.size(pages) > 0, F.array_sort(F.array_distinct(pages))).otherwise(span)


def list_of_ints(text: Column | str) -> Column:
    """Distinct integers of a delimited string, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), r"[,|;\s]+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull()))


def clip_words(text: Column, limit: int) -> Column:
    """Cut at the last blank within the limit and end with a point."""
    cut = F.btrim(F.regexp_replace(F.left(text, F.lit(limit)), " [^ ]*$", ""))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(cut, F.lit(".")))


def clean_note(text: Column | str, limit: int = 220) -> Column:
    """Without tags, icon markers and labelled brackets, blanks collapsed, clipped at a word."""
    t = F.coalesce(col(text), F.lit(""))
    for pattern in ("<[^>]+>", r"\[Icon:[^\]]+\]", rf"\[(?:{NOTE_LABELS}):[^\]]*\]", r"\s+"):
        t = F.regexp_replace(t, pattern, " ")
    return clip_words(F.btrim(t), limit)


def snippet(text: Column | str, limit: int = 320) -> Column:
    """Blanks collapsed, cut at the limit."""
    return F.left(F.btrim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " ")), F.lit(limit))


def label(text: Column | str, pattern: str) -> Column:
    """The first group of a pattern, blanks collapsed."""
    return snippet(F.regexp_extract(col(text), pattern, 1), 1_000_000)


def icon_markers(text: Column | str) -> Column:
    """The named icon markers of a text, in order and in one spelling."""
    names = F.transform(F.regexp_extract_all(col(text), F.lit(r"(?i)\[icon\s*:([^\]]+)\]"), F.lit(1)), lambda n: F.btrim(n))
    return F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit("[Icon: "), n, F.lit("]")))


def is_no_missing(text: Column) -> Column:
    """Whether an answer says that no icon is missing."""
    low = F.lower(F.btrim(text))
    plain = F.btrim(F.regexp_replace(low, r"[\s`\"'.:;!,，。；：！]+", " "))
    return F.contains(low, F.lit(NO_MISSING.lower())) | plain.isin("no missing", "no missing icon", "no missing icons") | F.startswith(plain, F.lit("no missing "))


def is_only_icon(original: Column, patched: Column) -> Column:
    """Whether nothing but icon markers and marks is left of a text that had more."""
    rest = F.regexp_replace(F.regexp_replace(patched, ICON_PATTERN, " "), r"[\s`\"'.:;!,，。；：！/\\|()\[\]{}<>_-]+", "")
    return (F.btrim(original) != "") & patched.rlike(r"(?i)\[icon\s*:") & (rest == "")


def patch_decision(original: Column, patched: Column) -> Column:
    """no_missing, only_icon, empty or apply."""
    return F.when(is_no_missing(patched), "no_missing").when(is_only_icon(original, patched), "only_icon").when(F.btrim(patched) == "", "empty").otherwise("apply")


def strip_reasoning(text: Column | str) -> Column:
    """What follows the last closing think tag."""
    return F.btrim(F.substring_index(col(text), "</think>", -1))


def preservation_key(text: Column | str) -> Column:
    """Letters and digits only, without icon markers, tags and emphasis."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    for pattern in (r"\[icon:[^\]]*\]", "<[^>]*>", r"\*\*|__"):
        t = F.regexp_replace(t, pattern, " ")
    return F.btrim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def page_ranges(spec: Column | str) -> Column:
    """Zero-based pages of 'a-b,c', sorted and distinct."""
    parts = F.filter(F.split(F.regexp_replace(col(spec), r"\s", ""), ","), lambda x: x != "")

    def span(x: Column) -> Column:
        first = F.substring_index(x, "-", 1).try_cast("int")
        last = F.substring_index(x, "-", -1).try_cast("int")
        return F.transform(F.sequence(F.least(first, last), F.greatest(first, last)), lambda p: p - 1)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))


def slug(text: Column | str, joint: str = "-") -> Column:
    """Runs of other characters than letters and digits become the joint."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+", joint), F.lit(joint))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# The headings of the parts of a picture's context.
CONTEXT_HEADS = {"before": "### Nearby Text Before Image", "current": "### Current Image Caption/Footnote", "after": "### Nearby Text After Image"}


def context_parts(context: Column | str) -> Column:
    """The texts under the three headings of a context, each up to the next heading there is."""
    t = F.coalesce(col(context), F.lit(""))
    at = {k: F.instr(t, F.lit(h)) for k, h in CONTEXT_HEADS.items()}

    def part(name: str) -> Column:
        start = at[name] + len(CONTEXT_HEADS[name])
        later = [F.when(p > at[name], p) for k, p in at.items() if k != name]
        end = F.coalesce(F.least(*later), F.char_length(t) + 1)
        return F.when(at[name] > 0, F.btrim(F.substr(t, start, end - start), F.lit(" \t\r\n"))).otherwise("").alias(name)

    return F.struct(*[part(k) for k in CONTEXT_HEADS])


def usage_count(usage: Column | str, key: str) -> Column:
    """A count of a usage object in JSON; zero where it is missing or no number."""
    return F.coalesce(F.get_json_object(col(usage), f"$.{key}").try_cast("int"), F.lit(0))


def replace_references(json: Column | str, replacements: dict[str, str]) -> Column:
    """Old names in all strings of nested JSON become new ones (B32); both are written as JSON holds them."""
    out = col(json)
    for old, new in replacements.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
