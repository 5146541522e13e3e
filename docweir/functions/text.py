"""Column functions on URLs, titles and other strings; all run in the JVM but those marked as vectorised."""

from __future__ import annotations

import unicodedata
from functools import cache
from urllib.parse import parse_qsl, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The id's prefix and length, reply marks, dashes, title and probe lengths, and the length of an error message.
ID_PREFIX, ID_HEX = "web-", 16
REPLY = r"(?i)^(\s*(re|fwd?|fw)\s*:\s*)+"
DASHES = "‐‑‒–—―−"
KEY_LENGTH, MIN_PROBE, ERROR_LENGTH = 200, 20, 1000

#: Scheme and authority of a URL; and scheme, authority and path apart.
SITE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"
URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def collapsed(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def canonical_url(url: Column | str) -> Column:
    """Scheme and authority in lower case, no query, fragment or trailing slashes; an empty path is ``/``."""
    u = F.regexp_replace(_col(url), r"(?U)^\s+|\s+$|[\t\r\n]", "")
    path = F.regexp_extract(u, SITE + r"([^?#]*?)/*(?:[?#]|$)", 1)
    return F.concat(F.lower(F.regexp_extract(u, SITE, 0)), F.when(path == "", "/").otherwise(path))


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(stripped(url), URL, 2))


def article_id(url: Column | str) -> Column:
    """An id that depends on nothing but the canonical URL."""
    return id_of_canonical(canonical_url(url))


def id_of_canonical(canonical: Column | str) -> Column:
    return F.concat(F.lit(ID_PREFIX), F.substring(F.sha2(_col(canonical), 256), 1, ID_HEX))


def is_own_id(c: Column | str) -> Column:
    return F.startswith(_col(c), F.lit(ID_PREFIX))


def url_slug(url: Column | str) -> Column:
    """Last segment of the canonical URL's path."""
    return F.substring_index(canonical_url(url), "/", -1)


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """From the rule of compatibility decomposition: characters with one ASCII letter, and those with several characters."""
    single, to, several = [], [], {}
    for cp in range(0x80, 0x10000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ascii_part = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(ascii_part) == 1:
            single.append(chr(cp))
            to.append(ascii_part)
        elif len(ascii_part) > 1:
            several[chr(cp)] = ascii_part
    return "".join(single), "".join(to), several


#: The part of the folding that titles in European languages need: Latin letters with marks, and full-width forms.
_COMMON = [(0xA0, 0x24F), (0x1E00, 0x1EFF), (0x2000, 0x200A), (0xFF01, 0xFF5E)]


def ascii_folded(c: Column | str) -> Column:
    """Compatibility-decomposed, all but ASCII deleted. Characters outside the common ranges take a slower way, row by row."""
    single, to, several = _folds()
    plain = [(a, b) for a, b in zip(single, to) if any(x <= ord(a) <= y for x, y in _COMMON)]
    text = F.translate(_col(c), "".join(a for a, _ in plain), "".join(b for _, b in plain))
    table = F.from_json(F.lit(_json_map()), "map<string,string>")
    slow = F.array_join(F.transform(F.split(text, ""), lambda x: F.coalesce(table[x], x)), "")
    return F.regexp_replace(F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), slow).otherwise(text), r"[^\x00-\x7F]", "")


@cache
def _json_map() -> str:
    import json

    single, to, several = _folds()
    return json.dumps({**dict(zip(single, to)), **several})


def slugified(c: Column | str, length: int = KEY_LENGTH) -> Column:
    """Lower-case ASCII words joined by hyphens, cut at a length."""
    s = F.regexp_replace(F.lower(ascii_folded(c)), r"[^a-z0-9\s-]", "")
    return F.left(F.trim(F.regexp_replace(s, r"[\s-]+", "-"), F.lit("-")), F.lit(length))


def title_key(title: Column | str) -> Column:
    """Titles that mean the same article have one key; a null or empty title has the key '', which matches nothing."""
    t = F.regexp_replace(F.coalesce(_col(title), F.lit("")), REPLY, "")
    return slugified(F.translate(t, DASHES, "-" * len(DASHES)))


def without_query(url: Column | str) -> Column:
    return F.substring_index(F.substring_index(_col(url), "?", 1), "#", 1)


def url_pattern(url: Column | str) -> Column:
    """The path with its last segment generalised; null if there is none."""
    segments = F.filter(F.split(F.regexp_extract(stripped(url), URL, 3), "/"), lambda s: s != "")
    return F.when(F.size(segments) > 0, F.concat(F.lit("/"), F.array_join(F.concat(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("{slug}"))), "/")))


def last_segment(url: Column | str) -> Column:
    return F.element_at(F.filter(F.split(F.regexp_extract(stripped(url), URL, 3), "/"), lambda s: s != ""), -1)


def id_from_filename(path: Column | str) -> Column:
    """What follows the last underscore of a file's stem."""
    stem = F.regexp_replace(F.substring_index(_col(path), "/", -1), r"\.[^.]*$", "")
    return F.substring_index(stem, "_", -1)


def joined_names(names: Column | str) -> Column:
    """``A``, ``A and B``, ``A, B and C``; blank names go."""
    n = F.filter(F.transform(_col(names), collapsed), lambda x: x.isNotNull() & (x != ""))
    head = F.array_join(F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(1))), ", ")
    return F.when(F.size(n) <= 1, F.array_join(n, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(n, -1)))


def display_name(name: Column | str, url: Column | str) -> Column:
    """The name, else the host, else the URL."""
    return F.coalesce(F.nullif(_col(name), F.lit("")), F.nullif(F.regexp_extract(_col(url), URL, 2), F.lit("")), _col(url))


def yaml_escaped(c: Column | str) -> Column:
    """Backslashes first, then quotes."""
    return F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def yaml_unescaped(c: Column | str) -> Column:
    """A scalar without its quotes and escapes; one that is not quoted stays."""
    v = F.trim(_col(c))
    quoted = (F.length(v) > 1) & F.startswith(v, F.lit('"')) & F.endswith(v, F.lit('"'))
    inner = F.substring(v, F.lit(2), F.greatest(F.length(v) - 2, F.lit(0)))
    return F.when(quoted, F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).otherwise(v)


def html_escaped(c: Column | str) -> Column:
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_unescaped(c: Column | str) -> Column:
    """The five named characters that markup must escape, and the apostrophe's numbers."""
    out = _col(c)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def template_filled(template: Column | str, **values: Column) -> Column:
    """``{name}`` replaced by each value."""
    out = _col(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


def comma_list(c: Column | str) -> Column:
    """Parts between commas, trimmed, blank ones dropped; one null if none is left."""
    parts = F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(None).cast("string")))


def archive_key(url: Column | str) -> Column:
    """Two archive addresses with one key are the same."""
    return F.lower(F.regexp_replace(_col(url), "/+$", ""))


def video_link(video_id: Column | str, start: Column | str) -> Column:
    """Address of a video by its id, with a start time if there is one; null for what can be no id."""
    t = F.trim(F.coalesce(_col(start).cast("string"), F.lit("")))
    link = F.concat(F.lit("https://www.youtube.com/watch?v="), _col(video_id), F.when(t != "", F.concat(F.lit("&t="), F.url_encode(t))).otherwise(""))
    return F.when(F.rlike(_col(video_id), F.lit("^[A-Za-z0-9_-]{6,20}$")), link)


def clean_address(value: object) -> str:
    """An absolute http(s) address without ``utm_`` parameters; '' for anything else."""
    url = value.strip() if isinstance(value, str) else ""
    try:
        parts = urlsplit(url)
    except ValueError:
        return ""
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return ""
    given = parse_qsl(parts.query, keep_blank_values=True)
    left = [p for p in given if not p[0].lower().startswith("utm_")]
    return url if len(left) == len(given) else urlunsplit(parts._replace(query=urlencode(left)))


@F.pandas_udf(T.StringType())
def clean_url(url: pd.Series) -> pd.Series:
    """Vectorised: :func:`clean_address`; a query is encoded anew only if something was dropped."""
    return url.map(clean_address)


@F.pandas_udf(T.StringType())
def joined_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    """Vectorised: a reference resolved against a base address."""
    return pd.Series([None if b is None or r is None else _join(b, r) for b, r in zip(base, ref)], dtype=object)


def _join(base: str, ref: str) -> str:
    try:
        return urljoin(base, ref)
    except ValueError:
        return ref


@F.pandas_udf(T.StringType())
def percent_decoded(c: pd.Series) -> pd.Series:
    """Vectorised: percent escapes decoded, a plus sign left as it is."""
    return c.map(lambda x: None if x is None else unquote(x))
