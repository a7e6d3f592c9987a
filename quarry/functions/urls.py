"""URL column functions (pure Spark SQL expressions, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference behaviour: wiki namespaces never followed
# or written (the list holds "File:" twice in the reference; duplicates do not matter).
IGNORED_PATH_PREFIXES = ["文件:", "模板:", "用户:", "特殊:", "MediaWiki:", "File:", "Widget:", "User:", "File:",
                         "Data:", "分类:"]
HOME_PAGE = "首页"
# A path ending in a dot and 1-8 letters is a static file.
STATIC_FILE_PATTERN = r"^.*\.[a-zA-Z]{1,8}$"

_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def url_path(url: Column) -> Column:
    """Path component of an absolute URL ('' when there is none)."""
    return F.regexp_extract(url, _PATH_RE, 1)


def url_origin(url: Column) -> Column:
    """``scheme://host[:port]`` of an absolute URL."""
    return F.regexp_extract(url, _ORIGIN_RE, 1)


def resolve(base: Column, href: Column) -> Column:
    """Resolve an href against a page URL: absolute kept, ``//`` scheme-relative, ``/`` host-relative,
    fragments/queries dropped to the page itself, anything else relative to the page directory."""
    h = F.trim(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    directory = F.regexp_replace(page, r"[^/]*$", "")
    joined = (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
              .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
              .when(h.startswith("/"), F.concat(url_origin(base), h))
              .when(h.startswith("#") | (h == ""), page)
              .when(h.startswith("?"), F.concat(page, h))
              .otherwise(F.concat(directory, h)))
    return F.when(url_path(joined).rlike(r"(^|/)\.\.?(/|$)"), normal_path(joined)).otherwise(joined)


def normal_path(url: Column) -> Column:
    """An absolute URL whose ``.`` segments are gone and whose ``..`` segments took their parent with them."""
    segments = F.split(F.substring(url_path(url), 2, 1 << 30), "/", -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s:
                       F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                       .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    # a last segment of dots names a folder: its slash stays
    tail = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return F.concat(url_origin(url), F.lit("/"), F.array_join(kept, "/"), tail, rest)


def unquote(c: Column) -> Column:
    """Percent-decode like a lenient ``unquote``: ``+`` stays ``+``; undecodable input is kept raw."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def is_static(url: Column) -> Column:
    return url_path(url).rlike(STATIC_FILE_PATTERN)


def _prefix_alternation(prefixes) -> str:
    import re
    return "|".join(re.escape(p) for p in dict.fromkeys(prefixes))


def starts_with_ignored(site_path: Column, prefixes=IGNORED_PATH_PREFIXES) -> Column:
    return site_path.rlike("^(" + _prefix_alternation(prefixes) + ")")


def contains_ignored(text: Column, prefixes=IGNORED_PATH_PREFIXES) -> Column:
    return text.rlike("(" + _prefix_alternation(prefixes) + ")")


def save_key(url: Column) -> Column:
    """Decoded URL without its scheme (text after the last ``://``)."""
    return F.regexp_replace(unquote(url), r"^.*://", "")


def url_leaf(url: Column) -> Column:
    """U8: last path segment, query and fragment removed."""
    return F.substring_index(F.substring_index(F.substring_index(url, "?", 1), "#", 1), "/", -1)


def strip_suffix(text: Column) -> Column:
    """Drop the last ``.suffix``; text without a dot is unchanged."""
    return F.regexp_replace(text, r"\.[^.]*$", "")
