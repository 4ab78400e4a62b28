"""Column expressions on paths, links and URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import ASSET_EXTENSIONS, IGNORED_HREF_PREFIXES, NON_HTML_EXTENSIONS
from .values import stripped

_ABSOLUTE = r"^https?://"
_URL_PATH = r"^https?://[^/?#]*([^?#]*)"
_SITE_PATH = r"^(?:https?://[^/?#]*)?/?([^?#]*)"
_ABSOLUTE_PARAMS = r"^(https?://[^?#]*?);[^/?#]*(?=[?#]|\z)"
_BARE_ORIGIN = r"^https?://[^/?#]*([?#]|\z)"
_LAST_SEGMENT_PARAMS = r";[^/]*$"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_ORIGIN = r"^(https?://[^/?#]*)"


def normalize_path(value: Column) -> Column:
    """Site path of a request target: query and fragment cut, leading slash; NULL when blank."""
    raw = stripped(value)
    path = F.regexp_extract(F.regexp_replace(raw, _ABSOLUTE_PARAMS, "$1"), _SITE_PATH, 1)
    # most targets already are site paths; they skip the patterns
    is_plain = raw.startswith("/") & ~raw.contains("?") & ~raw.contains("#")
    return F.when(is_plain, raw).when(raw != "", F.concat(F.lit("/"), path))


def normalize_referrer(value: Column) -> Column:
    """Site path of a referrer; NULL when blank, ``-`` or a URL without a path."""
    raw = stripped(value)
    return F.when((raw != "-") & ~raw.rlike(_BARE_ORIGIN), normalize_path(raw))


def path_from_request_line(value: Column) -> Column:
    """Path in ``METHOD target PROTOCOL``; NULL with fewer than two words."""
    return normalize_path(F.get(F.split(stripped(value), r"\s+"), F.lit(1)))


def path_category(path: Column) -> Column:
    """First path segment, ``home`` for the root."""
    inner = F.btrim(path, F.lit("/"))
    return F.when(inner == "", F.lit("home")).otherwise(F.substring_index(inner, "/", 1))


def path_depth(path: Column) -> Column:
    """Number of non-empty segments."""
    return F.size(F.filter(F.split(path, "/"), lambda part: part != "")).cast("int")


def _extension(path: Column) -> Column:
    """Lower-case text after the last dot; the whole path, which starts with a slash, without one."""
    return F.lower(F.substring_index(path, ".", -1))


def is_page_path(path: Column) -> Column:
    """True for pages, false for static assets."""
    return ~_extension(path).isin(ASSET_EXTENSIONS)


def is_html_like(url: Column) -> Column:
    """True unless the URL path ends like a known non-HTML resource."""
    path = F.when(url.rlike(_ABSOLUTE), F.regexp_extract(url, _URL_PATH, 1)).otherwise(
        F.regexp_extract(url, r"^[^?#]*", 0)
    )
    path = F.regexp_replace(path, _LAST_SEGMENT_PARAMS, "")
    return ~_extension(F.concat(F.lit("/"), path)).isin(NON_HTML_EXTENSIONS)


def _ignored_href(ref: Column) -> Column:
    ignored = F.lit(False)
    for prefix in IGNORED_HREF_PREFIXES:
        ignored = ignored | ref.startswith(prefix)
    return ignored


def local_reference(ref: Column) -> Column:
    """Path part of a link within the site; NULL for other schemes, hosts and bare anchors."""
    raw = stripped(ref)
    path = F.regexp_replace(F.regexp_extract(raw, r"^[^?#]*", 0), _LAST_SEGMENT_PARAMS, "")
    outside = (raw == "") | _ignored_href(raw) | raw.rlike(_SCHEME) | raw.rlike(r"^//[^/?#]")
    return F.when(~outside, F.nullif(path, F.lit("")))


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    is_dot = lambda part: (part == ".") | (part == "..")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    closing = F.when(is_dot(F.element_at(parts, -1)) & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), closing)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), resolved).otherwise(path)


def internal_url(base_url: Column, ref: Column) -> Column:
    """The link resolved against its page, without fragment; NULL when it leaves the host."""
    origin = F.regexp_extract(base_url, _ORIGIN, 1)
    base_path = F.coalesce(
        F.nullif(F.regexp_extract(base_url, _URL_PATH, 1), F.lit("")), F.lit("/")
    )
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    target = F.regexp_extract(ref, r"^[^#]*", 0)
    target_path = F.regexp_extract(target, r"^[^?]*", 0)
    query = F.regexp_extract(target, r"(\?.*)$", 1)
    joined = F.concat(
        origin,
        F.when(target_path == "", base_path)
        .when(target_path.startswith("/"), remove_dot_segments(target_path))
        .otherwise(remove_dot_segments(F.concat(folder, target_path))),
        query,
    )
    resolved = (
        F.when(ref.rlike(_SCHEME), target)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base_url, r"^https?:", 0), target))
        .otherwise(joined)
    )
    same_host = F.regexp_extract(resolved, r"^https?://([^/?#]*)", 1) == F.regexp_extract(
        base_url, r"^https?://([^/?#]*)", 1
    )
    usable = (ref != "") & ~_ignored_href(ref) & resolved.rlike(_ABSOLUTE) & same_host
    return F.when(usable, resolved)
