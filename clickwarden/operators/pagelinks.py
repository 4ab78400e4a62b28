"""Links between stored HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import internal_url, is_html_like, local_reference, normalize_path, remove_dot_segments

_COMMENT = r"(?s)<!--.*?-->"
_SCRIPT_BODY = r"(?is)(<script\b[^>]*>).*?</script\s*>"
_STYLE_BODY = r"(?is)(<style\b[^>]*>).*?</style\s*>"
_TAG = r"(?i)<(?:a|img|script|link)\b[^>]*>"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)])
    for entity, character in _ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(character))
    return value


def page_links(pages: DataFrame) -> DataFrame:
    """Every anchor, image, script and link tag with its reference, resolved within the site.

    ``local_target`` is the site path of a reference without scheme and host, ``internal`` the full
    URL when it stays on the page's host.
    """
    visible = F.regexp_replace(F.col("html"), _COMMENT, "")
    visible = F.regexp_replace(F.regexp_replace(visible, _SCRIPT_BODY, "$1"), _STYLE_BODY, "$1")
    tags = pages.select("page_id", "url", F.explode(F.regexp_extract_all(visible, F.lit(_TAG), F.lit(0))).alias("tag"))
    name = F.lower(F.regexp_extract("tag", r"^<(\w+)", 1))
    reference = F.when(name.isin("a", "link"), _attribute(F.col("tag"), "href")).otherwise(_attribute(F.col("tag"), "src"))
    found = tags.select(
        "page_id", "url", F.when(name == "a", "link").otherwise("asset").alias("kind"), reference.alias("ref")
    ).where(F.col("ref") != "")
    local = local_reference(F.col("ref"))
    folder = F.regexp_replace(normalize_path(F.col("url")), r"[^/]*$", "")
    target = F.when(local.startswith("/"), remove_dot_segments(local)).otherwise(
        remove_dot_segments(F.concat(folder, local))
    )
    internal = internal_url(F.col("url"), F.col("ref"))
    return found.withColumns({
        "local_target": target, "internal": internal, "is_html": is_html_like(internal),
    })


def site_key(url: Column) -> Column:
    """Host and path of a URL."""
    return F.concat(F.regexp_extract(url, r"^https?://([^/?#]*)", 1), normalize_path(url))


def page_edges(pages: DataFrame) -> DataFrame:
    """Distinct internal links from page to page."""
    links = page_links(pages).where((F.col("kind") == "link") & F.col("internal").isNotNull() & F.col("is_html"))
    return links.select(site_key(F.col("url")).alias("source"), site_key(F.col("internal")).alias("target")).distinct()


def broken_links(pages: DataFrame) -> DataFrame:
    """Local references whose target is none of the known pages."""
    known = pages.select(site_key(F.col("url")).alias("target_page")).distinct()
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    links = page_links(pages).where(F.col("local_target").isNotNull()).withColumn(
        "target_page", F.concat(host, "local_target")
    )
    return links.join(known, "target_page", "left_anti").select("page_id", "kind", "ref", "target_page")
