"""URL repair and resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions.text import full_trim


def ensure_protocol(url: Column) -> Column:
    text = full_trim(url)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", url)
        .when(text.startswith("http://") | text.startswith("https://"), text)
        .when(text.startswith("//"), F.concat(F.lit("https:"), text))
        .otherwise(F.concat(F.lit("https://"), text))
    )


def repair_doubled(base_url: Column, page_url: Column) -> Column:
    """``base/www.other`` becomes ``https:///www.other``: the cut keeps the slash before ``www``."""
    base = F.when(base_url.endswith("/"), base_url).otherwise(F.concat(base_url, F.lit("/")))
    mark = F.concat(base, F.lit("www"))
    at = F.position(mark, page_url)
    tail = F.substr(page_url, at + F.length(mark) - 4)
    return F.when(
        (F.coalesce(base_url, F.lit("")) != "") & (F.coalesce(page_url, F.lit("")) != "") & (at > 0),
        F.when(tail.startswith("http"), tail).otherwise(F.concat(F.lit("https://"), tail)),
    ).otherwise(page_url)


def resolve_link(href: Column, page_url: Column) -> Column:
    """Absolute form of a link found on a page."""
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    path = F.regexp_replace(page_url, "[?#].*$", "")
    folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(F.coalesce(href, F.lit("")) == "", F.lit(None))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(origin == "", href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(page_url, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(path, href))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^\./", "")))
    )
