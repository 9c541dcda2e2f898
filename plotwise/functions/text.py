"""Text, URLs and page fields as column expressions; but for JSON-LD of any shape nothing leaves the JVM."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of plausible coordinates (inclusive).
LAT_MIN, LAT_MAX, LON_MIN, LON_MAX = 40.45, 41.0, -74.3, -73.6
#: Query parameters of map links that may hold a pair, in order.
MAP_PARAMS = ("q", "query", "ll", "sll", "center")


def compare_key(x: Column) -> Column:
    return F.upper(F.coalesce(x, F.lit("")))


def squeeze(x: Column) -> Column:
    """White space made single, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def looks_like_address(x: Column) -> Column:
    n = F.length(x)
    return (n > 5) & (n < 200) & x.rlike(r"\d")


def with_city(address: Column, city: str = ", New York, NY", state: str = "NY") -> Column:
    """Appends the city unless the state is named already."""
    return F.when(address.rlike(rf"(?i),\s*{state}\b"), address).otherwise(F.concat(address, F.lit(city)))


def _matched(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def _words(title: Column) -> Column:
    """The words of a title, with bars and colons as words of their own."""
    return F.split(squeeze(F.regexp_replace(title, "([|:])", " $1 ")), " ")


def _stands_at(words: Column, word: str, after: Column) -> Column:
    """Where a word first stands beyond a place, in any case; null if nowhere."""
    places = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i > after) & (F.lower(F.get(words, i - 1)) == word))
    return F.get(places, F.lit(0))


def title_address(title: Column) -> Column:
    """The address in a page title: what stands between `at` and the next `in`, else before the first `in`; null if neither looks like one.

    A bar or colon between the two ends the first form.
    """
    words = _words(title)
    at = _stands_at(words, "at", F.lit(0))
    until = _stands_at(words, "in", at)
    inner = F.slice(words, at + 1, F.greatest(until - at - 1, F.lit(0)))
    between = F.when(~F.arrays_overlap(inner, F.array(F.lit("|"), F.lit(":"))), F.array_join(inner, " "))
    first = _stands_at(words, "in", F.lit(1))
    before = F.regexp_replace(F.array_join(F.slice(words, 1, first - 1), " "), " ([|:])", "$1")
    return F.coalesce(F.when(looks_like_address(between), between), F.when(looks_like_address(before), before))


def title_neighbourhood(title: Column, breadcrumbs: Column | None = None) -> Column:
    """What follows the first ` in ` up to a colon or bar, below 80 characters; else the last of two or more breadcrumbs."""
    words = _words(title)
    at = _stands_at(words, "in", F.lit(1))
    stop = F.array_min(F.filter(F.array(_stands_at(words, "|", at), _stands_at(words, ":", at), F.size(words) + 1), lambda x: x.isNotNull()))
    found = F.nullif(F.array_join(F.slice(words, at + 1, F.greatest(stop - at - 1, F.lit(0))), " "), F.lit(""))
    out = F.when(F.length(found) < 80, found)
    return out if breadcrumbs is None else F.coalesce(out, F.when(F.size(breadcrumbs) >= 2, F.element_at(breadcrumbs, -1)))


def page_title(page: Column) -> Column:
    return squeeze(_matched(page, r"(?is)<title[^>]*>(.*?)</title>"))


def parse_number(x: Column) -> Column:
    """The number a text begins with, as parseFloat reads it; null if there is none."""
    return F.regexp_extract(x.cast("string"), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(LAT_MIN, LAT_MAX) & lon.between(LON_MIN, LON_MAX), F.lit(False))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _pair(text: Column) -> Column:
    """Struct of the first two numbers of a text that is a pair of them with a comma between."""
    parts = F.transform(F.split(text, ","), F.trim)
    return F.struct(*[F.get(parts, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(("lat", "lon"))])


def map_link_coordinates(url: Column) -> Column:
    """Struct of lat and lon in a map link, the first whose pair is plausible; null if none.

    Read in order: the path's part after /maps/place/, any part of the path, the part after an @, and the
    query's values for MAP_PARAMS.
    """
    parts = F.split(url_path(url), "/")
    place = F.element_at(F.split(url_path(url), "/maps/place/"), 2)
    named = F.when(F.contains(url_path(url), F.lit("/maps/place/")), F.get(F.split(place, "/"), F.lit(0)))
    texts = F.concat(F.array(named), parts, F.transform(F.filter(parts, lambda x: x.contains("@")), lambda x: F.substring_index(x, "@", -1)))
    query = F.substring_index(F.regexp_replace(url, "^[^?]*", ""), "#", 1)
    given = F.transform(F.split(F.substring(query, 2, 100_000), "&"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("name"), F.try_url_decode(F.regexp_replace(x, "^[^=]*=?", "")).alias("value")))
    named_by = lambda n: F.transform(F.filter(given, lambda x: x["name"] == n), lambda x: x["value"])
    values = [named_by(n) for n in MAP_PARAMS]
    pairs = F.transform(F.filter(F.concat(texts, *values), lambda x: x.isNotNull()), _pair)
    return F.get(F.filter(pairs, lambda p: valid_coordinates(p["lat"], p["lon"])), F.lit(0))


def json_ld_coordinates(document: Column, depth: int = 6) -> Column:
    """Struct of lat and lon in a JSON-LD text, null if there is none or the text is no JSON.

    Of every object its `geo` object is read first, then its own pair, then its values in order, `depth` levels
    down. A small reader of one text at a time, in Arrow batches: JSON of any shape has no column expression.
    """
    def pair(x: dict) -> tuple | None:
        try:
            lat, lon = float(x.get("latitude")), float(x.get("longitude"))
        except (TypeError, ValueError):
            return None
        return (lat, lon) if LAT_MIN <= lat <= LAT_MAX and LON_MIN <= lon <= LON_MAX else None

    def search(x, left: int) -> tuple | None:
        if left < 0 or not isinstance(x, (dict, list)):
            return None
        if isinstance(x, dict):
            found = (pair(x["geo"]) if isinstance(x.get("geo"), dict) else None) or pair(x)
            if found:
                return found
            x = list(x.values())
        return next((f for v in x if (f := search(v, left - 1))), None)

    def read(text) -> dict | None:
        try:
            found = search(json.loads(text), depth) if text else None
        except (ValueError, RecursionError):
            return None
        return {"lat": found[0], "lon": found[1]} if found else {"lat": None, "lon": None}

    @F.pandas_udf("struct<lat:double,lon:double>")
    def found_in(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(t) or {"lat": None, "lon": None} for t in texts], columns=["lat", "lon"]).astype("float64")

    out = found_in(document)
    return F.when(out["lat"].isNotNull() & ~F.isnan(out["lat"]), out)


def normalize_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def photo_base_hash(url: Column) -> Column:
    """Host and path without extension and size suffix; null for what is no URL."""
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"(?i)\.[a-z]+$", ""), r"-se_[a-z]+_\d+(?:_\d+)?", "")
    return F.when(url_host(url) != "", F.concat(url_host(url), path))


def listing_id(path: Column) -> Column:
    """type:rest for paths of buildings, rentals and sales, with colons for slashes; else null."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    known = F.get(parts, F.lit(0)).isin("building", "rental", "sale") & path.startswith("/") & (F.size(parts) > 1)
    return F.when(known, F.array_join(parts, ":"))


def is_listing_photo(url: Column, hosts: tuple[str, ...]) -> Column:
    host = url_host(url)
    named = [(host == h) | host.endswith("." + h) for h in hosts]
    out = named[0]
    for x in named[1:]:
        out = out | x
    return out


def large_enough(width: Column, height: Column, least: int = 150) -> Column:
    """Too small only if both sides are known and below."""
    return ~((width > 0) & (width < least) & (height > 0) & (height < least))


def position_label(label: Column) -> Column:
    """Struct of position and total in `3 of 11`; null if the label has none."""
    pattern = r"(\d+)\s+of\s+(\d+)"
    return F.when(label.rlike(pattern), F.struct(F.regexp_extract(label, pattern, 1).cast("long").alias("position"), F.regexp_extract(label, pattern, 2).cast("long").alias("total")))


def format_number(x: Column) -> Column:
    return F.coalesce(F.format_number(x, 0), F.lit("—"))


def format_rate(x: Column) -> Column:
    """Thousands separated and whole from 1000 on, else one decimal without separators (999.96 is 1000.0); a dash for null."""
    from .numeric import half_up

    return F.when(x.isNull(), F.lit("—")).when(x >= 1000, F.format_number(half_up(x).cast("long"), 0)).otherwise(F.call_function("format_number", half_up(x, 1), F.lit("0.0")))


def city_multiple(value: Column, reference: Column) -> Column:
    """`1.2×` the reference; null where either side is missing or the reference is not above 0."""
    from .numeric import half_up

    ratio = value / reference
    shown = F.when(ratio >= 10, half_up(ratio).cast("long").cast("string")).otherwise(F.format_number(half_up(ratio, 1), 1))
    return F.when(value.isNotNull() & (reference > 0), F.concat(shown, F.lit("×")))


def html_escape(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def clean_label(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def one_of(x: Column, allowed: tuple[str, ...], default: str) -> Column:
    """An enumerated setting, lower case and trimmed, or the default."""
    key = F.lower(F.trim(x))
    return F.when(key.isin(*allowed), key).otherwise(F.lit(default))
