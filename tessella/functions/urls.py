"""URL columns: parts, normal form, page ids, link resolution, filters, priority and depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

#: Fixed values of the link rules.
BLOCKED_EXTENSIONS = (
    "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "zip", "tar", "gz", "rar", "7z", "jpg", "jpeg", "png", "gif", "svg", "ico", "webp", "mp4",
    "mp3", "avi", "mov", "wav", "exe", "dmg", "apk", "deb", "rpm",
)
SKIPPED_EXTENSIONS = (
    "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "zip", "tar", "gz", "jpg", "jpeg", "png", "gif", "mp4", "mp3",
)
NOISE_WORDS = (
    "schedule", "timetable", "time-table", "exam-schedule", "calendar", "event", "news", "announcement", "gallery", "photo", "image", "login",
    "signin", "download-", "print", "share", "comment", "reply",
)
DATE_PARAMS = ("date=", "month=", "year=", "day=", "time=")
DATE_WORDS = ("calendar", "schedule", "event", "news")
TRACKING_PARAMS = ("session=", "sid=", "token=", "utm_", "ref=")
BLACKLIST = ("*/news/*", "*/events/*", "*/calendar/*", "*/login/*", "*/admin/*")
PRIORITY_BANDS = (
    (("/faculty", "/people/", "/member", "/staff"), 300),
    (("/research", "/lab", "group", "/projects"), 250),
    (("/publication", "/paper", "thesis", "/book"), 150),
    (("/course", "/teach", "/class"), 50),
    (("/about", "/contact", "/gallery"), -50),
    (("/news", "/archive", "/old", "/past", "/2020", "/2019", "/2018"), -100),
)

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def part(url: Column, which: str) -> Column:
    """scheme, host, path, query or fragment; empty where there is none."""
    return F.regexp_extract(url, _PARTS, 1 + ("scheme", "host", "path", "query", "fragment").index(which))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "https?://([^/]+)", 1)


def normalize(url: Column) -> Column:
    """https for http, host in lower case, no trailing slash but the root's, parameters in order of their keys, no fragment."""
    scheme = F.when(part(url, "scheme").isin("http", "https"), "https").otherwise(part(url, "scheme"))
    path = F.when(part(url, "path") == "/", "/").otherwise(F.regexp_replace(part(url, "path"), "/+$", ""))
    # A parameter without '=' gets one; equal keys keep their order.
    params = F.filter(F.split(part(url, "query"), "&"), lambda p: p != "")
    keyed = F.transform(params, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")
    return F.concat(F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))), F.when(part(url, "host") == "", "").otherwise(F.concat(F.lit("//"), F.lower(part(url, "host")))), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def page_id(url: Column, domain: Column) -> Column:
    return F.concat(F.replace(domain, F.lit("."), F.lit("_")), F.lit("_"), F.substring(F.md5(url), 1, 12))


def resolve(base: Column, href: Column) -> Column:
    """The absolute form of a link: absolute, scheme-relative, root-relative, query or fragment only, or relative to the base's folder."""
    root = F.concat(part(base, "scheme"), F.lit("://"), part(base, "host"))
    folder = F.regexp_replace(part(base, "path"), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(part(base, "scheme"), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#[\\s\\S]*$", ""), href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, part(base, "path"), href))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )


def _ends_with(path: Column, extensions) -> Column:
    return F.lower(path).rlike("\\.(" + "|".join(extensions) + ")$")


def segments(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def block_reason(url: Column, blacklist=BLACKLIST, whitelist=()) -> Column:
    """The first rule that blocks a link, null if none does. Whitelisted globs pass every rule (none by default)."""
    low, path, query = F.lower(url), F.lower(part(url, "path")), F.lower(part(url, "query"))
    page = F.regexp_extract(query, r"page=([^&]*)", 1)
    glob = lambda g: "(" + g.replace("*", ".*") + ")"  # noqa: E731  other characters keep their regular-expression meaning
    reason = (
        F.when(_ends_with(path, BLOCKED_EXTENSIONS), "extension")
        .when(contains_any(low, NOISE_WORDS) & (segments(path) > 1), "noise")
        .when(contains_any(query, DATE_PARAMS) & contains_any(low, DATE_WORDS), "date")
        .when(page.rlike(r"^\s*[+-]?\d{1,9}\s*$") & (F.trim(page).try_cast("int") > 3), "pagination")
        .when(contains_any(query, TRACKING_PARAMS), "tracking")
    )
    if blacklist:
        reason = reason.when(url.rlike("|".join(map(glob, blacklist))), "blacklist")
    return F.when(url.rlike("|".join(map(glob, whitelist))), F.lit(None)).otherwise(reason) if whitelist else reason


def should_follow(url: Column, source: Column, allowed_hosts: tuple[str, ...] = ()) -> Column:
    """http(s) only, no files, no anchors into the page itself; with allowed_hosts, hosts that contain one of them."""
    bare = lambda u: F.concat(part(u, "scheme"), F.lit("://"), part(u, "host"), part(u, "path"))
    same_page = (part(url, "fragment") != "") & (part(url, "query") == "") & (bare(url) == bare(source))
    files = (*SKIPPED_EXTENSIONS, "avi", "mov") if allowed_hosts else SKIPPED_EXTENSIONS
    ok = part(url, "scheme").isin("http", "https") & ~_ends_with(part(url, "path"), files) & ~same_page
    return ok & contains_any(part(url, "host"), allowed_hosts) if allowed_hosts else ok


def priority(url: Column, source_type: Column | None = None) -> Column:
    """500 and the first band that fits, 50 more behind a faculty page, from -100 to 1000."""
    low, band = F.lower(url), None
    for terms, value in PRIORITY_BANDS:
        band = (F.when if band is None else band.when)(contains_any(low, terms), value)
    score = 500 + band.otherwise(0)
    if source_type is not None:
        score = score + F.when(source_type == "faculty", 50).otherwise(0)
    return F.greatest(F.lit(-100), F.least(F.lit(1000), score))


def is_internal(host: Column, primary_host: str) -> Column:
    return F.contains(host, F.lit(primary_host))


def next_depth(source_internal: Column, link_internal: Column, depth: Column) -> Column:
    """One more within a kind of host; crossing over starts anew."""
    return F.when(source_internal == link_internal, depth + 1).otherwise(0)


def adjusted_max_depth(word_count: Column, depth: Column, max_depth: Column, high: int = 500, low: int = 100) -> Column:
    return F.when(word_count > high, max_depth + 1).when(word_count < low, F.greatest(depth + 1, max_depth - 1)).otherwise(max_depth)


def retry_decision(status: Column, attempts: Column, max_retries: int = 3) -> Column:
    """Struct (retry, delay_s, priority_change) of the downloader's retries: 2 ** attempts seconds apart."""
    again = status.isin(500, 502, 503, 504, 522, 524, 408, 429) & (attempts < max_retries)
    return F.struct(again.alias("retry"), F.when(again, F.pow(F.lit(2.0), attempts)).alias("delay_s"), F.when(again, -1).alias("priority_change"))


def error_route(kind: Column, status: Column, attempts: Column, internal: Column) -> Column:
    """Struct (retry, priority) for a failed request; kind: http, timeout, dns, refused."""
    limited = (kind == "http") & (status == 429) & (attempts < 1)
    server = (kind == "http") & status.isin(500, 502, 503, 504) & (attempts < 2)
    late = (kind == "timeout") & internal & (attempts < 2)
    return F.struct((limited | server | late).alias("retry"), F.when(limited, -100).when(server, 100 - 50 * attempts).when(late, 150 - 50 * attempts).cast("int").alias("priority"))


def robots_override(host: Column, internal_hosts: tuple[str, ...]) -> Column:
    return contains_any(host, internal_hosts)
