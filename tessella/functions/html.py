"""HTML columns by regular expressions on the JVM: text, title, metadata, headings, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Elements whose content is no text of the page.
UNWANTED = ("script", "style", "nav", "footer", "header", "aside", "iframe", "noscript")
#: Entities and the characters they stand for.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))


def _strip(html: Column, pattern: str) -> Column:
    return F.regexp_replace(html, pattern, " ")


def _decoded(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain(html: Column) -> Column:
    """Tags out, entities decoded, white space to single spaces, none before punctuation."""
    t = bound(_strip(html, "<[^>]*>"), lambda x: F.when(F.contains(x, F.lit("&")), _decoded(x)).otherwise(x))
    t = F.regexp_replace(t, r"[\s ]+", " ")
    return F.trim(F.regexp_replace(t, r" ([.,!?;:])", "$1"))


def without_unwanted(html: Column) -> Column:
    return _strip(_strip(html, "(?is)<!--.*?-->"), rf"(?is)<({'|'.join(UNWANTED)})\b[^>]*>.*?</\1\s*>")


def main_content(html: Column) -> Column:
    """The first main element, else article, else div of a content or main class, else all of it."""
    patterns = (r"(?is)<main\b[^>]*>(.*?)</main>", r"(?is)<article\b[^>]*>(.*?)</article>", r"""(?is)<div\b[^>]*class=["'][^"']*(?:content|main)[^"']*["'][^>]*>(.*?)</div>""")

    def first(kept: Column) -> Column:
        return F.coalesce(*[bound(F.regexp_extract(kept, p, 1), lambda x: F.when(x != "", x)) for p in patterns], kept)

    return bound(without_unwanted(html), first)


def page_text(html: Column) -> Column:
    return plain(main_content(html))


def _where(lowered: Column | None, part: str, found: Column, empty: Column) -> Column:
    """What is found in pages that hold a part without which nothing can be; ``lowered``: the page in lower case, if a column has it."""
    return found if lowered is None else F.when(F.contains(lowered, F.lit(part)), found).otherwise(empty)


def meta(html: Column, name: str, attribute: str = "name", lowered: Column | None = None) -> Column:
    """Content of a meta element, null if there is none."""
    a = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*{attribute}=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*content=["']([^"']*)["'][^>]*{attribute}=["']{name}["']""", 1)
    return _where(lowered, name.lower(), F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))), F.lit(None).cast("string"))


def title(html: Column, url: Column, lowered: Column | None = None) -> Column:
    """title element, else first h1, else og:title, else the last part of the URL, else Untitled."""
    t = plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    h = plain(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    last = F.substring_index(url, "/", -1)
    return F.trim(F.coalesce(F.nullif(t, F.lit("")), F.nullif(h, F.lit("")), meta(html, "og:title", "property", lowered), F.nullif(last, F.lit("")), F.lit("Untitled")))


def headings(html: Column, limit: int = 10, lowered: Column | None = None) -> Column:
    """Structs (level, text) of h1, then h2, then h3, the first ten."""
    def level(k: int) -> Column:
        found = F.regexp_extract_all(html, F.lit(rf"(?is)<h{k}\b[^>]*>(.*?)</h{k}>"), F.lit(1))
        found = _where(lowered, f"<h{k}", found, F.when(html.isNotNull(), F.array().cast("array<string>")))
        return F.transform(found, lambda h: F.struct(F.lit(k).alias("level"), plain(h).alias("text")))

    parts = [level(k) for k in (1, 2, 3)]
    return F.slice(F.concat(*parts), 1, limit)


def metadata(html: Column, lowered: Column | None = None) -> Column:
    own = {k: meta(html, k, lowered=lowered).alias(k) for k in ("description", "keywords", "author")}
    return F.struct(*own.values(), headings(html, lowered=lowered).alias("headings"))


def hrefs(html: Column) -> Column:
    """Targets of anchors in order of appearance."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    return F.transform(raw, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))
