"""Entities, article bodies, page metadata and feeds: Arrow functions where expressions cannot go.

Parsers here are lenient: what is broken is passed over, and nothing raises for bad input.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities, containers, blocks and names that results depend on.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "shy": "", "mdash": "—", "ndash": "–", "hellip": "…", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "laquo": "«", "raquo": "»",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "ecirc": "ê", "euro": "€", "pound": "£", "copy": "©", "reg": "®", "trade": "™", "bull": "•", "middot": "·",
}
GOOD_CONTAINER = ["article", "articlebody", "story", "content", "main", "post", "entry", "body", "meldung", "text"]
BAD_CONTAINER = ["nav", "menu", "footer", "header", "aside", "comment", "related", "teaser", "ad", "advert", "social"]
REMOVED_BLOCKS = ["script", "style", "nav", "header", "footer", "aside", "noscript"]
CONTAINERS = ["article", "main", "section", "div"]
LEAST_BODY_BYTES = 200
DATE_NAMES = ["article:published_time", "og:article:published_time", "datePublished", "date", "dc.date", "dc.date.issued", "pubdate"]

_ENTITY = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);")


def _entity(found: re.Match) -> str:
    name = found[1]
    if name[0] != "#":
        return ENTITIES.get(name, found[0])
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else found[0]


def decode(s: str) -> str:
    """Known entities decoded once, from the left; others stay."""
    return _ENTITY.sub(_entity, s)


def strip(html: str) -> str:
    """Tags out without anything in their place, entities decoded, white space squeezed."""
    return " ".join(decode(re.sub(r"<[^>]*(?:>|\Z)", "", html).replace(">", "")).split())


def tag_blocks(html: str, tag: str) -> list[tuple[str, str]]:
    """(open tag, inside) of the elements whose name starts with ``tag``, each to the first end tag."""
    out, at, opening, closing = [], 0, re.compile(rf"<{tag}[^>]*>", re.I), re.compile(rf"</{tag}>", re.I)
    while found := opening.search(html, at):
        end = closing.search(html, found.end())
        if not end:
            break
        out.append((found[0], html[found.end() : end.start()]))
        at = end.end()
    return out


def remove_blocks(html: str, tags: list[str]) -> str:
    for tag in tags:
        html = re.sub(rf"<{tag}.*?</{tag}>", "", html, flags=re.I | re.S)
    return html


def container_score(tag: str, text: str) -> int:
    low = tag.lower()
    return 4 * sum(w in low for w in GOOD_CONTAINER) - 5 * sum(w in low for w in BAD_CONTAINER) + min(len(text.split()) // 80, 8)


def article_body(html: str) -> str:
    """The text of the container that scores best, longer ones first among equals; else of the page."""
    page, best = remove_blocks(html, REMOVED_BLOCKS), None
    for name in CONTAINERS:
        for tag, inside in tag_blocks(page, name):
            text = strip(inside)
            if len(text.encode()) >= LEAST_BODY_BYTES and (score := container_score(tag, text)) > 0:
                rank = (score, len(text.encode()))
                if best is None or rank > best[0]:
                    best = (rank, text)
    return best[1] if best else strip(page)


def attribute(tag: str, name: str) -> str | None:
    """A quoted attribute's trimmed value; null if empty or missing."""
    found = re.search(rf"{re.escape(name)}=(?:\"([^\"]*)\"|'([^']*)')", tag, re.I)
    return (decode(found[1] if found[1] is not None else found[2]).strip() or None) if found else None


def link_rel(html: str, name: str) -> str | None:
    for tag in re.findall(r"<link\b[^>]*>", html, re.I):
        if name.lower() in (attribute(tag, "rel") or "").lower().split() and (href := attribute(tag, "href")):
            return href
    return None


def meta(html: str, name: str) -> str | None:
    for tag in re.findall(r"<meta\b[^>]*>", html, re.I):
        if (attribute(tag, "property") or attribute(tag, "name") or "").lower() == name.lower() and (content := attribute(tag, "content")):
            return content
    return None


def published_text(html: str) -> str | None:
    """The page's date as it stands there: the first metadata name that is there, else structured data."""
    for name in DATE_NAMES:
        if value := meta(html, name):
            return value
    found = re.search(r"\"datePublished\"\s*:\s*\"([^\"]*)\"", html)
    return found[1] if found else None


def _number(v) -> float | None:
    if isinstance(v, bool):
        return None
    try:
        return float(v) if isinstance(v, (int, float)) else float(v.strip()) if isinstance(v, str) else None
    except ValueError:
        return None


def _location(value) -> dict | None:
    if isinstance(value, list):
        return next((x for x in map(_location, value) if x), None)
    if not isinstance(value, dict):
        return None
    kind = value.get("@type")
    if any(isinstance(k, str) and k.endswith("Event") for k in (kind if isinstance(kind, list) else [kind])):
        place = value.get("location")
        place = place[0] if isinstance(place, list) and place else place
        inner = place if isinstance(place, dict) else {}
        where = inner.get("geo") if isinstance(inner.get("geo"), dict) else {}
        lat, lon = _number(where.get("latitude")), _number(where.get("longitude"))
        inside = lat is not None and lon is not None and -90 <= lat <= 90 and -180 <= lon <= 180
        address = inner.get("address")
        if isinstance(address, dict):
            address = " ".join(p.strip() for k in ("streetAddress", "postalCode", "addressLocality") if isinstance(p := address.get(k), str) and p.strip())
        address = (address.strip() if isinstance(address, str) else "") or (place if isinstance(place, str) else None)
        return {"lat": lat if inside else None, "lon": lon if inside else None, "address": address} if inside or address else None
    return _location(value.get("@graph"))


def event_location(html: str) -> dict | None:
    """{lat, lon, address} of the first event in the page's structured data that has any."""
    for tag, body in tag_blocks(html, "script"):
        if (attribute(tag, "type") or "").lower() == "application/ld+json":
            try:
                found = _location(json.loads(body.strip()))
            except (ValueError, RecursionError):
                continue
            if found:
                return found
    return None


def district(html: str) -> str | None:
    found = re.search(r"title=\"ereignisort\"[^>]*>([^<]*)<", html, re.I)
    return (decode(found[1].strip()) or None) if found else None


def percent_decode(s: str) -> str:
    """Good escapes decoded, others kept; broken UTF-8 becomes replacement characters."""
    return unquote_to_bytes(s).decode("utf-8", "replace")


def url_parameter(url: str, keys: list[str]) -> str | None:
    """The first listed parameter with a web address; a part without ``=`` ends the search."""
    for pair in (url.split("?", 1)[1] if "?" in url else "").split("&"):
        name, sep, value = pair.partition("=")
        if not sep:
            return None
        if name.lower() in keys and (value := percent_decode(value)).startswith(("http://", "https://")):
            return value
    return None


def is_google(url: str) -> bool:
    return "news.google." in url.lower() or "google.com/url" in url.lower()


def external_link(html: str) -> str | None:
    """The first link out of an aggregator's page, unwrapped."""
    for tag in re.findall(r"<a\b[^>]*>", html, re.I):
        href = attribute(tag, "href") or ""
        href = url_parameter(href, ["url", "q"]) or href
        if href.startswith(("http://", "https://")) and "google." not in href.lower():
            return href
    return None


def article_link(feed_url: str, html: str) -> str:
    """The page's own address: canonical, else Open Graph, else the feed's; out of an aggregator if the
    address is one."""
    own = link_rel(html, "canonical") or meta(html, "og:url")
    link = own if own and own.startswith(("http://", "https://")) else feed_url
    if is_google(link) or is_google(feed_url):
        link = external_link(html) or link
    return link.strip() and link or feed_url


def _column(kind: str, f):
    @F.pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in values], dtype=object)

    return apply


def _reference(part: Column) -> Column:
    """What follows an ``&``, with the entity that it begins with decoded."""
    name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1)
    hexa, digits = F.regexp_extract(part, r"^#[xX]0*([0-9a-fA-F]{1,6});", 1), F.regexp_extract(part, r"^#0*([0-9]{1,7});", 1)
    code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(digits != "", digits).cast("int")
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair]), name)
    said = F.coalesce(named, F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")))
    return F.coalesce(F.concat(said, F.regexp_replace(part, r"^[^;]*;", "")), F.concat(F.lit("&"), part))


def decode_entities(c: Column) -> Column:
    """As :func:`decode`, in the JVM."""
    parts = F.split(c, "&")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _reference), ""))


def article_body_column(c: Column) -> Column:
    return _column("string", article_body)(c)


PAGE = "struct<text:string,published:string,lat:double,lon:double,address:string,district:string>"


def page_columns(c: Column) -> Column:
    """A struct with all that a page gives, in one pass over the text; nulls for a null page."""
    names = [f.split(":")[0] for f in PAGE[7:-1].split(",")]

    def read(html: str | None) -> tuple:
        if html is None:
            return (None,) * len(names)
        where = event_location(html) or {}
        return article_body(html) or None, published_text(html), where.get("lat"), where.get("lon"), where.get("address"), district(html)

    @F.pandas_udf(PAGE)
    def apply(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(p) for p in pages], columns=names)

    return apply(c)


def article_link_column(url: Column, html: Column) -> Column:
    @F.pandas_udf("string")
    def resolve(urls: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else article_link(u, p or "") for u, p in zip(urls, pages, strict=True)], dtype=object)

    return resolve(url, html)


def link_note(url: Column, link: Column, text_: Column, title: Column) -> Column:
    """A remark on links to rolling coverage."""
    from vicinity.functions import text

    rolling = text.is_rolling_url(url) | text.is_rolling_url(link)
    return F.when(rolling & ~text.text_matches_title(text_, title), "rolling source link may no longer show this item").when(rolling, "rolling source link")


def xml_text(xml: str, tag: str) -> str | None:
    """The text of the first element of a name that is not closed in itself; CDATA is unwrapped."""
    for found in re.finditer(rf"<{re.escape(tag)}(?:\s[^>]*)?>", xml):
        if found[0].endswith("/>"):
            continue
        end = xml.find(f"</{tag}>", found.end())
        if end < 0:
            return None
        inside = xml[found.end() : end].strip()
        cdata = re.fullmatch(r"<!\[CDATA\[(.*?)\]\]>", inside, re.S)
        return (cdata[1].strip() if cdata else decode(inside).strip()) or None
    return None


def xml_attribute(xml: str, tag: str, name: str) -> str | None:
    found = re.search(rf"<{re.escape(tag)}\s[^>]*>", xml)
    return attribute(found[0], name) if found else None
