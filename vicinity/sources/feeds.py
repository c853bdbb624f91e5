"""Feeds: RSS, Atom and JSON Feed documents to items, with coordinates; search addresses.

A document is cut into its entries, and each is mended and read by itself, so that a broken one costs no
other: :func:`broken_entries` lists what could not be read.  All of it runs in the JVM (``from_xml``,
``from_json``); :func:`entries` does the same for a document in Python, for readers outside of Spark.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.functions import dates, markup, text
from vicinity.functions.shared import evaluated

TITLE_CHARS = 120
TAGS = {"id": ["guid", "id"], "title": ["title"], "summary": ["description", "summary"], "content": ["encoded", "content"], "published": ["pubdate", "published", "date"], "updated": ["updated", "modified"]}
COMMENT = r"(?s)<!--.*?-->"
ENTRY_START = r"(?i)<(?:[\w.-]+:)?(?:item|entry)(?=[\s>/])"
ENTRY_BODY = r"(?is)^([^>]*>.*?)</(?:[\w.-]+:)?(?:item|entry)\s*>"
MENDING = [  # characters that XML has not; a stray & or an undeclared entity; a stray <
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""),
    (r"&(?!(?:amp|lt|gt|quot|apos|#0*[1-9][0-9]*|#[xX]0*[1-9a-fA-F][0-9a-fA-F]*);)", "&amp;"),
    (r"<(?![A-Za-z_/])", "&lt;"),
]
ENTRY = "struct<id:string,title:string,summary:string,content:string,links:array<struct<href:string,rel:string>>,published:string,updated:string,lat:double,lon:double>"


def _local(tag) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _points(node) -> tuple[float | None, float | None]:
    found = {}
    for x in node.iter():
        name, value = _local(x.tag), (x.text or "").strip()
        if name == "point" and value:
            parts = value.replace(",", " ").split()
            if len(parts) >= 2:
                found.setdefault("point", parts[:2])
        elif name in ("lat", "long") and value:
            found.setdefault(name, value)
    pair = found.get("point") or [found.get("lat"), found.get("long")]
    try:
        return float(pair[0]), float(pair[1])
    except (TypeError, ValueError):
        return None, None


def _inner(node) -> str:
    """An element's text; markup inside it, as some feeds have it, is written out."""
    return (node.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in node)


def _entry(node) -> dict:
    e: dict = {"id": None, "title": None, "summary": None, "content": None, "links": [], "published": None, "updated": None}
    for c in node:
        name, value = _local(c.tag), _inner(c).strip()
        if name == "link":
            href = c.get("href") or value
            if href:
                e["links"].append({"href": href, "rel": c.get("rel")})
        else:
            field = next((f for f, tags in TAGS.items() if name in tags), None)
            if field:
                e[field] = e[field] or value or None
    e["lat"], e["lon"] = _points(node)
    return e


def _mended_entries(document: str) -> list[dict]:
    """The entries of a document that is not well-formed, each read by itself."""
    plain = re.sub(COMMENT, "", re.sub(r"(?s)<!\[CDATA\[(.*?)\]\]>", lambda m: m[1].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"), document))
    out = []
    for piece in re.split(ENTRY_START, plain)[1:]:
        whole = re.match(ENTRY_BODY, piece)
        mended = f"<item{whole[1]}</item>" if whole else ""
        for pattern, by in MENDING:
            mended = re.sub(pattern, by, mended)
        bare = re.sub(r"<[^>]*>", lambda m: re.sub(r"(</?|\s)[\w.-]+:(?=[\w.-]+)", r"\1", re.sub(r"\sxmlns(?::[\w.-]+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "", m[0])), mended)
        try:
            out.append(_entry(ElementTree.fromstring(bare)))
        except ElementTree.ParseError:
            continue
    return out


def _xml_entries(document: str) -> list[dict]:
    try:
        root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", document.strip().lstrip("\ufeff")))
    except ElementTree.ParseError:
        return _mended_entries(document)
    return [_entry(node) for node in root.iter() if _local(node.tag) in ("item", "entry")]


def entries(document: str | None) -> list[dict]:
    """The entries of a feed document of any of the three kinds."""
    if not document or not document.strip():
        return []
    if document.lstrip("﻿ \t\r\n").startswith("{"):
        try:
            got = json.loads(document).get("items")
        except (ValueError, AttributeError):
            return []
        return [
            {"id": str(x["id"]) if x.get("id") is not None else None, "title": x.get("title"), "summary": x.get("summary"), "content": x.get("content_html") or x.get("content_text"), "links": [{"href": x["url"], "rel": None}] if x.get("url") else [], "published": x.get("date_published"), "updated": x.get("date_modified"), "lat": None, "lon": None}
            for x in got or [] if isinstance(x, dict)
        ]
    return _xml_entries(document)


def _escaped(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], c)


def _without_cdata(c: Column) -> Column:
    """CDATA sections written as text, comments taken out."""
    close = lambda x: F.instr(x, "]]>")
    section = lambda x: F.when(close(x) == 0, x).otherwise(F.concat(_escaped(F.substring(x, F.lit(1), close(x) - 1)), F.substring(x, close(x) + 3, F.length(x))))
    parts = F.split(c, r"<!\[CDATA\[")
    return F.regexp_replace(F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), section), "")), COMMENT, "")


def _xml_piece(piece: Column) -> Column:
    body = F.regexp_extract(piece, ENTRY_BODY, 1)
    whole = F.concat(F.lit("<item"), F.when(body != "", F.concat(body, F.lit("</item>"))).otherwise(piece))
    return reduce(lambda x, m: F.regexp_replace(x, m[0], m[1]), MENDING, whole)


def raw_entries(documents: DataFrame, body: str = "xml") -> DataFrame:
    """(source_name, is_json, raw) for each entry of documents (source_name, body), mended; blank and null
    documents have none."""
    rows = documents.select("source_name", F.regexp_replace(F.col(body), r"^[\uFEFF\s]+", "").alias("body")).where("body <> ''").withColumn("is_json", F.startswith("body", F.lit("{")))
    pieces = F.slice(F.split(_without_cdata(F.col("body")), ENTRY_START), 2, F.length("body"))
    kept = F.filter(pieces, lambda x: ~x.rlike(r"^[^>]*/>"))
    listed = F.from_json("body", "items array<string>")["items"]
    cut = F.when(F.col("is_json"), listed).otherwise(kept)
    each = rows.select("source_name", "is_json", F.explode(cut).alias("piece"))
    return evaluated(each, raw=F.when(F.col("is_json"), F.col("piece")).otherwise(_xml_piece(F.col("piece")))).drop("piece")


def read_entries(raw: DataFrame) -> DataFrame:
    """Rows of :func:`raw_entries` with the entry struct ``e`` and ``broken``, the text of one that cannot be
    read (``e`` is null then)."""
    lists = ", ".join(f"{t} array<{'struct<_VALUE:string>' if t == 'guid' else 'string'}>" for tags in TAGS.values() for t in tags)
    kind = f"{lists}, link array<struct<_VALUE:string,_href:string,_rel:string>>, point array<struct<_VALUE:string,lat:string,long:string>>, lat array<string>, long array<string>, broken string"
    x = F.from_xml("raw", kind, {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken"})
    j = F.from_json("raw", "id string, url string, title string, summary string, content_html string, content_text string, date_published string, date_modified string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = evaluated(raw, x=F.when(~F.col("is_json"), x), j=F.when(F.col("is_json"), j))

    def first(field: str) -> Column:
        said = [F.transform(F.col(f"x.{t}"), lambda v: v["_VALUE"]) if t == "guid" else F.col(f"x.{t}") for t in TAGS[field]]  # noqa: B023
        words = F.flatten(F.array(*[F.coalesce(s, F.array().cast("array<string>")) for s in said]))
        return F.get(F.filter(F.transform(words, text.squeeze_ends), lambda v: v.isNotNull() & (v != "")), F.lit(0))

    links = F.filter(F.transform("x.link", lambda v: F.struct(F.coalesce(F.nullif(v["_href"], F.lit("")), F.nullif(text.squeeze_ends(v["_VALUE"]), F.lit(""))).alias("href"), v["_rel"].alias("rel"))), lambda v: v["href"].isNotNull())
    point = F.filter("x.point", lambda v: F.size(_numbers(v["_VALUE"])) >= 2)
    pair = _numbers(F.get(point, F.lit(0))["_VALUE"])
    coordinate = lambda i, name: F.coalesce(F.get(pair, F.lit(i)), F.get(F.col(f"x.{name}"), F.lit(0)), F.get(F.filter(F.transform("x.point", lambda v: v[name]), lambda v: v.isNotNull()), F.lit(0))).try_cast("double")
    lat, lon = coordinate(0, "lat"), coordinate(1, "long")
    both = lambda c: F.when(lat.isNotNull() & lon.isNotNull(), c)
    xml = F.struct(*[first(f).alias(f) for f in ("id", "title", "summary", "content")], F.coalesce(links, F.array().cast("array<struct<href:string,rel:string>>")).alias("links"), first("published").alias("published"), first("updated").alias("updated"), both(lat).alias("lat"), both(lon).alias("lon"))
    url = F.when(F.coalesce(F.col("j.url"), F.lit("")) != "", F.array(F.struct(F.col("j.url").alias("href"), F.lit(None).cast("string").alias("rel")))).otherwise(F.array().cast("array<struct<href:string,rel:string>>"))
    nothing = F.lit(None).cast("double")
    js = F.struct(*[F.col(f"j.{f}").alias(f) for f in ("id", "title", "summary")], F.coalesce(F.nullif("j.content_html", F.lit("")), "j.content_text").alias("content"), url.alias("links"), F.col("j.date_published").alias("published"), F.col("j.date_modified").alias("updated"), nothing.alias("lat"), nothing.alias("lon"))
    broken = F.coalesce("x.broken", "j.broken")
    return evaluated(rows, e=F.when(broken.isNull(), F.when(F.col("is_json"), js.cast(ENTRY)).otherwise(xml.cast(ENTRY))), broken=broken).drop("x", "j")


def _numbers(c: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(c, ",", " "), r"^\s+|\s+$", ""), r"\s+")


def broken_entries(documents: DataFrame, body: str = "xml") -> DataFrame:
    """(source_name, broken): entries that cannot be read, as mended, and documents without any start of a
    feed, whole."""
    bad = read_entries(raw_entries(documents, body)).where("broken is not null").select("source_name", "broken")
    strange = documents.select("source_name", F.col(body).alias("broken")).where((F.trim("broken") != "") & ~F.col("broken").rlike(r"(?i)<(?:[\w.-]+:)?(?:rss|feed|rdf)[\s>]|\A[\uFEFF\s]*\{"))
    return bad.unionByName(strange)


def preferred_link(links: Column) -> Column:
    """The first link that is no other kind, else the first."""
    plain = F.filter(links, lambda x: x["rel"].isNull() | (x["rel"] == "alternate"))
    return text.null_if_blank(F.coalesce(F.get(plain, F.lit(0))["href"], F.get(links, F.lit(0))["href"]))


def normalize_entries(rows: DataFrame) -> DataFrame:
    """Feed items of rows with source_name and the entry struct ``e``; entries without any words go."""

    def words(c: Column) -> Column:
        return F.nullif(text.plain_text(c, markup.decode_entities), F.lit(""))

    title, summary, content = (words(F.col(f"e.{n}")) for n in ("title", "summary", "content"))
    cleaned = evaluated(rows.select("source_name", "e"), t=title, s=summary, c=content, link=preferred_link(F.col("e.links")))
    named = cleaned.withColumn("title", F.coalesce("t", F.substring("s", 1, TITLE_CHARS), F.substring("c", 1, TITLE_CHARS))).where("title is not null")
    published = F.coalesce(dates.parse_feed_date(F.col("e.published")), dates.parse_feed_date(F.col("e.updated")))
    guid = F.coalesce(F.nullif(F.trim("e.id"), F.lit("")), F.col("link"), F.concat("source_name", F.lit("::"), "title"))
    return named.select(guid.alias("guid"), "title", "link", F.coalesce("s", "c").alias("description"), "source_name", published.alias("published_at"), F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon"))


def parse(documents: DataFrame, body: str = "xml") -> DataFrame:
    """Feed items of documents (source_name, body)."""
    return normalize_entries(read_entries(raw_entries(documents, body)).where("broken is null").select("source_name", "e"))


def attach_coordinates(items: DataFrame, points: DataFrame) -> DataFrame:
    """Coordinates by guid, else by link, from (key, lat, lon) with distinct keys."""
    p = points.select("key", F.struct("lat", "lon").alias("p"))
    by_guid = items.join(p.withColumnsRenamed({"key": "guid", "p": "a"}), "guid", "left")
    both = by_guid.join(p.withColumnsRenamed({"key": "link", "p": "b"}), "link", "left")
    found = F.coalesce("a", "b")
    return both.withColumns({"lat": F.coalesce("lat", found["lat"]), "lon": F.coalesce("lon", found["lon"])}).select(*items.columns)


def search_feed_url(query: Column, base: str = "https://news.google.com/rss/search") -> Column:
    """The address of a news search; empty for a blank query."""
    return F.when(F.trim(query) == "", "").otherwise(F.concat(F.lit(f"{base}?q="), text.url_encode(query), F.lit("&hl=de&gl=DE&ceid=DE:de")))


def social_posts(pages: DataFrame, body: str = "body", source: str = "source_name") -> DataFrame:
    """Feed items of search result pages of posts.  Posts without an address or words go; the text
    stands for the article, so that no page is fetched."""
    kind = "posts array<struct<uri:string,author:struct<handle:string>,record:struct<text:string,createdAt:string>>>"
    rows = pages.select(F.col(source).alias("source_name"), F.explode(F.from_json(F.col(body), kind)["posts"]).alias("p"))
    said = text.squeeze_ends(F.coalesce("p.record.text", F.lit("")))
    lines = F.filter(F.split(said, "\n"), lambda x: text.squeeze_ends(x) != "")
    title = F.substring(text.squeeze_ends(F.get(lines, F.lit(0))), 1, TITLE_CHARS)
    link = F.concat(F.lit("https://bsky.app/profile/"), F.coalesce("p.author.handle", F.lit("unknown")), F.lit("/post/"), F.element_at(F.split("p.uri", "/"), -1))
    kept = rows.where(F.col("p.uri").isNotNull() & (said != ""))
    return kept.select(F.col("p.uri").alias("guid"), title.alias("title"), link.alias("link"), said.alias("description"), said.alias("article_text"), "source_name", dates.parse_feed_date(F.col("p.record.createdAt")).alias("published_at"))


def read(spark, sources: DataFrame, folder: str) -> DataFrame:
    """Items of all configured sources from saved responses ``folder/NAME.xml`` and ``folder/NAME.json``
    by their type; search sources are feeds at a made-up address.  Missing files give no items."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xml,json}").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.(?:xml|json)$", 1).alias("file"), F.decode("content", "utf-8").alias("body"))
    rows = sources.select(F.col("name").alias("source_name"), "type", F.regexp_replace("name", "[^A-Za-z0-9_-]", "_").alias("file")).join(named, "file")
    feeds = parse(rows.where(F.col("type") != "bluesky").select("source_name", "body"), "body")
    posts = social_posts(rows.where(F.col("type") == "bluesky").select("source_name", "body"))
    return feeds.unionByName(posts, allowMissingColumns=True)
