"""Main text of web pages by consensus host paths.

A tolerant parser makes the tree of a page in one pass: every character is looked at a bounded number of
times, whatever the markup, so time grows in proportion to a page's length.  Each container with text gets
a score from the text it holds directly or in paragraphs, less links and unlikely names, and a generalised
path: tags with their first class, without ids and with digits taken out, so that pages of one template
share it.  A path is written as its last steps and a digest of all steps, so its length is bounded.  Pages
vote for all their containers with a positive score, Spark adds the votes of each host, and the path with
most votes wins (ties: the shallower, then the first in order).  Each page is then extracted again: from
the elements on its host's winning path, or, if the page has none with text, from its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader
comments are left out by tag, role and name.  Character references are decoded, white space in a
block becomes one space, and blocks are joined by an empty line.  Null and empty pages have an empty
text and no vote.  Votes are pre-aggregated by host and path, and a host with many pages is dealt over
many tasks when its path is looked up.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import bounded_batches, fresh, look_up, own_names, save
from vicinity.llm.urlfilter import url_parts

#: A tag without odd quotes; it ends before the next "<", so trying it costs no more than the tag's own length.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[\s/]++(?:[^\s/>=\"'<]++(?:\s*+=\s*+(?:\"[^\"<]*+\"|'[^'<]*+'|[^\s\"'=<>`]++))?+)?+)*+)>")
_ATTR = re.compile(r"([^\s/>=\"'<]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?+")
_MARKUP = re.compile(r"<(?:[a-zA-Z!?]|/(?s:.))")
_START, _GAP, _NAME, _EQUALS, _BARE = re.compile(r"[a-zA-Z][^\s/>]*+"), re.compile(r"[\s/]*+"), re.compile(r"=?[^\s/>=]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements whose text never counts.
_DROPPED = frozenset("script style textarea noscript iframe template xmp head title nav header footer aside form button select option label input svg canvas object embed audio video map dialog menu".split())
_BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINER = frozenset("article main section div td body".split())
#: Elements that a new block of the listed kind closes, where end tags are missing.
_ENDS_P = _BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "li", "dd", "dt"} | {"li", "dd", "dt"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail widget widgets header masthead topbar footer "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall comment comments respond reply replies disqus discussion share sharing social related recommended recommendations "
    "pagination pager toolbar search form tags taglist skip".split()
)
#: Names that layouts also use around the whole page ("with-sidebar"): they count against parts only.
_LAYOUT = frozenset("sidebar aside rail header masthead topbar footer nav navbar navigation menu menubar banner widget widgets form search toolbar notice notices alert related tags promo share sharing social".split())
_WHOLE = 0.6
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
_LIKELY = frozenset("article content main post entry story body text".split())
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element.  ``path`` is its place in ``paths``, the page's table of (parent path, step, depth)."""

    __slots__ = ("children", "dropped", "layout", "name", "path", "tag")

    def __init__(self, tag: str, name: str = "", path: int = 0, dropped: bool = False, layout: bool = False) -> None:
        self.tag, self.name, self.path, self.dropped, self.layout = tag, name, path, dropped, layout
        self.children: list = []  # nodes and strings


class Paths:
    """The generalised paths of one page, each once; number 0 is the root's."""

    def __init__(self) -> None:
        self.steps: list[tuple[int, str, int]] = [(-1, "", 0)]
        self.numbers: dict[tuple[int, str], int] = {}
        self.digests: list[bytes] = [b""]

    def add(self, parent: int, step: str) -> int:
        found = self.numbers.get((parent, step))
        if found is None:
            found = self.numbers[parent, step] = len(self.steps)
            self.steps.append((parent, step, self.steps[parent][2] + 1))
            self.digests.append(hashlib.blake2b(self.digests[parent] + b"/" + step.encode("utf-8", "surrogatepass"), digest_size=8).digest())
        return found

    def name(self, path: int) -> str:
        """The last steps of a path, shortened, and the digest of all of them."""
        last, at = [], path
        while at > 0 and len(last) < _SHOWN:
            last.append(self.steps[at][1][:_STEP])
            at = self.steps[at][0]
        return "/".join(reversed(last)) + "#" + self.digests[path].hex()


#: Steps of a path that are shown, and characters of each.
_SHOWN, _STEP = 4, 40


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class _Page:
    """Finds tags and comments in a page.  Whether a quote or an end mark comes at all is asked once."""

    def __init__(self, text: str) -> None:
        self.text, self.lasts = text, {}

    def last(self, mark: str) -> int:
        if mark not in self.lasts:
            self.lasts[mark] = self.text.rfind(mark)
        return self.lasts[mark]

    def tag(self, at: int) -> tuple[dict[str, str], int, bool]:
        """(attributes, end, whether it ends in a slash) of a tag whose name ends at ``at``, read as browsers do.
        A quoted value that is never closed ends with the tag."""
        text, size, out = self.text, len(self.text), {}
        while True:
            at = _GAP.match(text, at).end()
            if at >= size or text[at] == ">":
                return out, min(size, at + 1), text[at - 1] == "/"
            found = _NAME.match(text, at)
            at, name, value = found.end(), found[0].lower(), ""
            if equals := _EQUALS.match(text, at):
                at = equals.end()
                quote = text[at : at + 1]
                if quote in ('"', "'") and quote:
                    stop = text.find(quote, at + 1) if self.last(quote) > at else text.find(">", at) if self.last(">") > at else size
                    value, at = text[at + 1 : stop], stop + (stop < size and text[stop] == quote)
                else:
                    found = _BARE.match(text, at)
                    value, at = found[0], found.end()
            out.setdefault(name, _html.unescape(value))

    def skip(self, at: int) -> tuple[int, str]:
        """(end, text) of a comment, a declaration or a CDATA section at ``at``."""
        text, size = self.text, len(self.text)
        for start, mark in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if text.startswith(start, at) and (mark == "-->" or self.last(mark) > at):
                stop = text.find(mark, at + (2 if mark == "-->" else len(start))) if self.last(mark) > at else -1
                return (size, "") if stop < 0 else (stop + 3, "" if mark == "-->" else text[at + len(start) : stop])
        return (text.find(">", at) + 1 if self.last(">") > at else size), ""

    def raw(self, tag: str, at: int) -> tuple[int, int]:
        """(start, end) of the end tag of an element whose content is not markup."""
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(self.text, at)
        return found.span() if found else (len(self.text), len(self.text))


def _unwanted(tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
    """(left out, only for names that layouts use too)."""
    if tag in _DROPPED:
        return True, False
    if not attrs or tag in ("html", "body", "article", "main"):
        return bool(attrs) and attrs.get("role", "") in _ROLES, False
    if attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True, False
    words = [w for k in ("class", "id") if k in attrs for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", attrs[k]).lower())]
    named = {w for w in words if w in _NAMES}
    return bool(named), bool(named) and named <= _LAYOUT


class _Open:
    """The open elements, with the places of each tag among them, so that none is searched for."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at, self.scopes = [root], {root.tag: [0]}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def cut(self, to: int) -> None:
        """Closes the elements from place ``to`` on; the root stays."""
        while len(self.stack) > max(1, to):
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in _SCOPE:
                self.scopes.pop()

    def place(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def end(self, tag: str) -> None:
        """An end tag: closes its element, unless that is outside a table cell or an article."""
        own = self.place((tag,))
        bar = 0 if tag in _TABLE else self.place(("table", "td", "th"))
        if tag not in _SCOPE:
            bar = max(bar, self.place(("article", "main", "body")))
        if own and own >= bar:
            self.cut(own)

    def begin(self, tag: str) -> None:
        """A start tag: closes the paragraph and the siblings that it ends."""
        if tag in _ENDS_P and self.stack[self.scopes[-1]].tag == "p":
            self.cut(self.scopes[-1])
        if tag in _SIBLINGS:
            own = self.place(_SIBLINGS[tag])
            if own > self.place(_STOP[tag] - _SIBLINGS[tag]):
                self.cut(own)


_SCOPE = _BLOCK | _DROPPED
_TABLE = frozenset("table tr tbody thead tfoot".split())


def parse(page: str) -> tuple[Node, Paths]:
    """The tree of a page and its paths; broken markup is mended as far as it matters here."""
    root, paths, text = Node("html"), Paths(), _Page(page)
    now, at, done, size = _Open(root), 0, 0, len(page)
    stack = now.stack
    while True:
        begin = _MARKUP.search(page, at)
        if not begin:
            break
        at = begin.start()
        found = _TAG.match(page, at)
        if at > done:
            stack[-1].children.append(page[done:at])
        if found:
            close, tag, done = found[1], found[2].lower(), found.end()
            slash, written = found[3].endswith("/"), found[3]
            attrs = _attributes(written) if written and not written.isspace() and not close else {}
        else:
            name = _START.match(page, at + 1 + (page[at + 1] == "/"))
            if not name:
                done, inside = text.skip(at)
                if inside:
                    stack[-1].children.append(_html.escape(inside))
                at = done
                continue
            close, tag = page[at + 1] == "/", name[0].lower()
            attrs, done, slash = text.tag(name.end())
        at = done
        if close:
            now.end(tag)
            continue
        now.begin(tag)
        parent = stack[-1]
        first = re.sub(r"\d+", "#", (attrs.get("class", "").split() or [""])[0]) if attrs else ""
        node = Node(tag, first, paths.add(parent.path, tag + (f".{first}" if first else "")), *_unwanted(tag, attrs))
        parent.children.append(node)
        if tag in _RAW:
            start, done = text.raw(tag, at)
            if not node.dropped:
                node.children.append(page[at:start])
            at = done
        elif tag not in _VOID and not slash:
            now.push(node)
    if done < size:
        stack[-1].children.append(page[done:])
    _spare(root)
    return root, paths


def _spare(root: Node) -> None:
    """Takes back elements left out for a layout's name that hold most of the page or its article."""
    order, suspects = [root], False
    for x in order:  # grows meanwhile: parents come before their children
        order += [c for c in x.children if not isinstance(c, str) and (c.layout or not c.dropped)]
        suspects = suspects or x.layout
    if not suspects:
        return
    held, whole = {}, {}
    for x in reversed(order):
        below = [c for c in x.children if not isinstance(c, str) and c in held]
        held[x] = sum(len(c.strip()) for c in x.children if isinstance(c, str)) + sum(held[c] for c in below)
        whole[x] = x.tag in ("article", "main") or any(whole[c] for c in below)
    for x in order:
        if x.layout and (whole[x] or held[x] >= _WHOLE * max(1, held[root])):
            x.dropped = False


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below a node, in order, without what never counts."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(run)).replace("\x00", "")).strip()
        run.clear()
        if text:
            out.append(text)

    work: list = [node]
    while work:
        item = work.pop()
        if isinstance(item, str):
            run.append(item)
        elif item is None:
            close()
        elif item.tag == "br":
            run.append(" ")
        elif not item.dropped or item is node:
            if item.tag in _BLOCK:
                close()
                work.append(None)
            elif item.tag in ("img", "wbr"):
                continue
            work.extend(reversed(item.children))
    close()
    return out


def _has_text(text: str) -> bool:
    stripped = text.strip()
    return bool(stripped) and ("&" not in stripped or bool(_html.unescape(stripped).replace("\x00", "").strip()))


def candidates(root: Node) -> list[tuple[float, int, Node]]:
    """(score, order, node) of containers with text.  A paragraph's characters count for its container
    in full and for the next two above by a half and a quarter; text in links counts against."""
    scores: dict[Node, float] = {}
    visited: list[tuple[Node, tuple]] = []
    work: list[tuple[Node, tuple, tuple, bool]] = [(root, (), (), False)]
    while work:
        x, up, above, linked = work.pop()
        if x.dropped:
            continue
        visited.append((x, above))
        if x.tag in _CONTAINER:
            scores[x] = scores.get(x, 0.0) + (25.0 if x.tag in ("article", "main") else 0.0) + (15.0 if set(_WORDS.findall(x.name.lower())) & _LIKELY else 0.0)
            up = (x, *up[:2])
        held = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        if held and up:
            sign = -1.0 if linked or x.tag == "a" else 1.0
            for k, container in enumerate(up):
                scores[container] += sign * held / (1 << k)
        work.extend((c, up, (x,), linked or x.tag == "a") for c in x.children if not isinstance(c, str))
    filled: set[Node] = set()  # with text below, children before their parents
    for x, above in reversed(visited):
        if x in filled or any(isinstance(c, str) and _has_text(c) for c in x.children):
            filled.add(x)
            filled.update(above)
    at = {x: i for i, (x, _) in enumerate(visited)}
    return sorted(((s, at[x], x) for x, s in scores.items() if s > 0 or x in filled), key=lambda c: (-c[0], c[1]))


#: Weight of a page's best path; each next one has half of that before, down to 1.
_BEST = 1 << 16


def votes(page: str | None) -> list[tuple[str, int, int]]:
    """(path, depth, weight) for all containers of a page with a positive score, once for each path."""
    if not page:
        return []
    root, paths = parse(page)
    first = dict.fromkeys(node.path for score, _, node in candidates(root) if score > 0)
    return [(paths.name(p), paths.steps[p][2], max(1, _BEST >> min(k, 16))) for k, p in enumerate(first)]


def extract(page: str | None, path: str | None) -> str:
    """The text of the page's elements on ``path``, or of its best container; empty if none has text."""
    if not page:
        return ""
    (root, paths), found = parse(page), []
    if path:
        digest = path.rpartition("#")[2]
        wanted = {p for p, x in enumerate(paths.digests) if x.hex() == digest}
        work: list = [root] if wanted else []
        while work:  # outermost elements on the path, in page order
            x = work.pop()
            if isinstance(x, str) or x.dropped:
                continue
            if x.path in wanted:
                found += blocks(x)
            else:
                work.extend(reversed(x.children))
    if not found:
        best = candidates(root)
        found = blocks(best[0][2]) if best else blocks(root)
    return "\n\n".join(found)


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, pages): the winning path of each host and how many pages voted for it."""
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("array<struct<path:string,depth:int,weight:long>>")
    def ballots(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("path", "depth", "weight"), v, strict=True)) for v in votes(x)] for x in texts], dtype=object)

    host: Column = url_parts(F.col(url))[0]
    cast = pages.select(host.alias("host"), F.explode(ballots(F.col(html))).alias("vote"))
    counted = cast.groupBy("host", F.col("vote.path").alias("path")).agg(F.sum("vote.weight").alias("weight"), F.min("vote.depth").alias("depth"), F.count("*").alias("pages"))
    best = F.min_by(F.struct("path", "pages"), F.struct(-F.col("weight"), "depth", "path"))  # partial, so no host's paths meet in one task
    return counted.groupBy("host").agg(best.alias("best")).select("host", "best.path", "best.pages")


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each row.  ``pages`` is read twice: for votes and for texts.

    Null urls and urls without a host belong to one host of no name, repeated rows give and count as a
    row each, an empty table gives an empty one.  Other columns are not read, whatever their names; a
    ``key`` or ``url`` with the name of a new column is an error."""
    own_names(key, "text", "n_chars")
    own_names(url, "text", "n_chars")
    winners = save(host_paths(pages, url, html), "host-paths")

    @F.pandas_udf("string")
    def texts(page: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([extract(x, p) for x, p in zip(page, path, strict=True)], dtype=object)

    host, path, n, cell = fresh(pages.select(key, url, html), "host", "path", "pages", "cell")
    rows = pages.select(F.col(key), F.col(url), F.col(html), url_parts(F.col(url))[0].alias(host))
    joined = look_up(rows, winners.toDF(host, path, n), host, n, salt=[url, html])
    return joined.select(key, url, texts(F.col(html), F.col(path)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
