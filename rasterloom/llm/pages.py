"""Main text of web pages, with each site's templates removed.

Every element's subtree is hashed; a subtree that recurs on a large share of a host's pages is that host's template.
Counts are made in Spark per host and hash. A second pass deletes template subtrees, and elements whose tag, role or
class says that they are menus, adverts and the like, and reads the blocks of what is left of the article.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import flat_rows, map_rows, table, whole_text, written

#: Fixed values of HTML: elements without content, with raw text, that end an open paragraph, and that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_ITSELF = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dd dt table tbody thead tr td th b i em strong a span code figcaption".split())
#: Elements, roles and words of class or id that never hold the article's text.
CHROME = frozenset("nav footer aside form head script style noscript iframe template button select dialog menu svg object".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu modal "
    "nav navbar navigation newsletter notice notices pagination popup promo related share sharing sidebar social sponsor sponsored subscribe widget".split()
)
#: Words that may go with those in one class name: site-footer, cookie-banner-wrapper, share_buttons, but not share-price.
BESIDE = frozenset(
    "area articles bar block bottom box buttons consent container content global group inner items left links list main outer page panel posts primary right "
    "secondary section signup site slot thread top unit wrap wrapper".split()
)
NAME = re.compile(r"[a-z][^\s/>]*", re.I)
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:([\"'])|([^\s>]*)))?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Elements that hide the open p, li, ... outside them from those inside.
WALLS = {"p": frozenset("article section div td th li body blockquote button main aside".split()), "option": frozenset(["select"])} | {
    tag: frozenset(walls) for tag, walls in ENDS_ITSELF.items()
}


@dataclass
class Element:
    """``near``: the open p, li and the like that a sibling inside here would end, by tag."""

    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    up: Element | None = None
    inside: list = field(default_factory=list)
    near: dict[str, Element] = field(default_factory=dict)

    def chrome_named(self) -> bool:
        """Whether a class, the id or the role says that this is a menu, an advert and the like: a whole name, not a part of one."""
        if any(w in ROLES for w in self.attributes.get("role", "").lower().split()):
            return True
        for name in f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}".lower().split():
            parts = [w for w in re.split(r"[^a-z]+", name) if w]
            if any(w in NAMES for w in parts) and all(w in NAMES or w in BESIDE for w in parts):
                return True
        return False


class Reader:
    """Reads markup from left to right, in time linear in its length."""

    def __init__(self, html: str) -> None:
        self.html, self.missing = html, set()

    def find(self, what: str, at: int) -> int:
        """As str.find; what was once not found is not looked for again."""
        if what in self.missing:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """The attributes from a place in a tag on, whether it closes itself, and where it ends.

        A quote starts a value right after = only; it ends at the next such quote, or where there is none at the next >.
        """
        html, found = self.html, {}
        while m := ATTRIBUTE.match(html, at):
            name, quote, value, at = m[1].lower(), m[2], m[3] or "", m.end()
            if quote:
                end = self.find(quote, at)
                if end < 0:
                    end = self.find(">", at)
                    end = len(html) if end < 0 else end
                value, at = html[at:end], end + (html[end : end + 1] == quote)
            found.setdefault(name, unescape(value))
        end = self.find(">", at)
        end = len(html) if end < 0 else end
        return found, "/" in html[at:end], min(end + 1, len(html))

    def tokens(self):
        """("text", text), ("open", tag, attributes, closes itself) and ("close", tag); raw text, comments and the like left out."""
        html, at = self.html, 0
        while at < len(html):
            mark = self.find("<", at)
            if mark < 0:
                mark = len(html)
            if mark > at:
                yield "text", html[at:mark]
                at = mark
                continue
            slash = html.startswith("/", at + 1)
            if m := NAME.match(html, at + 1 + slash):
                tag = m[0].lower()
                attributes, itself, at = self.attributes(m.end())
                if slash:
                    yield "close", tag
                    continue
                yield "open", tag, attributes, itself
                if tag in RAW:
                    end = RAW_END[tag].search(html, at)
                    at = end.start() if end else len(html)
            elif html.startswith("<!--", at):
                end = self.find("-->", at + 2)
                at = len(html) if end < 0 else end + 3
            elif html[at + 1 : at + 2] in ("!", "?", "/"):
                end = self.find(">", at)
                at = len(html) if end < 0 else end + 1
            else:
                yield "text", "<"
                at += 1


def parse(html: str) -> Element:
    """The element tree; unclosed and stray tags are mended as browsers do for paragraphs, items and cells."""
    top = here = Element("#")
    opened: Counter = Counter()  # of block elements; other elements, by the innermost block that holds them
    within = [Counter()]

    def leave(until: Element) -> Element:
        found = here
        while True:
            if found.tag in BLOCKS:
                opened[found.tag] -= 1
                within.pop()
            else:
                within[-1][found.tag] -= 1
            if found is until:
                return found.up
            found = found.up

    for kind, tag, *more in Reader(html).tokens():
        if kind == "text":
            here.inside.append(unescape(tag))
        elif kind == "close":
            if (opened if tag in BLOCKS else within[-1])[tag]:
                found = here
                while found.tag != tag:
                    found = found.up
                here = leave(found)
        else:
            attributes, itself = more
            ended = ["p"] if tag in BLOCKS or tag == "p" else []
            if tag in ENDS_ITSELF:
                ended += ["dd", "dt"] if tag in ("dd", "dt") else ["td", "th", "tr"] if tag == "tr" else ["td", "th"] if tag in ("td", "th") else [tag]
            for other in ended:
                if other in here.near:
                    here = leave(here.near[other])
            new = Element(tag, attributes, here)
            here.inside.append(new)
            if tag not in VOID and not (itself and tag not in BLOCKS and tag not in PROSE and tag not in RAW):
                hidden = [k for k in here.near if tag in WALLS[k]]
                new.near = {k: v for k, v in here.near.items() if k not in hidden} if hidden or tag in WALLS else here.near
                if tag in WALLS:
                    new.near[tag] = new
                if tag in BLOCKS:
                    opened[tag] += 1
                    within.append(Counter())
                else:
                    within[-1][tag] += 1
                here = new
    return top


def digest(element: Element, seen: dict[int, int]) -> str:
    """A subtree's content in one string; fills ``seen`` with the hash of it and of all below, by object."""
    parts = []
    stack = [(element, 0)]
    done: dict[int, str] = {}
    while stack:
        node, state = stack.pop()
        if not state:
            stack.append((node, 1))
            stack += [(x, 0) for x in node.inside if not isinstance(x, str)]
            continue
        parts = [x if isinstance(x, str) else done.pop(id(x)) for x in node.inside]
        body = " ".join(" ".join(parts).split())
        key = xxhash.xxh64_intdigest(f"{node.tag}\0{body}".encode("utf-8", "surrogatepass"))
        if body:
            seen[id(node)] = key - (1 << 64) if key >> 63 else key
        done[id(node)] = f"<{node.tag}:{key:x}>" if body else ""
    return done[id(element)]


def is_chrome(node: Element, in_article: bool) -> bool:
    if node.tag == "form":
        return not holds_article(node)
    if node.tag in CHROME or (node.tag == "header" and not in_article):
        return True
    if not node.attributes or node.tag in ("body", "html", "article", "main"):
        return False
    return "hidden" in node.attributes or node.chrome_named()


def holds_article(form: Element) -> bool:
    """Whether a form wraps an article, as some sites' pages are one form."""
    left = [form]
    while left:
        node = left.pop()
        if node.tag in ("article", "main", "h1"):
            return True
        left += [x for x in node.inside if not isinstance(x, str) and x.tag != "form"]
    return False


def is_main(node: Element) -> bool:
    return node.tag == "main" or "main" in node.attributes.get("role", "").lower().split()


def articles(top: Element) -> list[Element]:
    """The outermost article elements outside menus and the like, else the main element, else the body, else all."""
    for wanted in ("article", "main", "body"):
        found, left = [], [top]
        while left:
            node = left.pop()
            if node.tag == wanted or (wanted == "main" and is_main(node)):
                if not (wanted == "article" and node.chrome_named()):  # a reader's comment
                    found.append(node)
            elif not is_chrome(node, False):
                left += [x for x in reversed(node.inside) if not isinstance(x, str)]
        if found:
            return found
    return [top]


def main_text(html: str, templates: frozenset[int]) -> str:
    """The blocks of the article, joined by newlines, without elements and templates that don't belong to it.

    An article's own prose stays even where many pages repeat it; other elements that recur go.
    """
    top = parse(html)
    seen: dict[int, int] = {}
    if templates:
        digest(top, seen)
    blocks: list[list[str]] = [[]]
    for start in articles(top):
        named = start.tag == "article" or is_main(start)
        left: list = [start]
        while left:
            node = left.pop()
            if node is None:
                blocks.append([])
            elif isinstance(node, str):
                blocks[-1].append(node)
            elif node.tag == "br":
                blocks[-1].append(" ")
            else:
                if node is not start and (is_chrome(node, named) or (seen.get(id(node)) in templates and not (named and node.tag in PROSE))):
                    blocks[-1].append(" ")
                    continue
                if node.tag in BLOCKS:
                    blocks.append([])
                    left.append(None)
                left += reversed(node.inside)
        blocks.append([])
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def subtree_hashes(html: str) -> list[int]:
    """The different hashes of a page's subtrees that hold text, but the whole page's."""
    top = parse(html)
    seen: dict[int, int] = {}
    digest(top, seen)
    return sorted({h for k, h in seen.items() if k != id(top)})


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def templates(pages: DataFrame, share: float = 0.2, least: int = 3) -> DataFrame:
    """Rows (host, hashes): subtrees on at least ``share`` of a host's different pages and on ``least`` of them.

    Pages of equal html count once, so a mirrored article is no template. A host has at most 1 / share times as many
    templates as a mean page has subtrees, so the lists stay small.
    """
    schema = StructType([StructField("host", StringType()), StructField("page", LongType()), StructField("hash", LongType())])
    rows = pages.select(host().alias("host"), F.xxhash64("html").alias("page"), whole_text("html").alias("html"))
    found = flat_rows(rows, lambda: lambda h, p, t: [(h, p, x) for x in subtree_hashes(t)], schema)
    counts = found.groupBy("host", "hash").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least)
    sizes = rows.groupBy("host").agg(F.count_distinct("page").alias("of")).where(F.col("of") >= least)
    often = counts.join(sizes, "host").where(F.col("n") >= share * F.col("of"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text) of every page: the article's text, empty where there is none or html is null.

    Pages whose url is null or has no host share the empty host. Repeated rows give repeated results; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select("page_id", "url", host().alias("host"), whole_text("html").alias("html"))
    known = written(templates(pages.select("url", "html")), "templates")
    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "hashes")
    schema = StructType([*(StructField(c, pages.schema[c].dataType) for c in ("page_id", "url")), StructField("text", StringType())])
    return map_rows(joined, lambda: lambda key, url, html, hashes: (key, url, main_text(html, frozenset(hashes or ()))), schema)


def op4(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
