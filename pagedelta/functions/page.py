"""What is read from a page's HTML: signals of its tree, and its main text.

One UDF returns all of it, so a page crosses to Python once. Hash, word count and snippet are native expressions over
the text that comes back.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Elements, and substrings of class and id, whose subtrees are not content.
STRIP_TAGS = ("script", "style", "nav", "header", "footer", "noscript", "svg", "iframe", "aside", "form")
STRIP_CLASSES = (
    "sidebar", "side-bar", "related", "recommended", "popular",
    "newsletter", "subscribe", "signup", "sign-up", "cta",
    "social", "share", "sharing", "comments", "comment",
    "breadcrumb", "pagination", "widget", "ad", "ads",
    "banner", "cookie", "popup", "modal", "menu",
    "table-of-contents", "toc",
)
STRIP_IDS = (
    "sidebar", "related", "recommended", "comments", "newsletter",
    "subscribe", "social", "share", "breadcrumb", "toc",
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
BARRIER = frozenset("table ul ol dl div article section main aside nav header footer form body html".split())
SIGNALS = "struct<title:string,meta_description:string,h1_tags:array<string>,noindex:boolean,canonical:string,schemas:array<string>,main_text:string>"
_NAMES = [x.split(":")[0] for x in SIGNALS.removeprefix("struct<").split(",")]


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    """A tolerant tree: end tags that nothing opened are ignored, and some start tags end what they cannot be in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in shut:
                del self.open[k:]
                break
            if self.open[k].tag in BARRIER:
                break
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known kind
            return self.parse_bogus_comment(i)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def walk(root: Node, enter=lambda node: True):
    """Nodes and texts in document order, without what is below nodes that ``enter`` refuses; no recursion."""
    todo = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif enter(x):
            yield x
            todo.extend(reversed(x.children))


def _texts(node: Node, enter=lambda node: True) -> list[str]:
    return [s for x in walk(node, enter) if isinstance(x, str) and (s := x.strip())]


def _types(data) -> list[str]:
    """The @type values of a JSON-LD object, or of each object of a list; strings only."""
    out = []
    for item in data if isinstance(data, list) else [data]:
        if isinstance(item, dict):
            kind = item.get("@type", "")
            out += [k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str) and k]
    return out


def is_content(node: Node) -> bool:
    if node.tag in STRIP_TAGS:
        return False
    classes = " ".join(node.attrs.get("class", "").split()).lower()
    own_id = node.attrs.get("id", "").lower()
    return not any(c in classes for c in STRIP_CLASSES) and not any(i in own_id for i in STRIP_IDS)


def read_page(html: str | None) -> tuple:
    """Values in the order of ``SIGNALS``; signals come from the whole tree, the text from what is content."""
    root = parse(html or "")
    title = description = canonical = robots = None
    h1, schemas = [], []
    for x in walk(root):
        if isinstance(x, str):
            continue
        if x.tag == "title" and title is None:
            title = x.children[0].strip() if len(x.children) == 1 and isinstance(x.children[0], str) else ""
        elif x.tag == "meta":
            name = x.attrs.get("name")
            if name == "description" and description is None:
                description = x.attrs.get("content", "").strip()
            elif name == "robots" and robots is None:
                robots = x.attrs.get("content", "").lower()
        elif x.tag == "link" and canonical is None and "canonical" in x.attrs.get("rel", "").split():
            canonical = x.attrs.get("href", "").strip()
        elif x.tag == "h1":
            if whole := "".join(_texts(x)):
                h1.append(whole)
        elif x.tag == "script" and x.attrs.get("type") == "application/ld+json":
            try:
                schemas += _types(json.loads("".join(c for c in x.children if isinstance(c, str)) or "null"))
            except ValueError:
                continue
    nodes = [x for x in walk(root, is_content) if isinstance(x, Node)]
    area = next((x for tag in ("main", "article", "body") for x in nodes if x.tag == tag), root)
    return (title or "", description or "", h1, "noindex" in (robots or ""), canonical or "", schemas, " ".join(_texts(area, lambda n: n is area or is_content(n))))


def page_signals(html: Column) -> Column:
    """``read_page`` as a struct column."""
    return F.pandas_udf(_signals, SIGNALS)(html)


def _signals(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=_NAMES)


def _signals_or_error(html: pd.Series) -> pd.DataFrame:
    def one(h: str | None) -> tuple:
        try:
            return (*read_page(h), None)
        except Exception as e:  # one page must not fail the others; the error is a value
            return (*[None] * len(_NAMES), f"{type(e).__name__}: {e}"[:500])

    return pd.DataFrame([one(h) for h in html], columns=[*_NAMES, "error"])


def extract_or_error(captures: DataFrame) -> DataFrame:
    """Page extracts of captures (domain, url, html), with the error of those that could not be read."""
    read = F.pandas_udf(_signals_or_error, SIGNALS.removesuffix(">") + ",error:string>")
    return _extracts(captures.select("domain", "url", read("html").alias("p")).select("domain", "url", "p.*"), "error")


def extract(captures: DataFrame) -> DataFrame:
    """Page extracts of captures (domain, url, html)."""
    return _extracts(captures.select("domain", "url", page_signals(F.col("html")).alias("p")).select("domain", "url", "p.*"))


def _extracts(rows: DataFrame, *more: str) -> DataFrame:
    text = T.normalize_text(F.col("main_text"))
    rows = rows.withColumn("main_text", text)
    body = F.col("main_text")
    return rows.select(
        "domain", "url", T.content_hash(body).alias("content_hash"), "title", "meta_description", "h1_tags", T.word_count(body).alias("word_count"),
        "canonical", "schemas", T.snippet(body).alias("content_snippet"), "noindex", *more,
    )


# The same signals by expressions alone, exact for pages whose markup is regular.

ARTICLE = r"(?is)<article[^>]*>(.*?)(?:</article>|$)"


def quick_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def quick_h1(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def quick_text(html: Column) -> Column:
    plain = F.regexp_replace(F.regexp_extract(html, ARTICLE, 1), r"(?s)<!--.*?-->|<[^>]+>", " ")
    plain = F.replace(F.replace(plain, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def json_ld_types(json_text: Column) -> Column:
    """@type of a JSON-LD document held in a column, by variant access: a string, a list, or objects in a list."""
    v = F.try_parse_json(json_text)
    one = lambda x: F.coalesce(
        F.try_variant_get(x, "$['@type']", "array<string>"),
        F.transform(F.filter(F.array(F.try_variant_get(x, "$['@type']", "string")), lambda t: t.isNotNull()), lambda t: t),
    )
    items = F.try_variant_get(v, "$", "array<variant>")
    many = F.flatten(F.transform(items, one))
    return F.coalesce(F.when(items.isNotNull(), many), one(v), F.array().cast("array<string>"))
