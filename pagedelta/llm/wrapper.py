"""HTML extraction through union-free wrappers.

Pages of a host share templates. A page becomes a stream of blocks, each with the path of tags that holds it and its text.
Two streams are aligned; where they agree they stay, what only one has becomes optional, what repeats becomes a repeated
group, and text that differs becomes a slot. Aligning page after page gives the host's wrapper: a sequence of path nodes
that are plain, optional (?) or repeated (+), with no unions. Wrappers are kept by host and layout (the path that holds most of a
page's text), so that an error page or a second kind of page does not end those of the others. At a node of the wrapper a text of
any length is template that at least nine tenths of the layout's distinct pages have there; in a repeated group, which may hold the
paragraphs of the article, the layout must have ten distinct pages to tell. Pages without blocks do not count.

Alignment is a fold over the distinct shapes of a layout's pages, in sorted order and in two rounds, so neither the order of the
pages nor a task that is run again changes a wrapper, and no task sees all pages of a host. Texts are counted by Spark. Pages and
wrappers meet in a join that Spark can split, where one host holds a third of the pages.

Which slots are the content is told by evidence over all pages of a host: how much text stands there that is no link, each text
counted once. The main text is what the element around a page's content slots holds, less what is named or classed as menus,
headers, footers, sidebars, notices, adverts, forms or comments, less template text. A page alone on its host, or without the
host's content slots, is read by its tags: the articles, the main area or the rest of the body, whichever holds the text.

Defined results: a null or empty page has no text; a null url has no wrapper, its page is read by the other rules
alone; pages of equal blocks count once towards a template; only page_id, url and html are read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

MIN_BODIES = 3
CELLS = 1 << 20
SALTS = 32
# Distinct pages that a layout needs for template texts in a group that repeats, where the paragraphs of articles are too.
MIN_REPEATED = 10
# The share of a layout's distinct pages that have a template text: 9 / 10.
NUM, DEN = 9, 10

# Element names and the words in class, id and role that mark what is not the article.
LINKED = frozenset("dd div dt li td ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea xmp iframe noembed noframes title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
SKIP = frozenset(
    "aside button canvas datalist dialog footer form head header iframe input menu nav noscript object audio video script "
    "search select style svg template textarea title".split()
)
# Words of a name of menus, headers, footers, sidebars, notices, adverts, forms and comments, and words that may stand beside them: a
# name of both marks its element ("post-comments"), one with any other word does not ("has-comments", "no-sidebar").
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies discussion disqus footer footnav gdpr header login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification opinions overlay paywall popup promo promoted recommended related replies reply respond "
    "rail sidebar sidenav signup sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
BESIDE = frozenset(
    "a area articles bar block bottom box container content fixed form group holder inner item items left links list main message "
    "outer page panel post posts primary reader readers right row secondary section site slot small sticky stories text the top unit user wrap wrapper".split()
)
NOT_ARTICLE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CLOSES_P = BLOCK - frozenset("html body li dd dt td th tr tbody thead tfoot caption option optgroup summary legend".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
SCOPE = frozenset("table ul ol dl div article section main aside nav header footer form body html select blockquote".split())

#: Elements that hold blocks rather than are one, and those that hold the whole page.
AREAS = frozenset("article body center details div fieldset figure form html main search section".split()) | {""}
WHOLE = frozenset({"", "html", "body"})

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGIT = re.compile(r"\d+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


#: Elements nested deeper count as the one at this depth; beyond ``NAMED`` levels a path is named by a checksum of it.
MAX_DEPTH = 1000
NAMED = 48


class Element:
    """An open element: its path of tags, whether it is outside the article, and the article and main area that it is in."""

    __slots__ = ("area", "article", "depth", "parent", "path", "skip", "tag")

    def __init__(self, tag: str, sign: str, parent: Element | None, skip: bool) -> None:
        self.tag, self.parent, self.skip = tag, parent, skip or parent is not None and parent.skip
        self.depth = parent.depth + 1 if parent else 0
        self.article, self.area = (parent.article, parent.area) if parent else (None, None)
        up = parent.path if parent else ""
        self.path = up if not sign else f"{up}/{sign}" if self.depth <= NAMED else f"#/{crc32(f'{up}/{sign}'.encode()):x}"


class Block:
    __slots__ = ("element", "known", "linked", "parts", "skip")

    def __init__(self, element: Element) -> None:
        self.element, self.skip, self.parts, self.linked, self.known = element, element.skip, [], 0, None

    @property
    def path(self) -> str:
        return self.element.path

    @property
    def text(self) -> str:
        if self.known is None:  # asked for when the block is whole
            self.known = " ".join(entities.unescape("".join(self.parts)).split())
        return self.known

    @property
    def size(self) -> int:
        """Characters that are no links."""
        return max(0, sum(map(len, self.parts)) - self.linked)


def _marks(name: str) -> bool:
    """Whether a class or id names something that is not the article."""
    words = [w.lower() for w in _NAMES.findall(name)]
    return any(w in NOT_ARTICLE for w in words) and all(w in NOT_ARTICLE or w in BESIDE for w in words)


def _kind(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Signature, whether it is outside the article, whether it is a main area."""
    skip, main, sign = tag in SKIP, tag == "main", tag
    if attrs and not attrs.isspace():
        got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        named = f"{got.get('class', '')} {got.get('id', '')}".strip()
        role = got.get("role", "").lower()
        if named:
            sign = f"{tag}.{_DIGIT.sub('0', named)}"
            skip = skip or tag not in ("html", "body", "main", "article") and any(_marks(name) for name in named.split())
        skip = skip or role in NOT_ARTICLE_ROLES or "hidden" in got or got.get("aria-hidden") == "true"
        skip = skip or re.search(r"display\s*:\s*none", got.get("style", "")) is not None
        main = main or role == "main" or got.get("itemprop") == "articleBody"
    return sign, skip, main


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    stack = [Element("", "", None, False)]
    opened: Counter = Counter()
    now, links, over, at, size = None, 0, 0, 0, len(page)
    known: dict[tuple[str, str], tuple[str, bool, bool]] = {}

    def add(text: str) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            if text.isspace():
                return
            now = Block(stack[-1])
            out.append(now)
        elif stack[-1].skip != now.skip:  # an inline element that is not part of the article
            if stack[-1].skip:
                now.parts.append(" ")
                return
        now.parts.append(text)
        now.linked += len(text) if links else 0

    def close(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    while at < size:
        m = _TAG.search(page, at)
        add(page[at : m.start() if m else size])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                now = None
            if tag == "br":
                add(" ")
            if over and tag in BLOCK:
                over -= 1
                continue
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPE and tag not in BLOCK:
                    break
            continue
        attrs = m[3] if m[2] else m[6] or ""
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            now = None
        if tag in VOID:
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            shut = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in shut) else ():
                if stack[k].tag in shut:
                    close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        kind = known.get((tag, attrs))
        if kind is None:
            kind = known[tag, attrs] = _kind(tag, attrs)
        sign, skip, main = kind
        up = stack[-1]
        if tag == "a" and not attrs.rstrip().endswith("/"):
            links += 1
        if attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        # In an article a header holds its title.
        skip = skip and not (tag == "header" and up.article)
        if tag not in BLOCK and not (skip and not up.skip) and not opened[tag] and not (main and not up.area):
            continue  # an inline element without effect need not be closed
        if len(stack) >= MAX_DEPTH:
            over += tag in BLOCK
            continue
        element = Element(tag, sign if tag in BLOCK else "", up, skip)
        if tag == "article" and not element.article:
            element.article = element
        if main and not element.area:
            element.area = element
        stack.append(element)
        opened[tag] += 1
    return [b for b in out if b.text]


def _is_menu(b: Block) -> bool:
    """A list entry or cell that is mostly links."""
    return b.path.rpartition("/")[2].partition(".")[0] in LINKED and 2 * b.linked >= sum(map(len, b.parts))


def by_tags(kept: list[Block]) -> list[Block]:
    """The blocks of the articles, of the main area or of all the rest, whichever holds the text: of a page that stands alone."""
    size = lambda found: sum(b.size for b in found)
    articles, main = [b for b in kept if b.element.article], [b for b in kept if b.element.area]
    if main:
        inner = [b for b in main if b.element.article]
        if inner and 2 * size(inner) >= size(main):
            return inner
        if size(main) >= size(articles):
            return main
    rest = [b for b in kept if not b.element.article and not _is_menu(b)]
    return articles if articles and size(articles) >= size(rest) else rest


def by_slots(kept: list[Block], slots: frozenset[int]) -> list[Block] | None:
    """The blocks of the element that holds the slots of the host's content, or None for a page without them.

    That element is the lowest that all of them are in; the article or main area around it takes its place. Where it is the whole
    body, and the slots lie deeper, the parts of the body that hold some are meant.
    """
    holders = []
    for b in kept:
        if slot_of(b.path) in slots:
            holders.append(b.element.parent if b.element.tag not in AREAS and b.element.parent else b.element)
    if not holders:
        return None
    chain, e = [], holders[0]
    while e:
        chain.append(e)
        e = e.parent
    low, depth = 0, {id(e): k for k, e in enumerate(chain)}
    for e in set(holders):
        while id(e) not in depth:
            e = e.parent
        low = max(low, depth[id(e)])
    top = chain[low]
    top = top.article or top.area or top
    tops = {id(top)}
    if top.tag in WHOLE and not any(e is top for e in holders):
        tops = set()
        for e in set(holders):
            while e.parent is not top:
                e = e.parent
            tops.add(id(e))
    of: dict[int, bool] = {}

    def inside(e: Element | None) -> bool:
        way = []
        while e and id(e) not in of and id(e) not in tops:
            way.append(id(e))
            e = e.parent
        found = e is not None and (id(e) in tops or of.get(id(e), False))
        of.update(dict.fromkeys(way, found))
        return found

    return [b for b in kept if inside(b.element) and (top.article or top.area or not _is_menu(b))]


def chosen(found: list[Block], template: dict[str, list[int]] | None = None, slots: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks that make the main text. ``template``: path to checksums of its template texts; ``slots``: of ``evidence``."""
    kept = [b for b in found if not b.skip]
    area = by_slots(kept, slots) if slots else None
    return [b.text for b in (by_tags(kept) if area is None else area) if not template or crc32(b.text.encode()) not in template.get(b.path, ())]


# A wrapper: {"n": pages, "bodies": up to MIN_BODIES checksums of bodies, "nodes": [[path, repeated, optional, text]]}, where text is
# the checksum of the text that all have in common, or null for a slot.


def wrap(found: list[Block]) -> dict:
    nodes: list[list] = []
    for b in found:
        nodes.append([b.path, False, False, crc32(b.text.encode())])
    body = crc32("\n".join(b.text for b in found).encode())
    return {"n": 1, "bodies": [body], "nodes": fold_repeats(nodes)}


def _repeats(ids: np.ndarray, period: int) -> bool:
    """Whether a group of ``period`` numbers stands twice side by side."""
    same = np.concatenate([[0], np.cumsum(ids[period:] == ids[:-period])])
    return bool((same[period:] - same[:-period] == period).any())


def fold_repeats(nodes: list[list]) -> list[list]:
    """Collapse runs of equal groups of paths, shorter groups first, into one repeated group."""
    period = 1
    while 2 * period <= len(nodes):
        known: dict[str, int] = {}
        ids = [known.setdefault(n[0], len(known)) for n in nodes]
        if len(known) == len(ids):
            break
        if not _repeats(np.array(ids), period):
            period += 1
            continue
        out: list[list] = []
        for node in nodes:
            out.append(node)
            if len(out) >= 2 * period and all(out[-1 - k][0] == out[-1 - k - period][0] for k in range(period)):
                for k in range(period):
                    kept, gone = out[-1 - k - period], out[-1 - k]
                    kept[1], kept[2], kept[3] = True, kept[2] or gone[2], None
                del out[-period:]
        nodes = out
        period += 1
    return nodes


def matched(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of x and y that an alignment puts together, rising in both.

    What both begin and end with is matched; the rest by a longest common subsequence where its table has at most ``CELLS`` cells,
    else it is cut at the paths that each side has once and in the same order, and, where there are none, in half.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= CELLS:
            out += [(a + i, c + j) for i, j in _longest(x[a:b], y[c:d])]
            continue
        once = {p for p, n in Counter(x[a:b]).items() if n == 1} & {p for p, n in Counter(y[c:d]).items() if n == 1}
        at = {p: c + j for j, p in enumerate(y[c:d]) if p in once}
        cuts, last = [], c - 1
        for i in range(a, b):
            if x[i] in once and at[x[i]] > last:
                last = at[x[i]]
                cuts.append((i, last))
        if not cuts:
            cuts = [((a + b) // 2, (c + d) // 2)]
        else:
            out += cuts
        for i, j in cuts:
            todo.append((a, i, c, j))
            a, c = (i + 1, j + 1) if x[i] in once else (i, j)
        todo.append((a, b, c, d))
    return sorted(out)


def _longest(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below, path = best[i], best[i + 1], x[i]
        for j in range(len(y) - 1, -1, -1):
            row[j] = 1 + below[j + 1] if path == y[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: dict, b: dict) -> dict:
    """The wrapper of all pages of two wrappers."""
    x, y = a["nodes"], b["nodes"]
    out, i, j = [], 0, 0
    for p, q in [*matched([n[0] for n in x], [n[0] for n in y]), (len(x), len(y))]:
        out += [[n[0], n[1], True, n[3]] for n in x[i:p] + y[j:q]]
        if p < len(x):
            m, n = x[p], y[q]
            out.append([m[0], m[1] or n[1], m[2] or n[2], m[3] if m[3] == n[3] else None])
        i, j = p + 1, q + 1
    bodies = list(dict.fromkeys(a["bodies"] + b["bodies"]))[:MIN_BODIES]
    return {"n": a["n"] + b["n"], "bodies": bodies, "nodes": fold_repeats(out)}


def expression(wrapper: dict) -> str:
    """The wrapper as a union-free regular expression over paths; ``#`` is a text slot."""
    marks = {(False, False): "", (True, False): "+", (False, True): "?", (True, True): "*"}
    return " ".join(f"({p} {'#' if t is None else hex(t)}){marks[r, o]}" for p, r, o, t in wrapper["nodes"])


def layout_of(found: list[Block]) -> int:
    """The checksum of the path that holds the most text of a page, of what is not marked as outside the article if there is any."""
    sizes: dict[str, int] = {}
    for b in [b for b in found if not b.skip] or found:
        at = b.path.rpartition("/")[0]
        sizes[at] = sizes.get(at, 0) + sum(map(len, b.parts))
    return crc32(max(sizes, key=lambda k: (sizes[k], k)).encode()) if sizes else 0


def slot_of(path: str) -> int:
    return crc32(path.encode()) & 0x7FFFFFFF


def mark(path: str, text: int) -> int:
    """One number for a path and the checksum of a text."""
    return slot_of(path) << 32 | text


def template_of(nodes: list[list], marks: list[int], pages: int) -> dict[str, list[int]]:
    """Path to checksums of the template texts. ``marks``: of the texts that enough of its ``pages`` distinct pages have."""
    texts: dict[int, list[int]] = {}
    for m in marks:
        texts.setdefault(m >> 32, []).append(m & 0xFFFFFFFF)
    paths = Counter(n[0] for n in nodes)
    if pages < MIN_REPEATED:
        paths -= Counter({p: paths[p] for p, r, _, _ in nodes if r or paths[p] > 1})
    return {p: sorted(texts[c]) for p in paths if (c := slot_of(p)) in texts}


def skeleton(found: list[Block]) -> str:
    """The wrapper of one page without its texts, as JSON; the same for all pages of one shape."""
    return json.dumps([[p, r, o, None] for p, r, o, _ in wrap(found)["nodes"]])


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by salt, host, layout and wrapper to one wrapper of each salt, host and layout; a task holds one at a time."""
    key, held = None, None
    row = lambda: pd.DataFrame([(*key[1:], json.dumps(held["nodes"]))], columns=["host", "layout", "wrapper"])
    for batch in batches:
        for salt, host, layout, wrapper in zip(batch["salt"], batch["host"], batch["layout"], batch["wrapper"], strict=True):
            new = {"n": 1, "bodies": [], "nodes": json.loads(wrapper)}
            if (salt, host, layout) == key:
                held = align(held, new)
                continue
            if key is not None:
                yield row()
            key, held = (salt, host, layout), new
    if key is not None:
        yield row()


def _host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, layout, wrapper (JSON), marks (of template texts), pages (distinct ones) of every layout whose pages differ enough to tell."""
    return inferred(pages)[0]


def inferred(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``wrappers``, and the slots of ``evidence``.

    Shapes are made distinct and sorted before they are aligned, so neither the order of the pages nor a task that is run again
    changes a wrapper.
    """

    def of_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, shapes = [], set()
            for host, page in zip(batch["host"], batch["html"], strict=True):
                found = blocks(page)
                if not found:
                    continue
                layout, texts = layout_of(found), [crc32(b.text.encode()) for b in found]
                shapes.add((host, layout, skeleton(found)))
                every = [mark(b.path, t) for b, t in zip(found, texts, strict=True)]
                body = hashlib.blake2b(repr(every).encode(), digest_size=7).digest()
                sizes = {m: 0 if b.skip else b.size for m, b in zip(every, found, strict=True)}
                marks = sorted(sizes)
                seen.append((host, layout, None, int.from_bytes(body), marks, [sizes[m] for m in marks]))
            seen += [(*s, None, None, None) for s in sorted(shapes)]
            yield pd.DataFrame(seen, columns=["host", "layout", "wrapper", "body", "marks", "sizes"]).astype({"body": "Int64", "layout": "Int64"})

    schema = "host string, layout long, wrapper string"
    rows = _host(pages).filter(F.col("host").isNotNull()).select("host", "html")
    rows = staged(rows.mapInPandas(of_pages, schema + ", body long, marks array<long>, sizes array<long>"), "wrapper-pages")
    shapes = rows.filter("wrapper IS NOT NULL").select("host", "layout", "wrapper").distinct()
    # A host of many shapes is folded in parts, then the parts are.
    aligned = shapes
    for salt in (F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)), F.lit(0).cast("long")):
        keyed = aligned.withColumn("salt", salt).repartition("salt", "host", "layout").sortWithinPartitions("salt", "host", "layout", "wrapper")
        aligned = keyed.mapInPandas(_folded, schema)
    bodies = rows.filter("wrapper IS NULL").groupBy("host", "layout", "body").agg(F.first("marks").alias("marks"), F.min("sizes").alias("sizes"))
    # The mark -1 counts the pages themselves.
    pairs = F.arrays_zip(F.concat("marks", F.array(F.lit(-1).cast("long"))).alias("mark"), F.concat("sizes", F.array(F.lit(0).cast("long"))).alias("size"))
    each = bodies.select("host", "layout", F.explode(pairs).alias("x")).select("host", "layout", "x.mark", "x.size")
    counts = staged(each.groupBy("host", "layout", "mark").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")), "wrapper-marks")
    of = counts.filter("mark = -1").select("host", "layout", F.col("n").alias("pages"))
    often = counts.filter(F.col("n") >= MIN_BODIES).filter("mark <> -1").join(of, ["host", "layout"]).filter(DEN * F.col("n") >= NUM * F.col("pages"))
    often = often.groupBy("host", "layout").agg(F.collect_list("mark").alias("marks"), F.first("pages").alias("pages"))
    return aligned.join(often, ["host", "layout"]), evidence(counts)


def evidence(counts: DataFrame) -> DataFrame:
    """(host, slots): of hosts of two distinct pages or more the slots that hold their content.

    ``counts``: host, layout, mark, n (pages that have it; of the mark -1 all pages), size. A slot is a path, and its weight the
    characters, outside links and what tags mark as no article, of its texts, each counted once however many pages have it, and not
    at all where nine tenths of the layout's pages do. So notices and menus weigh little, and what is written anew for each page
    weighs much. The slots of at least half the greatest
    weight are the content's; the rest of the article is found around them.
    """
    slot = F.shiftright("mark", 32)
    of = counts.filter("mark = -1").select("host", "layout", F.col("n").alias("pages"))
    anew = counts.filter("mark >= 0").join(of, ["host", "layout"]).filter((DEN * F.col("n") < NUM * F.col("pages")) | (F.col("pages") == 1))
    weights = anew.groupBy("host", slot.alias("slot")).agg(F.sum("size").alias("weight")).filter("weight > 0")
    most = weights.groupBy("host").agg(F.max("weight").alias("most"))
    several = counts.filter("mark = -1").groupBy("host").agg(F.sum("n").alias("pages")).filter("pages > 1")
    heavy = weights.join(most, "host").filter(2 * F.col("weight") >= F.col("most")).join(several, "host", "left_semi")
    return heavy.groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    known, slots = inferred(pages)

    @F.pandas_udf("string")
    def template(column: pd.Series, marks: pd.Series, pages: pd.Series) -> pd.Series:
        found = (template_of(json.loads(w), [int(x) for x in m], n) for w, m, n in zip(column, marks, pages, strict=True))
        return pd.Series([json.dumps(t) for t in found], dtype=object)

    known = known.select("host", "layout", template("wrapper", "marks", "pages").alias("template")).filter("template <> '{}'")
    by_layout = F.map_from_entries(F.collect_list(F.struct(F.col("layout").cast("string"), "template")))
    known = known.groupBy("host").agg(F.to_json(by_layout).alias("template"))
    known = staged(slots.select("host", F.concat_ws(",", F.col("slots").cast("array<string>")).alias("slots")).join(known, "host", "full_outer"), "wrapper-templates")

    @F.pandas_udf("string")
    def extract(htmls: pd.Series, templates: pd.Series, slots: pd.Series) -> pd.Series:
        read: dict[str, dict] = {}
        out = []
        for page, t, s in zip(htmls, templates, slots, strict=True):
            if t is not None and t not in read:
                read[t] = {int(k): json.loads(v) for k, v in json.loads(t).items()}
            found = blocks(page)
            content = frozenset(map(int, s.split(","))) if s else frozenset()
            out.append("\n".join(chosen(found, read[t].get(layout_of(found)) if t is not None else None, content)))
        return pd.Series(out, dtype=object)

    rows = _host(pages)
    key = F.coalesce("host", F.concat(F.lit("no host:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("key", key).join(known.withColumnRenamed("host", "key"), "key", "left")
    return rows.select("page_id", "url", extract("html", "template", "slots").alias("text"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
