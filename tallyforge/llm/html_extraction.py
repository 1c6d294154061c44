"""Main text of web pages, with site templates removed by counting element subtrees.

Each element's subtree is hashed inside tasks; Spark counts on how many
distinct pages of a host each hash stands (within the article: in how many distinct
articles), and the subtrees that recur on a large share of them are
the host's template and are deleted from the whole tree. On pages without an article, variants that rotate recur on
a smaller share. Recurring alone tells nothing of running text, so they must
be links alone, as menus of sections are, or stand next to sure template in a place that recurring subtrees
hold on nearly all of its pages, as notices do. They stay where a page would lose most of its text by it. In what is left,
on every host, the article is chosen by its tag, and elements whose tag, role or class
says that they are no part of it go as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A subtree is a template where it stands on at least this share of a host's distinct pages, and on at least so many.
SHARE, LEAST_PAGES = 0.3, 5
#: Fewer words make no rotating variant, nor a paragraph of an article that can be template.
LONG_WORDS = 5
#: On pages without an article, a subtree that stands on this share of the pages (LEAST_PAGES at least) recurs; a place next to sure template whose pages hold recurring subtrees to this share rotates.
ROTATING_SHARE, PLACE_SHARE = 0.01, 0.8
#: Up to so many template hashes go to the tasks as one broadcast; beyond that they are joined to the pages.
BROADCAST_ROWS = 200_000

# The roles that HTML's elements play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
DROP = frozenset("head script style noscript iframe template svg nav header footer aside form button select option textarea input dialog menu object canvas video audio map".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre b i em strong span a code u small sub sup mark q cite br td th tr dd dt figcaption article main body html".split())
ENDS_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "title"}
DROP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORD = r"(?:ads?|adverts?|advertis\w*|banners?|sponsor\w*|promo\w*|sidebars?|side|nav(?:s|bars?|igation|menu)?|menus?|breadcrumbs?|footers?|headers?|masthead|cookies?|consent|gdpr|notices?|popups?|modals?|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|comments?|commentlist|replies|respond|disqus|related|recommend\w*|widgets?|toolbar|pagination|pager|skip\w*|copyright|disclaimer)"
#: Whole class names (and ids) made of such words only, and the usual names of a reader's comment.
_NOISE = re.compile(rf"{_WORD}(?:[_-]+{_WORD})*(?:[_-]+\d+)?|(?:div-|li-)?(?:comment|reply)(?:-(?:\d+|body|content|text|list|area|form))?", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:[\"'][^>]*)?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
# HTML's white space, with the no-break space that a reference may stand for.
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "noise", "named", "parts", "hash", "label", "words", "links")

    def __init__(self, tag: str, label: str, noise: bool, named: bool = False):
        # The page's frame and main element are never dropped for a class or id, nor the frame for anything else.
        self.named = named and tag not in ("html", "body", "main")
        self.tag, self.label, self.noise, self.parts, self.hash, self.words = tag, label, (noise and tag not in ("html", "body")) or self.named, [], 0, 0
        self.links = 0


def _attributes(raw: str) -> tuple[str, bool, bool]:
    """What of the attributes belongs to a subtree's hash, and whether they mark it as no part of the article: by role or as hidden, and by class or id."""
    label, noise, named = "", False, False
    if raw and ("=" in raw or "hidden" in raw):
        for name, a, b, c in _ATTR.findall(raw):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                label += f" {name}={value}"
                named = named or any(_NOISE.fullmatch(v) for v in value.split())
            elif name == "role":
                noise = noise or value.strip().lower() in DROP_ROLE
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                noise = True
    return label, noise, named


def parsed(html: str) -> Node:
    """The page as a tree. Unclosed elements end with their parent; paragraphs end where a block begins; stray end tags are passed over."""
    root = Node("#root", "", False)
    stack, at, n = [root], 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(x.tag == tag for x in stack):
                while stack.pop().tag != tag:
                    pass
            elif tag == "p":
                stack[-1].parts.append(Node("p", "", False))
            continue
        if tag in ENDS_P and any(x.tag == "p" for x in stack):
            open_p = max(i for i, x in enumerate(stack) if x.tag == "p")
            if not any(x.tag in ("td", "th", "table", "button", "caption") for x in stack[open_p:]):
                del stack[open_p:]
        if tag in ("li", "option", "tr", "td", "th", "dd", "dt") and stack[-1].tag in ({tag, "dd", "dt"} if tag in ("dd", "dt") else {tag}):
            stack.pop()
        label, noise, named = _attributes(m[3])
        node = Node(tag, label, noise, named)
        stack[-1].parts.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            node.parts.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def _walk_hash(node: Node) -> None:
    """Hashes every subtree from its tag, class and id, texts and children; deep pages need no deep Python stack."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [p for p in x.parts if isinstance(p, Node)]
    for x in reversed(order):
        seen = [x.tag + x.label]
        for p in x.parts:
            if isinstance(p, Node):
                seen.append(f"{p.hash:x}")
                x.words += p.words
                x.links += p.links
            else:
                words = p.split()
                seen.append(" ".join(words))
                x.words += len(words)
        if x.tag == "a":
            x.links = x.words
        x.hash = xxhash.xxh64_intdigest("\x1f".join(seen).encode("utf-8", "surrogatepass"))


def _visible(start: Node, without: Node | None = None) -> int:
    """Characters of text, white space aside, that tags, roles and class names leave below start."""
    n, todo = 0, [start]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            n += sum(map(len, x.split()))
        elif x is start or not (x is without or x.tag in DROP or x.tag == "title" or x.noise):
            todo += x.parts
    return n


def _content_root(root: Node) -> Node | None:
    """The page's only article, or else its only main element; null where there is none or several.

    Articles that are noise themselves, such as readers' comments, do not count.
    A single article within elements that a class word names counts if it has more text
    than all that is outside such elements: class words drop no element that holds the article.
    """
    for wanted in ("article", "main"):
        for through in (False, True):
            found, todo = [], [root]
            while todo:
                x = todo.pop()
                if x.tag == wanted and not x.noise:
                    found.append(x)
                elif x.tag not in DROP and (not x.noise or through and x.named and x.tag != wanted):
                    todo += [p for p in x.parts if isinstance(p, Node)]
            if len(found) == 1 and (not through or _visible(found[0]) > _visible(root, found[0])):
                return found[0]
            if found:
                break
    return None


#: Pseudo-subtrees that stand on every page, and in every article: their counts are those of a host's pages and articles.
PAGE, ARTICLE = 0, 1


def _key(x: Node, inside: bool) -> int | None:
    """What a subtree is counted under, as a signed number: its hash, with 1 for a place in the article, 2 for LONG_WORDS and 4 for links alone in the lowest bits.

    Null for what is never template: the page itself, and short phrases and paragraphs of an article.
    """
    long = x.words >= LONG_WORDS
    if x.tag in ("html", "body", "head") or inside and x.tag in FLOW and not long:
        return None
    h = x.hash & ~7 | inside | long << 1 | (x.words > 0 and x.links == x.words) << 2
    return h - (1 << 64) if h >> 63 else h


def subtree_hashes(html: str | None) -> tuple[int | None, list[tuple[int, int]], list[int]]:
    """The article's hash (null without one), and the keys of the subtrees outside and inside it that can be template; outside with the key of the element before them that has words, 0 where there is none or the page has an article."""
    root = parsed(html or "")
    _walk_hash(root)
    article = _content_root(root)
    outside: set[tuple[int, int]] = set()
    within: set[int] = set()
    todo = [(root, False)]
    while todo:
        x, inside = todo.pop()
        inside = inside or x is article
        before = 0
        for p in x.parts:
            if not isinstance(p, Node):
                continue
            key = _key(p, inside) if p is not article else None
            if key is not None:
                if inside:
                    within.add(key)
                else:
                    outside.add((key, before if article is None else 0))
            if p.words:
                before = key or 0
            todo.append((p, inside))
    return None if article is None else article.hash - (1 << 64) if article.hash >> 63 else article.hash, sorted(outside), sorted(within)


def _pruned(root: Node, template: dict[int, bool]) -> int:
    """Empties the subtrees that are template and returns how many words they had. Elements stay as boundaries of the text beside them.

    template: the keys, and whether each is a rotating variant only. Variants stay where they are most of the page's text.
    """
    _walk_hash(root)
    article = _content_root(root)
    holds, todo = set(), [(root, ())]
    if article is not None:
        # An element that holds the article is no template as a whole.
        while todo:
            x, above = todo.pop()
            if x is article:
                while above:
                    holds.add(id(above[0]))
                    above = above[1]
                break
            todo += [(p, (x, above)) for p in x.parts if isinstance(p, Node)]
    found: tuple[list[Node], list[Node]] = ([], [])
    walk: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while walk:
        x, inside, within = walk.pop()
        inside = inside or x is article
        for p in x.parts:
            if isinstance(p, Node):
                rotating = template.get(_key(p, inside)) if p is not article and id(p) not in holds else None
                if rotating is False:
                    found[0].append(p)
                    continue
                if rotating and not within:
                    found[1].append(p)
                walk.append((p, inside, within or bool(rotating)))
    gone = found[0]
    rest = root.words - sum(p.words for p in gone) - sum(c.words for c in _raw(root))
    if 2 * sum(p.words for p in found[1]) <= rest:
        gone = gone + found[1]
    words = sum(p.words for p in gone)
    for p in gone:
        p.parts, p.tag = [], "div" if p.tag in BLOCK else "span"
    return words


def _raw(root: Node) -> Iterator[Node]:
    """The elements whose words are no text of the page."""
    todo = [root]
    while todo:
        x = todo.pop()
        if x.tag in RAW or x.tag == "head":
            yield x
        else:
            todo += [p for p in x.parts if isinstance(p, Node)]


def _titled(header: Node) -> bool:
    """Whether a header has a heading."""
    todo = [header]
    while todo:
        x = todo.pop()
        if x.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return True
        todo += [p for p in x.parts if isinstance(p, Node)]
    return False


def main_text(html: str | None, template: dict[int, bool] | None = None) -> str:
    return main_text_and_template(html, template)[0]


def main_text_and_template(html: str | None, template: dict[int, bool] | None = None) -> tuple[str, int]:
    """Blocks of the article joined by line ends, each with its white space squeezed and its references decoded; and the number of words that went as template.

    Within an article, a header with a heading is the article's own and stays.
    """
    root = parsed(html or "")
    words = _pruned(root, template) if template else 0
    article = _content_root(root)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(run))).strip()
        run.clear()
        if text:
            blocks.append(text)

    todo: list[Node | str | None] = [article or root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif (x.tag in DROP and not (x.tag == "header" and article is not None and _titled(x))) or x.tag == "title" or x.noise and x is not article:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.parts)
    flush()
    return "\n".join(blocks), words


def host_of(url: Column) -> Column:
    """The host in lower case; empty for a null url or one without a host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for htmls in batches:
        rows = [subtree_hashes(h if isinstance(h, str) else None) for h in htmls]
        outside = [[(PAGE, 0), *r[1]] for r in rows]
        yield pd.DataFrame({"article": pd.Series([r[0] for r in rows], dtype="Int64"), "outside": [[k for k, _ in r] for r in outside], "before": [[b for _, b in r] for r in outside], "inside": [[] if r[0] is None else [ARTICLE, *r[2]] for r in rows]})


def _stands(pages: DataFrame) -> DataFrame:
    """(host, page, at, subtree, before): where each subtree stands; page is the hash of the whole, at that of the page or, inside it, of the article, before what stands in front of it."""
    hashes = F.pandas_udf(_hashes, "article long, outside array<long>, before array<long>, inside array<long>")
    page = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html").filter("host <> ''")
    found = page.select("host", "page", hashes("html").alias("_h"))
    on = lambda where, k, b: F.struct(where.alias("at"), k.alias("subtree"), b.alias("before"))
    outside = F.zip_with("_h.outside", "_h.before", lambda k, b: on(F.col("page"), k, b))
    inside = F.transform("_h.inside", lambda k: on(F.col("_h.article"), k, F.lit(0).cast("long")))
    return found.select("host", "page", F.explode(F.concat(outside, inside)).alias("s")).select("host", "page", "s.*")


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES, rotating: float = ROTATING_SHARE, place: float = PLACE_SHARE) -> DataFrame:
    """(host, subtree, rotating): the keys that recur on a share of a host's distinct pages, or of its distinct articles, and the rotating ones on pages without an article. Copies count once. Pages without a host have no template.

    Shares alone decide, whatever the number of pages: running text that recurs on fewer stays.
    """
    stands = written(_stands(pages).select("host", "at", "subtree", "before").distinct(), "site-places")
    # Counted in two steps: partial counts in each task, then one row a task and key.
    counted = stands.select("host", "at", "subtree").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    counted = written(counted, "site-subtrees")
    totals = counted.filter(F.col("subtree").isin(PAGE, ARTICLE)).select("host", F.col("subtree").alias("kind"), F.col("n").alias("of"))
    keyed = counted.filter(~F.col("subtree").isin(PAGE, ARTICLE)).withColumn("kind", F.col("subtree").bitwiseAND(F.lit(1))).join(totals, ["host", "kind"])
    has = lambda bit: F.col("subtree").bitwiseAND(F.lit(bit)) != 0
    sure = keyed.filter(F.col("n") >= share * F.col("of"))
    recurring = keyed.filter((F.col("n") < share * F.col("of")) & has(2) & (F.col("kind") == PAGE) & (F.col("n") >= rotating * F.col("of"))).select("host", "subtree")
    # Of each place next to sure template: on how many pages a recurring subtree stands there.
    beside = stands.filter("before <> 0").join(recurring, ["host", "subtree"]).join(sure.select("host", F.col("subtree").alias("before"), F.col("n").alias("of")), ["host", "before"])
    beside = written(beside.select("host", "at", "subtree", "before", "of"), "site-beside")
    turning = beside.select("host", "at", "before", "of").distinct().groupBy("host", "before", "of").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= place * F.col("of")).select("host", "before")
    variants = beside.join(turning, ["host", "before"], "left_semi").select("host", "subtree").unionByName(recurring.filter(has(4))).distinct()
    return sure.select("host", "subtree", F.lit(False).alias("rotating")).unionByName(variants.select("host", "subtree", F.lit(True).alias("rotating")))


_EXTRACTED = "text string, n_template_words long"


def _texts(htmls: pd.Series, sets: list[dict[int, bool] | None]) -> pd.DataFrame:
    rows = [main_text_and_template(h if isinstance(h, str) else None, t) for h, t in zip(htmls, sets, strict=True)]
    return pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "n_template_words": pd.Series([r[1] for r in rows], dtype="int64")})


def extracted(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES, broadcast_rows: int = BROADCAST_ROWS, rotating: float = ROTATING_SHARE) -> DataFrame:
    """All columns of pages and text (empty if nothing is left), n_chars and n_template_words, the words that went as template.

    Columns of pages with these names are replaced. A null or empty page has the
    empty text; pages with a null url are extracted without a template; repeated
    rows are kept; texts are read whole, however long. An empty table gives an empty result.
    A paragraph of an article goes only where it stands in the share of the host's distinct articles that makes
    template, however many they are.
    """
    spark = pages.sparkSession
    found = written(templates(pages, share, least, rotating=rotating), "site-templates")
    own = [c for c in pages.columns if c.lower() not in ("text", "n_chars", "n_template_words", "_host", "_template", "_page", "_x")]
    if found.count() <= broadcast_rows:
        by_host: dict[str, dict[int, bool]] = {}
        for r in found.collect():
            by_host.setdefault(r["host"], {})[r["subtree"]] = r["rotating"]
        shared = spark.sparkContext.broadcast(by_host)

        @F.pandas_udf(_EXTRACTED)
        def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for htmls, hosts in batches:
                yield _texts(htmls, [shared.value.get(host) for host in hosts])

        out = pages.select(*own, text("html", host_of(F.col("url"))).alias("_x"))
    else:
        # Each page meets those of its own subtrees alone that are template, however long its host's list is.
        hits = _stands(pages).select("host", "page", "subtree").distinct().join(found, ["host", "subtree"]).groupBy(F.col("host").alias("_host"), F.col("page").alias("_page")).agg(F.collect_set(F.struct("subtree", "rotating")).alias("_template"))

        @F.pandas_udf(_EXTRACTED)
        def text_joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for htmls, sets in batches:
                yield _texts(htmls, [{r["subtree"]: r["rotating"] for r in s} if s is not None else None for s in sets])

        joined = pages.select(*own).withColumns({"_host": host_of(F.col("url")), "_page": F.xxhash64("html")}).join(hits, ["_host", "_page"], "left")
        out = joined.select(*own, text_joined("html", "_template").alias("_x"))
    return out.select(*own, F.col("_x.text").alias("text"), F.length("_x.text").cast("long").alias("n_chars"), F.col("_x.n_template_words").alias("n_template_words"))
