"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: a node is the path of tags, classes and
ids from the root, and keeps how its pages style its children (presentation) and what
they say there (content). A node's presentation counts for what its entropy is of the
largest possible, its content for how little of it is the same on the host's pages. A
block that is all links says by its style what it is: its words, which differ from page
to page in a menu, don't count as content. A few different pages are added to every host,
so that the fewer pages there are, the more alike they must be. From branches that are
low in both, the blocks that repeat are removed from each page, unless they are in an
article or main part. Of what is left, blocks go whose own tags, roles and class names
say that they are no article: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, comments of readers; in an article or main part only whole names say so. Of the
rest, the text is the whole of what is marked as article or main part, if that is not the
lesser part of what is marked or named as content, else what is so named; and all of it
where these are a small share.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: A branch goes if its importance is below this.
LEAST_IMPORTANCE = 0.3
#: Pages that each host is taken to have besides, all different: what few pages repeat says little.
PRIOR_PAGES = 6
#: Elements nested deeper than this count as children of the last such one, as in browsers.
MOST_DEPTH = 512
#: In such a branch, blocks go whose own words are on this share of its pages, and on two at least.
LEAST_SHARE = 0.1

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(script|style|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: What stands in these is no mark-up of the page, if they are closed; that of xmp is text.
_APART = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("noscript", "template", "iframe", "svg", "xmp")}
# Fixed lists of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter object output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
_MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml".split())
_INLINE |= _MATH
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tbody div section article main body form td th button".split())
# What isn't an article, by tag, role and words of class names and ids.
_NOISE_TAGS = frozenset("nav footer aside form head button select dialog menu header audio video canvas fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
_NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies respond disqus discussion pagination pager copyright masthead toolbar tags".split())
_WEAK_WORDS = frozenset("header banner notice notices alert alerts widget widgets aside disclaimer legal side top bottom search form".split())
_CONTENT_WORDS = frozenset("article articles post entry content story main text body".split())


#: What is marked gives way to what is named, and both to all, if they are under this share of it.
LEAST_MARKED, LEAST_NAMED = 0.4, 0.2


@dataclass(slots=True)
class _Node:
    tag: str
    path: int
    noise: bool
    article: int  # 2 in an article or main part, and 1 more in what is named like content
    branch: tuple[int, ...] = ()
    children: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    text: str
    path: int
    noise: bool
    article: int
    branch: tuple[int, ...]
    linked: bool = False  # all of it is links


def _open(tag: str, attributes: str, up: _Node) -> _Node:
    got = {}
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    name = f"{got.get('class', '')} {got.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(name)} if name != " " else frozenset()
    role = got.get("role", "").lower()
    inside = up.article >= 2
    marked = tag in ("article", "main") or role in ("main", "article")
    content = bool(words & _CONTENT_WORDS)
    noise = up.noise or role in _NOISE_ROLES or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    if inside or marked:  # parts of names say nothing here
        noise = noise or not _NOISE_WORDS.isdisjoint(name.lower().split())
    else:
        noise = noise or bool(words & _NOISE_WORDS) or (bool(words & _WEAK_WORDS) and not content)
    if tag in _NOISE_TAGS and not (tag == "header" and inside):
        noise = True
    if tag in ("body", "html"):  # their names are the whole page's
        noise = up.noise
    article = up.article
    if marked and not inside:
        article += 2
    if content and tag not in ("body", "html") and not article & 1:
        article += 1
    styled = re.sub(r"\d+", "0", f"{tag}.{name}")
    path = zlib.crc32(styled.encode(), up.path) | (zlib.adler32(styled.encode(), up.path & 0xFFFF) & 0x7FFF) << 32
    return _Node(tag, path, noise, article, (*up.branch, path))


def parse(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks of text in page order, and (path, hash of its children's styles) of every node."""
    root = _Node("", 0, False, 0)
    stack, blocks, shapes = [root], [], []
    said: list[str] = []
    holder, plain = root, False

    def flush() -> None:
        nonlocal said, plain
        if said:
            text = " ".join(html.unescape("".join(said)).split())
            if text:
                blocks.append(Block(text, holder.path, holder.noise, holder.article, holder.branch, not plain))
            said, plain = [], False

    def close(at: int) -> None:
        while len(stack) > at:
            node = stack.pop()
            if node.children:
                shapes.append((node.path, hash(tuple(node.children))))

    def within(tags: tuple[str, ...]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in _SCOPE:
                return 0
        return 0

    def say(text: str) -> None:
        nonlocal holder, plain
        if text:
            top = stack[-1]
            if said and (top.noise != holder.noise or top.article != holder.article):
                flush()
            if not said:
                i = len(stack) - 1
                while i and stack[i].tag in _INLINE and stack[i].noise == top.noise and stack[i].article == top.article:
                    i -= 1
                holder = stack[i] if stack[i].noise == top.noise and stack[i].article == top.article else top
            said.append(text)
            # Signs and spaces between links are no words of their own.
            plain = plain or (any(map(str.isalnum, text)) and not any(x.tag == "a" for x in stack[:0:-1] if x.tag in _INLINE))

    at, never = 0, set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[1]:
            flush()
            continue
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, ends = tag.lower(), bool(m[2] or m[5])
        if tag == "br":
            if said:
                said.append(" ")
            continue
        if tag in _APART:
            if tag not in ("svg", "iframe"):
                flush()
            # A tag closed in itself is empty, one that nothing closes has no content of its own.
            if not ends and not (m[4] or m[7] or "").endswith("/") and tag not in never:
                if end := _APART[tag].search(page, at):
                    if tag == "xmp":  # shown as it is written
                        say(html.escape(page[at : end.start()]))
                        flush()
                    at = end.end()
                else:
                    never.add(tag)
            continue
        if tag in _MATH and not ends and (m[4] or m[7] or "").endswith("/"):
            continue
        if tag not in _INLINE:
            flush()
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in _ENDS_P and (i := within(("p",))):
            close(i)
        elif tag in _CLOSES and (i := within(_CLOSES[tag])):
            while stack[i - 1].tag in _CLOSES[tag]:
                i -= 1
            close(i)
        if tag in _VOID:
            continue
        node = _open(tag, m[4] or m[7] or "", stack[-1])
        if tag not in _INLINE:
            stack[-1].children.append(node.path)
        if len(stack) > MOST_DEPTH:
            node.branch = stack[MOST_DEPTH].branch
        stack.append(node)
    if at < len(page):
        say(page[at:])
    flush()
    close(1)
    return blocks, shapes


def _value(block: Block) -> int:
    """What the block says; links all say the same."""
    return zlib.crc32(block.text.encode()) << 20 ^ len(block.text) if not block.linked else -1


def main_text(page: str | None, low: frozenset[int] = frozenset(), common: frozenset[int] = frozenset()) -> str:
    """The article's blocks; `low` are the host's branches of low importance, `common` the values of blocks that repeat there."""
    if not page:
        return ""
    blocks = parse(page)[0]
    if low:
        own = [b for b in blocks if b.article >= 2 or not low.intersection(b.branch) or _value(b) not in common]
        # A page that only repeats keeps what it says.
        blocks = own if any(not b.noise for b in own) else blocks
    blocks = [b for b in blocks if not b.noise]
    size = lambda of: sum(len(b.text) for b in of)
    marked, named = [b for b in blocks if b.article >= 2], [b for b in blocks if b.article & 1]
    part = marked if marked and size(marked) >= LEAST_MARKED * size(b for b in blocks if b.article) else named
    return "\n".join(b.text for b in (part if part and size(part) >= LEAST_NAMED * size(blocks) else blocks))


# --- the tree of a host -----------------------------------------------------------


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("path", pa.int64()), ("shape", pa.bool_()), ("value", pa.int64()), ("first", pa.bool_())]))
    for b in batches:
        pages, styles = [], []
        for page in b.column("html").to_pylist():
            blocks, shapes = parse(page or "")
            seen, rows = set(), {}
            for path, value, shape in [*((p, _value(x), False) for x in blocks for p in x.branch), *((p, v, True) for p, v in shapes)]:
                rows.setdefault((path, shape, value), (path, shape) not in seen)
                seen.add((path, shape))
            styles.append([{"path": p, "shape": s, "value": v, "first": f} for (p, s, v), f in rows.items()])
            pages.append(hash(tuple((p, v) for p, s, v in rows)))
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(pages, pa.int64()), pa.array(styles, kind)], ["host", "page", "nodes"])


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, low, common): paths of each host's branches whose presentation and content are of low importance, and values of blocks that repeat in them; copies of a page count once."""
    nodes = pages.select("host", "html").mapInArrow(_trees, "host string, page long, nodes array<struct<path:long,shape:boolean,value:long,first:boolean>>")
    each = nodes.groupBy("host", "page").agg(F.first("nodes").alias("nodes")).select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    said = materialize(each.groupBy("host", "path", "shape", "value").agg(F.count("*").alias("c"), F.sum(F.col("first").cast("long")).alias("f")), "said")
    node = said.groupBy("host", "path", "shape").agg(F.sum("f").alias("m"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    full = F.log(F.col("m") + F.lit(float(PRIOR_PAGES)))
    # Content: 1 less what the values' spread over pages is of the largest. Presentation: entropy of the shapes, of the largest.
    importance = F.when(F.col("shape"), (F.log(F.col("n").cast("double")) - F.col("clogc") / F.col("n")) / full).otherwise(1 - F.col("clogc") / (F.col("n") * full))
    rated = node.groupBy("host", "path").agg(F.max(importance).alias("importance"), F.max(F.expr("IF(shape, NULL, m)")).alias("pages"))
    low = materialize(rated.where(F.col("pages").isNotNull() & (F.col("importance") < LEAST_IMPORTANCE)), "low")
    common = said.where("NOT shape AND c > 1").join(low, ["host", "path"]).where(F.col("c") >= LEAST_SHARE * F.col("pages"))
    # A share bounds the values of a host by its blocks a page.
    return low.groupBy("host").agg(F.collect_set("path").alias("low")).join(common.groupBy("host").agg(F.collect_set("value").alias("common")), "host")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null html counts as empty; pages without an article's text give an empty text. Blocks
    are those of HTML's block elements, in page order; character references are decoded
    and white space in a block becomes one space; line breaks by <br> are white space.
    Nothing else is dropped or capped. Rows of no host (null or odd urls) share one tree.
    Repeated rows each give a row, an empty table none. Other columns are not read.
    """
    hosted = pages.select("page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)).alias("host"))
    low = materialize(low_branches(hosted), "styles")  # its size is known from here on; the planner broadcasts it only below its threshold
    joined = hosted.join(low, "host", "left").select("page_id", "url", "html", "host", "low", "common")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A batch's host is turned into sets once.
            hosts = b.column("host").to_pylist()
            first = {h: i for i, h in reversed(list(enumerate(hosts)))}
            sets = {h: tuple(frozenset(b.column(c)[i].as_py() or ()) for c in ("low", "common")) for h, i in first.items()}
            texts = [main_text(page, *sets[h]) for page, h in zip(b.column("html").to_pylist(), hosts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
