"""Main text of web pages, with site templates found by counting equal subtrees per host.

Pass one parses each page and hashes the subtrees of its block elements, and Spark counts on
how many different pages of a host each occurs; pages of one text count once, as copies of a page
share all of it.  Pass two parses again and deletes every subtree that recurs on many pages of the
page's host, within the article or outside.  What cannot be counted, on hosts of a page or two
and in boxes whose words change from page to page, is left to the marks: element names, roles
and class words, and the article element where a page has one.

Two thresholds, as articles may share passages: a block of plain text (a paragraph, list or
table without attributes and links) is a template only when nearly every page of a large enough
host has it; any other block when several pages do.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footing.llm.common import durable

#: Template hashes up to which all hosts' lists are broadcast (8 bytes each); beyond, a shuffle join.
BROADCAST_HASHES = 1_000_000

# Element names and marks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul video audio canvas object svg select".split()
)
DROPPED = frozenset(
    "head script style textarea title noscript template iframe nav footer aside form dialog menu button select option svg canvas object audio video".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion recommended related replies reply search share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
OWN = frozenset("article body content entry main post story text".split())
#: A start of the first closes an open one of the second, unless one of the third lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that are never a template themselves; ends that close across an article or table.
WHOLE = frozenset(("html", "body", "article", "main"))
OUTER = frozenset(("article", "main", "table", "body", "html", "div", "section"))
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre dl dt dd table thead tbody tfoot tr figure figcaption hr".split())

#: Where markup may start, and the two kinds that do not end at the next bracket.
_START = re.compile(r"<(?:[A-Za-z!?]|/[A-Za-z])")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
#: A tag in which quotes are closed; nothing is tried twice.
_TAG = re.compile(r"</?[A-Za-z][^\s/>]*+(?>\"[^\"]*\"|'[^']*'|[^>\"']+)*+>", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=\"'<>/]+)")
_SPACE = re.compile(r"\s+")
CONTAINERS = (BLOCK | {"td", "th"}) - {"p"}
_ROOT = re.compile(r"<(?:article|main)", re.I | re.A)
#: What a form that wraps a whole page holds, and forms' ends.
_PARTS = re.compile(r"<(?:article|main|nav|header|footer|aside|h1)(?=[\s/>])", re.I | re.A)
_FORM_END = re.compile(r"</form(?=[\s/>]|\Z)", re.I | re.A)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I | re.A) for name in RAW}


@dataclass
class _Open:
    name: str
    dropped: bool
    inside: bool  # within the article
    marked: bool  # has attributes
    parts: list
    blocks: int  # blocks before it
    rich: bool  # holds more than plain text


def _attributes(tag: str, name: str) -> dict[str, str]:
    out = {}
    for m in _ATTRIBUTE.finditer(tag, len(name) + 1, len(tag) - 1):
        key = (m[1] or m[3]).lower()
        out.setdefault(key, _html.unescape((m[2] or "").strip("\"'")))
    return out


def _unwanted(name: str, attributes: dict[str, str], inside: bool) -> bool:
    if name in DROPPED or (name == "header" and not inside):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return True
    marks = {w for k in ("class", "id") for w in re.split(r"[^a-z]+", attributes.get(k, "").lower())}
    return name not in ("html", "body", "article", "main") and bool(marks & MARKS) and not marks & OWN


def _wrapping(page: str):
    """Whether a form that starts at a place wraps parts of the page, which no form that is filled in has.

    Places are found once, so that many forms, closed or not, cost no more than the page is long.
    """
    parts = [m.start() for m in _PARTS.finditer(page)]
    ends = [m.start() for m in _FORM_END.finditer(page)]

    def wraps(at: int) -> bool:
        k, e = bisect_left(parts, at), bisect_left(ends, at)
        return k < len(parts) and (e == len(ends) or parts[k] < ends[e])

    return wraps


def _markup(page: str) -> Iterator[tuple[str, str, int]]:
    """(text before, tag, place after it) of every tag, comment or declaration; last the rest with no tag.

    Linear: a bracket after the last ``>`` starts no tag, and once a quote is found never to
    be closed, tags end at their next ``>`` whatever the quotes.  A caller that skips raw text
    sends the place to go on from.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (start := _START.search(page, at)) is not None:
        k = start.start()
        if page[k + 1] in "!?":
            end = _COMMENT.match(page, k).end()
        elif k > last:
            break
        else:
            tag = _TAG.match(page, k) if quotes else None
            quotes = tag is not None
            end = tag.end() if tag else page.index(">", k) + 1
        to = yield page[at:k], page[k:end], end
        at = to or end
        if to:
            yield "", "", to
    yield page[at:], "", len(page)


def parse(page: str, templates: frozenset[int] = frozenset(), host: str = "", rooted: bool | None = None) -> tuple[list[str], set[int]]:
    """The article's blocks, and hashes of the subtrees that may belong to a template (odd ones: plain text).

    Without an article or main element the whole body counts as the article.  So it does where
    they are only named in scripts, comments or other elements' names, or stand in a dropped
    element: the page is then read again.  Plain blocks are not deleted when no other text is left.
    A form that wraps parts of the page (its headers, its article) is no form, as server-side pages put
    one around all they have; what is filled in within it is still left out.
    """
    wraps = None
    if rooted is None:
        rooted = _ROOT.search(page) is not None
    opened = False
    blocks: list[str] = []
    spared: list[tuple[int, list[str]]] = []  # plain template blocks and where they stood
    line: list[str] = []
    hashes: set[int] = set()
    stack = [_Open("", False, not rooted, False, [], 0, False)]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are; "*": containers

    def flush() -> None:
        if line:
            text = _SPACE.sub(" ", _html.unescape("".join(line))).strip()
            if text:
                blocks.append(text)
            line.clear()

    def close() -> None:
        top = stack.pop()
        places[top.name].pop()
        if top.name in CONTAINERS:
            places["*"].pop()
        if top.name not in BLOCK:  # its parts are those of the block around it
            stack[-1].rich |= top.rich
            return
        flush()
        plain = top.name in PLAIN and not top.marked and not top.rich
        h = xxhash.xxh3_64_intdigest("\x00".join(top.parts)) >> 1 & ~1 | plain
        if top.name not in WHOLE and len(top.parts) > 1:
            hashes.add(h)
            if h in templates and len(blocks) > top.blocks:
                if plain:
                    spared.append((top.blocks, blocks[top.blocks :]))
                del blocks[top.blocks :]
        stack[-1].parts.append(str(h))
        stack[-1].rich |= not plain

    def close_to(k: int) -> None:
        while len(stack) > k:
            close()

    def close_open(ends: Iterable[str], stops: Iterable[str]) -> None:
        """Close the innermost element of ``ends`` unless one of ``stops`` lies between."""
        innermost = lambda names: max((places[x][-1] for x in names if places.get(x)), default=0)
        k = innermost(ends)
        if k and k >= innermost(stops):
            close_to(k)

    def words(text: str) -> None:
        top = stack[-1]
        squeezed = _SPACE.sub(" ", text).strip()
        if squeezed:
            top.parts.append(squeezed.replace(host, "\x01") if host else squeezed)
        if top.inside and not top.dropped:
            line.append(text)

    markup = _markup(page)
    for text, tag, at in markup:
        if text:
            words(text)
        found = _NAME.match(tag)
        if found is None:  # a comment, a declaration or the end
            if tag.startswith("<![CDATA["):
                words(_html.escape(tag[9:].removesuffix("]]>")))
            continue
        name = found[1].lower()
        if tag[1] == "/":
            if name == "br":
                line.append(" ")
            close_open((name,), () if name in OUTER else ("article", "main", "table"))
            continue
        attributes = _attributes(tag, name) if len(tag) > len(name) + 2 else {}
        if name in BLOCK:
            close_open(("p",), ("*",))
            flush()
        if name in CLOSES:
            close_open(*CLOSES[name])
            if name in ("td", "th"):
                line.append(" ")
        if name in VOID:
            if name in ("br", "hr") and stack[-1].inside and not stack[-1].dropped:
                line.append(" ")
            continue
        if name in RAW:
            end = _ENDS[name].search(page, at)
            markup.send(end.end() if end else len(page))
            continue
        top = stack[-1]
        inside = top.inside or name in ("article", "main")
        bare = " ".join(f"{k}={v}" for k, v in sorted(attributes.items()) if k in ("class", "id", "role", "href"))
        parts = [] if name in BLOCK else top.parts
        parts.append(name + bare)
        places[name].append(len(stack))
        if name in CONTAINERS:
            places["*"].append(len(stack))
        if name == "form" and wraps is None:
            wraps = _wrapping(page)
        around = name == "form" and wraps(at)
        stack.append(_Open(name, top.dropped or _unwanted("div" if around else name, attributes, inside), inside, bool(attributes), parts, len(blocks), name == "a"))
        opened |= name in ("article", "main") and not stack[-1].dropped
    close_to(1)
    flush()
    if rooted and not opened:
        return parse(page, templates, host, rooted=False)
    if not blocks and spared:
        blocks = [x for _, some in spared for x in some]
    return blocks, hashes


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col("page_id"), F.col("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


@dataclass(frozen=True)
class Often:
    """When a subtree is a template: on ``least`` different pages of a host and on ``share`` of them, or on ``enough``.

    A block of plain text: on ``plain_least`` pages and ``plain_share`` of them.
    """

    least: int = 3
    share: float = 0.2
    enough: int = 50
    plain_least: int = 10
    plain_share: float = 0.95


def recurring(pages: DataFrame, often: Often = Often()) -> DataFrame:
    """host, hash: the subtrees that recur on a host's pages, as :class:`Often` says.

    Pages of one host with the same blocks count once.  Pages without a host have no
    templates; null and empty pages count as one page without blocks.
    """
    hosted = _hosted(pages).where("host <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                blocks, hashes = parse(page.as_py(), host=host)
                texts.append(xxhash.xxh3_64_intdigest("\n".join(blocks)) >> 1)
                found.append([0, *hashes])  # 0 counts the pages
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["host", "text", "hashes"])

    # copies first, a few numbers a page; of several the least list, so that any run takes the same
    once = hosted.select("host", "html").mapInArrow(run, "host string, text long, hashes array<long>").groupBy("host", "text").agg(F.min(F.array_sort("hashes")).alias("hashes"))
    counts = once.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    counts = durable(counts.where(F.col("n") >= often.least), "subtrees")
    totals = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    n, plain = F.col("n"), F.col("hash").bitwiseAND(F.lit(1)) == 1
    recurs = F.when(plain, (n >= often.plain_least) & (n >= F.col("pages") * often.plain_share)).otherwise((n >= F.col("pages") * often.share) | (n >= often.enough))
    return durable(counts.where("hash <> 0").join(totals, "host").where(recurs).select("host", "hash"), "templates")


def site_templates(pages: DataFrame, often: Often = Often()) -> DataFrame:
    """host, hashes: :func:`recurring` as one list a host, for hosts whose lists are known to be small."""
    return recurring(pages, often).groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def _own_templates(hosted: DataFrame, templates: DataFrame) -> DataFrame:
    """key, hashes: of each page the templates among its own subtrees, so that no list is longer than a page.

    Pages are told by a hash of what they hold; equal pages share a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[*parse(page.as_py(), host=host)[1]] for host, page in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["key", "host", "hashes"])

    each = hosted.where("host <> ''").select("key", "host", "html").mapInArrow(run, "key long, host string, hashes array<long>")
    subtrees = each.select("key", "host", F.explode("hashes").alias("hash")).distinct()
    return subtrees.join(templates, ["host", "hash"]).groupBy("key").agg(F.collect_list("hash").alias("hashes"))




def extract_pages(pages: DataFrame, often: Often = Often()) -> DataFrame:
    """page_id, url and text of every page.

    Blocks are joined by an empty line; character references are decoded and white space
    within a block is one space.  Null and empty pages, and pages without any article text,
    have the empty text.  Null ids and urls stay; repeated rows each have a row; columns
    other than page_id, url and html are not looked at.
    """
    templates, hosted = recurring(pages, often), _hosted(pages)
    shared = templates.count() <= BROADCAST_HASHES
    if shared:
        # all hosts' lists together are small: one a host goes to every task
        lists = templates.groupBy("host").agg(F.collect_list("hash").alias("hashes"))
        joined = hosted.join(F.broadcast(lists), "host", "left").select("page_id", "url", "host", "html", "hashes")
    else:
        keyed = hosted.withColumn("key", F.xxhash64("host", "html"))
        joined = keyed.join(_own_templates(keyed, templates), "key", "left").select("page_id", "url", "host", "html", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for k, host in enumerate(batch.column(2).to_pylist()):
                if host not in kept or not shared:
                    if len(kept) > 10_000:
                        kept.clear()
                    kept[host] = frozenset(batch.column(4)[k].as_py() or ())
                texts.append("\n\n".join(parse(batch.column(3)[k].as_py(), kept[host], host)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = joined.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
