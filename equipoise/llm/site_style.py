"""Main text of web pages by site style trees.

Pages of a host share a layout. Their DOMs are merged into one tree of element paths; for every path
the tree counts which sequences of children (presentation) and which texts (content) the pages show.
The entropy of these, over the pages that have the path, is its importance: what looks and reads the
same on every page is template. A branch whose composite importance, presentation of the element and
content of its most telling leaf, is low on a host with enough pages is removed from each of its pages;
so nothing goes that has anything of its own below it.

Beside that a page is read for what it says itself: elements and names that mean menus, headers,
footers, sidebars, notices, adverts, forms or comments go. A name other than of comments needs the
support of the text below it: a branch of ``LONG_BRANCH`` words or more, of which few are links, stays.
If articles, or else main parts, hold most of the page's words that are not noise, only they are
read. Paragraphs of a part that is read alone are never removed for repeating on a host.

Counts are combined before the shuffle, so a host that holds a third of all pages costs a row per
path and map task. A host's removed paths occur on at least half of its pages, so they number at most
twice a page's paths; pages are joined with them by host.

Cases: a null html is an empty page; a null or odd url has the host ''. Repeated pages count each.
Broken or cut markup is read as far as it goes. A page without text gives ''.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import stored

LEAST_PAGES = 4
LEAST_IMPORTANCE = 0.3
PRESENTATION_WEIGHT = 0.3
LONG_BRANCH = 40
LINK_SHARE = 0.3
ARTICLE, MAIN = 2, 1

# HTML's void, raw-text and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
# Elements and names of what is no main text.
MUTE = frozenset("noscript template svg select button object annotation annotation-xml".split())  # inline, without text of the page
BOILERPLATE = frozenset("nav footer aside form menu dialog head search fieldset".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies "
    "consent gdpr notice notices alert alerts announcement nav navbar navigation navi menu menus submenu sidebar sidebars aside rail footer foot "
    "masthead topbar toolbar breadcrumb breadcrumbs crumbs comment comments commentlist disqus respond reply replies discussion related recommended "
    "recommendations share sharing social newsletter subscribe subscription signup login register popup modal overlay lightbox widget widgets "
    "pagination pager skip copyright legal disclaimer search searchbox form teaser outbrain taboola".split()
)
DOUBTFUL_NAMES = frozenset("discussion legal copyright disclaimer share sharing social related register search form skip rail widget widgets teaser promotion".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt b i em strong a span".split())
SPARED = PROSE | {"article", "main", "body", "html"}  # within an article or main part

# A quote opens a value only right behind "="; elsewhere it is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?(?:>|$)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\s(class|id|role|hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")


class Block:
    """A run of text between block borders: its words, path, and what its ancestors say of it.
    ``named`` counts the words and the linked words of each branch around it that is noise by name,
    and says whether that name could mean the story as well."""

    __slots__ = ("text", "path", "noise", "region", "named")

    def __init__(self, text: str, path: tuple[str, ...], noise: bool, region: int, named: tuple[list[int], ...]):
        self.text, self.path, self.noise, self.region, self.named = text, path, noise, region, named

    def dropped(self, page_words: int) -> bool:
        """Noise, or below a name that the branch's text does not contradict: a long one that holds
        most of the page is the story, whatever it is called, and so may be one of a doubtful name."""
        return self.noise or any(
            linked > LINK_SHARE * words or words < LONG_BRANCH or (not doubtful and 2 * words < page_words)
            for words, linked, doubtful in self.named
        )


def _describe(tag: str, token: str, inside_region: bool) -> tuple[str, bool, frozenset[str] | set[str], int]:
    """Label of an element in the tree, whether it is noise by itself, the noise names it bears
    otherwise, and the region it opens: ``ARTICLE`` or ``MAIN``."""
    attributes = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(token)}
    names = set(_WORDS.findall(attributes.get("class", ""))) | set(_WORDS.findall(attributes.get("id", "")))
    role = attributes.get("role", "")
    noise = tag in BOILERPLATE or role in NOISE_ROLES or "hidden" in attributes
    named = set()
    if tag not in ("html", "body", "article", "main"):
        noise = noise or bool(names & COMMENT_NAMES)
        named = names & NOISE_NAMES
    if tag == "header" or "header" in names and tag != "body":
        noise = noise or not inside_region
    region = ARTICLE if tag == "article" or attributes.get("itemprop") == "articlebody" else MAIN if tag == "main" or role == "main" else 0
    label = tag + "".join("." + n for n in sorted(names)[:4])
    return label, noise, set() if noise else named, region


def parse(page: str) -> tuple[list[Block], list[tuple[tuple[str, ...], str]]]:
    """Blocks of a page in order, and ``(path, children)`` of every element."""
    stack: list[list] = []  # tag, path, noise, region, children, named
    mute = None  # depth of the outermost open element of MUTE
    last_end = {}  # of elements of MUTE: where the last end tag is
    blocks: list[Block] = []
    elements: list[list] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                inside = stack[:mute]
                top = inside[-1] if inside else ["", (), False, 0, [], ()]
                for counts in top[5]:
                    counts[0] += words.count(" ") + 1
                blocks.append(Block(words, top[1], top[2], top[3], top[5]))

    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)[0]
        at += len(token)
        if token[0] != "<" or token == "<":
            if mute is None:
                token = html.unescape(token)
                text.append(token)
                if stack and stack[-1][5] and any(e[0] == "a" for e in stack):
                    for counts in stack[-1][5]:
                        counts[1] += len(token.split())
            continue
        name = _NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if tag in BLOCK and mute is None:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if mute is not None and depth <= mute:
                        if tag in BLOCK:
                            flush()
                        mute = None
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCK and tag not in BLOCK and tag not in MUTE:
                    break
            continue
        if tag in VOID:
            if mute is not None:
                continue
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in RAW:
            if not token.endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else len(page)
            text.append(" ")
            continue
        if tag in MUTE:
            if tag not in last_end:
                last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
            text.append(" ")
            # Without an end it would hold all that follows; then it holds nothing.
            if token.endswith("/>") or last_end[tag] < at:
                continue
            mute = len(stack) if mute is None else mute
        if mute is not None:
            if not token.endswith("/>"):
                stack.append([tag, stack[-1][1] if stack else (), True, 0, [], ()])
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                _close(stack, {"p"}, {"table", "td", "th", "button"})
            if tag in ("li", "dd", "dt", "tr", "td", "th"):
                _close(stack, {"li"} if tag == "li" else {"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag != "tr" else {"tr"}, {"ul", "ol", "dl", "table"})
        parent = stack[-1] if stack else None
        label, noise, named, region = _describe(tag, token, bool(parent and parent[3]))
        path = (parent[1] if parent else ()) + (label,)
        if parent:
            parent[4].append(label)
        item = [tag, path, noise or bool(parent and parent[2]), region | (parent[3] if parent else 0), [], (parent[5] if parent else ()) + (([0, 0, named <= DOUBTFUL_NAMES],) if named else ())]
        elements.append(item)
        stack.append(item)
    flush()
    return blocks, [(e[1], " ".join(e[4])) for e in elements]


def _close(stack: list[list], tags: set[str], stop: set[str]) -> None:
    for depth in range(len(stack) - 1, -1, -1):
        if stack[depth][0] in tags:
            del stack[depth:]
            return
        if stack[depth][0] in stop:
            return


def _template(path: tuple[str, ...], removed: frozenset[str], spare: frozenset[str] = frozenset()) -> bool:
    """Whether a removed branch holds the path; branches of ``spare`` elements do not count."""
    return any(">".join(path[:depth]) in removed and path[depth - 1].split(".")[0] not in spare for depth in range(1, len(path) + 1))


def main_text(page: str, removed: frozenset[str]) -> str:
    """The page's article, one line per block. ``removed`` holds the paths of the host's template."""
    blocks, _ = parse(page)
    page_words = sum(len(b.text.split()) for b in blocks if not b.noise)
    blocks = [b for b in blocks if not b.dropped(page_words)]
    sizes = [(b.region, 0 if _template(b.path, removed, SPARED if b.region else frozenset()) else len(b.text.split())) for b in blocks]
    half = sum(n for _, n in sizes) / 2
    region = next((r for r in (ARTICLE, MAIN) if sum(n for own, n in sizes if own & r) > half), 0)
    kept = []
    for block in blocks:
        if region and not block.region & region:
            continue
        if not _template(block.path, removed, SPARED if region else frozenset()):
            kept.append(block.text)
    return "\n".join(kept)


def host_of(url: str = "url") -> Column:
    """Host of an address, '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def style_trees(pages: DataFrame) -> DataFrame:
    """``(host, path, pages, importance)`` of the merged trees."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, kinds, keys = [], [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks, elements = parse(page)
                seen: dict[tuple[int, str], list[str]] = {}
                for path, children in elements:
                    seen.setdefault((0, ">".join(path)), []).append(children)
                for block in blocks:
                    seen.setdefault((1, ">".join(block.path)), []).append(block.text)
                for (kind, path), shown in seen.items():
                    hosts.append(host)
                    paths.append(path)
                    kinds.append(kind)
                    keys.append("\n".join(shown))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(kinds, pa.int32()), pa.array(keys, pa.string())], ["host", "path", "kind", "shown"])

    rows = pages.select(host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    shown = rows.mapInArrow(walk, "host string, path string, kind int, shown string").select("host", "path", "kind", F.xxhash64("shown").alias("shown"))
    counts = shown.groupBy("host", "path", "kind", "shown").agg(F.count("*").alias("n"))
    # Entropy to the base of the number of pages: log m - sum(n log n) / m, over log m.
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("part"))
    entropy = F.when(F.col("m") > 1, 1 - F.col("part") / (F.col("m") * F.log(F.col("m").cast("double")))).otherwise(1.0)
    return sums.select("host", "path", "kind", "m", entropy.alias("importance"))


def removed_paths(pages: DataFrame) -> DataFrame:
    """``(host, removed)``: paths of each host that are template."""
    tree = stored(style_trees(pages), "tree")
    parts = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ">"))
    content = tree.where("kind = 1").select("host", F.explode(above).alias("path"), "m", "importance")
    content = content.groupBy("host", "path").agg(F.max("importance").alias("content"))
    style = tree.where("kind = 0").select("host", "path", "m", F.col("importance").alias("style"))
    joined = style.join(content, ["host", "path"])
    composite = PRESENTATION_WEIGHT * F.col("style") + (1 - PRESENTATION_WEIGHT) * F.col("content")
    # A branch is judged on the pages that show it, so each layout of a host has its template.
    low = joined.where((F.col("m") >= LEAST_PAGES) & (composite < LEAST_IMPORTANCE)).select("host", "path")
    # Branches within removed branches say nothing more.
    up = F.explode(F.slice(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ">")), 1, F.size(parts) - 1))
    inner = low.select("host", "path", up.alias("above")).join(low.select("host", F.col("path").alias("above")), ["host", "above"], "left_semi")
    top = low.join(inner.select("host", "path"), ["host", "path"], "left_anti")
    return top.groupBy("host").agg(F.collect_set("path").alias("removed"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    removed = stored(removed_paths(pages), "removed")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, frozenset(paths or ())) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    rows = rows.join(removed, "host", "left").select("page_id", "url", "html", "removed")
    return rows.mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
