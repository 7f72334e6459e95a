"""Main text of web pages: the maximum-scoring run of words and tags.

A page is read as words and tags in order. Words score above zero and tags below, with weights
from pages whose content region is marked; one linear scan finds the contiguous run of the highest
sum, and the text blocks in it are the main text. Where a page marks its content itself (article,
else main), each marked region is scanned for itself, and tags in it score zero: tables, figures or
lists end no region. What is never content by its markup (menus, forms, adverts, scripts, comments
of readers, ...) is left out before and splits no block: by its tag, role or hiding, or by a name of
its class or id, whole or in part, whatever its size; see _read() for elements around marked regions.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, small_batches, text_of

#: Weights are learned from a bounded sample of pages with one marked region, those of the least hashes.
SAMPLE = 1_000
MARKED = frozenset(("article", "main"))
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Left out whole, wherever they stand; `header` only outside marked regions.
NEVER = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object svg canvas dialog menu noembed noframes xmp title audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Class names or ids of elements that are not content, fixed values: whole names, parts of names between - or _, and those of readers' comments.
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist comment-list respond disqus cookie cookies cookie-banner cookie-notice "
    "consent notice alert popup modal sidebar side-bar left-sidebar right-sidebar widget widgets menu main-menu navbar nav navigation toolbar footer site-footer page-footer masthead site-header "
    "page-header share sharing social social-share social-links related related-posts recommended promo sponsor sponsored newsletter subscribe signup login search search-form pagination pager skip-link".split()
)
PARTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist disqus respond cookie cookies consent popup modal sidebar widget widgets navbar nav "
    "navigation toolbar footer masthead newsletter promo sponsor sponsored pagination pager".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
#: A name with one of these tells of what stands beside the element, of its state, or that there is none.
BESIDE = frozenset("with has no without open closed".split())
ROLE = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"))

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_INSIDE = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden)(?![^\s=/>])\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile("[-_]+")
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether an end tag, name, attributes) of each piece of markup; comments and declarations have no name.

    A quote that is never closed ends its tag at the next >. Whatever was read is not read again,
    so that a page takes time in proportion to its length. A < that starts no markup is text.
    """
    at, size = page.find("<"), len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, False, "", ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = size if end < 0 else end + 1
            yield at, end, False, "", ""
        elif m := _NAME.match(page, at + 1):
            end = _INSIDE.match(page, m.end()).end()
            if end < size and page[end] != ">":  # a quote without an end
                end = page.find(">", end)
                end = size if end < 0 else end
            yield at, min(end + 1, size), bool(m[1]), m[2].lower(), page[m.end() : end]
            end = min(end + 1, size)
        else:
            end = at + 1
        at = page.find("<", end)


def raw_end(page: str, name: str, at: int) -> tuple[int, int]:
    """Where the text of a raw element ends, and where its end tag does."""
    end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
    close = page.find(">", end.end()) if end else -1
    return end.start() if end else len(page), close + 1 if close >= 0 else len(page)


def _may_go(attributes: str) -> str:
    """What an element's class, id, role or hiding says: "" nothing, "comments" readers' comments, "other" that it is no content else."""
    said = ""
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            for name in value.split():
                parts = set(_PARTS.split(name))
                if parts & COMMENTS and not parts & BESIDE:
                    return "comments"
                if name in NAMES or (parts & PARTS and not parts & BESIDE):
                    said = "other"
        elif (key == "role" and value in ROLE) or (key == "hidden" and value != "until-found") or (key == "aria-hidden" and value == "true"):
            said = "other"
    return said


@dataclass
class _Element:
    name: str
    at: int  # its place among the events
    regions: int  # marked regions before it
    may_go: str
    marked: bool  # stands in a marked region


def _read(page: str) -> tuple[list[tuple[str, str, int]], list[tuple[int, int]]]:
    """Events, and the elements that are left out as (first event, event after it).

    An element that its attributes speak against goes if it holds no marked region, or stands in one
    itself (what is marked in it is beside the content, such as teasers of other articles). One of
    readers' comments goes too if there are marked regions outside it; articles can be comments.
    Where a page marks nothing and would be left without a word, the element of the most words that
    goes by a name other than of comments is a wrapper, and stays.
    """
    seen: list[tuple[str, str, int]] = []
    stack: list[_Element] = []
    open_ = Counter()
    out: list[tuple[int, int, bool, str, bool, int]] = []  # first event, event after it, by its tag alone, what is said of it, within a marked region, regions in it
    hidden = regions = at = upto = 0  # hidden: open elements that go by their tag; upto: markup before it was read as raw text

    def level() -> int:
        """2 within an article, 1 within main alone, else 0."""
        return 2 if open_["article"] else 1 if open_["main"] else 0

    def close() -> _Element:
        nonlocal hidden
        e = stack.pop()
        open_[e.name] -= 1
        never = e.name in NEVER or (e.name == "header" and not e.marked)
        hidden -= never
        if never or e.may_go:
            out.append((e.at, len(seen), never, e.may_go, e.marked, regions - e.regions))
        return e

    def text(a: int, b: int) -> None:
        if b > a:
            seen.append(("", html.unescape(page[a:b]), level()))

    for start, end, closing, name, attributes in tags(page):
        if start < upto:
            continue
        text(at, start)
        at = end
        if not name:
            continue
        if closing:
            if open_[name]:
                while close().name != name:
                    pass
                seen.append((f"/{name}", "", level()))
            continue
        if (name in _CLOSES_P and stack and stack[-1].name == "p") or (name == "li" and stack and stack[-1].name == "li"):
            close()
        alone = name in VOID or attributes.endswith("/")
        if name in RAW and not alone:
            at = upto = raw_end(page, name, end)[1]
            seen.append((f"!{name}", "", level()))
            continue
        seen.append((name, "", level()))
        if not alone:
            never = name in NEVER or (name == "header" and not level())
            may_go = "" if never or name in ("html", "body") or not attributes else _may_go(attributes)
            if name in MARKED and may_go != "comments":
                may_go = ""
            stack.append(_Element(name, len(seen) - 1, regions, may_go, level() > 0))
            open_[name] += 1
            regions += name in MARKED and not hidden
            hidden += never
    text(at, len(page))
    while stack:
        close()
    gone = sorted((a, b) for a, b, never, said, marked, held in out if never or not held or marked or (said == "comments" and held < regions))
    named = {(a, b) for a, b, never, said, _, _ in out if said == "other" and not never}
    if not regions and named and not any(text.split() for tag, text, _ in _left(seen, gone) if not tag):
        before = list(accumulate((0 if tag else len(text.split()) for tag, text, _ in seen), initial=0))
        gone.remove(max(sorted(named), key=lambda ab: before[ab[1]] - before[ab[0]]))
    return seen, gone


def _left(seen: list[tuple[str, str, int]], gone: list[tuple[int, int]]) -> Iterator[tuple[str, str, int]]:
    """The events but for elements that are left out, each of which gives its name with a mark before it."""
    at = 0
    for a, b in gone:
        if a >= at:
            yield from seen[at:a]
            yield f"!{seen[a][0]}", "", seen[a][2]
            at = b + 1 if b < len(seen) and seen[b][0] == f"/{seen[a][0]}" else b
    yield from seen[at:]


def events(page: str) -> Iterator[tuple[str, str, int]]:
    """(tag, text, level): a tag's name (an end tag with a slash) with no text, or no tag with a decoded text; level: 2 within an article, 1 within main, else 0.

    An element that is left out gives its name with a mark before it, and nothing else; it ends
    with its end tag or with that of an element around it.
    """
    yield from _left(*_read(page))


def tally(page: str) -> Counter:
    """(token, in, out) counts of a page with just one marked region, by token: "word", or a tag's name; else nothing."""
    found: Counter = Counter()
    if sum(name in MARKED and not closing for _, _, closing, name, _ in tags(page)) != 1:
        return found
    for tag, text, marked in events(page):
        if not tag:
            found["word", marked > 0] += len(text.split())
        elif tag[0] != "!" and tag.strip("/") not in MARKED:
            found[tag, marked > 0] += 1
    return found


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of standing in a marked region, words held at 0.1 or more and tags at -0.01 or less."""
    names = {k for k, _ in counts}
    odds = {n: math.log((counts.get((n, True), 0) + 1) / (counts.get((n, False), 0) + 1)) for n in names}
    return {n: max(0.1, min(2.0, w)) if n == "word" else min(-0.01, w) for n, w in odds.items()} | {"word": max(0.1, min(2.0, odds.get("word", 1.0)))}


def best_run(seen: list[tuple[str, str]], weight: dict[str, float], marked: bool) -> tuple[int, int]:
    """(first event, event after the last) of the run of the highest sum, of equal ones the first and shortest; tags score zero in a marked region."""
    best, best_from, best_to, total, begin = 0.0, 0, 0, 0.0, 0
    word, other = weight["word"], weight.get("div", -1.0)
    for i, (tag, text) in enumerate(seen):
        if total <= 0:
            total, begin = 0.0, i
        if not tag:
            total += word * len(text.split())
        elif tag[0] != "!" and not marked:
            total += weight.get(tag, -0.01 if tag.strip("/") in INLINE else other)
        if total > best:
            best, best_from, best_to = total, begin, i + 1
    return best_from, best_to


def extract(page: str | None, weight: dict[str, float]) -> str:
    """Blocks of the best run of each marked region, or of the page if it marks none, white space made single, joined by line ends."""
    seen = list(events(page or ""))
    top = max((level for tag, text, level in seen if not tag and text.strip()), default=0)
    regions: list[list[tuple[str, str]]] = [[]]
    for tag, text, level in seen:
        if level >= top:
            regions[-1].append((tag, text))
        elif regions[-1]:
            regions.append([])
    blocks = []
    for region in regions:
        first, last = best_run(region, weight, top > 0)
        now = []
        for tag, text in region[first:last]:
            if not tag:
                now.append(text)
            elif tag.strip("/!") not in INLINE:
                blocks.append("".join(now))
                now = []
        blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def learn(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from marked pages; with none, words and tags weigh as in `weights` without counts."""
    small_batches(pages.sparkSession)
    h = F.col(html_col)
    marked = pages.select(h.alias("html"), F.xxhash64(h).alias("h")).where(h.rlike(r"(?i)<(article|main)\b"))
    least = [r.h for r in marked.select("h").distinct().orderBy("h").limit(sample).collect()]  # hashes alone are sorted, no pages
    chosen = marked.where(F.col("h") <= F.lit(least[-1] if least else 0)).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                total.update(tally(page))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([m for _, m in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["token", "marked", "n"])

    got = chosen.mapInArrow(run, "token string, marked boolean, n bigint").groupBy("token", "marked").agg(F.sum("n").alias("n"))
    return weights({(r.token, r.marked): r.n for r in got.collect()})  # names of tags in the bounded sample


def main_text(pages: DataFrame, html_col: str = "html", weight: dict[str, float] | None = None) -> DataFrame:
    """pages without their html, with text and n_chars (its code points) added; columns of these names are replaced.

    Each page is read whole and for itself, so that repeated rows and ids get equal texts. A null or
    empty page, or one without words, gives an empty text; an empty table no rows.
    """
    small_batches(pages.sparkSession)
    weight = weight or learn(pages, html_col)

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: extract(t, weight)).astype(object)

    return pages.select(*columns(pages, "text", "n_chars", html_col.lower()), of(text_of(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
