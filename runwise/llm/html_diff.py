"""Main text of web pages by nearest-URL page differencing, with the page's own structure.

Pages of a host are ordered by URL path; each is paired with the neighbour whose path shares
the longer beginning.  The text lines of both (one line per block element) are aligned by a
longest common subsequence, and lines outside the article that both have are deleted.

Differencing alone can't be right where pages of a host share article text (copies, passages) or
where adverts and menus differ from page to page.  So structure decides what is certain:
elements that never hold article text (menus, forms, scripts, adverts, comments, ...) are
dropped, by their name, role, or the class or id of a container (never of a paragraph or of running text); where the
page marks its article, the lines in it are kept and those around it dropped.  Every page is judged by differencing; where a page marks
its article, the mark then checks that verdict line by line: a shared line of the article (a copy, a passage) stays, and what differencing
couldn't see around the article goes too.  In all other pages the verdict stands.  Where the paired page shares over half of the text, either may
be a copy of the other or both stand under long boilerplate: then a line is deleted only if the page's other neighbour has it as well.

The order of a host's pages is cut into ranges, so a host with a third of all pages is spread over
many tasks; neighbours across a cut are found from the first and last page of each range.

Defined results: null and empty html give an empty text; pages without a url or alone in their
host have no neighbour; repeated rows give equal results; unclosed elements end with the page, but a dropped one inside an article loses its
tag only; a very long page is read whole; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runwise.llm.common import map_texts, written

# Above this share of the characters of a page, what it shares with the paired page needs a second witness.
COPY_SHARE = 0.5

# Elements of HTML by their role here.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "dialog", "menu", "audio", "video", "map"} | RAW
ARTICLE = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
# Elements whose class or id may mark what isn't the article: containers, not paragraphs, headings or running text.
CONTAINERS = {"div", "section", "article", "ul", "ol", "dl", "table", "header", "center", "details", "fieldset", "figure"}
# Names in a class or id that mark what isn't the article: alone, after other words, or before a word for a part of a page.
_MARKS = re.compile(
    r"(?:^|.*[_-])(?:nav|navbar|navigation|menu|sidebar|side-bar|footer|masthead|site-header|page-header|topbar|banner|ad|ads|advert|advertisement|"
    r"adsense|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|share|sharing|social|related|recommended|recommendations|comment|comments|disqus|respond|replies|breadcrumb|breadcrumbs|"
    r"pagination|pager|login|signin|signup|search|widget|toolbar|skip|skip-link)"
    r"(?:[_-](?:\d+|area|articles|bar|block|body|box|button|buttons|container|content|footer|form|group|header|inner|item|items|link|links|list|"
    r"menu|message|nav|outer|panel|posts|section|slot|teaser|text|title|top|bottom|unit|widget|wrap|wrapper))*$", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                  r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _is_dropped(name: str, attrs: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body"):
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id") and name in CONTAINERS and any(_MARKS.match(word) for word in value.split()):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the content of a raw element, which is no markup, ends with its closing tag."""
    close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
    return close.end() if close else len(page)


def _closed(page: str) -> set[int]:
    """Where the opening tags end that have a closing tag of their own, each name by itself."""
    open_: dict[str, list[int]] = {}
    out, at = set(), 0
    while tag := _TAG.search(page, at):
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            continue
        if tag["end"] or tag["end2"]:
            if open_.get(name):
                out.add(open_[name].pop())
        elif name in RAW:
            at = _raw_end(page, name, at)
        else:
            open_.setdefault(name, []).append(at)
    return out


def lines_of(page: str | None, closed: set[int] | None = None) -> list[tuple[str, bool]]:
    """Text lines of a page in order, one per block, each with whether it is inside an article element.

    ``closed`` is given when the page is read again, as an element to be dropped from an article had no end.
    """
    if not page:
        return []
    lines: list[tuple[str, bool]] = []
    parts: list[str] = []
    articles, skip, depth, at, end = 0, "", 0, 0, len(page)

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append((text, articles > 0))
            parts.clear()

    while at < end:
        tag = _TAG.search(page, at)
        upto = tag.start() if tag else end
        if not skip and upto > at:
            parts.append(html.unescape(page[at:upto]))
        if not tag:
            break
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            continue
        closing = bool(tag["end"] or tag["end2"])
        if skip:
            if name in RAW and not closing:
                at = _raw_end(page, name, at)
            elif name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            if name in ARTICLE and articles:
                articles -= 1
            continue
        attrs = tag["attrs"] or ""
        if name in VOID or attrs.endswith("/") and name in ("svg", "path"):
            continue
        if _is_dropped(name, attrs, articles > 0):
            if name in RAW:
                at = _raw_end(page, name, at)
            elif closed is None or at in closed or not articles:
                skip, depth = name, 1
        elif name in ARTICLE:
            articles += 1
    if skip and articles and closed is None:
        return lines_of(page, _closed(page))
    flush()
    return lines


def print_of(line: str) -> int:
    import xxhash

    x = xxhash.xxh3_64_intdigest(line)
    return x - (1 << 64) if x >> 63 else x


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    last: list[tuple | None] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[k] = j
                last[k] = link
    out, link = [], last[-1] if last else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def shared_lines(lines: list[int], sizes: list[int], others: list[list[int]]) -> list[int]:
    """Lines to delete: those shared with the nearest of the other pages, if they are over ``COPY_SHARE`` of the text only
    those that the next one has as well; none if that is all there is."""
    others = [o for o in others if o != lines]  # a page with the very same lines says nothing
    if not others:
        return []
    at = common_lines(lines, others[0])
    if sum(sizes[k] for k in at) > COPY_SHARE * sum(sizes):
        at = sorted(set(at) & set(common_lines(lines, others[1]))) if len(others) > 1 else []
    return at if len(at) < len(lines) else []


def main_text(page: str | None, deleted: list[int] | None) -> str:
    """The lines that ``deleted`` leaves, of the article only if the page marks one."""
    lines = lines_of(page)
    marked = any(inside for _, inside in lines)
    gone = set(deleted or ())
    return "\n\n".join(text for k, (text, inside) in enumerate(lines) if k not in gone and (inside or not marked))


def keyed(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    return pages.withColumns({"key": F.xxhash64("page_id", "url", "html"), "host": host, "path": path})


def line_prints(pages: DataFrame) -> DataFrame:
    """Per page its lines' fingerprints and lengths, and the indices of the lines in the article it marks."""
    def make():
        def apply(texts):
            every = [lines_of(t) for t in texts]
            return ([[print_of(x) for x, _ in ls] for ls in every], [[len(x) for x, _ in ls] for ls in every],
                    [[k for k, (_, i) in enumerate(ls) if i] for ls in every])
        return apply
    rows = keyed(pages).filter("host <> '' AND url IS NOT NULL")
    return map_texts(rows, make, "lines array<bigint>, sizes array<int>, inside array<int>",
                     ["key", "host", "path"], text="html").dropDuplicates(["key"])


def neighbours(prints: DataFrame) -> DataFrame:
    """Each page with the path and lines of the pages before and after it in its host."""
    order = ["host", "path", "key"]
    cut = written(prints.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "ordered")
    page = F.struct("host", "path", "key", "lines")
    inside = Window.partitionBy("slice").orderBy(*order)
    rows = cut.withColumns({"before": F.lag(page).over(inside), "after": F.lead(page).over(inside)})
    # One row per range: the pages on either side of its ends.
    ends = cut.groupBy("slice").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    across = Window.orderBy("slice")
    ends = ends.select("slice", F.lag("last").over(across).alias("prior"), F.lead("first").over(across).alias("later"))
    rows = rows.join(ends, "slice").withColumns({"before": F.coalesce("before", "prior"), "after": F.coalesce("after", "later")})
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.struct(f"{c}.path", f"{c}.lines"))
    return rows.select("key", "path", "lines", "sizes", "inside", same("before").alias("before"), same("after").alias("after"))


def decisions(pages: DataFrame) -> DataFrame:
    """(key, deleted): of every page with a neighbour the lines that differencing deletes, where there are any; lines of the
    article that a page marks are taken back."""
    rows = neighbours(line_prints(pages)).filter("before IS NOT NULL OR after IS NOT NULL")

    def alike(a: str, b: str) -> int:
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for r in batch.to_pylist():
                near = [x for x in (r["before"], r["after"]) if x]
                near.sort(key=lambda x: -alike(r["path"], x["path"]))  # the earlier one first on a tie
                inside = set(r["inside"])
                gone = [k for k in shared_lines(r["lines"], r["sizes"], [x["lines"] for x in near]) if k not in inside]
                if gone:
                    keys.append(r["key"])
                    out.append(gone)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["key", "deleted"])
    return written(rows.mapInArrow(run, "key bigint, deleted array<int>"), "decisions")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_deleted of every page."""
    pages = pages.select("page_id", "url", "html")
    found = decisions(pages)
    rows = keyed(pages).join(found, "key", "left").select("page_id", "url", "html", "deleted")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"]] + T.StructType.fromDDL("text string, n_chars bigint, n_deleted bigint").fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("deleted").to_pylist()
            texts = [main_text(t, d) for t, d in zip(batch.column("html").to_pylist(), gone)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(d or ()) for d in gone], pa.int64())], names)
    return rows.mapInArrow(run, schema)
