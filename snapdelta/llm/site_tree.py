"""Main text of web pages by site style trees.

The element trees of a host's pages are merged: a node is an element with its tag, classes, id and place among the
siblings of that name, and a text under its sibling group is one more node, so that what is repeated is found wherever
it stands. The groups, the same elements whatever their places, are also merged over all hosts. The importance of a node or group comes
from the entropy of what pages have there: of its presentation (which elements follow each other in it) and of its content, the
host's own name taken out. What pages draw from a stock of texts has little entropy, however large the site, and what they write anew
has much; so the importances of groups have two modes, and the threshold lies between them. Few pages show few repeats even of a stock,
so the entropy is carried on from the share of texts seen once (Good and Turing), and a host leans on all hosts.

Removed from a page are the groups below the threshold and, on its host, the nodes that do not vary. What tags, whole classes, ids and
roles say counts only for groups of which too few pages are known, and there unless such names alone hold most of the text; and for
readers' comments and asides, which vary as articles do. Scripts, styles, forms and what is hidden are never text. Pages equal in all their
text count once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.common import written

#: A node is removed below this importance (0: the same on every page, 1: different on every page), on hosts with so many pages.
LOW, LEAST_PAGES = 0.4, 2
#: Pages that the importance of the group on all hosts counts for, for a node, and hosts that it takes.
LEAN, LEAST_HOSTS = 4, 3
#: A group is known from so many pages on (and ``LEAST_HOSTS`` hosts, or pages of one host); its merged importance counts for so many of a host.
KNOWN, STOCK = 100, 200
#: Entropy is measured against that of so many different texts.
HORIZON = 1_000_000
#: The threshold lies between the modes of the groups' importances, within these bounds; without two modes so far apart it is the lower one.
BOUNDS, APART, BINS = (0.4, 0.7), 0.3, 100

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_MARKED = re.compile(r"<(?:article|main)[\s/>]", re.I)

# What HTML says about elements.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover"
    " semantics".split()
)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_NO_TEXT = frozenset(  # never text of an article
    "head script style title noscript template iframe object svg canvas audio video button select option optgroup textarea form"
    " datalist noembed noframes".split()
)
_NO_ARTICLE = frozenset("nav footer aside dialog menu".split())
#: Whole classes, ids and roles; a name that only has such a word in it ("content-sidebar-wrap", "no-comments") says nothing.
_NO_ARTICLE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices"
    " newsletter popup modal overlay sidebar menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments"
    " disqus replies share sharing social related recommended widget toolbar pagination pager login signup subscribe search complementary"
    " contentinfo alert dialog cookie-notice cookie-banner cookie-consent site-footer site-nav main-menu main-nav nav-bar side-bar"
    " disqus_thread related-posts share-buttons".split()
)
#: Of these, what differs from page to page as articles do, so that no tree can tell: readers' comments and what stands beside the article.
_VARYING = frozenset("aside comment comments disqus disqus_thread replies related recommended related-posts".split())
_HEADERS = frozenset("header headers topbar site-header".split())
_MAIN = frozenset("article main".split())
_CLOSED_BY = {  # an open element that a new one ends
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre"
        " section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}


#: What an element is declared to be: anything, no article by a class, id or role, no article by its tag, comments or asides, never text.
OPEN, NAMED, TAGGED, BESIDE, NEVER = range(5)
#: Kinds of nodes, and the group of text outside of all elements.
GROUP, ELEMENT, TEXT = range(3)
ROOT = 0


def _base(host: str) -> str:
    """A host's name without its first part, if what is left is a name still."""
    base = host.partition(".")[2]
    return base if "." in base else host


class Block:
    """A run of text between block elements: the node it stands in, the group of that node (the same elements whatever
    their places), the elements that follow each other in the node, its text, how far it is declared no article,
    whether it is inside one."""

    __slots__ = ("group", "node", "children", "text", "declared", "main")

    def __init__(self, group: int, node: int, children: list[str], text: str, declared: int, main: bool):
        self.group, self.node, self.children, self.text, self.declared, self.main = group, node, children, text, declared, main

    def own(self, host: str) -> int:
        """The node of the text itself, at any place in its group and whatever its host is called."""
        text = self.text
        if host and "." in text and _base(host) in text.lower():
            for name in (host, _base(host)):
                text = re.sub(re.escape(name), "\0", text, flags=re.I)
        return _hash(f"{self.group}={text}")


def tokens(page: str) -> Iterator[tuple[str, str, str, int, int]]:
    """Text, elements and their ends in order: ``("text", text, "", start, end)``, ``("open" or "close", tag, the rest, start, end)``.

    Quotes hold ``>``. From the first tag on whose quotes or end are missing, tags end at the next ``>``, so that no text is searched
    twice. The caller may send the place to go on from.
    """
    at, end, quotes = 0, len(page), True
    last, no_data = page.rfind(">"), False
    while at < end:
        start = page.find("<", at)
        if start < 0 or start > last:
            yield "text", page[at:], "", at, end
            return
        if start > at:
            yield "text", page[at:start], "", at, start
        at = start
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if not no_data and page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at + 9)
            if stop >= 0:
                yield "text", html.escape(page[at + 9 : stop], quote=False), "", at, stop + 3
                at = stop + 3
                continue
            no_data = True
        name = _NAME.match(page, at + 1)
        if name is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                at = page.find(">", at) + 1
            else:
                yield "text", "<", "", at, at + 1
                at += 1
            continue
        stop = _tag_end(page, name.end()) if quotes else -1
        if stop < 0:
            quotes, stop = False, page.find(">", name.end())
        kind = "close" if page[at + 1] == "/" else "open"
        moved = yield kind, name[1].lower(), page[name.end() : stop], at, stop + 1
        at = stop + 1 if moved is None else moved


def _tag_end(page: str, at: int) -> int:
    """Where the ``>`` outside of quotes is; -1 if quotes or tag do not end."""
    while (mark := _STOP.search(page, at)) is not None:
        if mark[0] == ">":
            return mark.start()
        at = page.find(mark[0], mark.end()) + 1
        if not at:
            return -1
    return -1


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    found: list[Block] = []
    # Of each open element: tag, group, node, declared, main, names of its children.
    stack: list[tuple[str, int, int, int, bool, list[str]]] = [("", ROOT, ROOT, OPEN, False, [])]
    # Of each open element, how many children of a name it has so far; and how many elements of a tag are open.
    seen: list[dict[str, int]] = [{}]
    opened: Counter[str] = Counter()
    waiting: list[str] = []
    page = page or ""

    def flush() -> None:
        if waiting:
            text = _SPACE.sub(" ", html.unescape("".join(waiting))).strip()
            waiting.clear()
            if text:
                _, group, node, declared, main, children = stack[-1]
                found.append(Block(group, node, children, text, declared, main))

    def leave() -> None:
        opened[stack.pop()[0]] -= 1
        seen.pop()

    stream, moved = tokens(page), None
    while True:
        try:
            kind, tag, rest, _, end = stream.send(moved)
        except StopIteration:
            break
        moved = None
        if kind == "text":
            waiting.append(tag)
            continue
        if tag in _INLINE:
            if tag == "br":
                waiting.append(" ")
            continue
        flush()
        if kind == "close":
            if opened[tag]:
                while stack[-1][0] != tag:
                    leave()
                leave()
            continue
        while len(stack) > 1 and tag in _CLOSED_BY.get(stack[-1][0], ()):
            leave()
        _, group, node, declared, main, children = stack[-1]
        name, says = _named(tag, rest, main)
        if tag in _MAIN and declared == NAMED:  # the name of a wrapper says less than the article's own tag
            declared = OPEN
        children.append(name)
        place = seen[-1][name] = seen[-1].get(name, 0) + 1
        if tag in _RAW:  # text up to its end tag only
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, end)
            moved = stop.start() if stop else len(page)
        if tag not in _VOID and not rest.endswith("/"):
            own = _hash(f"{group}/{name}"), _hash(f"{node}/{name}/{place}")
            stack.append((tag, *own, max(declared, says), main or (tag in _MAIN and declared == OPEN), []))
            seen.append({})
            opened[tag] += 1
    flush()
    return found


def _named(tag: str, rest: str, main: bool) -> tuple[str, int]:
    """An element's name in the tree, and what tag, class, id and role declare it to be."""
    says = OPEN
    if tag in _NO_TEXT:
        says = NEVER
    elif tag in _NO_ARTICLE or (tag == "header" and not main):
        says = BESIDE if tag in _VARYING else TAGGED
    if not rest:
        return tag, says
    named = [(a.lower(), v.strip("\"'").lower()) for a, v in _ATTRIBUTE.findall(rest)]
    words = {w for _, v in named for w in v.split()}
    if tag in ("html", "body"):  # one on every page, often with the page's number or kind as a class
        return tag, says
    if tag not in _MAIN:
        if _HIDDEN.search(rest):
            says = NEVER
        elif words & _VARYING:
            says = BESIDE
        elif says == OPEN and (words & _NO_ARTICLE_NAMES or (not main and words & _HEADERS)):
            says = NAMED
    own = "".join(f".{_SPACE.sub('.', v.strip())}" if a == "class" else f"#{v.strip()}" for a, v in sorted(named) if a != "role")
    return tag + _DIGITS.sub("0", own), says  # numbers in names are those of pages and items


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - 2**63


def page_rows(page: str | None, host: str = "") -> list[tuple[int, int, int, int, int, int]]:
    """For every node of a page: kind, group, node, hash of its presentation (of a text its length), of its content, and of all text of the page.

    The kinds are groups, elements and texts. The root is a group of every page with text.
    """
    found = [b for b in blocks(page) if b.declared < NEVER]
    if not found:
        return []
    content: dict[tuple[int, int], list[Block]] = {}
    for b in found:
        content.setdefault((b.group, b.node), []).append(b)
    whole = _hash("\n".join(b.text for b in found))
    rows = [(GROUP, g, g, 0, 0, whole) for g in {ROOT, *(b.group for b in found)}]
    rows += [(TEXT, g, n, size, 0, whole) for (g, n), size in {(b.group, b.own(host)): len(b.text) for b in found}.items()]
    for (group, node), mine in content.items():
        names = mine[0].children
        runs = [n for n, before in zip(names, [None, *names], strict=False) if n != before]
        rows.append((ELEMENT, group, node, _hash(" ".join(runs)), _hash("\n".join(b.text for b in mine)), whole))
    return rows


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _sums(rows: DataFrame, value: str, name: str) -> DataFrame:
    """For each node, the sum of c log c over its values, each on c pages."""
    key = ["host", "kind", "group", "node"]
    counts = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*key).agg(F.sum("c").alias("found"), F.sum(F.col("c") * F.log("c")).alias(name))


def _importance(counts: DataFrame, *key: str) -> DataFrame:
    """Importance of groups by the texts found in them: ``weight`` characters on ``c`` pages each.

    The share of text seen once estimates what a further page has new, which counts in full; the rest counts by its entropy. A text on
    many pages counts by the logarithm of their number, so that an article of which there are very many copies is not taken for a stock.
    """
    mass = F.col("weight") * (1 + F.log2("c"))
    sums = counts.groupBy(*key).agg(
        F.sum(mass).alias("mass"), F.sum(F.when(F.col("c") == 1, F.col("weight")).otherwise(0)).alias("once"),
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("known"),
    )
    new = F.col("once") / F.col("mass")
    entropy = F.greatest(F.lit(0.0), F.log("n") - F.col("known") / F.col("n"))
    return sums.select(*key, (new + (1 - new) * F.least(F.lit(1.0), entropy / float(np.log(HORIZON)))).alias("importance"))


def _between_modes(mass: dict[int, int]) -> float:
    """The threshold between the two modes of a histogram of importances: where parting it leaves the least variance within the parts."""
    low, high = BOUNDS
    bins = np.array(sorted(mass), float) / BINS
    weight = np.array([mass[b] for b in sorted(mass)], float)
    best, found = 0.0, low
    for k in range(1, len(bins)):
        below, above = (np.average(part, weights=w) for part, w in ((bins[:k], weight[:k]), (bins[k:], weight[k:])))
        apart = weight[:k].sum() * weight[k:].sum() * (above - below) ** 2
        if above - below >= APART and apart > best:
            best, found = apart, (bins[k - 1] + bins[k]) / 2
    return float(min(high, max(low, found)))


def groups(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """``host, group, low`` of the groups that are known: whether they fall below the threshold.

    ``texts`` are ``host, group, node, weight, c``, the texts of a host's groups, and ``pages`` the pages that have a group,
    ``host, group, pages``. The importance on a host leans on that over all hosts as on ``STOCK`` pages.
    """
    merged = texts.groupBy("group", "node").agg(F.max("weight").alias("weight"), F.sum("c").alias("c"))
    found = pages.groupBy("group").agg(F.sum("pages").alias("in_all"), F.count(F.lit(1)).alias("hosts"))
    merged = written(_importance(merged, "group").join(found, "group"), "merged")
    own = _importance(texts, "host", "group").withColumnRenamed("importance", "own").join(pages, ["host", "group"])
    histogram = merged.where((F.col("in_all") >= KNOWN) & (F.col("hosts") >= LEAST_HOSTS))
    histogram = histogram.groupBy(F.floor(F.col("importance") * BINS).cast("int").alias("bin")).agg(F.sum("in_all").alias("mass"))
    threshold = _between_modes({r.bin: r.mass for r in histogram.collect()})
    known = (F.col("in_all") >= KNOWN) & ((F.col("hosts") >= LEAST_HOSTS) | (F.col("pages") >= KNOWN))
    leaning = (F.col("pages") * F.col("own") + STOCK * F.col("importance")) / (F.col("pages") + STOCK)
    return own.join(merged, "group").where(known).select("host", "group", (leaning < threshold).alias("low"))


def nodes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host, kind, group, node, pages, all_pages, importance`` of every node of every site's tree, and ``groups`` over all sites.

    ``pages`` have the node's group, of ``all_pages`` of the host; a page with the group but without the node counts as
    one that differs. The importance is the greater entropy of presentation and content, 1 where all pages differ. It
    leans on the mean of the group over the hosts that have it on two or more pages, or if these are too few, on the share
    of the host's pages without the group: what few of many pages have is no proof. On more than one page it only rises
    by that. Null where neither is known.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, columns = [], ([], [], [], [], [], [])
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in page_rows(page.as_py(), host):
                    hosts.append(host)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int8(), *[pa.int64()] * 5)
            arrays = [pa.array(c, t) for c, t in zip((hosts, *columns), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "kind", "group", "node", "style", "content", "page"])

    schema = "host string, kind byte, group long, node long, style long, content long, page long"
    rows = written(pages.select("host", "html").mapInArrow(collect, schema).distinct(), "nodes")
    texts = written(_sums(rows, "content", "text"), "sums")
    styles = _sums(rows.where(F.col("kind") == ELEMENT), "style", "presentation").drop("found")
    on_pages = texts.where(F.col("kind") == GROUP).select("host", "group", F.col("found").alias("pages"))
    # The presentation of a text is its length.
    lengths = rows.where(F.col("kind") == TEXT).groupBy("host", "group", "node")
    weighed = written(lengths.agg(F.max("style").alias("weight"), F.count(F.lit(1)).alias("c")), "texts")
    verdicts = groups(weighed, on_pages)
    known = texts.join(on_pages, ["host", "group"]).join(styles, ["host", "kind", "group", "node"], "left")
    least = F.least("text", F.coalesce("presentation", "text"))
    own = F.when(F.col("pages") > 1, 1 - least / (F.col("pages") * F.log("pages")))
    known = written(known.select("host", "kind", "group", "node", "found", "pages", own.alias("own")), "entropies")
    elements = known.where((F.col("kind") == ELEMENT) & (F.col("pages") > 1))
    hosts = elements.groupBy("host", "group").agg((F.sum(F.col("own") * F.col("found")) / F.sum("found")).alias("own"))
    usual = hosts.groupBy("group").agg(F.avg("own").alias("usual"), F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= LEAST_HOSTS)
    sites = known.where((F.col("kind") == GROUP) & (F.col("group") == ROOT)).select("host", F.col("pages").alias("all_pages"))
    known = known.join(usual.drop("hosts"), "group", "left").join(sites, "host")
    other = F.coalesce("usual", F.when(F.col("all_pages") > 1, 1 - F.col("pages") / F.col("all_pages")))
    leaning = (F.col("pages") * F.col("own") + LEAN * other) / (F.col("pages") + LEAN)
    importance = F.when(F.col("pages") > 1, F.greatest("own", leaning)).otherwise(other)
    return known.select("host", "kind", "group", "node", "pages", "all_pages", importance.alias("importance")), verdicts


def _by_names(found: list[Block], marked: bool, varies: bool, sure: set[int]) -> list[Block]:
    """Without what is declared no article in groups that are not ``sure``, and without comments and asides. On a page that marks no
    article, names count for nothing if they hold all text or, of text known to vary from page to page, most of it."""
    some = [b for b in found if b.declared < TAGGED or (b.declared == TAGGED and b.group in sure)]
    left = [b for b in some if b.declared == OPEN or b.group in sure]
    most = varies and 2 * sum(len(b.text) for b in left) < sum(len(b.text) for b in some)
    return some if not marked and (most or not left) else left


def sorted_out(
    page: str | None, removed: set[int], unknown: set[int] | None = None, sure: set[int] = frozenset(), host: str = ""
) -> tuple[list[Block], list[Block], list[Block], list[Block]]:
    """The blocks of a page that are its main text, and those that go by the tree, by what they are declared to be, and for standing
    outside of the marked article.

    ``removed`` are nodes and groups. Groups that are ``sure`` go by the tree alone. Of groups that the tree does not know, ``unknown`` or
    all if that is None, only text in the marked article is kept, if there is one. If the site's tree leaves nothing, the declarations alone
    decide. What is never text, such as scripts and forms, is in none of the lists.
    """
    found = [b for b in blocks(page) if b.declared < NEVER]
    marked = bool(_MARKED.search(page or ""))
    varying = [b for b in found if not removed or not (b.group in removed or b.node in removed or b.own(host) in removed)]
    for some, varies, known in ((varying, unknown is not None and not unknown, sure), (found, False, frozenset())):
        named = _by_names(some, marked, varies, known)
        kept = named
        if any(b.main for b in kept):
            kept = [b for b in kept if b.main or b.group in known or not (unknown is None or b.group in unknown)]
        if kept:
            return kept, _without(found, some), _without(some, named), _without(named, kept)
    return [], _without(found, varying), varying, []


def _without(blocks: list[Block], others: list[Block]) -> list[Block]:
    there = {id(b) for b in others}
    return [b for b in blocks if id(b) not in there]


def main_text(
    page: str | None, removed: set[int], unknown: set[int] | None = None, sure: set[int] = frozenset(), host: str = ""
) -> str:
    """The main text of a page, by ``sorted_out``."""
    return "\n\n".join(b.text for b in sorted_out(page, removed, unknown, sure, host)[0])


def with_verdicts(pages: DataFrame, low: float, least_pages: int) -> DataFrame:
    """Adds what the trees say of a page's host: nodes and groups ``removed``, groups ``unknown`` and ``sure``."""
    tree, verdicts = nodes(pages)
    single = (F.col("kind") == GROUP) & (F.col("pages") == 1)
    enough = (F.col("kind") != GROUP) & (F.col("pages") > 1) & (F.col("all_pages") >= least_pages)
    repeated = (single | enough) & (F.col("importance") < low)
    lone = single & F.col("importance").isNull()
    said = tree.where(repeated | lone).select("host", F.when(repeated, F.col("node")).alias("removed"), F.when(lone, F.col("group")).alias("unknown"))
    sure = verdicts.select("host", F.when(F.col("low"), F.col("group")).alias("removed"), F.when(~F.col("low"), F.col("group")).alias("sure"))
    lists = said.unionByName(sure, allowMissingColumns=True).groupBy("host").agg(
        *(F.collect_set(name).alias(name) for name in ("removed", "unknown", "sure"))
    )
    return pages.join(written(lists, "removed"), "host", "left")


def extracted(
    pages: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty page has an empty text. A null url or one without a host belongs to the site with the empty
    name. Repeated rows are extracted each for itself; an empty table gives no rows. The nodes to remove are joined by
    host; Spark broadcasts them if their written size is small and else shuffles the pages, splitting a hot host.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html")
    ).withColumn("host", _host("url"))
    joined = with_verdicts(rows, low, least_pages).select("page_id", "url", "host", "html", "removed", "unknown", "sure")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[set(x or ()) for x in batch.column(k).to_pylist()] for k in (4, 5, 6)]
            given = zip(batch.column(3), *lists, batch.column(2).to_pylist(), strict=True)
            out = [main_text(page.as_py(), *rest) for page, *rest in given]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(np.fromiter(map(len, out), np.int64, len(out)))],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
