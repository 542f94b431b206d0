"""Main text of web pages by a site style tree and the meaning of elements.

Pages are parsed to trees by the rules of HTML that matter here: void elements, implied ends, raw text of
scripts and styles, unclosed and misnested tags. The trees of one host are merged into a site style tree:
a node is a path of tags and classes. Each of its elements counts, with its presentation (the tags beneath) and its
content (the text beneath). The importance of an element is the surprisal of both, -ln(share of the pages with that path
that have the same), to the base of the number of those pages: 0 where all pages agree and 1 where each has its own; the
entropy of a node is the mean of it over its elements. Elements that occur on `LEAST_PAGES` pages and `LEAST_SHARE` of
the pages with their path, with an importance below `THRESHOLD`, are removed from each page of the host, one by one:
others of the same path stay. Equal pages of a host count as one page (each as its part of one), and a page
that would be left without text keeps its branches. Counts combine before their shuffle, so a host with a third of all pages is no more than
a large count.

Beside that, elements that say what they are go: navigation, footers, forms, scripts, hidden elements,
and those whose class, id or role names a menu, an advert, a notice, comments and so on. Names in class and id don't
count on html, body, article and main, nor on what holds most of the page's text with every article and main in it. An article
or main element is added evidence: if what the style tree leaves in such elements is at least half as much text as
what it leaves outside, the text outside is left out. Within them the style tree removes blocks, but no inline elements.

Defined results: null or empty html gives the empty text; a null url belongs to the host ""; rows that repeat
a page_id each get their own result; other columns are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, tidied

LEAST_PAGES = 8
LEAST_SHARE = 0.5
THRESHOLD = 0.25
MAX_BROADCAST_PATHS = 1_000_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe title textarea xmp noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROP = frozenset("script style noscript template iframe object svg canvas audio video head title nav aside form footer button select textarea dialog menu datalist map".split())
_DROP_OUTSIDE = frozenset(["header"])
_TRUSTED = frozenset(["article", "main"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments disqus respond reply replies toolbar pagination pager "
    "widget copyright paywall skiplink alert banner commentlist masthead".split()
)
_WORDS_OUTSIDE = frozenset("header search legal topbar logo".split())
_NEVER_BY_NAME = frozenset(["html", "body", "article", "main"])
#: Kinds of noise: by tag, role or style; by tag outside of trusted elements; by name; by name outside of trusted elements.
_ALWAYS, _OUTSIDE, _NAMED, _NAMED_OUTSIDE = 1, 2, 3, 4
#: Closed by the start of one of the same set, up to the nearest element of the second set.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {t: re.compile(rf"</{t}\s*/?\s*>", re.I) for t in _RAW}
_MASK, _K = (1 << 64) - 1, 0x9E3779B97F4A7C15


class _Page:
    """Elements in page order, each with parent, path, whether it is left out or trusted, and its range of texts."""

    __slots__ = ("parent", "tag", "path", "out", "trusted", "begin", "end", "texts", "of", "breaks", "noise")

    def __init__(self):
        self.parent, self.tag, self.path, self.out, self.trusted = [-1], ["#"], [0], [False], [False]
        self.noise = [0]
        self.begin, self.end = [0], [0]
        #: Texts, the element each is in, and whether a block begins with it.
        self.texts, self.of, self.breaks = [], [], []


def _noise(tag: str, attributes: str) -> tuple[int, str]:
    """How an element says that it isn't main text (0: it doesn't), and its class and id for the path."""
    if tag in _DROP or tag in _DROP_OUTSIDE:
        return _ALWAYS if tag in _DROP else _OUTSIDE, ""
    if not attributes or attributes.isspace():
        return 0, ""
    found = {m[1].lower(): m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    label = f"{found.get('class', '')} {found.get('id', '')}".strip()
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDES.search(found.get("style", "")):
        return _ALWAYS, label
    if found.get("role", "").lower() in _ROLES:
        return _ALWAYS, label
    if tag in _NEVER_BY_NAME:
        return 0, label
    words = {w.lower() for w in _NAME.findall(label)}
    return _NAMED if words & _WORDS else _NAMED_OUTSIDE if words & _WORDS_OUTSIDE else 0, label


def _settle(page: _Page) -> None:
    """Sets out and trusted. A name alone doesn't make noise of the holder of most of a page's text, unless an article or main is elsewhere."""
    size, main = [0] * len(page.tag), [t in _TRUSTED for t in page.tag]
    hard = [False] * len(page.tag)
    for k in range(1, len(page.tag)):
        hard[k] = hard[page.parent[k]] or page.noise[k] == _ALWAYS
    for text, of in zip(page.texts, page.of):
        if not hard[of]:
            size[of] += sum(map(len, text.split()))
    mains = [int(m and not h) for m, h in zip(main, hard)]
    for k in range(len(page.tag) - 1, 0, -1):
        size[page.parent[k]] += size[k]
        mains[page.parent[k]] += mains[k]
    for k in range(1, len(page.tag)):
        up = page.parent[k]
        noise, trusted = page.noise[k], page.trusted[up]
        by_name = noise == _NAMED or noise == _NAMED_OUTSIDE and not trusted
        by_name = by_name and not (2 * size[k] > size[0] and mains[k] == mains[0])
        page.out[k] = page.out[up] or noise == _ALWAYS or noise == _OUTSIDE and not trusted or by_name
        page.trusted[k] = trusted or main[k] and not page.out[k]


def parse(html: str, paths: dict | None = None) -> _Page:
    page, paths = _Page(), {} if paths is None else paths
    open_, at, block = [0], 0, True
    if len(paths) > 200_000:
        paths.clear()

    def close(upto: int) -> None:
        while len(open_) > upto:
            page.end[open_.pop()] = len(page.texts)

    def close_sort(kinds: frozenset, stop: frozenset) -> None:
        for k in range(len(open_) - 1, 0, -1):
            t = page.tag[open_[k]]
            if t in kinds:
                close(k)
                if kinds <= {"p"} or "tr" not in kinds:
                    return
            elif t in stop:
                return

    def text(piece: str) -> None:
        nonlocal block
        if piece:
            page.texts.append(unescape(piece) if "&" in piece else piece)
            page.of.append(open_[-1])
            page.breaks.append(block)
            block = False

    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name not in _INLINE:
            block = True
        if closing:
            for k in range(len(open_) - 1, 0, -1):
                t = page.tag[open_[k]]
                if t == name:
                    close(k)
                    break
                if name in _INLINE and t not in _INLINE:
                    break
            continue
        if name not in _INLINE:
            if name in _CLOSES:
                close_sort(*_CLOSES[name])
            elif name != "br":
                close_sort(frozenset(["p"]), frozenset(["td", "th", "table", "button"]))
        up = open_[-1]
        noise, label = _noise(name, attributes)
        key = (page.path[up], name, label)
        path = paths.get(key)
        if path is None:
            path = paths[key] = xxhash.xxh64_intdigest(f"{key[0]}/{name} {label}") >> 1
        k = len(page.tag)
        page.parent.append(up)
        page.tag.append(name)
        page.path.append(path)
        page.out.append(False)
        page.trusted.append(False)
        page.noise.append(noise)
        page.begin.append(len(page.texts))
        page.end.append(len(page.texts))
        if name in _RAW:
            end = _ENDS[name].search(html, at)
            at = end.end() if end else n
        elif name not in _VOID and not attributes.endswith("/") or name not in _VOID and name in _TRUSTED:
            open_.append(k)
    close(0)
    _settle(page)
    return page


def main_text(page: _Page, low: frozenset = frozenset()) -> str:
    """The page's main text, without branches whose value is in low, unless that leaves nothing."""
    out = list(page.out)
    if low:
        values = _values(page)
        for k in range(1, len(out)):
            out[k] = out[k] or out[page.parent[k]] or values[k] in low
    blocks: list[list[str]] = []
    inside: list[bool] = []
    fresh = True
    for piece, of, begins in zip(page.texts, page.of, page.breaks):
        fresh = fresh or begins
        if out[of]:
            continue
        if fresh or inside[-1] != page.trusted[of]:
            blocks.append([])
            inside.append(page.trusted[of])
            fresh = False
        blocks[-1].append(piece)
    texts = ["".join(b).split() for b in blocks]
    size = [sum(len(w) for t, i in zip(texts, inside) if i == side for w in t) for side in (False, True)]
    only = size[True] > 0 and 2 * size[True] >= size[False]
    words = [w for t, i in zip(texts, inside) if i or not only for w in t]
    if words:
        return " ".join(words)
    return main_text(page) if low else ""


def _values(page: _Page) -> list[int]:
    """A hash of path, presentation and content of each element that repetition may remove, 0 of the others."""
    prefix, powers, worded = [0], [1], [0]
    for t in page.texts:
        words = " ".join(t.split())
        prefix.append((prefix[-1] * _K + (xxhash.xxh64_intdigest(words) | 1)) & _MASK if words else prefix[-1])
        powers.append(powers[-1] * _K & _MASK)
        worded.append(worded[-1] + bool(words))
    beneath: dict[int, int] = {}
    for k in range(len(page.tag) - 1, 0, -1):
        beneath[page.parent[k]] = (beneath.get(page.parent[k], 7) * _K + page.path[k]) & _MASK
    out = [0] * len(page.tag)
    for k in range(1, len(page.tag)):
        a, b = page.begin[k], page.end[k]
        if worded[a] == worded[b] or page.out[k] or page.trusted[k] and page.tag[k] in _INLINE or page.tag[k] in ("html", "body"):
            continue
        content = (prefix[b] - prefix[a] * powers[worded[b] - worded[a]]) & _MASK
        out[k] = xxhash.xxh64_intdigest(f"{page.path[k]} {beneath.get(k, 0)} {content}") >> 1 | 1
    return out


def _style_rows(batches):
    """host, path, value and on how many pages of the batch, copies as parts of one; value 0 counts the pages that have the path."""
    paths: dict = {}
    for batch in batches:
        counts: dict[tuple, float] = {}
        for host, html, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            page = parse(html.as_py() or "", paths)
            values = _values(page)
            for path, value in {(page.path[k], v) for k, v in enumerate(values) if v} | {(page.path[k], 0) for k, v in enumerate(values) if v}:
                key = (host, path, value)
                counts[key] = counts.get(key, 0) + 1 / copies
        columns = zip(*counts) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(counts.values(), pa.float64())], ["host", "path", "value", "n"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host (hashed), value, n_pages and importance of the elements of every host's style tree that repeat on least_pages pages."""
    rows = pages.select(F.xxhash64("host").alias("host"), "html", F.xxhash64("html", F.length("html")).alias("page"))
    same = cut(rows.groupBy("host", "page").agg(F.count("*").alias("copies")).where("copies > 1"))
    rows = rows.join(F.broadcast(same) if same.count() <= MAX_BROADCAST_PATHS else same, ["host", "page"], "left")
    rows = rows.select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    found = rows.mapInArrow(tidied(_style_rows), "host long, path long, value long, n double")
    counted = cut(found.groupBy("host", "path", "value").agg(F.sum("n").alias("n")).where(F.col("n") > least_pages - 0.5))
    whole = counted.where("value = 0").select("host", "path", F.col("n").alias("n_pages"))
    both = counted.where("value <> 0").join(whole, ["host", "path"])
    return both.select("host", "value", "n", "n_pages", (-F.ln(F.col("n") / F.col("n_pages")) / F.ln("n_pages")).alias("importance"))


def _texts(batches):
    paths: dict = {}
    for batch in batches:
        texts = []
        for html, low in zip(batch.column(2), batch.column(3)):
            page = parse(html.as_py() or "", paths)
            texts.append(main_text(page, frozenset(low.as_py() or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    low = style_tree(rows, least_pages).where((F.col("importance") < threshold) & (F.col("n") >= LEAST_SHARE * F.col("n_pages")))
    low = cut(low.groupBy("host").agg(F.collect_list("value").alias("low")))
    n = low.agg(F.sum(F.size("low") + 1)).first()[0] or 0
    rows = rows.withColumn("host", F.xxhash64("host"))
    rows = rows.join(F.broadcast(low) if n <= MAX_BROADCAST_PATHS else low, "host", "left")
    out = rows.select("page_id", "url", "html", "low").mapInArrow(tidied(_texts), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
