"""Main text of HTML pages with site templates removed.

Each page is parsed once: its furniture by kind (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, reader comments) goes, and what is left of the article becomes one string, kept as a
table with the hash and the place in it of each element subtree.  Spark counts, for each host and
subtree, the different surroundings in which the subtree stands; those recurring on many of the host's
pages are its template and are cut out of the kept strings, inside the article as well.

Surroundings are sketched by the least hashes of the page's other blocks, so copies of a page, and all
but a few of its near-copies, count once: an article published many times is no template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, stage, texts

#: A subtree is template if it stands in at least so many surroundings and as many as this share of the host's different pages.
MIN_PAGES, MIN_SHARE = 5, 0.5
#: Least hashes that sketch what surrounds a subtree.
SEEDS = 4
#: Cuts of up to so many pages are broadcast; more are joined.
BROADCAST_ROWS = 50_000

# All patterns only move forwards.  A quote opens a value right after "=" and is an ordinary sign elsewhere.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_ATTR = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[\s\-_]+")
_PRIME, _BASE = (1 << 61) - 1, 0x9E3779B97F4A7C15 % ((1 << 61) - 1)

# Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form button select option optgroup datalist input script style noscript template iframe svg canvas object embed audio video map head title dialog menu menuitem textarea fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar status".split())
#: Words in a class or id that mark furniture, those that an article's own parts may have as well, and those that only mark headers.
MARKS = frozenset(
    "ad ads adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo sidebar nav navbar navigation breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing social comments commentlist replies disqus toolbar pagination pager skip".split())
WEAK_MARKS = frozenset("promotion banner menu notice notices notification alert overlay related recommended comment widget widgets".split())
HEADER_MARKS = frozenset("header masthead topbar".split())
#: Inside the main content a weak mark counts only where at least this share of the text stands in links; an element is the
#: main content if at least this share of the page's text outside links stands in its kind.
LINKED, MOST_TEXT = 0.5, 0.5


def host_of(url: str | None) -> str:
    """Host of an address in lower case, without user and port; '' if there is none."""
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


class Page:
    """Elements ``[tag, attributes, parent, first token, token after]`` of a page in page order, and its
    text and breaks as ``(element, token, text)``; a break has the text None.  Unclosed and misnested
    tags are closed as browsers commonly do; a tag without an end takes the rest of the page."""

    def __init__(self, page: str):
        self.elements: list[list] = []
        self.pieces: list[tuple[int, int, str | None]] = []
        self.stack: list[int] = []
        self.open: Counter = Counter()
        self.prefix = [0]  # rolling hash of the tokens so far
        self._read(page)
        self._close(0)
        self._powers = [1]

    def _token(self, text: str) -> None:
        self.prefix.append((self.prefix[-1] * _BASE + xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7)) % _PRIME)

    def _text(self, text: str) -> None:
        self._token(text)
        self.pieces.append((self.stack[-1] if self.stack else -1, len(self.prefix) - 1, text))

    def _break(self, element: int) -> None:
        self.pieces.append((element, len(self.prefix) - 1, None))

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.elements[self.stack.pop()]
            self.open[e[0]] -= 1
            e[4] = len(self.prefix)
            if e[0] not in INLINE:
                self._break(e[2])

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            low = page.find("<", at)
            following = page[low + 1 : low + 2] if low >= 0 else ""
            while low >= 0 and not (following.isascii() and following.isalpha() or following in ("!", "?", "/")):  # a sign of the text
                low = page.find("<", low + 1)
                following = page[low + 1 : low + 2] if low >= 0 else ""
            if low != at:
                self._text(page[at : low if low >= 0 else n])
            if low < 0:
                return
            m = (_COMMENT if page.startswith("<!--", low) else _TAG).match(page, low)
            if m is None:  # a declaration, or a tag without an end
                end = page.find(">", low)
                if end < 0 or following not in "!?/" or following == "/" and page[low + 2 : low + 3].isalpha() and page[low + 2].isascii():
                    return
                at = end + 1
                continue
            at = m.end()
            if m.re is _TAG:
                at = self._end(m[2].lower(), at) if m[1] else self._start(m[2].lower(), m[3], page, at)

    def _end(self, tag: str, at: int) -> int:
        if tag == "br":
            self._break(self.stack[-1] if self.stack else -1)
        if tag in VOID or not self.open[tag]:
            return at
        depth = len(self.stack) - 1
        while self.elements[self.stack[depth]][0] != tag:
            if tag in INLINE and self.elements[self.stack[depth]][0] not in INLINE:
                return at  # an inline end tag doesn't close blocks around it
            depth -= 1
        self._token("/")
        self._close(depth)
        return at

    def _start(self, tag: str, raw: str, page: str, at: int) -> int:
        if tag in CLOSES_P and self.open["p"]:
            for depth in range(len(self.stack) - 1, -1, -1):
                t = self.elements[self.stack[depth]][0]
                if t == "p":
                    self._close(depth)
                    break
                if t not in INLINE:
                    break
        elif tag in SIBLINGS and any(self.open[t] for t in SIBLINGS[tag][0]):
            same, scope = SIBLINGS[tag]
            low = None
            for depth in range(len(self.stack) - 1, -1, -1):
                t = self.elements[self.stack[depth]][0]
                if t in same:
                    low = depth
                if t in scope or t in same:
                    break
            if low is not None:
                self._close(low)
        parent = self.stack[-1] if self.stack else -1
        if tag not in INLINE:
            self._break(parent)
        first = len(self.prefix) - 1
        self._token(f"{tag} {raw}")
        self.elements.append([tag, _attributes(raw), parent, first, first + 2])
        if tag in VOID or raw.endswith("/") and tag in ("svg", "path"):
            return at
        self.stack.append(len(self.elements) - 1)
        self.open[tag] += 1
        if tag in RAW:  # up to its own end tag, whatever stands between
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            self._text(page[at : end.start() if end else len(page)])
            at = page.find(">", end.end()) + 1 if end else 0
            self._close(len(self.stack) - 1)
            return at or len(page)
        return at

    def subtree(self, e: list) -> int:
        """Hash of an element's tokens, from its start tag to its end."""
        n = e[4] - 1 - e[3]
        while len(self._powers) <= n:
            self._powers.append(self._powers[-1] * _BASE % _PRIME)
        return (self.prefix[e[4] - 1] - self.prefix[e[3]] * self._powers[n]) % _PRIME


def kind(tag: str, attributes: dict[str, str]) -> str:
    """``drop`` for furniture, ``weak`` for what is furniture unless it is part of an article, ``header`` for headers, else ''."""
    if tag in FURNITURE:
        return "drop"
    if tag == "header":
        return "header"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return "drop"
    if tag in HEADINGS:
        return ""
    if attributes.get("role", "").lower() in ROLES:
        return "drop"
    words = set(_PART.split(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    if words & MARKS and "free" not in words:  # "ad-free" is no advert
        return "drop"
    if words & WEAK_MARKS:
        return "weak"
    return "header" if words & HEADER_MARKS and tag != "article" else ""


def _masses(page: Page, state: list[str]) -> tuple[list[int], list[int]]:
    """For each element the length of the text right in it, and of that in links; furniture counts for nothing."""
    linked = [False] * len(page.elements)
    for i, (tag, _, parent, _, _) in enumerate(page.elements):
        linked[i] = tag == "a" or parent >= 0 and linked[parent]
    text, links = [0] * len(linked), [0] * len(linked)
    for element, _, piece in page.pieces:
        if piece and element >= 0 and state[element] != "drop":
            n = len(piece.strip())
            text[element] += n
            links[element] += n if linked[element] else 0
    return text, links


def _states(page: Page) -> tuple[list[str], list[bool], str]:
    """Each element's kind with its ancestors' (``drop``, ``header`` or ''), whether it lies in the
    main content or holds it, and the main content's tag: the articles, else the main elements, where they hold
    most of the text outside links, whatever else there is."""
    elements = page.elements
    own = [kind(tag, attributes) for tag, attributes, _, _, _ in elements]

    def spread(kinds: list[str]) -> list[str]:
        state: list[str] = []
        for k, (_, _, parent, _, _) in zip(kinds, elements, strict=True):
            above = state[parent] if parent >= 0 else ""
            state.append("drop" if "drop" in (k, above) else "header" if "header" in (k, above) else "")
        return state

    state, strict = spread(own), spread(["drop" if k == "weak" else k for k in own])
    text, links = _masses(page, state)
    region, inside = "", [False] * len(elements)
    for tag in ("article", "main"):
        hit = [(e[0] == tag or tag == "main" and e[1].get("role") == "main") and s == "" for e, s in zip(elements, state, strict=True)]
        within = [False] * len(elements)
        for i, e in enumerate(elements):
            within[i] = hit[i] or e[2] >= 0 and within[e[2]]
        plain = [(t - l, w) for t, l, w, s in zip(text, links, within, strict, strict=True) if w or s != "drop"]
        if any(hit) and sum(n for n, w in plain if w) >= MOST_TEXT * sum(n for n, _ in plain):
            region, inside = tag, within
            break
    for i in range(len(elements) - 1, -1, -1):  # parents stand before their children
        if (parent := elements[i][2]) >= 0:
            text[parent] += text[i]
            links[parent] += links[i]
    for i, k in enumerate(own):
        if k == "weak" and (not inside[i] or links[i] >= LINKED * text[i]):
            own[i] = "drop"
    return spread(own), inside, region


def article(page: str) -> tuple[str, list[tuple[int, int, int]]]:
    """What is left of a page without its furniture, as one string with spaces between blocks, and each
    subtree in it that may be template: ``(hash, from, to)``, the first of equal ones of a page."""
    parsed = Page(page)
    elements = parsed.elements
    state, inside, region = _states(parsed)
    heading = [False] * len(elements)
    for i, e in enumerate(elements):
        heading[i] = e[0] in HEADINGS or e[2] >= 0 and heading[e[2]]
    out: list[str] = []
    starts: list[int] = []  # by piece kept: its token and place
    tokens: list[int] = []
    at = 0
    for element, token, text in parsed.pieces:
        if text is None:
            out.append(" ")
        elif (not region if element < 0 else state[element] != "drop" and (inside[element] or not region)):
            # of a header in the article its headings stay
            if element >= 0 and state[element] == "header" and not (inside[element] and heading[element]):
                continue
            text = entities.unescape(text) if "&" in text else text
            if not text.isspace():
                tokens.append(token)
                starts.append(at)
            out.append(text)
        else:
            continue
        at += len(out[-1])
    found: dict[int, tuple[int, int, int]] = {}
    ends = [*starts[1:], at]
    where = np.array(tokens, dtype=np.int64)
    for i, e in enumerate(elements):
        if e[0] not in INLINE and e[0] not in WHOLE and e[0] not in VOID and state[i] != "drop":
            lo, hi = np.searchsorted(where, (e[3], e[4]))
            if lo < hi:
                key = parsed.subtree(e)
                if key not in found:
                    found[key] = (key, starts[lo], ends[hi - 1])
    return "".join(out), list(found.values())


def cut(body: str, ranges: list[tuple[int, int]]) -> str:
    """``body`` without ``ranges``, white space runs one space."""
    if ranges:
        parts, at = [], 0
        for lo, hi in sorted(ranges):
            if lo > at:
                parts.append(body[at:lo])
            at = max(at, hi)
        body = " ".join([*parts, body[at:]])
    return _SPACE.sub(" ", body).strip()


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text: character references decoded, template subtrees cut, white space runs one space."""
    if not page:
        return ""
    body, subtrees = article(page)
    return cut(body, [(lo, hi) for key, lo, hi in subtrees if key in template])


def surroundings(body: str, subtrees: list[tuple[int, int, int]]) -> list[int]:
    """For each subtree a sketch of the page's other text: the least hashes, under SEEDS seeds, of the
    stretches between the places where subtrees begin and end."""
    if not subtrees:
        return []
    edges = np.unique([0, len(body), *(x for s in subtrees for x in s[1:])]).tolist()
    parts = [_SPACE.sub(" ", body[a:b]).strip() for a, b in zip(edges, edges[1:], strict=False)]
    top = (1 << 64) - 1
    hashes = np.array([[xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), seed) if p else top for p in parts] for seed in range(SEEDS)], dtype=np.uint64).reshape(SEEDS, len(parts))
    edge = np.full((SEEDS, 1), top, dtype=np.uint64)
    before = np.concatenate([edge, np.minimum.accumulate(hashes, axis=1)], axis=1)
    after = np.concatenate([np.minimum.accumulate(hashes[:, ::-1], axis=1)[:, ::-1], edge], axis=1)
    lo, hi = np.searchsorted(edges, [s[1] for s in subtrees]), np.searchsorted(edges, [s[2] for s in subtrees])
    least = np.minimum(before[:, lo], after[:, hi])
    return [xxhash.xxh64_intdigest(np.ascontiguousarray(least[:, k]).tobytes()) - (1 << 63) for k in range(len(subtrees))]


_PARSED = "uid long, row_id long, url string, host string, body string, page long, subtrees array<struct<hash:long,lo:int,hi:int,around:long>>"


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A staged table of pages without furniture: a number of the row, identifier, address, host, text, the
    text's hash, and its subtrees with their places and surroundings."""
    kind_of = pa.list_(pa.struct([("hash", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("around", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for url, page in zip(batch.column("url").to_pylist(), texts(batch, "html"), strict=True):
                body, subtrees = article(page)
                rows = [{"hash": s[0], "lo": s[1], "hi": s[2], "around": a} for s, a in zip(subtrees, surroundings(body, subtrees), strict=True)]
                for col, x in zip(cols, (host_of(url), body, xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63), rows), strict=True):
                    col.append(x)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(uid, uid + n), pa.int64()), batch.column("row_id"), batch.column("url"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], kind_of)],
                names=["uid", "row_id", "url", "host", "body", "page", "subtrees"])
            uid += n

    rows = limit_batches(pages).select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return stage(rows.mapInArrow(run, _PARSED), "parsed-pages")


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, hash`` of subtrees that stand in at least ``min_pages`` different surroundings, and in as many
    as ``min_share`` of the different pages of their host."""
    stands = parsed.select("host", F.explode("subtrees").alias("s")).select("host", "s.hash", "s.around")
    counts = stands.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    pages = parsed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(pages, "host").where(F.col("n") >= F.col("pages") * min_share).select("host", "hash")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``<id_col>, url, text, n_chars`` for every page.

    Null and empty pages have the empty text; a null address is its own host ''.  A page most of whose
    text outside links isn't in articles or main elements gives its body without furniture and templates.  Repeated rows and
    null identifiers pass through (copies of a page count once for templates); other columns are
    ignored; very long pages take time in proportion; an empty table gives an empty result.
    """
    parsed = parsed_pages(pages, id_col, url_col, html_col)
    found = stage(templates(parsed, min_pages, min_share), "templates")
    stands = parsed.select("uid", "host", F.explode("subtrees").alias("s")).select("uid", "host", "s.hash", F.struct("s.lo", "s.hi").alias("range"))
    # Spark itself broadcasts the templates where they are small, and deals skewed hosts out where not
    cuts = stage(stands.join(found, ["host", "hash"]).groupBy("uid").agg(F.collect_list("range").alias("ranges")), "cuts")
    small = cuts.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = parsed.select("uid", "row_id", "url", "body").join(F.broadcast(cuts) if small else cuts, "uid", "left").select("row_id", "url", "body", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cut(body, [(r["lo"], r["hi"]) for r in ranges or ()]) for body, ranges in zip(batch.column("body").to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["row_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "row_id long, url string, text string, n_chars long").withColumnRenamed("row_id", id_col)
