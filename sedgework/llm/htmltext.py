"""Main text of web pages: page structure first, then a suffix array over each host.

A page is cut into blocks with their places in the element tree.  Scripts, styles, navigation,
headers, footers, sidebars, forms, and elements whose class, id or role names them as adverts,
notices, menus or reader comments are left out with all that they hold.  If the page has an article
(else a main) element, the blocks within it are the main text, whole: text that authors share is
theirs, so repetition never removes it.

Pages without such an element are decided by their host.  Their blocks form a token stream; so do, on
each host that has such a page, the parts of its other pages: the text in their bounding element (which
protects) and what lies outside it, left-out elements included (which accuses).  Each suffix goes, by the
hash of its first RUN tokens, to a group of its host; a group sorts its suffixes
and takes those that agree in RUN tokens and stem from pages of at least STREAMS different streams, as
two pages alone may be near copies, whose common text is their own; runs that also occur in a bounding
element are text.
Tokens that such runs cover are boilerplate (of a block that is not covered whole, only stretches of
RUN tokens or more); the runs between them are kept.  A host has as many
groups as its number of pages asks for, so no task sorts more than a share of a large host, and a
frequent first token fills none.

Cases: null, empty or text-free html gives the empty text; cut pages, unclosed and stray tags are
read as browsers do for the elements concerned; pages of any length are read whole; pages without a
url form one host; copies of a page don't make its text boilerplate; repeated rows get a row each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import frugal, materialize, table

RUN, STREAMS, GROUP_PAGES = 8, 3, 5000

# Names of elements, classes and roles (fixed values).
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "title", "xmp", "noembed", "noframes"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "meter", "nobr", "output", "progress", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "toolbar"}
NOISE = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "nav", "aside", "header", "footer", "form"}

#: A tag; possessive, so that a place is tried once.  Where quotes never end, a tag ends at the next bracket.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")


def _noise(name: str, attrs: str) -> bool:
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            if any(p in NOISE for p in _NAME_PARTS.split(value)):
                return True
        elif key == "role" and value.strip() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
    return False


def _role_main(attrs: str) -> bool:
    return any(k.lower() == "role" and "".join(v).strip().lower() == "main" for k, *v in _ATTR.findall(attrs))


class _Open:
    """The open elements: name, whether left out, zone; with the places of each name and of the elements that bound a search."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int]] = []
        self.at: dict[str, list[int]] = {}
        self.bounds: list[int] = [-1]
        self.solid: list[int] = [-1]

    def push(self, name: str, left_out: bool, zone: int) -> None:
        k = len(self.stack)
        self.stack.append((name, left_out, zone))
        self.at.setdefault(name, []).append(k)
        if name in _BOUNDS:
            self.bounds.append(k)
        if name not in INLINE:
            self.solid.append(k)

    def cut(self, k: int) -> None:
        """Closes the k-th element and all within."""
        while len(self.stack) > k:
            name = self.stack.pop()[0]
            i = len(self.stack)
            for places in (self.at[name], self.bounds, self.solid):
                if places and places[-1] == i:
                    places.pop()

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)


def blocks(html: str, chrome: bool = False) -> list[tuple[str, int]]:
    """(text, zone) of each block in page order; zone 2: in an article, 1: in a main element, 0: elsewhere.
    With ``chrome`` also the blocks that are left out, as zone -1.

    Each place of the page is read once, and an element is found among the open ones by its name, so the time
    follows the page's length whatever its markup.
    """
    out: list[tuple[str, int]] = []
    open_ = _Open()
    gone, zone = False, 0
    parts: list[str] = []
    tag = _TAG

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, -1 if gone else zone))

    def close(k: int) -> None:
        nonlocal gone, zone
        flush()
        open_.cut(k)
        _, gone, zone = open_.stack[-1] if open_.stack else ("", False, 0)

    at = here = 0  # text since ``at`` is not yet taken
    while True:
        i = html.find("<", here)
        after = html[i + 1 : i + 2]
        if i >= 0 and not (after in ("!", "?", "/") or after.isalpha() and after.isascii()):
            here = i + 1  # a plain character
            continue
        m = None
        if i >= 0 and after in ("!", "?"):
            comment = html.startswith("<!--", i)
            k = html.find("-->" if comment else ">", i + 4 if comment else i)
            end = len(html) if k < 0 else k + (3 if comment else 1)
        elif i >= 0:
            m = tag.match(html, i)
            if m is None and (after != "/" or html[i + 2 : i + 3].isalpha()):
                if html.find(">", i) >= 0 and (bare := _BARE_TAG.match(html, i)):
                    m, tag = bare, _BARE_TAG
                elif html.find(">", i) < 0:
                    end = len(html)  # a tag that the page's end cuts is no text
                else:
                    here = i + 1
                    continue
            elif m is None:
                here = i + 1
                continue
            end = m.end() if m else end
        else:
            end = len(html)
        if not gone or chrome:
            piece = html[at : i if i >= 0 else len(html)]
            if piece:
                parts.append(piece)
        at = here = end
        if i < 0:
            break
        if m is None:
            continue
        name = m[2].lower()
        if m[1]:
            places = open_.at.get(name)
            if not places:
                continue
            k = places[-1]
            if name not in INLINE or open_.stack[k][1]:
                if name not in INLINE or k > open_.solid[-1]:
                    close(k)
            elif k > open_.solid[-1]:
                places.pop()  # formatting does not end what it doesn't hold
            continue
        if name == "br":
            parts.append(" ") if not gone or chrome else None
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            raw = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(html, at)
            at = here = raw.end() if raw else len(html)
            continue
        if name not in INLINE:
            flush()
            for ends, ended in ((CLOSES_P, ("p",)), (SELF_CLOSING, SELF_CLOSING.get(name, ()))):
                if name in ends and (k := open_.last(ended)) > open_.bounds[-1]:
                    close(k)
        if name in VOID:
            continue
        inner = max(zone, 2 if name == "article" else 1 if name == "main" or _role_main(m[3]) else 0)
        left_out = gone or (name in DROPPED and not (name == "header" and zone == 2)) or _noise(name, m[3])
        if left_out and not gone:
            flush()
        open_.push(name, left_out, inner)
        gone, zone = left_out, inner
    flush()
    return out


def main_blocks(html: str | None) -> tuple[list[str], bool]:
    """Blocks of the main text, and whether an element bounds it."""
    found = blocks(html or "")
    top = max((z for _, z in found), default=0)
    return [t for t, z in found if z == top], top > 0


def _parse(batches):
    for b in batches:
        text, loose = [], []
        for h in b.column(1):
            parts, bound = main_blocks(h.as_py())
            text.append("\n".join(parts) if bound or not parts else None)
            loose.append(None if bound or not parts else parts)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(loose, pa.list_(pa.string()))], names=["key", "text", "blocks"])


def _others(batches):
    """Of each page with a bounding element the blocks in it (main) and those outside it."""
    for b in batches:
        host, groups, main, whole, parts = [], [], [], [], []
        for h, g, html in zip(b.column("host"), b.column("groups"), b.column("html")):
            found = blocks(html.as_py() or "", chrome=True)
            top = max((z for _, z in found), default=0)
            page = xxhash.xxh64_intdigest(repr(found).encode("utf-8")) >> 1
            for inside in (True, False) if top > 0 else ():
                host.append(h.as_py())
                groups.append(g.as_py())
                main.append(inside)
                whole.append(page)
                parts.append([t for t, z in found if (z == top) == inside])
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(groups, pa.int64()), pa.array([None] * len(host), pa.int64()), pa.array(main, pa.bool_()), pa.array(whole, pa.int64()), pa.array(parts, pa.list_(pa.string()))], names=["host", "groups", "row", "main", "whole", "blocks"])


def _suffixes(batches):
    """Suffixes of each token stream by host and group: place and the hashes of their first RUN tokens.

    ``whole`` tells apart the pages that the parts of a page with a bounding element stem from.
    """
    for b in batches:
        cols = {k: [] for k in ("host", "grp", "row", "main", "stream", "places", "heads")}
        for host, groups, row, main, whole, parts in zip(*(b.column(c).to_pylist() for c in ("host", "groups", "row", "main", "whole", "blocks"))):
            tokens = np.array([xxhash.xxh64_intdigest(t.encode("utf-8")) for p in parts for t in p.split(" ")], np.uint64)
            n = len(tokens) - RUN + 1
            if n <= 0:
                continue
            stream = xxhash.xxh64_intdigest(tokens.tobytes()) >> 1 if whole is None else whole
            heads = np.lib.stride_tricks.sliding_window_view(tokens, RUN)
            grp = (H.grams(tokens, RUN) % np.uint64(groups)).astype(np.int64)
            for g in np.unique(grp).tolist():
                at = np.flatnonzero(grp == g)
                for k, v in zip(cols, (host, g, row, main, stream, at.astype("<i4").tobytes(), heads[at].astype("<u8").tobytes())):
                    cols[k].append(v)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols.values(), kinds)], names=list(cols))


def _repeated(rows: list[tuple]):
    """(row, place) of suffixes that agree in RUN tokens with those of STREAMS streams, their own among them, none in a main text."""
    places = [np.frombuffer(r[3], "<i4") for r in rows]
    size = [len(p) for p in places]
    heads = np.frombuffer(b"".join(r[4] for r in rows), "<u8").reshape(-1, RUN)
    row = np.repeat([-1 if r[0] is None else r[0] for r in rows], size)
    main, stream, place = np.repeat([r[1] for r in rows], size), np.repeat([r[2] for r in rows], size), np.concatenate(places)
    order = np.lexsort(heads.T[::-1])  # the suffix array
    s = heads[order]
    # common prefix of each suffix with the one before, in tokens
    common = np.append(0, np.logical_and.accumulate(s[1:] == s[:-1], axis=1).sum(axis=1))
    cls = np.cumsum(common < RUN) - 1
    n = int(cls[-1]) + 1
    # (class, stream) pairs, each once
    st = np.unique(stream, return_inverse=True)[1][order]
    pair = np.unique(cls * (st.max() + 1) + st)
    several = np.bincount(pair // (st.max() + 1), minlength=n) >= STREAMS
    several[cls[main[order]]] = False
    hit = order[several[cls] & (row[order] >= 0)]
    return row[hit], place[hit]


def _sort(batches):
    at, rows = None, []

    def out():
        r, p = _repeated(rows)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(p.astype(np.int32), pa.int32())], names=["row", "place"])

    for b in batches:
        for host, grp, *rest in zip(*(b.column(c).to_pylist() for c in ("host", "grp", "row", "main", "stream", "places", "heads"))):
            if (host, grp) != at:
                if rows:
                    yield out()
                at, rows = (host, grp), []
            rows.append(rest)
    if rows:
        yield out()


def _long_runs(covered: np.ndarray) -> np.ndarray:
    """``covered`` without stretches of less than RUN tokens, which reach in from a neighbouring block."""
    if covered.all() or not covered.any():
        return covered
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    out = np.zeros(len(covered), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        out[a:b] = b - a >= RUN
    return out


def _without(batches):
    for b in batches:
        text = []
        for parts, places in zip(b.column("blocks").to_pylist(), b.column("places").to_pylist()):
            size = sum(len(p.split(" ")) for p in parts)
            hit = np.zeros(size + 1, np.int64)
            for p in places or ():
                hit[p] += 1
                hit[p + RUN] -= 1
            covered = np.cumsum(hit[:-1]) > 0
            kept, i = [], 0
            for p in parts:
                t = p.split(" ")
                stay = ~_long_runs(covered[i : i + len(t)])
                kept.append(" ".join(w for w, s in zip(t, stay.tolist()) if s))
                i += len(t)
            text.append("\n".join(k for k in kept if k))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(text, pa.string())], names=["row", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_pages: int = GROUP_PAGES) -> DataFrame:
    """Per row: id, url, text and n_chars."""
    key = F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kind = f"struct<id:{pages.schema[id_col].dataType.simpleString()},url:string>"
    parsed = pages.select(key.alias("key"), F.col(html_col).alias("html")).mapInArrow(frugal(_parse), f"key {kind}, text string, blocks array<string>")
    parsed = materialize(parsed.withColumn("row", F.monotonically_increasing_id()), "html-parsed")
    host = lambda url: F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    hosts = parsed.groupBy(host("key.url").alias("host")).agg(F.ceil(F.count("*") / group_pages).cast("long").alias("groups"), F.count("blocks").alias("loose")).filter("loose > 0").drop("loose")
    # written, so that its size is known: a small one is broadcast and no page is shuffled for the join
    hosts = materialize(hosts, "html-hosts")
    loose = parsed.filter(F.col("blocks").isNotNull()).select("row", "key", "blocks", host("key.url").alias("host"))
    own = loose.join(hosts, "host").select("host", "groups", "row", F.lit(False).alias("main"), F.lit(None).cast("long").alias("whole"), "blocks")
    others = pages.select(host(F.col(url_col).cast("string")).alias("host"), F.col(html_col).alias("html")).join(hosts, "host").select("host", "groups", "html")
    others = others.mapInArrow(frugal(_others), "host string, groups long, row long, main boolean, whole long, blocks array<string>")
    packed = own.unionByName(others).mapInArrow(frugal(_suffixes), "host string, grp long, row long, main boolean, stream long, places binary, heads binary")
    repeated = packed.repartition("host", "grp").sortWithinPartitions("host", "grp").mapInArrow(frugal(_sort), "row long, place int")
    places = repeated.groupBy("row").agg(F.collect_list("place").alias("places"))
    cleaned = loose.join(places, "row", "left").select("row", "blocks", "places").mapInArrow(frugal(_without), "row long, text string")
    rest = loose.select("row", "key").join(cleaned, "row").select("key", "text")
    out = parsed.filter(F.col("blocks").isNull()).select("key", "text").unionByName(rest)
    return out.select(F.col("key.id").alias(id_col), F.col("key.url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
