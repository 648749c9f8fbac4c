"""Main text of web pages: page structure, and a suffix array over the pages of a host.

A page becomes blocks of text. Blocks in menus, headers, forms, adverts and the like go by their
markup; blocks inside the page's article stay. Where markup leaves it open (pages without an
article, or with less text in articles than outside) the host decides on every block: the pages'
token streams are joined, a suffix array finds long substrings that several distinct pages
share, and a block that such substrings cover is boilerplate; only unique runs stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import store
from gradewell.operators.skew import own_shuffle

#: A shared substring has at least LONG tokens and lies in at least PAGES distinct pages. A block
#: is boilerplate where shared substrings cover COVERED of its tokens.
LONG, PAGES, COVERED = 8, 3, 0.8
#: Pages of a host in one suffix array, about. Larger hosts are dealt over several shards, whose
#: runs of LONG tokens are counted together.
SHARD = 512
#: Large hosts are broadcast up to so many, and joined beyond.
BROADCAST_HOSTS = 100_000

#: Elements by their role in HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {
    "nav", "footer", "aside", "form", "head", "template", "svg", "math", "canvas", "object", "audio", "video",
    "button", "select", "dialog", "menu", "map", "datalist", "fieldset",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "br", "wbr", "img", "ruby", "rt", "rp", "rb", "rtc",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: Names in class and id attributes that mark text beside the article: alone, or as the last word
#: of a name ("site-footer").
MARKS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside",
    "widget", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "banner", "ad", "ads", "advert", "adverts",
    "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "disqus", "reply",
    "replies", "respond", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup",
    "login", "popup", "modal", "overlay", "toolbar", "pagination", "pager", "skip", "copyright", "disclaimer",
}
#: Words that may follow a mark in a name ("comment-list") without changing what it means.
PARTS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "group", "holder",
    "inner", "item", "items", "left", "line", "link", "links", "list", "main", "outer", "panel", "right", "row", "section",
    "slot", "small", "text", "thread", "title", "top", "unit", "wrap", "wrapper",
}
#: Words before a mark that tell of it rather than being it ("has-sidebar").
TELLS = {"has", "have", "with", "without", "no", "not", "is", "show", "hide", "before", "after", "below", "above", "under"}
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
    "table", "ul",
}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|\Z)""", re.I | re.S)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Kinds of text: beside the article for certain, or by a name only; outside and inside an
#: article or main element; and in an article that lies in something beside the article by a name.
GONE, NAMED, PLAIN, ARTICLE, MAIN, NAMED_ARTICLE = range(6)


def _is_mark(name: str, in_article: bool) -> bool:
    """Whether a name of a class or id attribute marks text beside the article. An article may have
    a header of its own."""
    words = _WORD.findall(name)
    if not words or words[0] in TELLS:
        return False
    marks = MARKS - {"header"} if in_article else MARKS
    while len(words) > 1 and words[-1] in PARTS and words[-2] in marks | PARTS:
        words.pop()
    return words[-1] in marks


def _beside(name: str, attributes: str, in_article: bool) -> int | None:
    """GONE or NAMED for an element that holds text beside the article, by its name and attributes."""
    if name in DROPPED or (name == "header" and not in_article):
        return GONE
    if not attributes or name in ("html", "body"):
        return None
    named = None
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            return GONE
        if key == "role" and value in ROLES:
            return GONE
        if key in ("class", "id") and name not in ("article", "main") and any(_is_mark(x, in_article) for x in value.split()):
            named = NAMED
    return named


def _inside(kind: int, name: str, attributes: str) -> int:
    """The kind of text inside an element that lies in text of ``kind``. An article inside another
    one is a reader's comment on it."""
    if kind == GONE or (kind == NAMED_ARTICLE and name in ("article", "main")):
        return kind
    if kind == NAMED:
        return GONE if _beside(name, attributes, False) == GONE else NAMED_ARTICLE if name in ("article", "main") else NAMED
    beside = _beside(name, attributes, kind in (ARTICLE, MAIN, NAMED_ARTICLE))
    if beside is not None:
        return GONE if kind in (ARTICLE, MAIN, NAMED_ARTICLE) else beside
    if name == "main":
        return MAIN if kind == PLAIN else kind
    if name == "article":
        return {PLAIN: ARTICLE, ARTICLE: GONE}.get(kind, kind)
    return kind


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order, without those beside the article by markup.
    Kind is ARTICLE for text that is the article's by markup, else PLAIN: then the host decides.
    White space inside a block is one space, character references are decoded. Unclosed elements
    end with their parents; a p ends where another block begins.

    A name of a class or id never costs the whole text: if all articles, or all blocks, lie in
    elements that only a name puts beside the article, the name does not count. Where articles
    (without a main element) hold less text than is outside them, they are teasers as well as
    they may be the text, and the host decides on all blocks.
    """
    out: list[tuple[int, str]] = []
    held: list[str] = []
    open_: list[tuple[str, int]] = []  # element, kind inside it
    kind, at, end = PLAIN, 0, len(page or "")

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text and kind != GONE:
                out.append((kind, text))
            held.clear()

    while at < end:
        found = _TAG.search(page, at)
        if found is None:
            if kind != GONE:
                held.append(page[at:])
            break
        if kind != GONE and found.start() > at:
            held.append(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        block = name not in INLINE
        if name == "br" and kind != GONE:
            held.append(" ")
        if block:
            flush()
        if found[1]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if open_[k][1] != kind or block:
                        flush()
                    del open_[k:]
                    break
                if not block and open_[k][0] not in INLINE:
                    break
            after = open_[-1][1] if open_ else PLAIN
            if after != kind:
                flush()
            kind = after
            continue
        if name in VOID or found[3].endswith("/") and name not in RAW and name not in DROPPED and not block:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in ENDS_P:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == "p":
                    del open_[k:]
                    break
                if open_[k][0] not in INLINE:
                    break
            kind = open_[-1][1] if open_ else PLAIN
        inside = kind
        if kind != GONE:
            inside = _inside(kind, name, found[3])
        if inside != kind:
            flush()
            kind = inside
        open_.append((name, inside))
    flush()
    return _settled(out)


def _settled(blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks that markup leaves, as ARTICLE or PLAIN."""
    kinds = {kind for kind, _ in blocks}
    if MAIN in kinds:
        return [(ARTICLE if kind == MAIN else PLAIN, text) for kind, text in blocks if kind in (MAIN, ARTICLE, PLAIN)]
    if ARTICLE in kinds:
        inside = sum(len(text) for kind, text in blocks if kind == ARTICLE)
        outside = sum(len(text) for kind, text in blocks if kind == PLAIN)
        sure = ARTICLE if inside >= outside else PLAIN
        return [(sure if kind == ARTICLE else PLAIN, text) for kind, text in blocks if kind in (ARTICLE, PLAIN)]
    if NAMED_ARTICLE in kinds:
        return [(ARTICLE if kind == NAMED_ARTICLE else PLAIN, text) for kind, text in blocks if kind in (NAMED_ARTICLE, PLAIN)]
    return [(PLAIN, text) for kind, text in blocks if kind == (PLAIN if PLAIN in kinds else NAMED)]


def shared_tokens(pages: list[list[int]], long: int = LONG, least: int = PAGES) -> list[np.ndarray]:
    """For each page's tokens, whether each lies in a substring of at least ``long`` tokens that
    at least ``least`` distinct pages have.

    The pages are joined, with a separator of its own behind each. Suffixes are sorted by their
    first ``long`` tokens, by doubling the sorted length; equal neighbours share a substring, and
    longer shared substrings are runs of such ones."""
    lengths = np.fromiter(map(len, pages), dtype=np.int64, count=len(pages))
    if not lengths.sum():
        return [np.zeros(n, dtype=bool) for n in lengths]
    joined = np.concatenate([np.append(np.asarray(p, dtype=np.int64), -1 - k) for k, p in enumerate(pages)])
    page = np.repeat(np.arange(len(pages)), lengths + 1)
    _, rank = np.unique(joined, return_inverse=True)
    sorted_to = 1
    while sorted_to < long:
        step = min(sorted_to, long - sorted_to)
        later = np.zeros(len(rank), dtype=np.int64)
        later[:-step] = rank[step:] + 1
        _, rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)
        sorted_to += step
    suffixes = np.argsort(rank, kind="stable")  # within equal ranks by place, so by page
    ordered, owner = rank[suffixes], page[suffixes]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    other = np.concatenate(([True], owner[1:] != owner[:-1])) | fresh
    group = np.cumsum(fresh) - 1
    distinct = np.bincount(group, weights=other)
    starts = suffixes[distinct[group] >= least]
    marks = np.zeros(len(joined) + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + long, len(joined)), -1)
    covered = np.cumsum(marks[:-1]) > 0
    ends = np.cumsum(lengths + 1)
    return [covered[e - n - 1 : e - 1] for e, n in zip(ends, lengths, strict=True)]


def run_hashes(streams: list[list[str]], long: int = LONG) -> list[np.ndarray]:
    """For each page's words, a 64-bit hash of each run of ``long`` words, the same in every shard."""
    known: dict[str, int] = {}

    def code(word: str) -> int:
        if word not in known:
            known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return known[word]

    out = []
    for words in streams:
        codes = np.fromiter(map(code, words), dtype=np.uint64, count=len(words))
        n = max(0, len(words) - long + 1)
        hashes = np.zeros(n, dtype=np.uint64)
        for k in range(long if n else 0):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        out.append(hashes.view(np.int64))
    return out


def known_tokens(streams: list[list[str]], shared: np.ndarray, long: int = LONG) -> list[np.ndarray]:
    """For each page's words, whether each lies in a run whose hash is one of ``shared``."""
    out = []
    for words, hashes in zip(streams, run_hashes(streams, long), strict=True):
        marks = np.zeros(len(words) + 1, dtype=np.int64)
        starts = np.flatnonzero(np.isin(hashes, shared))
        marks[starts] += 1
        marks[starts + long] -= 1
        out.append(np.cumsum(marks[:-1]) > 0)
    return out


def is_open(blocks: list[tuple[int, str]]) -> bool:
    """Whether the host decides on the page: it has text, and no article."""
    return bool(blocks) and all(kind != ARTICLE for kind, _ in blocks)


def page_words(blocks: list[tuple[int, str]]) -> list[str]:
    return [word for _, text in blocks for word in text.split()]


def main_texts(pages: list[list[tuple[int, str]]], shared: np.ndarray | None = None) -> list[str]:
    """The main text of each of a host's pages, from their blocks. Of a shard of a host, with the
    hashes of the runs that the whole host shares."""
    if shared is None:
        words: dict[str, int] = {}
        covered = shared_tokens([[words.setdefault(w, len(words)) for w in page_words(blocks)] for blocks in pages])
    else:
        covered = known_tokens([page_words(blocks) if is_open(blocks) else [] for blocks in pages], shared)
    out = []
    for blocks, marks in zip(pages, covered, strict=True):
        decided, kept, at = is_open(blocks), [], 0
        for kind, text in blocks:
            n = len(text.split())
            own = marks[at : at + n]
            at += n
            if kind == ARTICLE or decided and own.mean() < COVERED:
                kept.append(text)
        out.append("\n\n".join(kept))
    return out


def shared_runs(rows: DataFrame) -> DataFrame:
    """(host, part, hash): for each shard of ``rows`` (host, part, html), the runs of LONG tokens that
    at least PAGES pages of the whole host have, as far as the shard's pages without an article have
    them. Only hosts with such pages are counted, but all their pages are."""

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hosts = {h for h, x in zip(frame["host"], frame["html"], strict=True) if is_open(page_blocks(x))}
            yield pd.DataFrame({"host": sorted(hosts)}, dtype="object")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        pages = [page_blocks(x) for x in frame["html"]]
        found = [np.unique(x) for x in run_hashes([page_words(blocks) for blocks in pages])]
        asked = [x for x, blocks in zip(found, pages, strict=True) if is_open(blocks)]
        hashes, counts = np.unique(np.concatenate(found), return_counts=True)
        needed = np.isin(hashes, np.concatenate(asked)) if asked else np.zeros(len(hashes), dtype=bool)
        return pd.DataFrame({"host": frame["host"].iloc[0], "part": frame["part"].iloc[0], "hash": hashes, "pages": counts, "needed": needed})

    hosts = store(rows.select("host", "html").mapInPandas(opened, "host string").distinct(), "hosts")
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else own_shuffle(hosts, "host")
    rows = rows.join(side, "host", "left_semi").select("host", "part", "html")
    runs = rows.groupBy("host", "part").applyInPandas(count, "host string, part int, hash long, pages long, needed boolean")
    runs = store(runs, "runs")
    shared = runs.groupBy("host", "hash").agg(F.sum("pages").alias("pages"), F.max("needed").alias("needed"))
    shared = shared.filter(f"pages >= {PAGES} and needed").select("host", "hash")
    return store(runs.filter("needed").join(own_shuffle(shared, "hash"), ["host", "hash"], "left_semi").select("host", "part", "hash"), "shared")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard: int = SHARD) -> DataFrame:
    """One row per page: id_col, url, text, n_chars (code points of text).

    Blocks by markup as in ``page_blocks``; the blocks of a page with an article are those inside
    it, others are kept unless substrings that the host's pages share cover them. A host of up to
    ``shard`` pages is one suffix array. Larger ones are dealt by a hash of the page over several
    shards, so a hot host is many small groups; their runs of LONG tokens are counted over all
    shards by hash (``shared_runs``), so the decision is the whole host's too. Blocks are joined by an empty line in page order; nothing is capped.

    Null and empty pages, and pages without text, have the empty text. Rows that repeat are
    extracted each and count as distinct pages. Pages without host share the empty host. An empty
    table gives an empty table.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    large = rows.groupBy("host").agg(F.ceil(F.count("*") / shard).alias("parts")).filter("parts > 1")
    large = store(large, "hosts")
    some = large.count()
    side = F.broadcast(large) if some <= BROADCAST_HOSTS else own_shuffle(large, "host")
    rows = rows.join(side, "host", "left")
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int")
    rows = rows.select("page_id", "url", "html", "host", part.alias("part"), F.col("parts").isNotNull().alias("dealt"))

    def texts_of(frame: pd.DataFrame, shared: np.ndarray | None) -> pd.DataFrame:
        texts = main_texts([page_blocks(x) for x in frame["html"]], shared)
        return pd.DataFrame({"page_id": frame["page_id"].array, "url": frame["url"], "text": texts, "n_chars": [*map(len, texts)]})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return texts_of(frame, None)

    def run_shard(frame: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        return texts_of(frame, shared["hash"].to_numpy(dtype=np.int64))

    made = "page_id long, url string, text string, n_chars long"
    found = rows.filter("not dealt").drop("dealt").groupBy("host", "part").applyInPandas(run, made)
    if some:
        dealt = rows.filter("dealt").drop("dealt")
        runs = shared_runs(dealt.select("host", "part", "html"))
        pair = dealt.groupBy("host", "part").cogroup(runs.groupBy("host", "part"))
        found = found.union(pair.applyInPandas(run_shard, made))
    return found.select(F.col("page_id").alias(id_col), "url", "text", "n_chars")
