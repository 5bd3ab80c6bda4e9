"""Main text of web pages, with the templates of their sites removed.

A small reader turns the markup into elements, tolerating what is not closed. Site templates
are found by counting: every element gets a hash from its tag, attributes and children,
bottom up, and Spark counts on how many different pages of a host each hash occurs. Subtrees
are deleted that recur on at least ``share`` of a host's pages, and on ``few`` pages, or that
lie outside an article on ``many`` pages, however many the host has. Articles may quote each
other: running text inside an article (paragraphs, headings, list items and the like) is
deleted only if it recurs in different articles on at least ``notice`` of the host's pages,
and only on pages whose article keeps more text than it loses. In addition, elements that are
never article text are left out by their kind, class, id or role; where a page marks its
article, only that is kept.

The templates of all hosts are one table of 64-bit hashes of (host, subtree), saved in the
shared folder and mapped by workers, so pages join nothing and no host has a list.

Defined results: a null or empty page has no text; a page without an article or main
element gives all that is left of it; pages of equal content count once; pages without a host
share no templates. Unknown references stay as written. Other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafclock.llm.common import over_batches, pair
from leafclock.llm.tables import Table, part_bits, reader, saved
from leafclock.llm.url_filter import host_and_path
from leafclock.sources.scratch import staged

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img br nobr ruby rb rt rp".split())
#: Running text: blocks that hold prose.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead table caption figcaption ul ol dl".split())
#: Never article text.
DROPPED = RAW | frozenset(
    "head nav footer aside form button select option optgroup datalist dialog menu template svg math object audio video canvas "
    "embed input applet map".split())
#: Parts of class and id names, and roles, of what is not article text.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets "
    "related recommended trending share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer comment comments "
    "commentlist disqus respond replies reply pagination pager toolbar masthead search skip skiplink copyright".split())
#: Of these, what an article or main element may not have: readers write it.
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: Of these, what running text inside an article may have.
MODEST = frozenset("alert menu navigation related recommended search share sharing social trending".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
MAIN = frozenset(("article", "main"))
#: An opening tag of these closes an open one of the sets.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
_SCOPES = frozenset("ul ol dl table div article section main body aside nav form".split())


def pair_of(h: int) -> int:
    """Another hash for each hash."""
    return xxhash.xxh3_64_intdigest(h.to_bytes(8, "little"))


class Page:
    """Elements (tag, parent, start, end, attributes) and texts (element, start, end) of a page."""

    def __init__(self, source: str):
        self.source = source
        self.elements: list[list] = [["", -1, 0, len(source), ""]]
        self.texts: list[tuple[int, int, int]] = []
        stack, at, i = [0], 0, 0
        places: dict[str, list[int]] = {}  # of the open elements of each tag, in the stack

        def close(n: int, end: int) -> None:
            while len(stack) > n:
                element = self.elements[stack.pop()]
                element[3] = end
                if element[0]:
                    places[element[0]].pop()

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def close_open(tags, end: int, scopes) -> None:
            k = last(tags)
            if k and k >= last(scopes):
                close(k, end)

        while m := _MARKUP.search(source, i):
            start, i = m.span()
            if start > at:
                self.texts.append((stack[-1], at, start))
            at = i
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if depth := last((tag,)):
                    close(depth, i)
                continue
            if tag not in INLINE and tag not in VOID and tag not in RAW or tag == "hr":
                close_open({"p"}, start, _SCOPES)
            if tag in CLOSES:
                close_open(CLOSES[tag], start, _SCOPES)
            attributes = m[3] or m[6] or ""
            self.elements.append([tag, stack[-1], start, i, attributes])
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, i)
                i = at = end.end() if end else len(source)
                self.elements[-1][3] = i
            else:
                places.setdefault(tag, []).append(len(stack))
                stack.append(len(self.elements) - 1)
        if at < len(source):
            self.texts.append((stack[-1], at, len(source)))
        close(0, len(source))

    def attributes(self, i: int) -> list[tuple[str, str]]:
        return [(name.lower(), a or b or c) for name, a, b, c in _ATTRIBUTE.findall(self.elements[i][4])]

    def unwanted(self, i: int, inside: bool) -> bool:
        tag = self.elements[i][0]
        if tag in DROPPED:
            return True
        if not self.elements[i][4] or tag in ("html", "body"):
            return False
        hints = COMMENTS if tag in MAIN else HINTS - MODEST if inside and tag in PROSE else HINTS
        for name, value in self.attributes(i):
            value = value.lower()
            if name in ("class", "id") and hints.intersection(re.split(r"[^a-z0-9]+", value)):
                return True
            if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
        return False

    def states(self) -> tuple[list[bool], list[bool]]:
        """For each element: whether it is left out, and whether it lies in an article."""
        out, inside = [False], [False]
        for i in range(1, len(self.elements)):
            tag, parent = self.elements[i][:2]
            out.append(out[parent] or self.unwanted(i, inside[parent]) or tag == "header" and not inside[parent])
            inside.append(inside[parent] or tag in MAIN and not out[i])
        return out, inside

    def digests(self) -> list[int]:
        """A hash of each element, from its tag, attributes in order, and children; white space does not tell."""
        parts: list[list[tuple[int, str]]] = [[] for _ in self.elements]
        for element, start, end in self.texts:
            if words := self.source[start:end].split():
                parts[element].append((start, " ".join(words)))
        out = [0] * len(parts)
        for i in range(len(parts) - 1, -1, -1):
            tag, parent, start = self.elements[i][:3]
            own = [tag, *sorted(f"{n}={v}" for n, v in self.attributes(i)), *(x for _, x in sorted(parts[i]))]
            out[i] = xxhash.xxh3_64_intdigest("\0".join(own).encode())
            if i:
                parts[parent].append((start, f"<{out[i]:x}>"))
        return out

    def subtrees(self, inside: list[bool]) -> list[tuple[int, int, int]]:
        """(element, hash, hash of its article or page) of what may be a template.

        Running text in an article has other hashes than elsewhere.
        """
        own, found = self.digests(), []
        article, holds = [0] * len(own), [e[0] in MAIN for e in self.elements]
        for i in range(len(own) - 1, 0, -1):
            holds[self.elements[i][1]] |= holds[i]
        for i in range(1, len(own)):
            tag, parent = self.elements[i][:2]
            article[i] = article[parent] or (i if tag in MAIN else 0)
            if not holds[i] and tag not in ("html", "body") and tag not in INLINE and tag not in VOID:
                h = pair_of(own[i]) if inside[i] and tag in PROSE else own[i]
                found.append((i, h - (1 << 63), own[article[i]] - (1 << 63)))
        return found

    def deleted(self, templates: frozenset[int], out: list[bool], inside: list[bool]) -> list[bool]:
        """``out`` and what recurs; running text of an article only if more of the article stays."""
        prose, other = [False] * len(out), list(out)
        hit = {i for i, h, _ in self.subtrees(inside) if h in templates}
        for i in range(1, len(out)):
            tag, parent = self.elements[i][:2]
            mild = inside[i] and tag in PROSE
            other[i] = other[i] or other[parent] or i in hit and not mild
            prose[i] = prose[parent] or i in hit and mild
        left = [(prose[e], len(" ".join(self.source[s:t].split()))) for e, s, t in self.texts if inside[e] and not other[e]]
        if 2 * sum(n for lost, n in left if lost) >= sum(n for _, n in left):
            return other
        return [a or b for a, b in zip(prose, other)]

    def text(self, templates: frozenset[int]) -> str:
        out, inside = self.states()
        if templates:
            out = self.deleted(templates, out, inside)
        marked = any(x and not o for x, o in zip(inside, out))
        blocks: list[str] = []
        part: list[str] = []
        block = -1
        events = [(e[2], 0, i) for i, e in enumerate(self.elements) if i and e[0] not in INLINE]
        events += [(e[3], 0, i) for i, e in enumerate(self.elements) if i and e[0] not in INLINE]
        breaks = sorted({x[0] for x in events})
        spaces = [e[2] for e in self.elements if e[0] == "br"]
        edges = np.array(breaks)
        of_block = np.searchsorted(edges, [t[1] for t in self.texts], side="right").tolist() if self.texts else []
        gaps = np.searchsorted(spaces, [t[1] for t in self.texts], side="right").tolist() if self.texts else []
        gap = -1

        def flush():
            words = html.unescape("".join(part)).split()
            if words:
                blocks.append(" ".join(words))
            part.clear()

        for (element, start, end), b, g in zip(self.texts, of_block, gaps):
            if out[element] or marked and not inside[element]:
                continue
            if b != block:
                flush()
                block = b
            elif g != gap:
                part.append(" ")
            gap = g
            part.append(self.source[start:end])
        flush()
        return "\n".join(blocks)


def _pages(batch: pa.RecordBatch) -> list[Page]:
    return [Page(h or "") for h in batch.column("html").to_pylist()]


def templates(pages: DataFrame, share: float = 0.3, few: int = 4, many: int = 50, notice: float = 0.8) -> DataFrame:
    """(host, hash): subtrees that recur on many pages of the host. ``pages`` is (host, html)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hosts, found = [], []
        for host, page in zip(batch.column("host").to_pylist(), _pages(batch)):
            _, inside = page.states()
            own: dict[int, tuple] = {}
            for i, h, whole in page.subtrees(inside):
                prose = inside[i] and page.elements[i][0] in PROSE
                own[h] = (h, whole, prose, not inside[i] or h in own and own[h][3])
            whole = page.digests()[0] - (1 << 63)
            found += [*own.values(), (None, whole, False, False)]
            hosts += [host] * (len(own) + 1)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), *(pa.array(c, k) for c, k in zip(zip(*found), kinds))],
            ["host", "hash", "whole", "prose", "outside"]) if found else None

    rows = over_batches(pages.where("host <> ''"), run, "host string, hash long, whole long, prose boolean, outside boolean")
    seen = staged(rows.groupBy("host", "hash", "whole").agg(F.max("prose").alias("prose"), F.max("outside").alias("outside")).groupBy(
        "host", "hash").agg(F.count("*").alias("n"), F.count_if("outside").alias("outside"), F.max("prose").alias("prose")), "subtrees")
    # The row without a hash counts the host's different pages.
    size = seen.where("hash is null").select("host", F.col("n").alias("pages"))
    part = F.when(F.col("prose"), notice).otherwise(share)
    often = (F.col("n") >= few) & (F.col("n") >= part * F.col("pages")) | (F.col("outside") >= many)
    return seen.where("hash is not null").join(size, "host").where(often).select("host", "hash")


def _keys(hosts: list[str], hashes: list[int]) -> np.ndarray:
    of = {h: xxhash.xxh3_64_intdigest(h.encode()) for h in set(hosts)}
    return pair(np.array([of[h] for h in hosts], np.uint64), np.array(hashes, np.int64).view(np.uint64))


def _saved_templates(found: DataFrame) -> Table:
    def keyed(batch: pa.RecordBatch):
        return _keys(batch.column("host").to_pylist(), batch.column("hash").to_pylist()), np.ones(batch.num_rows)

    return saved(found, keyed, part_bits(found.count()))


def extract(pages: DataFrame, **how) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    known = _saved_templates(staged(templates(rows.select("host", "html"), **how), "templates"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages, hosts = _pages(batch), batch.column("host").to_pylist()
        own = [list({h for _, h, _ in p.subtrees(p.states()[1])}) if host else [] for p, host in zip(pages, hosts)]
        at = np.repeat(np.arange(len(own)), [len(x) for x in own])
        hashes = [h for x in own for h in x]
        hit: list[set[int]] = [set() for _ in own]
        for i in np.flatnonzero(reader(known).get(_keys([hosts[k] for k in at], hashes), 0.0) > 0).tolist():
            hit[at[i]].add(hashes[i])
        out = [page.text(frozenset(x)) for page, x in zip(pages, hit)]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            ["page_id", "url", "text", "n_chars"])

    return over_batches(rows, run, "page_id long, url string, text string, n_chars long")
