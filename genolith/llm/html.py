"""Main-text extraction with consensus host paths.

First pass: each page's containers are scored by the text that they hold outside of boilerplate; from its best one the page climbs to
the whole article around it and votes for the generalised tag-class path of that. Spark sums the votes per host (map-side first, so a host with
most of the pages costs no more than another). Second pass: each page gives the text of the elements at its host's winning path;
a page without such an element, or without a host, gives that of its own best container.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genolith.llm.common import bound_batches, stored
from genolith.llm.urls import url_parts

#: Winning paths broadcast at most; beyond that pages meet them in a shuffled join.
MAX_BROADCAST = 200_000
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# fixed values: element names of HTML and the usual names of boilerplate
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg math".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
JUNK_TAGS = set("nav header footer aside form menu button select dialog head search".split())
JUNK_NAMES = set("nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement adverts advertising banner promo promotion sponsor sponsored cookie cookies consent notice notices alert gdpr comment comments disqus reply replies respond related recommended share sharing social newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget popup modal toolbar copyright legal".split())
#: Words that say nothing about a class name's kind: a name is boilerplate if it has a word of boilerplate and else only such words, so `comment-list` is and `comment-on-law` isn't.
NEUTRAL_NAMES = set("a area article bar block body bottom box button buttons center col column container content element entry fixed floating form full global group head holder id in inline inner item items layer left link links list main mobile module outer page panel post primary right row secondary section side site slot small sticky strip text title top unit wrap wrapper zone".split())
KEEP_NAMES = set("content main article post body text story entry page".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Blocks that are lines of a container rather than containers.
_LINES = HEADINGS | {"p", "li", "pre", "blockquote", "td", "th", "tr", "dt", "dd"}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}


class Page:
    """Elements and text blocks of a page, in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.name, self.junk = [-1], [""], [""], [False]
        self.blocks: list[tuple[int, str, float]] = []  # element, text, share of it outside links
        self._stack, self._buffer, self._linked, self._link = [0], [], 0, 0
        self._open_at: dict[str, list[int]] = defaultdict(list)  # where on the stack each tag is open, and all blocks
        self._open_blocks: list[int] = []
        self._holder, self._open_junk = [0], 0
        at, last = 0, source.rfind(">") + 1  # no tag ends behind the last bracket
        unclosed: set[str] = set()
        while True:
            m = _TAG.search(source, at, last)
            if not m:
                end = source.find("<!--", max(at, last))
                self._add(source[at : end if end >= 0 else len(source)])
                break
            self._add(source[at : m.start()])
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # a comment that doesn't end
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(name)
            elif name in RAW:
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                if not close:
                    unclosed.add(name)  # nor is there an end tag further on
                at = close.end() if close else at if name in {"svg", "math"} else len(source)
            else:
                self._open(name, m[3] or m[6] or "")
        self._flush()

    def _add(self, text: str) -> None:
        if text:
            self._buffer.append(text)
            if self._link:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._buffer:
            raw = "".join(self._buffer)
            text = " ".join(entities.unescape(raw).split())
            if text:
                self.blocks.append((self._stack[-1], text, 1 - min(1.0, self._linked / len(raw))))
            self._buffer, self._linked = [], 0

    def _pop_to(self, depth: int) -> None:
        for e in reversed(self._stack[depth:]):
            tag = self.tag[e]
            self._link -= tag == "a"
            self._open_junk -= self.junk[e]
            self._open_at[tag].pop()
            if tag in BLOCK:
                self._open_blocks.pop()
        del self._stack[depth:]

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
            if self._open_blocks and self.tag[self._stack[self._open_blocks[-1]]] == "p":
                self._pop_to(self._open_blocks[-1])
            if tag in _CLOSES:
                scope = max((self._open_at[t][-1] for t in _SCOPE.get(tag, {"table"}) if self._open_at[t]), default=0)
                over = [x[i] for t in _CLOSES[tag] if (i := bisect_right(x := self._open_at[t], scope)) < len(x)]
                if over:
                    self._pop_to(min(over))
        elif tag in VOID:
            self._buffer.append(" " if tag == "br" else "")
        if tag in VOID:
            return
        words, role = [], ""
        for key, *values in _ATTR.findall(attrs):
            value = next((v for v in values if v), "")
            if key.lower() == "role":
                role = value.lower()
            else:
                words += re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split() if key.lower() == "class" else [f"#{value.lower()}"]
        names = [{w for w in re.split(r"[^a-z]+", x) if w} for x in words]
        up = self._stack[-1]
        junk = self.junk[up] or tag in JUNK_TAGS or role in {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog"}
        if not junk and tag not in {"html", "body", "main", "article"} and any(n & JUNK_NAMES and n <= JUNK_NAMES | NEUTRAL_NAMES for n in names) and not any(n and n <= KEEP_NAMES for n in names):
            junk = True
        if junk and tag in HEADINGS and self.tag[up] == "header" and (self._open_at["article"] or self._open_at["main"]):
            junk = self._open_junk > self.junk[up]  # the headline of the article itself
        self.parent.append(up)
        self.tag.append(tag)
        self.name.append(tag + "".join("." + g for g in sorted({re.sub(r"\d+", "", w) for w in words})[:3]))
        self.junk.append(junk)
        self._open_at[tag].append(len(self._stack))
        if tag in BLOCK:
            self._open_blocks.append(len(self._stack))
        self._open_junk += junk
        self._holder.append(self._holder[up] if tag not in BLOCK or tag in _LINES else len(self.tag) - 1)
        self._stack.append(len(self.tag) - 1)
        self._link += tag == "a"

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        at = self._open_at[tag]
        if at and (tag in BLOCK or not self._open_blocks or at[-1] > self._open_blocks[-1]):  # an inline end tag doesn't reach out of its block
            self._pop_to(at[-1])

    def path(self, element: int) -> str:
        names = []
        while element > 0:
            names.append(self.name[element])
            element = self.parent[element]
        return ">".join(reversed(names))

    def best(self) -> tuple[int, float]:
        """The article around the container with the most text close to it, and that container's score; -1 without any."""
        score: dict[int, float] = {}
        for e, text, free in self.blocks:
            if self.junk[e]:
                continue
            worth, holder = len(text) * free, self._holder[e]
            while holder >= 0 and worth >= 1:
                score[holder] = score.get(holder, 0) + worth * (1.5 if self.tag[holder] in {"article", "main"} else 1)
                holder, worth = self.parent[holder], worth / 2
        found, most = max(score.items(), key=lambda x: (x[1], -x[0]), default=(-1, 0.0))
        return self._whole(found), most

    def _whole(self, element: int) -> int:
        """The nearest article or main around element; without one, the outermost ancestor that adds at least as much text as boilerplate."""
        if element < 0:
            return element
        chain = [element]
        while chain[-1] > 0:
            chain.append(self.parent[chain[-1]])
        for e in chain:
            if self.tag[e] in {"article", "main"}:
                return e
        level = [0] * len(self.tag)
        for k, e in enumerate(chain):
            level[e] = k
        known = set(chain)
        for e in range(1, len(level)):  # parents come first
            if e not in known:
                level[e] = level[self.parent[e]]
        text, junk = [0.0] * len(chain), [0.0] * len(chain)  # by the first ancestor that holds them; links count as boilerplate
        for e, words, free in self.blocks:
            free = 0.0 if self.junk[e] else free
            if k := level[e]:
                text[k] += len(words) * free
                junk[k] += len(words) * (1 - free)
        out, had, added, spoilt = element, 0.0, 0.0, 0.0
        for e, more, other in zip(chain, text, junk, strict=True):
            added, spoilt = added + more, spoilt + other
            if added > had and added >= spoilt:
                out, had = e, added
        return out

    def text(self, path: str | None) -> str:
        """Blocks inside the elements at path, or inside the page's own best container."""
        inside = [False] * len(self.tag)
        met = [0] + [-1] * (len(self.tag) - 1)  # how much of path the elements down to this one spell, if they spell its beginning
        for e in range(1, len(self.tag)):  # parents come first
            up = self.parent[e]
            if path is not None and met[up] >= 0 and path.startswith(part := f">{self.name[e]}" if up else self.name[e], met[up]):
                met[e] = met[up] + len(part)
            inside[e] = inside[up] or (path is not None and met[e] == len(path))
        if not any(inside[e] and not self.junk[e] for e, _, _ in self.blocks):
            root = self.best()[0]
            for e in range(len(self.tag)):
                inside[e] = e == root or (e > 0 and inside[self.parent[e]])
        return "\n".join(t for e, t, _ in self.blocks if inside[e] and not self.junk[e])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, source in zip(batch.column(0), batch.column(1), strict=True):
            page = Page(source.as_py())
            e, score = page.best()
            if e >= 0:
                hosts.append(host.as_py())
                paths.append(page.path(e))
                scores.append(int(score))
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [Page(s.as_py()).text(p.as_py()) for s, p in zip(part.column(2), part.column(3), strict=True)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the container path with the most votes of each host, then the highest score, then the greater string."""
    rows = pages.select(url_parts(F.col(url))[0].alias("host"), F.col(html).alias("html")).where("host <> '' and html is not null")
    votes = rows.mapInArrow(_votes, "host string, path string, score long").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """key, url, text, n_chars of each row of pages.

    text: the blocks of the main container without boilerplate, references decoded, white space collapsed, joined by newlines.
    Null or empty html: empty text. Pages without a host have no consensus. Keys may be null or repeated: each row gives one row.
    Other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    winners = stored(host_paths(pages, url, html))
    small = winners.count() <= max_broadcast
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), url_parts(F.col(url))[0].alias("host"))
    met = rows.join(F.broadcast(winners) if small else winners, "host", "left").select("key", "url", "html", "path")
    kind = pages.schema[key].dataType.simpleString()
    return met.mapInArrow(_texts, f"key {kind}, url string, text string, n_chars long").withColumnsRenamed({"key": key, "url": url})
