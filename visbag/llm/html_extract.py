"""HTML extraction by site template removal: element subtrees are hashed, counted per host, and deleted where they
recur across many pages of the host; what else is not the article goes by its element, role or class.

1. Pages are dealt into chunks by a hash. A chunk parses its pages and sends, packed by bucket, the distinct keys of
   their subtrees, each with the SKETCH least hashes of the texts of its pages, and those of the hosts. A bucket puts
   them together, counts the different texts (exactly below SKETCH, else by the least hashes) and answers each chunk in
   its order. One host may have any share of the pages: keys, not hosts, are dealt out, and each chunk sends a key once.
   A subtree has three keys: (host, place, subtree), (host, place, shape: its elements without texts), and the subtree
   on any host; its place is the elements that hold it.
2. A chunk parses its pages again and deletes the subtrees that stand in one place with enough different texts of the
   host's pages: MANY, or half the root of the host's number if that is more, so the share falls with the size of the
   host and copies of one page are no template. A slot whose texts change goes if its shape stands there so often and its
   text on MANY pages of any hosts. What holds the page's content never goes: its longest article, else its main element,
   else the innermost element with half of the page's letters outside links and menus, or, if that is the body, the
   element with the most letters of its own in paragraphs and the like. Outside the content only what is
   smaller than it goes; inside, only small containers of links or loose text: paragraphs, headings, lists, tables and
   what is made of them stay, however often they recur.
3. What the counts leave goes by rules: scripts, styles, forms, menus, asides, footers, headers outside the article,
   hidden elements, and elements one of whose classes, or whose id, consists of words of SAYS and NEUTRAL ("comments",
   "ad-box", but not "with-sidebar" or "related-work"; names of headings say nothing, those of paragraphs, lists and
   tables in an article only if they speak of advertising), or whose role is in ROLES. Of what stays, the outermost
   article elements count if there are any, else main, else the body.

Blocks are texts between starts and ends of block elements. Character references are decoded, white space inside a
block becomes one space, blocks are trimmed, empty ones dropped, and joined by a blank line. ``<br>`` is white space.
Null or empty html gives an empty text; a null url is a host of its own; unclosed and stray tags, and any depth of
nesting, are tolerated in linear time; an unclosed title, textarea or iframe ends where it starts. Repeated rows are
handled each (rows equal in all columns meet in one chunk); other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, packed, prepared, released, tasks_for, unpacked

MANY, SKETCH, CHUNK_BYTES, BUCKET_KEYS = 3, 16, 6 << 20, 500_000
_SKIP = r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"""
TAG = re.compile(_SKIP + r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
LOOSE = re.compile(_SKIP + r"""|<(/?)([a-zA-Z][^\s/>]*+)()>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|style|hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes".split())  # what they hold is not markup
ENDLESS = frozenset("script style".split())  # unclosed, they take the rest of the page
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
GONE = frozenset("script style title template noscript svg math noframes".split())  # nothing of them is shown
APART = frozenset("nav aside footer form button select dialog object audio video canvas menu search fieldset input label datalist head textarea iframe".split())
CONTAINERS = frozenset("div section aside nav header footer form ul ol dl menu table figure details dialog fieldset search".split())
TOP = frozenset(["", "html", "body"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p pre blockquote ul ol li dl dt dd table tr td th figure figcaption".split()) | HEADINGS
HOLDERS = frozenset("div section article main td body html blockquote center".split()) | {""}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class names and ids that tell what is not the article, and words that may stand beside them.
SAYS = frozenset("ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookiebanner cookiebar cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification onetrust pager pagination popup promo promotion promotions recommendations recommended related reply replies respond response responses search share sharing sidebar signin signup skip skiplink social sponsor sponsored subscribe subscription toolbar widget widgets".split())
ADVERTS = frozenset("ad ads adbox adsense advert adverts advertisement advertising promo promotion promotions sponsor sponsored".split())
NEUTRAL = frozenset("area articles bar block body bottom box button buttons c cc container content control controls cover css entry form global group header icons inner item items js l left link links list main menu module news of outer overlay page panel posts primary reader right sdk secondary section site slot static sticky stories story the thread title to top unit user wrap wrapper".split())


def named(names: str, says: frozenset = SAYS) -> bool:
    """Whether one of the names consists of words of ``says`` and NEUTRAL, one of ``says`` at least."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
        if any(w in says for w in words) and all(w in says or w in NEUTRAL for w in words):
            return True
    return False


class Node:
    __slots__ = ("tag", "said", "gone", "inside", "open", "close", "size", "prose", "links", "own", "made", "keys")

    def __init__(self, tag: str, inside: bool, at: int):
        self.tag, self.inside, self.open, self.close, self.said, self.gone = tag, inside, at, at, False, tag in GONE
        self.size = self.prose = self.links = self.own = 0  # letters: all, outside links and menus, in links; of paragraphs and the like, in no holder within
        self.made, self.keys = False, ()  # whether there are elements of PROSE in it; keys of what counts may delete


class Page:
    """Elements in the order of their starts, and ``flow``: texts, i where element i starts, ~i where it ends."""

    def __init__(self, page: str):
        root = Node("", False, 0)
        self.nodes, self.flow = [root], [0]
        stack, opened, tag, at, low = [0], {}, TAG, 0, None
        last, nodes, flow = page.rfind(">") + 1, self.nodes, self.flow

        def close(i: int) -> None:
            for k in reversed(stack[i:]):
                nodes[k].close = len(flow)
                flow.append(~k)
                opened[nodes[k].tag] -= 1
            del stack[i:]

        opened[""] = 1
        while m := tag.search(page, at, last):
            if m.start() > at:
                flow.append(page[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            if m[5] and tag is TAG:
                tag = LOOSE  # a quotation mark that nothing closes: from here on, tags end at the next ">"
            name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if opened.get(name):
                    for i in range(len(stack) - 1, 0, -1):
                        other = nodes[stack[i]].tag
                        if other == name:
                            close(i)
                            break
                        if name not in BLOCK and other in BLOCK:
                            break  # a stray inline end does not close blocks
                continue
            if name in BLOCK and opened.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i]].tag == "p":
                        close(i)
                        break
                    if nodes[stack[i]].tag in BLOCK:
                        break
            if name in CLOSES and any(opened.get(x) for x in CLOSES[name]):
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i]].tag in HOLDS[name]:
                        break
                    if nodes[stack[i]].tag in CLOSES[name]:
                        close(i)
                        break
            top = nodes[stack[-1]]
            node = Node(name, top.inside or top.tag in ("article", "main"), len(flow))
            if attributes:
                for key, a, b, c in NAMED.findall(attributes):
                    key, value = key.lower(), a or b or c
                    if key in ("class", "id"):
                        prose = name in PROSE and node.inside
                        node.said |= name not in HEADINGS and (not prose or key == "class") and named(value, ADVERTS if prose else SAYS)
                    elif key == "role":
                        node.said |= value.lower().strip() in ROLES
                    elif key == "hidden" or HIDDEN.search(value):
                        node.gone = True
            flow.append(len(nodes))
            stack.append(len(nodes))
            nodes.append(node)
            opened[name] = opened.get(name, 0) + 1
            if name in RAW:
                if low is None:
                    low = page.lower()
                    low = low if len(low) == len(page) else page
                end = low.find(f"</{name}", at)
                shut = page.find(">", end) if end >= 0 else -1
                at = shut + 1 if shut >= 0 else len(page) if name in ENDLESS else at
                close(len(stack) - 1)
            elif name in VOID or attributes.endswith("/") and (name not in BLOCK or opened.get("svg") or opened.get("math")):
                close(len(stack) - 1)
        if at < len(page):
            flow.append(page[at:])  # a tag that the page's end cuts is text
        close(0)
        self._measure()

    def _measure(self) -> None:
        """Letters of each element's own and inner texts; the content (see the module's text) and what holds it."""
        nodes, total, prose, links = self.nodes, 0, 0, 0
        begun, apart, linked, made, around, holders = [], 0, 0, 0, 0, []
        for x in self.flow:
            if isinstance(x, str):
                n = len(x) - x.count(" ") - x.count("\n")
                total += n
                if linked:
                    links += n
                elif not apart:
                    prose += n
                    holders[-1].own += n if around else 0
            elif x >= 0:
                node = nodes[x]
                begun.append((total, prose, links, made))
                if node.tag in HOLDERS:
                    holders.append(node)
                apart += bool(node.gone or node.tag in APART or node.said)
                linked += node.tag == "a"
                made += node.tag in PROSE
                around += node.tag in PROSE
            else:
                node = nodes[~x]
                if node.tag in HOLDERS:
                    holders.pop()
                apart -= bool(node.gone or node.tag in APART or node.said)
                linked -= node.tag == "a"
                around -= node.tag in PROSE
                t, p, k, m = begun.pop()
                node.size, node.prose, node.links, node.made = total - t, prose - p, links - k, made - m > (node.tag in PROSE)
        kept = [n for n in nodes if n.tag == "article" and not n.said and not n.gone] or [n for n in nodes if n.tag == "main" and not n.gone]
        if kept:
            content = max(kept, key=lambda n: n.size)
        else:
            half = [n for n in nodes if n.tag in HOLDERS and not n.gone and not n.said and 2 * n.prose >= prose > 0]
            content = half[-1] if half else None  # each holds the next, but for two halves
            if content and content.tag in TOP:
                content = max((n for n in nodes if n.tag in HOLDERS and not n.gone and not n.said), key=lambda n: n.own)
        at = content.open if content else -1
        self.content = content
        self.holds = {n.open for n in nodes if n.open <= at <= n.close}

    def deletable(self, node: Node, prose_top: bool) -> bool:
        """Whether counts may delete the element; ``prose_top``: prose that stands in the content or right in the body that
        is the content."""
        content = self.content
        if node.tag in TOP or node.tag in ("article", "main") or node.open in self.holds:
            return False
        if content is None:
            return True
        if content.open < node.open < content.close and (content.tag not in TOP or prose_top):
            # a small container of links or of text that is in no paragraph
            return node.tag in CONTAINERS and node.tag not in PROSE and 2 * node.size <= content.size and (not node.made or 2 * node.links >= node.size)
        return node.size <= content.size

    def unwanted(self, node: Node) -> bool:
        if node.gone or node.tag in APART and not (node.tag in ("form", "fieldset") and node.open in self.holds):
            return True
        return node.tag == "header" and not node.inside and node.open not in self.holds or node.said and node.tag not in TOP and node.open not in self.holds

    def hash(self, host: bytes) -> list[int]:
        """Sets and returns the keys of the elements that counts may delete: of (host, place, subtree), and, outside the
        content and where no rule deletes them, of (host, place, shape) and of the subtree on any host."""
        open_, texts, shapes, places, keys = [], [], [], [], []
        out = depth = 0  # elements around that go by a rule, that are prose
        content, number = self.content, lambda data, key: int.from_bytes(blake2b(data, key=key, digest_size=8).digest(), "little")
        for x in self.flow:
            if isinstance(x, str):
                words = " ".join(x.split())
                if words:
                    open_[-1].update(b"\0" + words.encode("utf-8", "replace"))
                    texts[-1] = True
            elif x >= 0:
                node = self.nodes[x]
                tag = node.tag.encode()
                open_.append(blake2b(tag, digest_size=8))
                shapes.append(crc32(tag))
                places.append(crc32(tag + b"/", places[-1] if places else 0))
                texts.append(False)
                out += self.unwanted(node)
                depth += node.tag in PROSE
            else:
                node, digest, text, shape, place = self.nodes[~x], open_.pop().digest(), texts.pop(), shapes.pop(), places.pop()
                wanted = not self.unwanted(node)
                out -= not wanted
                depth -= node.tag in PROSE
                if open_ and not node.gone:
                    shapes[-1] = crc32(shape.to_bytes(4, "little"), shapes[-1])
                if text and not node.gone:
                    if open_:
                        open_[-1].update(b"\1" + digest)
                        texts[-1] = True
                    if self.deletable(node, bool(depth) or node.tag in PROSE):
                        where = place.to_bytes(4, "little")
                        node.keys = (number(digest + where, host),)
                        inside = content and content.open < node.open < content.close and content.tag not in TOP
                        if wanted and not out and not inside and node.tag not in HEADINGS:
                            node.keys += (number(b"shape" + shape.to_bytes(4, "little") + where, host), number(b"text" + digest, b"any"))
                        keys += node.keys
        return keys

    def recurring(self, count, enough: float) -> set[int]:
        """Where the elements start that occur often enough; ``count``: of a key, ``enough``: pages of the host."""
        gone = set()
        for node in self.nodes:
            k = node.keys
            if k and (count(k[0]) >= enough or len(k) > 1 and count(k[1]) >= enough and count(k[2]) >= MANY):
                gone.add(node.open)
        return gone

    def blocks(self, gone=frozenset()) -> list[str]:
        """Texts of the blocks of the content, without the elements that start at one of ``gone``."""
        flow, nodes, skip, articles, mains, at = self.flow, self.nodes, {}, [], [], 0
        upto = {"article": -1, "main": -1}
        while at < len(flow):
            x = flow[at]
            if not isinstance(x, str) and x >= 0:
                node = nodes[x]
                if x and (self.unwanted(node) or node.open in gone):
                    skip[at] = node
                    at = node.close
                elif node.tag in upto and node.open > upto[node.tag]:
                    (articles if node.tag == "article" else mains).append(node)
                    upto[node.tag] = node.close
            at += 1
        out, part = [], []

        def flush():
            text = " ".join(html.unescape("".join(part)).split())
            part.clear()
            if text:
                out.append(text)

        for node in articles or mains or [nodes[0]]:
            at = node.open
            while at <= node.close:
                x = flow[at]
                if isinstance(x, str):
                    part.append(x)
                elif at in skip:
                    if skip[at].tag in BLOCK:
                        flush()
                    elif skip[at].tag not in GONE:
                        part.append(" ")
                    at = skip[at].close
                elif nodes[x if x >= 0 else ~x].tag in BLOCK:
                    flush()
                elif nodes[x if x >= 0 else ~x].tag == "br":
                    part.append(" ")
                at += 1
            flush()
        return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _salt(host: str) -> bytes:
    return blake2b(host.encode("utf-8", "replace"), digest_size=16).digest()


def least(host_texts: float) -> float:
    """With so many different texts a subtree is a template of a host with ``host_texts``."""
    return max(MANY, math.sqrt(host_texts) / 2)


def _page(page: str, host: bytes) -> tuple[Page, list[int], int]:
    page = Page(page)
    return page, page.hash(host), int.from_bytes(blake2b(host, digest_size=8).digest(), "little")


def _smallest(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (key, hash of a text), sorted, the different ones, SKETCH least hashes of each key at most."""
    order = np.lexsort((texts, keys))
    keys, texts = keys[order], texts[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
    keys, texts = keys[fresh], texts[fresh]
    first = np.searchsorted(keys, keys)
    stay = np.arange(len(keys)) - first < SKETCH
    return keys[stay], texts[stay]


def _requests(chunk: int, table: pa.Table, bits: int) -> pa.Table:
    keys, texts = [], []
    for url, page in zip(table.column("url").to_pylist(), table.column("html").to_pylist()):
        tree, own, of_host = _page(page or "", _salt(host_of(url)))
        text = int.from_bytes(blake2b("\n".join(tree.blocks()).encode("utf-8", "replace"), digest_size=8).digest(), "little")
        own = {*own, of_host}
        keys += own
        texts += [text] * len(own)
    keys, texts = _smallest(np.array(keys, np.uint64), np.array(texts, np.uint64))
    distinct, many = np.unique(keys, return_counts=True)
    cuts, ends = bucket_cuts(distinct, bits), np.concatenate([[0], np.cumsum(many)])
    used = [b for b in range(len(cuts) - 1) if cuts[b] < cuts[b + 1]]
    part = [slice(cuts[b], cuts[b + 1]) for b in used]
    released()
    return pa.table([pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int32()), pa.array([packed(distinct[p]) for p in part], pa.binary()), pa.array([packed(many[p].astype(np.uint8)) for p in part], pa.binary()), pa.array([packed(texts[ends[p.start] : ends[p.stop]]) for p in part], pa.binary())], ["bucket", "chunk", "keys", "many", "texts"])


def bucket_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(keys)]])


def _answers(table: pa.Table) -> pa.Table:
    """The number of different texts of each key, 0 where it is under MANY."""
    asked = [unpacked(x) for x in table.column("keys").to_pylist()]
    many = [unpacked(x) for x in table.column("many").to_pylist()]
    keys, texts = _smallest(np.concatenate([np.repeat(k, n) for k, n in zip(asked, many)]), np.concatenate([unpacked(x) for x in table.column("texts").to_pylist()]))
    distinct, start, count = np.unique(keys, return_index=True, return_counts=True)
    last = texts[start + count - 1].astype(np.float64) / 2.0**64  # of SKETCH least hashes, the greatest tells how dense they lie
    found = np.where(count < SKETCH, count, (SKETCH - 1) / np.maximum(last, 2.0**-64))
    found[found < MANY] = 0
    return pa.table([table.column("chunk"), table.column("bucket"), pa.array([packed(found[np.searchsorted(distinct, k)].astype(np.float32)) for k in asked], pa.binary())], ["chunk", "bucket", "counts"])


def _texts(table: pa.Table, replies: pa.Table, bits: int) -> pa.Table:
    pages = [_page(page or "", _salt(host_of(url))) for url, page in zip(table.column("url").to_pylist(), table.column("html").to_pylist())]
    keys = np.array(sorted({k for _, own, of_host in pages for k in (*own, of_host)}), np.uint64)
    total, cuts = np.zeros(len(keys), np.float32), bucket_cuts(keys, bits)
    for bucket, reply in zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist()):
        total[cuts[bucket] : cuts[bucket + 1]] = unpacked(reply)
    count = dict(zip(keys[total > 0].tolist(), total[total > 0].tolist()))
    out, removed = [], []
    for page, own, of_host in pages:
        enough = least(count.get(of_host, 0))
        gone = page.recurring(lambda k: count.get(k, 0), enough)  # noqa: B023  called at once
        out.append("\n\n".join(page.blocks(gone)))
        removed.append(len(gone))
    released()
    return pa.table([table.column("page_id"), table.column("url"), pa.array(out, pa.string()), pa.array(removed, pa.int64())], ["page_id", "url", "text", "n_templates"])


def extracted(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, url, text and n_templates (subtrees of the page that counts deleted) of every row of ``pages`` (page_id, url, html)."""
    spark = prepared(pages.sparkSession)
    pages = columns(pages, page_id="bigint", url="string", html="string")
    size = pages.agg(F.sum(F.octet_length("html")), F.count("*")).first()
    chunks = max(tasks_for(spark, 0, 1), math.ceil((size[0] or 0) / chunk_bytes), math.ceil(size[1] / 20_000))
    bits = max(3, math.ceil(math.log2(max(1, size[1] * 20 / BUCKET_KEYS))))
    dealt = pages.withColumn("chunk", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(chunks)).cast("int"))
    requests = dealt.groupBy("chunk").applyInArrow(lambda key, t: _requests(key[0].as_py(), t, bits), "bucket int, chunk int, keys binary, many binary, texts binary")
    replies = requests.groupBy("bucket").applyInArrow(_answers, "chunk int, bucket int, counts binary")
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda t, r: _texts(t, r, bits), "page_id bigint, url string, text string, n_templates bigint")
