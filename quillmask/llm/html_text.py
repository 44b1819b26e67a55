"""Main text of web pages by site style trees (operator 1).

Yi, Liu and Li, "Eliminating Noisy Information in Web Pages for Data Mining" (2003).
The DOMs of one host merge into a style tree whose nodes are paths of (tag, class, id).

1. One pass parses each page and gives, per host, the child sequences of each node
   (presentation styles), the texts right below it (content) and the nodes above it, counted
   per task before they are shuffled.
2. Of a node on m pages, a style on n pages has the share n / m, and a text on n pages the entropy
   log n / log m.  So the texts' importance is 1 - entropy: 1 for a text of one page, 0
   for one of all.  A node's importance joins both down the tree: 1 - gamma of the entropy of its
   styles, and gamma of the mean importance of the distinct texts in it and the nodes below it.
   So a node of one style and unique texts has gamma, one that is alike on all pages 0.
3. A second pass removes branches and joins the rest.

A branch goes by its importance, if its node is on ``min_pages`` pages or more: below ``threshold``, or,
where its tag, class or id hints at noise, below ``named_threshold``.  Inside the core only the latter counts.
What names say by themselves goes too, as unique texts of noise (reader comments) are
important: elements ``nav``, ``footer``, ``aside``, ``form`` and the like, their roles,
and class or id tokens that consist of noise words and mere qualifiers ("site-footer", but not "with-sidebar").
Headers are noise outside of the article only.

The core of a page is the longest article or main part outside of such noise.  The core and
what holds it are never removed, nor are plain text blocks inside it: copies of one article stay
whole.  If importance would leave a page nothing, it does not apply to that page.

Low nodes are broadcast if there are at most ``broadcast_nodes`` of them, a checked bound;
beyond it they are joined with the pages by (host, node).  Nodes deeper than ``DEEPEST`` levels count as part of
the node at that level.

Scripts, styles, frames, fields, titles and drawings have no text; a drawing or noscript part that
nothing closes drops only its tag.  Formulas count as inline text, objects and templates as blocks.
Character references are decoded in each run of text between two tags.

A null or empty page gives an empty text; a null or odd URL is the host "".  Rows that
repeat a ``page_id`` and null ids are rows of their own.  Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm._store import Workspace

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe svg textarea title noembed noframes".split())
#: Of these, the ones that run to the end of the page if nothing closes them.
ENDLESS = RAW - {"noscript", "svg"}
MATH = frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover"
    " none semantics annotation annotation-xml".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp".split()
) | MATH
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("html table td th caption button object template".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre td th tr table dl dt dd figure figcaption".split())
NOISE_TAGS = frozenset("nav footer aside form dialog menu button select".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
# Words of class and id names that mean noise, those that do so outside of an article only, and words that say nothing by themselves.
NOISE_NAMES = frozenset(
    (
        "ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsors sponsored promo promos promotion sidebar sidebars menu menus submenu nav navbar navigation"
        " topnav breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr popup popups modal overlay newsletter subscribe subscription signup login share sharing social"
        " related recommended recommendations comment comments commentlist disqus respond reply replies widget widgets toolbar pagination pager"
    ).split()
)
OUTSIDE_NAMES = frozenset("header banner notice notices notification notifications copyright search".split())
QUALIFIERS = frozenset(
    (
        "site page global top bottom left right upper lower primary secondary main outer inner box bar area block wrap wrapper container holder section panel list item items links link button"
        " buttons form field text thread fixed sticky mobile desktop small large big the my js ui col column row widget block unit slot banner title heading inline style post posts article articles media icons icon"
    ).split()
)
#: Levels of the style tree.
DEEPEST = 256
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden)(?=[\s=/>]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_XMP = re.compile(r"</xmp(?=[\s/>])", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")


def named(value: str) -> int:
    """What a class or id says: 2 a token of it means noise, 1 noise outside of an article, 0 neither."""
    most = 0
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        words = [w for w in words if not w.isdigit()]
        rest = [w for w in words if w not in NOISE_NAMES and w not in QUALIFIERS]
        if any(w in NOISE_NAMES for w in words) and not [w for w in rest if w not in OUTSIDE_NAMES]:
            return 2
        if any(w in OUTSIDE_NAMES for w in words) and not [w for w in rest if w not in OUTSIDE_NAMES]:
            most = 1
    return most


class Page:
    """The elements of a page: per element its parent, tag, node key and child labels;
    and its text, as events ``(element, text)`` with ``(element, None)`` for a block's edge.

    ``noise`` is 2 for an element that is noise by itself, 1 for one that is so outside of the core, else 0.
    ``hint`` tells whether a word of its class or id hints at noise.
    """

    __slots__ = ("parent", "tag", "key", "kids", "noise", "hint", "core", "events", "depth")

    def __init__(self, source: str):
        self.parent, self.tag, self.key, self.kids, self.noise, self.hint, self.depth = [-1], ["#"], [0], [[]], [0], [False], [0]
        self.core = [False]
        self.events: list[tuple[int, str | None]] = []
        self._parse(source)
        self._find_core()

    def _find_core(self) -> None:
        """Marks the longest article or main part outside of noise, and what holds it (True), and what is inside it (None)."""
        n = len(self.tag)
        size = [0] * n
        for e, t in self.events:
            if t:
                size[e] += len(t)
        shut = [False] * n
        best = 0
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
        for e in range(1, n):
            up, tag = self.parent[e], self.tag[e]
            shut[e] = shut[up] or (self.noise[e] == 2 and tag not in ("article", "main", "body", "html", "form") and not (2 * size[e] > size[0]))
            if tag in ("article", "main") and not shut[e] and self.noise[e] < 2 and size[e] > size[best] * (best > 0):
                # the outermost of equally long ones comes first
                best = e
        self.core = [False] * n
        if best:
            for e in range(best + 1, n):
                if self.parent[e] == best or self.core[self.parent[e]] is None:
                    self.core[e] = None
            e = best
            while e >= 0:
                self.core[e] = True
                e = self.parent[e]

    def _open(self, up: int, tag: str, attrs: str) -> int:
        label, noise, hint = tag, 2 * (tag in NOISE_TAGS) or tag == "header", False
        if attrs.strip(" /"):
            seen = set()
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in seen:  # the first of repeated attributes counts
                    continue
                seen.add(name)
                if name == "hidden":
                    noise = 2
                elif name == "role":
                    noise = 2 if value.lower() in NOISE_ROLES else noise
                else:
                    value = html.unescape(value)
                    label += ("." if name == "class" else "#") + _DIGITS.sub("0", value)
                    noise = max(noise, named(value))
                    hint = hint or any(w.lower() in NOISE_NAMES or w.lower() in OUTSIDE_NAMES for w in _WORD.findall(value))
        self.kids[up].append(label)
        self.parent.append(up)
        self.tag.append(tag)
        self.depth.append(self.depth[up] + 1)
        self.key.append(xxhash.xxh64_intdigest(label, seed=self.key[up]) if self.depth[up] < DEEPEST else self.key[up])
        self.kids.append([])
        self.noise.append(0 if tag in ("body", "html") else int(noise))
        self.hint.append(hint or noise > 0)
        return len(self.tag) - 1

    def _parse(self, s: str) -> None:
        stack, opened, unclosed = [0], Counter(), set()
        events, tags = self.events, self.tag

        def close(upto: int) -> None:
            while len(stack) > upto:
                e = stack.pop()
                opened[tags[e]] -= 1
                if tags[e] not in INLINE:
                    events.append((e, None))

        def find(names, stop) -> int:
            for k in range(len(stack) - 1, 0, -1):
                t = tags[stack[k]]
                if t in names:
                    return k
                if t in stop:
                    break
            return 0

        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                run = s[at:lt]
                events.append((stack[-1], html.unescape(run) if "&" in run else run))
            if lt >= n:
                break
            c = s[lt + 1 : lt + 2]
            if c == "!" or c == "?":
                if s.startswith("<!--", lt):
                    end = s.find("-->", lt + 4)
                    at = end + 3 if end >= 0 else n
                else:
                    end = s.find(">", lt)
                    at = end + 1 if end >= 0 else n
                continue
            m = _TAG.match(s, lt)
            if not m:
                if c.isascii() and c.isalpha() or c == "/":
                    end = s.find(">", lt)
                    if end < 0:
                        break
                    at = end + 1
                else:
                    events.append((stack[-1], "<"))
                    at = lt + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if opened[tag] > 0:
                    k = find({tag}, ())
                    if k:
                        close(k)
                elif tag == "br" or tag == "p":
                    events.append((stack[-1], " ") if tag == "br" else (stack[-1], None))
                continue
            if (tag == "svg" or tag in MATH) and m[3].endswith("/"):
                continue
            if tag == "xmp":  # text as it stands
                end = _XMP.search(s, at)
                end = end.start() if end else n
                events += [(stack[-1], None), (stack[-1], s[at:end]), (stack[-1], None)]
                at = end
                continue
            if tag in RAW:
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(s, at)
                if not end:
                    unclosed.add(tag)
                at = end.end() if end else n if tag in ENDLESS else at
                continue
            if tag in CLOSES_P and opened["p"] > 0:
                k = find({"p"}, SCOPE)
                if k:
                    close(k)
            if tag in ENDS and opened:
                names, stop = ENDS[tag]
                if any(opened[t] > 0 for t in names):
                    k = find(names, stop)
                    if k:
                        close(k)
            if tag == "br" or tag in MATH:
                events.append((stack[-1], " "))
            if tag in VOID:
                if tag == "hr":
                    events.append((stack[-1], None))
            else:
                e = self._open(stack[-1], tag, m[3])
                if tag not in INLINE:
                    events.append((e, None))
                stack.append(e)
                opened[tag] += 1
        close(1)

    def nodes(self) -> tuple[dict[int, int], set[tuple[int, int]], set[tuple[int, int]]]:
        """The style of each node with text in it, ``(node, text)`` and ``(node above or itself, node)``."""
        texts: set[tuple[int, int]] = set()
        some = [False] * len(self.tag)
        block = [0] * len(self.tag)  # the nearest element that is no inline one
        for e in range(1, len(self.tag)):
            block[e] = block[self.parent[e]] if self.tag[e] in INLINE else e
        for e, t in self.events:
            if t and not t.isspace():
                e = block[e]
                texts.add((self.key[e], xxhash.xxh64_intdigest(t.strip())))
                some[e] = True
        styles: dict[int, int] = {}
        pairs: set[tuple[int, int]] = set()
        above: dict[int, set[int]] = {}
        for e in range(len(self.tag) - 1, 0, -1):
            if some[e]:
                some[self.parent[e]] = True
        for e in range(1, len(self.tag)):
            if some[e] and block[e] == e:
                key = self.key[e]
                styles[key] = xxhash.xxh64_intdigest("\0".join(self.kids[e]), seed=styles.get(key, 0))
                if key not in above:
                    above[key] = above.get(self.key[block[self.parent[e]]], set()) | {key}
                    pairs.update((up, key) for up in above[key])
        return styles, texts, pairs

    def text(self, low: frozenset | set, names: bool = True) -> str:
        """The text that is left; ``low`` has nodes of low importance, and ``~node`` where only a named one is low."""

        def kept(by_importance: bool) -> str:
            gone = [False] * len(self.tag)
            for e in range(1, len(self.tag)):
                tag, core = self.tag[e], self.core[e]
                if gone[self.parent[e]]:
                    gone[e] = True
                elif core is True:
                    continue
                elif names and (self.noise[e] == 2 or self.noise[e] == 1 and core is False):
                    gone[e] = True
                elif by_importance and tag not in INLINE and tag not in ("html", "body") and not (core is None and tag in TEXT_BLOCKS):
                    hint = names and self.hint[e]
                    gone[e] = (hint or core is False) and self.key[e] in low or hint and ~self.key[e] in low
            blocks, own = [], []
            for e, t in self.events:
                if t is None:
                    if own:
                        blocks.append("".join(own))
                        own = []
                elif not gone[e]:
                    own.append(t)
            if own:
                blocks.append("".join(own))
            lines = (" ".join(b.split()) for b in blocks)
            return "\n".join(x for x in lines if x)

        return kept(True) or kept(False) if low else kept(False)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


STYLE, TEXT, ABOVE = range(3)


def _counter():
    """Pages to ``host, node, kind, value, n``: on how many pages of the host a node has a style, a text, or a node below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if source:
                    styles, texts, pairs = Page(source).nodes()
                    found.update((host, node, STYLE, style) for node, style in styles.items())
                    found.update((host, node, TEXT, text) for node, text in texts)
                    found.update((host, node, ABOVE, below) for node, below in pairs)
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array([_signed(x) for x in cols[1]], pa.int64()), pa.array(cols[2], pa.int32()), pa.array([_signed(x) for x in cols[3]], pa.int64()), pa.array(list(found.values()), pa.int64())],
                names=["host", "node", "kind", "value", "n"],
            )

    return run, "host string, node long, kind int, value long, n long"


def style_importance(pages: DataFrame, gamma: float = 0.9, work: Workspace | None = None) -> DataFrame:
    """``host, node, pages, importance`` of the style trees of ``pages(host, html)``."""
    run, schema = _counter()
    values = pages.select("host", "html").mapInArrow(run, schema).groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"))
    values = (work or Workspace(pages.sparkSession, "html")).settle(values, "values")

    def total(kind: int, c: Column):
        return F.sum(F.when(F.col("kind") == kind, c))

    one, spread = F.lit(1), F.log(F.col("n").cast("double"))
    own = values.filter(F.col("kind") != ABOVE).groupBy("host", "node").agg(
        total(STYLE, F.col("n")).alias("pages"), total(STYLE, F.col("n") * spread).alias("p"),
        F.coalesce(total(TEXT, one), F.lit(0)).alias("texts"), F.coalesce(total(TEXT, spread), F.lit(0.0)).alias("spread"),
    )
    log = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    own = own.select(
        "host", "node", "pages", "texts",
        F.when(F.col("pages") > 1, 1 - F.col("p") / F.col("pages") / log).otherwise(1.0).alias("presentation"),
        F.when(F.col("pages") > 1, F.col("texts") - F.col("spread") / log).otherwise(F.col("texts")).alias("content"),
    )
    above = values.filter(F.col("kind") == ABOVE).select("host", F.col("node").alias("up"), F.col("value").alias("node"))
    below = above.join(own.select("host", "node", "texts", "content"), ["host", "node"])
    below = below.groupBy("host", F.col("up").alias("node")).agg((F.sum("content") / F.sum("texts")).alias("content"))
    both = own.drop("content").join(below, ["host", "node"])
    return both.select("host", "node", "pages", ((1 - gamma) * F.col("presentation") + gamma * F.coalesce("content", F.lit(1.0))).alias("importance"))


def _lister():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                source = batch.column(3)[i].as_py()
                for node in Page(source).nodes()[0] if source else ():
                    rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), _signed(node)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["page_id", "row_key", "host", "node"])

    return run, "page_id long, row_key long, host string, node long"


def _signs(marked) -> frozenset:
    """Of ``(node, low)`` the node where low, else its complement, which stands for "low if named"."""
    return frozenset(x["node"] & (1 << 64) - 1 if x["low"] else ~(x["node"] & (1 << 64) - 1) for x in marked)


def _extractor(shared, names: bool):
    """Rows ``page_id, url, host, html, low`` to texts; ``low`` is null where the broadcast holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = shared.value if shared is not None else {}
        for batch in batches:
            texts = []
            for host, source, low in zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)], strict=True):
                nodes = _signs(low) if low else by_host.get(host, frozenset())
                texts.append(Page(source).text(nodes, names) if source else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return run, "page_id long, url string, text string, n_chars long"


def main_text(
    pages: DataFrame, threshold: float = 0.75, named_threshold: float = 0.88, min_pages: int = 8, gamma: float = 0.9, broadcast_nodes: int = 200_000, names: bool = True
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; without ``names``, no tag, class or id says anything by itself."""
    spark = pages.sparkSession
    work = Workspace(spark, "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), "html")
    low = style_importance(rows, gamma, work).filter((F.col("pages") >= min_pages) & (F.col("importance") < named_threshold))
    low = work.settle(low.select("host", "node", (F.col("importance") < threshold).alias("low")), "low")
    if low.count() <= broadcast_nodes:
        by_host: dict[str, list] = {}
        for r in low.collect():
            by_host.setdefault(r.host, []).append(r)
        run, schema = _extractor(spark.sparkContext.broadcast({h: _signs(x) for h, x in by_host.items()}), names)
        return rows.withColumn("low", F.lit(None).cast("array<struct<node:long,low:boolean>>")).mapInArrow(run, schema)
    run, schema = _lister()
    keyed = rows.withColumn("row_key", F.xxhash64("html"))
    own = keyed.select("page_id", "row_key", "host", "html").mapInArrow(run, schema).distinct().join(low, ["host", "node"])
    own = own.groupBy("page_id", "row_key", "host").agg(F.collect_set(F.struct("node", "low")).alias("low")).withColumnsRenamed({"page_id": "p", "row_key": "k", "host": "h"})
    run, schema = _extractor(None, names)
    joined = keyed.join(own, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("row_key") == F.col("k")) & (F.col("host") == F.col("h")), "left")
    return joined.select("page_id", "url", "host", "html", "low").mapInArrow(run, schema)
