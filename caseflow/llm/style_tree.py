"""Main text of HTML pages by site style trees.

Method. The DOMs of all pages of a host are merged into one tree: a node is a
path of elements (tag and class or id, repeated siblings merged; what is nested
deeper than ``MAX_DEPTH`` belongs to its ancestor at that depth). Per node the
host's pages are counted, with the distinct ways its children are laid out
(presentation) and, for text, the distinct contents. A node whose layouts and
contents vary from page to page has high entropy and is important; one that is
the same everywhere has entropy 0: menus, notices, share bars, author boxes. An
entropy seen on few pages is drawn towards 1 (``PRIOR`` pages' worth), so one
page says nothing and evidence grows smoothly.

A node's composite importance is passed up the tree: the mean of the entropies in
its branch, its own and those of all nodes below, each weighted by its pages, the
length of its text and ``DECAY`` for every level in between. Branches below
``IMPORTANCE`` are dropped, inside ``article`` and ``main`` too, unless they hold
more than half of the host's varied text: that one is the article's branch, and
only parts of it may go. Names and elements that are by their meaning no article
text (``NOISE_TAGS``, names such as ``ad`` or ``post-comments``) are a prior
beside the tree: they go whatever their entropy, since comments vary, too. Pages of a
host with the same own text count once, so copies of a page do not look like a
menu, and a page that would lose all its text to the tree keeps it. A page
without other text keeps what stands below a form or such a name only if that
holds the page's ``h1`` or an element that is a page's section, since it then
wraps the page; an article below it starts clean. Notices, forms and comments
alone give empty text.

Statistics are partial counts ``(host, node, layout or content)`` combined before
the shuffle, so a host with a third of all pages is spread over its nodes; a
host comes back as the list of the tops of its unimportant branches.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import stage
from caseflow.llm.hashing import by_bytes

#: Elements that are no article text by their meaning.
NOISE_TAGS = frozenset("script style noscript template iframe object embed svg math canvas audio video nav footer aside form "
                       "button input select textarea label dialog menu head".split())
#: Names (class, id) of such blocks. A name counts if all its words, parted by hyphens or underscores, are of these:
#: ``cookie-notice``, but not ``no-sidebar`` or ``related-work``, about which importance decides.
_NOISE_WORD = (r"(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|banner|footer|sidebar|aside|widget|ads?|advert\w*|"
               r"sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|"
               r"comments?|commentlist|disqus|replies|reply|pagination|pager|toolbar|search|login|signup|copyright|legal|skip)")
#: Words that may stand beside a noise word in such a name, but make none themselves: ``post-comments``, ``share-buttons``.
_BESIDE = (r"(?:post|posts|article|articles|entry|page|site|top|bottom|box|bar|block|area|section|list|buttons?|links?|icons?|items?|"
           r"wrapper|container|form|user|reader)")
#: Names that hold a page's title or its text beside a noise word are none: ``article-header``, ``post-banner``.
_TITLE = r"(?![\w-]*(?:post|article|entry|page)s?[_-](?:header|banner|masthead))"
NOISE_NAMES = re.compile(rf"(?:^|\s)[_-]*{_TITLE}(?:{_BESIDE}[_-]+)*{_NOISE_WORD}(?:[_-]+(?:{_NOISE_WORD}|{_BESIDE}))*[_-]*(?:$|\s)"
                         r"|(?:^|\s)(?:author|about)[_-](?:author|bio|box|info|card)(?:$|\s)", re.I)
#: Elements that hold the article's own words; inside an article their name does not make them noise.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table caption thead tbody tfoot tr td th dl dt dd figcaption".split())
NOISE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"))
#: Elements inside a line of text; all others begin a new block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these kinds (omitted end tags).
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
_BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                          "main nav ol p pre section table ul".split())
_SCOPE = frozenset("article aside body div footer form header html li main nav ol section table td th ul".split())
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noframes"))  # no markup inside
_TOKEN = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(>?)|[!?][^>]*>?)""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

#: Noise by name or by an enclosing form may be a wrapper of the page; other noise never is.
WRAPPER, NOISE = 1, 2
#: Below a form or a noisy name these show that it wraps the page.
PAGE_PARTS = frozenset(("h1", "article", "main", "section"))
MAX_DEPTH = 64         # levels of the tree
PRIOR = 0.5            # pages' worth of entropy 1 that every node starts with
DECAY = 0.9            # weight of a branch's nodes for each level below its top
IMPORTANCE = 0.2       # branches below are dropped


def _decode(text: str) -> str:
    """Character references decoded; texts that only have ``&amp;`` take the short way."""
    n = text.count("&")
    if not n:
        return text
    return text.replace("&amp;", "&") if n == text.count("&amp;") else entities.unescape(text)


class _Dom:
    """A page as a list of (node path, noise by meaning, block number, text) and its layouts."""

    def __init__(self):
        self.stack: list[tuple[str, str, int]] = []  # tag, path, noise
        self.block = 0
        self.texts: list[tuple[str, int, int, str]] = []
        self.children: dict[str, list[str]] = {}
        self.wraps = False  # a part of a page stands below a form or a noisy name

    def feed(self, html: str) -> None:
        at, lower = 0, None
        for m in iter(lambda: _TOKEN.search(html, at), None):
            if m.start() > at:
                self.handle_data(_decode(html[at:m.start()]))
            at, tag = m.end(), (m[3] or "").lower()
            if m[1]:
                end = html.find("-->", at)
                at = len(html) if end < 0 else end + 3
            elif tag and not m[5]:  # a quote left open: the tag ends at the next bracket
                end = html.find(">", m.start())
                at = len(html) if end < 0 else end + 1
            if m[2] and tag:
                self.handle_endtag(tag)
            elif tag:
                attrs = m[4]
                self.handle_starttag(tag, [(k.lower(), _decode(v.strip("\"'"))) for k, v in _ATTRIBUTE.findall(attrs)] if attrs.strip("/ ") else [])
                if attrs.endswith("/") and tag not in VOID and tag not in _RAW:
                    self.handle_endtag(tag)
                if tag in _RAW:
                    lower = lower or html.lower()
                    end = lower.find("</" + tag, at)
                    end = len(html) if end < 0 else end
                    if tag in ("title", "textarea") and end > at:
                        self.handle_data(_decode(html[at:end]))
                    at = end
        if at < len(html):
            self.handle_data(_decode(html[at:]))

    def _path(self) -> str:
        return self.stack[-1][1] if self.stack else ""

    def _pop(self, at: int) -> None:
        for tag, _, _ in self.stack[at:]:
            if tag not in INLINE:
                self.block += 1
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.block += 1
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCKS_END_P else set())
        if ends:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    self._pop(i)
                    break
                if self.stack[i][0] in _SCOPE:
                    break
        a = {k: v or "" for k, v in attrs}
        name = " ".join(x for x in (a.get("class"), a.get("id")) if x)
        noise = self.stack[-1][2] if self.stack else 0
        inside = any(t in ("article", "main") for t, _, _ in self.stack)
        self.wraps |= noise == WRAPPER and tag in PAGE_PARTS and not NOISE_NAMES.search(name)
        if noise == WRAPPER and tag in ("article", "main") and not inside and not NOISE_NAMES.search(name):
            noise = 0  # an article below a noisy wrapper starts clean, one called a comment does not
        if noise < NOISE and tag not in ("html", "body", "article", "main"):
            names = re.sub(r"(?i)[\w-]*header[\w-]*", "", name) if inside else name  # an article's own header is its title
            if (tag in NOISE_TAGS and tag != "form" or tag == "header" and not inside
                    or a.get("role", "").lower() in NOISE_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
                    or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I) is not None):
                noise = NOISE
            elif tag == "form" or NOISE_NAMES.search(names) and not (inside and tag in PROSE):
                noise = WRAPPER
        label = tag + ("." + re.sub(r"\d+", "0", name).replace("/", "|") if name else "")
        parent = self._path()
        deep = len(self.stack) >= MAX_DEPTH
        if tag not in INLINE and tag != "br" and not deep:
            kids = self.children.setdefault(parent, [])
            if not kids or kids[-1] != label:
                kids.append(label)
        if tag not in VOID:
            self.stack.append((tag, f"{parent}/{label}" if tag not in INLINE and not deep else parent, noise))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
        if tag not in INLINE:
            self.block += 1

    def handle_data(self, data):
        if not data.isspace() or self.texts and self.texts[-1][2] == self.block:
            self.texts.append((self._path(), self.stack[-1][2] if self.stack else 0, self.block, data))


def parse(html: str | None) -> _Dom:
    dom = _Dom()
    if html:
        dom.feed(html)
    return dom


def _key(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _observe(batches):
    """One row for each node of each page: a hash of its layout, or of its own text; ``page`` is a hash of all own text."""
    for b in by_bytes(batches, "html"):
        rows = {"host": [], "page": [], "node": [], "kind": [], "value": [], "chars": []}
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            dom, own = parse(html), {}
            for path, noise, _, text in dom.texts:
                if not noise:
                    own.setdefault(path, []).append(" ".join(text.split()))
            page = hashlib.blake2b("\0".join(x for p, t in own.items() for x in (p, *t)).encode("utf-8", "surrogatepass"), digest_size=8)
            page = int.from_bytes(page.digest(), "big", signed=True)
            seen = [(p, 0, _key(",".join(c)), 0) for p, c in dom.children.items()]
            seen += [(p, 1, _key(x), len(x)) for p, x in ((p, " ".join(t)) for p, t in own.items())]
            for row in seen:
                for column, x in zip(rows.values(), (host, page, *row), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows.values(), _SEEN_TYPES, strict=True)], list(rows))


_SEEN = "host string, page bigint, node string, kind int, value bigint, chars bigint"
_SEEN_TYPES = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())


def style_tree(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` -> ``(host, node, pages, chars, presentation, content)``, entropies from 0 to 1.

    Base of the logarithm is the host's number of pages that have the node, so 1
    means different on every page. A node without children or text has null there;
    ``chars`` is the mean length of its text. Pages whose own text is the same are
    one page.
    """
    seen = pages.select("host", "html").mapInArrow(_observe, _SEEN)
    seen = seen.groupBy("host", "page", "node", "kind").agg(F.min(F.struct("value", "chars")).alias("v"))
    counts = seen.groupBy("host", "node", "kind", "v.value").agg(F.count(F.lit(1)).alias("n"), F.sum("v.chars").alias("chars"))
    # entropy = log N - sum(n log n) / N, so two sums that combine before the shuffle
    sums = counts.groupBy("host", "node", "kind").agg(F.sum("n").alias("pages"), F.sum("chars").alias("chars"),
                                                      F.sum(F.col("n") * F.log("n")).alias("s"))
    h = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    return sums.groupBy("host", "node").agg(
        F.max("pages").alias("pages"), F.max(F.when(F.col("kind") == 1, F.col("chars") / F.col("pages"))).alias("chars"),
        F.max(F.when(F.col("kind") == 0, h)).alias("presentation"), F.max(F.when(F.col("kind") == 1, h)).alias("content"))


def importance(tree: DataFrame) -> DataFrame:
    """``(host, node, importance, share)``: composite importance of each branch, and its share of the host's varied text.

    The nodes of a branch send their entropies to every ancestor; sums combine
    before the shuffle. A text node sends its content entropy, weighted by pages
    and text length; a node with children its layout's, weighted by pages alone.
    """
    smooth = lambda h: (F.lit(PRIOR) + F.col(h) * F.col("pages")) / (PRIOR + F.col("pages"))
    facts = F.array(F.struct((F.col("pages") * F.col("chars")).alias("w"), smooth("content").alias("h"), F.lit(True).alias("own")),
                    F.struct(F.col("pages").cast("double").alias("w"), smooth("presentation").alias("h"), F.lit(False).alias("own")))
    parts = F.split("node", "/")
    up = tree.withColumn("fact", F.explode(F.filter(facts, lambda f: f["w"].isNotNull() & f["h"].isNotNull())))
    up = up.select("host", "fact", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("level"))
    up = up.select("host", F.array_join(F.slice("parts", 1, F.col("level")), "/").alias("node"), F.col("fact.own").alias("own"),
                   F.col("fact.h").alias("h"), F.col("fact.w").alias("w"),
                   F.pow(F.lit(DECAY), F.size("parts") - F.col("level")).alias("decay"))
    weight, varied = F.col("w") * F.col("decay"), F.when(F.col("own"), F.col("w") * F.col("h")).otherwise(0.0)
    sums = up.groupBy("host", "node").agg(F.sum(weight * F.col("h")).alias("a"), F.sum(weight).alias("b"), F.sum(varied).alias("varied"))
    # every path begins at the empty root, so the root's sum is the host's
    roots = sums.where("node = ''").select(F.col("host").alias("_host"), F.col("varied").alias("_all"))
    j = sums.join(roots, sums["host"] == F.col("_host"))
    return j.select("host", "node", F.coalesce(F.try_divide("a", "b"), F.lit(1.0)).alias("importance"),
                    F.coalesce(F.try_divide("varied", "_all"), F.lit(0.0)).alias("share"))


def unimportant(tree: DataFrame, least: float = IMPORTANCE) -> DataFrame:
    """``(host, nodes)``: branches whose composite importance is below ``least``, but for those with over half of the
    host's varied text."""
    low = importance(tree).where((F.col("importance") < least) & (F.col("share") <= 0.5))
    return low.groupBy("host").agg(F.collect_set("node").alias("nodes"))


def _below(path: str, drop: set[str]) -> bool:
    """Whether a node lies in a dropped branch."""
    while path not in drop:
        if not path:
            return False
        path = path[:path.rindex("/")]
    return True


def _text(texts) -> str:
    blocks: dict[int, list[str]] = {}
    for _, _, block, text in texts:
        blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(t).split()) for t in blocks.values())
    return "\n".join(x for x in lines if x)


def _extract(names: list[str]):
    def run(batches):
        for b in by_bytes(batches, "html"):
            out = []
            for html, nodes in zip(b.column("html").to_pylist(), b.column("nodes").to_pylist(), strict=True):
                drop, dom = set(nodes or ()), parse(html)
                own = [x for x in dom.texts if not x[1]]
                gone = {p: _below(p, drop) for p in {x[0] for x in own}} if drop else {}
                text = _text(x for x in own if not gone.get(x[0])) or _text(own)
                out.append(text or (_text(x for x in dom.texts if x[1] == WRAPPER) if dom.wraps else ""))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(out, pa.string())], [*names, "text"])
    return run


def main_text(pages: DataFrame, least: float = IMPORTANCE) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, url, text)``, one row per input row.

    Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined by one newline in page order. Null or
    empty html: empty text. A null url is a host of its own. Pages of a
    host with the same own text count as one page. A page whose text the tree would
    drop as a whole keeps it. Text that stands below a noisy name or a form is left
    out, but where that wraps the whole page.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    p = pages.select("page_id", "url", "html", host.alias("host"))
    low = stage(unimportant(style_tree(p), least), "style-tree").withColumnRenamed("host", "low_host")
    j = p.join(low, p["host"] == low["low_host"], "left").select("page_id", "url", "html", "nodes")
    kinds = ", ".join(f"{c} {j.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return j.mapInArrow(_extract(["page_id", "url"]), f"{kinds}, text string")
