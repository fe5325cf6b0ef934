"""Main text of web pages, by the template that pages of one host share.

Tokens of a page are its block tags, told apart by their ancestors, and its text blocks, told apart by the tag they stand in. The
occurrence vector of a token says how often each page of the host holds it; tokens with one vector form an equivalence class.
Vectors are compared by sums of hashes that Spark adds up per token, so no task sees a whole host. A class counts if it stands on
at least ``LEAST_PAGES`` pages of different content and holds a tag. Classes are nested by the elements: a text belongs to the
template if an element around it has the text's own class, i.e. if the text is there whenever that element is. What is left are
slots. Slots with mostly linked text over the host, and regions that tags, roles or names mark as menus, headers, footers,
sidebars, notices, adverts, forms or comments, hold no main text; where a page has ``article`` or ``main`` elements, the slots
inside them are the main text, else all that remain. A page that would lose more than half of its main text to the template is
one of many copies and keeps it.

The host is what stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; pages without one, and hosts with
fewer pages, are judged without a template. Malformed html is read as browsers do in the main: unclosed elements end with what
encloses them, comments, scripts and styles without an end reach to the end of the page. ``br`` is white space, every other block
tag ends a block; character references are decoded, white space is one space, blocks are joined by one line feed. A null or empty
``html`` gives an empty text; pages are read whole, however long, in time linear in their length; repeated rows give repeated
results and count as so many pages; a null ``page_id`` or ``url`` stays null; an empty table gives no rows. Only ``page_id``,
``url`` and ``html`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from holdfast.llm.common import stored

LEAST_PAGES = 3
#: Most roles of a template that every task holds (8 bytes each); beyond, pages get theirs by joins.
HELD = 1 << 21

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
UNSEEN = frozenset("head svg math template select button canvas object video audio datalist map dialog".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre search section summary table ul".split())
BLOCK = ENDS_P | frozenset("html body head li dt dd tr td th caption thead tbody tfoot legend option optgroup".split())
#: A start tag ends an open element of these names, unless one of the bounds lies between.
ENDS_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
# Fixed names of regions beside the main text, in elements, roles, classes and ids.
ASIDE_TAGS = frozenset("nav aside footer menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
ASIDE_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu"
    " menubar topnav sidenav breadcrumb breadcrumbs pagination pager sidebar rail aside footer cookie cookies consent gdpr notice"
    " notices disclaimer popup modal overlay lightbox newsletter subscribe subscription signup login share sharing social related"
    " recommended recommendations trending widget widgets comment comments respond reply replies disqus discussion form search"
    " searchbox toolbar skip".split())
#: Names that mark a region only outside of the main text: an article has a header of its own.
OUTER_NAMES = frozenset("header masthead topbar alert copyright".split())
_WHOLE = ("has", "with", "no", "without", "is", "not")

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_REST = re.compile(r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_DIGITS = re.compile(r"\d+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Roles:
    """Hashes of paths; those seen before are remembered."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}

    def of(self, parent: int, name: str) -> int:
        got = self.known.get((parent, name))
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = self.known[parent, name] = _signed(xxh64_intdigest(f"{parent:x} {name}".encode("utf-8", "replace")))
        return got


_ROLES = _Roles()
_SEEN: dict[tuple[str, str], tuple[str, int]] = {}
OUTER, INNER = 1, 2


def _judged(name: str, attributes: str) -> tuple[str, int]:
    """What tells a tag apart (its name, class and id without digits), and whether it marks a region that is no main text:
    ``OUTER`` outside of the main text only, ``INNER`` everywhere, 0 not at all."""
    got = _SEEN.get((name, attributes))
    if got:
        return got
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
    own = " ".join(sorted({_DIGITS.sub("", t) for t in tokens}))
    mark = INNER if name in ASIDE_TAGS else OUTER if name in ("header", "form") else 0
    if found.get("role", "").lower() in ASIDE_ROLES:
        mark = INNER
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        mark = INNER
    if name not in ("html", "body", "main") and mark != INNER:
        words: set[str] = set()
        for t in tokens:
            parts = [w.lower() for w in _NAME_WORDS.findall(t)]
            if parts and parts[0] not in _WHOLE and (name != "article" or len(parts) == 1):
                words.update(parts)
        mark = INNER if words & ASIDE_NAMES else OUTER if words & OUTER_NAMES else mark
    if name == "main" or found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody":
        mark = -1
    if len(_SEEN) > 50_000:
        _SEEN.clear()
    _SEEN[name, attributes] = f"{name} {own}" if own else name, mark
    return _SEEN[name, attributes]


class Page:
    """Tags and text blocks of one page; ``root`` keeps the roles of different hosts apart."""

    __slots__ = ("tags", "blocks", "has_main")

    def __init__(self, html: str, root: int = 0) -> None:
        #: role -> how often, role of the parent, characters right inside, of these linked
        self.tags: dict[int, list[int]] = {}
        #: text, role of the tag around it, in a main element, in a region that is no main text
        self.blocks: list[tuple[str, int, bool, bool]] = []
        self.has_main = False
        self._read(html, root)

    def _read(self, html: str, root: int) -> None:
        # an open element: name, role, is a block, main, marked, unseen, link
        stack = [("", root, True, False, 0, False, False)]
        name, role, _, main, marked, unseen, link = stack[0]
        open_: dict[str, int] = {}
        pieces: list[str] = []
        linked, at, n, tags, blocks = 0, 0, len(html), self.tags, self.blocks
        in_article = 0  # blocks of the outermost article so far

        def close(depth: int) -> None:
            while len(stack) > depth:
                open_[stack.pop()[0]] -= 1

        def end_block() -> None:
            nonlocal pieces, linked, in_article
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    slot = next(e for e in reversed(stack) if e[2])
                    blocks.append((text, slot[1], slot[3], slot[4] > 0))
                    in_article += slot[3] and not slot[4]
                    if slot[1] in tags:
                        tags[slot[1]][2] += len(text)
                        tags[slot[1]][3] += min(linked, len(text))
                pieces, linked = [], 0

        def text_of(first: int, last: int) -> None:
            nonlocal linked
            if first < last and not unseen:
                piece = html[first:last]
                if "&" in piece:
                    piece = unescape(piece)
                pieces.append(piece)
                if link:
                    linked += len(piece.strip())

        while at < n:
            m = _TAG.search(html, at)
            if not m:
                text_of(at, n)
                break
            text_of(at, m.start())
            if m[1]:
                end = html.find("-->", m.start() + 2)
                at = n if end < 0 else end + 3
                continue
            if not m[3]:
                end = html.find(">", m.end())
                at = n if end < 0 else end + 1
                continue
            name = m[3].lower()
            rest = _REST.match(html, m.end())
            if not rest:  # a tag without end
                break
            at = rest.end()
            block = name in BLOCK
            if m[2]:  # an end tag
                if block:
                    end_block()
                if open_.get(name):
                    depth = len(stack) - 1
                    while stack[depth][0] != name:
                        depth -= 1
                    if not block and any(e[2] for e in stack[depth:]):
                        continue  # an inline end tag does not end the blocks inside
                    close(depth)
                    _, role, _, main, marked, unseen, link = stack[-1]
                continue
            if block or name in RAW:
                if block:
                    end_block()
                if open_.get("head") and name not in IN_HEAD and name != "head":
                    close(next(i for i, e in enumerate(stack) if e[0] == "head"))
                if name in ENDS_P and open_.get("p"):
                    close(max(i for i, e in enumerate(stack) if e[0] == "p"))
                if name in ENDS_LIKE:
                    names, bounds = ENDS_LIKE[name]
                    if any(open_.get(x) for x in names):
                        depth, cut = len(stack) - 1, 0
                        while depth and stack[depth][0] not in bounds:
                            if stack[depth][0] in names:
                                cut = depth
                            depth -= 1
                        if cut:
                            close(cut)
                _, role, _, main, marked, unseen, link = stack[-1]
            if name in RAW:
                end = _ENDS[name].search(html, at)
                rest = end and _REST.match(html, end.end())
                at = rest.end() if rest else n
                continue
            if name in VOID:
                if name == "br":
                    pieces.append(" ")
                continue
            own, mark = _judged(name, html[m.end():rest.end() - 1])
            parent, inside = role, main
            if mark < 0:
                main, marked = True, 0
                self.has_main |= not unseen
            elif name == "article":
                nested = inside and open_.get("article") and in_article
                marked = INNER if mark == INNER or nested or marked == INNER else 0
                main = main or not marked
                self.has_main |= not marked and not unseen
                if not open_.get("article"):
                    in_article = 0
            elif mark == INNER or mark == OUTER and not main:
                marked = max(marked, mark)
            elif name == "form":  # outside, a form may hold the whole page
                marked = INNER
            unseen = unseen or name in UNSEEN or not block and mark == INNER
            link = link or name == "a"
            if block:
                role = _ROLES.of(parent, own)
                if not unseen:
                    found = tags.get(role)
                    if found:
                        found[0] += 1
                    else:
                        tags[role] = [1, parent, 0, 0]
            stack.append((name, role, block, main, marked, unseen, link))
            open_[name] = open_.get(name, 0) + 1
        end_block()

    def texts(self) -> dict[int, list[int]]:
        """Roles of the text blocks outside marked regions: how often, role of the tag around."""
        out: dict[int, list[int]] = {}
        for text, slot, _, marked in self.blocks:
            if not marked:
                role = _signed(xxh64_intdigest(text.encode("utf-8", "replace"), slot & (1 << 64) - 1))
                if role in out:
                    out[role][0] += 1
                else:
                    out[role] = [1, slot]
        return out

    def main_text(self, template) -> str:
        """The main text, given what tells which roles (an array of them) are texts of the template or slots of links."""
        kept = [(text, slot) for text, slot, main, marked in self.blocks if not marked and (main or not self.has_main)]
        if not kept:
            return ""
        roles = np.array([_signed(xxh64_intdigest(t.encode("utf-8", "replace"), s & (1 << 64) - 1)) for t, s in kept], np.int64)
        if not self.has_main:
            slots = template(np.array([s for _, s in kept], np.int64))
            mostly = lambda s: s in self.tags and 5 * self.tags[s][3] > 4 * self.tags[s][2]
            free = [i for i, (_, s) in enumerate(kept) if not slots[i] and not mostly(s)]
            kept, roles = [kept[i] for i in free], roles[free]
        same = template(roles)
        size = np.array([len(t) for t, _ in kept], np.int64)
        if 2 * size[same].sum() > size.sum():
            same = np.zeros(len(kept), bool)
        return "\n".join(t for (t, _), s in zip(kept, same) if not s)


def host_of(url: Column) -> Column:
    """Null where there is no host."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(host != "", host)


def _read(pages: DataFrame) -> DataFrame:
    """The three columns, the host's hash (0 for none) and a hash of the page's content."""
    return pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
        F.coalesce(F.when(host_of(F.col("url")).isNotNull(), F.xxhash64(host_of(F.col("url")))), F.lit(0)).alias("host"),
    ).withColumn("content", F.xxhash64("html"))


def _pages(b: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    for html, host in zip(b.column("html"), b.column("host").to_pylist()):
        yield html.as_py(), host


def tokens(read: DataFrame) -> DataFrame:
    """``host, role, parent, is_tag, page, content, times, chars, linked``: the tokens of every page of a host."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, unique = b.column("content").to_pylist(), b.column("page").to_pylist()
            rows: list[tuple] = []
            for i, (html, host) in enumerate(_pages(b)):
                page = Page(html, host)
                rows += [(host, r, up, True, unique[i], content[i], k, c, x) for r, (k, up, c, x) in page.tags.items()]
                rows += [(host, r, up, False, unique[i], content[i], k, 0, 0) for r, (k, up) in page.texts().items()]
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.bool_() if n == "is_tag" else pa.int64()) for n, c in zip(names, columns)], names=list(names))

    names = ("host", "role", "parent", "is_tag", "page", "content", "times", "chars", "linked")
    schema = ", ".join(f"{n} {'boolean' if n == 'is_tag' else 'long'}" for n in names)
    hosts = read.where("host != 0").select("html", "host", "content", F.xxhash64("content", "page_id", "url").alias("page"))
    return hosts.mapInArrow(of, schema)


def classes(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """``host, role, parent, is_tag, n_pages, times, v0, v1, chars, linked``: the tokens on enough pages of a host. Tokens of a
    host with equal ``n_pages, times, v0, v1`` have one occurrence vector, up to a chance of 2^-62 a pair."""
    vector = F.xxhash64("page", "times")
    half = lambda shift: F.sum(F.shiftrightunsigned(vector, shift).bitwiseAND(F.lit((1 << 31) - 1)))
    found = tokens(_read(pages)).groupBy("host", "role").agg(
        F.max("parent").alias("parent"), F.max("is_tag").alias("is_tag"), F.count("*").alias("n_pages"),
        F.sum("times").alias("times"), half(0).alias("v0"), half(31).alias("v1"), F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    return found.where((F.col("n_pages") >= least) & (F.col("lo") != F.col("hi"))).drop("lo", "hi")


def template_roles(found: DataFrame) -> DataFrame:
    """``host, role`` of what holds no main text: texts with the class of an element around them, slots of mostly links."""
    tags = found.where("is_tag").select("host", F.col("role").alias("up"), F.col("parent").alias("above"),
                                        *[F.col(c).alias(f"t_{c}") for c in ("n_pages", "times", "v0", "v1")])
    out = found.where("is_tag and 2 * linked > chars").select("host", "role")
    climbing = found.where("not is_tag").select("host", "role", F.col("parent").alias("up"), "n_pages", "times", "v0", "v1")
    same = (F.col("n_pages") == F.col("t_n_pages")) & (F.col("times") == F.col("t_times")) & (
        F.col("v0") == F.col("t_v0")) & (F.col("v1") == F.col("t_v1"))
    while not climbing.isEmpty():  # one step up the elements at a time, at most as many as elements are nested
        met = stored(climbing.join(tags, ["host", "up"]).withColumn("same", same), "html_template")
        out = out.unionByName(met.where("same").select("host", "role"))
        climbing = met.where("not same").select("host", "role", F.col("above").alias("up"), "n_pages", "times", "v0", "v1")
    return out.distinct()


def _marked_pages(read: DataFrame, roles: DataFrame) -> DataFrame:
    """``read`` with the roles of the template that occur on the page: what joins do in place of a table in every task."""
    of = tokens(read).select("host", "content", "role").join(roles, ["host", "role"])
    per_page = of.groupBy("host", "content").agg(F.collect_set("role").alias("roles"))
    return read.join(per_page, ["host", "content"], "left")


def extract(pages: DataFrame, least: int = LEAST_PAGES, held: int = HELD) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    spark, read = pages.sparkSession, _read(pages)
    roles = stored(template_roles(stored(classes(pages, least), "html_classes")), "html_template")
    every = None
    if roles.count() <= held:
        every = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in roles.select("role").collect()], np.int64)))
        rows = read.select("page_id", "url", "html", "host")
    else:
        rows = _marked_pages(read, roles).select("page_id", "url", "html", "host", "roles")

    def main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (html, host) in enumerate(_pages(b)):
                if every is not None:
                    known = every.value
                else:
                    known = np.sort(np.array(b.column("roles")[i].as_py() or [], np.int64))

                def template(x: np.ndarray, known: np.ndarray = known) -> np.ndarray:
                    if not len(known):
                        return np.zeros(len(x), bool)
                    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x

                out.append(Page(html, host).main_text(template))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(main, f"page_id {kind}, url string, text string, n_chars long")
