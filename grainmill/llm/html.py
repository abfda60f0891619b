"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream is read as nested sequences of tags and texts. Aligning it with a host's expression resolves each
mismatch: a run of like siblings becomes a repeated group, siblings that one side lacks become optional, texts that
differ become a text slot, texts that agree stay template text. Alignment is folded over all pages: a task folds the
pages of each host that it reads into one partial expression, and a host's partial expressions (one per task, however
many pages the host has) are folded into its wrapper. So a host with a third of all pages is pre-aggregated, and no
page is sampled.

The wrapper tells what a part of a page is. Text that never varies over pages of a host is the host's, not the page's:
notices, adverts, sharing lines. In regions that the markup names as article or main, the wrapper drops boxes (BOXES) whose
text is the same wherever they stand, on SEEN pages at least and on half of those that have the region; headings,
paragraphs, list items and the like may be alike on many pages and stay. Without such regions, it drops any block that
never varies or is mostly links. Only pages of different text count, so copies of one page keep theirs: an item of a wrapper
holds the SEEN smallest hashes of the texts of pages that have it.
Rules by tag and by words of class and id hold for every page, also where a host has one page only.

Null and empty html give an empty text, as do pages without text. Broken, unclosed and cut-off markup is read as far as
it goes, and nesting of any depth, too. A null url is a host of its own. Repeated rows are returned each. An empty table gives an empty result. Only
the named columns are read."""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.words import slices
from grainmill.session import Written

#: Bytes of all wrappers that are broadcast at most; more are joined to the pages by host.
BROADCAST_BYTES = 16 << 20
#: Levels that expressions hold; what is nested deeper is one slot that varies, so wrappers decide nothing on it. Pages are
#: read to any depth.
DEEP = 200
#: Pages of different text on which a block must be the same to be a host's.
SEEN = 3
#: Hosts whose partial wrappers a task holds at once.
HOSTS = 4096

# HTML element names by kind, and words of class and id that name page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object select".split())
BLOCK = set("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("head script style title noscript template iframe svg math object select nav aside footer form button textarea input dialog menu".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"br", "html", "body"}
SCOPE = set("table ul ol dl article section div body td th blockquote main aside nav footer header form".split())
FURNITURE = set(
    "ad ads advert adverts advertisement adsbygoogle sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay toast newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations comment comments reply replies respond responses disqus discussion breadcrumb breadcrumbs pagination pager menu menus nav navbar navigation "
    "sidebar sidebars aside widget widgets footer toolbar login search skip".split()
)
BOXES = {"div", "section", "fieldset", "details", "figure"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "sig", "kids", "bad")

    def __init__(self, tag: str, sig: str, bad: bool):
        self.tag, self.sig, self.kids, self.bad = tag, sig, [], bad


def _start(tag: str, raw: str) -> Node:
    """Signature: tag, class and id without digits; bad: furniture by tag, role, class, id, or hidden."""
    bad = tag in DROPPED
    if not raw or raw == "/":
        return Node(tag, tag, bad)
    at = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(raw)}
    names = f"{at.get('class', '')} {at.get('id', '')}"
    sig = ".".join([tag, *sorted(set(re.sub(r"[\d]+", "", names).split()))])
    if tag not in ("html", "body", "article", "main"):
        bad = bad or "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower() or at.get("role", "").lower() in ROLES
        bad = bad or not FURNITURE.isdisjoint(w.lower() for w in WORDS.findall(names))
    if at.get("role", "").lower() in ("main", "article") or at.get("itemprop", "") == "articleBody":
        return Node("main", sig, False)
    return Node(tag, sig, bad)


def parse(text: str) -> Node:
    """The tree of a page; texts are kids of type str, with character references decoded."""
    top = Node("#", "#", False)
    stack, at = [top], 0

    def say(chunk: str) -> None:
        if chunk:
            stack[-1].kids.append(entities.unescape(chunk))

    size = len(text)
    while at < size:
        m = TOKEN.search(text, at)
        if not m:
            say(text[at:])
            break
        say(text[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or (stack[k].tag == "main" and stack[k].sig.split(".")[0] == tag):
                    del stack[k:]
                    break
            continue
        closing = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closing:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        node = _start(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(text, at)
            at = end.end() if end else size
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
    return top


# -- expressions: [signature, flags, kids, pages, chars, link chars, hashes of pages]; a text is ["", flags, value or None, ...]

OPTIONAL, REPEATED = 1, 2


def expression(top: Node) -> list:
    """The expression of one page."""
    return _expression(top, False, 0, zlib.crc32(_said(top, None).encode("utf-8", "surrogatepass")))


def _expression(node: Node, linked: bool, depth: int, page: int) -> list:
    linked = linked or node.tag == "a"
    if depth == DEEP:
        return [node.sig, 0, [["", 0, None, 1, 0, 0]], 1, 0, 0, [page]]
    kids = []
    for kid in node.kids:
        if isinstance(kid, str):
            if said := " ".join(kid.split()):
                kids.append(["", 0, zlib.crc32(said.encode("utf-8", "surrogatepass")), 1, len(said), len(said) * linked])
        else:
            kids.append(_expression(kid, linked, depth + 1, page))
    kids = _repeats(kids)
    return [node.sig, 0, kids, 1, sum(k[4] for k in kids), sum(k[5] for k in kids), [page]]


def _repeats(items: list) -> list:
    """Runs of like items, and of like pairs of items, as repeated groups."""
    out: list = []
    for x in items:
        if out and out[-1][0] == x[0]:
            out[-1] = _merge(out[-1], x)
            out[-1][1] |= REPEATED
            out[-1][3] = 1
        elif len(out) >= 3 and out[-2][0] == x[0] and out[-3][0] == out[-1][0]:
            last = out.pop()  # a b a + b: the pair repeats, its members become repeated
            out[-2], out[-1] = _merge(out[-2], last), _merge(out[-1], x)
            for k in (-2, -1):
                out[k][1] |= REPEATED
                out[k][3] = 1
        else:
            out.append(x)
    return out


def _merge(a: list, b: list) -> list:
    """The expression of two with the same signature."""
    if not a[0]:
        return ["", a[1] | b[1], a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4], a[5] + b[5]]
    seen = a[6] if a[6] == b[6] else sorted({*a[6], *b[6]})[:SEEN]
    return [a[0], a[1] | b[1], align(a[2], b[2]), a[3] + b[3], a[4] + b[4], a[5] + b[5], seen]


def align(a: list, b: list) -> list:
    """Longest common sequence by signature; what only one side has is optional."""
    n, m = len(a), len(b)
    head = 0
    while head < n and head < m and a[head][0] == b[head][0]:
        head += 1
    out = [_merge(a[k], b[k]) for k in range(head)]
    if head == n == m:
        return out
    best = [[0] * (m - head + 1) for _ in range(n - head + 1)]
    for i in range(n - head - 1, -1, -1):
        for j in range(m - head - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[head + i][0] == b[head + j][0] else max(best[i + 1][j], best[i][j + 1])
    i = j = head
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i - head + 1][j - head] >= best[i - head][j - head + 1]):
            out.append([a[i][0], a[i][1] | OPTIONAL, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], b[j][1] | OPTIONAL, *b[j][2:]])
            j += 1
    return _repeats_kept(out)


def _repeats_kept(items: list) -> list:
    """Adjacent like groups that alignment left side by side."""
    out: list = []
    for x in items:
        if out and out[-1][0] == x[0]:
            pages = max(out[-1][3], x[3])
            out[-1] = _merge(out[-1], x)
            out[-1][1] |= REPEATED
            out[-1][3] = pages
        else:
            out.append(x)
    return out


def _varies(x: list) -> bool:
    return x[2] is None if not x[0] else any(_varies(k) for k in x[2])


def _match(kids: list, items: list) -> list:
    """For each kid of a page the wrapper's item that it stands for, or None."""
    at, out = 0, []
    for kid in kids:
        sig = "" if isinstance(kid, str) else kid.sig
        found = next((k for k in range(at, len(items)) if items[k][0] == sig), None)
        if found is None:
            found = next((k for k in range(at) if items[k][0] == sig), None)
        else:
            at = found
        out.append(None if found is None else items[found])
    return out


# -- extraction ------------------------------------------------------------------------------------------------------


def _regions(top: Node) -> list[list[Node]]:
    """Topmost article (else main) elements outside furniture, each as the elements from the top down to it."""
    for wanted in ("article", "main"):
        found, todo = [], [(top, None)]
        while todo:
            here = todo.pop()
            if here[0].tag == wanted:
                found.append(here)
            else:
                todo += [(k, here) for k in reversed(here[0].kids) if not isinstance(k, str) and not k.bad]
        if found:
            return [_path(x) for x in found]
    return []


def _path(here: tuple | None) -> list[Node]:
    path = []
    while here:
        path.append(here[0])
        here = here[1]
    return path[::-1]


class Page:
    def __init__(self):
        self.blocks: list[str] = []
        self.now: list[str] = []

    def flush(self) -> None:
        if said := " ".join("".join(self.now).split()):
            self.blocks.append(said)
        self.now = []

    def take(self, region: Node, wrapper: list | None, named: bool) -> None:
        """named: the region is an article by its markup. wrapper: the region's item, or None."""
        template = wrapper is not None and len(wrapper[6]) >= SEEN and _varies(wrapper)
        often = wrapper[3] / 2 if wrapper else 0
        todo: list = [(region, wrapper, False)]  # None ends a block; the last of three: headings only
        while todo:
            step = todo.pop()
            if step is None:
                self.flush()
                continue
            if isinstance(step, str):
                self.now.append(step)
                continue
            node, item, headings = step
            parts: list = []
            for kid, of in zip(node.kids, _match(node.kids, item[2]) if item else [None] * len(node.kids), strict=True):
                if isinstance(kid, str):
                    if not headings:
                        parts.append(kid)
                elif kid.bad:
                    continue
                elif headings and kid.tag not in HEADINGS:
                    parts.append((kid, None, True))
                elif kid.tag == "header":
                    if named:
                        parts.append((kid, None, True))
                elif kid.tag not in BLOCK:
                    parts.append((kid, of, False))
                elif not self.furniture(kid, of, named, template, often):
                    parts += [None, (kid, of, False), None]
            todo += reversed(parts)

    @staticmethod
    def furniture(kid: Node, item: list | None, named: bool, template: bool, often: float) -> bool:
        """Whether the wrapper says that a block is the host's and not the page's."""
        if item is None:
            return False
        constant = template and len(item[6]) >= SEEN and not _varies(item)
        if named:
            return constant and kid.tag in BOXES and item[4] > 0 and item[3] >= often
        return constant or item[5] > 0.5 * item[4] > 0


def main_text(page: str | None, wrapper: list | None = None) -> str:
    if not page:
        return ""
    return _said(parse(page), wrapper)


def _said(top: Node, wrapper: list | None) -> str:
    out = Page()
    regions = _regions(top)
    for path in regions or [[top]]:
        item = wrapper
        for walk, below in zip(path, path[1:], strict=False):  # follow the wrapper down to the region
            if item is None:
                break
            item = next(w for k, w in zip(walk.kids, _match(walk.kids, item[2]), strict=True) if k is below)
        out.take(path[-1], item, bool(regions))
        out.flush()
    return " ".join(out.blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))


def _pack(x: list) -> bytes:
    return zlib.compress(json.dumps(x, separators=(",", ":")).encode(), 1)


def _open(blob: bytes) -> list:
    return json.loads(zlib.decompress(blob))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): the expression that all pages of a host were aligned to."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([_pack(x) for x in held.values()], pa.binary())], names=["host", "wrapper"])
            held.clear()
            return out

        for batch in slices(batches):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    own = expression(parse(page))
                    held[host] = _merge(held[host], own) if host in held else own
            if len(held) > HOSTS:
                yield done()
        yield done()

    def join(group: pa.Table) -> pa.Table:
        parts = [_open(b) for b in sorted(group.column("wrapper").to_pylist())]
        whole = parts[0]
        for x in parts[1:]:
            whole = _merge(whole, x)
        return pa.table({"host": [group.column("host")[0].as_py()], "wrapper": pa.array([_pack(whole)], pa.binary())})

    parts = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("text")).mapInArrow(fold, "host string, wrapper binary")
    return parts.groupBy("host").applyInArrow(join, "host string, wrapper binary")


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) per row."""
    keep = Written(spark)
    known = keep(wrappers(pages, url_col, html_col), "wrappers")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("text"))
    fits = (known.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES
    if fits:  # the size has been checked
        held = spark.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in known.collect()})
        rows = rows.withColumn("wrapper", F.lit(None).cast("binary"))
    else:
        held = None
        rows = rows.join(known, "host", "left")
    rows = rows.select("page_id", "url", "host", "text", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[bytes, list] = {}
        for batch in slices(batches):
            texts = []
            for host, page, blob in zip(*(batch.column(c).to_pylist() for c in ("host", "text", "wrapper")), strict=True):
                blob = held.value.get(host) if held else blob
                if blob and blob not in opened:
                    if len(opened) > HOSTS:
                        opened.clear()
                    opened[blob] = _open(blob)
                texts.append(main_text(page, opened.get(blob) if blob else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grainmill.session import table

    return extract(spark, table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
