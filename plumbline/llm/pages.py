"""Main text of web pages by a style tree for every site.

Every page becomes a small DOM; a block is the text of one block-level element, and
its node is the path of element labels (tag, id and class words) above it.  The
pages of one host are merged: for each node, how many pages have it and how its
contents are spread over them.  A node's importance has two parts.

* Presentation: elements whose tag, or a whole class, id or role, says menu, footer,
  advert, script, style or comments have none (``HARD``), an ``article`` whose class says comment too.  Forms, headers, sidebars, notices and the like
  have little (``SOFT``): articles inside them and such elements inside articles count in full, and where
  they have more text than all else of the page, they count too.  An ``article`` or
  ``main`` is a prior: its branch alone counts if it has at least half of the text left.
* Content: the entropy of the node's contents over the host's pages, in units of
  the largest possible one, and the information of each single content, in the same units.  A node or
  content that at least ``LEAST_PAGES`` pages share and whose importance is under
  ``LEAST_IMPORTANCE`` is a site's repeated block, inside articles too.  A heading in
  an article has the importance of the blocks below it, up to the next heading.

Branches of low importance are removed from each page; if nothing would be left,
only presentation counts, and where that leaves nothing either, the branch with most text.  White space in a block becomes one blank, blocks are
joined by two line feeds.

Null and empty html give the empty text.  Null urls and urls without a host form a
site of their own each.  Repeated rows are answered each.  Empty tables give no rows.
Only page_id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST_PAGES = 2
LEAST_IMPORTANCE = 0.2
#: Sites whose lists of removed nodes are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_SITES = 100_000

# Element kinds and the words that mark what is no article.
BLOCK = frozenset("address article aside blockquote body br_ caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math select option object canvas title".split())
DROP_TAGS = frozenset("nav header footer aside form button dialog menu head".split()) | RAW
DROP_WORDS = frozenset("ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer foot sidebar aside rail widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply form search pagination pager copyright legal disclaimer".split())
SOFT_TAGS = frozenset("form header".split())
SOFT_WORDS = frozenset("header masthead sidebar rail form search notice notices legal disclaimer copyright".split())
#: How much presentation speaks against a block.
FULL, SOFT, HARD = 0, 1, 2
CLOSES = {"p": frozenset("p".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
INLINE_KEEPS_P = frozenset("a abbr b bdi bdo big br button cite code data dfn em font i img input kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

HEADING = re.compile(r"h[1-6](?:\.|$)")
# Words by which an article element is a reader's comment.
COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


def blocks(source: str) -> list[tuple[str, int, bool, str]]:
    """(node path, dropped by presentation (FULL, SOFT, HARD), in an article, text) of every block with text, in page order."""
    out: list[tuple[str, int, bool, str]] = []
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, dropped, in an article
    held: list[tuple[str, int]] = []  # text, dropped
    at, end = 0, len(source)

    def flush() -> None:
        if held:
            path, base, article = next(((p, d, a) for t, p, d, a in reversed(stack) if t in BLOCK), ("", FULL, False))
            # Inline elements of less importance leave their block's text; if nothing else is in it, they are the block.
            level = min(max(base, d) for x, d in held if not x.isspace()) if any(not x.isspace() for x, _ in held) else base
            text = _SPACE.sub(" ", entities.unescape("".join(x for x, d in held if d <= level))).strip()
            held.clear()
            if text:
                out.append((path, level, article, text))

    def hold(text: str) -> None:
        held.append((text, stack[-1][2] if stack else FULL))

    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            hold(source[at:])
            break
        if m.start() > at:
            hold(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if place is not None:
                if any(t in BLOCK for t, *_ in stack[place:]):
                    flush()
                del stack[place:]
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = close.end() if close else (end if tag in ("script", "style", "title", "textarea") else at)
            continue
        if tag in ("br", "hr"):
            hold(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK:
            flush()
            closes = CLOSES.get(tag, frozenset()) | (frozenset(["p"]) if tag in BLOCK else frozenset())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        names = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m[3])} if m[3] else {}
        label = tag + "".join(f".{w}" for w in sorted({*(names.get("class") or "").lower().split(), *(names.get("id") or "").lower().split()}))
        words = {w for v in (names.get("class"), names.get("id"), names.get("role")) if v for w in v.lower().split()}
        path, dropped, article = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else ("", FULL, False)
        root = tag in ("article", "main") and not words & COMMENT_WORDS
        if root and dropped == SOFT:
            dropped = FULL
        own = FULL
        if tag in DROP_TAGS or words & DROP_WORDS and not root and tag not in ("body", "html"):
            own = HARD if tag in DROP_TAGS - SOFT_TAGS or words & DROP_WORDS - SOFT_WORDS else FULL if article else SOFT
        stack.append((tag, f"{path}/{label}" if tag in BLOCK else path, max(dropped, own), article or root))
    flush()
    return out


def host(url: str | None) -> str | None:
    try:
        return (urlsplit(url).netloc or None) if url else None
    except ValueError:
        return None


def content(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def best_branch(found: list[tuple[str, int, bool, str]]) -> list[tuple[str, int, bool, str]]:
    """The blocks of the parent element whose blocks have most text."""
    size: dict[str, int] = {}
    for path, _, _, text in found:
        parent = path.rpartition("/")[0]
        size[parent] = size.get(parent, 0) + len(text)
    best = max(size, key=size.__getitem__, default="")
    return [b for b in found if b[0].rpartition("/")[0] == best]


def important(found: list[tuple[str, int, bool, str]], low: frozenset[str]) -> list[bool]:
    """Whether each block's node and content have importance; a heading in an article has that of what stands below it.

    So a heading that all articles of a site have stays where its section differs, and goes with a section that repeats.
    """
    out = [b[0] not in low and f"{b[0]}\n{content(b[3])}" not in low for b in found]
    below: bool | None = None
    for i in range(len(found) - 1, -1, -1):
        path, _, article, _ = found[i]
        if article and HEADING.match(path.rpartition("/")[2]):
            out[i], below = out[i] or bool(below), None
        else:
            below = bool(below) or out[i] if article else None
    return out


def main_text(found: list[tuple[str, int, bool, str]], low: frozenset[str]) -> str:
    """The blocks that stay, given the host's nodes, and contents of nodes, of low content importance."""
    size = lambda level: sum(len(b[3]) for b in found if b[1] == level)
    most = SOFT if size(SOFT) > size(FULL) else FULL
    kept = [b for b in found if b[1] <= most] or best_branch(found)
    kept = [b for b, stays in zip(kept, important(kept, low), strict=True) if stays] or kept
    inside = [b for b in kept if b[2]]
    if 2 * sum(len(b[3]) for b in inside) >= sum(len(b[3]) for b in kept):
        kept = inside
    return "\n\n".join(t for *_, t in kept)


def importance(pages: DataFrame) -> DataFrame:
    """site, node, pages, importance: the merged style trees of all hosts.

    A content that more than one page has at a node follows as a node of its own: the path, a line feed and its hash.
    """

    def nodes(batches):
        for batch in batches:
            out: set | list = []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                site = host(url)
                if site is not None and source:
                    # Contents of one node in a page count as one.
                    of: dict[str, list[str]] = {}
                    for path, _, _, text in blocks(source):
                        of.setdefault(path, []).append(text)
                    out += [(site, p, content("\n".join(t)), False) for p, t in of.items()]
                    out += [(site, p, c, True) for p, t in of.items() for c in {content(x) for x in t}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.bool_())], names=["site", "node", "content", "single"])

    seen = pages.select("url", "html").mapInArrow(nodes, "site string, node string, content long, single boolean").groupBy("site", "node", "content", "single").agg(F.count("*").alias("n"))
    seen = shared.written(seen.filter("not single or n > 1"), "style-contents")
    total = seen.filter("not single").groupBy("site", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    # The entropy of the shares n/m is ln m - sum(n ln n)/m; its largest value is ln m.
    nodes_of = total.select("site", "node", "pages", F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.ln("pages"))).otherwise(1.0).alias("importance"))
    # A content of n of the node's m pages tells ln m - ln n.
    single = seen.filter("single").join(total.select("site", "node", "pages"), ["site", "node"])
    return nodes_of.unionByName(single.select("site", F.concat_ws("\n", "node", "content").alias("node"), F.col("n").alias("pages"), (1 - F.ln("n") / F.ln("pages")).alias("importance")))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    low = importance(pages).filter((F.col("pages") >= least_pages) & (F.col("importance") < least)).groupBy("site").agg(F.collect_list("node").alias("low"))
    low = shared.written(low, "style-trees")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def run(removed):
        def texts(batches):
            for batch in batches:
                lists = batch.column("low").to_pylist() if removed is None else [None] * batch.num_rows
                out = []
                for url, source, nodes in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), lists, strict=True):
                    out.append(main_text(blocks(source or ""), frozenset(nodes or ()) if removed is None else removed.get(host(url), frozenset())))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return texts

    schema = "page_id long, url string, text string, n_chars long"
    few = low.limit(BROADCAST_SITES + 1).toArrow()
    if few.num_rows <= BROADCAST_SITES:
        return rows.mapInArrow(run({s: frozenset(n) for s, n in zip(few["site"].to_pylist(), few["low"].to_pylist(), strict=True)}), schema)
    site = F.udf(host, "string")
    return rows.withColumn("site", site("url")).join(low, "site", "left").select("page_id", "url", "html", "low").mapInArrow(run(None), schema)


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.table(spark, sf_dir, "pages"))
