"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: its nodes are presentation
paths (element with class and id, from the root), an element node has the
sequences of child styles it occurs with, a content node the texts it holds. Over the m
pages with a node,

- a text that n of them share has the entropy log n / log m; a content node's
  importance is one less the mean entropy of its texts;
- an element node's own importance is the entropy (base m) of its sequences;
- a branch's is (1 - g^l) own + g^l content, l sequences, g = 0.9, content
  the mean over the content nodes below it, by their pages.

Branches of little importance that have a presentation of their own (a class,
an id) or stand outside a marked article are removed from each page, together
with the elements that say themselves that they are no article (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, comments: many sites fill
those anew on each page, which entropy can't tell from an article). Plain
paragraphs of an article are never removed, however often they repeat.

Pages are counted by their content, so copies of one page are one. All counts
are aggregates on (host, path, text); no host's pages meet anywhere.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import python_ready, stored

#: Importance below which a branch goes, and the pages that it has to be seen on.
LOW, MIN_PAGES, DECAY = 0.2, 5, 0.9

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg annotation annotation-xml canvas object select".split())
DROPPED = frozenset("head nav footer aside form dialog menu button label fieldset search input audio video map".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tooltip status".split())
#: Parts of a class or an id that name what isn't the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations comment comments commentlist disqus reply replies respond sidebar sidenav aside widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar pagination pager login search copyright skip hidden".split()
)
#: Whole classes that make an article element a foreign one.
FOREIGN = frozenset("comment reply related teaser promo ad ads advert sponsored recommended".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("table td th caption button object html body article section div main aside nav footer header form li dd dt blockquote figure".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CUT = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")


def _attributes(source: str) -> dict[str, str]:
    if not source.strip("/ \t\n"):
        return {}
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


@dataclass
class Node:
    tag: str
    path: str
    dropped: bool  # by what the element says of itself or of one that holds it
    article: bool
    main: bool
    styles: list[str] = field(default_factory=list)


@dataclass
class Block:
    path: str
    text: str
    dropped: bool
    article: bool
    main: bool


def _opened(tag: str, attributes: dict[str, str], inside: Node) -> Node:
    classes = attributes.get("class", "").split()
    named = attributes.get("id", "")
    style = tag + "".join(sorted({"." + _DIGITS.sub("0", c) for c in classes})) + ("#" + _DIGITS.sub("0", named) if named else "")
    role = attributes.get("role", "").lower()
    own_main = tag == "main" or role == "main"
    own_article = tag == "article" or role == "article"
    dropped = inside.dropped or tag in DROPPED or role in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
    dropped = dropped or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    if own_article:
        dropped = dropped or bool({c.lower() for c in classes} & FOREIGN)
    elif not own_main and tag not in ("html", "body"):
        parts = {p.lower() for c in (*classes, named) for p in _CUT.split(c)} & NAMES
        if inside.article or own_article:
            parts -= {"header"}
        dropped = dropped or bool(parts) or (tag == "header" and not inside.article)
    return Node(tag, f"{inside.path}/{style}", dropped, inside.article or own_article, inside.main or own_main)


def _raw_end(source: str, at: int, tag: str, blocks: list[str]) -> int:
    """Where an element without parsed content ends: after its end tag, or, but
    for scripts and styles, where one of the open `blocks` ends before that."""
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
    if tag in ("script", "style"):
        return end.end() if end else len(source)
    inner = []
    for m in _TAG.finditer(source, at, end.start() if end else len(source)):
        name = (m[2] or "").lower()
        if name not in BLOCKS:
            continue
        if not m[1]:
            if not end and blocks and blocks[-1] == "p":
                return m.start()  # a block ends an open paragraph
            inner.append(name)
        elif name in inner:
            while inner.pop() != name:
                pass
        elif name in blocks:
            return m.start()
    return end.end() if end else at


def parse(source: str) -> tuple[list[Block], list[Node]]:
    """The blocks of a page in order, and all its block elements. Forgiving:
    unclosed, misnested and cut-off elements hold what follows them."""
    root = Node("", "", False, False, False)
    stack, blocks, nodes, parts = [root], [], [], []
    holder = root

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append(Block(holder.path, text, holder.dropped, holder.article, holder.main))

    def close(at: int):
        nonlocal holder
        if any(n.tag in BLOCKS for n in stack[at:]):
            flush()
        del stack[at:]
        holder = stack[-1]

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        block = tag in BLOCKS
        if block:
            flush()
            ends, until = CLOSES.get(tag, ({"p"}, SCOPE))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    if tag not in ("tr",):
                        break
                elif stack[k].tag in until:
                    break
        node = _opened(tag, _attributes(m[3]), stack[-1])
        if tag in RAW:
            if tag in ("script", "style") or not m[3].rstrip().endswith("/"):
                at = _raw_end(source, at, tag, [n.tag for n in stack if n.tag in BLOCKS])
            continue
        if m[3].rstrip().endswith("/") and not block:
            continue
        if block:
            holder_of = next(n for n in reversed(stack) if n.tag in BLOCKS or n is root)
            holder_of.styles.append(node.path.rpartition("/")[2])
            nodes.append(node)
        elif not node.dropped or stack[-1].dropped:
            node.path = stack[-1].path  # inline elements have no place in the tree
        stack.append(node)
        if block or node.path != stack[-2].path:
            if not block:
                flush()
            holder = node
    flush()
    return blocks, nodes


def main_text(source: str | None, low: frozenset[str] | None = None) -> str:
    """The page's kept blocks, one a line. `low` has the paths of its site's
    branches of little importance, None if the site has too few pages to tell;
    then a marked article (main) that holds half of the text stands for the
    page, with the headings (h1) outside."""
    blocks, _ = parse(source or "")
    kept = [b for b in blocks if not b.dropped and not (low and _under(b.path, low))]
    for marked in (lambda b: b.article, lambda b: b.main):
        inside = sum(len(b.text) for b in kept if marked(b))
        if low is None and inside and 2 * inside >= sum(len(b.text) for b in kept):
            kept = [b for b in kept if marked(b) or "/h1" in b.path]
            break
    return "\n".join(b.text for b in kept)


def _under(path: str, low: frozenset[str]) -> bool:
    while path:
        if path in low:
            return True
        path = path.rpartition("/")[0]
    return False


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _tree_rows(batches):
    """(host, path, content?, value, page): each text of each content node and
    the child styles of each element node, once a page."""
    for b in batches:
        rows = set()
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            page = _hash(source)
            blocks, nodes = parse(source)
            rows.update((host, x.path, True, _hash(x.text), page) for x in blocks if not x.dropped)
            rows.update((host, x.path, False, _hash(" ".join(x.styles)), page) for x in nodes if x.styles and not x.dropped)
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["host", "path", "content", "value", "page"])


def _host(url: str):
    return F.nullif(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def importance(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, pages, importance) of every branch of every site's tree."""
    source = python_ready(pages).select(_host(url).alias("host"), F.col(html).cast("string").alias("html")).filter("host is not null and html is not null")
    rows = source.mapInArrow(_tree_rows, "host string, path string, content boolean, value long, page long")
    rows = stored(rows.distinct())  # copies of a page count once
    values = rows.groupBy("host", "path", "content", "value").agg(F.count(F.lit(1)).alias("n"))
    nodes = rows.groupBy("host", "path").agg(F.count_distinct("page").alias("pages"))
    joined = values.join(nodes, ["host", "path"])
    share = F.col("n") / F.col("pages")
    base = F.log(F.col("pages").cast("double"))
    each = joined.groupBy("host", "path", "pages").agg(
        F.avg(F.when(F.col("content") & (F.col("pages") > 1), F.log(F.col("n").cast("double")) / base).when(F.col("content"), F.lit(0.0))).alias("shared"),
        F.sum(F.when(~F.col("content") & (F.col("pages") > 1), -share * F.log(share) / base)).alias("styles"),
        F.count_if(~F.col("content")).alias("l"),
    )
    # every content node tells all branches that hold it
    steps = F.split("path", "/")
    held = each.filter("shared is not null").select(
        "host", F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("path"), (F.col("pages") * (1 - F.col("shared"))).alias("x"), F.col("pages").alias("w")
    )
    content = held.groupBy("host", "path").agg((F.sum("x") / F.sum("w")).alias("content"))
    decay = F.pow(F.lit(DECAY), F.col("l"))
    own = F.coalesce("styles", F.lit(0.0))
    return each.join(content, ["host", "path"]).select("host", "path", "pages", F.when(F.col("l") > 0, (1 - decay) * own + decay * F.col("content")).otherwise(F.col("content")).alias("importance"))


def low_branches(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, low): the paths that go, a list a host (as long as its templates
    have branches of their own, not as its pages); empty for a host of enough
    pages that has none."""
    last = F.element_at(F.split("path", "/"), -1)
    own = last.rlike(r"[.#]") | ~F.col("path").rlike(r"/(article|main)[^/]*(/|$)")
    plain = last.rlike(r"^(html|body|article|main)")
    found = importance(pages, url, html).filter(F.col("pages") >= MIN_PAGES)
    return found.groupBy("host").agg(F.collect_set(F.when((F.col("importance") < LOW) & own & ~plain, F.col("path"))).alias("low"))


def extract(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """The columns `keep` of every row, and `text` and `n_chars` of its main
    text; empty for a null or empty page and one without an article. A page
    without a host is no part of a site, so only its own marks count. Repeated
    rows come back each."""
    low = stored(low_branches(pages, url, html)).withColumnRenamed("host", "__host")
    source = python_ready(pages).select(*keep, _host(url).alias("__at"), F.col(html).cast("string").alias("__html"))
    joined = source.join(low, F.col("__at") == F.col("__host"), "left").select(*keep, "__html", "low")

    def run(batches):
        k = len(keep)
        for b in batches:
            texts = [main_text(s, None if x is None else frozenset(x)) for s, x in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[: len(keep)])
    return joined.mapInArrow(run, f"{kinds}{', ' if keep else ''}text string, n_chars long")
