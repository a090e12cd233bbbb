"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is the path of element names with their classes and
ids. For each node the tree counts how many pages have it, which child sequences (styles) it has, and
in how many pages each of its texts stands. With m pages of a node,

* presentation importance is the entropy of its styles to the base m,
* content importance is 1 minus the mean entropy of its texts over the pages, ``log_m k`` for a text on k pages,

and the node's importance is a weighted sum of both. Nodes of low importance show the same in the same way
on page after page; their text is removed from every page of the host. Elements whose name or class names their
role (menu, footer, advert, ..) are low beforehand, on hosts of any size, but not one that holds the article or
main element or most of the page's words; these, and parts of an article with an ambiguous class (notice,
related, ..), are left to the tree. Of what remains, the text inside ``article`` (else ``main``, else the body) is the main text.

The tree is a table of hashes, summed map-side, so a host with a third of all pages is no larger
in any task than another. Low nodes repeat on many pages and are therefore few; they are broadcast
below BROADCAST_ROWS hosts and nodes, joined beyond that.

Defined results: NULL or empty html gives an empty text; a NULL url belongs to the empty host; repeated rows are
extracted alike; hosts with fewer than MIN_PAGES pages, or whose pages hardly differ at all, lose nothing
by the tree; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written
from .url_filter import host_of

MIN_PAGES = 5
LOW = 0.3
CONTENT_WEIGHT = 0.8
BROADCAST_ROWS = 200_000

# Element names and words of classes and ids by their role.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style noscript template iframe textarea title svg math canvas object".split())
ROLE_TAGS = frozenset(
    "nav footer aside form head button select dialog menu script style noscript template iframe "
    "textarea title svg math canvas object".split()
)
ROLE_ATTRIBUTES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu "
    "menubar toolbar".split()
)
ROLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice popup modal overlay sidebar sidenav menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond reply "
    "replies share sharing social related recommended newsletter subscribe subscription widget "
    "widgets toolbar pagination pager login signup search skip".split()
)
#: Within an article or main element these may as well name its subject; the tree decides.
AMBIGUOUS_WORDS = frozenset(
    "banner sponsor sponsored promo promotion notice sidebar sidenav menu navigation footer masthead respond "
    "social related recommended subscription widget widgets search skip".split()
)
#: Elements that hold other elements: low beforehand, but not where they hold the article.
HOLDERS = frozenset("nav footer aside form dialog menu header".split())
ARTICLE_WORDS = frozenset("ad ads advert advertisement sponsored comment comments reply related".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open element of these names (up to the given border).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_P_ENDS = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z0-9]+")

_nodes: dict[tuple[int, str], int] = {}


def _node(parent: int, key: str) -> int:
    """Hash of a path: of its parent's hash and its own key."""
    found = _nodes.get((parent, key))
    if found is None:
        import xxhash

        if len(_nodes) >= 200_000:
            _nodes.clear()
        found = xxhash.xxh3_64_intdigest(f"{parent}/{key}".encode()) - (1 << 63)
        _nodes[parent, key] = found
    return found


class Page:
    """Blocks of a page in order: (node, region, text), where region is 2 inside ``article``, 1
    inside ``main``, else 0; and the child sequence of every node. Elements of a naming role
    are skipped with all they hold, unless they hold the article or most of the words."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, int, str]] = []
        self.styles: dict[int, list[str]] = {}
        # Elements of a role: the one around it, and whether its words count; 0 is none.
        self._roles: list[tuple[int, bool]] = [(0, False)]
        self._found: list[tuple[int, int, list[tuple[str, int]]]] = []  # blocks as pieces of (text, role)
        self._mains: list[int] = []  # the innermost role around each article or main element
        # Open elements: (name, node, region, skipped, innermost role).
        self._stack: list[tuple[str, int, int, bool, int]] = [("", 0, 0, False, 0)]
        self._text: list[tuple[str, int]] = []
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            if m is None:
                self._read(source[at:])
                break
            self._read(source[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None or not m[4]:  # comment, declaration, or a tag that the page's end cuts
                continue
            name = name.lower()
            if m[1]:
                self._close(name)
                continue
            self._open(name, m[3])
            if name in RAW and not m[3].endswith("/"):
                close = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(source, at)
                at = close.start() if close else end
        self._flush()
        kept = self._kept_roles()
        for node, region, pieces in self._found:
            text = " ".join("".join(t for t, role in pieces if role in kept).split())
            if text:
                self.blocks.append((node, region, text))

    def _around(self, role: int) -> Iterator[int]:
        while role:
            yield role
            role = self._roles[role][0]

    def _kept_roles(self) -> set[int]:
        """Roles of which nothing around is skipped: 0, and those that hold the article (of several, those
        within the fewest roles) or most of the words."""
        if len(self._roles) == 1:
            return {0}
        depth = {r: sum(1 for _ in self._around(r)) for r in set(self._mains)}
        least = min(depth.values(), default=0)
        spared = {x for r, d in depth.items() if d == least for x in self._around(r)}
        words, total = Counter(), 0
        for text, role in (piece for _, _, pieces in self._found for piece in pieces):
            n = len(text.split())
            around = list(self._around(role))
            if all(self._roles[r][1] for r in around):
                total += n
            for r in around:
                words[r] += n
        spared |= {r for r, n in words.items() if self._roles[r][1] and 2 * n > total}
        kept = {0}
        for r in range(1, len(self._roles)):  # the role around comes first
            if r in spared and self._roles[r][0] in kept:
                kept.add(r)
        return kept

    def _read(self, text: str) -> None:
        if text and not self._stack[-1][3]:
            self._text.append((text, self._stack[-1][4]))

    def _flush(self) -> None:
        if self._text:
            pieces = [(html.unescape(t) if "&" in t else t, role) for t, role in self._text]
            self._text = []
            if any(not t.isspace() for t, _ in pieces):
                _, node, region, _, _ = self._block
                self._found.append((node, region, pieces))

    @property
    def _block(self) -> tuple[str, int, int, bool, int]:
        return next((e for e in reversed(self._stack) if e[0] in BLOCK), self._stack[0])

    def _open(self, name: str, attributes: str) -> None:
        stack = self._stack
        if name in BLOCK:
            self._flush()
            if name in _P_ENDS and any(e[0] == "p" for e in stack):
                self._close("p")
        if name in ENDS:
            names, border = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in border:
                    break
                if stack[k][0] in names:
                    del stack[k:]
                    break
        if name == "br":
            self._read(" ")
        if name in VOID:
            return
        _, parent, region, skipped, role = stack[-1]
        found = dict(
            (k.lower(), v.strip("\"'").lower()) for k, v in ATTRIBUTE.findall(attributes)
        ) if attributes else {}
        key = name
        if found:
            key += "." + " ".join(sorted(found.get("class", "").split())) + "#" + found.get("id", "")
        node = _node(parent, key)
        if not skipped:
            children = self.styles.setdefault(parent, [])
            if not children or children[-1] != key:  # runs of equal children count once
                children.append(key)
            self.styles.setdefault(node, [])
        if name == "article":
            region = 2
        elif name == "main" or found.get("role") == "main":
            region = max(region, 1)
        if not skipped and self._has_role(name, found, region):
            if name in ROLE_TAGS and name not in HOLDERS:
                skipped = True
            else:
                self._roles.append((role, name not in HOLDERS or name == "form"))
                role = len(self._roles) - 1
        if not skipped and (name in ("article", "main") or found.get("role") == "main"):
            self._mains.append(role)
        stack.append((name, node, region, skipped, role))

    @staticmethod
    def _has_role(name: str, found: dict[str, str], region: int) -> bool:
        if name in ROLE_TAGS or (name == "header" and not region):
            return True
        if not found or name in ("html", "body", "main"):
            return False
        if found.get("role") in ROLE_ATTRIBUTES:
            return True
        words = set(WORD.findall(found.get("class", "") + " " + found.get("id", "")))
        if name != "article" and region:
            return not words.isdisjoint(ROLE_WORDS - AMBIGUOUS_WORDS)
        return not words.isdisjoint(ARTICLE_WORDS if name == "article" else ROLE_WORDS)

    def _close(self, name: str) -> None:
        stack = self._stack
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                if any(e[0] in BLOCK for e in stack[k:]):
                    self._flush()
                del stack[k:]
                return


def main_text(source: str | None, low: frozenset[int]) -> str:
    """The main text without the nodes in ``low``; blocks joined by an empty line."""
    if not source:
        return ""
    blocks = Page(source).blocks
    region = max((r for _, r, _ in blocks), default=0)
    return "\n\n".join(text for node, r, text in blocks if r == region and node not in low)


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, node, pages, presentation, content): the merged tree, one row per node."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def digest(text: str) -> int:
            return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)

        for batch in batches:
            seen: Counter = Counter()
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not source:
                    continue
                page = Page(source)
                for node, children in page.styles.items():
                    seen[host, node, False, digest("|".join(children))] += 1
                for node, text in {(node, digest(text)) for node, _, text in page.blocks}:
                    seen[host, node, True, text] += 1
            rows = [(*key, n) for key, n in seen.items()]
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["host", "node", "is_text", "feature", "k"],
            )

    features = (
        pages.select(host_of(F.col(url_col)).alias("host"), f"`{html_col}`")
        .mapInArrow(count, "host string, node long, is_text boolean, feature long, k long")
        .groupBy("host", "node", "is_text", "feature").agg(F.sum("k").alias("k"))
    )
    k, spread = F.col("k"), F.col("k") * F.log(F.col("k").cast("double"))
    text = F.col("is_text")
    sums = features.groupBy("host", "node").agg(
        F.sum(F.when(~text, k)).alias("pages"), F.sum(F.when(~text, spread)).alias("styles"),
        F.sum(F.when(text, k)).alias("texts"), F.sum(F.when(text, spread)).alias("shared"),
    )
    base = F.log(F.col("pages").cast("double"))
    return sums.filter("pages > 1").select(
        "host", "node", "pages", "texts",
        (1 - F.col("styles") / F.col("pages") / base).alias("presentation"),
        (1 - F.least(F.lit(1.0), F.col("shared") / F.col("texts") / base)).alias("content"),
    )


def low_nodes(tree: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """(host, low): hashes of the nodes of low importance. Hosts whose texts as a whole are of low
    importance are left out: their pages are copies, in which nothing tells a template from text."""
    rated = tree.filter("texts > 0").withColumn(
        "importance",
        CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("presentation"),
    )
    hosts = rated.groupBy("host").agg(
        (F.sum(F.col("texts") * F.col("content")) / F.sum("texts")).alias("whole")
    )
    # Few nodes are low, so the array of a host is short.
    return (
        rated.filter((F.col("pages") >= min_pages) & (F.col("importance") < low))
        .groupBy("host").agg(F.collect_set("node").alias("low"))
        .join(hosts.filter(F.col("whole") >= low), "host").select("host", "low")
    )


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_pages: int = MIN_PAGES, low: float = LOW,
) -> DataFrame:
    """One row per page: id_col, url_col, ``text``."""
    found = written(low_nodes(style_tree(pages, url_col, html_col), min_pages, low), "low-nodes")
    rows, nodes = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("low")), F.lit(0))).first()
    if rows + nodes <= BROADCAST_ROWS:
        found = F.broadcast(found)
    named = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"),
        host_of(F.col(url_col)).alias("host"),
    ).join(found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(source, frozenset(nodes or ()))
                for source, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=[id_col, url_col, "text"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return named.select("_id", "_url", "_html", "low").mapInArrow(
        run, f"`{id_col}` {kind}, `{url_col}` string, text string"
    )
