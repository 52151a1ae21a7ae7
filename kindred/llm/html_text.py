"""Main text of web pages by consensus paths per host.

Each page's containers are scored by the text of the blocks in them less the text in links; the best one votes, with its
path of tags and classes (digits generalised), for its host. Spark counts the votes, the path with most pages wins
(ties: larger score, then the last in alphabetical order), and every page is extracted again from the elements at its
host's winning path and, where that ends in an article, section or main, from those beside it. A page that has no text
there uses its own best container.

Left out: navigation, page headers (an article's own header stays), footers, sidebars, forms, scripts, styles and
containers that a class, id or role calls advert, notice, menu, comment and the like; headings and paragraphs stay
whatever their class or id. Character references are decoded, white space inside a block is one space, blocks are joined
by a line feed.

Null html is empty and gives empty text. Pages without a host in their url form one host. Broken markup is read
leniently: an unfinished tag at the end is dropped. Time and memory grow with a page's length, not with its nesting; a very
long page is read whole. Repeated rows get equal results, empty tables give empty results; input columns that have the
name of an output are replaced and all others returned.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noframes".split())
_DROP = frozenset("script style noscript template iframe object svg math canvas nav header footer aside form button select option textarea input label dialog menu head title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_HOLDS = frozenset("article main section div td body".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "option"}
_NAMED = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|sidebar|footer|header|masthead|comments?|commentlist|reply|replies|respond|notice|cookies?|consent|gdpr|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|popup|modal|overlay|breadcrumbs?|widget|disclaimer|alert|toolbar|pagination|pager|skip|search|login|form)(?:$|[-_\s\d])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())


#: Elements whose class or id may say that they are left out; headings, paragraphs and inline elements stay whatever they are called.
_CONTAINERS = frozenset("div section aside ul ol dl table details figure address center span".split())
#: Elements that an unmatched end tag of an inline element does not reach beyond.
_SCOPES = frozenset("article body table".split())


class Page:
    """The containers of a page as a tree (parents before children) and its blocks (container, text, characters in links)."""

    def __init__(self, html: str):
        self.parent, self.step, self.blocks = [-1], [""], []
        self._child: dict[tuple[int, str], int] = {}
        self._read(html)

    def child(self, at: int, step: str) -> int:
        found = self._child.get((at, step))
        if found is None:
            found = self._child[at, step] = len(self.parent)
            self.parent.append(at)
            self.step.append(step)
        return found

    def path(self, at: int) -> str:
        steps = []
        while at > 0:
            steps.append(self.step[at])
            at = self.parent[at]
        return ">".join(reversed(steps))

    def find(self, path: str) -> int:
        """The container at ``path``, or -1."""
        at = 0
        for step in path.split(">") if path else ():
            at = self._child.get((at, step), -1)
            if at < 0:
                break
        return at

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, container around its content, left out
        opened: dict[str, int] = {}
        scopes: list[dict[str, int]] = [{}]
        dropped = linked = node = 0
        parts: list[str] | None = None
        held: list[tuple[int, list[str], list[int]]] = []

        def text(s: str) -> None:
            nonlocal parts
            if dropped or not s:
                return
            if parts is None:
                if s.isspace():
                    return
                parts = []
                held.append((node, parts, [0]))
            parts.append(s)
            if linked:
                held[-1][2][0] += len(s)

        def close(tag: str) -> None:
            nonlocal dropped, linked, parts, node
            if not (opened if tag in _BLOCK else scopes[-1]).get(tag):
                return
            while True:
                t, _, off = stack.pop()
                dropped -= off
                linked -= t == "a"
                opened[t] -= 1
                if t in _SCOPES:
                    scopes.pop()
                scopes[-1][t] -= 1
                if t == tag:
                    break
            node = stack[-1][1] if stack else 0
            if tag in _BLOCK:
                parts = None

        at, size = 0, len(html)
        while at < size:
            m = _TAG.search(html, at)
            if not m:
                text(html[at:])
                break
            text(html[at : m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            if not m[4]:
                break  # unfinished at the end
            tag = name.lower()
            if m[1]:
                close(tag)
                continue
            if tag == "br":
                text(" ")
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if tag in _BLOCK:
                parts = None
                if tag in _CLOSES_P:
                    close("p")
                if tag == "li" and stack and stack[-1][0] == "li":
                    close("li")
            if tag in _VOID or m[3].endswith("/"):
                continue
            step, off = tag, tag in _DROP and not (tag == "header" and opened.get("article"))
            if m[3]:
                for a in _ATTR.finditer(m[3]):
                    key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if key == "class" and value:
                        step += "." + re.sub(r"\d+", "#", ".".join(value.lower().replace(">", " ").split()))
                    named = key in ("class", "id") and tag in _CONTAINERS and _NAMED.search(value)
                    if tag not in ("html", "body") and (named or (key == "role" and value.lower() in _ROLES) or key == "hidden" or (key == "aria-hidden" and value.lower() == "true")):
                        off = True
            if tag in _HOLDS:
                node = self.child(node, step)
            stack.append((tag, node, off))
            opened[tag] = opened.get(tag, 0) + 1
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
            if tag in _SCOPES:
                scopes.append({})
            dropped += off
            linked += tag == "a"
        for k, ps, links in held:
            t = " ".join(entities.unescape("".join(ps)).split())
            if t:
                self.blocks.append((k, t, links[0]))

    def scores(self) -> dict[int, float]:
        """Per container the text of its own and a third of its children's; text in links counts against it."""
        score: dict[int, float] = {}
        for k, t, links in self.blocks:
            points = max(0.0, len(t) - 2.0 * links) * (1.0 if len(t) >= 25 else 0.25)
            score[k] = score.get(k, 0.0) + points
            if self.parent[k] > 0:
                up = self.parent[k]
                score[up] = score.get(up, 0.0) + points / 3
        return score

    def best(self) -> tuple[int, float]:
        """The container with the highest score and that score; of equal ones the first in the page; -1 without text."""
        score = self.scores()
        if not score:
            return -1, 0.0
        top = max(score.values())
        return min(k for k, s in score.items() if s == top), top

    def below(self, tops: set[int]) -> list[bool]:
        inside = [False] * len(self.parent)
        for k in range(len(inside)):
            inside[k] = k in tops or (k > 0 and inside[self.parent[k]])
        return inside


def best_path(page: Page) -> tuple[str, float]:
    top, score = page.best()
    return (page.path(top), score) if top >= 0 else ("", 0.0)


def extract(html: str | None, winner: str | None) -> str:
    """The text at the host's winning path, and at the containers beside it with the same tag.

    A page that has no text there uses its own best container in the place of the winner.
    """
    page = Page(html or "")
    if not page.blocks:
        return ""
    top = page.find(winner) if winner else -1
    if top >= 0:
        inside = page.below({top})
        if not any(inside[k] for k, _, _ in page.blocks):
            top = -1
    if top < 0:
        top, _ = page.best()
    tag = lambda k: page.step[k].split(".", 1)[0]
    beside = {k for k in range(1, len(page.parent)) if page.parent[k] == page.parent[top] and tag(k) == tag(top)} if top > 0 and tag(top) in ("article", "section", "main") else set()
    inside = page.below({top} | beside)
    return "\n".join(t for k, t, _ in page.blocks if inside[k])


def host_col(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [best_path(Page(h.as_py() or "")) for h in b.column("_html")]
        yield pa.RecordBatch.from_arrays([b.column("_host"), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["_host", "path", "score"])


def _texts(schema: pa.Schema, html: str, path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), w.as_py()) for h, w in zip(b.column(html), b.column(path), strict=True)]
            made = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return rows


def extract_main_text(pages: DataFrame, *, url: str = "url", html: str = "html", salts: int = 16) -> DataFrame:
    """``pages`` with text and n_chars."""
    page = F.col(f"`{html}`").cast("string")
    votes = pages.select(host_col(url).alias("_host"), page.alias("_html")).mapInArrow(_votes, "_host string, path string, score double").where("path <> ''")
    count = votes.groupBy("_host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    # the page side of a host with very many pages is dealt over `salts` keys; the winners are small
    won = C.stash(count.groupBy("_host").agg(F.max_by("path", F.struct("n", F.round("score", 3), "path")).alias("_path")))
    salt = F.pmod(F.xxhash64(F.col(f"`{url}`").cast("string"), F.length(page)), F.lit(salts)).cast("int")
    keyed, (src, host, part) = C.with_helpers(pages, ("text", "n_chars"), _html=page, _host=host_col(url), _salt=salt)
    base = keyed.drop(src, host, part)
    (path,) = C.apart([*keyed.columns, "text", "n_chars"], "_path")
    spread = won.select(F.col("_host").alias(host), F.col("_path").alias(path), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(part))
    joined = keyed.join(spread, [host, part], "left")
    schema, arrow = C.widened(base, "text string, n_chars long")
    return joined.select(*[F.col(f"`{c}`") for c in base.columns], src, path).mapInArrow(_texts(arrow, src, path), schema)
