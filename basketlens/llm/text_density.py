"""Main text of a page by composite text density.

A page is parsed into a tree (end tags may be missing). Elements that cannot be article text are left out first: menus,
headers, footers, asides, forms, scripts, and what a class, id or role names as advert, notice, comment, sidebar and the like.
For every node the density is its characters per tag, adjusted for links:

    D = C / T * log_b(C / LC * T / LT),   b = ln(C / (C - LC) * LC + LCbody / Cbody * C + e)

with C characters, T tags, LC characters in links, LT link tags, each at least 1 as a divisor. A node's sum adds the densities of its children
and of its own runs of text. The subtree with the largest sum is the text's core; the smallest density on the path from it to
the body is the threshold. The core and the largest-sum subtrees of all other nodes at or above the threshold are taken, on every
page, with what lies between two of them under the same parent and the last h1 before the first; lists of links below the threshold
go, but for the blocks in them that are not mostly links. Tags only enter the sum: an `article` around the largest sum, or a `main` with no article
between, has that sum added to its own, so that its title and lead count with its longest part.

A page is one row in and one row out, so nothing is shuffled. Defined results: NULL, empty or text-free html gives an empty
text; markup that is cut off is read as far as it goes; noscript, template, svg and math are left out up to their end tag
or their parent's, and an open tag alone if no end tag follows or it closes itself; repeated rows get equal results; an input column named `text` or
`n_chars` is replaced.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "xmp")}
SKIPPED = frozenset(("noscript", "template", "svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
LEFT_OUT = frozenset("head nav header footer aside form button select option label input dialog menu object canvas video audio map".split()) | SKIPPED
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
        "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
NOISE = frozenset("""ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
    alert popup modal overlay newsletter subscribe subscription signup paywall comment comments respond replies disqus discussion sidebar menu menus nav navbar
    navigation breadcrumb breadcrumbs footer header masthead topbar share sharing social related recommended recommendations widget widgets
    toolbar pagination pager login search skip""".split())
REMARK = frozenset("comment comments respond replies disqus discussion".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
PLAIN = frozenset(("with", "has", "no", "without"))


def _noise(tag: str, attributes: str) -> str:
    """Why an element's attributes say it is no article text: "" (they do not), "kind" or "remark"."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return "remark"
    words: set[str] = set()
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = re.split(r"[-_:]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if parts[0] not in PLAIN:
            words.update((parts[0], parts[-1]))
    if words & REMARK:
        return "remark"
    return "kind" if words & NOISE or found.get("role", "").lower() in ROLES else ""


class Page:
    """A page's elements in page order: an element's subtree is the range from its number to `end`."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.out = ["#root"], [-1], [0], [""]
        self.runs: list[tuple[int, str | None]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        lower = source.lower()
        last_end = {name: lower.rfind(f"</{name}") for name in SKIPPED}
        tags = self.tag
        while at < size:
            m = TAG.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            if m.start() > at:
                self._text(stack[-1], source[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(stack, name)
                continue
            attributes = m[3] or m[6] or ""
            if name in RAW:
                over = RAW[name].search(source, at)
                at = over.end() if over else size
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self.runs.append((stack[-1], None))
                continue
            if name in SKIPPED and (attributes.endswith("/") or last_end[name] < m.start()):
                continue
            if name in BLOCK:
                self._end_implied(stack, {"p"}, BLOCK - {"p"})
                if name in ENDS:
                    self._end_implied(stack, *ENDS[name])
            node = len(tags)
            tags.append(name)
            self.parent.append(stack[-1])
            self.end.append(0)
            self.out.append("kind" if name in LEFT_OUT else _noise(name, attributes) if attributes and name not in ("html", "body", "main") else "")
            if name in BLOCK:
                self.runs.append((node, None))
            if not attributes.endswith("/") or name in BLOCK:
                stack.append(node)
            else:
                self.end[node] = node + 1
        self._pop_to(stack, 0)
        self.end[0] = len(tags)

    def _text(self, node: int, text: str) -> None:
        self.runs.append((node, entities.unescape(text) if "&" in text else text))

    def _pop_to(self, stack: list[int], depth: int) -> None:
        while len(stack) > max(depth, 1):
            node = stack.pop()
            self.end[node] = len(self.tag)
            if self.tag[node] in BLOCK:
                self.runs.append((node, None))

    def _end_implied(self, stack: list[int], ended: set[str], stop: frozenset[str] | set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[depth]]
            if name in ended:
                self._pop_to(stack, depth)
                return
            if name in stop or name in SKIPPED:
                return

    def _close(self, stack: list[int], name: str) -> None:
        inline = name not in BLOCK and name not in SKIPPED
        for depth in range(len(stack) - 1, 0, -1):
            open_name = self.tag[stack[depth]]
            if open_name == name:
                self._pop_to(stack, depth)
                return
            if inline and open_name in BLOCK:
                return

    def left_out(self) -> list[bool]:
        """Which elements are no article text, with all they hold."""
        n = len(self.tag)
        holds = [0] * (n + 1)
        for i in range(n):
            holds[i + 1] = holds[i] + (self.tag[i] in ("article", "main"))
        gone = [False] * n
        for i in range(1, n):
            kind = self.out[i]
            if kind == "kind" and (self.tag[i] == "article" or holds[self.end[i]] > holds[i]):
                kind = ""
            gone[i] = gone[self.parent[i]] or bool(kind)
        return gone


def _log(base: float, x: float) -> float:
    return math.log(x) / math.log(base) if x > 0 and base > 1 else 0.0


def main_text(source: str | None) -> str:
    """The article's blocks, one per line; empty if there are none."""
    if not source:
        return ""
    page = Page(source)
    tag, parent, end, gone = page.tag, page.parent, page.end, page.left_out()
    n = len(tag)
    chars, tags, link_chars, links = [0] * n, [0] * n, [0] * n, [0] * n
    in_link, skipped = [False] * n, [False] * n
    own: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        in_link[i] = tag[i] == "a" or in_link[parent[i]]
        skipped[i] = tag[i] in SKIPPED or skipped[parent[i]]
    for node, text in page.runs:
        if text is not None and not gone[node] and (size := len(text.strip())):
            chars[node] += size
            link_chars[node] += size * in_link[node]
            own[node].append(size)
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            up = parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            links[up] += links[i] + (tag[i] == "a")
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    ratio = link_chars[body] / chars[body]

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        return c / max(t, 1) * _log(max(base, 1.0 + 1e-9), c / max(lc, 1) * max(t, 1) / max(lt, 1)) if base > 1.0 + 1e-9 else c / max(t, 1) * math.log(c + 1.0)

    dense, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if gone[i]:
            continue
        dense[i] = density(chars[i], tags[i], link_chars[i], links[i])
        sums[i] += sum(density(c, 1, c * in_link[i], int(in_link[i])) for c in own[i])
        if i:
            sums[parent[i]] += dense[i]
    core = max(range(body, end[body]), key=lambda i: (sums[i], -i))
    most, holds, i = sums[core], tag[core] == "article", parent[core]
    while i > 0:
        if tag[i] == "article" or tag[i] == "main" and not holds:
            sums[i] += most
        holds = holds or tag[i] == "article"
        i = parent[i]
    core = max(range(body, end[body]), key=lambda i: (sums[i], -i))
    threshold, i = dense[core], core
    while i != body:
        i = parent[i]
        threshold = min(threshold, dense[i])
    roots = _marked(core, body, threshold, dense, sums, end, gone)
    roots = _completed(roots, body, tag, parent, end, gone, chars, link_chars)
    keep = [False] * n
    for root in roots:
        keep[root:end[root]] = [True] * (end[root] - root)
    listed = [False] * n
    for i in range(1, n):
        mostly = 2 * link_chars[i] > chars[i]
        if gone[i]:
            keep[i] = False
        elif keep[i] and i not in roots:
            inside = listed[parent[i]]
            listed[i] = mostly or tag[i] not in BLOCK if inside else tag[i] in BLOCK and dense[i] < threshold and mostly
            keep[i] = not listed[i] and (inside or keep[parent[i]])
    lines, line = [], []
    for node, text in page.runs:
        if text is None:
            if line and not skipped[node]:
                lines.append(" ".join("".join(line).split()))
                line = []
        elif keep[node]:
            line.append(text)
    lines.append(" ".join("".join(line).split()))
    return "\n".join(x for x in lines if x)


def _marked(core: int, body: int, threshold: float, dense: list[float], sums: list[float], end: list[int], gone: list[bool]) -> list[int]:
    """The core and, of every other node at or above the threshold, the subtree with the largest sum."""
    roots = {core}
    for i in range(body + 1, end[body]):
        if not gone[i] and dense[i] >= threshold and not any(r <= i < end[r] for r in roots) and not i <= core < end[i]:
            roots.add(max(range(i, end[i]), key=lambda k: (sums[k], -k)))
    return sorted(roots)


def _completed(roots: list[int], body: int, tag: list[str], parent: list[int], end: list[int], gone: list[bool], chars: list[int], link_chars: list[int]) -> list[int]:
    """The roots, what lies between two of them under the same parent unless it is mostly links, and the page's last h1
    before the first of them."""
    first, last = {}, {}
    for r in roots:
        first.setdefault(parent[r], r)
        last[parent[r]] = r
    more = set(roots)
    for i in range(body + 1, end[body]):
        up = parent[i]
        if first.get(up, i) < i < last.get(up, i) and not gone[i] and chars[i] and 2 * link_chars[i] <= chars[i]:
            more.add(i)
    title = next((i for i in range(roots[0] - 1, body, -1) if tag[i] == "h1" and chars[i] and not gone[i] and 2 * link_chars[i] <= chars[i]), None)
    if title is not None and not title < roots[0] < end[title]:
        more.add(title)
    return sorted(more)


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """`pages` with the main text of each page as `text` and its length in code points as `n_chars`."""

    def fn(column: pa.Array) -> list[pa.Array]:
        texts = [main_text(source.as_py()) for source in column]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return add_columns(pages, [html], "text string, n_chars bigint", fn, carry)
