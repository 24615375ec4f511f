"""Main text of HTML pages by a minimum cut.

A page becomes a row of text blocks. A logistic classifier, fitted on generated pages whose every block is known,
reads a block's text, links, place and structure and what the elements around it are called; its log odds are the
capacities to the two terminals. Neighbours in page order, and neighbours under the same parent, are tied by
smoothness edges. The maximum flow parts content from boilerplate: a short paragraph between long ones
stays, a lone sentence in a menu goes. No name or tag decides by itself, but for what a browser never shows.
"""

from __future__ import annotations

import random
import re
from functools import cache
from html import escape, unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'<>]|"[^"<]*"|'[^'<]*')*|[^<>]*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")

#: Elements whose content is never text of the page. One that is never closed ends where the next block begins, but for scripts and styles.
_RAW = frozenset("script style noscript template svg iframe object title select button textarea canvas audio video map".split())
_TO_THE_END = frozenset("script style template title textarea".split())
_BLOCK = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset legend address hr details summary dialog menu body html head center".split())
_VOID = frozenset(["hr"])
_CLOSES = {k: frozenset(v.split()) for k, v in {"p": "p", "li": "li p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p"}.items()}
_STOPS = {"li": frozenset("ul ol menu".split()), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
_NEXT_BLOCK = re.compile(r"</?(?:p|div|section|article|main|footer|body|html)\b", re.I)

#: What an element around a block may be. STRONG and WEAK names speak against content, more or less; IN names for it.
NONE, TAG_IN, NAME_IN, TAG_OUT, STRONG, WEAK = range(6)
_OUT_TAGS = frozenset("nav footer aside form menu dialog head".split())
_STRONG = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter "
    "subscribe subscription signup login register comment comments commentlist disqus reply replies respond related recommended recommendations pagination pager masthead contentinfo complementary dialog modal popup".split()
)
_WEAK = frozenset(
    "banner notice notices alert overlay discussion share sharing social widget toolbar search skip disclaimer copyright tags tagcloud topbar warning flash toast paywall announcement announcements feedback results buttons header".split()
)
_IN = frozenset("article articlebody content main body post entry story text maincontent hentry".split())
_PAGE_HEADER = frozenset("site page top global main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block:
    __slots__ = ("text", "parent", "tag", "near", "inside", "against", "linked")

    def __init__(self, text, parent, tag, near, inside, against, linked):
        self.text, self.parent, self.tag, self.near, self.inside, self.against, self.linked = text, parent, tag, near, inside, against, linked


def _kind(tag: str, attrs: str, inside: bool) -> int | None:
    """What an element speaks for by its tag and names; None if a browser doesn't show it."""
    kind = NONE
    if attrs.strip():
        words: set[str] = set()
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return None
            if key in ("class", "id", "role", "itemprop") and value and tag not in ("body", "html"):
                words |= {w.lower() for w in _CAMEL.split(value) if w}
        if tag in ("div", "header", "section") and "header" in words:
            words.discard("header")
            if not inside or words & _PAGE_HEADER:
                kind = STRONG
        if words & _STRONG and not (words & _IN and tag in ("article", "main")):
            kind = STRONG
        elif kind == NONE and words & _IN:
            kind = NAME_IN
        elif kind == NONE and words & _WEAK:
            kind = WEAK
    if tag in _OUT_TAGS or tag == "header" and not inside:
        return TAG_OUT
    return TAG_IN if tag in ("article", "main") and kind in (NONE, NAME_IN, WEAK) else kind


def blocks(html: str) -> list[Block]:
    """Text blocks in page order, with where they stand."""
    out: list[Block] = []
    stack = [("", 0, NONE, 0, 0)]  # tag, own number, nearest kind that says something, how many around speak for content, against it
    parts: list[str] = []
    linked, in_link, number, at = 0, 0, 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                tag, own, near, good, bad = stack[-1]
                parent = stack[-2][1] if tag in ("p", "li", "td", "th", "tr", "dt", "dd") or tag in _HEADINGS else own
                out.append(Block(text, parent, tag, near, good, bad, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def text_of(lo, hi):
        nonlocal linked
        if hi > lo:
            parts.append(html[lo:hi])
            if in_link:
                linked += hi - lo

    def past(name, at):
        """End of an element that isn't read."""
        end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
        if not end and name not in _TO_THE_END:
            end = _NEXT_BLOCK.search(html, at)
            return end.start() if end else n
        return end.end() if end else n

    def element_end(name, at):
        """End of a hidden block: its own closing tag, others of its name inside it counted; one that needs none ends where its like begins."""
        if name in _CLOSES:
            end = re.compile(rf"</{name}\s*>|(?=<{name}\b)|(?=</(?:ul|ol|dl|table|div|section|article|main|body)\b)" + (f"|(?={_NEXT_BLOCK.pattern})" if name == "p" else ""), re.I).search(html, at)
            return end.end() if end else n
        depth = 1
        for m in re.compile(rf"<(/?){name}\b[^>]*>", re.I).finditer(html, at):
            depth += -1 if m[1] else 1
            if not depth:
                return m.end()
        return n

    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            break
        text_of(at, m.start())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = 0
            elif name in _BLOCK:
                flush()
                in_link = 0
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            continue
        attrs = m[3] or ""
        if name in _RAW:
            if not attrs.endswith("/"):
                at = past(name, at)
            parts.append(" ")
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = 1
        elif name in _BLOCK:
            flush()
            in_link = 0
            shut, stop = _CLOSES.get(name), _STOPS.get(name, frozenset())
            if shut or stack[-1][0] == "p":
                shut = shut or _CLOSES["p"]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in stop or (name == "p" and stack[k][0] != "p"):
                        break
                    if stack[k][0] in shut:
                        del stack[k:]
            if name in _VOID:
                continue
            _, _, near, good, bad = stack[-1]
            kind = _kind(name, attrs, good > 0)
            if kind is None:
                at = element_end(name, at)
                continue
            number += 1
            stack.append((name, number, kind or near, good + (kind in (TAG_IN, NAME_IN)), bad + (kind in (TAG_OUT, STRONG))))
        elif _ATTR.search(attrs) and not attrs.endswith("/"):
            kind = _kind(name, attrs, True)
            if kind is None or kind == STRONG:
                # An inline element that is hidden or marked, such as <span class="ad">: all up to its end goes.
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                if end and not _NEXT_BLOCK.search(html[at : end.start()]):
                    at = end.end()
                    parts.append(" ")
    if at < n:
        text_of(at, n)
    flush()
    return out


def features(row: list[Block]) -> np.ndarray:
    """Of each block: its text, links, place on the page, structure, and what is around it."""
    out, n = [], len(row)
    for i, b in enumerate(row):
        words = b.text.count(" ") + 1
        around = [row[j] for j in (i - 1, i + 1) if 0 <= j < n]
        long = log1p(words)
        one_of = [float(b.near == k) for k in range(1, 6)]
        out.append([
            1.0, long, max(0.0, long - 3.4), b.linked, b.text[-1:] in ".!?…:;\"”»", b.text.count(",") / words, b.tag in _HEADINGS, b.tag == "h1",
            b.tag in ("p", "blockquote", "pre", "td", "dd"), b.tag == "li", "©" in b.text or "(c)" in b.text.lower(),
            *one_of, *(k * max(0.0, long - 3.4) for k in one_of[2:]), min(b.inside, 2), min(b.against, 2), b.against > 0 and b.inside > 0,
            sum(log1p(x.text.count(" ") + 1) for x in around) / 2, sum(x.linked for x in around) / 2, i == 0, i == n - 1,
        ])
    return np.array(out, np.float64).reshape(n, WIDE)


#: Features of a block.
WIDE = 26
#: Greatest log odds of one block: what is around it can always turn it.
MOST = 8.0


def _page(rng: random.Random) -> list[tuple[str, bool | None]]:
    """A generated page: its pieces in order, and for each whether its text is content; None for markup alone."""
    word = lambda: "".join(rng.choice("aeioubcdfglmnprstv") for _ in range(rng.randrange(2, 9)))
    def text(n, stop=True):
        return escape(" ".join(word() + ("," if rng.random() < 0.06 else "") for _ in range(max(1, n))) + (rng.choice(".!?.") if stop else ""))
    link = lambda n=1: f'<a href="/{word()}">{text(n, False)}</a>'
    named = lambda tag, names: f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">' if rng.random() < 0.85 else f"<{tag}>"
    strong, weak, inn = sorted(_STRONG), sorted(_WEAK), sorted(_IN)
    out: list[tuple[str, bool | None]] = []

    def mark(s):
        out.append((s, None))

    def menu():
        tag = rng.choice(["nav", "div", "ul", "header"])
        mark(f"<{tag}>" if rng.random() < 0.4 else named(tag, ["nav", "menu", "main-menu", "topbar", "navbar", "breadcrumb"]))
        mark("<ul>" if rng.random() < 0.7 else "")
        for _ in range(rng.randrange(3, 9)):
            out.append((f"<li>{link(rng.randrange(1, 3))}</li>" if rng.random() < 0.8 else f"<div>{link()} | {link()}</div>", False))
        mark(f"</ul></{tag}>")

    def boxed(lengths, tag=None, names=None):
        tag = tag or rng.choice(["div", "section", "aside", "footer", "form", "div"])
        names = names or [f"{a}{rng.choice(['', '-box', '-wrap', ' widget', 'Area'])}" for a in rng.sample(strong, 3)]
        mark(named(tag, names) if tag in ("div", "section") else f"<{tag}>")
        if rng.random() < 0.4:
            out.append((f"<h3>{text(rng.randrange(1, 4), False)}</h3>", False))
        for n in lengths:
            out.append((f"<p>{text(n)}{link(2) if rng.random() < 0.3 else ''}</p>" if rng.random() < 0.8 else f"<li>{link(min(n, 8))}</li>", False))
        mark(f"</{tag}>")

    def small():
        return [rng.choice([2, 5, 8, 12, 16, 20, 30, 45]) for _ in range(rng.randrange(1, 4))]

    def weak_box():
        mark(f'<div class="{rng.choice(weak)}{rng.choice(["", "-bar", " box"])}">')
        for _ in range(rng.randrange(1, 3)):
            out.append((f"<p>{text(rng.randrange(2, 20))}</p>", False))
        mark("</div>")

    def prose(depth=0):
        r = rng.random()
        if r < 0.6 or depth > 1:
            out.append((f"<p>{text(rng.choice([1, 3, 8, 15, 30, 45, 60, 100, 150]))}{link(2) if rng.random() < 0.15 else ''}</p>", True))
        elif r < 0.7:
            out.append((f"<h2>{text(rng.randrange(1, 7), False)}</h2>", True))
        elif r < 0.78:
            mark("<ul>")
            for _ in range(rng.randrange(2, 5)):
                out.append((f"<li>{text(rng.randrange(1, 20), rng.random() < 0.5)}</li>", True))
            mark("</ul>")
        elif r < 0.83:
            out.append((f"<blockquote>{text(rng.randrange(3, 50))}</blockquote>", True))
        elif r < 0.87:
            mark("<table><tr>")
            for _ in range(rng.randrange(2, 5)):
                out.append((f"<td>{text(rng.randrange(1, 9), False)}</td>", True))
            mark("</tr></table>")
        elif r < 0.93:  # a wrapper whose name misleads, about long prose
            mark(f'<div class="{rng.choice(weak)}-{rng.choice(["", *inn])}">')
            for _ in range(rng.randrange(1, 3)):
                out.append((f"<p>{text(rng.randrange(45, 150))}</p>", True))
            mark("</div>")
        else:
            mark(f'<div class="{word()}">')
            for _ in range(rng.randrange(1, 3)):
                prose(depth + 1)
            mark("</div>")

    mark("<html><head><title>t</title></head><body>")
    if rng.random() < 0.5:
        mark("<header>" if rng.random() < 0.5 else '<div class="site-header">')
        out.append((f"<div>{text(rng.randrange(1, 5), False)}</div>", False))
        mark("</header></div>")
    if rng.random() < 0.85:
        menu()
    for _ in range(rng.randrange(0, 3)):
        rng.choice([weak_box, lambda: boxed(small())])()
    r = rng.random()
    opened = "<article>" if r < 0.45 else "<main>" if r < 0.6 else f'<div class="{rng.choice(inn)}{rng.choice(["", "-body", "-wrap", "-share-story"])}">' if r < 0.8 else "<div>"
    mark(opened)
    if rng.random() < 0.7:
        out.append((f"<h1>{text(rng.randrange(1, 10), False)}</h1>", True))
    for _ in range(rng.choice([1, 1, 2, 4, 8, 14])):
        prose()
        if rng.random() < 0.12:
            rng.choice([weak_box, lambda: boxed(small(), "div")])()
    if rng.random() < 0.3:  # readers' comments, some of them long
        boxed([rng.choice([6, 20, 40, 80]) for _ in range(rng.randrange(1, 5))], "section", ["comments", "reader-comments", "comment-list", "replies"])
    mark("</" + opened[1:].split()[0].rstrip(">") + ">")
    for _ in range(rng.randrange(0, 3)):
        rng.choice([weak_box, lambda: boxed(small()), lambda: boxed([25, 40], "aside")])()
    if rng.random() < 0.8:
        mark("<footer>" if rng.random() < 0.7 else '<div class="footer">')
        out.append((f"<p>{rng.choice(['© 2020 ', ''])}{text(rng.randrange(2, 25))}</p>", False))
        mark("</footer></div>")
    mark("</body></html>")
    return out


@cache
def weights(pages: int = 800, seed: int = 7, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weights of the classifier, fitted by Newton steps on ``pages`` generated pages; the same wherever it is fitted."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        page = _page(rng)
        known = [c for _, c in page if c is not None]
        row = blocks("".join(s for s, _ in page))
        if len(row) == len(known):
            x.append(features(row))
            y += known
    x, y = np.concatenate(x), np.array(y, np.float64)
    a = np.zeros(WIDE)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(WIDE)
        a += np.linalg.solve(h, x.T @ (y - p) - ridge * a)
    return a


def scores(row: list[Block], fitted: np.ndarray | None = None) -> list[float]:
    """Log odds of each block: above 0 speaks for content."""
    return np.clip(features(row) @ (weights() if fitted is None else fitted), -MOST, MOST).tolist()


def labels(row: list[Block], near: float = 0.6, same_parent: float = 0.5, fitted: np.ndarray | None = None) -> list[bool]:
    """Content side of the minimum cut."""
    cost = scores(row, fitted)
    n = len(row)
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(row):
        if i:
            edges[i - 1, i] = near if row[i - 1].parent == b.parent else near / 3
        if (k := last.get(b.parent)) is not None:
            edges[k, i] = edges.get((k, i), 0.0) + same_parent
        last[b.parent] = i
    return min_cut(cost, edges)


def min_cut(cost: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Nodes on the source side: ``cost`` > 0 is capacity from the source, < 0 to the sink; ``edges`` have one capacity either way.

    Blocking flows over breadth-first levels. A pair of equal cuts gives the smaller source side.
    """
    n = len(cost)
    nbr: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for (i, j), c in edges.items():
        nbr[i].append(len(to))
        nbr[j].append(len(to) + 1)
        to += (j, i)
        cap += (c, c)
    supply, demand = [max(c, 0.0) for c in cost], [max(-c, 0.0) for c in cost]
    eps = 1e-9
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if supply[i] > eps]
        for i in queue:
            level[i] = 0
        reached = False
        for u in queue:
            if demand[u] > eps:
                reached = True
            for e in nbr[u]:
                v = to[e]
                if cap[e] > eps and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if not reached:
            return [x >= 0 for x in level]
        it = [0] * n
        for s in [i for i in queue if supply[i] > eps]:
            path, u = [], s
            while supply[s] > eps:
                if demand[u] > eps:
                    f = min(supply[s], demand[u], *(cap[e] for e in path)) if path else min(supply[s], demand[u])
                    supply[s] -= f
                    demand[u] -= f
                    for e in path:
                        cap[e] -= f
                        cap[e ^ 1] += f
                    path, u = [], s
                    continue
                while it[u] < len(nbr[u]):
                    e = nbr[u][it[u]]
                    if cap[e] > eps and level[to[e]] == level[u] + 1:
                        path.append(e)
                        u = to[e]
                        break
                    it[u] += 1
                else:
                    if not path:
                        break
                    u = to[path.pop() ^ 1]
                    it[u] += 1


def main_text(html: str | None, fitted: np.ndarray | None = None) -> str:
    """Content blocks of a page, joined by two newlines; empty if there is none."""
    row = blocks(html or "")
    return "\n\n".join(b.text for b, keep in zip(row, labels(row, fitted=fitted), strict=True) if keep) if row else ""


def extract(pages: DataFrame, html: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; null html is empty. Rows are independent, so nothing is shuffled.

    Repeated rows come out as often, an empty table gives none, other columns are ignored; pages may have any length.
    """
    box = pages.sparkSession.sparkContext.broadcast(weights())

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = [main_text(h, box.value) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
