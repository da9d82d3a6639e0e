"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree. Each has a hidden label, content or not, with a potential from what is seen of the
element (share of link text, length of text), and each parent and child have a joint potential, which depends on the child's tag and
the words of its class and id. Sum-product message passing up and down the tree gives every element's marginal; the text
of elements that are more likely content than not is the result. Potentials are learned from labelled pages: a set of page skeletons that is built
by rule below, and a bounded sample of the given pages that mark their content by an element for it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqalert.llm.text import emitted, made, rows, sampled, share_parts

#: Pages of the table, about, that the potentials are learned from, chosen by a seeded hash. Pages over 200 000 characters
#: teach nothing.
FIT_ROWS = 400

#: Elements inside a line of text; they are no nodes.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("applet audio button canvas datalist head iframe math noframes noscript object option script select style svg template textarea title video".split())
#: Elements whose content is not markup.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: An element whose start ends an open one of the same group: it, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Elements whose start ends an open paragraph or heading line.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold one line: what is no block inside them is part of it, whatever its name.
LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Elements for parts around the content, and for the content itself: pages that use them label themselves.
AROUND, CORE = frozenset("aside dialog footer form header menu nav".split()), frozenset("article main".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*))>""")
#: A tag whose quotes do not match ends at the next sign that ends tags.
_ODD_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_KEEP = re.compile(r'data-keep="([01])"')
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "chars", "linked", "hidden")

    def __init__(self, tag: str, attrs: str, parent: int, hidden: bool):
        self.tag, self.attrs, self.parent, self.hidden = tag, attrs, parent, hidden
        self.parts: list = []  # texts of the element itself, and None where a child stands
        self.chars = self.linked = 0


def parse(page: str) -> list[Node]:
    """Block elements of a page in document order; the first is the page itself."""
    nodes = [Node("html", "", -1, False)]
    stack, link, at, size = [0], 0, 0, len(page)
    still: Counter = Counter()  # open elements by name

    def drop(place: int) -> None:
        still.subtract(nodes[i].tag for i in stack[place:])
        del stack[place:]

    def push(i: int) -> None:
        stack.append(i)
        still[nodes[i].tag] += 1

    def say(text: str) -> None:
        node = nodes[stack[-1]]
        if node.hidden or not text:
            return
        node.parts.append(text)
        n = len(text) - text.count(" ")
        node.chars += n
        node.linked += n if link else 0

    while at < size:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        found = _TAG.match(page, start) or _ODD_TAG.match(page, start)
        if found is None:  # no tag: the sign stands for itself, but an unfinished tag at the end is dropped
            if page[start + 1 : start + 2].isalpha() and page.find(">", start) < 0:
                break
            say("<")
            at = start + 1
            continue
        closing, tag, attrs = found[1], found[2].lower(), found[3]
        at = found.end()
        if tag in INLINE:
            if tag == "a":
                link = not closing
            elif tag == "br":
                say("\n")
            continue
        if closing:
            if still[tag] > 0:
                drop(next(i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag))
                link = 0 if tag in BLOCKS else link
            continue
        if tag in ("html", "body"):
            continue
        hidden, last = tag in HIDDEN, nodes[stack[-1]].tag
        if not hidden and tag not in BLOCKS and last in LINES:
            continue
        if tag in BLOCKS:
            link = 0
            if last == "p":
                drop(len(stack) - 1)
        if tag in ENDS and any(still[t] > 0 for t in ENDS[tag][0]):
            ended, stop = ENDS[tag]
            place = len(stack) - 1
            last = 0
            while place > 0 and nodes[stack[place]].tag not in stop:
                if nodes[stack[place]].tag in ended:
                    last = place
                place -= 1
            if last:
                drop(last)
        above = stack[-1]
        nodes.append(Node(tag, attrs, above, nodes[above].hidden or hidden))
        if not hidden:  # what is never shown does not part the text around it
            if nodes[above].parts and nodes[above].parts[-1] is not None:
                nodes[above].parts.append(None)
            nodes[above].parts.append(len(nodes) - 1)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            if end is None:
                at = size
            else:
                close = page.find(">", end.end())
                at = size if close < 0 else close + 1
        elif tag not in VOID:
            push(len(nodes) - 1)  # a slash ends no element that is not empty by kind
    return nodes


def described(node: Node) -> tuple[str, ...]:
    """Tag of an element and words of its class, id and role."""
    out = [f"tag:{node.tag}"]
    for found in _ATTR.finditer(node.attrs):
        out += [f"name:{w}" for w in _NAME.findall((found[2] or found[3] or found[4] or "").lower()) if len(w) > 1]
    return tuple(dict.fromkeys(out))


def seen(nodes: list[Node]) -> list[str]:
    """Share of link text and length of text of each element with all below it."""
    chars, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        chars[up] += chars[i]
        linked[up] += linked[i]
    out = []
    for c, k in zip(chars, linked):
        share = k / c if c else 0
        links = "none" if share == 0 else "few" if share < 0.3 else "half" if share < 0.7 else "most"
        out.append(links + (" empty" if c == 0 else " short" if c < 40 else " line" if c < 200 else " long"))
    return out


class TreeModel:
    """``evidence``: likelihood of what is seen of an element if it is content, over that if it is not. ``weights`` and ``bias``:
    log odds that a child of content is content, by the child's description. A child of what is no content is content
    with probability ``RARE``."""

    RARE = 0.001

    def __init__(self, weights: dict[str, float], bias: float, evidence: dict[str, float]):
        self.weights, self.bias, self.evidence = weights, bias, evidence
        self.known: dict = {}

    def joint(self, node: Node) -> float:
        """Probability that the element is content if its parent is."""
        key = node.tag, node.attrs
        p = self.known.get(key)
        if p is None:
            z = self.bias + sum(self.weights.get(x, 0.0) for x in described(node))
            p = 1 / (1 + np.e ** -max(-20.0, min(20.0, z)))
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[key] = p
        return p

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for every element, by one pass of messages up and one down the tree."""
        n, rare = len(nodes), self.RARE
        below = [(1.0, self.evidence.get(x, 1.0)) for x in seen(nodes)]  # belief from the element and all below it
        sent: list = [None] * n
        likely = [0.99, *map(self.joint, nodes[1:])]
        for i in range(n - 1, 0, -1):
            (a, b), p, k = below[i], likely[i], nodes[i].parent
            m0, m1 = (1 - rare) * a + rare * b, (1 - p) * a + p * b
            sent[i] = m0, m1
            m0, m1 = below[k][0] * m0, below[k][1] * m1
            below[k] = (m0 / (m0 + m1), m1 / (m0 + m1))
        both: list = [None] * n
        a, b = below[0][0] * 0.01, below[0][1] * 0.99
        both[0] = (a / (a + b), b / (a + b))
        for i in range(1, n):
            k, p = nodes[i].parent, likely[i]
            p0, p1 = both[k][0] / sent[i][0], both[k][1] / max(sent[i][1], 1e-300)  # the parent without this child
            a, b = below[i][0] * (p0 * (1 - rare) + p1 * (1 - p)), below[i][1] * (p0 * rare + p1 * p)
            both[i] = (a / (a + b), b / (a + b))
        return [b for _, b in both]

    def extract(self, page: str | None) -> str:
        """Content blocks in page order, one per line, each with its white space turned into single spaces."""
        if not page:
            return ""
        nodes = parse(page)
        keep = [p > 0.5 for p in self.marginals(nodes)]
        blocks: list[str] = []
        # Depth first without recursion; a child ends the run of text before it.
        todo: list = [(0, 0)]
        while todo:
            i, at = todo.pop()
            parts, held = nodes[i].parts, []
            while at < len(parts):
                part = parts[at]
                at += 1
                if isinstance(part, str):
                    held.append(part)
                    continue
                if held and keep[i]:
                    blocks.append("".join(held))
                held = []
                if part is not None:
                    todo += [(i, at), (part, 0)]
                    break
            else:
                if held and keep[i]:
                    blocks.append("".join(held))
        lines = (" ".join(html.unescape(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def labelled(nodes: list[Node]) -> list[bool | None] | None:
    """Labels of the elements of a page that marks its content: by ``data-keep`` where it is given, else by an article or main
    element outside the parts around it. What such an element holds under a class or id is unknown (None), as comments
    or adverts may stand there. None for a page that marks nothing."""
    label: list = [None] * len(nodes)
    marked = [_KEEP.search(n.attrs) for n in nodes]
    if any(marked):
        for i, m in enumerate(marked):
            label[i] = m[1] == "1" if m else label[nodes[i].parent] if i else None
    else:
        for i, n in enumerate(nodes):
            above = label[n.parent] if i else None
            if n.tag in AROUND:
                label[i] = False
            elif above is True and len(described(n)) > 1:
                label[i] = "unknown"
            else:
                label[i] = above if above is not None else True if n.tag in CORE else None
        if True not in label:
            return None
    out = [x is True for x in label]
    for i in range(len(nodes) - 1, 0, -1):  # what holds content and is not marked is part of its way up
        if out[i] and label[nodes[i].parent] is None:
            out[nodes[i].parent] = True
    return [None if x == "unknown" else y for x, y in zip(label, out)]


def skeletons() -> Iterator[str]:
    """Labelled pages: each way to wrap a text with some of the parts that stand around or inside it."""
    core = ['article', 'main', 'div class="content"', 'div id="content"', 'div class="post-body entry"', 'section class="article-body"', 'div class="story text"', 'div id="main"', 'article class="post"', 'div class="col left"', 'div', 'section', 'div class="inner wide"', 'td']
    around = (
        "nav|header|footer|aside|form|dialog|menu|div class=menu|div class=navbar nav|div id=nav|ul class=nav menu|div class=header|div id=footer|div class=sidebar|"
        "div id=side-bar|section class=related|div class=ad|div class=ads|div class=advert|div class=advertisement|div class=banner ad|div class=promo|div class=sponsored|"
        "div class=cookie-notice|div id=cookie-banner|div class=notice|div class=consent|div class=popup modal|div class=newsletter subscribe|div class=share social|"
        "div class=breadcrumbs|div class=comments|section id=comments|div class=comment|ol class=comment-list|div class=reply|article class=comment|div class=disqus|"
        "div class=login|div class=search|div class=widget|div class=tags|div class=pagination pager|div class=copyright|div class=legal"
    ).split("|")
    line = "Some words that make a plain sentence of the usual kind, with a second clause to it. "
    for i, part in enumerate(around):
        tag, _, names = part.partition(" ")
        name = f' {names.replace("=", chr(61) + chr(34), 1)}"' if names else ""
        links = "<ul>" + "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(5)) + "</ul>"
        inside = (f"<p>{line}</p><p>Name wrote: {line * 2}</p>", links, "Short text.", f"<p>{line}</p>{links}")[i % 4]
        box = f'<{tag}{name} data-keep="0">{inside}</{tag}>'
        for k in range(3):
            first = core[(i + 3 * k) % len(core)]
            text = f"<h1>Title of it</h1><p>{line * (k + 2)}</p><h2>Part</h2><p>Short.</p><ul><li>{line}</li><li>One</li></ul><blockquote><p>{line}</p></blockquote><table><tr><td>1</td></tr></table><p>{line * 3}</p>"
            body = f'<{first} data-keep="1">{text}{box if k == 2 else ""}</{first.split()[0]}>'
            yield f"<html><body><div class=\"page wrapper\">{box if k != 2 else ''}{body}<footer data-keep=\"0\">&copy; 1 <a href=\"/\">Home</a></footer></div></body></html>"


def fit(pages: Iterable[str]) -> TreeModel:
    """Potentials from labelled pages: a penalised logistic fit of the labels of children of content by their description, and
    smoothed counts of what is seen of elements by label."""
    told: Counter = Counter()
    looks = {True: Counter(), False: Counter()}
    for page in pages:
        nodes = parse(page)
        label = labelled(nodes)
        if label is None:
            continue
        for node, look, y in zip(nodes[1:], seen(nodes)[1:], label[1:]):
            if y is None:
                continue
            looks[y][look] += 1
            if label[node.parent]:
                told[described(node), y] += 1
    every = set(looks[True]) | set(looks[False])
    total = {y: sum(c.values()) + len(every) for y, c in looks.items()}
    # The root holds back evidence that an element shares with those around it.
    evidence = {x: float(np.power(((looks[True][x] + 1) / total[True]) / ((looks[False][x] + 1) / total[False]), 0.25)) for x in every}
    names = sorted({x for f, _ in told for x in f})
    at = {x: i for i, x in enumerate(names)}
    row = np.repeat(np.arange(len(told)), [len(f) for f, _ in told])
    col = np.array([at[x] for f, _ in told for x in f])
    y = np.array([float(label) for _, label in told])
    n = np.sqrt(np.array(list(told.values()), float))  # the same element on very many pages does not outweigh all others
    w, b = np.zeros(len(names)), 0.0
    step = 1 / (0.25 * 6 * np.bincount(col, n[row], len(names)) + 0.02)
    at_w, at_b = w, b
    for i in range(2000):
        r = n * (1 / (1 + np.exp(-(at_b + np.bincount(row, at_w[col], len(y))))) - y)
        new, new_b = at_w - step * (np.bincount(col, r[row], len(names)) + 0.02 * at_w), at_b - r.sum() / (0.25 * 6 * n.sum())
        pull = i / (i + 3)
        at_w, at_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return TreeModel(dict(zip(names, w.tolist())), float(b), evidence)


def extracted(pages: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 3, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row of ``pages``.

    A null or empty page, and one without content, has an empty text. Pages are read whole. Rows that repeat an id are rows of
    the result; other columns are ignored; an empty table gives no rows."""
    picked = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    sample = sampled(picked, ["page_id", "url"], fit_rows, seed).where("length(html) between 1 and 200000").select("html").collect()
    model = fit([*skeletons(), *sorted(r["html"] for r in sample)])
    told = share_parts(pages.sparkSession.sparkContext, model.weights, model.bias, model.evidence)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def make(batches):
        m = made(told, TreeModel)
        for i, address, source in rows(batches):
            text = m.extract(source)
            yield i, address, text, len(text)

    return picked.mapInArrow(lambda b: emitted(make(b), schema, 500), "page_id bigint, url string, text string, n_chars bigint")
