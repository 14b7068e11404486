"""Main text of web pages by a tree-structured graphical model.

Block elements of a page are the variables of a tree: each is content, boilerplate, or a container of both. Evidence at an element is
its tag, the part of the page that its class, id or role names, the share of link text below it and the length of its own text;
parent-child potentials tie an element to its parent. Sum-product messages, up the tree and down again, give every
element's marginals. All tables are counted, with smoothing, on labelled pages (html_samples). Text counts as its
nearest block element does.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .html_samples import labelled_pages
from .words import pieces

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LABEL = re.compile(r'data-l="(.)"')
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup and ends with their own end tag, or with the page.
_RAW = frozenset("script style title textarea iframe".split())
#: Elements without text of the page's own. They end with their end tag, their parent's, or, drawings, where a block opens; one whose end
#: tag doesn't follow at all is passed over.
_SKIPPED = frozenset("noscript template svg select datalist annotation annotation-xml".split())
_BLOCK = frozenset("html head body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot "
                   "caption tr td th blockquote pre figure figcaption form fieldset legend label button details summary address dialog hgroup search menu center".split())
#: What an opening tag closes, up to the element that stops the search.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_PARTS = {"nav": "nav menu navbar topnav navigation breadcrumb breadcrumbs pagination pager", "head": "header masthead topbar branding banner site",
          "foot": "footer copyright colophon legal imprint", "side": "sidebar side aside widget related recommended rail complementary more",
          "ad": "ad ads advert advertisement sponsored sponsor promo promotion", "notice": "cookie cookies notice consent alert gdpr disclaimer modal popup overlay warning",
          "form": "form search newsletter subscribe login signup register", "comment": "comment comments replies reply respond discussion disqus reader",
          "share": "share social tags toolbar tools buttons", "content": "content article post entry main story body text"}
_PART_OF = {w: k for k, words in _PARTS.items() for w in words.split()}
_RANK = ["comment", "ad", "notice", "form", "nav", "foot", "side", "share", "content", "head"]
STATES = "mcb"


class Page:
    """Block elements in page order (a parent before its children) and the text of each block."""

    def __init__(self, source: str, labels: bool = False):
        self.tag, self.part, self.parent, self.label = ["html"], [None], [-1], [None]
        self.blocks: list[tuple[int, list[str]]] = []
        self.own, self.link = [0], [0]
        stack, open_blocks, text, links, at = [], [0], [], 0, 0
        # How often each name is open, where its next end tag is, and the place in the stack of the element that is skipped.
        count, ends_at, skipped = Counter(), {}, None

        def flush() -> None:
            nonlocal text
            if text:
                self.blocks.append((open_blocks[-1], text))
                text = []

        def pop(to: int) -> None:
            nonlocal links, skipped
            while len(stack) > to:
                name, is_block = stack.pop()
                count[name] -= 1
                if is_block:
                    flush()
                    open_blocks.pop()
                elif name == "a":
                    links -= 1
            if skipped is not None and to <= skipped:
                skipped = None

        def push(name: str, is_block: bool = False) -> None:
            stack.append((name, is_block))
            count[name] += 1

        def close(name: str) -> None:
            """Close the innermost open element of the name and all within it."""
            to = len(stack) - 1
            while stack[to][0] != name:
                to -= 1
            pop(to)

        def ends(name: str) -> bool:
            """Whether an end tag of the name follows; each stretch of the page is searched once a name."""
            if ends_at.get(name, -1) < at:
                found = re.compile(rf"</{name}\b", re.I).search(source, at)
                ends_at[name] = found.start() if found else len(source) + 1
            return ends_at[name] <= len(source)

        def add(raw: str) -> None:
            if raw and skipped is None:
                s = html.unescape(raw) if "&" in raw else raw
                text.append(s)
                n = len(s.strip())
                self.own[open_blocks[-1]] += n
                if links:
                    self.link[open_blocks[-1]] += n

        for m in iter(lambda: _TOKEN.search(source, at), None):
            add(source[at:m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if count[name]:
                    close(name)
                continue
            if name in _RAW:
                if not m[0].endswith("/>"):
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if skipped is not None:
                if stack[skipped][0] != "svg" or name not in _BLOCK or count["foreignobject"]:
                    if name not in _VOID and not m[0].endswith("/>"):
                        push(name)
                        links += name == "a"
                    continue
                pop(skipped)
            if name in _SKIPPED:
                if not m[0].endswith("/>") and ends(name):
                    skipped = len(stack)
                    push(name)
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in _VOID:
                if name == "hr":
                    flush()
                continue
            if name in _CLOSES:
                closed, stops = _CLOSES[name]
                for i in range(len(stack) - 1, -1, -1) if any(count[c] for c in closed) else ():
                    if stack[i][0] in stops:
                        break
                    if stack[i][0] in closed:
                        pop(i)
                        break
            if name in _BLOCK:
                if count["p"] and name not in ("label", "button"):
                    close("p")
                flush()
                attributes = m[3] if m[3] is not None else m[6]
                if name == "html" and len(self.tag) == 1 and not stack:
                    self.label[0] = _LABEL.search(attributes)[1] if labels else None
                    push(name, True)
                    open_blocks.append(0)
                    continue
                found = {_PART_OF[w.lower()] for v in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall(v[1] or v[2] or v[3] or "") if w.lower() in _PART_OF} if attributes else ()
                self.parent.append(open_blocks[-1])
                self.tag.append(name)
                self.part.append(next((k for k in _RANK if k in found), None))
                self.label.append(_LABEL.search(attributes)[1] if labels and "data-l" in attributes else None)
                self.own.append(0)
                self.link.append(0)
                open_blocks.append(len(self.tag) - 1)
            elif name == "a":
                links += 1
            push(name, name in _BLOCK)
        add(source[at:])
        flush()

    def evidence(self) -> list[tuple]:
        total, linked = self.own[:], self.link[:]
        for i in range(len(self.tag) - 1, 0, -1):
            total[self.parent[i]] += total[i]
            linked[self.parent[i]] += linked[i]
        return [(self.tag[i], self.part[i], 4 if not total[i] else min(3, int(3.999 * linked[i] / total[i])), min(5, self.own[i].bit_length() // 2)) for i in range(len(self.tag))]


class Model:
    """Potentials in counts turned to probabilities; messages stay plain numbers because each is normalised."""

    def __init__(self, pages: list[Page]):
        kinds = [{} for _ in range(4)]
        states = [1.0] * 3
        step = [[0.5] * 3 for _ in range(3)]
        root = [1.0] * 3
        seen = []
        for page in pages:
            evidence, at = page.evidence(), [STATES.index(x) if x else None for x in page.label]
            for i, s in enumerate(at):
                if s is None:
                    continue
                seen.append((s, evidence[i]))
                states[s] += 1
                if i == 0:
                    root[s] += 1
                elif at[page.parent[i]] is not None:
                    step[at[page.parent[i]]][s] += 1
        for s, e in seen:
            for k, v in enumerate(e):
                kinds[k].setdefault(v, [0.5] * 3)[s] += 1
        self.root = [x / sum(root) for x in root]
        self.step = [[x / sum(row) for x in row] for row in step]
        # An unseen value says nothing; link share and text length, which go with tag and name, count half.
        self.kinds = [{v: [(c / (states[s] + 0.5 * len(kind))) ** power for s, c in enumerate(row)] for v, row in kind.items()} for kind, power in zip(kinds, (1, 1, 0.5, 0.5))]

    def marginals(self, page: Page) -> list[float]:
        """Probability that each element is content."""
        n, none, step, parent = len(page.tag), [1.0] * 3, self.step, page.parent
        kinds = self.kinds
        up = []
        for e in page.evidence():
            a, b, c, d = (kinds[k].get(e[k], none) for k in range(4))
            up.append([a[s] * b[s] * c[s] * d[s] for s in range(3)])
        message = [none] * n
        for i in range(n - 1, 0, -1):
            x, y, z = up[i]
            m = [row[0] * x + row[1] * y + row[2] * z for row in step]
            t = m[0] + m[1] + m[2] or 1.0
            message[i] = m = [m[0] / t, m[1] / t, m[2] / t]
            p = up[parent[i]]
            p[0], p[1], p[2] = p[0] * m[0], p[1] * m[1], p[2] * m[2]
            if (t := p[0] + p[1] + p[2]) < 1e-100:
                p[0], p[1], p[2] = (v / t if t else 1.0 for v in p)
        belief = [[r * u for r, u in zip(self.root, up[0])]]
        t = sum(belief[0]) or 1.0
        belief[0] = [v / t for v in belief[0]]
        for i in range(1, n):
            q = [v / max(m, 1e-300) for v, m in zip(belief[parent[i]], message[i])]
            own = [(q[0] * step[0][s] + q[1] * step[1][s] + q[2] * step[2][s]) * up[i][s] for s in range(3)]
            t = own[0] + own[1] + own[2] or 1.0
            belief.append([own[0] / t, own[1] / t, own[2] / t])
        return [b[1] for b in belief]


@lru_cache(1)
def trained() -> Model:
    return Model([Page(p, labels=True) for p in labelled_pages()])


def main_text(source: str | None, model: Model | None = None) -> str:
    """The page's content blocks, white space in each turned into one space, joined by two line ends."""
    if not source:
        return ""
    page = Page(source)
    content = (model or trained()).marginals(page)
    blocks = (" ".join("".join(parts).split()) for node, parts in page.blocks if content[node] >= 0.5)
    return "\n\n".join(b for b in blocks if b)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(*keep, text, n_chars): the main text of every row's whole page. A null or empty page, or one without content, has an empty
    text. Rows are independent: repeats and nulls in other columns pass through, columns that are not kept are left out, and an empty table
    gives none. Time grows with a page's length, however deep its elements nest. The model is trained once per Python worker."""
    narrow = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("__page__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for b in pieces(batches, "__page__"):
            texts = [main_text(h, model) for h in b.column(len(keep)).to_pylist()]
            yield pa.record_batch([*b.columns[:len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = "".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}, " for c in keep)
    return narrow.mapInArrow(run, f"{kinds}text string, n_chars long")
