"""Main text of web pages by a graphical model on the DOM tree.

Every block-level element and every run of text is a node that is content or not. A node has
a potential from its features (tag, names in class, id and role, links, length, form
fields, wording), an edge one from the two labels of parent and child. Messages passed up and then
down the tree give each node's marginal exactly; runs of text with a marginal of a half or
more are the main text.

The weights are fitted by maximum likelihood, with the same messages, on labelled pages: a
bounded set of layouts written out below by rule, on filler words, plus any the caller has.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.llm.text import per_batch

#: fixed values: elements by their part in the tree
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "iframe legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template svg math title select option textarea button object canvas audio video iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FIELDS = frozenset("input select textarea button".split())
#: silent elements whose content has no tags but their own end tag
RAW = {x: re.compile(rf"</{x}(?=[ \t\n\f\r/>])[^>]*+(?:>|\Z)", re.I | re.A) for x in ("script", "style", "textarea", "title")}
#: silent elements of another vocabulary, and the elements in them that hold HTML again; elsewhere in them a tag of BREAKS ends them
FOREIGN = {"svg": ("foreignobject", "desc", "title"), "math": ("annotation-xml", "mi", "mo", "mn", "ms", "mtext")}
BREAKS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: silent elements that start tags of these names end
ONCE = {"button": ("button",), "option": ("option", "optgroup"), "select": ("select", "input", "textarea")}
#: silent elements that end with an open paragraph before them at the next block
PLAIN = frozenset("canvas audio video option".split())
#: a slash that ends a tag and is not the end of an unquoted value
UNQUOTED = re.compile(r"""=\s*[^\s"'=]*+(?<=/)$""")
#: a start tag ends an open element of these names
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th")}
HOLDERS = frozenset("ul ol dl table menu".split())
CUES = ("cookie", "subscribe", "newsletter", "sponsored", "log in", "sign up")

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@lru_cache(100_000)
def named(tag: str, attrs: str) -> tuple[str, ...]:
    """Features of an element from its tag and the words of its class, id and role."""
    words = (w.lower() for m in NAMES.finditer(attrs) for part in m.groups() if part for w in WORD.findall(part))
    return ("tag:" + tag, *sorted({"name:" + w for w in words}))


class Tree:
    """Nodes in page order, parents first: parent, features, text (None for elements)."""

    def __init__(self, page: str):
        self.parent, self.tags, self.names, self.text, self.links, self.fields = [-1], ["root"], [("tag:root",)], [None], [0], [0]
        self.labels: list[int | None] = [None]
        self._parse(page)

    def _parse(self, page: str) -> None:
        stack, run, linked, in_link = [0], [], 0, 0
        silent, inside, inline = None, Counter(), Counter()  # elements open in the silent one, and open elements that are no blocks

        def flush():
            nonlocal linked
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                self._add(stack[-1], "text", ("tag:text",), text, min(linked, len(text)))
            run.clear()
            linked = 0

        def implied(tag):
            """Place in the stack of the open element that a start tag ends."""
            ends = IMPLIED.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if self.tags[stack[k]] in ends:
                    return k
                if not ends or self.tags[stack[k]] in HOLDERS:
                    break

        def within(tag, closing):
            """Whether a tag leaves the silent element open: it ends with itself, its parent, or what the next element may not be in."""
            if closing:
                if inside[tag]:
                    inside[tag] -= 1
                    return True
                return tag != silent and tag != "head" and not inline[tag] and tag not in (self.tags[i] for i in stack[1:])
            if tag == "body" or tag in ONCE.get(silent, ()):
                return False
            if silent in FOREIGN:
                return tag not in BREAKS or any(inside[x] for x in FOREIGN[silent])
            if tag in BLOCK and not any(inside[x] for x in HOLDERS):
                return (silent == "template" or implied(tag) is None) and not (silent in PLAIN and self.tags[stack[-1]] == "p")
            return True

        at, end = 0, len(page)
        while m := TAG.search(page, at):
            if silent is None and m.start() > at:
                part = page[at : m.start()]
                run.append(part)
                linked += len(part) if in_link else 0
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag, closing = tag.lower(), bool(m[1] or m[4])
            attrs = m[3] or m[6] or ""
            alone = tag in VOID or attrs.endswith("/") and not UNQUOTED.search(attrs)
            if silent is not None:
                if within(tag, closing):
                    if not closing and tag in RAW and silent not in FOREIGN:
                        over = RAW[tag].search(page, at)
                        at = over.end() if over else end
                    elif not closing and not alone:
                        inside[tag] += 1
                    continue
                silent = None
            if not closing and tag in FIELDS:
                self.fields[stack[-1]] += 1
            if tag in SILENT:
                if not closing:
                    run.append(" ")
                    if tag in RAW:
                        over = RAW[tag].search(page, at)
                        at = over.end() if over else end
                    elif not alone:
                        silent = tag
                        inside.clear()
                continue
            if tag not in BLOCK and tag not in VOID:
                inline[tag] = max(0, inline[tag] + (-1 if closing else 1))
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                run.append(" ")
            if tag not in BLOCK:
                continue
            flush()
            if closing:
                if tag in (self.tags[i] for i in stack[1:]):
                    while self.tags[stack.pop()] != tag:
                        pass
                in_link = 0
                continue
            if self.tags[stack[-1]] == "p":
                stack.pop()
            if (k := implied(tag)) is not None:
                del stack[k:]
            if tag not in VOID:
                stack.append(self._add(stack[-1], tag, named(tag, attrs), None, 0))
                mark = re.search(r"data-label=\"?([01])", m[3] or "")
                self.labels[-1] = int(mark[1]) if mark else None
        if silent is None and at < end:
            run.append(page[at:])
        flush()

    def _add(self, parent, tag, names, text, links) -> int:
        self.parent.append(parent)
        self.tags.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.links.append(links)
        self.fields.append(0)
        self.labels.append(None)
        return len(self.parent) - 1

    def features(self) -> list[tuple[str, ...]]:
        n = len(self.parent)
        size = [len(t) if t else 0 for t in self.text]
        links, fields, runs, stops = list(self.links), list(self.fields), [int(bool(t)) for t in self.text], [0] * n
        for i, t in enumerate(self.text):
            if t:
                stops[i] = len(re.findall(r"[.!?…](?:\s|$)", t))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            size[p] += size[i]
            links[p] += links[i]
            fields[p] += fields[i]
            runs[p] += runs[i]
            stops[p] += stops[i]
        out = []
        for i in range(n):
            kind = "t" if self.text[i] else "e"
            ratio = links[i] / size[i] if size[i] else 0.0
            f = [*self.names[i], f"{kind}size:{min(12, size[i].bit_length())}", f"{kind}links:{min(3, int(ratio * 4))}", f"{kind}stops:{min(3, stops[i])}"]
            if fields[i]:
                f.append(f"fields:{min(2, fields[i])}")
            if self.text[i]:
                low = self.text[i][:400].lower() if size[i] < 400 else ""
                f += ["cue:" + c for c in CUES if c in low]
                f.append("under:" + self.tags[self.parent[i]])
            elif runs[i] > 2:
                f.append(f"mean:{min(10, (size[i] // runs[i]).bit_length())}")
            out.append(tuple(f))
        return out


def _lse(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Model:
    """Weights of features and of the four label pairs of an edge (parent, child)."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.edge = [[0.5, -0.5], [-0.5, 0.5]]

    def score(self, feats: tuple[str, ...]) -> float:
        w = self.w
        return sum(w[f] for f in feats if f in w)

    def marginals(self, parent: list[int], unary: list[float], pairs: list | None = None) -> list[float]:
        """P(content) of every node by sum-product; with ``pairs`` also each edge's joint."""
        (t00, t01), (t10, t11) = self.edge
        n = len(parent)
        up, belief = [0.0] * n, list(unary)
        for i in range(n - 1, 0, -1):  # leaves to root
            b = belief[i]
            up[i] = _lse(t10, t11 + b) - _lse(t00, t01 + b)
            belief[parent[i]] += up[i]
        for i in range(1, n):  # root to leaves
            rest = belief[parent[i]] - up[i]
            if pairs is not None:
                b = belief[i]
                logs = (t00, t01 + b, t10 + rest, t11 + rest + b)
                top = max(logs)
                e = [math.exp(x - top) for x in logs]
                z = sum(e)
                pairs.append((i, [x / z for x in e]))
            belief[i] += _lse(t01, t11 + rest) - _lse(t00, t10 + rest)
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, b)))) for b in belief]

    def fit(self, pages: list[tuple[list[int], list[tuple[str, ...]], list[int]]], rounds: int = 80, rate: float = 0.4, decay: float = 0.004) -> Model:
        """Gradient ascent on the exact likelihood of the labels, with a penalty on large weights."""
        total: dict[str, float] = {}
        for _, feats, _ in pages:
            for fs in feats:
                for f in fs:
                    total[f] = total.get(f, 0.0) + 1.0
        self.w = dict.fromkeys(sorted(total), 0.0)
        n_edges = sum(len(p) - 1 for p, _, _ in pages)
        for _ in range(rounds):
            grad, edge = dict.fromkeys(self.w, 0.0), [[0.0, 0.0], [0.0, 0.0]]
            for parent, feats, y in pages:
                pairs: list = []
                p = self.marginals(parent, [self.score(f) for f in feats], pairs)
                for i, fs in enumerate(feats):
                    d = y[i] - p[i]
                    for f in fs:
                        grad[f] += d
                for i, q in pairs:
                    edge[y[parent[i]]][y[i]] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            edge[a][b] -= q[2 * a + b]
            for f, g in grad.items():
                self.w[f] += rate * (8 * g / (total[f] + 8) - decay * total[f] / (total[f] + 8) * self.w[f] - decay * self.w[f])
            for a in (0, 1):
                for b in (0, 1):
                    self.edge[a][b] += rate * (4 * edge[a][b] / n_edges - decay * self.edge[a][b])
        return self

    def text(self, page: str) -> str:
        tree = Tree(page)
        p = self.marginals(tree.parent, [self.score(f) for f in tree.features()])
        return "\n".join(t for t, x in zip(tree.text, p) if t and x >= 0.5)


def labelled_tree(page: str) -> tuple[list[int], list[tuple[str, ...]], list[int]]:
    """Training form of a page whose elements carry ``data-label``: the nearest label above decides.

    An element that holds the content of the page (half of its text at least) is content.
    """
    tree = Tree(page)
    n = len(tree.parent)
    y, size, good = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        y[i] = tree.labels[i] if tree.labels[i] is not None else y[tree.parent[i]]
        if tree.text[i]:
            size[i], good[i] = len(tree.text[i]), len(tree.text[i]) * y[i]
    for i in range(n - 1, 0, -1):
        size[tree.parent[i]] += size[i]
        good[tree.parent[i]] += good[i]
        if not tree.text[i]:
            y[i] = int(size[i] > 0 and 2 * good[i] >= size[i]) if size[i] else y[i]
    y[0] = int(size[0] > 0 and 2 * good[0] >= size[0])
    return tree.parent, tree.features(), y


def layouts(seed: int = 7, n: int = 160) -> list[str]:
    """Labelled pages by rule: article bodies of many lengths among the usual furniture of a page."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice(("ka", "lo", "mi", "ter", "ssa", "vo", "re", "an", "du", "ing")) for _ in range(rng.randrange(1, 4)))

    def words(a, z):
        return " ".join(word() for _ in range(rng.randrange(a, z)))

    def sentence(a=4, z=18):
        return words(a, z).capitalize() + rng.choice("....!?")

    def para(most=7):
        return " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5, most))))

    def links(k, sep=""):
        return sep.join(f"<li><a href='/{word()}'>{words(1, 4)}</a></li>" for _ in range(k))

    def name(*options):
        return rng.choice(options)

    def furniture(kind):
        k = rng.randrange(3, 9)
        return {
            "nav": lambda: f"<nav{name('', ' class=menu', ' id=main-nav', ' role=navigation')}><ul>{links(k)}</ul></nav>",
            "menu": lambda: f"<div class='{name('menu', 'navbar', 'top-menu navigation', 'breadcrumbs', 'breadcrumb')}'><ul>{links(k)}</ul></div>",
            "header": lambda: f"<header{name('', ' class=site-header', ' role=banner')}><h1><a href=/>{words(1, 4)}</a></h1><p>{words(2, 8)}</p></header>",
            "top": lambda: f"<div id='{name('header', 'masthead', 'top-bar')}'><div>{words(1, 5)}</div><p class=tagline>{sentence()}</p></div>",
            "footer": lambda: f"<footer{name('', ' class=site-footer')}>{name('&copy; ', 'Copyright ', '')}{word()}.example {name('&middot; ', '')}{para(3)}</footer>",
            "foot": lambda: f"<div class='{name('footer', 'site-footer', 'bottom')}'><p>{name('All rights reserved. ', '&copy; 2020 ', 'Privacy policy. ')}{words(2, 12)}</p></div>",
            "aside": lambda: f"<aside{name('', ' class=sidebar', ' class=related', ' role=complementary')}><h3>{words(1, 4)}</h3>{name(f'<ul>{links(k)}</ul>', f'<p>{para(3)}</p>')}</aside>",
            "side": lambda: f"<div class='{name('sidebar', 'widget', 'related-posts', 'recommended', 'side-column')}'><h4>{words(1, 3)}</h4>{name(f'<ul>{links(k)}</ul>', f'<p>{sentence()}</p>')}</div>",
            "notice": lambda: f"<div {name('class=cookie-notice', 'id=cookie-banner', 'class=notice', 'class=alert', 'class=consent', 'role=alert', 'class=popup', 'class=modal')}><p>{name('We use cookies. ', 'Accept cookies? ', '')}{para(3)}</p></div>",
            "ad": lambda: f"<div class='{name('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo', 'ad-slot', 'advertisement')}'>{name('', 'Advertisement ')}{para(3)}</div>",
            "form": lambda: f"<form{name('', ' class=newsletter', ' id=search', ' class=login')}><label>{words(1, 5)}</label> <input name=q> {name(words(1, 4), sentence())} <button>Go</button></form>",
            "signup": lambda: f"<div class='{name('newsletter', 'subscribe', 'signup')}'><p>{name('Subscribe to our newsletter. ', 'Sign up. ', '')}{sentence()}</p><input type=email></div>",
            "share": lambda: f"<div class='{name('share', 'social', 'share-buttons', 'tags', 'meta', 'byline')}'>{links(3)}{words(1, 4)}</div>",
            "comments": lambda: f"<{(t := name('section', 'div'))} {name('id=comments', 'class=comments', 'class=comment-list', 'class=responses', 'class=discussion')}><h3>{words(1, 3)}</h3>"
            + "".join(
                name(f"<div class='{name('comment', 'comment-body', 'reply')}'><b>{word()}</b><p>{para(4)}</p></div>", f"<ol><li class=comment><p>{para(4)}</p></li></ol>", f"<p class=comment>{para(4)}</p>")
                for _ in range(rng.randrange(1, 5))
            )
            + f"</{t}>",
        }[kind]()

    def article(holder):
        body = [f"<h1>{words(2, 9)}</h1>"] if rng.random() < 0.7 else []
        if rng.random() < 0.15:
            body = [f"<header>{body[0]}</header>"] if body else body
        tiny = rng.random() < 0.08  # verse, lists and the like: many short paragraphs
        for i in range(rng.choice((20, 40, 70)) if tiny else rng.choice((1, 1, 2, 3, 5, 8, 14))):
            text = name(sentence(1, 4), words(1, 3)) if tiny else para() if rng.random() < 0.85 else name(words(1, 3).capitalize() + rng.choice(("", ".")), "All rights reserved.", f"Licensed under the {words(1, 4)}.", words(10, 40), " | ".join(words(1, 2) for _ in range(12)), (words(6, 20) + "!! ").upper())
            if rng.random() < 0.15:
                text = text.replace(" ", " <a href=/x>", 1).replace(".", "</a>.", 1)
            body.append(name(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<blockquote><p>{text}</p></blockquote>" if i else f"<p>{text}</p>"))
            if rng.random() < 0.08:
                body.append(name(f"<h2>{words(1, 6)}</h2>", f"<ul><li>{sentence()}</li><li>{sentence()}</li></ul>", f"<pre>{words(4, 20)}</pre>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"))
            if rng.random() < 0.06:
                body.append(furniture(name("ad", "share", "aside", "signup")).replace(">", " data-label=0>", 1))
        tag = holder.split()[0]
        return f"<{holder} data-label=1>" + "".join(body) + f"</{tag}>"

    holders = (
        "article", "article", "article", "main", "div class=content", "div id=content", "div class=post-content", "div class=entry-content", "div class='article-body text'", "section class=story", "div role=main", "div class=main-text", "div", "td",
    )
    out = []
    for _ in range(n):
        before = [furniture(k) for k in rng.sample(("nav", "menu", "header", "top", "notice", "ad", "form", "share"), rng.randrange(1, 5))]
        after = [furniture(k) for k in rng.sample(("footer", "foot", "aside", "side", "comments", "comments", "ad", "signup", "share", "notice"), rng.randrange(1, 5))]
        middle = article(name(*holders))
        if rng.random() < 0.3:
            middle = f"<div class='{name('container', 'wrapper', 'page', 'row')}'>{middle}{after.pop()}</div>"
        out.append(f"<html><head><title>{words(2, 6)}</title></head><body>" + "".join(before) + middle + "".join(after) + "</body></html>")
    return out


@lru_cache(1)
def trained() -> Model:
    """The model fitted on the layouts; a few seconds' work, the same every time."""
    return Model().fit([labelled_tree(p) for p in layouts()])


def main_text(pages: DataFrame, model: Model | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (code points) of every row of ``pages``.

    Null and empty pages, and pages without any content, give an empty text. Broken markup is
    read as browsers would: missing end tags are implied, an unfinished tag or comment is
    dropped. Elements without text of the page (buttons, canvases, ...) end with their parent at
    the latest; scripts, styles, titles and text areas at their own end tag alone. Rows are read each by itself, so repeated rows repeat their answer.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    kinds = dict(rows.dtypes)

    def make():
        m = shared.value

        def step(b):
            texts = [m.text(p) if p else "" for p in b.column("_html").to_pylist()]
            cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *cols], [*keep, "text", "n_chars"])

        return step

    return per_batch(rows, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_chars long", make)
