"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements and texts. Each node has a hidden state: noise, content, or (for
elements) mixed, which holds both. A potential on each node ties its state to what is seen of it
(tag, words of class, id and role, amount of text, share of links, how the text ends), and a
potential on each parent-child pair ties their states. Sum-product message passing, once upward and
once downward, gives each node's exact marginals; texts that are likelier content than noise are
kept. The potentials are counted, with smoothing, on labelled pages that `labelled_pages` makes by
seeded rules from common page layouts.

Character references are decoded; white space inside a block becomes one space; blocks are joined in
page order by one space. Dropped is what stands between both tags of an element of RAW, or of one of
HIDDEN, whose content is a drawing, choices, or shown only where the element can't be. Nothing else is
dropped or cut; `/>` closes any element at once.

Passes are iterative, so depth does not matter; work and memory are proportional to the page.

Defined results: a null or empty page has an empty text; unclosed and stray tags are borne: an element
of RAW or HIDDEN that no tag closes is an empty one, but a script or style goes on to the page's end; a
tag cut off by the page's end is dropped; a quote that doesn't open a value is a character like others; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mnemora.llm.arrow import in_arrow
from mnemora.sources.tables import table

NOISE, CONTENT, MIXED = 0, 1, 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset("script style".split())
RAW = CODE | {"textarea", "title"}
HIDDEN = frozenset("noscript template iframe object svg select canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag closes an open element of these, unless a boundary stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"}}
BOUNDS = frozenset("ul ol dl table div section article main aside nav body html td th blockquote form".split()) | HIDDEN
CLOSE_P = BLOCKS - frozenset("br body head html li dd dt td th tr tbody thead tfoot caption legend option title summary".split())
_token = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|/([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z))""", re.S)
_named = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Words of class, id and role, by what they hint at.
HINTS = {
    "ad": "ad ads adv advert adverts advertisement banner sponsor sponsored promo promoted dfp outbrain taboola".split(),
    "comment": "comment comments commentlist disqus reply replies respond discussion reactions".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs topbar skip".split(),
    "side": "sidebar side rail widget related recommended recommendations trending popular more aside tags share social follow".split(),
    "frame": "header masthead footer foot copyright legal site logo bottom top contentinfo banner".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall message".split(),
    "form": "form search login comment-form".split(),
    "main": "content article post entry story main body text articlebody maincontent hentry prose page".split(),
    "meta": "meta byline author date published caption summary lead intro".split(),
}
_hint = {w: h for h, ws in reversed(HINTS.items()) for w in ws}


class Node:
    __slots__ = ("tag", "hint", "kids", "up", "text", "chars", "linked", "state", "feats", "link", "belief", "msg")

    def __init__(self, tag: str, up: Node | None, text: str | None = None) -> None:
        self.tag, self.up, self.text, self.kids = tag, up, text, []
        self.hint, self.chars, self.linked, self.state, self.link = "", 0, 0, NOISE, False


def parse(page: str) -> Node:
    """The page's tree; text nodes have the tag #text."""
    root, unclosed = _parsed(page, frozenset())
    return _parsed(page, unclosed)[0] if unclosed else root


def _parsed(page: str, empty: frozenset[int]) -> tuple[Node, frozenset[int]]:
    """The tree, and where the tags of HIDDEN stand that nothing closes; those at `empty` have no content."""
    root = here = Node("#root", None)
    pos, end = 0, len(page)
    opened: dict[Node, int] = {}
    absent: set[str] = set()

    def add(raw: str) -> None:
        if raw:
            here.kids.append(Node("#text", here, html.unescape(raw) if "&" in raw else raw))

    while pos < end:
        m = _token.search(page, pos)
        if not m:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        pos = m.end()
        shut, tag = m[1], m[2]
        if shut:
            shut, node = shut.lower(), here
            while node is not root and node.tag != shut:
                node = node.up
            if node is not root:
                here = node.up
                if shut in HIDDEN:
                    here.kids.pop()  # the last one: it was open
                    del opened[node]
            elif shut in ("p", "br"):
                here.kids.append(Node("br", here))
        elif tag:
            if m[0][-1] != ">":
                break
            tag, attrs = tag.lower(), m[3]
            if tag in RAW:
                if attrs[-1:] == "/":
                    continue
                close = None if tag in absent else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
                if close:
                    pos = close.end()
                elif tag in CODE:
                    break
                else:
                    absent.add(tag)
                continue
            if tag in CLOSE_P or tag in CLOSES:
                closes = CLOSES.get(tag) or {"p"}
                node = here
                while node is not root and node.tag not in closes and (node.tag not in BOUNDS or node.tag in closes):
                    node = node.up
                while node is not root and node.tag in closes:
                    here, node = node.up, node.up
            if tag in HIDDEN and (attrs[-1:] == "/" or m.start() in empty):
                continue
            new = Node(tag, here)
            if attrs and not attrs.isspace():
                found = [_hint[w] for a in _named.findall(attrs) for w in re.split(r"[^a-z]+", "".join(a).lower()) if w in _hint]
                new.hint = found[0] if found else ""
            here.kids.append(new)
            if tag not in VOID and attrs[-1:] != "/":
                here = new
                if tag in HIDDEN:
                    opened[new] = m.start()
    return root, frozenset(opened.values())


def in_order(root: Node) -> list[Node]:
    """All nodes, each before its children, in page order."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.kids))
    return out


def observe(nodes: list[Node]) -> None:
    """What is seen of each node, from the amounts below it."""
    for n in nodes:
        n.link = n.tag == "a" or n.up is not None and n.up.link
        n.chars = n.linked = 0
    for n in reversed(nodes):
        if n.text is not None:
            words = n.text.split()
            n.chars = len(words)
            n.linked = len(words) if n.link else 0
            ends = words[-1][-1] in ".!?…:;\"'”»)" if words else False
            n.feats = (ends, min(n.chars, 3))
        if n.up:
            n.up.chars += n.chars
            n.up.linked += n.linked
    block: dict[int, tuple] = {}
    for n in nodes:
        share = n.linked / n.chars if n.chars else 0.0
        if n.text is not None:
            up, in_block = block[id(n.up)]
            n.feats = (("t", in_block, n.link and in_block[1] > 0, up), ("e", *n.feats, n.link and in_block[1] > 0))
        else:
            seen = (_amount(n.chars), 0 if share < 0.1 else 1 if share < 0.5 else 2)
            block[id(n)] = block[id(n.up)] if n.up and n.tag not in BLOCKS else (n.tag, seen)
            if n.tag in BLOCKS or n.hint:
                n.feats = (("tag", n.tag, n.hint), ("amount", *seen, n.tag in ("p", "li")), ("up", n.tag, n.up.tag if n.up else ""))
            else:
                n.feats = (("inline", n.tag, block[id(n)]),)


def _amount(n: int) -> int:
    return 0 if n == 0 else 1 if n <= 2 else 2 if n <= 6 else 3 if n <= 15 else 4 if n <= 40 else 5


class Model:
    def __init__(self) -> None:
        self.counts: dict[tuple, list[float]] = {}
        self.totals: dict[str, list[float]] = {}
        self.kinds: dict[str, set] = {}
        self.edges = {k: [[0.5] * 3 for _ in range(3)] for k in (False, True)}
        self.edges[True] = [[0.5, 0.5, 0.0] for _ in range(3)]
        self.known: dict[tuple, list[float]] = {}

    def learn(self, root: Node) -> None:
        """Count a tree whose texts' states are set; an element's follow from the texts below it."""
        nodes = in_order(root)
        observe(nodes)
        below: dict[int, set[int]] = {}
        for n in reversed(nodes):
            s = below.pop(id(n), set())
            if n.text is not None:
                s = {n.state} if n.chars else set()
            else:
                n.state = MIXED if len(s) == 2 else CONTENT if s == {CONTENT} else NOISE
            if n.up:
                below.setdefault(id(n.up), set()).update(s)
        for n in nodes:
            if n.up:
                self.edges[n.text is not None][n.up.state][n.state] += 1
            for f in n.feats:
                self.counts.setdefault(f, [0.0] * 3)[n.state] += 1
                self.totals.setdefault(f[0], [0.0] * 3)[n.state] += 1
                self.kinds.setdefault(f[0], set()).add(f)

    def finish(self) -> Model:
        self.trans = {k: [[x / sum(row) for x in row] for row in t] for k, t in self.edges.items()}
        return self

    def potential(self, feats: tuple) -> list[float]:
        """P(what is seen | state) for each state; what was never seen says nothing."""
        r = self.known.get(feats)
        if r is None:
            p = [0.0, 0.0, 0.0]
            for f in feats:
                if f not in self.counts:
                    continue
                c, t, k = self.counts[f], self.totals[f[0]], len(self.kinds[f[0]])
                for s in range(3):
                    p[s] += math.log((c[s] + 0.1) / (t[s] + 0.1 * k))
            top = max(p)
            r = [math.exp(max(x - top, -40.0)) for x in p]
            if len(self.known) < 50_000:
                self.known[feats] = r
        return r

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node by sum-product: messages to parents first, then to children."""
        trans = self.trans
        for n in nodes:
            p = self.potential(n.feats)
            n.belief = [p[0], p[1], 0.0] if n.text is not None else list(p)
        for n in reversed(nodes):
            b = n.belief
            z = b[0] + b[1] + b[2]
            b[0], b[1], b[2] = b[0] / z, b[1] / z, b[2] / z
            if n.up:
                t = trans[n.text is not None]
                n.msg = msg = [r[0] * b[0] + r[1] * b[1] + r[2] * b[2] for r in t]
                u = n.up.belief
                u[0] *= msg[0]
                u[1] *= msg[1]
                u[2] *= msg[2]
                if u[0] + u[1] + u[2] < 1e-150:
                    u[0], u[1], u[2] = u[0] * 1e150, u[1] * 1e150, u[2] * 1e150
        out = []
        for n in nodes:
            b = n.belief  # of what is below; becomes the marginal when the parent's message comes
            if n.up:
                u, t, msg = n.up.belief, trans[n.text is not None], n.msg
                a = [u[s] / msg[s] if msg[s] > 0 else 0.0 for s in range(3)]
                for s in range(3):
                    b[s] *= a[0] * t[0][s] + a[1] * t[1][s] + a[2] * t[2][s]
                z = b[0] + b[1] + b[2]
                if z > 0:
                    b[0], b[1], b[2] = b[0] / z, b[1] / z, b[2] / z
                else:
                    b[0], b[1], b[2] = 1.0, 0.0, 0.0
            out.append(b[1])
        return out

    def text(self, page: str | None) -> str:
        """The page's main text."""
        if not page:
            return ""
        nodes = in_order(parse(page))
        observe(nodes)
        kept = self.marginals(nodes)
        out: list[str] = []
        stack: list[Node] = []
        for n, p in zip(nodes, kept):
            while stack and stack[-1] is not n.up:
                if stack.pop().tag in BLOCKS:
                    out.append(" ")
            if n.text is None:
                stack.append(n)
                if n.tag in BLOCKS:
                    out.append(" ")
            elif p >= 0.5:
                out.append(n.text)
        return " ".join("".join(out).split())


MARK = ""


def labelled_pages(n: int = 700, seed: int = 3) -> list[str]:
    """Pages of common layouts; texts that start with MARK are content."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkqjxz"

    def word() -> str:
        w = "".join(rng.choice(letters[:18]) for _ in range(rng.randint(1, 11)))
        return w.title() if rng.random() < 0.1 else w + rng.choice(["", "", "", "", ",", "!!", "###"]) if rng.random() < 0.3 else w

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 25) -> str:
        return words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{words(1, 3)}</a></{tag}>' for _ in range(k))

    def inline(t: str) -> str:
        """Content text with some links and emphasis in it."""
        parts = t.split(" ")
        if len(parts) > 6 and rng.random() < 0.3:
            i = rng.randrange(1, len(parts) - 2)
            tag = rng.choice(["a", "b", "em", "strong", "code", "span", "i"])
            return f"{MARK}{' '.join(parts[:i])} <{tag}{' href=/y' if tag == 'a' else ''}>{MARK}{parts[i]}</{tag}>{MARK} {' '.join(parts[i + 1:])}"
        return MARK + t

    def block() -> str:
        r = rng.random()
        if r < 0.6:
            return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}"]).format(inline(rng.choice([prose(), prose(), words(1, 4), sentence(1, 3)])))
        if r < 0.68:
            return f"<h{rng.randint(2, 4)}>{MARK}{words(1, 8)}</h2>".replace("</h2>", "</h2>")
        if r < 0.76:
            t = rng.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{inline(sentence(1, 12))}</li>" for _ in range(rng.randint(1, 6))) + f"</{t}>"
        if r < 0.82:
            return f"<blockquote>{rng.choice(['<p>', ''])}{MARK}{prose()}</blockquote>"
        if r < 0.87:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 5))) + "</table>"
        if r < 0.91:
            return f"<pre><code>{MARK}{words(3, 20)}</code></pre>"
        if r < 0.95:
            return f'<figure><img src="z.png"><figcaption>{MARK}{sentence()}</figcaption></figure>'
        return f"<div>{rng.choice(['<p>', ''])}{MARK}{prose()}</div>"

    def noise() -> str:
        """A stretch of noise that may stand before, inside or after the article."""
        k = rng.randrange(11)
        if k == 0:
            return f'<div class="{rng.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo"])}">{rng.choice([sentence(), prose(), words(1, 3)])}</div>'
        if k == 1:
            return f'<aside{rng.choice(["", " class=sidebar", " id=side"])}><h3>{words(1, 3)}</h3>' + rng.choice([f"<ul>{links(rng.randint(2, 6))}</ul>", f"<p>{prose()}</p>"]) + "</aside>"
        if k == 2:
            return f'<div class="{rng.choice(["cookie-notice", "cookie-banner", "consent", "notice", "newsletter", "popup"])}">{rng.choice(["<p>", ""])}{prose()} <button>{word()}</button></div>'
        if k == 3:
            return f'<form action="/s" class="{rng.choice(["search", "login", ""])}"><label>{words(1, 3)}</label><input name=q><button>{word()}</button>{rng.choice(["", "<p>" + prose()])}</form>'
        if k == 4:
            return f'<div class="{rng.choice(["related", "share", "social", "tags", "widget", "trending"])}"><ul>{links(rng.randint(2, 6))}</ul></div>'
        if k == 5:
            return f'<div class="{rng.choice(["breadcrumb", "pagination", "menu", "topbar"])}">{links(3, "span")}</div>'
        if k == 6:
            c = "".join(rng.choice(['<div class="comment"><b>{}</b><p>{}</p></div>', '<li class="comment"><cite>{}</cite><p>{}</p></li>', '<article class="comment"><span>{}</span><p>{}</p></article>', "<div><span>{}</span> {}</div>"]).format(word(), prose()) for _ in range(rng.randint(1, 4)))
            return rng.choice(['<section id="comments"><h3>{}</h3>{}</section>', '<div class="comments"><h2>{}</h2>{}</div>', '<ol class="commentlist"><li>{}</li>{}</ol>']).format(words(1, 3), c)
        if k == 7:
            return f"<nav><ul>{links(rng.randint(2, 7))}</ul></nav>"
        if k == 8:
            return f"<script>var a = '{words(1, 5)}';</script><style>p{{margin:0}}</style>"
        if k == 9:
            return f"<!-- {sentence()} -->"
        return f'<div role="{rng.choice(["navigation", "complementary", "banner", "search"])}">{rng.choice([sentence(), links(3)])}</div>'

    def page() -> str:
        body = rng.choice([1, 2, 3, 5, 8, 14])
        parts = [f"<h1>{MARK}{words(1, 12)}</h1>"] * (rng.random() < 0.8)
        if rng.random() < 0.15:
            parts.append(f'<div class="{rng.choice(["byline", "meta", "date"])}">{MARK}{words(2, 5)}</div>')
        for _ in range(body):
            parts.append(block())
            if rng.random() < 0.06:
                parts.append(noise())
        shell = rng.choice(["<article>{}</article>", "<article>{}</article>", '<main><article class="post">{}</article></main>', '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', "<main>{}</main>", '<section class="story">{}</section>', '<div class="article-body" itemprop="articleBody">{}</div>', "<div><div>{}</div></div>"])
        before = rng.choice(["", f'<header class="site-header"><a href="/">{words(1, 3)}</a>{rng.choice(["", f"<p>{sentence(2, 8)}</p>"])}</header>', f"<header><h1>{words(1, 3)}</h1></header>"])
        before += rng.choice([f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>", f'<div id="nav">{links(4, "span")}</div>', ""]) + "".join(noise() for _ in range(rng.choice([0, 1, 1, 2])))
        after = "".join(noise() for _ in range(rng.choice([0, 0, 1, 2, 3])))
        after += rng.choice([f"<footer>&copy; www.{word()}.example &middot; {prose()}</footer>", f'<footer class="footer"><p>{prose()}</p><ul>{links(3)}</ul></footer>', f'<div id="footer">{sentence()} {links(2, "span")}</div>', ""])
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{words(1, 9)}</title><style>p{{margin:0}}</style></head><body>'
        return head + before + shell.format("".join(parts)) + after + rng.choice(["</body></html>", "</body></html>", ""])

    return [page() for _ in range(n)]


def train(pages: list[str]) -> Model:
    m = Model()
    for p in pages:
        root = parse(p)
        for n in in_order(root):
            if n.text is not None:
                n.state = CONTENT if n.text.startswith(MARK) else NOISE
                n.text = n.text.replace(MARK, "")
        m.learn(root)
    return m.finish()


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", model: Model | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: page_id, the columns `keep`, text and n_chars."""
    cols = pages.select(pages[id_col].alias("page_id"), *keep, pages[html_col].alias("html"))
    kept = [f for f in cols.schema.fields if f.name != "html"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string, n_chars long"

    # counts over tags, hints and amounts of the labelled pages only: some 100 kB
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [m.text(h.as_py()).encode("utf-8", "replace").decode() for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(f.name for f in kept), "text", "n_chars"])

    return cols.transform(in_arrow, run, schema)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"), keep=("url",))
