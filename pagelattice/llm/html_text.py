"""HTML main text: a linear-chain conditional random field over the leaf blocks of a page.

A tolerant tokenizer walks the page once and yields its leaf blocks: runs of text under
one block element, with the tags, classes and ids of all ancestors. The field labels each
block content or boilerplate from ancestor and text features and from its neighbours'
labels, decoded by Viterbi. It is trained here, by gradient ascent on the exact
likelihood, on labelled pages that a seeded generator writes in many layouts.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Role words of fewer training pages are strange.
STRANGE = 3
_SPACE = re.compile(r"\s+")
#: Elements whose text never shows.
_RAW = frozenset("script style noscript template iframe object svg math textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
#: Elements a new start tag ends implicitly.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("thead", "tbody", "tr", "td", "th"),
    "thead": ("tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
#: Start tags that end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul".split()
)
#: Containers that implied ends do not reach out of.
_SCOPE = frozenset("ul ol table dl body div article section main nav aside header footer form select blockquote".split())


#: Marks that make a phrase a piece of its own within its block.
_ADVERT = frozenset(".ad .ads .adv .advert .advertisement .adslot .adsense .sponsor .sponsored .promo .promoted .promotion".split())
#: Parts that say nothing about the role of what they hold.
_PLAIN = frozenset("html body div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table tbody thead tr td th blockquote pre figure figcaption span".split())
_ROLES = frozenset("article main header footer nav aside section form dialog".split())


class Node:
    """An open element. Blocks share the nodes of their ancestors, so a page of any depth takes linear memory.

    ``fresh`` are the words of this element that no ancestor has, ``near`` the innermost
    word that tells a role, ``roles`` the two innermost elements that do.
    """

    __slots__ = ("fresh", "hidden", "marks", "name", "near", "parent", "roles")

    def __init__(self, parent: Node | None, name: str, marks: tuple[str, ...], hidden: bool, fresh: tuple[str, ...]) -> None:
        self.parent, self.name, self.marks, self.hidden, self.fresh = parent, name, marks, hidden, fresh
        self.near = marks[-1] if marks else name if name not in _PLAIN else parent.near if parent else ""
        above = parent.roles if parent else ("", "")
        self.roles = (name, above[0]) if name in _ROLES else above


class Block:
    """A leaf block, or a piece of one: its text with references decoded, its element, how much of it is links.

    Pieces of one block have the same ``run``; ``raw`` keeps the spaces between them.
    """

    __slots__ = ("linked", "node", "raw", "run", "text")

    def __init__(self, raw: str, node: Node | None, linked: int, run: int) -> None:
        self.raw, self.text, self.node, self.linked, self.run = raw, raw.strip(" "), node, linked, run

    @property
    def path(self) -> tuple[str, ...]:
        """Names and marks from the root to the block's element."""
        out, node = [], self.node
        while node:
            out += [*reversed(node.marks), node.name]
            node = node.parent
        return tuple(reversed(out))


def _marks(attributes: str) -> tuple[tuple[str, ...], bool]:
    """Class, id and role words of a start tag, in lower case, digits apart, and whether it hides its element."""
    found, hidden = [], False
    if _TELLING.search(attributes):
        for m in _ATTR.finditer(attributes):
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key in ("class", "id", "role"):
                found += ["." + word for word in re.split(r"[^a-z]+", value.lower()) if word]
            elif key == "hidden" or key == "style" and _UNSEEN.search(value):
                hidden = True
    return tuple(found), hidden


class _Stack:
    """The open elements. Sought by name without a walk, so every element is pushed and popped once."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = {}  # positions of the open elements of a name
        self.scopes: list[int] = [-1]
        self.words: dict[str, int] = {}  # how many open elements have a word
        self.hidden = 0

    def push(self, name: str, marks: tuple[str, ...], hidden: bool) -> None:
        words, fresh = self.words, []
        for w in (name, *marks):
            n = words.get(w, 0)
            if not n:
                fresh.append(w)
            words[w] = n + 1
        self.at.setdefault(name, []).append(len(self.nodes))
        if name in _SCOPE:
            self.scopes.append(len(self.nodes))
        self.hidden += hidden
        self.nodes.append(Node(self.nodes[-1] if self.nodes else None, name, marks, hidden, tuple(fresh)))

    def cut(self, to: int) -> None:
        while len(self.nodes) > to:
            node = self.nodes.pop()
            for w in (node.name, *node.marks):
                self.words[w] -= 1
            self.at[node.name].pop()
            if node.name in _SCOPE:
                self.scopes.pop()
            self.hidden -= node.hidden

    def last(self, names: tuple[str, ...]) -> int:
        """Position of the innermost open element of these names, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; blocks without visible text are left out.

    Elements hidden by their attributes do not show. A phrase marked as an advert is a
    piece apart from the rest of its block.
    """
    if not page:
        return []
    out: list[Block] = []
    stack = _Stack()
    text: list[str] = []
    linked = at = run = 0
    inside_link = 0
    phrases: list[list] = []  # open phrases that stand on the stack: position, name, open elements of that name

    def piece() -> None:
        nonlocal linked
        if text:
            seen = _SPACE.sub(" ", html.unescape("".join(text)))
            text.clear()
            if seen.strip(" "):
                out.append(Block(seen, stack.nodes[-1] if stack.nodes else None, linked, run))
            elif seen and out and out[-1].run == run:
                out[-1].raw += " "
        linked = 0

    def flush() -> None:
        nonlocal run
        piece()
        run += 1

    def cut(to: int) -> None:
        stack.cut(to)
        while phrases and phrases[-1][0] >= to:
            phrases.pop()

    def close(names: tuple[str, ...]) -> None:
        """End open elements of these names up to the nearest container."""
        found = stack.last(names)
        if found >= 0 and found >= stack.scopes[-1]:
            flush()
            cut(found)

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        part = page[at : m.start() if m else size]
        if part and not stack.hidden:
            text.append(part)
            if inside_link:
                linked += len(part)
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if not m.group(1):
            if name in _RAW:
                if not m.group(3).endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else size
                continue
            if name in _INLINE:
                if name == "br":
                    if not stack.hidden:
                        text.append(" ")
                    continue
                if name == "a":
                    inside_link = 1
                if name in _VOID or m.group(3).endswith("/"):
                    continue
                marks, hidden = _marks(m.group(3))
                if hidden or not _ADVERT.isdisjoint(marks):
                    piece()
                    phrases.append([len(stack.nodes), name, 1])
                    stack.push(name, marks, hidden)
                elif phrases and phrases[-1][1] == name:
                    phrases[-1][2] += 1
                continue
            flush()
            inside_link = 0
            if name in _CLOSES:
                close(_CLOSES[name])
            if name in _ENDS_P:
                close(("p",))
            if name not in _VOID and not m.group(3).endswith("/"):
                stack.push(name, *_marks(m.group(3)))
        elif name in _INLINE:
            if name == "a":
                inside_link = 0
            if phrases and phrases[-1][1] == name:
                phrases[-1][2] -= 1
                if not phrases[-1][2]:
                    piece()
                    cut(phrases[-1][0])
        elif name not in _VOID:
            flush()
            inside_link = 0
            found = stack.last((name,))
            if found >= 0:
                cut(found)
    flush()
    return out


# -- features ------------------------------------------------------------------------

_NOTICE = re.compile(r"cookie|©|\(c\) ?\d|copyright|all rights|subscribe|sign up|log in|newsletter|privacy|terms|advert|sponsor|read more|share", re.I)


def node_features(node: Node | None) -> list[str]:
    """The element, the innermost word and the two innermost elements that tell a role."""
    if node is None:
        return ["tag=", "near=", "one"]
    return [f"tag={node.name}", f"near={node.near}", f"roles={node.roles[0]}<{node.roles[1]}", "one"]


def path_features(node: Node | None) -> list[str]:
    """``node_features`` and all ancestors' names and marks, each once."""
    out, at = node_features(node), node
    while at:
        out += [f"anc={x}" for x in at.fresh]
        at = at.parent
    return out


def text_key(block: Block, nth: int, total: int) -> tuple[int, int, bool, int, bool, int]:
    """Size class, share of link text, sentence end, commas, notice words, place on the page."""
    text = block.text
    words = text.count(" ") + 1
    return (
        min(6, words.bit_length()),
        min(4, 4 * block.linked // len(text)),
        text[-1] in ".!?…。",
        min(3, text.count(",")),
        words < 30 and _NOTICE.search(text) is not None,
        min(3, 4 * nth // total),
    )


def text_features(key: tuple) -> list[str]:
    return [*(f"{name}={value}" for name, value in zip(("words", "links", "stop", "commas", "notice", "place"), key)), f"form={key[0]}/{key[1]}/{key[2]}"]


def pair_features(node: Node | None, key: tuple) -> list[str]:
    """Whether links or whole sentences stand in this element."""
    return [f"in={node.name}/{key[1] > 1}/{key[2]}"] if node else []


class Field:
    """Two labels (0 boilerplate, 1 content): weights by feature and label, transitions, ends."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray, first: np.ndarray) -> None:
        self.weights, self.moves, self.first = weights, moves, first
        self._sums: dict[tuple, tuple[float, float]] = {}

    def _known(self, name: str) -> str:
        """Role words that training lacks count as one strange word."""
        return "near=?" if name.startswith("near=") and name not in self.weights else name

    def _sum(self, key: tuple, names: list[str]) -> tuple[float, float]:
        found = [self.weights[f] for f in map(self._known, names) if f in self.weights]
        if len(self._sums) >= 50_000:
            self._sums.clear()
        self._sums[key] = out = (sum(x[0] for x in found), sum(x[1] for x in found))
        return out

    def _ancestors(self, node: Node | None, known: dict[Node | None, tuple[float, float]]) -> tuple[float, float]:
        """Weights of all words from the root to a node; ``known`` keeps them, so each node is summed once a page."""
        todo = []
        while node not in known:
            todo.append(node)
            node = node.parent
        a, b = known[node]
        for node in reversed(todo):
            if node.fresh:
                c, d = self._sums.get(node.fresh) or self._sum(node.fresh, [f"anc={x}" for x in node.fresh])
                a, b = a + c, b + d
            known[node] = a, b
        return a, b

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks, by Viterbi; ties go to boilerplate."""
        if not page:
            return []
        sums, total = self._sums, len(page)
        (a, b), (c, d) = self.moves.tolist()
        s0, s1 = self.first.tolist()
        back: list[tuple[int, int]] = []
        known: dict[Node | None, tuple[float, float]] = {None: (0.0, 0.0)}
        for n, block in enumerate(page):
            key, node = text_key(block, n, total), block.node
            pair = node and (node.name, key[1] > 1, key[2])
            a0, a1 = known.get(node) or self._ancestors(node, known)
            where = (node.name, node.near, node.roles) if node else ()
            p0, p1 = sums.get(where) or self._sum(where, node_features(node))
            p0, p1 = p0 + a0, p1 + a1
            e0, e1 = sums.get(key) or self._sum(key, text_features(key))
            if pair:
                q0, q1 = sums.get(pair) or self._sum(pair, pair_features(node, key))
                e0, e1 = e0 + q0, e1 + q1
            if n:
                f0, f1 = s1 + c > s0 + a, s1 + d > s0 + b
                s0, s1 = (s1 + c if f0 else s0 + a), (s1 + d if f1 else s0 + b)
                back.append((int(f0), int(f1)))
            s0, s1 = s0 + e0 + p0, s1 + e1 + p1
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 100, rate: float = 0.5, decay: float = 1e-5) -> Field:
    """Maximum likelihood with an L2 term, by AdaGrad over exact forward-backward gradients."""
    names: dict[str, int] = {}
    rows = []
    near = Counter(w for page, _ in pages for w in {b.node.near for b in page if b.node})  # pages that have a role word
    for page, labels in pages:
        feats = []
        for n, b in enumerate(page):
            key = text_key(b, n, len(page))
            found = path_features(b.node) + text_features(key) + pair_features(b.node, key)
            found = ["near=?" if b.node and near[b.node.near] < STRANGE and f == f"near={b.node.near}" else f for f in found]
            feats.append([names.setdefault(f, len(names)) for f in found])
        if page:
            rows.append((feats, np.array(labels)))
    size = np.array([len(y) for _, y in rows])
    # all pages at once: blocks stand in a grid of pages by places
    flat = np.concatenate([np.array(f) for feats, _ in rows for f in feats])
    count = np.array([len(f) for feats, _ in rows for f in feats])
    begin = np.cumsum(count) - count
    page_of = np.repeat(np.arange(len(rows)), size)
    place = np.arange(len(page_of)) - np.repeat(np.cumsum(size) - size, size)
    gold = np.eye(2)[np.concatenate([y for _, y in rows])]
    follows = place > 0
    steps = gold[np.flatnonzero(follows) - 1].T @ gold[follows]
    w, moves, first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(x, 1e-8) for x in (w, moves, first)]
    for _ in range(rounds):
        emit = np.zeros((len(rows), size.max(), 2))
        emit[page_of, place] = np.add.reduceat(w[flat], begin, axis=0)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = first + emit[:, 0]
        for i in range(1, size.max()):
            ahead[:, i] = np.logaddexp(ahead[:, i - 1, :1] + moves[0], ahead[:, i - 1, 1:] + moves[1]) + emit[:, i]
        for i in range(size.max() - 2, -1, -1):
            x = behind[:, i + 1] + emit[:, i + 1]
            x = np.logaddexp(moves[:, 0] + x[:, :1], moves[:, 1] + x[:, 1:])
            behind[:, i] = np.where((i + 1 < size)[:, None], x, 0.0)
        last = ahead[np.arange(len(rows)), size - 1]
        z = np.logaddexp(last[:, 0], last[:, 1])
        error = gold - np.exp((ahead + behind - z[:, None, None])[page_of, place])
        spread = np.repeat(error, count, axis=0)
        gw = np.stack([np.bincount(flat, spread[:, k], len(names)) for k in (0, 1)], axis=1) - decay * len(rows) * w
        p, i = page_of[follows], place[follows]
        pairs = ahead[p, i - 1][:, :, None] + moves + (emit[p, i] + behind[p, i])[:, None, :] - z[p][:, None, None]
        gm, gf = steps - np.exp(pairs).sum(axis=0), error[place == 0].sum(axis=0)
        for x, g, s in zip((w, moves, first), (gw, gm, gf), sums):
            s += g * g
            x += rate * g / np.sqrt(s)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, moves, first)


# -- labelled pages --------------------------------------------------------------------

_OPEN = "\x01"
_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an en in on er st th nd".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))


def _sentence(rng: random.Random, low: int, high: int) -> str:
    return _words(rng, low, high).capitalize() + rng.choice("....!?")


def _paragraph(rng: random.Random) -> str:
    text = " ".join(_sentence(rng, 1, 18) for _ in range(rng.choice((1, 1, 2, 3, 5, 8))))
    if rng.random() < 0.3:
        text = re.sub(r" (\w+)", r", \1", text, count=2)
    if rng.random() < 0.12:  # decorated or shouted text is content like any other
        text = " ".join(x + rng.choice(("***", "!!", "###", " |")) for x in text.split(" "))
    if rng.random() < 0.1:
        text = " ".join([_words(rng, 1, 1)] * rng.randint(3, 40))
    return rng.choice(("", "", "", "<b>", "<em>")) + text + rng.choice(("", "", "<br>"))


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{_words(rng, 1, 1)}">{_words(rng, 1, 3)}</a></li>' for _ in range(n))


def _boiler(rng: random.Random, inside: bool = False) -> str:
    """One boilerplate part: menu, page header (not inside an article), footer, sidebar, notice, advert, form or comments."""
    text, kind = _sentence(rng, 3, 14), rng.randrange(9)
    if inside and kind == 1:
        kind = 5
    many = "".join(f"<p>{_sentence(rng, 3, 25)}</p>" for _ in range(rng.randint(1, 4)))
    if kind == 0:
        wrap = rng.choice((("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="nav">', "</div>"), ('<ul class="navbar">', "</ul>"), ('<div class="breadcrumb">', "</div>"), ('<div role="navigation">', "</div>")))
        return f"{wrap[0]}<ul>{_links(rng, rng.randint(2, 8))}</ul>{wrap[1]}"
    if kind == 1:
        return rng.choice((f"<header><p>{text}</p></header>", f"<header><h1>{text}</h1>{many}</header>", f'<div class="header">{text}</div>', f'<div id="masthead"><h2>{text}</h2></div>', f'<div role="banner">{text}</div>'))
    if kind == 2:
        return rng.choice((f"<footer>&copy; {rng.randint(1990, 2030)} {text}</footer>", f"<footer>{many}</footer>", f"<footer><ul>{_links(rng, 3)}</ul></footer>", f'<div class="footer">{many}</div>', f'<div id="footer">&copy; {text}</div>', f'<div role="contentinfo">{many}</div>'))
    if kind == 3:
        return rng.choice((f"<aside>{many}</aside>", f"<aside><ul>{_links(rng, 4)}</ul></aside>", f'<div class="sidebar">{many}</div>', f'<div class="related"><ul>{_links(rng, 3)}</ul></div>', f'<div id="sidebar"><h3>{text}</h3>{many}</div>', f'<div class="widget">{many}</div>', f'<div role="complementary">{many}</div>'))
    if kind == 4:
        mark = rng.choice(("cookie", "cookie-notice", "notice", "banner", "consent", "alert", "popup", "modal", "newsletter", "disclaimer", "subscribe", "paywall", "gdpr"))
        return f'<div {rng.choice(("class", "id"))}="{mark}">{rng.choice((text, many, "We use cookies. " + text))}</div>'
    if kind == 5:
        mark = rng.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor", "promotion"))
        return f'<{(tag := rng.choice(("div", "section", "aside", "p")))} class="{mark}">{text if tag == "p" else rng.choice((text, many))}</{tag}>'
    if kind == 6:
        return f'<form action="/s"><label>{_words(rng, 1, 2)}</label><input name="q"><p>{text}</p><button>{_words(rng, 1, 2)}</button><select><option>{_words(rng, 1, 1)}<option>{_words(rng, 1, 1)}</select></form>'
    if kind == 7:
        mark = rng.choice(("comments", "comment", "comment-list", "replies", "discussion", "user-comments", "responses", "disqus", "reader-comments"))
        body = "".join(f'<div class="comment"><p>{_sentence(rng, 4, 30)}</p></div>' for _ in range(rng.randint(1, 4)))
        return rng.choice((f'<section class="{mark}"><h2>{_words(rng, 1, 2)}</h2>{body}</section>', f'<div id="{mark}">{body}</div>', f'<ol class="{mark}"><li>{_sentence(rng, 4, 30)}<li>{_sentence(rng, 4, 30)}</ol>'))
    mark = rng.choice(("share", "social", "tags", "meta", "byline", "pagination", "pager", "toolbar", "skip"))
    return f'<div class="{mark}">{rng.choice((_words(rng, 1, 4), f"<ul>{_links(rng, 3)}</ul>"))}</div>'


def _phrase_advert(rng: random.Random) -> str:
    """An advert within a sentence's block; the text after it is content again."""
    mark = rng.choice(("ad", "ads", "advert", "sponsored", "promo"))
    tag = rng.choice(("span", "a", "b", "small"))
    return f'<{tag} class="{mark}">{_sentence(rng, 1, 9)}</{tag}>{_OPEN}'


def _content(rng: random.Random, own_head: bool = False) -> str:
    out = [f"<h1>{_sentence(rng, 1, 12)}</h1>"] if rng.random() < 0.85 else []
    if own_head and out and rng.random() < 0.5:
        out = ["<header>" + out[0] + (f"<p>{_sentence(rng, 4, 20)}</p>" if rng.random() < 0.5 else "") + "</header>"]
    for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 13))):
        kind = rng.random()
        if kind < 0.72:
            advert = f" {_phrase_advert(rng)} {_sentence(rng, 2, 12)}" if rng.random() < 0.06 else ""
            out.append(f"<p>{_paragraph(rng)}{advert}" + rng.choice(("</p>", "</p>", "")))
        elif kind < 0.8:
            out.append(f"<h{rng.randint(2, 4)}>{_words(rng, 1, 6)}</h{rng.randint(2, 4)}>")
        elif kind < 0.87:
            tag = rng.choice(("ul", "ol"))
            out.append(f"<{tag}>" + "".join(f"<li>{_sentence(rng, 1, 12)}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>")
        elif kind < 0.91:
            out.append(f"<blockquote><p>{_paragraph(rng)}</p></blockquote>")
        elif kind < 0.94:
            out.append("<table>" + "".join(f"<tr><td>{_words(rng, 1, 3)}</td><td>{_words(rng, 1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        elif kind < 0.97:
            out.append(f"<pre>{_words(rng, 3, 20)}</pre>")
        else:
            out.append(f"<figure><img src='x'><figcaption>{_sentence(rng, 2, 8)}</figcaption></figure>")
    return "".join(out)


_HOLDERS = (
    ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="article">', "</div>"), ('<div class="post-body">', "</div>"),
    ('<section class="entry">', "</section>"), ('<div id="main"><div class="post">', "</div></div>"), ('<article class="story">', "</article>"), ("<div>", "</div>"),
)

def _strange_holder(rng: random.Random) -> tuple[str, str]:
    """Elements and marks that say nothing, as the pages of the world have them."""
    name = _words(rng, 1, 1)
    return rng.choice((
        (f'<div class="{name}">', "</div>"), (f'<div id="{name}"><div class="{_words(rng, 1, 1)}">', "</div></div>"), (f"<x-{name}>", f"</x-{name}>"),
        (f'<table><tr><td class="{name}">', "</td></tr></table>"), (f'<section id="{name}">', "</section>"), ("", ""), (f'<div role="main" class="{name}">', "</div>"),
    ))


def _strange_boiler(rng: random.Random) -> str:
    """Menus, link lists and notices under elements and marks that say nothing."""
    name, text = _words(rng, 1, 1), _sentence(rng, 2, 8)
    items = rng.choice((f"<ul>{_links(rng, rng.randint(2, 10))}</ul>", " | ".join(f'<a href="/x">{_words(rng, 1, 2)}</a>' for _ in range(rng.randint(2, 8))), f'<a href="/y">{text}</a>', f"&copy; {rng.randint(1990, 2030)} {text}", f"All rights reserved. {text}"))
    wrap = rng.choice((("<div>", "</div>"), (f'<div class="{name}">', "</div>"), (f"<x-{name}>", f"</x-{name}>"), (f'<table><tr><td id="{name}">', "</td></tr></table>"), (f'<section class="{name}">', "</section>")))
    return wrap[0] + items + wrap[1]


def labelled_pages(n: int = 1200, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Seeded pages with their blocks' labels; content is written between two marks that the labels are read from."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        part = lambda: _strange_boiler(rng) if rng.random() < 0.3 else _boiler(rng)
        before = "".join(part() for _ in range(rng.choice((0, 1, 2, 2, 3, 4))))
        after = "".join(part() for _ in range(rng.choice((0, 1, 1, 2, 3, 4))))
        holder = _strange_holder(rng) if rng.random() < 0.35 else rng.choice(_HOLDERS)
        inner = _content(rng, own_head=holder[0].startswith(("<article", "<main")))
        marked = re.sub(r"(<(?:p|h\d|li|td|pre|figcaption)>(?:<b>|<em>)?)", rf"\1{_OPEN}", inner)
        if rng.random() < 0.3:  # boilerplate within the article's element, after or between its blocks
            cut = marked.find("<p>", len(marked) // 2)
            cut = len(marked) if cut < 0 else cut
            marked = marked[:cut] + _boiler(rng, inside=True) + marked[cut:]
        page = f"<html><head><title>{_words(rng, 1, 4)}</title></head><body>{before}{holder[0]}{marked}{holder[1]}{after}</body></html>"
        found = blocks(page)
        labels = [int(b.text.startswith(_OPEN)) for b in found]
        for b in found:
            b.raw = b.raw.replace(_OPEN, "")
            b.text = b.raw.strip(" ") or "."
        out.append((found, labels))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return train(labelled_pages())


def main_text(page: str | None, field: Field) -> tuple[str, int, int]:
    """(main text, its blocks, all blocks) of a page; kept pieces of one block stand in one line."""
    found = blocks(page)
    lines: list[str] = []
    last = -1
    for b, y in zip(found, field.decode(found)):
        if y:
            if b.run == last:
                lines[-1] += b.raw
            else:
                lines.append(b.raw)
            last = b.run
    kept = [_SPACE.sub(" ", x).strip(" ") for x in lines]
    return "\n".join(kept), len(kept), len({b.run for b in found})


def extract_rows(
    pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(page_id, url, text, n_chars, n_kept, n_blocks)`` per row of ``pages``.

    Time and memory grow with a page's length, at any depth of its elements.
    Null and empty pages, and pages without content blocks, give the empty text. Null
    ids and urls and repeated rows pass through; other columns are ignored; an empty
    table gives no rows.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(field or trained())  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [main_text(x.as_py(), shared.value) for x in batch.column(2)]
                cols = list(zip(*[(t, len(t), k, n) for t, k, n in rows])) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *map(pa.array, cols, kinds)],
                    names=["page_id", "url", "text", "n_chars", "n_kept", "n_blocks"],
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_kept long, n_blocks long")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))
