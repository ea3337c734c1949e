"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A block is a stretch of inline content inside one block-level element. Its features are its ancestors' tags, words in
their class, id and role, and features of its text. The field has two labels, text and boilerplate; it is trained here
on labelled pages (`labelled_pages`, a bounded number) and decoded by Viterbi.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestigraph.llm.common import small_batches, text_of

TRAIN_PAGES, EPOCHS = 700, 6
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img math mi mo mn mrow msup msub mfrac msqrt mtext semantics annotation svg g path rect circle text tspan font nobr acronym output meter progress noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Not shown as text: code, the head, what stands in for embedded things, and the controls of forms.
_UNSEEN = frozenset("script style template head title iframe object audio video canvas select datalist textarea button".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SPACE, _NAME = re.compile(r"\s+"), re.compile(r"[a-z]+")
_NOTICE = re.compile(r"cookie|subscri|newsletter|copyright|©|all rights|privacy|sign ?up|log ?in|advert|sponsor|share|related|comment|reply", re.I)


class Element:
    """An element and the chain of those around it. Elements with equal chains are one object, and each knows only what it adds to the chain, so a page of any depth costs its own tags."""

    __slots__ = ("tag", "names", "parent", "own", "added", "rest", "inner", "headed")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None, open_: dict[str, int]):
        self.tag, self.names, self.parent = tag, names, parent
        self.own = (f"has {tag}", *(f"name {n}" for n in names))
        #: Of its own features those that no element around it has.
        self.added = tuple(f for f in self.own if not open_.get(f))
        #: The nearest element from here outwards whose parent's chain still adds features.
        self.rest = parent if parent is None or parent.added else parent.rest
        self.inner = tag if tag in _BOX else parent.inner if parent else "none"
        self.headed = tag in ("h1", "h2") or bool(parent and parent.headed)

    def ancestry(self) -> list[str]:
        """Features of all tags and names of the chain, each once."""
        found, at = [], self
        while at is not None:
            found += at.added
            at = at.rest
        return found


class _Blocks(HTMLParser):
    """Leaf blocks in page order: text, the element they stand in, number of characters in links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.known: dict[tuple, Element] = {}
        self.open: dict[str, int] = {}  # of each tag, and of each feature of the chain
        self.blocks: list[tuple[str, Element | None, int]] = []
        self.parts: list[str] = []
        self.linked = self.in_link = self.unseen = 0

    def _end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.stack[-1] if self.stack else None, self.linked))
        self.parts, self.linked = [], 0

    def _open(self, tag: str, names: tuple[str, ...]) -> None:
        parent = self.stack[-1] if self.stack else None
        key = (id(parent), tag, names)
        element = self.known.get(key)
        if element is None:
            element = self.known[key] = Element(tag, names, parent, self.open)
        self.stack.append(element)
        for f in element.own:
            self.open[f] = self.open.get(f, 0) + 1
        self.unseen += tag in _UNSEEN

    def _close(self, at: int) -> None:
        for element in self.stack[at:]:
            self.unseen -= element.tag in _UNSEEN
            for f in element.own:
                self.open[f] -= 1
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.in_link += 1
        if tag in _INLINE:
            return
        self._end_block()
        self.in_link = 0
        if self.unseen and tag == "body":
            self._close(0)
        size = len(self.stack)
        last, second = (self.stack[-1].tag if size else None), (self.stack[-2].tag if size > 1 else None)
        if tag in _CLOSES_P and last == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option") and last == tag:
            self._close(size - 1)
        elif tag in ("li", "td", "th") and (second, last) == (tag, "p"):
            self._close(size - 2)
        if tag in _VOID:
            return
        names = {n for k, v in attrs if k in ("class", "id", "role", "itemprop", "aria-label") and v for n in _NAME.findall(v.lower())}
        self._open(tag, tuple(sorted(names)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in _INLINE:
            return
        self._end_block()
        if not self.open.get(f"has {tag}"):
            return
        at = len(self.stack) - 1
        while self.stack[at].tag != tag:
            at -= 1
        self._close(at)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def leaf_blocks(html: str) -> list[tuple[str, Element | None, int]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._end_block()
    return parser.blocks


_BOX = ("article", "main", "nav", "aside", "footer", "header", "form", "section")


def features(blocks: list[tuple[str, Element | None, int]]) -> list[list[str]]:
    """Feature names of each block: its tag, ancestors and their names, its own text, and what stands in the same element, so that prose is known without any telling name around it."""
    out, headed, memo = [], False, {}
    plain: dict[Element | None, int] = {}
    links: dict[Element | None, int] = {}
    for text, element, linked in blocks:
        at = element.parent if element else None
        plain[at] = plain.get(at, 0) + max(0, len(text) - linked)
        links[at] = links.get(at, 0) + linked
    whole = max(1, sum(plain.values()))
    most = max(plain.values(), default=0)
    before = None
    for nth, (text, element, linked) in enumerate(blocks):
        if element not in memo:
            at = element.parent if element else None
            size, linky = plain[at], links[at]
            memo[element] = [
                *(element.ancestry() if element else ()), *(f"last {n}" for n in (element.names if element else ())), f"in {element.tag if element else ''}", f"inner {element.inner if element else 'none'}",
                f"group {min(12, size.bit_length())}", f"group share {min(4, 5 * size // whole)}", f"group links {min(3, 4 * linky // max(1, size + linky))}", f"largest {size == most}",
            ]
        n = text.count(" ") + 1
        share = min(3, 4 * linked // max(1, len(text)))
        tag = element.tag if element else ""
        f = ["bias", f"words {min(6, n.bit_length())}", f"links {share}", f"ends {text[-1] in '.!?:;”"'}", f"headed {headed}", f"{tag} links {share} words {min(4, n.bit_length())}", f"same {element is before}", *memo[element]]
        if n < 40 and _NOTICE.search(text):
            f.append("notice")
        if nth == 0:
            f.append("first")
        if nth == len(blocks) - 1:
            f.append("last block")
        headed |= bool(element and element.headed)
        before = element
        out.append(f)
    return out


class Field:
    """Weights of a two-label linear chain: for each feature the score of `text` less that of `boilerplate`, and 2 x 2 transitions."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.moves = np.zeros((2, 2))

    def _scores(self, feats: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(x, 0.0) for x in f) for f in feats]

    def viterbi(self, feats: list[list[str]]) -> list[int]:
        if not feats:
            return []
        scores = self._scores(feats)
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_a = a + m00 >= b + m10
            to_b = a + m01 >= b + m11
            back.append((0 if from_a else 1, 0 if to_b else 1))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + s
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Stochastic gradient ascent on the conditional likelihood, by forward and backward sums, with AdaGrad steps."""
        seen: dict[str, float] = {}
        moves_seen = np.full((2, 2), 1e-6)
        for epoch in range(epochs):
            order = list(range(len(pages)))
            random.Random(epoch).shuffle(order)
            for p in order:
                feats, labels = pages[p]
                if not feats:
                    continue
                scores = self._scores(feats)
                n, move = len(scores), np.exp(self.moves)
                forward = np.empty((n, 2))
                backward = np.ones((n, 2))
                local = np.array([[1.0, math.exp(max(-30.0, min(30.0, s)))] for s in scores])
                forward[0] = local[0] / local[0].sum()
                for i in range(1, n):
                    f = forward[i - 1] @ move * local[i]
                    forward[i] = f / f.sum()
                for i in range(n - 2, -1, -1):
                    g = move @ (local[i + 1] * backward[i + 1])
                    backward[i] = g / g.sum()
                p1 = forward * backward
                p1 = p1[:, 1] / p1.sum(1)
                for f, y, q in zip(feats, labels, p1.tolist(), strict=True):
                    g = y - q
                    if abs(g) > 1e-3:
                        for x in f:
                            seen[x] = h = seen.get(x, 1e-6) + g * g
                            w = self.weights.get(x, 0.0)
                            self.weights[x] = w + rate * (g - decay * w) / math.sqrt(h)
                grad = np.zeros((2, 2))
                for i in range(1, n):
                    joint = forward[i - 1][:, None] * move * (local[i] * backward[i])[None, :]
                    grad -= joint / joint.sum()
                    grad[labels[i - 1], labels[i]] += 1
                moves_seen += grad * grad
                self.moves += rate * grad / np.sqrt(moves_seen)
        return self


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 7) -> Iterator[tuple[str, set[str]]]:
    """Pages of several layouts with their article blocks: menus, headers, sidebars, notices, adverts, forms, comments and footers stand around and inside the article."""
    rng = random.Random(seed)
    syllables = "an be co da el fi go hu in jo ka le mi no os pe qua ri so tu un ve wa xe yl zo tion er ent".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()
    sentence = lambda a=4, b=25: phrase(a, b) + rng.choice("....!?")
    link = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'
    some = lambda *x: rng.choice(x)

    def name(*x: str) -> str:
        return f' {some("class", "class", "id")}="{some(*x)}"'

    def prose(k: int) -> str:
        return " ".join(sentence() if rng.random() < 0.85 else phrase(1, 4) + "." for _ in range(k))

    def menu() -> str:
        inner = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 8)))
        return some(f"<nav><ul>{inner}</ul></nav>", f"<nav{name('menu', 'navbar', 'breadcrumb')}><ul>{inner}</ul></nav>", f"<div{name('nav', 'menu', 'navigation', 'topnav')}><ul>{inner}</ul></div>", f"<nav>{' | '.join(link() for _ in range(5))}</nav>")

    def advert() -> str:
        body = some(prose(1), phrase(2, 6), sentence() + " " + link(), f"<p>{prose(2)}</p>")
        return f"<{(t := some('div', 'div', 'aside', 'section', 'p'))}{name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner ad', 'ad-slot')}>{body}</{t}>"

    def sidebar() -> str:
        body = f"<h3>{phrase(1, 3)}</h3>" + some(f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul>", f"<p>{prose(1)}</p>", f"<p>{prose(2)}</p>")
        return some(f"<aside>{body}</aside>", f"<aside{name('sidebar', 'related')}>{body}</aside>", f"<div{name('sidebar', 'widget', 'related', 'side-bar', 'recommended')}>{body}</div>")

    def notice() -> str:
        body = some("We use cookies. ", "This site uses cookies to improve your visit. ", "Subscribe to our newsletter! ", "") + some(sentence(), prose(2))
        return f"<{(t := some('div', 'div', 'section', 'aside'))}{name('cookie', 'cookie-notice', 'notice', 'consent', 'newsletter', 'banner', 'popup', 'alert notice', 'modal')}>{some(body, f'<p>{body}</p>')}<button>{phrase(1, 2)}</button></{t}>"

    def form() -> str:
        return f"<form{some('', name('search', 'subscribe', 'login', 'signup'))}><label>{phrase(1, 4)}</label><input name=q><p>{sentence()}</p><button>{phrase(1, 2)}</button></form>"

    def comments() -> str:
        one = lambda: f"<{(t := some('div', 'li', 'article', 'p'))}{name('comment', 'reply', 'comment-body')}>{some(prose(1), f'<p>{prose(2)}</p>', f'<b>{word()}</b>: {prose(1)}')}</{t}>"
        return f"<{(t := some('section', 'div', 'div', 'aside'))}{name('comments', 'comment-list', 'discussion', 'responses', 'replies')}>{some('', f'<h2>{phrase(1, 3)}</h2>')}{''.join(one() for _ in range(rng.randint(1, 4)))}</{t}>"

    def header() -> str:
        return some(f"<header>{some('', f'<h1>{phrase(1, 3)}</h1>', f'<p>{phrase(2, 6)}</p>')}{menu()}</header>", f"<div{name('header', 'masthead', 'topbar', 'site-header')}><p>{phrase(1, 5)}</p></div>", menu(), menu())

    def footer() -> str:
        body = some(f"&copy; {word()}.example &middot; {prose(1)}", f"<p>Copyright {word()}. {prose(2)}</p>", f"{prose(1)} {link()} {link()}", f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(3))}</ul>")
        return some(f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<div{name('footer', 'site-footer', 'copyright', 'bottom')}>{body}</div>")

    for _ in range(n):
        truth: set[str] = set()

        def content(html: str, plain: str) -> str:
            truth.add(_SPACE.sub(" ", plain).strip())
            return html

        def block() -> str:
            kind, text = rng.random(), prose(some(1, 1, 2, 3, 6))
            if rng.random() < 0.16:
                return odd_block(text)
            if kind < 0.1:
                text = phrase(1, 6)
                return content(f"<{(t := some('h2', 'h3'))}>{text}</{t}>", text)
            if kind < 0.17:
                items = [sentence(2, 12) for _ in range(3)]
                return "<ul>" + "".join(content(f"<li>{x}</li>", x) for x in items) + "</ul>"
            if kind < 0.22:
                return content(f"<blockquote>{text}</blockquote>", text)
            if kind < 0.27:
                text = sentence(1, 3)
                return content(f"<p>{text}</p>", text)
            if kind < 0.35:
                head, rest = phrase(1, 4), prose(2)
                return content(f"<p>{head} <a href='/x'>{rest}</a> {text}</p>", f"{head} {rest} {text}")
            if kind < 0.42:
                return content(f"<p><b>{text}<br>", text)
            return content(f"<p>{text}</p>", text)

        def odd_block(text: str) -> str:
            """Code, formulas, tables, lists of terms, figures and bare text in an element of its own."""
            kind = rng.randrange(7)
            if kind == 0:
                lines = [phrase(1, 5).lower() + some(" = 1;", "();", " {", "") for _ in range(rng.randint(1, 5))]
                return content(f"<pre>{some('', '<code>')}" + "\n  ".join(lines) + "</pre>", " ".join(lines))
            if kind == 1:
                return content(f"<p>{text} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {text}</p>", f"{text} x=2 {text}")
            if kind == 2:
                rows = [[phrase(1, 3), some(str(rng.randint(1, 999)), phrase(1, 8))] for _ in range(rng.randint(1, 4))]
                return "<table>" + "".join("<tr>" + "".join(content(f"<td>{x}</td>", x) for x in r) + "</tr>" for r in rows) + "</table>"
            if kind == 3:
                term, said = phrase(1, 3), sentence()
                return "<dl>" + content(f"<dt>{term}</dt>", term) + content(f"<dd>{said}</dd>", said) + "</dl>"
            if kind == 4:
                said = phrase(2, 9)
                return f"<figure><img src=x.png>{content(f'<figcaption>{said}</figcaption>', said)}</figure>"
            if kind == 5:
                return content(f"<div>{text}</div>", text)
            items = [sentence(1, 6) for _ in range(rng.randint(2, 5))]
            return "<ol>" + "".join(content(f"<li>{x}", x) for x in items) + "</ol>"

        title = phrase(2, 10)
        inside = [content(f"<h1>{title}</h1>", title) if rng.random() < 0.9 else ""] + [block() for _ in range(rng.randint(1, 10))]
        for extra, chance in ((advert, 0.35), (notice, 0.15), (form, 0.15), (sidebar, 0.15), (comments, 0.25), (menu, 0.1)):
            if rng.random() < chance:
                inside.insert(rng.randint(1, len(inside)) if extra is not comments else len(inside), extra())
        body = "".join(inside)
        if rng.random() < 0.1:  # a page of a few words or one stretch of text
            truth.clear()
            said = [prose(some(1, 2, 4, 9)) for _ in range(some(1, 1, 2, 3))]
            body = some(content("<br>".join(said), " ".join(said)), content(f"<p>{' '.join(said)}", " ".join(said)), f"<div>{content('<br><br>'.join(said), ' '.join(said))}</div>", "".join(content(f"<p>{x}</p>", x) for x in said), "".join(content(f"<p><b>{x}<br>", x) for x in said))
        told = rng.random() < 0.5  # a page may say where its article is, or leave it to be seen
        if told:
            main = some(f"<article>{body}</article>", f"<article>{body}</article>", f"<main><article{name('post', 'entry', 'story')}>{body}</article></main>", f"<main>{body}</main>", f"<div{name('content', 'post', 'article', 'entry-content', 'main', 'post-body', 'story')}>{body}</div>", f"<article><section>{body}</section></article>")
        else:
            main = some(body, body, f"<div>{body}</div>", f"<div><div>{body}</div></div>", f'<div id="{word()}">{body}</div>', f'<div class="{word()} {word()}">{body}</div>', f"<section>{body}</section>", f"<table><tr><td>{body}</td></tr></table>", f"<center><div>{body}</div></center>", f'<div class="col wrap"><div class="{word()}">{body}</div></div>')
        around = [f() for f, chance in ((header, 0.9), (notice, 0.4), (advert, 0.6), (form, 0.2)) if rng.random() < chance]
        after = [f() for f, chance in ((sidebar, 0.4), (advert, 0.3), (comments, 0.4), (form, 0.2), (notice, 0.2), (footer, 0.9)) if rng.random() < chance]
        if rng.random() < 0.2:
            around.append(sidebar())
        if rng.random() < 0.1:  # nothing but the article
            around = after = []
        page = f"<html><head><title>{title}</title></head><body>{''.join(around)}{main}{''.join(after)}</body></html>"
        yield page, truth


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Field:
    rows = []
    for html, truth in labelled_pages(pages):
        blocks = leaf_blocks(html)
        rows.append((features(blocks), [int(b[0] in truth) for b in blocks]))
    return Field().fit(rows, epochs)


def main_text(field: Field, html: str) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(b[0] for b, y in zip(blocks, field.viterbi(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page. Null html is an empty page and gives an empty text; a page that breaks off is read to its end; repeated rows give repeated rows; an empty table gives none; columns but these three are not read."""
    spark = pages.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(field or train())  # some hundred weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(held.value, h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html").alias("html")).mapInArrow(scan, "page_id long, url string, text string, n_chars long")
