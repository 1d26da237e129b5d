"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is the sequence of its text blocks. Features are the tags and the class or id words of a block's ancestors and
properties of its text; labels are main text and other. The weights are fitted by gradient ascent on the conditional
likelihood of labelled pages, which ``labelled_pages`` composes, and pages are decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds of HTML elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "title", "template", "noscript", "svg", "math", "textarea", "select", "iframe", "object", "canvas", "audio", "video"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OF_SELECT = {"option", "optgroup", "hr", "script", "template", "select"}
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "tbody", "thead", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "blockquote", "body"}

TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "ul", "ol", "li", "p", "h1", "h2", "h3", "h4", "blockquote", "pre", "table", "dl", "figure", "figcaption", "button", "fieldset", "menu", "dialog", "address"]
WORDS = {
    "advert": r"(^|[-_\s])(ads?|advert\w*|banner|promo\w*|sponsor\w*|outbrain|taboola)([-_\s]|$)",
    "menu": r"nav|menu|breadcrumb|toolbar|pagination|pager|tabs|skip",
    "head": r"header|masthead|topbar|branding|logo",
    "foot": r"foot|copyright|legal|colophon|imprint",
    "side": r"side|related|widget|recommend|trending|popular|teaser|tags?\b|share|social",
    "comment": r"comment|respond|reply|disqus|discussion",
    "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|warning|paywall",
    "form": r"form|subscri|newsletter|login|signup|search",
    "body": r"article|content|post|entry|story|body|main|text",
}
KINDS = {k: re.compile(v) for k, v in WORDS.items()}
SHAPES = ["bias", "short", "middle", "long", "links_some", "links_most", "ends", "copyright", "rights", "comma", "first", "last", "plain"]
FEATURES = [f"in_{t}" for t in TAGS] + [f"kind_{k}" for k in WORDS] + SHAPES
INDEX = {f: i for i, f in enumerate(FEATURES)}


RAW = {"script", "style"}
#: What opens markup, and an attribute; no quantifier gives back what it took, so a page is read once.
OPENS = re.compile(r"<(?:(/?+)([a-zA-Z][^\s/>]*+)|!--|[!?/])")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+(=)\s*+)?+")
BARE = re.compile(r"[^\s>]*+")
#: Decimal references of more digits than any character has.
TOO_LARGE = re.compile(r"&#0*+[0-9]{8,}+;?")


def _read(text: str) -> str:
    """``text`` with its character references decoded."""
    return unescape(TOO_LARGE.sub("\N{REPLACEMENT CHARACTER}", text)) if "&" in text else text


def _attributes(html: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """Attributes of a tag from ``at``, whether it closes itself, and where it ends: -1 if the page ends before it."""
    found: list[tuple[str, str]] = []
    while True:
        m = ATTRIBUTE.match(html, at)
        if not m:
            end = html.find(">", at)
            return found, end > 0 and html[end - 1] == "/", end + 1 if end >= 0 else -1
        at, value = m.end(), ""
        if m[2]:
            if html[at : at + 1] in ("'", '"') and at < len(html):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return found, False, -1
                value, at = html[at + 1 : end], end + 1
            else:
                bare = BARE.match(html, at)
                value, at = bare[0], bare.end()
        found.append((m[1].lower(), _read(value)))


class _Blocks:
    """Text blocks of a page, each with its features.

    Tags, comments and declarations are told apart as browsers do. What is not closed before the page ends (a tag, a
    quoted value, a comment, a script) takes the rest of the page with it and is no text; nothing is an error.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # where in the stack a tag is open
        self.holders: list[int] = []
        self.open: Counter = Counter()
        self.unseen = self.links = 0
        self.text: list[str] = []
        self.link_chars = 0
        self.blocks: list[tuple[str, list[int]]] = []

    def feed(self, html: str) -> None:
        at = 0
        while True:
            m = OPENS.search(html, at)
            if m is None:
                self.handle_data(_read(html[at:]))
                return
            if m.start() > at:
                self.handle_data(_read(html[at : m.start()]))
            if m[2] is None:
                if m[0] == "<!--":
                    end = m.end() + 1 if html.startswith(">", m.end()) else m.end() + 2 if html.startswith("->", m.end()) else html.find("-->", m.end()) + 3
                    at = end if end > m.end() else -1
                else:  # a declaration or what browsers take for a comment
                    at = html.find(">", m.end()) + 1 or -1
            else:
                tag = m[2].lower()
                attrs, alone, at = _attributes(html, m.end())
                if at >= 0 and m[1]:
                    self.handle_endtag(tag)
                elif at >= 0:
                    self.handle_starttag(tag, attrs)
                    if alone and tag not in VOID:
                        self.handle_endtag(tag)
                    elif tag in RAW:
                        end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                        at = end.start() if end else -1
            if at < 0:
                return

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        closes = CLOSED_BY.get(tag, {"p"} if tag not in INLINE and tag not in UNSEEN else ())
        if self.places["select"] and tag not in OF_SELECT:
            self.cut(self.places["select"][0])  # never closed: a list of choices has no other elements
        last = max((self.places[c][-1] for c in closes if self.places[c]), default=-1)
        if last > self.holder():
            self.cut(last)
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower()
        kinds = tuple(f"kind_{k}" for k, p in KINDS.items() if p.search(named)) if named else ()
        names = (f"in_{tag}", *kinds) if f"in_{tag}" in INDEX else kinds
        self.places[tag].append(len(self.stack))
        if tag in HOLDERS:
            self.holders.append(len(self.stack))
        self.stack.append((tag, names))
        self.open.update(names)
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        at = self.places[tag][-1] if self.places[tag] else -1
        if at >= 0 and (tag not in INLINE or at > self.holder()):
            self.cut(at)

    def holder(self) -> int:
        return self.holders[-1] if self.holders else -1

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag, names = self.stack.pop()
            self.places[tag].pop()
            if tag in HOLDERS:
                self.holders.pop()
            self.open.subtract(names)
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"

    def handle_data(self, data):
        if not self.unseen:
            self.text.append(data)
            if self.links:
                self.link_chars += len(data)

    def flush(self) -> None:
        if self.text:
            raw = "".join(self.text)
            text = " ".join(raw.split())
            if text:
                share = self.link_chars / len(raw)
                names = [f for f, n in self.open.items() if n > 0 and f in INDEX]
                names += ["bias", "short" if len(text) < 40 else "middle" if len(text) < 140 else "long"]
                names += ["links_most"] * (share > 0.6) + ["links_some"] * (0.2 < share <= 0.6)
                names += ["ends"] * (text[-1] in ".!?…\"”»") + ["copyright"] * ("©" in text) + ["comma"] * ("," in text)
                names += ["rights"] * bool(re.search("rights reserved|cookie|privacy policy|subscribe|sign up", text, re.I))
                names += ["plain"] * (not any(n.startswith("kind_") for n in names))
                self.blocks.append((text, [INDEX[n] for n in names]))
        self.text, self.link_chars = [], 0


def blocks(html: str) -> list[tuple[str, list[int]]]:
    parser = _Blocks()
    parser.feed(html)
    parser.flush()
    found = parser.blocks
    if found:
        found[0][1].append(INDEX["first"])
        found[-1][1].append(INDEX["last"])
    return found


# --- labelled pages


def labelled_pages(count: int, seed: int) -> list[tuple[str, set[str]]]:
    """Composed pages, each with the texts of its main blocks."""
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice(("ka", "lo", "mi", "ter", "en", "sa", "du", "vor", "ne", "qui", "ra", "os")) for _ in range(rng.randint(1, 4)))

    def sentence(low: int = 4, high: int = 25) -> str:
        words = [word() for _ in range(rng.randint(low, high))]
        return (" ".join(w + "," * (rng.random() < 0.08) for w in words)).capitalize().rstrip(",") + rng.choice((".", ".", ".", "?", "!", ""))

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5, 8))))

    def links(n: int) -> str:
        items = [f'<a href="/{word()}">{word()} {word()}</a>' for _ in range(n)]
        return rng.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "".join(f"<span>{x}</span> " for x in items), "".join(f"<div>{x}</div>" for x in items)))

    def other() -> str:
        text = rng.choice((prose, sentence, lambda: sentence(1, 4)))()
        name = rng.choice(("nav", "menu", "ad", "promo", "side", "foot", "cookie", "form", "comment", "share", "head"))
        inner = f"<p>{text}</p>" if rng.random() < 0.5 else text
        return {
            "nav": f"<nav>{links(rng.randint(2, 8))}</nav>",
            "menu": f'<div class="{rng.choice(("main-menu", "navbar", "breadcrumbs"))}">{links(rng.randint(2, 6))}</div>',
            "ad": f'<div class="{rng.choice(("ad", "ads", "advert", "ad-slot", "banner"))}">{inner}</div>',
            "promo": f'<{(t := rng.choice(("div", "section", "aside")))} class="{rng.choice(("promo", "sponsored", "promo-box"))}">{inner}</{t}>',
            "side": f'<{(t := rng.choice(("aside", "div")))} {rng.choice(("", "class=sidebar", "id=sidebar", "class=related"))if t == "aside" else "class=sidebar"}><h3>{sentence(1, 3)}</h3>{rng.choice((links(3), inner))}</{t}>',
            "foot": f"<footer>{rng.choice(('&copy; ', ''))}{inner}</footer>",
            "cookie": f'<div class="{rng.choice(("cookie-banner", "consent", "notice", "alert"))}">{inner} <button>OK</button></div>',
            "form": f'<form action="/s"><label>{sentence(1, 3)}</label><input name="q">{inner}<button>{word()}</button></form>',
            "comment": f'<{(t := rng.choice(("section", "div", "ol")))} {rng.choice(("id", "class"))}="{rng.choice(("comments", "comment-list", "respond"))}"><h3>{sentence(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(rng.randint(1, 4))) + f"</{t}>",
            "share": f'<div class="{rng.choice(("share", "social", "tags", "widget"))}">{links(3)}</div>',
            "head": f"<header>{rng.choice((inner, f'<h1>{word()}</h1>', links(3)))}</header>",
        }[name]

    made = []
    for _ in range(count):
        main: list[str] = []

        def kept(text: str, main=main) -> str:
            main.append(" ".join(text.split()))
            return text

        body = [f"<h1>{kept(sentence(2, 10))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.72:
                text = kept(prose())
                marked = text if rng.random() < 0.7 else text.replace(" ", " <b>", 1) + "</b>"
                body.append(rng.choice((f"<p>{marked}</p>", f"<p>{marked}</p>", f"<p>{marked}", f"<div>{marked}</div>")))
            elif kind < 0.8:
                body.append(f"<h2>{kept(sentence(1, 6))}</h2>")
            elif kind < 0.87:
                body.append("<ul>" + "".join(f"<li>{kept(sentence(1, 9))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.91:
                body.append(f"<blockquote>{kept(prose())}</blockquote>")
            elif kind < 0.94:
                body.append("<table><tr>" + "".join(f"<td>{kept(sentence(1, 3))}</td>" for _ in range(3)) + "</tr></table>")
            else:
                body.append(other() if rng.random() < 0.7 else f"<pre>{kept(sentence())}</pre>")
        holder = rng.choice(("<article>{}</article>",) * 3 + ("<main>{}</main>", '<div class="content">{}</div>', '<div id="post-body">{}</div>', '<main><article class="entry">{}</article></main>', '<div class="article-text">{}</div>', "<div>{}</div>", "<section>{}</section>"))
        before, after = ("".join(other() for _ in range(rng.randint(0, 4))) for _ in range(2))
        made.append((f"<html><head><title>{sentence()}</title></head><body>{before}{holder.format(''.join(body))}{after}</body></html>", set(main)))
    return made


# --- the field


class Field:
    """Weights: a row of ``state`` for each feature, a column for each label; ``move`` from label to label."""

    def __init__(self, state: np.ndarray, move: np.ndarray):
        self.state, self.move = state, move

    def decode(self, rows: list[list[int]]) -> list[int]:
        if not rows:
            return []
        scores = np.array([self.state[r].sum(axis=0) for r in rows]).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            p, q = a + m00 >= b + m10, a + m01 > b + m11
            back.append((0 if p else 1, 0 if q else 1))
            a, b = (a + m00 if p else b + m10) + x, (a + m01 if q else b + m11) + y
        path = [int(b > a)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


def fit(pages: list[tuple[str, set[str]]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Gradient ascent (per-weight steps) on the mean conditional log-likelihood per block, all pages at once."""
    parsed = [(blocks(html), main) for html, main in pages]
    parsed = [(b, [int(t in main) for t, _ in b]) for b, main in parsed if b]
    n, longest = len(parsed), max(len(b) for b, _ in parsed)
    x = np.zeros((n, longest, len(FEATURES)))
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest))
    for i, (b, labels) in enumerate(parsed):
        y[i, : len(b)], mask[i, : len(b)] = labels, 1
        for t, (_, f) in enumerate(b):
            x[i, t, f] = 1
    hot = np.eye(2)[y] * mask[..., None]
    pair_mask = mask[:, 1:] * mask[:, :-1]
    pairs = np.einsum("nti,ntj,nt->ij", hot[:, :-1], hot[:, 1:], pair_mask)
    state, move = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    g2s, g2m = np.full_like(state, 1e-8), np.full_like(move, 1e-8)
    for _ in range(rounds):
        scores = x @ state
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, longest):
            stepped = np.logaddexp(forward[:, t - 1, :1] + move[0], forward[:, t - 1, 1:] + move[1]) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None] > 0, stepped, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = scores[:, t + 1] + backward[:, t + 1]
            stepped = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(mask[:, t + 1, None] > 0, stepped, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        marginal = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        joint = np.exp(forward[:, :-1, :, None] + move + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        blocks_ = mask.sum()
        gs = np.einsum("ntf,ntl->fl", x, hot - marginal) / blocks_ - decay * state
        gm = (pairs - np.einsum("ntij,nt->ij", joint, pair_mask)) / blocks_ - decay * move
        g2s, g2m = g2s + gs**2, g2m + gm**2
        state, move = state + rate * gs / np.sqrt(g2s), move + rate * gm / np.sqrt(g2m)
    return Field(state, move)


@lru_cache(maxsize=1)
def trained() -> Field:
    return fit(labelled_pages(400, 11))


def main_text(html: str, field: Field) -> str:
    found = blocks(html)
    return "\n".join(t for (t, _), keep in zip(found, field.decode([f for _, f in found]), strict=True) if keep)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Text blocks of the main text in page order, joined by \\n, white space inside a block as one space; null or empty
    pages and pages without main text give an empty text. Repeated rows and nulls in other columns come back as they
    are; extra columns are ignored; an empty table gives none.
    """
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", field) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9(spark, sf_dir: str) -> DataFrame:
    """Every page of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
