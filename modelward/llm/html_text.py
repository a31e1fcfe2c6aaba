"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that begin a new block, that have no content, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body canvas caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form frame "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody "
    "td template textarea tfoot th thead title tr ul button iframe".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
#: An open element of these ends where another of its kind, or a container around it, begins or ends.
ENDS_ITSELF = frozenset("p li dt dd td th tr option".split())

#: Comments, raw elements, declarations, tags, tags that the page ends in, text. A quote begins a value only after ``=``, and
#: what has been read is never read again, so that unclosed quotes cost no second look at the rest of the page.
TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PARTS = re.compile(r"[a-z]+")


class Open(NamedTuple):
    """An open element. What it shares with the one around it is one object, so deep pages cost little for each element."""

    tag: str
    own: str  # the nearest element that begins a block
    tags: frozenset[str]  # of the way from the root
    names: frozenset[str]
    linked: bool


ROOT = Open("", "none", frozenset(), frozenset(), False)


@dataclass
class Block:
    """Text of one leaf block, still with character references, and where it stands."""

    pieces: list[str]
    place: Open
    linked: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.pieces)).split())


def leaf_blocks(page: str, tags: frozenset[str] | None = None, names: frozenset[str] | None = None) -> list[Block]:
    """Blocks with text, in page order. Unclosed, crossed and cut-off tags are read as browsers mostly do.

    Of the way to a block only the given tags and names are kept, all of them if none are given.
    """
    out: list[Block] = []
    stack: list[Open] = []
    # How often a tag is open, and where in the stack the elements are that begin blocks.
    count: dict[str, int] = {}
    marks: list[int] = []
    now: Block | None = None

    def cut(k: int) -> None:
        for closed in stack[k:]:
            count[closed.tag] -= 1
        del stack[k:]
        while marks and marks[-1] >= k:
            marks.pop()

    for m in TOKENS.finditer(page):
        text = m.group(8)
        around = stack[-1] if stack else ROOT
        if text is not None:
            if now is None:
                if text.isspace():
                    continue
                now = Block([], around)
                out.append(now)
            now.pieces.append(text)
            if around.linked:
                now.linked += len(text)
            continue
        name = (m.group(3) or m.group(6) or "").lower()
        if not name:
            continue
        closing = bool(m.group(2) or m.group(5))
        if name in BLOCKS:
            now = None
        elif name == "br" and now is not None:
            now.pieces.append(" ")
        if closing:
            if count.get(name):
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                cut(k)
            continue
        attributes = m.group(4) or m.group(7) or ""
        if name not in EMPTY and not attributes.endswith("/"):
            if name in BLOCKS and name != "body":
                # A paragraph ends where a block begins; an item ends where its like begins.
                for k in reversed(marks):
                    if stack[k].tag == "p" or (name in ENDS_ITSELF and stack[k].tag == name):
                        cut(k)
                        break
                    if stack[k].tag not in ENDS_ITSELF:
                        break
            around = stack[-1] if stack else ROOT
            way, called = around.tags, around.names
            if name not in way and (tags is None or name in tags):
                way = way | {name}
            if "=" in attributes and (own := {p for v in NAMES.findall(attributes) for p in PARTS.findall(v.lower()) if names is None or p in names} - called):
                called = called | own
            if name in BLOCKS:
                marks.append(len(stack))
            count[name] = count.get(name, 0) + 1
            stack.append(Open(name, name if name in BLOCKS else around.own, way, called, around.linked or name == "a"))
    return out


@lru_cache(100_000)
def placed(own: str, tags: frozenset[str], names: frozenset[str]) -> tuple[str, ...]:
    """What is seen of a block's place: its ancestors and their names."""
    loose = () if "article" in tags or "main" in tags else ("loose",)
    return (f"tag={own}", *loose, *sorted(f"in={t}" for t in tags), *sorted(f"name={w}" for w in names))


def worded(block: Block, text: str, place: str) -> tuple[str, ...]:
    """What is seen of a block's text."""
    letters = max(sum(map(len, block.pieces)), 1)
    stops = text.count(". ") + text.count("! ") + text.count("? ") + text.endswith((".", "!", "?"))
    rights = ("rights",) if "©" in text or "copyright" in text.lower() else ()
    return (f"words={min((text.count(' ') + 1).bit_length(), 7)}", f"links={int(3 * min(block.linked / letters, 1))}", f"stops={min(stops, 3)}", f"ended={text.endswith(('.', '!', '?', '”', '"'))}", place, *rights)


def features(blocks: list[Block], texts: list[str]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """What is seen of each block: of its place and of its text."""
    last = len(blocks) - 1
    return [(placed(b.place.own, b.place.tags, b.place.names), worded(b, t, "first" if i == 0 else "last" if i == last else "inner")) for i, (b, t) in enumerate(zip(blocks, texts))]


@dataclass
class Field:
    """Weights of a two-state chain: state 1 is main text."""

    weights: dict[str, float] = field(default_factory=dict)
    turns: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    sums: dict[tuple[str, ...], float] = field(default_factory=dict)
    ways: tuple[frozenset[str], frozenset[str]] | None = None

    def known(self) -> tuple[frozenset[str], frozenset[str]]:
        """The tags and names that have a weight, or stand for a place outside the main element."""
        if self.ways is None:
            of = lambda kind: frozenset(f.removeprefix(kind) for f in self.weights if f.startswith(kind))
            self.ways = of("in=") | {"article", "main"}, of("name=")
        return self.ways

    def sum(self, seen: tuple[str, ...]) -> float:
        """Weight of some features; places and wordings recur, so their sums are kept, up to a bound."""
        found = self.sums.get(seen)
        if found is None:
            if len(self.sums) > 100_000:
                self.sums.clear()
            found = self.sums[seen] = sum(self.weights.get(f, 0.0) for f in seen)
        return found

    def decoded(self, seen: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> list[bool]:
        """The likeliest states of a page's blocks, by Viterbi."""
        (t00, t01), (t10, t11) = self.turns.tolist()
        lean = [self.sum(place) + self.sum(wording) for place, wording in seen]
        a, b, back = 0.0, 0.0, []
        for k, x in enumerate(lean):
            if k:
                stay, come = (a + t00, b + t10), (a + t01, b + t11)
                back.append((stay[1] > stay[0], come[1] > come[0]))
                a, b = max(stay), max(come)
            b += x
        states = [b > a]
        for from0, from1 in reversed(back):
            states.append(from1 if states[-1] else from0)
        return states[::-1][: len(seen)]


def fitted(pages: list[tuple[list, list[int]]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Adam on the conditional log likelihood; forward and backward sums run over all pages at once."""
    pages = [([(*place, *wording) for place, wording in seen], y) for seen, y in pages]
    index = {f: k for k, f in enumerate(sorted({f for seen, _ in pages for fs in seen for f in fs}))}
    n, length = len(pages), max(len(y) for _, y in pages)
    y, mask = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    flat, owner = [], []
    for p, (seen, labels) in enumerate(pages):
        y[p, : len(labels)], mask[p, : len(labels)] = labels, True
        for t, fs in enumerate(seen):
            flat += [index[f] for f in fs]
            owner += [p * length + t] * len(fs)
    flat, owner = np.array(flat), np.array(owner)
    w, turns = np.zeros(len(index)), np.zeros((2, 2))
    both = mask[:, 1:] & mask[:, :-1]
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[:, :-1][both], y[:, 1:][both]), 1)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(turns), np.zeros_like(turns)]
    for step in range(1, rounds + 1):
        score = np.bincount(owner, w[flat], n * length).reshape(n, length)
        local = np.stack([np.zeros_like(score), score], axis=2)
        forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        forward[:, 0] = local[:, 0]
        for t in range(1, length):
            ahead = np.logaddexp(forward[:, t - 1, 0, None] + turns[0], forward[:, t - 1, 1, None] + turns[1]) + local[:, t]
            forward[:, t] = np.where(mask[:, t, None], ahead, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            behind = backward[:, t + 1] + local[:, t + 1]
            back = np.logaddexp(turns[:, 0] + behind[:, 0, None], turns[:, 1] + behind[:, 1, None])
            backward[:, t] = np.where(mask[:, t + 1, None], back, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        chance = np.exp(forward + backward - total[:, None, None])[:, :, 1] * mask
        pair = forward[:, :-1, :, None] + turns + (local[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.where(both[:, :, None, None], pair, -np.inf))).sum(axis=(0, 1))
        gw = np.bincount(flat, (y * mask - chance).reshape(-1)[owner], len(index)) / n - decay * w
        gt = (gold - expected) / n - decay * turns
        for k, (v, g) in enumerate(((w, gw), (turns, gt))):
            m, s = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(w[k]) for f, k in index.items()}, turns)


def labelled_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A made page and the texts of its main blocks: layouts and boilerplate drawn at random, words invented."""
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), rng.integers(2, 9)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    sentence = lambda: phrase(3, 14).capitalize() + str(rng.choice([".", ".", ".", "!", "?"]))
    pick = lambda *x: str(x[int(rng.integers(len(x)))])
    links = lambda: "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(rng.integers(3, 8)))
    good: list[str] = []

    def keep(text: str) -> str:
        good.append(text)
        return text

    def body_part() -> str:
        kind = rng.random()
        if kind < 0.72:
            return f"<p>{keep(' '.join(sentence() for _ in range(rng.integers(1, 7))))}</p>"
        if kind < 0.82:
            return f"<{(h := pick('h2', 'h3'))}>{keep(phrase(1, 7))}</{h}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{keep(phrase(2, 12))}</li>" for _ in range(rng.integers(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{keep(sentence())}</p></blockquote>"
        if kind < 0.94:
            return f"<p><b>{keep(sentence())}<br></p>"
        if kind < 0.97:
            return f'<p>{pick("", "<b>")}<a href="/{word()}">{keep(" ".join(sentence() for _ in range(rng.integers(1, 4))))}</a></p>'
        return f"<table><tr><td>{keep(phrase(1, 4))}</td><td>{keep(phrase(1, 4))}</td></tr></table>"

    def junk() -> str:
        return pick(
            f'<div class="{pick("ad", "ads", "advert", "banner", "sponsored", "promo")}">{sentence()}</div>',
            f'<aside class="{pick("sidebar", "related", "widget")}"><h3>{phrase(1, 4)}</h3><ul>{links()}</ul></aside>',
            f'<div class="{pick("share", "social", "toolbar")}"><a href="#">{word()}</a> <a href="#">{word()}</a></div>',
            f'<form action="/s"><label>{phrase(1, 4)}</label><input name="q"><button>{word()}</button></form>',
            f'<form action="/s"><p>{sentence()} {sentence()}</p><p>{phrase(1, 5)}</p><input name="q"></form>',
            f"<aside><p>{sentence()} {sentence()}</p></aside>",
            f'<{(t := pick("nav", "footer", "header"))}><p>{sentence()} {sentence()}</p></{t}>',
            f'<div id="{pick("cookie", "notice", "consent", "gdpr")}"><p>{sentence()} {sentence()}</p><button>{word()}</button></div>',
            f'<div class="{pick("newsletter", "subscribe", "signup")}"><p>{sentence()}</p></div>',
            f'<div class="{pick("breadcrumb", "pagination", "tags", "menu", "meta")}"><a href="/">{word()}</a> <a href="/x">{word()}</a></div>',
        )

    def comments() -> str:
        rows = "".join(f'<div class="comment"><span class="author">{word()}</span><p>{sentence()} {sentence()}</p></div>' for _ in range(rng.integers(1, 5)))
        return f'<{(t := pick("section", "div"))} {pick("id", "class")}="{pick("comments", "comments", "replies", "discussion", "reader-comments")}"><h3>{phrase(1, 3)}</h3>{rows}</{t}>'

    title = phrase(2, 9)
    if rng.random() < 0.04:  # bare text
        return "\n".join(f"<p>{keep(' '.join(sentence() for _ in range(rng.integers(1, 5))))}</p>" for _ in range(rng.integers(1, 5))), good
    head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>track({rng.integers(999)});</script></head><body>"
    top = pick(f"<nav><ul>{links()}</ul></nav>", f'<header><h1>{phrase(1, 3)}</h1><nav><ul>{links()}</ul></nav></header>', f'<div class="{pick("nav", "menu", "header", "topbar")}"><ul>{links()}</ul></div>', "")
    opening = junk() if rng.random() < 0.6 else ""
    inner = [f"<h1>{keep(title)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.integers(1, 12)):
        inner.append(body_part())
        if rng.random() < 0.15:
            inner.append(junk())
    if rng.random() < 0.15:
        inner.append(comments())
    text = "".join(inner)
    frame = rng.random()
    wrapped = f"<article>{text}</article>" if frame < 0.55 else f"<main>{text}</main>" if frame < 0.7 else f'<div class="{pick("content", "post", "entry", "story", "article", "text")}">{text}</div>' if frame < 0.9 else f"<div>{text}</div>" if frame < 0.95 else text
    closing = (comments() if rng.random() < 0.3 else "") + (junk() if rng.random() < 0.5 else "")
    foot = pick(f"<footer>&copy; {word()}.example &middot; {sentence()}</footer>", f'<div class="footer"><p>&copy; {phrase(2, 6)}</p></div>', f"<footer><ul>{links()}</ul><p>{sentence()}</p></footer>", "")
    return f"{head}{top}{opening}{wrapped}{closing}{foot}</body></html>", good


@cache
def trained(pages: int = 500, seed: int = 23) -> Field:
    """A field trained on labelled pages."""
    rng = np.random.default_rng(seed)
    examples = []
    for _ in range(pages):
        page, good = labelled_page(rng)
        blocks = leaf_blocks(page)
        texts = [b.text() for b in blocks]
        rest, labels = list(good), []
        for t in texts:
            # Main texts come in page order; the title in the head is not one of them.
            mine = bool(rest) and t == " ".join(html.unescape(rest[0]).split()) and "title" not in blocks[len(labels)].place.tags
            labels.append(int(mine))
            if mine:
                rest.pop(0)
        examples.append((features(blocks, texts), labels))
    return fitted(examples)


def main_text(page: str, model: Field) -> str:
    blocks = leaf_blocks(page, *model.known())
    texts = [b.text() for b in blocks]
    kept = [(b, t) for b, t in zip(blocks, texts) if t]
    if not kept:
        return ""
    blocks, texts = [b for b, _ in kept], [t for _, t in kept]
    return "\n".join(t for t, main in zip(texts, model.decoded(features(blocks, texts))) if main)


def extracted_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", model: Field | None = None) -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Null and empty pages, and pages without main text, have an empty text. Null ids and urls and repeated rows are kept;
    other columns are not read; an empty table gives no rows. Pages may be of any length and depth. Cut-off pages are read as far as they go.
    """
    model = model or trained()
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_column, url_column)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", model) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")).mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
