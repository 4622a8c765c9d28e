"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags. Each block is a vector of its hashed tag path
(tags, class and id words of all elements around it, the inner ones counting more), its hashed words and a few measures. A
bidirectional LSTM in numpy reads the blocks of the page in order, so each block is judged in the light of the whole page,
and labels it as main text or not. The main blocks are joined by an empty line. Pages are parsed in one pass; long ones
are read STEPS blocks at a time in either direction, with the state carried on, so nothing grows but the blocks themselves.

The labeller is trained in each call on generated pages, whose layouts are drawn from many templates and whose text comes
from a sample of the table's own pages, and on that sample itself, labelled by the elements that say what they are
(article, nav, footer and the like). The sample holds SAMPLE pages, those with the least hash of their id among pages of
SAMPLE_CHARS characters at most; generated pages draw from its first LINES lines and WORDS words.

Character references are decoded; white space inside a block becomes one space; the content of script, style, title and
textarea is no text of the page and dropped; nothing else is dropped or capped. Formulas, drawings, media, templates,
noscript, frames and selects are elements like others: the labeller judges their text.

Defined cases: a null or empty html gives an empty text; repeated pages are read each; markup that is cut off or not
closed is read as far as it goes; an empty table gives an empty result; columns other than page_id, url and html are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
) | frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts semantics annotation".split())
#: Inside these a tag that ends in a slash has no content; EMPTY can be written so anywhere.
FOREIGN = frozenset("svg math".split())
EMPTY = FOREIGN | frozenset("noscript template iframe object select canvas audio video".split())
#: An opening tag closes these if they are open inside the same parent.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARENTS = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav header footer form body html blockquote".split())
RAW = frozenset("script style title textarea".split())
#: What elements and their names say of their content, for labelling the sample; fixed words.
MAIN = frozenset("article main".split())
NOT_MAIN = frozenset("nav aside footer header form menu dialog button".split())
NOT_MAIN_NAMES = frozenset(
    "nav menu menubar sidebar side ad ads advert advertisement banner promo sponsor sponsored cookie cookies consent notice alert comments comment reply replies respond "
    "disqus footer header breadcrumb breadcrumbs share social related widget subscribe newsletter login search popup modal masthead toolbar pagination pager copyright".split()
)
_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:_-]*+))", re.I)
_STOP = re.compile(r"[>\"']")
_EDGE = re.compile(r"[<>]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_NO_DIGITS = dict.fromkeys(map(ord, "0123456789"))


class Element:
    """An open element and, through its parents, all around it; blocks share them."""

    __slots__ = ("length", "names", "out", "parent", "said")

    def __init__(self, parent: Element | None, names: tuple[str, ...]):
        self.parent, self.names = parent, names
        self.length = len(names) + (parent.length if parent else 0)
        self.said = bool(parent and parent.said) or any(t in MAIN for t in names)
        self.out = bool(parent and parent.out) or any(t in NOT_MAIN or t[:1] == "." and t[1:] in NOT_MAIN_NAMES for t in names)

    def nearest(self, most: int) -> tuple[str, ...]:
        """Tokens of so many innermost elements, the last first."""
        found, at = [], self
        while at is not None and most:
            found += at.names[::-1]
            at, most = at.parent, most - 1
        return tuple(found)


class Block(NamedTuple):
    text: str
    path: Element | None
    linked: float


class Stack:
    """Open elements, with the places of each tag, so that no step walks the whole stack."""

    def __init__(self):
        self.open: list[tuple[str, Element]] = []
        self.places: dict[str, list[int]] = {}
        self.parents, self.blocks = [-1], [-1]  # places of elements that bound what a tag closes; of those that aren't inline
        self.foreign = 0

    @property
    def top(self) -> Element | None:
        return self.open[-1][1] if self.open else None

    def n_open(self, tag: str) -> int:
        return len(self.places.get(tag, ()))

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        at = len(self.open)
        self.open.append((tag, Element(self.top, names)))
        self.places.setdefault(tag, []).append(at)
        if tag in PARENTS:
            self.parents.append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        self.foreign += tag in FOREIGN

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, _ = self.open.pop()
            self.places[tag].pop()
            if tag in PARENTS:
                self.parents.pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.foreign -= tag in FOREIGN

    def end(self, tag: str) -> None:
        """Closes the last element of that tag; an inline one only inside its block."""
        k = self.last(tag)
        if k >= 0 and (tag not in INLINE or k > self.blocks[-1]):
            self.pop_to(k)

    def shut(self, tags) -> None:
        """Closes the last element of one of the tags inside the same parent."""
        k = max(map(self.last, tags), default=-1)
        if k > self.parents[-1]:
            self.pop_to(k)


class Ends:
    """Ends of tags in a page, found in one pass however many of them are never closed."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()  # places of quotes from which no end is reached
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.known = (0, -1)  # from the first of these places on, the second is the next > or quote

    def stop(self, at: int) -> int:
        low, high = self.known
        if not low <= at <= high:
            m = _STOP.search(self.page, at)
            high = m.start() if m else -1
            self.known = (at, high)
        return high

    def of(self, at: int) -> int:
        """Place of the > that ends a tag whose name ends at this place, outside quotes; -1 where there is none."""
        tried = []
        while at <= self.last[">"]:
            stop = self.stop(at)
            mark = self.page[stop]
            if mark == ">":
                return stop
            if stop in self.dead:
                break
            tried.append(stop)
            if stop >= self.last[mark]:
                break
            at = self.page.find(mark, stop + 1) + 1
        self.dead.update(tried)
        return -1


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    page = page or ""
    stack, ends = Stack(), Ends(page)
    out: list[Block] = []
    parts: list[str] = []
    path: Element | None = None
    link_chars = 0

    def close() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, path, min(1.0, link_chars / len(text))))
            parts.clear()
        link_chars = 0

    def add(text: str) -> None:
        nonlocal path, link_chars
        if text:
            if not parts:
                path = stack.top
            parts.append(text)
            if stack.n_open("a") and not text.isspace():
                link_chars += len(text.strip())

    def after(mark: str, at: int) -> int:
        """Place behind the next mark, or the page's end."""
        found = page.find(mark, at)
        return found + len(mark) if found >= 0 else len(page)

    at = scan = 0
    while m := _OPEN.search(page, scan):
        start, attrs = m.start(), ""
        if m[1]:
            scan = after("-->", m.end())
        elif m[2]:
            scan = after("]]>", m.end())
        elif m[3]:
            if m.end() > ends.last[">"]:
                scan = m.end()  # no tag: its < is text
                continue
            scan = page.find(">", m.end()) + 1
        else:
            stop = ends.of(m.end())
            if stop >= 0:
                attrs, scan = page[m.end() : stop], stop + 1
            else:  # not closed: up to the next angle, or as far as it goes
                edge = _EDGE.search(page, m.end())
                if edge and edge[0] == "<":
                    scan = m.end()
                    continue
                scan = edge.end() if edge else len(page)
        if start > at:
            add(html.unescape(page[at:start]))
        at = scan
        if m[2]:
            add(page[m.end() : scan - 3] if page.endswith("]]>", 0, scan) else page[m.end() : scan])
        if not m[5]:
            continue
        tag = m[5].lower()
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            close()
        if m[4]:
            stack.end(tag)
            continue
        if tag in RAW:
            # A slash closes nothing here, but inside drawings and formulas.
            if not (attrs.endswith("/") and stack.foreign):
                end = _RAW_END[tag].search(page, scan)
                stop = page.find(">", end.end()) if end else -1
                at = scan = stop + 1 if stop >= 0 else len(page)
            continue
        if tag in VOID:
            continue
        shut = CLOSES.get(tag, () if tag in INLINE else ("p",))
        if shut:
            stack.shut(shut)
        if attrs.endswith("/") and (tag in EMPTY or stack.foreign):
            continue
        names = [tag]
        for found in _NAMES.findall(attrs):
            names += [f".{x.lower()}" for x in _PARTS.findall("".join(found))]
        stack.push(tag, tuple(names))
    if at < len(page):
        add(html.unescape(page[at:]))
    close()
    return out


PATH_DIM, WORD_DIM = 96, 48
MEASURES = 9
INPUT = PATH_DIM + WORD_DIM + MEASURES
HIDDEN_DIM = 20
#: Blocks of a page read at a time; elements whose sums are held at a time; bound of a path's sums.
STEPS, HELD, CLIP = 2048, 20_000, 4.5


class _Hashed(dict):
    """(place, sign) of a token in a hashed vector, remembered up to a bound."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) > 300_000:
            self.clear()
        h = crc32(token.encode("utf-8", "surrogatepass"))
        self[token] = found = (h % self.dim, 1.0 if h >> 31 else -1.0)
        return found


class _Places(dict):
    """Place of a word in a hashed vector, dim further on for words of sign -1, remembered up to a bound."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = crc32(word.encode("utf-8", "surrogatepass"))
        self[word] = found = h % self.dim + (0 if h >> 31 else self.dim)
        return found


def digits(text: str) -> int:
    """How many signs of a text are digits; of plain texts by removing them."""
    return len(text) - len(text.translate(_NO_DIGITS)) if text.isascii() else sum(map(str.isdigit, text))


class Vectors:
    """Turns the blocks of a page into rows of numbers."""

    def __init__(self):
        self.path, self.place = _Hashed(PATH_DIM), _Places(WORD_DIM)
        self.own: dict[tuple[str, ...], np.ndarray] = {}
        self.sums: dict[Element, tuple[np.ndarray, np.ndarray]] = {}
        #: Path vectors by parent and tokens: neighbours that are tagged alike share one.
        self.shared: dict[tuple[Element | None, tuple[str, ...]], np.ndarray] = {}

    def of_names(self, names: tuple[str, ...]) -> np.ndarray:
        found = self.own.get(names)
        if found is None:
            if len(self.own) > HELD:
                self.own.clear()
            found = np.zeros(PATH_DIM, np.float32)
            for token in names:
                place, sign = self.path[token]
                found[place] += sign
            self.own[names] = found
        return found

    def of_path(self, element: Element) -> np.ndarray:
        """Vector of an element and all around it: the sum of their tokens, and a sum that halves at each step outwards. Each
        element adds its own to its parent's sums."""
        key = element.parent, element.names
        found = self.shared.get(key)
        if found is not None:
            return found
        chain, at = [], element
        while at is not None and at not in self.sums:
            chain.append(at)
            at = at.parent
        zero = np.zeros(PATH_DIM, np.float32)
        every, near = self.sums[at] if at is not None else (zero, zero)
        for at in reversed(chain):
            own = self.of_names(at.names)
            every, near = every + own, near / 2 + own
            if len(self.sums) > HELD:
                self.sums.clear()
            self.sums[at] = (every, near)
        # Many equal elements around a block must not drown the others in its gates.
        if len(self.shared) > HELD:
            self.shared.clear()
        found = self.shared[key] = np.minimum(np.maximum(0.6 * every + 0.4 * near, -CLIP), CLIP)
        return found

    def of(self, page: list[Block], first: int = 0, end: int | None = None) -> np.ndarray:
        """A row for each block of a page, or for those from first to end."""
        end = len(page) if end is None else end
        out = np.zeros((end - first, INPUT), np.float32)
        for r, i in enumerate(range(first, end)):
            b = page[i]
            words = b.text.lower().split(" ")
            if b.path:
                out[r, :PATH_DIM] = self.of_path(b.path)
            # Words of sign -1 are counted behind the others and taken off.
            counts = np.bincount(list(map(self.place.__getitem__, words)), minlength=2 * WORD_DIM)
            out[r, PATH_DIM : PATH_DIM + WORD_DIM] = (counts[:WORD_DIM] - counts[WORD_DIM:]) / np.sqrt(len(words))
            n = len(b.text)
            stops = sum(map(b.text.count, ".!?;:,"))
            out[r, PATH_DIM + WORD_DIM :] = (
                np.log1p(len(words)) / 4, b.linked, (i + 1) / len(page), 1 / (i + 1), 1 / (len(page) - i), min(2, 10 * stops / n),
                b.text[-1] in ".!?", min(60, b.path.length if b.path else 0) / 10, digits(b.text) / n,
            )
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each step."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN_DIM
        self.p = {"out": rng.normal(0, 0.2, (2 * h, 1)), "out_b": np.zeros(1)}
        for way in ("on", "back"):
            self.p[f"{way}_x"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * h))
            self.p[f"{way}_h"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p[f"{way}_b"] = np.repeat([0.0, 1.0, 0.0, 0.0], h)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _read(self, x: np.ndarray, mask: np.ndarray, way: str, begin: tuple | None = None, keep: bool = True) -> tuple[np.ndarray, list, tuple]:
        """Hidden states (time, batch, unit) of one direction, gates of each step if they are to be kept, and the last state
        and cell; masked steps carry the state on. begin: state and cell to go on from."""
        steps, batch, h = len(x), x.shape[1], HIDDEN_DIM
        from_x = x @ self.p[f"{way}_x"] + self.p[f"{way}_b"]
        state, cell = begin or (np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32))
        out, kept = np.zeros((steps, batch, h), np.float32), [None] * steps
        for t in range(steps) if way == "on" else range(steps - 1, -1, -1):
            z = from_x[t] + state @ self.p[f"{way}_h"]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            new_cell = f * cell + i * g
            squashed = np.tanh(new_cell)
            new_state = o * squashed
            m = mask[t][:, None]
            if keep:
                kept[t] = (state, cell, i, f, o, g, squashed)
            state, cell = np.where(m, new_state, state), np.where(m, new_cell, cell)
            out[t] = state
        return out, kept, (state, cell)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._read(x, mask, way, keep=False)[0] for way in ("on", "back")], -1)
        return (both @ self.p["out"])[..., 0] + self.p["out_b"]

    def page_logits(self, page: list[Block], vectors: Vectors, steps: int = STEPS) -> np.ndarray:
        """The same for one page of any length, steps blocks at a time."""
        total = np.full(len(page), self.p["out_b"][0], np.float32)
        for way, weights in (("on", self.p["out"][:HIDDEN_DIM, 0]), ("back", self.p["out"][HIDDEN_DIM:, 0])):
            begin, firsts = None, range(0, len(page), steps)
            for first in firsts if way == "on" else reversed(firsts):
                end = min(first + steps, len(page))
                x = vectors.of(page, first, end)[:, None]
                states, _, begin = self._read(x, np.ones((end - first, 1), bool), way, begin, keep=False)
                total[first:end] += states[:, 0] @ weights
        return total

    def gradients(self, x: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        h, read = HIDDEN_DIM, {way: self._read(x, mask, way) for way in ("on", "back")}
        both = np.concatenate([read["on"][0], read["back"][0]], -1)
        d = (_sigmoid((both @ self.p["out"])[..., 0] + self.p["out_b"]) - truth) * mask / max(mask.sum(), 1)
        g = {"out": np.einsum("tbu,tb->u", both, d)[:, None], "out_b": d.sum()[None]}
        d_both = d[..., None] * self.p["out"][:, 0]
        for way in ("on", "back"):
            d_out = d_both[..., :h] if way == "on" else d_both[..., h:]
            d_state, d_cell = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
            d_z = np.zeros((*x.shape[:2], 4 * h), np.float32)
            d_h = np.zeros_like(self.p[f"{way}_h"])
            for t in range(len(x) - 1, -1, -1) if way == "on" else range(len(x)):
                state, cell, i, f, o, c, squashed = read[way][1][t]
                m = mask[t][:, None]
                d_new = np.where(m, d_state + d_out[t], 0)
                pass_on = np.where(m, 0, d_state + d_out[t])
                d_c = np.where(m, d_cell, 0) + d_new * o * (1 - squashed**2)
                d_z[t] = np.concatenate([d_c * c * i * (1 - i), d_c * cell * f * (1 - f), d_new * squashed * o * (1 - o), d_c * i * (1 - c**2)], 1)
                d_h += state.T @ d_z[t]
                d_state = d_z[t] @ self.p[f"{way}_h"].T + pass_on
                d_cell = d_c * f + np.where(m, 0, d_cell)
            g[f"{way}_h"], g[f"{way}_b"] = d_h, d_z.sum((0, 1))
            g[f"{way}_x"] = np.einsum("tbi,tbz->iz", x, d_z, optimize=True)
        return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch, feature) and (time, batch) of pages of unlike length."""
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), INPUT), np.float32), np.zeros((longest, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, True
    return x, mask


EPOCHS, BATCH, RATE, SAMPLE, GENERATED = 6, 24, 0.01, 240, 720
SAMPLE_CHARS, LINES, WORDS = 200_000, 4000, 8000


def train(pages: list[tuple[list[Block], list[bool]]], seed: int = 11) -> Labeller:
    """Fits the labeller by Adam on labelled pages."""
    rng, vectors = np.random.default_rng(seed), Vectors()
    data = sorted(((vectors.of(b), np.array(y, np.float32)) for b, y in pages if b), key=lambda d: len(d[0]))
    groups = [data[k : k + BATCH] for k in range(0, len(data), BATCH)]
    ready = []
    for group in groups:
        x, mask = padded([v for v, _ in group])
        truth = np.zeros(mask.shape, np.float32)
        for k, (_, y) in enumerate(group):
            truth[: len(y), k] = y
        ready.append((x, mask, truth))
    model = Labeller(rng)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(ready)):
            x, mask, truth = ready[k]
            step += 1
            # Some paths are blanked, so that words and surroundings are learned too.
            x = x * 1
            x[..., :PATH_DIM] *= rng.random(x.shape[:2])[..., None] > 0.1
            g = model.gradients(x, mask, truth)
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for name, v in g.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                rate = RATE * (1 - 0.8 * epoch / EPOCHS)
                model.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def said_main(path: Element | None) -> bool:
    """Whether a block's elements say that it is main text."""
    return bool(path and path.said and not path.out)


class Layouts:
    """Draws pages with known main blocks."""

    SHORT = ("Home", "About us", "Contact", "Products", "News", "Log in", "Sign up", "Search", "Next page", "Privacy policy", "Terms of use", "Subscribe", "Menu", "Share", "Archive")
    NOTICE = ("We use cookies to improve this site. Accept all", "This site uses cookies.", "Please log in to read on.", "Sign up for our newsletter", "Skip to content", "Advertisement", "All rights reserved.")

    def __init__(self, rng: np.random.Generator, lines: list[str], words: list[str]):
        self.rng, self.lines, self.words = rng, lines or ["A line of text, and then some more of it."], words or ["word", "text", "line"]

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def often(self, share: float) -> bool:
        return bool(self.rng.random() < share)

    def some(self, low: int, high: int) -> str:
        return " ".join(self.pick(*self.words) for _ in range(int(self.rng.integers(low, high + 1))))

    def sentence(self) -> str:
        line = self.pick(*self.lines)
        return line if self.often(0.8) else self.some(8, 60).capitalize() + "."

    def element(self, tag: str, name: str, inside: str) -> str:
        key = self.pick("class", "class", "id")
        return f'<{tag} {key}="{name}">{inside}</{tag}>' if name else f"<{tag}>{inside}</{tag}>"

    def links(self, low: int = 3, high: int = 9) -> str:
        texts = [self.pick(self.pick(*self.SHORT), self.some(1, 3)) for _ in range(int(self.rng.integers(low, high)))]
        if self.often(0.6):
            return "<ul>" + "".join(f'<li><a href="/x">{html.escape(t)}</a></li>' for t in texts) + "</ul>"
        return "".join(self.pick('<a href="#">{}</a> ', '<p><a href="#">{}</a></p>', '<div><a href="#">{}</a></div>').format(html.escape(t)) for t in texts)

    def main(self) -> str:
        mark = lambda t: f"\x01{html.escape(t)}\x02"
        out = [f"<h1>{mark(self.some(2, 9))}</h1>"] if self.often(0.85) else []
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.72:
                out.append(self.pick("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p><em>{}</em></p>").format(mark(self.sentence() if self.often(0.85) else self.some(1, 4))))
            elif kind < 0.8:
                out.append(self.pick("<h2>{}</h2>", "<h3>{}</h3>").format(mark(self.some(1, 6))))
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{mark(self.some(2, 15))}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{mark(self.sentence())}</blockquote>")
            elif kind < 0.93:
                out.append("<table><tr>" + "".join(f"<td>{mark(self.some(1, 6))}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.96:
                out.append(self.ad())
            else:
                out.append(f"<pre>{mark(self.some(5, 30))}</pre>")
        return "".join(out)

    def ad(self) -> str:
        return self.element(self.pick("div", "div", "aside", "p", "section"), self.pick("ad", "ads", "advert", "ad-slot", "banner", "promo", "sponsored"), html.escape(self.pick(self.sentence(), self.some(3, 20))))

    def comments(self) -> str:
        one = lambda: self.pick(
            '<li class="comment"><p>{}</p></li>', '<div class="comment"><b>{}</b><p>{}</p></div>', '<article class="comment"><p>{}</p></article>', '<div class="reply">{}</div>'
        ).replace("{}", html.escape(self.sentence()))
        inside = self.pick("<h3>Comments</h3>", "<h2>3 comments</h2>", "<h3>Leave a reply</h3>", "") + "".join(one() for _ in range(int(self.rng.integers(1, 6))))
        return self.element(self.pick("section", "div", "ol", "aside"), self.pick("comments", "comment-list", "respond", "discussion comments"), inside)

    def page(self) -> str:
        note = lambda: self.element(self.pick("div", "p", "aside"), self.pick("cookie", "notice", "alert", "consent", "popup"), self.pick(*self.NOTICE, html.escape(self.sentence())))
        form = lambda: self.element("form", self.pick("search", "newsletter", "login", ""), self.pick(*self.NOTICE) + self.pick("<label>Email</label>", "<p>Name</p>", "") + "<button>Send</button>")
        top = []
        if self.often(0.3):
            top.append(self.element(self.pick("header", "div"), self.pick("header", "masthead", "top", "banner"), f"<p>{self.some(1, 4)}</p>" + (self.links() if self.often(0.5) else "")))
        if self.often(0.85):
            top.append(self.pick("<nav>{}</nav>", "<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<ul class="nav">{}</ul>').format(self.links()))
        top += [f() for f, share in ((note, 0.3), (self.ad, 0.5), (form, 0.15)) if self.often(share)]
        self.rng.shuffle(top)
        main = self.main()
        main = self.pick(
            f"<article>{main}</article>", f"<article>{main}</article>", f"<main>{main}</main>", f'<div class="content">{main}</div>', f'<div id="main"><div class="post entry">{main}</div></div>',
            f'<section class="story">{main}</section>', f'<div class="article-body">{main}</div>', f'<td class="text">{main}</td>', f"<div>{main}</div>", f"<main><article>{main}</article></main>",
        )
        side = self.element(self.pick("aside", "div"), self.pick("sidebar", "side", "related", "widget"), self.pick("<h3>Related</h3>", "<h4>More</h4>", "") + self.links() + (f"<p>{html.escape(self.sentence())}</p>" if self.often(0.4) else ""))
        after = [f() for f, share in ((self.comments, 0.35), (lambda: side, 0.4), (self.ad, 0.2), (form, 0.2), (note, 0.1)) if self.often(share)]
        foot = self.pick("<footer>{}</footer>", "<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="copyright">{}</div>').format("&copy; " + self.pick(html.escape(self.sentence()), self.some(2, 12)) + (self.links(2, 4) if self.often(0.3) else ""))
        before_main = [side] if self.often(0.15) else []
        head = f"<!DOCTYPE html><html><head><title>{self.some(2, 8)}</title><style>p{{margin:0}}</style></head><body>"
        return head + "".join([*top, *before_main, main, *after]) + (foot if self.often(0.9) else "") + ("</body></html>" if self.often(0.9) else "")

    def labelled(self) -> tuple[list[Block], list[bool]]:
        """Blocks and their labels. Marks around main text are found and taken off again."""
        found = blocks(self.page())
        truth = ["\x01" in b.text for b in found]
        return [Block(b.text.replace("\x01", "").replace("\x02", "") or "-", b.path, b.linked) for b in found], truth


def labelled_pages(sample: list[str], generated: int = GENERATED, seed: int = 11) -> list[tuple[list[Block], list[bool]]]:
    """The sample's pages that say what is main, and generated ones with text of the sample."""
    read = [blocks(p) for p in sample]
    own = [(b, [said_main(x.path) for x in b]) for b in read if any(said_main(x.path) for x in b)]
    lines = [x.text for b in read for x in b if len(x.text) > 40][:LINES]
    words = [w for b in read for x in b for w in x.text.split()][:WORDS]
    layouts = Layouts(np.random.default_rng(seed), lines, words)
    return own + [layouts.labelled() for _ in range(generated)]


def main_texts(pages: list[str | None], model: Labeller, vectors: Vectors) -> list[str]:
    """Main text of each page; pages of like length are read together."""
    read = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k, b in enumerate(read) if b), key=lambda k: len(read[k]))
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and end - begin < 64 and len(read[order[end]]) * (end - begin + 1) <= 20_000:
            end += 1
        group = order[begin:end]
        begin = end
        if len(read[group[-1]]) > STEPS:
            for k in group:
                main = model.page_logits(read[k], vectors) > 0
                out[k] = "\n\n".join(b.text for b, yes in zip(read[k], main, strict=True) if yes)
            continue
        x, mask = padded([vectors.of(read[k]) for k in group])
        main = model.logits(x, mask) > 0
        for c, k in enumerate(group):
            out[k] = "\n\n".join(b.text for b, yes in zip(read[k], main[: len(read[k]), c], strict=True) if yes)
    return out


def sampled(pages: DataFrame) -> list[str]:
    """Html of the sample: hashes of page_id and html first, then their pages, so no task sends pages that aren't in it. Pages
    without page_id are told apart by their html."""
    keyed = pages.where(F.char_length("html") <= SAMPLE_CHARS).withColumn("key", F.xxhash64(F.lit("sample"), F.coalesce(F.col("page_id").cast("string"), F.sha2(F.encode("html", "UTF-8"), 256))))
    keys = [r.key for r in keyed.select("key").orderBy("key").limit(SAMPLE).collect()]
    found = keyed.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("html").alias("html")) if keys else keyed.limit(0)
    return [r.html for r in found.orderBy("key").collect()]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    sample = sampled(pages)
    model = train(labelled_pages(sample))
    sent = pages.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, vectors = sent.value, Vectors()
        for htmls in batches:
            # Some pages at a time, so that the blocks of all aren't held together.
            yield pd.Series([t for k in range(0, len(htmls), 128) for t in main_texts(list(htmls.iloc[k : k + 128]), model, vectors)], dtype="object")

    out = pages.select("page_id", "url", main_text("html").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
