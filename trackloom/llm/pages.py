"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Every block is described by its tag path (hashed tag, class
and id words), its hashed words, both as means of learned vectors, and a few figures. A bidirectional
LSTM in numpy reads the whole sequence, so each block is classified with the context of the document.

The labeller is trained on a bounded sample of the given pages, whose own markup names what is article
and what is not; where it does not, running text, links, repetition and containers decide. Each page is also shown with other container names, with container names removed, and with
foreign side blocks put in, so that words, shape and neighbours count where the markup says little.

Defined results: a null or empty page, and one without text, gives the empty text; a page is read whole;
unclosed scripts, comments and cut-off markup end with the page; formulas and what stands in for embedded
media are text; drawings, buttons and selections are not, up to their end tag, the next block or their
parent's end, nor are templates, up to their end tag or their parent's end; repeated rows give equal texts;
an empty table gives an empty result; without any running text to train on nothing is extracted. Other columns are
kept, and an existing column of the output's name is replaced.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# fixed values: elements that start and end a block, and elements whose content is no text
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# content read as raw text up to the end tag, and never shown
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe")}
# elements without text of the page; a block's start ends all but a template
_HIDDEN = frozenset(("template", "svg", "select", "button"))
# elements whose content stands in for something else and is set apart by spaces
_INSTEAD = frozenset(("noscript", "object", "video", "audio", "canvas"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.DOTALL,
)
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'>]+/\Z")
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_WORD = re.compile(r"\w+")

PATH_SLOTS, WORD_SLOTS = 2048, 2048
PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 16, 8, 6, 20
INPUT = PATH_DIM + WORD_DIM + FIGURES


@dataclass
class Block:
    path: list[str]
    text: str
    linked: int = 0
    main: bool = False


def node_words(tag: str, attributes: str) -> list[str]:
    """The tag and the words of its class, id, role and itemprop."""
    out = [tag]
    if attributes:
        for m in _NAMED.finditer(attributes):
            out += ["." + w.lower() for w in re.findall(r"[A-Za-z]+", m[1] or m[2] or m[3] or "")]
    return out


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order; references are decoded and white space is one space."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    linked = anchor = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block([w for _, words in stack for w in words], text, linked))
            parts.clear()
        linked = 0

    hidden = False
    foreign = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at and not hidden:
            piece = page[at : m.start()]
            parts.append(piece)
            if anchor:
                linked += len(piece)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            if m[1]:
                same = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if not (hidden and (same is None or any(t in _HIDDEN for t, _ in stack[:same]))):
                    flush()
                if same is not None:
                    del stack[same:]
            else:
                while stack and stack[-1][0] in _HIDDEN and stack[-1][0] != "template" and (tag, stack[-1][0]) != ("hr", "select"):
                    stack.pop()
                hidden = hidden and any(t in _HIDDEN for t, _ in stack)
                if not hidden:
                    flush()
                if stack and stack[-1][0] == "p":
                    stack.pop()
                ends = _CLOSES_ITSELF.get(tag)
                while ends and stack and stack[-1][0] in ends:
                    stack.pop()
                if tag != "hr":
                    stack.append((tag, node_words(tag, m[3])))
                foreign = 0
            hidden = hidden and any(t in _HIDDEN for t, _ in stack)
        elif tag == "br":
            if not hidden:
                parts.append(" ")
        elif tag == "a":
            if not hidden:
                anchor = 0 if m[1] else 1
        elif tag in _RAW:
            # only inside svg and math may such an element close itself
            if not m[1] and not (foreign and _closed(m[3])):
                end = _RAW[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag in _INSTEAD:
            if not hidden:
                parts.append(" ")
        elif tag in _HIDDEN or tag == "math":
            own = tag in ("svg", "math")
            if m[1]:
                if own:
                    foreign = max(foreign - 1, 0)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCKS and tag != "template":
                        break
                hidden = hidden and any(t in _HIDDEN for t, _ in stack)
            elif not (own and _closed(m[3])):
                foreign += own
                if tag in _HIDDEN:
                    stack.append((tag, []))
                    hidden = True
    if at < len(page) and not hidden:
        parts.append(page[at:])
    flush()
    return out


def _closed(attributes: str) -> bool:
    """Whether the tag ends in a slash that is not part of an unquoted value."""
    return attributes.endswith("/") and not _UNQUOTED_SLASH.search(attributes)


def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode()) % slots


class Encoder:
    """Blocks to hashed slots and figures; remembers the words' slots."""

    def __init__(self) -> None:
        self.paths: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def path(self, block: Block) -> list[int]:
        get = self.paths
        leaf = "<" + next((w for w in reversed(block.path) if w[0] != "."), "")
        out = []
        for w in [*block.path, leaf]:
            if w not in get:
                if len(get) > 50_000:
                    get.clear()
                get[w] = _slot(w, PATH_SLOTS)
            out.append(get[w])
        return out

    def word(self, block: Block) -> list[int]:
        get = self.words
        found = _WORD.findall(block.text.lower())
        out = [get.get(w) for w in found]
        if None in out:
            if len(get) > 200_000:
                get.clear()
            for i, w in enumerate(found):
                if out[i] is None:
                    out[i] = get[w] = _slot(w, WORD_SLOTS)
        return out or [0]

    def figures(self, block: Block) -> tuple[float, ...]:
        t, n = block.text, len(block.text)
        ends = t.count(".") + t.count("!") + t.count("?")
        return (np.log1p(n) / 8, min(block.linked / n, 1.0), min(ends / n * 20, 2.0), min(t.count(",") / n * 20, 2.0), float(t[-1] in ".!?"), min(sum(map(t.count, "©|·»›")) / n * 20, 2.0))


def _means(table: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
    return np.add.reduceat(table[flat], np.cumsum(sizes) - sizes) / sizes[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def inputs(self, encoder: Encoder, blocks: list[Block]) -> np.ndarray:
        w = self.weights
        return np.concatenate(
            [_means(w["path"], [encoder.path(b) for b in blocks]), _means(w["word"], [encoder.word(b) for b in blocks]), np.array([encoder.figures(b) for b in blocks], np.float32)],
            axis=1,
        ).astype(np.float32)

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Forward pass over padded sequences (time, batch, input); ``keep`` collects what training needs."""
        w = self.weights
        states = []
        for side in ("f", "b"):
            steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
            c = np.zeros_like(h)
            every = np.zeros((len(x), x.shape[1], HIDDEN), np.float32)
            trace = []
            z_in = x @ w["x" + side] + w["o" + side]
            for t in steps:
                z = z_in[t] + h @ w["h" + side]
                i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
                g = np.tanh(z[:, 3 * HIDDEN :])
                on = mask[t][:, None]
                c_new = (f * c + i * g) * on + c * (1 - on)
                s = np.tanh(c_new)
                h_new = (o * s) * on + h * (1 - on)
                if keep is not None:
                    trace.append((t, h, c, i, f, o, g, s, on))
                h, c = h_new, c_new
                every[t] = h
            states.append(every)
            if keep is not None:
                keep.append((side, trace))
        both = np.concatenate(states, axis=2)
        if keep is not None:
            keep.append(both)
        return both @ w["out"] + w["bias"]

    def label(self, encoder: Encoder, pages: list[list[Block]], cells: int = 60_000) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= cells:
                end += 1
            own = order[at:end]
            flat = self.inputs(encoder, [b for i in own for b in pages[i]])
            x, mask, where = _pad(flat, [len(pages[i]) for i in own])
            y = self.logits(x, mask) > 0
            for k, i in enumerate(own):
                out[i] = y[: where[k], k]
            at = end
        return out

    def text(self, blocks: list[Block], main: np.ndarray) -> str:
        return " ".join(b.text for b, m in zip(blocks, main) if m)


def _pad(flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    x = np.zeros((max(sizes), len(sizes), flat.shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    at = 0
    for k, n in enumerate(sizes):
        x[:n, k], mask[:n, k] = flat[at : at + n], 1
        at += n
    return x, mask, sizes


# names under which containers are shown in training; plain text on purpose
_MAIN = ["article", "main", "main article", "div .content", "div .post .content", "div .entry .content", "section .article .body", "div .story", "div .main", "article .post", "div .text"]
_SIDE = {
    "menu": ["nav", "div .menu", "ul .nav", "header nav", "div .navbar", "div .navigation", "div .breadcrumbs"],
    "head": ["header", "div .header", "div .masthead", "div .top"],
    "foot": ["footer", "div .footer", "div .copyright", "div .bottom"],
    "side": ["aside", "div .sidebar", "aside .sidebar", "div .related", "div .widget", "section .related"],
    "notice": ["div .cookie .notice", "div .banner", "div .consent", "div .alert", "div .notice"],
    "ad": ["div .ad", "div .ads", "aside .ad", "div .advert", "div .advertisement", "div .sponsored", "div .promo"],
    "form": ["form", "div .newsletter form", "div .subscribe", "form .search", "div .login form"],
    "talk": ["div .comments", "section .comments", "div .comments div .comment", "div .comment", "ol .comments li .comment", "div .discussion"],
}
_OUTSIDE = frozenset("nav header footer aside form menu".split()) | frozenset(
    f".{w}" for w in "menu nav navbar navigation breadcrumbs header footer sidebar related widget cookie banner consent ad ads advert advertisement sponsored promo comments comment newsletter subscribe login search share social".split()
)
_INSIDE = frozenset(("article", "main"))


def named_main(block: Block) -> bool:
    """Whether the markup says that the block is main text: inside an article, and in no side container."""
    return any(w in _INSIDE for w in block.path) and not any(w in _OUTSIDE for w in block.path)


_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption".split())
_SENTENCE = re.compile(r"[.!?。！？…](?:\s|$)")


def _container(block: Block) -> tuple[str, ...]:
    """Path of the element that holds a block of text."""
    end = len(block.path)
    while end and block.path[end - 1].startswith("."):
        end -= 1
    return tuple(block.path[: end - 1] if end and block.path[end - 1] in _TEXTUAL else block.path)


def placed_main(blocks: list[Block], repeated: frozenset[str] = frozenset()) -> list[bool]:
    """Main blocks by layout, for pages whose markup names none.

    The container with most running text wins: text outside links, in sentences, in no side container and
    not ``repeated`` on other pages. Its blocks that are not mostly links are main, repeated ones as well.
    """
    weight: dict[tuple[str, ...], int] = {}
    plain = []
    for b in blocks:
        ok = not any(w in _OUTSIDE for w in b.path) and 2 * b.linked < len(b.text)
        plain.append(ok)
        if ok and b.text not in repeated and _SENTENCE.search(b.text):
            at = _container(b)
            weight[at] = weight.get(at, 0) + len(b.text) - b.linked
    if not weight:
        return [False] * len(blocks)
    best = max(weight, key=lambda at: (weight[at], len(at), at))
    return [ok and tuple(b.path[: len(best)]) == best for ok, b in zip(plain, blocks)]


def _vary(blocks: list[Block], rng: np.random.Generator, foreign: list[str]) -> list[Block]:
    """Another rendering of the page: containers renamed or hidden, side blocks put in."""
    hide = rng.random() < 0.15
    main = str(rng.choice(_MAIN)).split()
    names = {k: str(rng.choice(v)).split() for k, v in _SIDE.items()}
    out: list[Block] = []
    for b in blocks:
        leaf = [w for w in b.path if w not in _INSIDE][-1:]
        base = ["html", "body"]
        if b.main:
            path = [*base, *([] if hide else main), *leaf]
        else:
            kind = "menu" if any(w in ("nav", ".menu") for w in b.path) else "foot" if "footer" in b.path else "ad" if any(w.startswith(".ad") for w in b.path) else "side"
            path = [*base, *([] if hide and rng.random() < 0.5 else names[kind]), *[w for w in b.path if w in ("ul", "li", "p", "ol")]]
        out.append(Block(path, b.text, b.linked, b.main))
    for kind in _SIDE:
        if foreign and rng.random() < 0.35:
            n = int(rng.integers(1, 5))
            inside = kind in ("ad", "side", "form", "talk") and rng.random() < 0.4
            top = [*["html", "body"], *(main if inside else []), *names[kind]]
            new = [Block([*top, *([["p"], ["li"], [], ["div"]][int(rng.integers(4))])], foreign[int(rng.integers(len(foreign)))]) for _ in range(n)]
            spots = [i for i, b in enumerate(out) if b.main]
            if inside and spots:
                at = int(rng.choice(spots))
            else:
                at = len(out) if kind in ("foot", "talk") else (0 if kind in ("menu", "head", "notice") else int(rng.choice([0, len(out)])))
            out[at:at] = new
    return out


def train(pages: list[list[Block]], steps: int = 300, batch: int = 24, seed: int = 5) -> Labeller:
    """Adam on the mean logistic loss of the blocks, by back-propagation through both directions."""
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    w: dict[str, np.ndarray] = {"path": rng.normal(0, 0.3, (PATH_SLOTS, PATH_DIM)).astype(np.float32), "word": rng.normal(0, 0.1, (WORD_SLOTS, WORD_DIM)).astype(np.float32)}
    for side in "fb":
        w["x" + side], w["h" + side], w["o" + side] = normal(INPUT, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
        w["o" + side][HIDDEN : 2 * HIDDEN] = 1
    w["out"], w["bias"] = normal(2 * HIDDEN, 1)[:, 0], np.zeros(1, np.float32)
    model = Labeller(w)
    seen = Counter(t for p in pages for t in {b.text for b in p})
    repeated = frozenset(t for t, n in seen.items() if n > max(2, len(pages) // 20))
    for p in pages:
        named = [named_main(b) for b in p]
        for b, main in zip(p, named if any(named) else placed_main(p, repeated)):
            b.main = main
    pages = [p for p in pages if p]
    if not pages or not any(b.main for p in pages for b in p):
        model.weights["out"] *= 0
        model.weights["bias"] -= 10
        return model
    foreign = [b.text for p in pages for b in p if len(b.text) < 400][:5000]
    encoder = Encoder()
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        chosen = [pages[i] for i in rng.integers(0, len(pages), batch)]
        chosen = [p if rng.random() < 0.4 else _vary(p, rng, foreign) for p in chosen]
        flat_blocks = [b for p in chosen for b in p]
        paths, word_rows = [encoder.path(b) for b in flat_blocks], [encoder.word(b) for b in flat_blocks]
        x, mask, sizes = _pad(model.inputs(encoder, flat_blocks), [len(p) for p in chosen])
        y = np.zeros(mask.shape, np.float32)
        for k, p in enumerate(chosen):
            y[: len(p), k] = [b.main for b in p]
        keep: list = []
        z = model.logits(x, mask, keep)
        d_z = (_sigmoid(z) - y) * mask / mask.sum()
        both = keep[2]
        grad = {"out": np.einsum("tb,tbh->h", d_z, both), "bias": np.array([d_z.sum()], np.float32)}
        d_both = d_z[:, :, None] * w["out"]
        d_x = np.zeros_like(x)
        for n, (side, trace) in enumerate(keep[:2]):
            d_h_out = d_both[:, :, n * HIDDEN : (n + 1) * HIDDEN]
            d_h = np.zeros((len(chosen), HIDDEN), np.float32)
            d_c = np.zeros_like(d_h)
            d_zs = np.zeros((len(x), len(chosen), 4 * HIDDEN), np.float32)
            hs = np.zeros((len(x), len(chosen), HIDDEN), np.float32)
            for t, h, c, i, f, o, g, sc, on in reversed(trace):
                total = d_h + d_h_out[t]
                live = total * on
                cell = d_c * on + live * o * (1 - sc * sc)
                d_zs[t] = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), live * sc * o * (1 - o), cell * i * (1 - g * g)], axis=1)
                hs[t] = h
                d_h = d_zs[t] @ w["h" + side].T + total * (1 - on)
                d_c = cell * f + d_c * (1 - on)
            grad["x" + side] = np.einsum("tbi,tbz->iz", x, d_zs)
            grad["h" + side] = np.einsum("tbh,tbz->hz", hs, d_zs)
            grad["o" + side] = d_zs.sum((0, 1))
            d_x += d_zs @ w["x" + side].T
        flat = np.concatenate([d_x[:n, k] for k, n in enumerate(sizes)])
        for name, rows, a, z_ in (("path", paths, 0, PATH_DIM), ("word", word_rows, PATH_DIM, PATH_DIM + WORD_DIM)):
            count = np.fromiter(map(len, rows), np.int64, len(rows))
            g_t = np.zeros_like(w[name])
            np.add.at(g_t, np.fromiter((i for r in rows for i in r), np.int64, int(count.sum())), np.repeat(flat[:, a:z_] / count[:, None], count, axis=0))
            grad[name] = g_t
        for k, g_ in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g_
            s[k] = 0.999 * s[k] + 0.001 * g_ * g_
            w[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return model


def fit_labeller(pages: DataFrame, max_pages: int = 300, max_bytes: int = 100_000) -> Labeller:
    """Train on at most ``max_pages`` different pages of at most ``max_bytes`` bytes, those of least hash.

    Only hashes are shuffled to choose them; their rows (at most ``max_pages`` of 8 bytes) are broadcast.
    """
    fit = pages.where(F.octet_length("html") <= max_bytes).select("html", F.xxhash64("html").alias("_h"))
    chosen = fit.select("_h").distinct().orderBy("_h").limit(max_pages)
    rows = fit.join(F.broadcast(chosen), "_h").groupBy("_h").agg(F.min("html").alias("html")).orderBy("_h").toArrow()["html"].to_pylist()
    return train([leaf_blocks(h) for h in rows])


def main_text(model: Labeller, page: Column | str = "html") -> Column:
    """The blocks of main text of each whole page, joined by one space."""

    def run(rows: pa.Array) -> pa.Array:
        encoder, out = Encoder(), []
        for a in range(0, len(rows), 256):
            pages = [leaf_blocks(h) for h in rows.slice(a, 256).to_pylist()]
            out += [model.text(p, m) for p, m in zip(pages, model.label(encoder, pages))]
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(F.col(page) if isinstance(page, str) else page)
