"""Main text of web pages: a bidirectional LSTM labels every block with the whole page in view."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import WHITE_TABLE, U64, batches, blocks, text_buffers, words

#: Elements that end a block and stand in the tag path (fixed names of the public HTML standard).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th "
    "thead title tr ul button label".split()
)
#: A start tag of these ends an open one of the same set, up to the element that holds them.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"ul", "ol", "table", "dl", "select", "menu"}
#: Any of these ends an open paragraph.
_ENDS_P = BLOCK_TAGS - {"option", "label", "button", "td", "th", "tr", "head", "html", "body", "title"}
_EMPTY = {"hr", "br", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track"}
#: Start tags that can stand in a head; any other ends it.
_IN_HEAD = {"html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "template", "script", "style", "noscript", "noframes"}
#: Start tags that end an open drawing, but within the elements of it that hold HTML.
_ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
) | (BLOCK_TAGS - {"title"})
_SVG_HTML = {"foreignobject", "desc", "title"}

#: What stands in a tag after its name: a quote opens a value only after "=", and a quoted value may hold anything.
_INSIDE = r"(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<(script|style|noscript|iframe|textarea)(?=[\s/>]){_INSIDE}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_INSIDE})>?",
    re.S | re.I,
)
_LAST = {name: re.compile(rf".*</{name}(?=[\s/>])", re.S | re.I) for name in ("template", "title")}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

PATH, WORDS, NUMBERS = 96, 32, 10
INPUT = PATH + WORDS + NUMBERS


class Path:
    """Block elements from the root, each followed by its class, id and role words: what the labeller reads of them.

    A path is made from the one above it, so that deep nesting costs no more than its own tags.
    """

    __slots__ = ("all", "tail", "size", "_bins")

    def __init__(self, above: "Path | None", words_: tuple[str, ...]) -> None:
        new = {zlib.crc32(x.encode()) % PATH for x in words_}
        self.all = frozenset(new) if above is None else above.all if new <= above.all else above.all | new
        self.tail = ((above.tail if above else ()) + words_)[-3:]
        self.size = (above.size if above else 0) + len(words_)
        self._bins: tuple[int, ...] | None = None

    @property
    def bins(self) -> tuple[int, ...]:
        if self._bins is None:
            self._bins = tuple(sorted(self.all | {zlib.crc32(("last " + x).encode()) % PATH for x in self.tail[-2:]}))
        return self._bins


_ROOT = Path(None, ())


class _Stack:
    """Open elements, with the places of each name at hand: no search through them, however deep they are."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.paths: list[Path] = [_ROOT]
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, words_: tuple[str, ...] = ()) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.paths.append(Path(self.paths[-1], (name, *words_)))

    def cut(self, at: int) -> None:
        while len(self.names) > at:
            self.places[self.names.pop()].pop()
            self.paths.pop()

    def last(self, names) -> int:
        """The place of the innermost open element of these names, -1 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    @property
    def top(self) -> str | None:
        return self.names[-1] if self.names else None


def leaf_blocks(page: str) -> list[tuple[str, Path, int]]:
    """Blocks of a page in order: text with references decoded and white space made single, tag path, characters inside links.

    Scripts,
    styles, drawings, templates, comments and the head give no block. Only the raw-text elements run to the end
    of the page where their end tag is missing: a drawing ends at the first tag that cannot stand in it, a head
    at the first tag or text, and a template that is never closed is read. Broken markup is read as far as it goes.
    """
    out: list[tuple[str, Path, int]] = []
    stack = _Stack()
    buffer: list[str] = []
    linked = in_link = at = templates = 0
    svg: list[str] = []
    ends: dict[str, int] = {}

    def last_end(name: str) -> int:
        if name not in ends:
            found = _LAST[name].match(page)
            ends[name] = found.end() if found else -1
        return ends[name]

    def leave_head() -> None:
        at_head = stack.last(("head",))
        if at_head >= 0:
            stack.cut(at_head)
            stack.push("body")

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text and stack.last(("head",)) < 0:
                out.append((text, stack.paths[-1], linked))
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at and not svg and not templates:
            if stack.top == "head" and not page[at : m.start()].isspace():
                leave_head()
            buffer.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "template":
            if m[2]:
                templates = max(0, templates - 1) if at < last_end(name) else 0
            elif at < last_end(name):
                templates += 1
            continue
        if templates:
            continue
        if svg:
            if m[2] and name in svg:
                del svg[len(svg) - 1 - svg[::-1].index(name) :]
                continue
            if name not in _ENDS_SVG and not (m[2] and name == "a") or not m[2] and not _SVG_HTML.isdisjoint(svg):
                if not m[2] and name not in _EMPTY and not m[4].endswith("/"):
                    svg.append(name)
                continue
            svg.clear()
        if stack.top == "title" and name != "title" and at < last_end("title"):
            continue  # a title holds text alone
        if not m[2] and name not in _IN_HEAD and name != "body":
            leave_head()
        if name == "svg":
            if not m[2] and not m[4].endswith("/"):
                svg.append(name)
        elif name == "a":
            in_link = 0 if m[2] else 1
        elif name == "br":
            buffer.append(" ")
        elif name in BLOCK_TAGS:
            flush()
            in_link = 0
            if m[2]:
                k = stack.last((name,))
                if k >= 0:
                    stack.cut(k)
                continue
            if name in _ENDS_P and stack.top == "p":
                stack.cut(len(stack.names) - 1)
            if name == "body":
                while stack.top in ("head", "title"):
                    stack.cut(len(stack.names) - 1)
                if stack.last(("body",)) >= 0:
                    continue
            k = stack.last(_CLOSES.get(name, ()))
            if k > stack.last(_HOLDS):
                stack.cut(k)
            if name not in _EMPTY:
                names = tuple(w for found in _NAMES.finditer(m[4] or "") for w in re.findall(r"[a-z]+", (found[1] or found[2] or found[3] or "").lower()))
                stack.push(name, names)
    if at < len(page) and not svg and not templates:
        if stack.top == "head" and not page[at:].isspace():
            leave_head()
        buffer.append(page[at:])
    flush()
    return out


def features(pages: list[list[tuple[str, Path, int]]]) -> np.ndarray:
    """One row a block over all pages: hashed tag path, hashed words, and a few numbers, by page order."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return out
    bins = [path.bins for _, path, _ in flat]
    row = np.repeat(np.arange(len(flat)), [len(b) for b in bins])
    out[row, np.array([x for b in bins for x in b], np.int64)] = 1
    lo = 0
    for block in blocks(pa.array([t for t, _, _ in flat])):
        n = len(block.rows)
        _, _, hashes, first = words(block, WHITE_TABLE)
        count = np.diff(first)
        doc = np.repeat(np.arange(n), count)
        bag = np.bincount(doc * WORDS + (hashes >> U64(59)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        out[lo : lo + n, PATH : PATH + WORDS] = np.minimum(np.log1p(bag), 3) / 3
        out[lo : lo + n, PATH + WORDS + 1] = np.log1p(count) / 5
        size = np.diff(block.offsets)
        owner = np.repeat(np.arange(n), size)
        stops = np.bincount(owner, (block.data == 46) | (block.data == 44), n)
        out[lo : lo + n, PATH + WORDS + 3] = stops / np.maximum(count, 1)
        out[lo : lo + n, PATH + WORDS + 4] = np.bincount(owner, (block.data >= 48) & (block.data < 58), n) / np.maximum(size, 1)
        lo += n
    x = out[:, PATH + WORDS :]
    lengths = np.array([len(t) for t, _, _ in flat])
    x[:, 0] = np.log1p(lengths) / 8
    x[:, 2] = np.minimum(1, np.array([a for _, _, a in flat]) / np.maximum(lengths, 1))
    sizes = np.array([len(p) for p in pages])
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[:, 5] = place / np.maximum(np.repeat(sizes, sizes), 1)
    x[:, 6] = place == 0
    x[:, 7] = [any(t in ("h1", "h2", "h3", "h4") for t in p.tail) for _, p, _ in flat]
    x[:, 8] = np.minimum([p.size for _, p, _ in flat], 12) / 12
    x[:, 9] = 1
    return out


class BiLSTM:
    """Two LSTM passes over a sequence of blocks and a logistic over both, in numpy, with its own training."""

    def __init__(self, hidden: int = 24, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["W" + d] = (rng.normal(size=(INPUT, 4 * hidden)) / np.sqrt(INPUT / 6)).astype(np.float32)
            self.p["U" + d] = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["V"] = (rng.normal(size=(2 * hidden, 1)) / np.sqrt(hidden)).astype(np.float32)
        self.p["v"] = np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: steps by pages by numbers. The state stays where a page has no block."""
        steps, n, _ = x.shape
        h, s = np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32)
        z_in = x @ self.p["W" + d] + self.p["c" + d]
        out, held = np.zeros((steps, n, self.hidden), np.float32), []
        k = self.hidden
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + h @ self.p["U" + d]
            g = 1 / (1 + np.exp(-z[:, : 3 * k]))
            i, f, o, u = g[:, :k], g[:, k : 2 * k], g[:, 2 * k :], np.tanh(z[:, 3 * k :])
            new = f * s + i * u
            th = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                held.append((t, h, s, i, f, o, u, th, m))
            s = np.where(m, new, s)
            h = np.where(m, o * th, h)
            out[t] = h
        return out, held

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        fwd, hf = self._pass(x, mask, "f", keep)
        bwd, hb = self._pass(x, mask, "b", keep)
        both = np.concatenate([fwd, bwd], 2)
        return (both @ self.p["V"])[..., 0] + self.p["v"], both, hf, hb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        z, both, hf, hb = self.forward(x, mask, keep=True)
        p = 1 / (1 + np.exp(-z))
        total = max(1, mask.sum())
        loss = -np.sum(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))) / total
        dz = ((p - y) * mask / total)[..., None].astype(np.float32)
        grad = {"V": np.einsum("tnh,tno->ho", both, dz), "v": dz.sum((0, 1))}
        dboth = dz @ self.p["V"].T
        k = self.hidden
        for d, held, dout in (("f", hf, dboth[..., :k]), ("b", hb, dboth[..., k:])):
            gW, gU, gc = (np.zeros_like(self.p[a + d]) for a in "WUc")
            dh, ds = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
            for t, h0, s0, i, f, o, u, th, m in reversed(held):
                dh = dh + dout[t]
                own = dh * m
                do, dnew = own * th, own * o * (1 - th * th) + ds * m
                di, df, du = dnew * u, dnew * s0, dnew * i
                dzt = np.concatenate([di * i * (1 - i), df * f * (1 - f), do * o * (1 - o), du * (1 - u * u)], 1)
                gW += x[t].T @ dzt
                gU += h0.T @ dzt
                gc += dzt.sum(0)
                dh = dh * ~m + dzt @ self.p["U" + d].T
                ds = ds * ~m + dnew * f
            grad |= {"W" + d: gW, "U" + d: gU, "c" + d: gc}
        return float(loss), grad

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 5) -> float:
        rng, moment, loss, step = np.random.default_rng(seed), {}, 0.0, 0
        for epoch in range(epochs):
            order = np.argsort(np.array([len(p) for p in pages]) + rng.uniform(0, 6, len(pages)), kind="stable")
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for g in rng.permutation(len(groups)):
                x, mask = pad([pages[i] for i in groups[g]])
                y = pad([labels[i][:, None].astype(np.float32) for i in groups[g]])[0][..., 0]
                loss, grad = self.gradients(x, mask, y)
                step += 1
                for name, value in grad.items():  # Adam
                    a, b = moment.get(name, (0, 0))
                    a, b = 0.9 * a + 0.1 * value, 0.99 * b + 0.01 * value * value
                    moment[name] = (a, b)
                    self.p[name] = (self.p[name] - rate * 0.5 ** (3 * epoch / epochs) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def label(self, pages: list[np.ndarray], at_once: int = 20_000) -> list[np.ndarray]:
        """True for every block of the main text. Pages of like length run together, some `at_once` blocks at a time."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list = [np.zeros(0, bool)] * len(pages)
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * len(pages[order[hi]]) <= at_once and hi - lo < 512:
                hi += 1
            own = order[lo:hi]
            if len(pages[own[-1]]):
                x, mask = pad([pages[i] for i in own])
                z = self.forward(x, mask)[0]
                for j, i in enumerate(own):
                    out[i] = z[: len(pages[i]), j] > 0
            lo = hi
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


@dataclass
class _Maker:
    """Made-up pages with a label for every block, in many layouts: what the labeller learns from."""

    rng: np.random.Generator

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def sentence(self, n: int) -> str:
        letters = self.pick("etaoinshrdlu", "enisratdhulcg", "esaitnrulodcm", "eaosrnidlctu")
        made = ["".join(self.rng.choice(list(letters), int(self.rng.integers(1, 10)))) for _ in range(max(1, n))]
        return " ".join(made).capitalize() + self.pick(".", ".", ".", "", "!")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence(int(self.rng.integers(3, 18))) for _ in range(int(self.rng.integers(low, high + 1))))

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{self.sentence(int(self.rng.integers(1, 4)))}</a></{tag}>' for _ in range(n))

    def wrap(self, names: str, tags: str, body: str) -> str:
        tag = self.pick(*tags.split())
        name = self.pick(*names.split())
        mark = self.pick(f' class="{name}"', f' id="{name}"', f' class="{self.pick("box", "wrap", "block")} {name}"', "" if tag not in ("div", "section", "p") else f' class="{name}"')
        return f"<{tag}{mark}>{body}</{tag}>"

    def clutter(self) -> str:
        n = int(self.rng.integers(2, 8))
        kind = int(self.rng.integers(12))
        if kind == 0:
            return self.wrap("nav menu navbar navigation topnav", "nav nav div", f"<ul>{self.links(n)}</ul>")
        if kind == 1:
            return self.wrap("header masthead top site-header", "header header div", f"<p>{self.sentence(3)}</p>" + self.links(n, "span"))
        if kind == 2:
            return self.wrap("footer site-footer bottom copyright", "footer footer div", f"{self.pick('&copy; ', '')}{self.sentence(5)} &middot; {self.sentence(3)}")
        if kind == 3:
            return self.wrap("sidebar aside side widget rail", "aside aside div", f"<h3>{self.sentence(2)}</h3><ul>{self.links(n)}</ul>" + (f"<p>{self.prose(1, 2)}</p>" if self.chance(0.5) else ""))
        if kind == 4:
            return self.wrap("ad ads advert advertisement sponsor sponsored promo banner", "div div aside section", f"{self.prose(1, 2)}")
        if kind == 5:
            return self.wrap("cookie cookies notice consent gdpr alert banner popup modal", "div div section aside", f"<p>{self.prose(1, 2)}</p>" + self.pick("", "<button>Ok</button>", f'<a href="/p">{self.sentence(2)}</a>'))
        if kind == 6:
            return self.pick(f"<form><label>{self.sentence(2)}</label><input name=q><button>{self.sentence(1)}</button></form>", self.wrap("newsletter subscribe signup search login", "div section form", f"<form><p>{self.sentence(8)}</p><input><button>{self.sentence(1)}</button></form>"))
        if kind in (7, 8):
            inner = "".join(self.pick(f'<div class="comment"><p>{self.prose(1, 4)}</p></div>', f"<li><b>{self.sentence(1)}</b><p>{self.prose(1, 3)}</p></li>", f"<p>{self.prose(1, 3)}</p>", f'<article class="comment"><p>{self.prose(1, 3)}</p></article>') for _ in range(int(self.rng.integers(1, 6))))
            return self.wrap("comments comment-list replies responses discussion disqus reader-comments", "section div div ol ul", f"<h2>{self.sentence(2)}</h2>" * self.chance(0.6) + inner)
        if kind == 9:
            return self.wrap("related recommended more trending popular read-next", "div section aside ul", f"<h3>{self.sentence(2)}</h3>" + self.links(n, self.pick("li", "p", "div")))
        if kind == 10:
            return self.wrap("breadcrumb breadcrumbs share social tags pagination byline meta", "div ul nav p", self.links(n, "span"))
        return self.wrap("warning disclaimer legal info notice message", "div p section", self.prose(1, 2))

    def article(self) -> str:
        parts = [f"<h1>{self.sentence(int(self.rng.integers(2, 12)))}</h1>"] if self.chance(0.9) else []
        for _ in range(int(self.pick(1, 2, 3, 4, 6, 9, 14, 25))):
            text = self.prose(1, int(self.pick(1, 2, 4, 8)))
            parts.append(self.pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <a href=/y>{self.sentence(2)}</a> {text}</p>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li><li>{self.sentence(4)}</li></ul>", f"<h2>{self.sentence(3)}</h2><p>{text}</p>", f"<pre>{text}</pre>", f"<div>{text}</div>", f"<table><tr><td>{self.sentence(2)}</td><td>{self.sentence(3)}</td></tr></table>", f"<figure><figcaption>{self.sentence(5)}</figcaption></figure>"))
        return "".join(parts)

    def page(self) -> tuple[list, np.ndarray]:
        """Blocks of one page, and which of them are main text."""
        body = self.article()
        tag, names = self.pick(("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="post entry article-body"'), ("section", ' class="story"'))
        inside = f'<{tag}{names}><i data-main="1">{body}</i data-main>'
        if self.chance(0.25):  # clutter within the article's element
            at = self.rng.integers(2)
            inside = f"<{tag}{names}>" + (self.clutter() if at else "") + f'<i data-main="1">{body}</i data-main>' + ("" if at else self.clutter())
        inside += f"</{tag}>"
        if self.chance(0.3):
            inside = f"<{self.pick('main', 'div')}>{inside}{self.clutter() if self.chance(0.5) else ''}</main></div>"
        before = "".join(self.clutter() for _ in range(int(self.rng.integers(0, 4))))
        after = "".join(self.clutter() for _ in range(int(self.rng.integers(0, 4))))
        return _marked(f"<!DOCTYPE html><html><head><title>t</title></head><body>{before}{inside}{after}</body></html>")


def _marked(page: str) -> tuple[list, np.ndarray]:
    """The page's blocks, and their labels from a reading in which the text between the marks carries a sign."""
    a, b = page.index('<i data-main="1">'), page.index("</i data-main>")
    signed = page[:a] + re.sub(r">([^<]+)", lambda m: ">" + m[1].replace(" ", " \x03"), page[a : b + 1]).replace(">", ">\x03") + page[b + 1 :]
    labels = np.array(["\x03" in t for t, _, _ in leaf_blocks(signed) if t.replace("\x03", "").strip()])
    return leaf_blocks(page), labels


@lru_cache(maxsize=2)
def train(n_pages: int = 900, seed: int = 11) -> BiLSTM:
    """Fits the labeller on `n_pages` made-up pages, labels known by the way they are made; a few seconds on the driver."""
    maker = _Maker(np.random.default_rng(seed))
    made = [maker.page() for _ in range(n_pages)]
    made = [(blocks_, y) for blocks_, y in made if len(blocks_) == len(y) and len(y)]
    model = BiLSTM()
    model.fit([features([b]) for b, _ in made], [y for _, y in made])
    return model


def extract_main_text(pages: DataFrame, model: BiLSTM | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars of every page: its main blocks in page order, joined by two newlines.

    In a block, character references are decoded, white space becomes one space, and both ends are trimmed.
    Which blocks are main text the labeller says, from the tag paths, words and numbers of all blocks of the
    page. A null or empty page, or one without main text, gives an empty text; null ids and urls, repeated
    rows and other columns make no difference; an empty table gives no rows. One pass, no shuffle.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or train())

    def extract(it) -> Iterator[pa.RecordBatch]:
        for ids, urls, sources in batches(it, ["page_id", "url", "html"]):
            data, offsets = text_buffers(sources)
            at = 0
            while at < len(ids):
                end = min(len(ids), max(at + 1, int(np.searchsorted(offsets, offsets[at] + (2 << 20), side="right")) - 1))
                parsed = [leaf_blocks(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[at:end], offsets[at + 1 : end + 1])]
                rows = features(parsed)
                cuts = np.cumsum([0, *map(len, parsed)])
                main = held.value.label([rows[a:b] for a, b in zip(cuts, cuts[1:])])
                texts = ["\n\n".join([t for (t, _, _), keep in zip(p, m) if keep]) for p, m in zip(parsed, main)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), urls.slice(at, end - at), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                at = end

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
