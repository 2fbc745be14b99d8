"""Main text of web pages: a recurrent labeller reads a page's blocks in both directions and classifies each of them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm import texts
from gradeline.llm.ranks import lowest_hashed

# Possessive, and outside quotes a tag ends before the next "<" at the latest: no start of a tag is read far or twice.
_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^<>"']++)*+)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

_IS_STOP = np.zeros(256, bool)
_IS_STOP[list(b".,;:!?")] = True

#: Fixed values of HTML: elements without content, elements whose content is not markup and that run to the end of a page if
#: unclosed, elements that hold no text of a page but must be closed to be left out, elements inside a line of text (formulas
#: included), and elements with a block of their own that stand inside a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
CLOSED = frozenset("svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub "
                   "sup time tt u var wbr math annotation menclose mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub "
                   "msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
APART = frozenset("button noscript object".split())
CLOSED_BY_NEXT = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th"}

#: Elements and parts of class names that mark what is not the article, for the labels the network learns from.
OTHER_TAGS = frozenset("nav header footer aside form menu dialog figure button".split())
OTHER_NAMES = re.compile(r"\b(ad|ads|advert\w*|banner|comments?|cookie\w*|footer|header|menu|modal|nav\w*|newsletter|notice\w*|popup|promo\w*|related|"
                         r"reply|replies|share|sidebar|social|sponsor\w*|subscribe|toolbar|widget)\b", re.I)
MAIN_TAGS = frozenset("article main".split())


@dataclass(frozen=True)
class Settings:
    """Sizes of the network and of its training: at most ``sample`` pages of at most ``longest`` characters are learnt from."""

    path_size: int = 96
    word_size: int = 32
    hidden: int = 16
    sample: int = 300
    longest: int = 40_000
    epochs: int = 12
    batch: int = 16
    rate: float = 0.01
    seed: int = 3


class Path:
    """The open block-level elements above a text, linked upwards: an element's tag and names, and what holds for it and all above."""

    __slots__ = ("above", "names", "depth", "other", "main")

    def __init__(self, above: Path | None, names: tuple[str, ...]):
        self.above, self.names = above, names
        self.depth = len(names) + (above.depth if above else 0)
        self.other = bool(above and above.other) or any(n in OTHER_TAGS or (n[0] == "." and OTHER_NAMES.search(n[1:])) for n in names)
        self.main = bool(above and above.main) or any(n in MAIN_TAGS for n in names)

    @classmethod
    def of(cls, *names: str) -> Path:
        return cls(None, names)

    def chain(self, known: dict[Path, object]) -> list[Path]:
        """This path and those above it as far as they are not ``known``, the highest first."""
        found, at = [], self
        while at is not None and at not in known:
            found.append(at)
            at = at.above
        return found[::-1]


@dataclass
class Block:
    """A stretch of text between block-level tags: the open elements around it, the names they carry, and its share in links."""

    text: str
    path: Path | None
    linked: float


class _Open:
    """Open elements of a page with the path down to each; every step takes the time of what it closes."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, Path | None]] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []  # places of elements with a block of their own
        self.links = 0

    @property
    def top(self) -> str:
        return self.tags[-1][0] if self.tags else ""

    @property
    def path(self) -> Path | None:
        return self.tags[-1][1] if self.tags else None

    def push(self, tag: str, path: Path | None) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.solid.append(len(self.tags))
        self.links += tag == "a"
        self.tags.append((tag, path))

    def pop(self) -> None:
        tag, _ = self.tags.pop()
        self.places[tag].pop()
        if tag not in INLINE:
            self.solid.pop()
        self.links -= tag == "a"

    def end(self, tag: str) -> None:
        """Close the last such element and all inside it; an inline one only inside its block."""
        at = self.places.get(tag)
        if at and (tag not in INLINE or not self.solid or at[-1] > self.solid[-1]):
            for _ in range(len(self.tags) - at[-1]):
                self.pop()


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order. Tags may be unclosed, crossed or upper case; comments, raw elements, drawings and
    choices hold no text; an unclosed drawing or choice ends with its tag, an option with the next tag. A "<" outside quotes ends a
    tag that was not closed before it, which then counts as text. Time and memory grow with the page, however deep it nests."""
    opened = _Open()
    found: list[Block] = []
    parts: list[str] = []
    linked = [0, 0]  # characters inside links, and all of the open block
    at, size = 0, len(page)

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, opened.path, linked[0] / max(1, linked[1])))
            parts.clear()
            linked[:] = 0, 0

    def add(piece: str) -> None:
        if piece:
            parts.append(html.unescape(piece) if "&" in piece else piece)
            linked[1] += len(piece)
            linked[0] += len(piece) if opened.links else 0

    while at < size:
        mark = _MARK.search(page, at)
        if mark is None:
            add(page[at:])
            break
        add(page[at:mark.start()])
        at = mark.end()
        tag = (mark.group(2) or "").lower()
        if not tag:
            if mark.group().startswith("<![CDATA["):
                add(mark.group()[9:].removesuffix("]]>"))
            continue
        if tag not in INLINE:
            close()
        if mark.group(1):
            opened.end(tag)
            continue
        if tag in VOID:
            continue
        if tag in RAW and not mark.group(3).endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^<>]*+>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in CLOSED:
            end = None if mark.group(3).endswith("/") else re.compile(rf"<(/?){tag}\b[^<>]*+>", re.I).search(page, at)
            at = end.end() if end and end.group(1) else at  # the end after another start is not this one's
            continue
        if tag == "option":
            after = page.find("<", at)
            at = size if after < 0 else after
            continue
        path = opened.path
        if tag not in INLINE:
            while opened.top in INLINE:  # an inline element left open ends with its block
                opened.pop()
            if opened.top in CLOSED_BY_NEXT.get(tag, "").split() or (opened.top == "p" and tag not in APART):
                opened.pop()
            names = [f".{x.lower()}" for m in _NAMES.finditer(mark.group(3)) for x in (m.group(1) or m.group(2) or m.group(3) or "").split()]
            path = Path(opened.path, (tag, *names))
        opened.push(tag, path)
    close()
    return found


@lru_cache(1 << 16)
def _bucket(name: str, size: int) -> int:
    h = 2166136261
    for octet in name.encode():
        h = ((h ^ octet) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % size


def features(pages: list[list[Block]], s: Settings) -> list[np.ndarray]:
    """For every page one row per block: hashed tag path, hashed words, and the block's shape and place on the page."""
    blocks = [block for page in pages for block in page]
    sizes = [len(page) for page in pages]
    out = np.zeros((len(blocks), s.path_size + s.word_size + 8), np.float32)
    seen: dict[Path, int] = {}  # the buckets of a path's names and of all above, as bits
    for k, block in enumerate(blocks):
        if block.path is not None:
            for path in block.path.chain(seen):
                bits = seen[path.above] if path.above else 0
                for name in path.names:
                    bits |= 1 << _bucket(name, s.path_size)
                seen[path] = bits
            bits = np.frombuffer(seen[block.path].to_bytes(-(-s.path_size // 8), "little"), np.uint8)
            out[k, : s.path_size] = np.unpackbits(bits, bitorder="little")[: s.path_size]
    octets, offsets = texts.flat(pa.array([b.text for b in blocks], pa.string()))
    octets = texts.lowered(octets)
    starts, ends, rows = texts.word_spans(octets, offsets)
    slots = (texts.span_hashes(octets, starts, ends) % np.uint64(s.word_size)).astype(np.int64)
    counts = np.bincount(rows * s.word_size + slots, minlength=len(blocks) * s.word_size).reshape(len(blocks), s.word_size)
    out[:, s.path_size:s.path_size + s.word_size] = np.log1p(counts) / 4
    words = np.maximum(counts.sum(1), 1)
    length = np.diff(offsets)
    stops = np.concatenate([[0], np.cumsum(_IS_STOP[octets])])
    place = np.arange(len(blocks)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    out[:, -8:] = np.column_stack([
        np.log1p(words) / 5, length / words / 10, [b.linked for b in blocks], place / np.repeat(np.maximum(sizes, 1), sizes),
        (stops[offsets[1:]] - stops[offsets[:-1]]) / words, [b.text[-1:] in ".!?" for b in blocks],
        [b.path.depth / 10 if b.path else 0 for b in blocks], np.ones(len(blocks))])
    return np.split(out, np.cumsum(sizes[:-1]))


def label_of(block: Block) -> int:
    """Whether a block belongs to the article by the names of the elements around it."""
    return int(block.path is not None and block.path.main and not block.path.other)


_FRAMES = (("body", "header"), ("body", "div", ".site-header"), ("body", "aside"), ("body", "div", ".sidebar"), ("body", "form"),
           ("body", "div", ".cookie-notice"), ("body", "section", ".comments"), ("body", "article", "section", ".comments", "div"),
           ("body", "div", ".comment"), ("body", "div", ".banner"), ("body", "div", ".promo"), ("body", "div", ".menu", "ul", "li"),
           ("body", "footer", "p"), ("body", "article", "aside"), ("body", "article", "footer"), ("body", "article", "p", "button"), ("body", "div", ".related", "ul", "li"))
_ARTICLES = (("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post-body"), ("div", ".entry-content"), ("section", ".story"))


def varied(blocks: list[Block], labels: list[int], draw: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page as another template might build it: other names around the article, and other kinds of blocks between its parts."""
    around = _ARTICLES[draw.integers(len(_ARTICLES))]
    page, marks = [], []
    renamed: dict[Path, Path] = {}
    for block, label in zip(blocks, labels, strict=True):
        path = block.path
        if label:
            for part in path.chain(renamed):
                renamed[part] = Path(renamed.get(part.above), tuple(y for x in part.names for y in (around if x in MAIN_TAGS else (x,))))
            path = renamed[path]
        if draw.random() < 0.15:
            words = blocks[draw.integers(len(blocks))].text.split()
            first, count = draw.integers(len(words)), draw.integers(2, 40)
            page.append(Block(" ".join(words[first:first + count]) or "more", Path.of("html", *_FRAMES[draw.integers(len(_FRAMES))]), float(draw.random() < 0.3)))
            marks.append(0)
        page.append(Block(block.text, path, block.linked))
        marks.append(label)
    return page, marks


def made(count: int, draw: np.random.Generator) -> list[tuple[list[Block], list[int]]]:
    """Pages of invented words with their labels, for tables of which no page names its article: short, often linked blocks around
    and between an article of a heading, paragraphs and a list."""
    syllables = "ba ce di fo gu la me ni or pa re si to un va we is an th er".split()

    def text(least: int, most: int, stops: bool) -> str:
        words = ["".join(draw.choice(syllables, draw.integers(1, 4))) for _ in range(draw.integers(least, most))]
        words = [word + (str(draw.choice([".", ",", ";"])) if stops and draw.random() < 0.15 else "") for word in words]
        return " ".join(words) + ("." if stops and draw.random() < 0.9 else "")

    def around() -> list[Block]:
        path = Path.of("html", *_FRAMES[draw.integers(len(_FRAMES))])
        return [Block(text(1, 12 if draw.random() < 0.8 else 40, draw.random() < 0.3), path, float(draw.random() < 0.5)) for _ in range(draw.integers(1, 7))]

    out = []
    for _ in range(count):
        before, after = [b for _ in range(draw.integers(1, 4)) for b in around()], [b for _ in range(draw.integers(1, 4)) for b in around()]
        home = ("html", "body", "article")
        article = [Block(text(3, 14, False), Path.of(*home, "h1"), 0.0)]
        for _ in range(draw.integers(2, 12)):
            kind = draw.random()
            path = (*home, "p") if kind < 0.75 else (*home, "ul", "li") if kind < 0.9 else (*home, "h2")
            article.append(Block(text(2, 10, False) if path[-1] == "h2" else text(8, 120, True), Path.of(*path), float(draw.random()) * 0.2))
        out.append((before + article + after, [0] * len(before) + [1] * len(article) + [0] * len(after)))
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for every block."""

    def __init__(self, width: int, s: Settings):
        draw = np.random.default_rng(s.seed)
        h = s.hidden
        scale = lambda *shape: (draw.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = h
        self.weights = {"out": scale(2 * h, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.weights |= {f"x{side}": scale(width, 4 * h), f"h{side}": scale(h, 4 * h), f"c{side}": np.zeros(4 * h, np.float32)}
            self.weights[f"c{side}"][h:2 * h] = 1  # remember at first

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        w, h = self.weights, self.hidden
        steps = x.shape[1]
        gates_in = x @ w[f"x{side}"] + w[f"c{side}"]
        state = np.zeros((len(x), h), np.float32)
        cell = np.zeros_like(state)
        out = np.zeros((len(x), steps, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = gates_in[:, t] + state @ w[f"h{side}"]
            sig = 1 / (1 + np.exp(-np.clip(g[:, :3 * h], -30, 30)))
            i, f, o, c = sig[:, :h], sig[:, h:2 * h], sig[:, 2 * h:], np.tanh(g[:, 3 * h:])
            m = mask[:, t, None]
            new = f * cell + i * c
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, c, th, cell, state, m))
            cell = m * new + (1 - m) * cell
            state = m * (o * th) + (1 - m) * state
            out[:, t] = state
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], 2)
        return 1 / (1 + np.exp(-np.clip(both @ self.weights["out"] + self.weights["bias"], -30, 30)))[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the blocks of the batch."""
        w, h = self.weights, self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        outs = {side: self._run(x, mask, side, kept[side]) for side in "fb"}
        both = np.concatenate([outs["f"], outs["b"]], 2)
        p = 1 / (1 + np.exp(-np.clip(both @ w["out"] + w["bias"], -30, 30)))[:, :, 0]
        error = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        grads = {"out": (both * error).sum((0, 1))[:, None], "bias": error.sum((0, 1))}
        into = error @ w["out"].T
        for side in "fb":
            part = into[:, :, :h] if side == "f" else into[:, :, h:]
            d_gates = np.zeros((len(x), x.shape[1], 4 * h), np.float32)
            d_state = np.zeros((len(x), h), np.float32)
            d_cell = np.zeros_like(d_state)
            grads[f"h{side}"] = np.zeros_like(w[f"h{side}"])
            for t, i, f, o, c, th, cell, state, m in reversed(kept[side]):
                d_out = d_state + part[:, t]
                live = d_out * m
                d_new = d_cell * m + live * o * (1 - th * th)
                g = np.concatenate([d_new * c * i * (1 - i), d_new * cell * f * (1 - f), live * th * o * (1 - o), d_new * i * (1 - c * c)], 1)
                d_gates[:, t] = g
                grads[f"h{side}"] += state.T @ g
                d_state = g @ w[f"h{side}"].T + d_out * (1 - m)
                d_cell = d_new * f + d_cell * (1 - m)
            grads[f"x{side}"] = np.einsum("btd,btg->dg", x, d_gates, optimize=True)
            grads[f"c{side}"] = d_gates.sum((0, 1))
        return grads


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of different lengths as one array, and a mask of what is there."""
    x = np.zeros((len(rows), max(map(len, rows)), rows[0].shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, row in enumerate(rows):
        x[k, : len(row)], mask[k, : len(row)] = row, 1
    return x, mask


def trained(pages: list[str], s: Settings) -> Labeller:
    """A labeller fitted to the labels that the element names of ``pages`` give. Pages without any block of a named article say
    nothing about theirs and are left out; without any other page the labeller learns from ``made`` pages."""
    known = [(blocks, [label_of(b) for b in blocks]) for blocks in map(blocks_of, pages) if blocks]
    known = [(blocks, labels) for blocks, labels in known if any(labels)]
    draw = np.random.default_rng(s.seed)
    known = known or made(s.sample, draw)
    model = Labeller(s.path_size + s.word_size + 8, s)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for _ in range(s.epochs):
        order = sorted(range(len(known)), key=lambda k: (len(known[k][0]) // 4, draw.random()))
        for at in draw.permutation(range(0, len(order), s.batch)):
            batch = [varied(*known[k], draw) if draw.random() < 0.7 else known[k] for k in order[at:at + s.batch]]
            x, mask = padded(features([b for b, _ in batch], s))
            hidden_names = draw.random((len(x), 1, s.path_size)) < 0.1  # so that a name alone does not decide
            x[:, :, : s.path_size] *= ~hidden_names
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(batch):
                y[k, : len(labels)] = labels
            step += 1
            for name, grad in model.gradients(x, mask, y).items():
                grad = np.clip(grad, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad * grad
                move = (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
                model.weights[name] = (model.weights[name] - s.rate * move).astype(np.float32)
    return model


def main_texts(pages: list[str], model: Labeller, s: Settings) -> list[str]:
    """The blocks of each page that the model takes for the article, joined by spaces."""
    blocks = [blocks_of(page) for page in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if blocks[k]), key=lambda k: len(blocks[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < 256 and (stop - at + 1) * len(blocks[order[stop]]) <= 8192:
            stop += 1
        own = order[at:stop]
        scores = model.scores(*padded(features([blocks[k] for k in own], s)))
        for k, row in zip(own, scores, strict=True):
            out[k] = " ".join(b.text for b, p in zip(blocks[k], row, strict=False) if p >= 0.5)
        at = stop
    return out


def fit(pages: DataFrame, settings: Settings = Settings()) -> Labeller:
    """Train on a bounded draw of those ``pages`` (page_id, html) that name an article: those of lowest id hash."""
    s = settings
    named = pages.where(F.length("html").between(1, s.longest) & F.col("html").rlike(rf"(?i)<({'|'.join(sorted(MAIN_TAGS))})[\s/>]"))
    drawn = lowest_hashed(named.select("page_id", "html"), ["page_id"], s.sample)
    return trained([r["html"] for r in drawn.collect()], s)


def main_text(pages: DataFrame, model: Labeller | None, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html; other columns are ignored).

    Character references are decoded, white space inside a block is one space, blocks of the article are joined in page order.
    A null or empty page, one without a block, and every page without a model has an empty text. Rows are independent: repeated
    rows repeat, nothing is shuffled, empty input gives an empty table.
    """
    s = settings
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in texts.small_batches(batches, "html", 1 << 20):
            rows = [page or "" for page in batch.column("html").to_pylist()]
            found = main_texts(rows, own, s) if own else [""] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
