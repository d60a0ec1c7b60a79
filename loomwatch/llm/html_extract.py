"""Main-text extraction by a recurrent block labeller (bidirectional LSTM in numpy).

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of its
open tags (and their class, id and role words), kept as counts of hashed words so that deep nesting
costs no more than its tags. A block's vector holds its hashed path words, the mean of all its
hashed words, and a few measures of its form. A bidirectional LSTM reads all blocks of the page in
order, so each block is judged with the whole document in view, and marks it as main text or not.

The labeller is trained here: on a sample of pages bounded by ``sample_pages`` and
``sample_chars``, with labels from page structure (inside an article or main element and outside
menus, headers, footers, sidebars, notices, adverts, forms and comments), and on variants of
those pages with more furniture of every kind put in and containers renamed. Training reads every
block of those pages, in windows of ``TRAIN_WINDOW`` blocks. The weights are about forty thousand
numbers and go to the tasks by broadcast. Extraction is a row in and a row out; within a batch,
pages of like length run together.

Defined cases: null and empty html give an empty text; unclosed and crossed tags are mended as
browsers do (a new paragraph ends an open one, ends without a start are ignored); an unfinished
character reference stays as it is; pages of any length and depth are read whole; repeated rows come
back alike; an empty table stays empty; an input column named like the added one is replaced, all
others are returned as they are.
"""

from __future__ import annotations

import html as entities
import re
from binascii import crc32
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwatch.llm.names import col

SAMPLE_PAGES, SAMPLE_CHARS, TRAIN_WINDOW = 160, 60_000, 160
#: Variants of each sampled page; more where few pages are sampled, to so many in all.
VARIANTS, LEAST_VARIANTS = 3, 480
PATH_DIM, WORD_DIM, FORM_DIM, HIDDEN = 512, 32, 6, 16
INPUT = PATH_DIM + WORD_DIM + FORM_DIM

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script|style|noscript|template|iframe|svg|textarea|title"
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Names of page furniture, in tags and in class, id and role words.
FURNITURE_TAGS = ("nav", "header", "footer", "aside", "form", "button", "select", "title", "dialog", "menu", "label", "figure")
FURNITURE_WORDS = (
    "ad ads advert adverts advertisement adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal "
    "newsletter subscribe signup login search menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related recommended share social "
    "comment comments discussion replies reply header masthead footer copyright legal disclaimer pagination pager toolbar tags"
).split()
MAIN_TAGS, MAIN_WORDS = ("article", "main"), ("article", "content", "main", "post", "entry", "story", "body")

# What variants of training pages wrap around and call their main text.
WRAPPERS = ((), (), ("div",), ("div", ".page"), ("div", ".wrap"), ("div", ".container"), ("div", ".site", "div"), ("section", ".outer"))
CONTAINERS = (
    ("article",), ("main",), ("main", "article"), ("div", ".content"), ("main", "div", ".post", ".content"), ("article", ".entry"),
    ("div", ".article", ".body"), ("div", ".story"), ("article", ".post"), ("div", ".main"), ("section", ".content"), ("div", ".entry", ".content"),
)

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})\b((?:[^>"']|"[^"]*"|'[^']*')*)>(.*?)(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"\w+")


Path = tuple[tuple[int, int], ...]


@dataclass
class Block:
    path: Path  # the place of each path word's feature, and how often it stands in the path
    text: str
    linked: bool
    main: bool  # what the teacher says
    heading: bool = False


def _names(attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return ()
    found = (a or b or c for a, b, c in _NAMES.findall(attributes))
    return tuple(dict.fromkeys("." + w for x in found for w in re.split(r"[\s_-]+", x.lower()) if w))


class _Places(dict):
    """Where a word's feature stands, up to a bound of remembered words."""

    def __init__(self, first: int, size: int):
        self.first, self.count = first, size

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        place = self[word] = self.first + crc32(word.encode()) % self.count
        return place


class _WordBytes(_Places):
    """Where a word's feature stands, as one byte: a text's words join to an array."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        place = self[word] = bytes([crc32(word.encode()) % self.count])
        return place


_PATHS, _WORDS = _Places(0, PATH_DIM), _WordBytes(0, WORD_DIM)


_FURNITURE = frozenset([*FURNITURE_TAGS, *("." + w for w in FURNITURE_WORDS)])
_MAIN = frozenset([*MAIN_TAGS, *("." + w for w in MAIN_WORDS)])


def block_of(path: tuple[str, ...], text: str, linked: bool) -> Block:
    """A block under the path words given, "tag" or ".name"; the teacher calls it main text inside a
    main container and outside every kind of furniture."""
    main = _FURNITURE.isdisjoint(path) and not _MAIN.isdisjoint(path)
    return Block(tuple(Counter(_PATHS[w] for w in path).items()), text, linked, main, path[-1:] in (("h1",), ("h2",)))


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, white space made single, empty ones left out."""
    if not page:
        return []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open tags with their words
    where: dict[str, list[int]] = {}  # depths at which a tag is open
    words: Counter[int] = Counter()  # of the open tags that are no inline ones
    furniture = mains = 0
    out: list[Block] = []
    parts: list[str] = []
    at: tuple[Path, bool, bool, bool] | None = None

    def flush() -> None:
        nonlocal at
        text = " ".join(entities.unescape("".join(parts)).split())
        if text and at:
            out.append(Block(at[0], text, *at[1:]))
        parts.clear()
        at = None

    def take(text: str) -> None:
        nonlocal at
        if at is None and text.strip():
            at = (tuple(words.items()), bool(where.get("a")), mains > 0 and not furniture, any(where.get(h) for h in ("h1", "h2")))
        parts.append(text)

    def count(path: tuple[str, ...], by: int) -> None:
        nonlocal furniture, mains
        for w in path:
            place = _PATHS[w]
            words[place] += by
            if not words[place]:
                del words[place]
        furniture += 0 if _FURNITURE.isdisjoint(path) else by
        mains += 0 if _MAIN.isdisjoint(path) else by

    def push(tag: str, names: tuple[str, ...]) -> None:
        path = () if tag in INLINE else (tag, *names)
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, path))
        count(path, 1)

    def pop_to(tags: tuple[str, ...], until: tuple[str, ...] = ()) -> None:
        """Closes the innermost of ``tags`` and all within it, unless one of ``until`` is open further in."""
        depth = max((where[t][-1] for t in tags if where.get(t)), default=-1)
        if depth < 0 or depth < max((where[t][-1] for t in until if where.get(t)), default=-1):
            return
        while len(stack) > depth:
            tag, path = stack.pop()
            where[tag].pop()
            count(path, -1)

    end = 0
    for m in _TOKEN.finditer(page):
        if m.start() > end:
            take(page[end : m.start()])
        end = m.end()
        raw, raw_names, raw_text, slash, tag, attributes = m.groups()
        if raw:
            flush()
            if raw.lower() in ("title", "textarea"):
                push(raw.lower(), _names(raw_names))
                take(raw_text)
                flush()
                pop_to((raw.lower(),))
            continue
        if not tag:
            continue
        tag = tag.lower()
        block = tag not in INLINE
        if block:
            flush()
        if slash:
            pop_to((tag,))
        else:
            if tag in ENDS_PARAGRAPH:
                pop_to(("p",), ("article", "body", "div", "section", "li", "td", "main"))
            if tag in CLOSES:
                pop_to(CLOSES[tag], ("ul", "ol", "table", "dl", "select"))
            if tag not in VOID and not attributes.endswith("/"):
                push(tag, _names(attributes))
    if end < len(page):
        take(page[end:])
    flush()
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row per block: counts of hashed path words, shares of hashed words, and measures of form."""
    rows, places, times, hashed = [], [], [], []
    form = np.empty((len(blocks), FORM_DIM), dtype=np.float32)
    for r, block in enumerate(blocks):
        hashed.append(b"".join(map(_WORDS.__getitem__, _WORD.findall(block.text.lower()))))
        rows += [r] * len(block.path)
        for place, n in block.path:
            places.append(place)
            times.append(n)
        n = len(block.text)
        form[r] = (np.log1p(n) / 8, n < 25, block.linked, block.text[-1] in ".!?", block.text[:1] == "©", 1.0)
    x = np.zeros((len(blocks), INPUT), dtype=np.float32)
    x[rows, places] = np.minimum(times, 2)
    count = np.array([len(h) for h in hashed])
    flat = np.repeat(np.arange(len(blocks)) * WORD_DIM, count) + np.frombuffer(b"".join(hashed), dtype=np.uint8)
    words = np.bincount(flat, minlength=len(blocks) * WORD_DIM).reshape(len(blocks), WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = words / np.maximum(count, 1)[:, None]
    x[:, PATH_DIM + WORD_DIM :] = form
    return x


Weights = dict[str, np.ndarray]


def new_weights(seed: int = 7) -> Weights:
    rng = np.random.RandomState(seed)
    w: Weights = {}
    for side in ("f", "b"):
        w[f"{side}x"] = rng.normal(0, 0.1, (INPUT, 4 * HIDDEN))
        w[f"{side}h"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))
        w[f"{side}o"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    w["out"] = rng.normal(0, 0.1, 2 * HIDDEN)
    w["skip"] = np.zeros(INPUT)
    w["bias"] = np.zeros(1)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(w: Weights, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, page, HIDDEN) of one direction; padding leaves the state as it is."""
    steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
    h = np.zeros((x.shape[1], HIDDEN), dtype=x.dtype)
    c = np.zeros_like(h)
    out = np.zeros((len(x), x.shape[1], HIDDEN), dtype=x.dtype)
    drive = x @ w[f"{side}x"] + w[f"{side}o"]
    for t in steps:
        z = drive[t] + h @ w[f"{side}h"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        h2 = o * tc
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc, m))
        c, h = m * c2 + (1 - m) * c, m * h2 + (1 - m) * h
        out[t] = h
    return out


def _logits(w: Weights, x: np.ndarray, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
    return hf @ w["out"][:HIDDEN] + hb @ w["out"][HIDDEN:] + x @ w["skip"] + w["bias"][0]


def _gradients(w: Weights, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    kept: dict[str, list] = {"f": [], "b": []}
    states = {side: _run(w, side, x, mask, kept[side]) for side in "fb"}
    p = _sigmoid(_logits(w, x, states["f"], states["b"]))
    n = mask.sum()
    d = ((p - y) * mask / n).astype(x.dtype)
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["bias"][0] = d.sum()
    grad["skip"] = d.reshape(-1) @ x.reshape(-1, INPUT)
    for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        grad["out"][part] = d.reshape(-1) @ states[side].reshape(-1, HIDDEN)
        dh = np.zeros((x.shape[1], HIDDEN), dtype=x.dtype)
        dc = np.zeros_like(dh)
        dz_all = np.zeros((len(x), x.shape[1], 4 * HIDDEN), dtype=x.dtype)
        for t, h, c, i, f, o, g, tc, m in reversed(kept[side]):
            dh = dh + d[t][:, None] * w["out"][part]
            dh2, dc2 = dh * m, dc * m
            dct = dc2 + dh2 * o * (1 - tc * tc)
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dh2 * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            grad[f"{side}h"] += h.T @ dz
            dh = dz @ w[f"{side}h"].T + dh * (1 - m)
            dc = dct * f + dc * (1 - m)
        grad[f"{side}x"] = x.reshape(-1, INPUT).T @ dz_all.reshape(-1, 4 * HIDDEN)
        grad[f"{side}o"] = dz_all.sum(axis=(0, 1))
    loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n
    return float(loss), grad


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), INPUT), dtype=np.float32)
    mask = np.zeros(x.shape[:2], dtype=np.float32)
    for j, page in enumerate(pages):
        x[: len(page), j] = page
        mask[: len(page), j] = 1
    return x, mask


def _variants(pages: list[list[Block]], rng: np.random.RandomState) -> list[tuple[list[Block], np.ndarray]]:
    """Labelled pages: each as it is, and with furniture put in and containers renamed."""
    texts = [b.text for p in pages for b in p] or ["text"]
    pick = lambda items: items[rng.randint(len(items))]

    def furniture(base: tuple[str, ...]) -> list[Block]:
        tag = pick([*FURNITURE_TAGS, *["div", "section", "ul", "div", "section", "p", "span"] * 2])
        named = tag not in FURNITURE_TAGS
        names = tuple("." + w for w in {pick(FURNITURE_WORDS), *([pick(["box", "block", "list", "wrap", "top", "item", "inner"])] if rng.rand() < 0.4 else [])}) if named or rng.rand() < 0.4 else ()
        if named and not any(n[1:] in FURNITURE_WORDS for n in names):
            names = ("." + pick(FURNITURE_WORDS),)
        inner = pick([(), ("p",), ("ul", "li"), ("div",), ("h3",), ("div", "p"), ("label",)])
        return [block_of((*base, tag, *names, *inner), pick(texts)[: pick([20, 60, 200, 1000])].strip() or "x", rng.rand() < 0.3) for _ in range(rng.randint(1, 6))]

    out = []
    for page in pages:
        plain = [b for b in page if b.main]
        out.append((page, np.array([b.main for b in page], dtype=np.float32)))
        for _ in range(max(VARIANTS, -(-LEAST_VARIANTS // len(pages)))):
            container = ("html", "body", *pick(WRAPPERS), *pick(CONTAINERS), *pick([(), (), (), ("div",), ("section",)]))
            rows: list[tuple[Block, float]] = []
            for _ in range(rng.randint(0, 4)):
                rows += [(b, 0.0) for b in furniture(("html", "body", *pick(WRAPPERS)))]
            short = rng.rand() < 0.3  # also articles of few and repeated words
            some = plain if rng.rand() < 0.6 else plain[: rng.randint(1, 5)]
            for b in some:
                text = b.text
                if short or rng.rand() < 0.15:
                    text = pick([text, plain[0].text, pick(texts)])[: pick([3, 12, 30, 80])].strip() or text
                tail = pick([("p",)] * 5 + [("h2",), ("h3",), ("ul", "li"), ("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("div",), ("pre",), ("table", "tr", "td"), ()]) if not b.heading else pick([("h1",), ("h2",)])
                rows.append((block_of((*container, *tail), text, b.linked), 1.0))
                if "li" in tail:  # more items, short ones too
                    rows += [(block_of((*container, *tail), pick(texts)[: pick([4, 12, 40, 200])].strip() or "x", rng.rand() < 0.1), 1.0) for _ in range(rng.randint(0, 4))]
                if rng.rand() < 0.15:
                    rows += [(f, 0.0) for f in furniture(container)]
            for _ in range(rng.randint(0, 4)):
                rows += [(b, 0.0) for b in furniture(pick([("html", "body"), container, container[:-1]]))]
            out.append(([b for b, _ in rows], np.array([y for _, y in rows], dtype=np.float32)))
    return out


def train(pages: list[str], epochs: int = 24, seed: int = 7, rate: float = 0.01) -> Weights:
    """Weights fitted (Adam) to the pages' structure; without a page, those of the bare skeleton."""
    rng = np.random.RandomState(seed)
    parsed = [b for b in map(blocks_of, pages) if b] or [blocks_of("<html><body><nav><p>a</p></nav><article><h1>t</h1><p>Some text.</p></article><footer>c</footer></body></html>")]
    examples = [(vectors(b[i : i + TRAIN_WINDOW]), y[i : i + TRAIN_WINDOW]) for b, y in _variants(parsed, rng) for i in range(0, len(b), TRAIN_WINDOW)]
    examples.sort(key=lambda e: len(e[0]))
    batches = []
    for i in range(0, len(examples), 32):
        x, mask = _padded([e[0] for e in examples[i : i + 32]])
        y = np.zeros_like(mask)
        for j, e in enumerate(examples[i : i + 32]):
            y[: len(e[1]), j] = e[1]
        batches.append((x, mask, y))
    w = {k: v.astype(np.float32) for k, v in new_weights(seed).items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    rounds = max(epochs, min(60, 200 // len(batches)))
    for epoch in range(rounds):
        pace = rate * (1 - 0.9 * epoch / rounds)
        for b in rng.permutation(len(batches)):
            _, grad = _gradients(w, *batches[b])
            step += 1
            for k in w:  # Adam
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def label_pages(w: Weights, pages: list[list[Block]]) -> list[np.ndarray]:
    """Which blocks of each page are main text; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    start = 0
    while start < len(order):
        end, most = start, 0
        while end < len(order) and end - start < 128 and (len(pages[order[end]]) * (end - start + 1) <= 8192 or end == start):
            end += 1
        some = order[start:end]
        x, mask = _padded([vectors(pages[i]) for i in some])
        marks = _logits(w, x, _run(w, "f", x, mask), _run(w, "b", x, mask)) > 0
        for j, i in enumerate(some):
            out[i] = marks[: len(pages[i]), j]
        start = end
    return out


def fit_labeller(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> Weights:
    """Weights trained on the ``sample_pages`` pages with the smallest hashes, of up to ``sample_chars`` characters."""
    known = pages.select(col(html_col).alias("h")).where(F.length("h").between(1, sample_chars)).select("h", F.xxhash64("h").alias("k"))
    least = known.select("k").distinct().orderBy("k").limit(sample_pages)  # eight bytes a row are shuffled, no page
    sample = known.join(F.broadcast(least), "k").groupBy("k").agg(F.first("h").alias("h")).orderBy("k").collect()  # bounded by both
    return train([r.h for r in sample])


def extract_text(pages: DataFrame, weights: Weights, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with ``text_col``: the blocks marked as main text, one a line."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        texts: list[str] = []
        for start in range(0, len(column), 256):
            parsed = [blocks_of(h.as_py()) for h in column[start : start + 256]]
            marks = label_pages(shared.value, parsed)
            texts += ["\n".join(b.text for b, m in zip(p, k, strict=True) if m) for p, k in zip(parsed, marks, strict=True)]
        return pa.array(texts, pa.string())

    return pages.withColumn(text_col, extract(col(html_col)))
