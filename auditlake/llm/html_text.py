"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between tags that begin or end a block. Each block has the mean vector of
its tag path (names, classes, ids and roles of all open elements), the mean vector of its hashed words, and a few
numbers. A bidirectional LSTM reads the blocks of the whole page and gives each a probability of being main
text. It is trained here, in numpy, on a bounded sample of the table's own pages: as they are, labelled by
their article or main element, or, without one, by the density of text and links, and laid out anew, their texts dealt into the parts of random layouts (menus, headers,
sidebars, notices, adverts, forms, comments, footers; in and around differently named content containers), so that the
labeller does not depend on one layout.

Character references are decoded, white space becomes one space, blocks are joined in page order by one line break.

Cases: a NULL or empty html, and one without text, give an empty text. Unclosed elements end with the page,
unclosed comments, scripts, styles, titles and text areas take the rest of it, other unclosed or self-closed elements
without text of their own (svg, iframe, select, noscript, template) only their tag; stray end tags are ignored. A page of any length is read whole.
Repeated rows are read each. Other columns are not looked at. Pages with neither such an element nor enough text in one
place teach nothing; without a page to learn from nothing is main text.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import words
from auditlake.llm.shared import table

SAMPLE_PAGES = 1500
LAYOUTS = 4000
PATH_SPACE, WORD_SPACE = 2048, 4096
PATH_SIZE, WORD_SIZE, NUMBERS, STATE = 16, 4, 5, 16
MAIN = 0.5
LONG, LEAST_TEXT, MOST_LINKS, HELD = 40, 140, 0.5, 0.7

# Elements of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section"
    " summary table tbody td tfoot th thead tr ul video audio object".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<whole>script|style|noscript|template|textarea|title|svg|iframe|select)(?=[\s/>])[^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
# the texts of these are no markup: they have no short form, and take the rest of the page if unclosed
_RAW = frozenset(("script", "style", "textarea", "title"))
_NAMED = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z][a-z]*")

Block = tuple[tuple[str, ...], str, float]


def leaf_blocks(page: str) -> list[Block]:
    """(tag path, text, share of the text in links) for each block with text."""
    found: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    texts: list[str] = []
    links = linked = total = 0
    at = 0

    def add(text: str) -> None:
        nonlocal linked, total
        if text:
            texts.append(text)
            total += len(text)
            linked += len(text) * (links > 0)

    def close() -> None:
        nonlocal texts, linked, total
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                found.append((tuple(t for _, parts in open_ for t in parts), text, linked / max(total, 1)))
        texts, linked, total = [], 0, 0

    unclosed: set[str] = set()
    while mark := _MARKUP.search(page, at):
        add(page[at : mark.start()])
        at = mark.end()
        whole = (mark["whole"] or "").lower()
        if whole and (whole in _RAW or page[at - 2] != "/") and whole not in unclosed:
            end = re.compile(rf"</{whole}\s*>", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            elif whole in _RAW:
                at = len(page)
            else:
                unclosed.add(whole)
        name = (mark["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            links = max(0, links - 1) if mark["end"] else 1
        if name == "br":
            texts.append(" ")
        if name not in BLOCKS:
            continue
        close()
        if name in EMPTY:
            continue
        if mark["end"]:
            places = [k for k, (n, _) in enumerate(open_) if n == name]
            if places:
                del open_[places[-1] :]
            links = 0
            continue
        if open_ and open_[-1][0] == name and name in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
            open_.pop()
        named = "".join(" " + (m[1] or m[2] or m[3] or "") for m in _NAMED.finditer(mark["rest"]))
        open_.append((name, (name, *(f".{p.lower()}" for p in _PART.findall(named)))))
    add(page[at:])
    close()
    return found


def _hashed(token: str, space: int, known: dict[str, int]) -> int:
    place = known.get(token)
    if place is None:
        if len(known) > 200_000:
            known.clear()
        place = known[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % space
    return place


_paths: dict[str, int] = {}
_words: dict[str, int] = {}


class Pages:
    """Blocks of some pages, padded to the longest: hashed tokens with their blocks, and numbers."""

    def __init__(self, pages: list[list[Block]]):
        self.lengths = np.array([len(p) for p in pages])
        self.steps = int(self.lengths.max(initial=0))
        flat = [b for p in pages for b in p]
        row = np.repeat(np.arange(len(pages)), self.lengths)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.cell = step * len(pages) + row
        self.paths = self._tokens([b[0] for b in flat], PATH_SPACE, _paths)
        self.words = self._tokens([b[1].lower().split() for b in flat], WORD_SPACE, _words)
        size = np.array([len(b[1]) for b in flat], dtype=float)
        count = np.array([b[1].count(" ") + 1 for b in flat], dtype=float)
        ends = np.array([b[1][-1] in ".!?" for b in flat], dtype=float)
        numbers = (np.log1p(size) / 5, np.log1p(count) / 3, np.array([b[2] for b in flat]), ends, np.ones(len(flat)))
        self.numbers = np.column_stack(numbers).astype(np.float32) if flat else np.zeros((0, NUMBERS), dtype=np.float32)

    @staticmethod
    def _tokens(lists: list, space: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block, token and weight; the weights of a block sum to 1."""
        sizes = np.array([len(t) for t in lists], dtype=np.int64)
        tokens = np.array([_hashed(t, space, known) for ts in lists for t in ts], dtype=np.int64)
        weights = np.repeat(1 / np.maximum(sizes, 1), sizes).astype(np.float32)
        return np.repeat(np.arange(len(lists)), sizes), tokens, weights

    def grid(self, values: np.ndarray) -> np.ndarray:
        """Values of blocks as (step, page, value)."""
        result = np.zeros((self.steps * len(self.lengths), values.shape[1]), dtype=np.float32)
        result[self.cell] = values
        return result.reshape(self.steps, len(self.lengths), -1)


def _means(tokens: tuple[np.ndarray, np.ndarray, np.ndarray], vectors: np.ndarray, n: int) -> np.ndarray:
    block, token, weight = tokens
    result = np.empty((n, vectors.shape[1]), dtype=np.float32)
    for k in range(vectors.shape[1]):
        result[:, k] = np.bincount(block, weights=vectors[token, k] * weight, minlength=n)
    return result


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTM layers side by side, one reading forward and one backward, and a logistic output."""

    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + NUMBERS

        def normal(*shape: int) -> np.ndarray:
            return (random.standard_normal(shape) * 0.2).astype(np.float32)

        self.weights = {"path": normal(PATH_SPACE, PATH_SIZE), "word": normal(WORD_SPACE, WORD_SIZE)}
        for way in "fb":
            self.weights |= {f"{way}_in": normal(size, 4 * STATE), f"{way}_across": normal(STATE, 4 * STATE)}
            bias = np.zeros(4 * STATE, dtype=np.float32)
            bias[STATE : 2 * STATE] = 1
            self.weights[f"{way}_bias"] = bias
        self.weights |= {"out": normal(2 * STATE, 1), "out_bias": np.zeros(1, dtype=np.float32)}

    def inputs(self, pages: Pages) -> np.ndarray:
        n = len(pages.cell)
        path = _means(pages.paths, self.weights["path"], n)
        return pages.grid(np.column_stack((path, _means(pages.words, self.weights["word"], n), pages.numbers)))

    def _pass(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """States of one direction; padding keeps the state as it is."""
        w = self.weights
        steps, n, _ = x.shape
        projected = (x.reshape(steps * n, -1) @ w[f"{way}_in"] + w[f"{way}_bias"]).reshape(steps, n, -1)
        h, c = np.zeros((n, STATE), dtype=np.float32), np.zeros((n, STATE), dtype=np.float32)
        states, kept = np.zeros((steps, n, STATE), dtype=np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = projected[t] + h @ w[f"{way}_across"]
            gates, new = _sigmoid(a[:, : 3 * STATE]), np.tanh(a[:, 3 * STATE :])
            i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
            cell = f * c + i * new
            squashed = np.tanh(cell)
            kept.append((t, h, c, i, f, o, new, squashed))
            m = mask[t][:, None]
            h, c = m * o * squashed + (1 - m) * h, m * cell + (1 - m) * c
            states[t] = h
        return states, kept

    def _masked(self, pages: Pages) -> np.ndarray:
        return (np.arange(pages.steps)[:, None] < pages.lengths).astype(np.float32)

    def probabilities(self, pages: Pages) -> np.ndarray:
        """Of being main text, for the blocks in page order."""
        if not len(pages.cell):
            return np.zeros(0)
        x, mask = self.inputs(pages), self._masked(pages)
        states = np.concatenate([self._pass(x, mask, way)[0] for way in "fb"], axis=2)
        scores = states.reshape(-1, 2 * STATE) @ self.weights["out"] + self.weights["out_bias"]
        return _sigmoid(scores[pages.cell, 0])

    def learn(self, pages: Pages, labels: np.ndarray, rate: float, memory: dict) -> None:
        """One adaptive step on the pages' blocks; ``labels`` in page order."""
        w = self.weights
        x, mask = self.inputs(pages), self._masked(pages)
        steps, n, width = x.shape
        both = {way: self._pass(x, mask, way) for way in "fb"}
        states = np.concatenate([both[way][0] for way in "fb"], axis=2).reshape(-1, 2 * STATE)
        off = np.zeros((steps * n, 1), dtype=np.float32)
        p = _sigmoid((states @ w["out"] + w["out_bias"])[pages.cell, 0])
        off[pages.cell, 0] = (p - labels) / len(labels)
        slopes = {"out": states.T @ off, "out_bias": off.sum(axis=0)}
        d_states = (off @ w["out"].T).reshape(steps, n, 2 * STATE)
        d_x = np.zeros((steps * n, width), dtype=np.float32)
        for at, way in enumerate("fb"):
            d_own = d_states[:, :, at * STATE : (at + 1) * STATE]
            d_a = np.zeros((steps, n, 4 * STATE), dtype=np.float32)
            before = np.zeros((steps, n, STATE), dtype=np.float32)
            d_h, d_c = np.zeros((n, STATE), dtype=np.float32), np.zeros((n, STATE), dtype=np.float32)
            for t, h, c, i, f, o, new, squashed in reversed(both[way][1]):
                m = mask[t][:, None]
                d_h = d_h + d_own[t]
                active = m * d_h
                d_cell = m * d_c + active * o * (1 - squashed**2)
                parts = (d_cell * new * i * (1 - i), d_cell * c * f * (1 - f), active * squashed * o * (1 - o))
                d_a[t] = np.concatenate((*parts, d_cell * i * (1 - new**2)), axis=1)
                before[t] = h
                d_h = (1 - m) * d_h + d_a[t] @ w[f"{way}_across"].T
                d_c = (1 - m) * d_c + d_cell * f
            flat = d_a.reshape(steps * n, -1)
            slopes[f"{way}_in"] = x.reshape(steps * n, -1).T @ flat
            slopes[f"{way}_bias"] = flat.sum(axis=0)
            slopes[f"{way}_across"] = before.reshape(steps * n, -1).T @ flat
            d_x += flat @ w[f"{way}_in"].T
        d_x = d_x[pages.cell]
        for name, (block, token, weight), at, size in (
            ("path", pages.paths, 0, PATH_SIZE),
            ("word", pages.words, PATH_SIZE, WORD_SIZE),
        ):
            slopes[name] = np.zeros_like(w[name])
            np.add.at(slopes[name], token, d_x[block, at : at + size] * weight[:, None])
        memory["step"] = step = memory.get("step", 0) + 1
        for name, slope in slopes.items():
            first, second = memory.setdefault(name, (np.zeros_like(slope), np.zeros_like(slope)))
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            w[name] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)


# Names that layouts give to their parts.
_CONTENT = (
    ("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main", ".content"), ("div", ".post"),
    ("div", ".article", ".body"), ("section", ".entry", ".content"), ("div", ".story"), ("div", ".text"),
    ("div", ".post", ".content", "article"), ("section",), ("div", ".page", "div", ".content"), ("article", ".post", "div", ".body"),
)
_AROUND = {
    "menu": (("nav",), ("nav", ".main", ".nav"), ("div", ".menu"), ("ul", ".nav"), ("div", ".navbar"), ("div", ".breadcrumb"), ("div", ".navigation"), ("header", "nav"), ("ol", ".breadcrumbs"), ("div", ".pagination"), ("div", ".toc")),
    "head": (("header",), ("div", ".header"), ("div", ".masthead"), ("div", ".banner"), ("header", ".site", ".header"), ("div", ".top", ".bar"), ("div", ".logo")),
    "side": (("aside",), ("div", ".sidebar"), ("aside", ".sidebar"), ("div", ".widget"), ("div", ".related"), ("div", ".side", ".column"), ("section", ".recommended"), ("div", ".popular"), ("aside", ".related", ".posts"), ("div", ".more", ".stories"), ("section", ".related"), ("div", ".trending")),
    "note": (("div", ".cookie", ".notice"), ("div", ".notice"), ("div", ".consent"), ("div", ".alert"), ("div", ".gdpr"), ("section", ".notice"), ("div", ".cookie"), ("div", ".cookies"), ("div", ".cookie", ".banner"), ("div", ".popup"), ("dialog",), ("div", ".modal"), ("div", ".newsletter"), ("div", ".subscribe"), ("div", ".paywall"), ("div", ".disclaimer"), ("div", ".overlay"), ("div", ".message")),
    "ad": (("div", ".ad"), ("div", ".ads"), ("div", ".advert"), ("div", ".advertisement"), ("aside", ".ad"), ("div", ".sponsored"), ("div", ".promo"), ("section", ".promotion"), ("div", ".sponsor"), ("div", ".banner", ".ad"), ("ins", ".adsbygoogle"), ("div", ".ad", ".slot"), ("div", ".ad", ".box")),
    "form": (("form",), ("form", ".search"), ("div", ".signup", "form"), ("form", "fieldset"), ("div", ".search"), ("div", ".login", "form"), ("form", ".newsletter"), ("div", ".contact", "form"), ("form", ".comment", ".form")),
    "talk": (("section", ".comments"), ("div", ".comments"), ("div", ".comment"), ("div", ".reader", ".comments"), ("ol", ".comment", ".list"), ("section", ".comments", "article", ".comment"), ("section", ".comments", "article"), ("div", ".responses"), ("div", ".replies"), ("div", ".discussion"), ("section", ".disqus", ".thread"), ("ul", ".comments"), ("div", ".feedback"), ("div", ".comments", "div", ".comment"), ("section", ".reviews")),
    "foot": (("footer",), ("div", ".footer"), ("footer", ".site", ".footer"), ("div", ".copyright"), ("div", ".legal"), ("div", ".bottom")),
    "share": (("div", ".share"), ("div", ".social"), ("ul", ".social", ".links"), ("div", ".tags"), ("div", ".byline"), ("div", ".meta"), ("div", ".author", ".bio"), ("ul", ".share", ".buttons")),
}
_LISTS = frozenset(("menu", "share"))
_SHELL = (("html", "body"), ("html", "body", "div", ".page"), ("html", "body", "div", ".wrapper"), ("html", "body", "div", ".container", "div", ".row"), ("html", "body", "div"))
_ORDER = ("note", "head", "menu", "ad", "form", None, "share", "side", "ad", "talk", "form", "foot", "note")


def teacher(block: Block) -> float:
    """The label of a block of a page as it is: inside article or main, and in no part around."""
    path = block[0]
    inside = "article" in path or "main" in path
    return float(inside and not any(t in path for t in ("nav", "aside", "footer", "form", "header", ".ad", ".comments", ".comment")))


# Names of parts around the main text, for pages that don't mark it.
_NO_MAIN = frozenset(
    "nav aside footer form header dialog .nav .menu .navbar .navigation .breadcrumb .breadcrumbs .pagination .toc .header"
    " .masthead .banner .sidebar .widget .related .recommended .popular .trending .cookie .cookies .consent .gdpr .notice"
    " .popup .modal .newsletter .subscribe .ad .ads .advert .advertisement .sponsored .promo .comments .comment .replies"
    " .footer .copyright .legal .share .social".split()
)


def by_density(page: list[Block]) -> list[float] | None:
    """Labels of a page without article and main: what lies in the innermost container of most of its running text.

    Running text is long, has few links and is in no part around. NULL if there is too little of it.
    """
    candidates = [b for b in page if b[2] < MOST_LINKS and not _NO_MAIN.intersection(b[0])]
    # the containers of the running texts: their paths without the last element
    rows = [(b[0][: max((k for k, t in enumerate(b[0]) if t[0] != "."), default=0)], len(b[1])) for b in candidates if len(b[1]) >= LONG]
    least = HELD * sum(size for _, size in rows)
    if sum(size for _, size in rows) < LEAST_TEXT:
        return None
    inside: list[str] = []
    while True:
        sizes: dict[str, int] = {}
        for path, size in rows:
            if len(path) > len(inside):
                sizes[path[len(inside)]] = sizes.get(path[len(inside)], 0) + size
        token = max(sizes, key=sizes.get, default=None)
        if token is None or sizes[token] < least:
            break
        rows = [(path, size) for path, size in rows if len(path) > len(inside) and path[len(inside)] == token]
        inside.append(token)
    own = tuple(inside)
    return [float(b[2] < MOST_LINKS and not _NO_MAIN.intersection(b[0]) and b[0][: len(own)] == own) for b in page]


def labels_of(page: list[Block]) -> list[float] | None:
    """Labels of a page as it is, or None for one that teaches nothing."""
    if any("article" in b[0] or "main" in b[0] for b in page):
        labels = [teacher(b) for b in page]
        return labels if any(labels) else None
    return by_density(page)


def layout(random: np.random.Generator, body: list[str], other: list[str], short: list[str]) -> tuple[list[Block], list[float]]:
    """A page of a random layout: ``body`` as its main text, ``other`` and ``short`` texts in the parts around."""
    pick = lambda options: options[random.integers(len(options))]
    shell, content = pick(_SHELL), pick(_CONTENT)
    blocks: list[Block] = []
    labels: list[float] = []

    def add(path: tuple[str, ...], text: str, links: float, label: float) -> None:
        blocks.append((path, text, links))
        labels.append(label)

    def part(kind: str, around: tuple[str, ...]) -> None:
        path = around + pick(_AROUND[kind])
        if kind in _LISTS or random.random() < 0.15:
            for _ in range(random.integers(1, 7)):
                add((*path, *(("ul", "li") if random.random() < 0.7 else ())), pick(short), 1.0 * (random.random() < 0.9), 0.0)
            return
        for _ in range(random.integers(1, 7) if kind == "talk" else random.integers(1, 4)):
            inner = pick((("p",), ("div",), (), ("div", "p"), ("h3",), ("li",)))
            add(path + inner, pick(other if random.random() < 0.75 else short), float(random.random() < 0.25), 0.0)

    for kind in _ORDER:
        if kind:
            if random.random() < 0.5:
                part(kind, shell)
            continue
        inside = shell + content
        if random.random() < 0.8:
            add((*inside, "h1"), body[0], 0.0, 1.0)
        for text in body[1:]:
            inner = pick((("p",),) * 8 + (("div",), ("blockquote", "p"), ("ul", "li"), ("h2",), ("table", "tr", "td"), ("pre",)))
            add(inside + inner, text, float(random.random() < 0.03), 1.0)
            if random.random() < 0.08:
                part(pick(("ad", "side", "note", "form", "share")), inside)
        if random.random() < 0.2:
            part(pick(("talk", "share", "side", "form")), inside)
    return blocks, labels


def fit(pages: list[list[Block]], layouts: int = LAYOUTS, seed: int = 3, rate: float = 0.01) -> Labeller | None:
    """A labeller from some pages, as they are and laid out anew; None if none of them teaches anything."""
    random = np.random.default_rng(seed)
    model, memory = Labeller(), {}
    examples = [(p, labels) for p in pages if (labels := labels_of(p))]
    if not examples:
        return None
    body = [[b[1] for b, label in zip(p, labels, strict=True) if label] for p, labels in examples]
    other = [b[1] for p in pages for b in p if len(b[1]) > 40]
    short = [b[1] for p in pages for b in p if len(b[1]) <= 40] or other
    if other:
        for _ in range(layouts):
            own = body[random.integers(len(body))]
            examples.append(layout(random, own, other, short))
    for round_ in range(3):
        order = random.permutation(len(examples))
        for k in range(0, len(order), 32):
            chosen = [examples[j] for j in order[k : k + 32]]
            labels = np.array([x for _, ls in chosen for x in ls], dtype=np.float32)
            model.learn(Pages([p for p, _ in chosen]), labels, rate / (1 + round_), memory)
    return model


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = [leaf_blocks(t.as_py()) for batch in batches for t in words.text_column(batch, "html")]
    model = fit(pages)
    if model:
        names = list(model.weights)
        columns = {"name": names, "shape": [list(model.weights[n].shape) for n in names]}
        columns["numbers"] = [model.weights[n].ravel().tolist() for n in names]
        kinds = pa.schema([("name", pa.string()), ("shape", pa.list_(pa.int32())), ("numbers", pa.list_(pa.float32()))])
        yield pa.RecordBatch.from_pydict(columns, schema=kinds)


def train(pages: DataFrame, rows: int = SAMPLE_PAGES) -> Labeller | None:
    """A labeller from at most ``rows`` pages, the least by a hash of their content; fitted in one task."""
    digest = F.xxhash64("html")
    chosen = pages.filter("html is not null").select(digest.alias("digest")).distinct().orderBy("digest").limit(rows)
    sample = pages.select("html", digest.alias("digest")).join(F.broadcast(chosen), "digest", "left_semi")  # ``rows`` numbers
    sample = sample.dropDuplicates(["digest"]).repartition(1).sortWithinPartitions("digest").select("html")
    found = sample.mapInArrow(_fitted, "name string, shape array<int>, numbers array<float>").collect()
    if not found:
        return None
    model = Labeller()
    model.weights = {r.name: np.array(r.numbers, dtype=np.float32).reshape(r.shape) for r in found}
    return model


def main_text(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = words.text_column(batch, "html")
            texts = [""] * len(column)
            parsed = [leaf_blocks(t.as_py()) for t in column]
            order = sorted(range(len(parsed)), key=lambda k: len(parsed[k]))
            for k in range(0, len(order) if shared.value else 0, 256):
                chosen = order[k : k + 256]
                keep = shared.value.probabilities(Pages([parsed[j] for j in chosen])) >= MAIN
                at = 0
                for j in chosen:
                    texts[j] = "\n".join(b[1] for b, kept in zip(parsed[j], keep[at:], strict=False) if kept)
                    at += len(parsed[j])
            columns = {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | {"n_chars": pa.array(map(len, texts), pa.int64())})

    kinds = [F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html"]
    return pages.select(*kinds).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, train(pages))
