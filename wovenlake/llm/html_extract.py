"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags, scripts, styles, comments and markup left out. Each
block is a vector of its hashed tag path (names, classes and ids), its hashed words, and its length and share of
links. A bidirectional LSTM in numpy reads the blocks of the whole page, so each label uses document-wide context, and
blocks labelled main are joined in page order. The network is trained by backpropagation through time on a bounded
sample of pages whose markup itself tells the label: text under article or main is wanted, text under menus, headers,
footers, sidebars, forms, adverts, notices and comments is not, other text has no label in training.

Defined results: null or empty html, and pages without blocks, give an empty text. If no sampled page has a labelled
main block, nothing can be learned and all texts are empty. Repeated rows give equal results. An empty table gives an
empty table.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import base_columns, worker_table

# fixed values: HTML element kinds
BLOCK_TAGS = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio object".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe svg math textarea".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "head", "button", "label", "option", "title"}
SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol dl blockquote".split())
WANTED_TAGS = frozenset({"article", "main"})
CLOSES_ITSELF = frozenset("li p td th tr dd dt option".split())
UNWANTED_TAGS = frozenset("nav header footer aside form head menu button select dialog".split())
UNWANTED_NAMES = re.compile(r"(^|[-_ ])(ad|ads|advert\w*|banner|comments?|cookie\w*|footer|header|menu|nav\w*|newsletter|notices?|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)($|[-_ ])", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[A-Za-z][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*(?:>|$)|[^<]+|<", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\s(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PATH_SIZE, WORD_SIZE, EXTRA = 64, 32, 3
#: Text bytes of the words that a worker remembers; blocks in a padded batch (a longer page stands alone).
SLOT_BYTES, BATCH_BLOCKS = 3_000_000, 16_384


@dataclass(frozen=True)
class HtmlParameters:
    """sample_pages (of at most sample_page_bytes each) and sample_blocks (per page, from both ends) bound the training
    sample; the rest are sizes and steps."""

    sample_pages: int = 300
    sample_page_bytes: int = 200_000
    sample_blocks: int = 60
    hidden: int = 12
    steps: int = 200
    batch: int = 24
    rate: float = 0.02
    seed: int = 3


class Block:
    """path counts the hashed names of all open elements, PATH_SIZE numbers whatever the depth."""

    __slots__ = ("label", "linked", "path", "text")

    def __init__(self, path: list[int], text: str, linked: int, label: int):
        self.path, self.text, self.linked, self.label = path, text, linked, label


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order. label: 1 wanted, 0 not, -1 unknown. Open elements are counted by tag and path
    slot, so deep nesting costs no more than its tags."""
    out: list[Block] = []
    stack: list[tuple[str, list[int], int]] = []  # tag, slots of its names, label of what is below it
    opened: dict[str, int] = {}
    counts = [0] * PATH_SIZE
    parts: list[str] = []
    linked = 0
    path: list[int] = []
    label = -1

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(path, text, linked, label))
        parts, linked = [], 0

    def close(i: int) -> None:
        for tag, slots, _ in stack[i:]:
            opened[tag] -= 1
            for k in slots:
                counts[k] -= 1
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        token = m.group()
        at = m.end()
        if token[0] != "<" or len(token) == 1:
            if not parts:
                path, label = counts.copy(), stack[-1][2] if stack else -1
            parts.append(entities.unescape(token) if "&" in token else token)
            if opened.get("a"):
                linked += len(token)
            continue
        n = NAME.match(token)
        if n is None:
            continue
        tag = n.group(1).lower()
        if token[1] == "/":
            if tag in BLOCK_TAGS:
                flush()
            if opened.get(tag):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in RAW_TAGS and not token.endswith("/>"):
            ended = re.compile(f"</{tag}\\b[^>]*(?:>|$)", re.I).search(page, at)
            at = ended.end() if ended else end
            if tag in BLOCK_TAGS:
                flush()
            elif parts:
                parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            ends = [x for x in (("p",) if tag in CLOSES_P else ()) + ((tag,) if tag in CLOSES_ITSELF else ()) if opened.get(x)]
            for i in range(len(stack) - 1, -1, -1) if ends else ():
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        elif tag == "br" and parts:
            parts.append(" ")
        if tag in VOID_TAGS or token.endswith("/>"):
            continue
        names = [w.lower() for a in ATTRIBUTE.finditer(token) for w in (a[2] or a[3] or a[4] or "").split()]
        below = stack[-1][2] if stack else -1
        if below != 0:
            if tag in UNWANTED_TAGS or any(UNWANTED_NAMES.search(x) for x in names):
                below = 0
            elif tag in WANTED_TAGS:
                below = 1
        slots = [slot(x, PATH_SIZE) for x in (tag, *names)]
        for k in slots:
            counts[k] += 1
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, slots, below))
    flush()
    return out


class _Slots(dict):
    """Hashes of words; emptied when they have SLOT_BYTES."""

    held = 0

    def __missing__(self, word: str) -> int:
        if self.held > SLOT_BYTES:
            self.clear()
            self.held = 0
        self.held += len(word)
        v = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return v


def slot(word: str, size: int) -> int:
    return worker_table("word slots", _Slots)[word] % size


def features(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), PATH_SIZE + WORD_SIZE + EXTRA), np.float32)
    known = worker_table("word slots", _Slots)
    for i, b in enumerate(page):
        x[i, :PATH_SIZE] = b.path
        words = b.text.lower().split()
        got = np.bincount([known[w] % WORD_SIZE for w in words], minlength=WORD_SIZE) if words else np.zeros(WORD_SIZE)
        x[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = got / max(1, len(words))
        x[i, -3:] = np.log1p(len(b.text)) / 5, min(1.0, b.linked / len(b.text)), i / len(page)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BlockLabeller:
    """Bidirectional LSTM over the blocks of a page. trained is False until a labelled main block was seen."""

    def __init__(self, p: HtmlParameters):
        g = np.random.default_rng(p.seed)
        d, h = PATH_SIZE + WORD_SIZE + EXTRA, p.hidden
        f = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h, self.trained = h, False
        self.w = {"O": f(2 * h, 1), "o": np.zeros(1, np.float32)}
        for k in "fb":
            self.w |= {f"I{k}": f(d, 4 * h), f"W{k}": f(h, 4 * h), f"c{k}": np.zeros(4 * h, np.float32)}

    def _run(self, k: str, x: np.ndarray, live: np.ndarray, keep: bool = True):
        h, w = self.h, self.w
        a = x @ w[f"I{k}"] + w[f"c{k}"]
        s = c = np.zeros((len(x), h), np.float32)
        states, kept = np.zeros((len(x), x.shape[1], h), np.float32), []
        for t in range(x.shape[1]):
            u = a[:, t] + s @ w[f"W{k}"]
            i, f, o, g = _sigmoid(u[:, :h]), _sigmoid(u[:, h : 2 * h] + 1), _sigmoid(u[:, 2 * h : 3 * h]), np.tanh(u[:, 3 * h :])
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                kept.append((s, c, i, f, o, g, th))
            on = live[:, t : t + 1]
            c, s = np.where(on, new, c), np.where(on, o * th, s)
            states[:, t] = s
        return states, kept

    def _both(self, x: np.ndarray, n: np.ndarray, keep: bool = True):
        place = np.arange(x.shape[1])
        live = place < n[:, None]
        back = np.where(live, n[:, None] - 1 - place, place)
        xb = np.take_along_axis(x, back[..., None], 1)
        sf, kf = self._run("f", x, live, keep)
        sb, kb = self._run("b", xb, live, keep)
        both = np.concatenate([sf, np.take_along_axis(sb, back[..., None], 1)], 2)
        return _sigmoid((both @ self.w["O"] + self.w["o"])[..., 0]), both, live, back, xb, kf, kb

    @staticmethod
    def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(p) for p in pages])
        x = np.zeros((len(pages), n.max(), pages[0].shape[1]), np.float32)
        for i, p in enumerate(pages):
            x[i, : len(p)] = p
        return x, n

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main per block, for pages of at least one block."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < 128 and (b - a + 1) * len(pages[order[b]]) <= BATCH_BLOCKS:
                b += 1
            x, n = self._pad([pages[i] for i in order[a:b]])
            y = self._both(x, n, False)[0]
            for j, i in enumerate(order[a:b]):
                out[i] = y[j, : n[j]]
            a = b
        return out

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], p: HtmlParameters) -> None:
        g, w, h = np.random.default_rng(p.seed + 1), self.w, self.h
        m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
        for step in range(1, p.steps + 1):
            pick = g.integers(0, len(pages), min(p.batch, len(pages)))
            x, n = self._pad([pages[i][0] for i in pick])
            want = np.full(x.shape[:2], -1)
            for j, i in enumerate(pick):
                want[j, : n[j]] = pages[i][1]
            y, both, live, back, xb, kf, kb = self._both(x, n)
            known = (want >= 0).astype(np.float32)
            dl = ((y - want) * known / max(1, known.sum())).astype(np.float32)[..., None]
            grad = {"O": np.einsum("btd,btc->dc", both, dl), "o": dl.sum((0, 1))}
            db = dl @ w["O"].T
            for k, kept, inputs, ds in (("f", kf, x, db[..., :h]), ("b", kb, xb, np.take_along_axis(db[..., h:], back[..., None], 1))):
                gw, gu = np.zeros_like(w[f"W{k}"]), np.zeros((*x.shape[:2], 4 * h), np.float32)
                cs = cc = np.zeros((len(x), h), np.float32)
                for t in range(x.shape[1] - 1, -1, -1):
                    s, c, i, f, o, gg, th = kept[t]
                    on = live[:, t : t + 1]
                    total = cs + ds[:, t]
                    dn = total * on
                    dc = (cc * on) + dn * o * (1 - th * th)
                    du = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dn * th * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                    gu[:, t] = du
                    gw += s.T @ du
                    cs, cc = total * ~on + du @ w[f"W{k}"].T, cc * ~on + dc * f
                grad[f"W{k}"], grad[f"c{k}"], grad[f"I{k}"] = gw, gu.sum((0, 1)), np.einsum("btd,btu->du", inputs, gu, optimize=True)
            rate = p.rate * min(1, 2 * (1 - step / (p.steps + 1)))
            for k, gr in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * gr
                m2[k] = 0.99 * m2[k] + 0.01 * gr * gr
                w[k] = (w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.trained = True


def fit(pages: list[str], p: HtmlParameters) -> BlockLabeller:
    model = BlockLabeller(p)
    cut = [b for b in (blocks(x) for x in pages) if b]
    # features are those of the whole page; of a long one the blocks at both ends are learned from
    ends = lambda x: x if len(x) <= p.sample_blocks else np.concatenate([x[: p.sample_blocks // 2], x[-(p.sample_blocks // 2) :]])
    known = [(ends(features(b)), ends(np.array([y.label for y in b]))) for b in cut]
    known = [k for k in known if (k[1] >= 0).any()]
    if any((y == 1).any() for _, y in known):
        model.train(known, p)
    return model


def extract(pages: DataFrame, parameters: HtmlParameters | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""
    p = parameters or HtmlParameters()
    d = base_columns(pages, page_id=id_col, url=url_col, html=html_col)
    able = d.filter(F.octet_length("html") <= p.sample_page_bytes)
    n = able.count()
    sample = able.filter(F.pmod(F.xxhash64("page_id", "html"), F.lit(max(1, n // p.sample_pages))) == 0).select("html").limit(2 * p.sample_pages).collect()
    sample = sample or able.select("html").limit(p.sample_pages).collect()  # equal rows may all miss the share
    shared = pages.sparkSession.sparkContext.broadcast(fit([r["html"] or "" for r in sample], p))  # a few thousand weights
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                cut = [blocks(x or "") for x in batch.column("html").to_pylist()]
                some = [i for i, b in enumerate(cut) if b] if model.trained else []
                texts = [""] * len(cut)
                for i, y in zip(some, model.label([features(cut[i]) for i in some]) if some else [], strict=True):
                    texts[i] = "\n".join(b.text for b, v in zip(cut[i], y.tolist(), strict=True) if v > 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return d.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
