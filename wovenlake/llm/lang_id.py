"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text forwards and backwards, words and the space between them, and labels every
position; a text's probabilities are the mean over all its positions. Long texts are read in windows of ``WINDOW``
bytes; each has ``MARGIN`` bytes of the text on both sides as context that isn't labelled, so every position is
labelled exactly once and sees the words around it. It is trained in numpy by backpropagation through time on pieces of
a bounded, stratified sample of labelled rows (about ``docs_per_language`` texts a language).

Only text decides a prediction. Defined results: a null text or one without a letter is ``und`` with score 0; so is
every text if no labelled row can be learned from. Ties go to the language first in order. Repeated rows get equal
results. Rows with a null id may be learned from (they aren't held out). An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import base_columns
from .subwords import small_batches

WINDOW, MARGIN = 224, 16
#: Length of a training piece; windows that are read together.
PIECE, BATCH_WINDOWS = 64, 1_024
ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class LangParameters:
    """docs_per_language and bytes_per_doc bound the training sample; the rest are sizes and steps."""

    docs_per_language: int = 150
    bytes_per_doc: int = 8_000
    hidden: int = 12
    embed: int = 8
    steps: int = 300
    batch: int = 96
    rate: float = 0.02
    seed: int = 11


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def to_matrix(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (rows padded with 256) and lengths."""
    n = np.fromiter(map(len, segments), np.int64, len(segments))
    out = np.full((len(segments), int(n.max())), 256, np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer(b"".join(segments), np.uint8)
    return out, n


class ByteNetwork:
    """Weights for both directions d in 'fb': X (input table), W (recurrent), and the position labeller O, o."""

    def __init__(self, languages: list[str], p: LangParameters):
        g = np.random.default_rng(p.seed)
        h = p.hidden
        f = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.languages, self.h = languages, h
        self.w = {"E": (g.standard_normal((257, p.embed)) * 0.5).astype(np.float32), "O": f(2 * h, len(languages)), "o": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.w |= {f"I{d}": f(p.embed, 3 * h), f"W{d}": f(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, keep: bool):
        """x (n, T) byte ids in reading order; live (n, T). States (T, n, h) and, for training, what a step used."""
        w, h, t = self.w, self.h, x.shape[1]
        table = w["E"] @ w[f"I{d}"] + w[f"c{d}"]
        s, states, kept = np.zeros((len(x), h), np.float32), np.zeros((t, len(x), h), np.float32), []
        for i in range(t):
            a, u = table[x[:, i]], s @ w[f"W{d}"]
            z, r = _sigmoid(a[:, :h] + u[:, :h]), _sigmoid(a[:, h : 2 * h] + u[:, h : 2 * h])
            n = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            new = n + z * (s - n)
            if keep:
                kept.append((s, z, r, n, u[:, 2 * h :]))
            s = np.where(live[:, i : i + 1], new, s)
            states[i] = s
        return states, kept

    def _both(self, x: np.ndarray, n: np.ndarray, keep: bool = False):
        t = x.shape[1]
        place = np.arange(t)
        live = place < n[:, None]
        back = np.where(live, n[:, None] - 1 - place, place)  # reading order of the backward pass, its own inverse
        xb = np.take_along_axis(x, back, 1)
        hf, kf = self._run("f", x, live, keep)
        hb, kb = self._run("b", xb, live, keep)
        both = np.concatenate([hf.transpose(1, 0, 2), np.take_along_axis(hb.transpose(1, 0, 2), back[..., None], 1)], 2)
        logits = both @ self.w["O"] + self.w["o"]
        logits -= logits.max(2, keepdims=True)
        y = np.exp(logits)
        y /= y.sum(2, keepdims=True)
        return y, both, live, back, xb, kf, kb

    def _read(self, d: str, x: np.ndarray) -> np.ndarray:
        """x (T, n) bytes in reading order; the direction's part of the logits (T, languages, n). What follows the end
        of a row comes after all of it has been read, so it needs no mask."""
        w, h = self.w, self.h
        # states lie in columns, so that every step works on whole rows; signs and the two of tanh(v) =
        # 2 / (1 + exp(-2 v)) - 1 are taken into the weights
        scale = np.repeat(np.array([-1, -1, -2], np.float32), h)
        table = np.ascontiguousarray(((w["E"] @ w[f"I{d}"] + w[f"c{d}"]) * scale).T)
        recurrent = np.ascontiguousarray((w[f"W{d}"] * scale).T)
        label = np.ascontiguousarray((w["O"][:h] if d == "f" else w["O"][h:]).T)
        s, out = np.zeros((h, x.shape[1]), np.float32), np.empty((len(x), len(label), x.shape[1]), np.float32)
        a, u = np.empty((3 * h, x.shape[1]), np.float32), np.empty((3 * h, x.shape[1]), np.float32)
        gates, new = u[: 2 * h], u[2 * h :]
        for i in range(len(x)):
            np.take(table, x[i], 1, out=a, mode="clip")
            np.matmul(recurrent, s, out=u)
            gates += a[: 2 * h]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new *= gates[h:]
            new += a[2 * h :]
            np.exp(new, out=new)
            new += 1
            np.divide(2, new, out=new)
            new -= 1
            s -= new
            s *= gates[:h]
            s += new
            np.matmul(label, s, out=out[i])
        return out

    def label_sums(self, windows: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Sum of the language probabilities of the positions from..to of each window (bytes, from, to)."""
        order = sorted(range(len(windows)), key=lambda i: len(windows[i][0]))
        out = np.zeros((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(order), BATCH_WINDOWS):
            pick = order[a : a + BATCH_WINDOWS]
            x, n = to_matrix([windows[i][0] for i in pick])
            place = np.arange(x.shape[1])
            back = np.where(place < n[:, None], n[:, None] - 1 - place, place)  # its own inverse
            logits = self._read("b", np.ascontiguousarray(np.take_along_axis(x, back, 1).T))
            logits = np.take_along_axis(logits, back.T[:, None, :], 0)
            logits += self._read("f", np.ascontiguousarray(x.T))
            logits += self.w["o"][:, None]
            np.exp(logits, out=logits)  # bounded by the width of the states
            low, high = (np.array([windows[i][k] for i in pick]) for k in (1, 2))
            logits *= (((place[:, None] >= low) & (place[:, None] < high)) / logits.sum(1))[:, None, :].astype(np.float32)
            out[pick] = logits.sum(0).T
        return out

    def text_means(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities of each text; zeros for an empty one."""
        windows, owner = [], []
        for k, t in enumerate(texts):
            t = t.lower()
            for at in range(0, len(t), WINDOW):
                first, end = max(0, at - MARGIN), min(len(t), at + WINDOW)
                windows.append((t[first : end + MARGIN], at - first, end - first))
                owner.append(k)
        out = np.zeros((len(texts), len(self.languages)))
        if windows:
            np.add.at(out, np.array(owner), self.label_sums(windows))
            total = out.sum(1, keepdims=True)
            np.divide(out, total, out=out, where=total > 0)
        return out

    def train(self, segments: list[list[bytes]], p: LangParameters) -> None:
        """segments[k]: training pieces of language k. Adam on the mean position loss of balanced batches."""
        g, w, h = np.random.default_rng(p.seed + 1), self.w, self.h
        m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
        each = max(1, p.batch // len(segments))
        label = np.repeat(np.arange(len(segments)), each)
        for step in range(1, p.steps + 1):
            x, n = to_matrix([s[i] for s in segments for i in g.integers(0, len(s), each)])
            y, both, live, back, xb, kf, kb = self._both(x, n, True)
            y[np.arange(len(y)), :, label] -= 1
            dl = y * (live[..., None] / live.sum()).astype(np.float32)
            grad = {"O": np.einsum("btd,btc->dc", both, dl, optimize=True), "o": dl.sum((0, 1)), "E": np.zeros_like(w["E"])}
            db = dl @ w["O"].T
            for d, kept, inputs, ds in (("f", kf, x, db[..., :h]), ("b", kb, xb, np.take_along_axis(db[..., h:], back[..., None], 1))):
                gw, gt, carry = np.zeros_like(w[f"W{d}"]), np.zeros((257, 3 * h), np.float32), np.zeros((len(x), h), np.float32)
                for i in range(x.shape[1] - 1, -1, -1):
                    s, z, r, nn, un = kept[i]
                    on = live[:, i : i + 1]
                    total = carry + ds[:, i]
                    dn = total * on
                    dz = dn * (s - nn) * z * (1 - z)
                    dpre = dn * (1 - z) * (1 - nn * nn)
                    dr = dpre * un * r * (1 - r)
                    da = np.concatenate([dz, dr, dpre], 1)
                    du = np.concatenate([dz, dr, dpre * r], 1)
                    gw += s.T @ du
                    np.add.at(gt, inputs[:, i], da)
                    carry = total * ~on + dn * z + du @ w[f"W{d}"].T
                grad[f"W{d}"], grad[f"c{d}"] = gw, gt.sum(0)
                grad[f"I{d}"] = w["E"].T @ gt
                grad["E"] += gt @ w[f"I{d}"].T
            rate = p.rate * min(1, 2 * (1 - step / (p.steps + 1)))
            for k, gr in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * gr
                m2[k] = 0.99 * m2[k] + 0.01 * gr * gr
                w[k] = (w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8"))))


def training_sample(docs: DataFrame, folds: int, fold: int, p: LangParameters) -> dict[str, list[bytes]]:
    """Texts per language from rows that aren't held out: a bounded share by a hash of the id."""
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.expr(f"coalesce(crc32(cast(doc_id as string)) % {folds} <> {fold}, true)"))
    counts = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, n // p.docs_per_language))])
    few = able.filter(F.pmod(F.xxhash64("doc_id"), F.element_at(share, F.col("lang")).cast("long")) == 0)
    out: dict[str, list[bytes]] = {}
    for r in few.select("lang", F.substring("text", 1, p.bytes_per_doc).alias("text")).limit(3 * p.docs_per_language * len(counts)).collect():
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def fit(sample: dict[str, list[bytes]], p: LangParameters) -> ByteNetwork | None:
    pieces = {k: [t[i : i + PIECE].lower() for t in v for i in range(0, len(t), PIECE)] for k, v in sorted(sample.items())}
    pieces = {k: v for k, v in pieces.items() if v}
    if not pieces:
        return None
    network = ByteNetwork(list(pieces), p)
    if len(pieces) > 1:
        network.train(list(pieces.values()), p)
    return network


def identify(docs: DataFrame, folds: int = 3, fold: int = 1, parameters: LangParameters | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs; carry adds columns of docs, unchanged."""
    p = parameters or LangParameters()
    network = fit(training_sample(base_columns(docs, doc_id=id_col, text=text_col, lang=lang_col), folds, fold, p), p)
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand weights
    carry = carry or []
    held = {f"k{i}": c for i, c in enumerate(carry)}
    source = base_columns(docs, doc_id=id_col, text=text_col, **held).withColumn("held_out", F.expr(f"coalesce(crc32(cast(doc_id as string)) % {folds} = {fold}, false)"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    names = ["doc_id", "held_out", *held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            pred, score = [], []
            for a, b in small_batches(texts):
                letters = [has_letter(t) for t in texts[a:b]]
                mean = net.text_means(texts[a:b]) if net else np.zeros((b - a, 1))
                best, top = mean.argmax(1).tolist(), mean.max(1).tolist()
                ok = [x and net is not None for x in letters]
                pred += [net.languages[k] if x else "und" for k, x in zip(best, ok, strict=True)]
                score += [min(1.0, s) if x else 0.0 for s, x in zip(top, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in names], "lang_pred string", "score double"])
    out = source.select("text", *names).mapInArrow(run, schema)
    return out.select("doc_id", "held_out", "lang_pred", "score", *[F.col(k).alias(f"kept_{c}") for k, c in held.items()])
