"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can end its encoding. Going through the word once, an automaton over the
vocabulary reports all tokens that end at a place (suffix matches); the one that is compatible with the unique last
token of the prefix before it is stored. Following the stored tokens back from the end of the word gives the ids that
merging in rank order would give, in time linear in the word (times the tokens that end at one place).

Two tokens are compatible if merging in rank order never joins symbols across their border: their last merges are
undone, the later one first, and no pair across the border may have a merge that comes earlier than those undone.

Defined results: null text counts as empty (0 tokens, hashes of the empty string). Ties and repeated rows are encoded
alike. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import base_columns, worker_table
from .subwords import PIECES, ChunkTable, byte_letters, small_batches

# fixed value: end-of-word mark of the word vocabulary
END = "</w>"


#: Bytes of the remembered pieces, with their ids, about.
PIECE_BYTES = 32_000_000


class PrefixEncoder:
    """Encodes one word (bytes) at a time. Symbols are characters: byte b is chr(1 + b), at the word's end chr(301 + b)."""

    def __init__(self, path: str, pair_cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbol = {c: chr(1 + b) for b, c in byte_letters().items()} | {c + END: chr(301 + b) for b, c in byte_letters().items()}
        # order[id]: symbols first, then merged tokens by rank. All comparisons below are on this order.
        self.order, self.left, self.right, self.pairs = {}, {}, {}, {}
        for t in symbol:
            if t in vocab:
                self.order[vocab[t]] = len(self.order)
        self.n_symbols = len(self.order)
        ids = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        for _, _, c in ids:
            self.order.setdefault(c, len(self.order))
        self.ids = sorted(self.order, key=self.order.get)
        o = self.order
        reachable = [True] * self.n_symbols + [False] * (len(o) - self.n_symbols)
        for a, b, c in ids:
            a, b, c = o[a], o[b], o[c]
            self.pairs.setdefault((a, b), c)
            if c not in self.left:
                self.left[c], self.right[c] = a, b
        for c in range(self.n_symbols, len(o)):
            a, b = self.left[c], self.right[c]
            reachable[c] = reachable[a] and reachable[b] and self._apart(a, b, c)
        spelled = [symbol[self.tokens[self.ids[c]]] for c in range(self.n_symbols)]
        self.automaton = ahocorasick.Automaton()
        for c in range(len(o)):
            if c >= self.n_symbols:
                spelled.append(spelled[self.left[c]] + spelled[self.right[c]])
            if reachable[c]:
                self.automaton.add_word(spelled[c], (c, len(spelled[c])))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        self.pair_cache = pair_cache

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """No merge before ``limit`` joins symbols across the border of a and b."""
        pairs, n = self.pairs, self.n_symbols
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a < n and b < n:
                return True
            if a > b:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= self.pair_cache:
                self.known.clear()
            got = self.known[key] = self._apart(a, b, len(self.ids))
        return got

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given as symbols."""
        n = len(symbols)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        known, slow = self.known.get, self.compatible
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = known(before << 20 | token)
                if not (slow(before, token) if fits is None else fits):
                    continue
            last[end], size[end] = token, length
        out = []
        while n:
            out.append(self.ids[last[n]])
            n -= size[n]
        return out[::-1]


class Codec:
    """Whole-chunk encoding (special tokens, NFC, lower case, pieces) on top of PrefixEncoder, and decoding."""

    def __init__(self, path: str):
        self.encoder = PrefixEncoder(path)
        self.lower = {i: chr(i).lower() for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).lower() != chr(i)}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.encoder.special)) + ")")
        self.mark = "<|"
        self.inner = {b: chr(1 + b) for b in range(256)}
        self.pieces: dict[str, list[int]] = {}
        self.piece_bytes = 0
        self.names = [self.encoder.tokens.get(i, "") for i in range(max(self.encoder.tokens) + 1)]
        self.decimals = [str(i) for i in range(len(self.names))]

    def piece(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is None:
            raw = piece.encode("utf-8")
            if self.piece_bytes > PIECE_BYTES:
                self.pieces.clear()
                self.piece_bytes = 0
            self.piece_bytes += 200 + 10 * len(raw)
            symbols = raw[:-1].decode("latin-1").translate(self.inner) + chr(301 + raw[-1])
            got = self.pieces[piece] = self.encoder.word(symbols)
        return got

    def chunk(self, chunk: str) -> list[int]:
        if self.mark in chunk and self.special.search(chunk):
            out: list[int] = []
            for part in self.special.split(chunk):
                if part in self.encoder.special:
                    out.append(self.encoder.special[part])
                elif part:
                    out += self.plain(part)
            return out
        return self.plain(chunk)

    def plain(self, text: str) -> list[int]:
        if text.isascii():
            text = text.lower()
        else:
            # per character: no rule that looks at neighbours, as for a final sigma
            text = unicodedata.normalize("NFC", text).translate(self.lower)
        out: list[int] = []
        for p in PIECES.findall(text):
            out += self.piece(p)
        return out

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False) of a vocabulary without decoder: token texts with single spaces."""
        names = self.names
        return " ".join([names[i] for i in ids])


def codec(path: str) -> tuple[Codec, ChunkTable]:
    """One per worker process."""

    def make() -> tuple[Codec, ChunkTable]:
        c = Codec(path)
        return c, ChunkTable(lambda new: [c.chunk(x.decode("utf-8")) for x in new])

    return worker_table(f"codec {path}", make)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, and decoded again from its ids."""
    source = base_columns(docs, doc_id=id_col, text=text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, table = codec(vocabulary)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n, ids_hash, text_hash = [], [], []
            for a, b in small_batches(texts):
                ids, at = table.ids(texts[a:b])
                ids, at = ids.tolist(), at.tolist()
                for i in range(b - a):
                    own = ids[at[i] : at[i + 1]]
                    n.append(len(own))
                    decimals = c.decimals
                    ids_hash.append(hashlib.sha256(" ".join([decimals[x] for x in own]).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(c.decode(own).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
