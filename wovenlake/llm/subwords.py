"""Token ids of whole texts through a bounded table of white-space chunks.

Texts are UTF-8 bytes here, and bytes.split() cuts at ASCII white space only. Neither normalisation nor
pre-tokenisation of the word vocabulary looks across white space, so the ids of a text are the ids of its chunks in a
row. Chunks recur, so each Python worker keeps a table from chunk to ids, bounded by the bytes of its chunks and ids; a
full table is emptied and filled again, so results don't depend on it (with keep_seen it keeps the chunks that came
again since it was last full). It is a worker_table: a worker holds one.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex

from .shared import worker_table

#: Bytes that one worker's table holds: about TABLE_ENTRY for each chunk, its text, and four for each id.
TABLE_BYTES, TABLE_ENTRY = 96_000_000, 110


def chunks(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space. Pure ASCII is lower-cased at once, as the vocabulary has no upper case
    (not beside other characters, since composition comes before lower-casing, nor beside special tokens)."""
    return (text.lower() if text.isascii() and b"<|" not in text else text).split()


class ChunkTable:
    """encode_many turns a list of chunks into id lists. About ``cap`` bytes are remembered. digest: a 64-bit hash that
    is kept for each chunk as well. keep_seen: a full table keeps chunks that came again, where half of cap holds them."""

    def __init__(self, encode_many: Callable[[list[bytes]], Iterable[list[int]]], cap: int = TABLE_BYTES, digest: Callable[[bytes], int] | None = None, keep_seen: bool = False):
        self.encode_many, self.cap, self.digest, self.keep_seen = encode_many, cap, digest, keep_seen
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.text_bytes, self.digests, self.seen = 0, np.zeros(0, np.uint64), np.zeros(0, bool)
        self.starts, self.lengths, self.flat, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1 << 16, np.uint32), 0

    def _make_room(self) -> None:
        """Empty the table; with keep_seen only of chunks that didn't come again, unless too many did."""
        seen = self.seen[: len(self.index)]
        kept, (ids, ends), digests = list(itertools.compress(self.index, seen)), self.ids_of_rows(np.flatnonzero(seen)), self.digests[: len(seen)][seen[: len(self.digests)]]
        text_bytes = sum(map(len, kept))
        self.clear()
        if self.keep_seen and kept and self._bytes(len(kept), text_bytes, len(ids)) <= self.cap / 2:
            self.index, self.text_bytes, self.digests = dict(zip(kept, range(len(kept)), strict=True)), text_bytes, digests
            self.starts, self.lengths, self.seen = ends[:-1].astype(np.int32), np.diff(ends).astype(np.int32), np.zeros(len(kept), bool)
            self.flat, self.used = np.concatenate([ids, self.flat]), len(ids)

    @staticmethod
    def _bytes(chunks: int, text_bytes: int, ids: int) -> int:
        return TABLE_ENTRY * chunks + text_bytes + 4 * ids

    def _learn(self, new: list[bytes]) -> None:
        lists = list(self.encode_many(new))
        lengths = np.fromiter(map(len, lists), np.int32, len(lists))
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(lengths.sum(dtype=np.int64)))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        n = len(self.index)
        if n + len(new) > len(self.starts):
            grown = max(1 << 12, 2 * (n + len(new)))
            self.starts, self.lengths = (np.concatenate([x[:n], np.zeros(grown - n, np.int32)]) for x in (self.starts, self.lengths))
        if len(self.seen) < len(self.starts):
            self.seen = np.concatenate([self.seen[:n], np.zeros(len(self.starts) - n, bool)])
        if self.digest:
            if len(self.digests) < len(self.starts):
                self.digests = np.concatenate([self.digests[:n], np.zeros(len(self.starts) - n, np.uint64)])
            self.digests[n : n + len(new)] = np.fromiter(map(self.digest, new), np.uint64, len(new))
        self.starts[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(new)] = lengths
        self.index.update(zip(new, range(n, n + len(new)), strict=True))
        self.used += len(ids)
        self.text_bytes += sum(map(len, new))

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Table row of every word; call it once per small batch, as it may empty the table first."""
        if self._bytes(len(self.index), self.text_bytes, self.used) > self.cap:
            self._make_room()
        got = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int32, len(words))
        missing = np.flatnonzero(got < 0)
        if self.keep_seen:
            self.seen[got[got >= 0]] = True
        if len(missing):
            lost = [words[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(lost)))
            got[missing] = np.fromiter(map(self.index.__getitem__, lost), np.int32, len(lost))
        return got

    def known(self, chunk: bytes) -> list[int] | None:
        """Ids of a chunk that the table holds."""
        i = self.index.get(chunk)
        return None if i is None else self.flat[self.starts[i] : self.starts[i] + self.lengths[i]].tolist()

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start (one more entry than texts)."""
        split = [chunks(t) for t in texts]
        ids, ends = self.ids_of_rows(self.rows(list(itertools.chain.from_iterable(split))))
        return ids, ends[np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)]

    def ids_of_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of table rows in a row, and where each row's ids start (one more entry than rows)."""
        lengths = self.lengths[rows]
        ends = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        places = np.arange(ends[-1], dtype=np.int32)
        places += np.repeat(self.starts[rows] - ends[:-1].astype(np.int32), lengths)
        return self.flat[places], ends


def small_batches(texts: list[bytes], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


#: Chunks whose normal form and pieces are plain: printable characters below U+0180, which no composition changes.
PLAIN = regex.compile("[!-~¡-¬®-ſ]+")
# fixed values: pre-tokenisation of the word vocabulary
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The usual printable letter for each byte: printable Latin-1 stands for itself, others go from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def _library_table(path: str, digest: Callable[[bytes], int] | None = None, keep_seen: bool = False) -> ChunkTable:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    model, letters = t.model, byte_letters()

    def cut(text: str) -> list[int]:
        if text.isascii() and text.isalpha():  # one plain piece
            return [token.id for token in model.tokenize(text.lower())]
        if "<|" in text or not PLAIN.fullmatch(text):
            return t.encode(text, add_special_tokens=False).ids
        text = text.lower()
        pieces = [text] if text.isalpha() else PIECES.findall(text)
        if not text.isascii():
            pieces = [x.encode("utf-8").decode("latin-1").translate(letters) for x in pieces]
        return [token.id for x in pieces for token in model.tokenize(x)]

    stops = {x: cut(x) for x in ",.;:!?"}

    def encode_many(new: list[bytes]) -> Iterator[list[int]]:
        for raw in new:
            text = raw.decode("utf-8")
            word = text[:-1]
            if word.isalpha() and text[-1] in stops:  # letters and one mark: two pieces, the first often known
                yield (table.known(raw[:-1]) or cut(word)) + stops[text[-1]]
            else:
                yield cut(text)

    table = ChunkTable(encode_many, digest=digest, keep_seen=keep_seen)
    return table


def library_table(path: str, digest: Callable[[bytes], int] | None = None, keep_seen: bool = False) -> ChunkTable:
    """Chunks encoded by the tokenizers library, one table per worker process.

    Plain chunks are lower-cased and cut into pieces here and go to the library's BPE model; its normaliser and its
    pre-tokeniser, which take most of its time on single words, see all others.
    """
    return worker_table(f"library ids {path} {digest} {keep_seen}", lambda: _library_table(path, digest, keep_seen))
