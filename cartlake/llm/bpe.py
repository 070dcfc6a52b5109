"""Byte-level BPE encoding and decoding: batched numpy merge rounds over the words of many texts.

Texts are cut into words by character class on one flat array of code points. All words that
the task has not met yet are merged together: their symbols lie in one flat array, and in each
round every word merges its lowest-ranked pair, found by binary search over the sorted pair
keys. The vocabulary is read once from the tokenizer's file and broadcast (its size is fixed).

A NULL text is encoded as an empty text: no ids, and an empty string when decoded. Repeated
rows, extra columns and texts of any length are kept as they are; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlake.llm.shipping import shipped
from cartlake.llm.words import text_chunks

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
               0x205F, 0x3000]
#: Words whose ids a task remembers; beyond that it starts over, which changes no result.
REMEMBERED_WORDS = 300_000
NO_RANK = np.iinfo(np.int32).max


def character_classes() -> np.ndarray:
    classes = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            classes[point] = LETTER
        elif major == "N":
            classes[point] = NUMBER
    classes[WHITE_SPACE] = SPACE
    return classes


def printable_bytes() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves, the other bytes for the characters from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Everything that encoding needs, as arrays; about 4 MB for 50,000 merges."""

    byte_ids: np.ndarray   # id of each single byte
    pair_keys: np.ndarray  # left id * size + right id, ascending
    pair_ranks: np.ndarray
    pair_ids: np.ndarray   # id of the merged symbol
    tokens: list[bytes]    # bytes of each id
    specials: dict[str, int]
    classes: np.ndarray

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *specials.values()])
        byte_of = printable_bytes()
        tokens = [b""] * size
        for token, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in specials.items():
            tokens[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        return cls(
            byte_ids=np.array([ids[c] for c in sorted(byte_of, key=byte_of.get)], np.int32),
            pair_keys=keys[order], pair_ranks=order.astype(np.int32),
            pair_ids=np.array([ids[a + b] for a, b in pairs], np.int32)[order],
            tokens=tokens, specials=specials, classes=character_classes())


def word_starts(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Marks the code points that begin a word; texts begin at ``offsets`` (the last one is the end).

    A run of letters, numbers or other characters is a word and takes one space before it along.
    White space before a word is one word without its last character. An apostrophe that stands
    alone after anything but a space joins the ending s, t, re, ve, m, ll or d behind it.
    """
    n = len(points)
    kind = classes[points]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= text_start
    start = change.copy()
    space = np.append(kind == SPACE, False)
    # The last white space before a word of the same text.
    last = np.flatnonzero(space[:n] & change[1:] & ~text_start[1:])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False

    padded = np.append(points, np.zeros(3, points.dtype))
    lone = np.flatnonzero((points == ord("'")) & change[:n] & change[1:] & ~text_start[1:])
    glued = (lone > 0) & (padded[lone - 1] == 0x20) & ~text_start[lone]
    lone = lone[~glued]
    one, two = padded[lone + 1], padded[lone + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    same_text = ~text_start[np.minimum(lone + 2, n)]
    long = same_text & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
    for found, length in ((lone[short], 2), (lone[long & ~short], 3)):
        start[found + 1] = False
        start[found + length] = True
    return start[:n]


def merged_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and how many each word has."""
    size, keys = len(vocabulary.tokens), vocabulary.pair_keys
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_words = [], []
    while len(symbols):
        rank = np.full(len(symbols), NO_RANK, np.int32)
        merged = np.zeros(len(symbols), np.int32)
        if len(keys):
            pair = symbols[:-1].astype(np.int64) * size + symbols[1:]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            known = (keys[at] == pair) & (word[1:] == word[:-1])
            rank[:-1][known] = vocabulary.pair_ranks[at[known]]
            merged[:-1][known] = vocabulary.pair_ids[at[known]]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
        finished = lowest == NO_RANK
        if finished.any():
            done_symbols.append(symbols[finished])
            done_words.append(word[finished])
        active = ~finished
        symbols, word, rank, merged, lowest = (x[active] for x in (symbols, word, rank, merged, lowest))
        chosen = np.flatnonzero(rank == lowest)
        if len(chosen):
            # Of overlapping equal pairs (a a a) every other one is merged, from the left.
            begins = np.concatenate(([True], chosen[1:] != chosen[:-1] + 1))
            run = np.maximum.accumulate(np.where(begins, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            symbols[chosen] = merged[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
    if not done_words:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def gathered(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[offsets[r]:offsets[r + 1]] of all rows one after the other, and their lengths."""
    lengths = offsets[rows + 1] - offsets[rows]
    skip = np.repeat(offsets[rows] - (np.cumsum(lengths) - lengths), lengths)
    return flat[np.arange(int(lengths.sum())) + skip], lengths


class Encoder:
    """Encodes and decodes batches; remembers the ids of words between batches."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self._code: dict[bytes, int] = {}
        self._flat = np.zeros(0, np.int32)
        self._offsets = np.zeros(1, np.int64)

    def _codes(self, words: list[bytes]) -> np.ndarray:
        if len(self._code) > REMEMBERED_WORDS:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self._code]
        if new:
            symbols, lengths = merged_words(new, self.vocabulary)
            self._code.update(zip(new, range(len(self._code), len(self._code) + len(new))))
            self._flat = np.concatenate((self._flat, symbols))
            self._offsets = np.concatenate((self._offsets, self._offsets[-1] + np.cumsum(lengths)))
        return np.fromiter(map(self._code.__getitem__, words), np.int64, len(words))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of texts without special tokens."""
        whole = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(word_starts(points, offsets, self.vocabulary.classes))
        width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        edges = np.concatenate(([0], np.cumsum(width)))[np.append(starts, len(points))].tolist()
        raw = whole.encode()
        words = [raw[a:b] for a, b in zip(edges, edges[1:])]
        codes = self._codes(words)
        ids, lengths = gathered(self._flat, self._offsets, codes)
        per_word = np.concatenate(([0], np.cumsum(lengths)))
        return ids, np.diff(per_word[np.searchsorted(starts, offsets)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; special tokens inside a text get their own id."""
        pieces, owner, special = [], [], []
        for i, text in enumerate(texts):
            for piece, token in self._around_specials(text or ""):
                pieces.append(piece)
                owner.append(i)
                special.append(token)
        ids, lengths = self._plain(pieces)
        if len(pieces) == len(texts):
            return np.split(ids, np.cumsum(lengths)[:-1]) if texts else []
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for i, token, part in zip(owner, special, np.split(ids, np.cumsum(lengths)[:-1])):
            parts[i] += [part] if token is None else [part, np.array([token], np.int32)]
        return [np.concatenate(p) for p in parts]

    def _around_specials(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Pieces of plain text, each with the id of the special token behind it; the last has none."""
        while True:
            found = [(text.index(s), -len(s), s) for s in self.vocabulary.specials if s in text]
            if not found:
                yield text, None
                return
            at, _, token = min(found)
            yield text[:at], self.vocabulary.specials[token]
            text = text[at + len(token):]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@cache
def _vocabulary(path: str) -> Vocabulary:
    """The driver reads a file once."""
    return Vocabulary.read(path)


def _mapped(docs: DataFrame, path: str, fields: dict[str, T.DataType], text: str, make) -> DataFrame:
    """``docs`` with new columns in place of any of the same name; make(encoder, text, ids) gives their values."""
    vocabulary = shipped(docs.sparkSession, _vocabulary(path))
    others = [f for f in docs.schema if f.name not in fields]
    schema = T.StructType([*others, *(T.StructField(n, t) for n, t in fields.items())])
    carried = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary())
        for batch in batches:
            for part in text_chunks(batch, text):
                texts = part[text].to_pylist()
                rows = [make(encoder, t, ids) for t, ids in zip(texts, encoder.encode(texts))]
                yield pa.RecordBatch.from_arrays(
                    [*(part[name] for name in carried), *(pa.array(c) for c in zip(*rows))], [*carried, *fields])

    return docs.select(*carried, *([text] if text not in carried else [])).mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens``."""
    return _mapped(docs, path, {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()}, text,
                   lambda encoder, t, ids: (ids, len(ids)))


def decoded(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the text that belongs to the ids; NULL ids give an empty text."""
    vocabulary = shipped(docs.sparkSession, _vocabulary(path))
    others = [f for f in docs.schema if f.name not in (text, ids)]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary())
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], np.int64)) for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(texts, pa.string())],
                                             [*names, text])

    return docs.select(*names, ids).mapInArrow(run, T.StructType([*others, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (little-endian, unsigned, 32 bits) and of the decoded text."""
    def row(encoder: Encoder, _: str | None, ids: np.ndarray) -> tuple[int, str, str]:
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(encoder.decode(ids).encode()).hexdigest())

    fields = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return _mapped(docs.select("doc_id", "text"), path, fields, "text", row).drop("text")
