"""Byte-level BPE encoding with a public vocabulary, in batched numpy merge rounds.

The words of many texts that are not cached yet are laid out as one flat array of byte
symbols. Each round forms the keys of all adjacent pairs, finds their merge ranks by binary
search over the sorted pair keys, takes for each word the lowest rank and merges every
occurrence of it. Words without a known pair leave the array, so that later rounds are short.

Null and empty texts give an empty list. Text that looks like a special token is ordinary
text. Lone surrogates, which UTF-8 cannot hold, count as U+FFFD.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import ship

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
CACHE_WORDS = 400_000
CACHE_IDS = 12_000_000
PART_CHARS = 1 << 20
SLOT_BITS = 20

# The contractions and white space of the published word pattern
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
ODD = 0x9E3779B97F4A7C15


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point."""
    majors = {"L": LETTER, "N": NUMBER}
    table = np.array([majors.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[WHITE] = SPACE
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of the words [begin, end), which come in order and don't overlap.

    Every code point is hashed together with its place in the word before the sum is taken, so
    that no regular pattern of letters (as in Thue-Morse words under a polynomial) makes two
    words collide.
    """
    sizes = ends - begins
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    shift = np.repeat(begins - starts, sizes)
    at = np.arange(total) + shift
    place = (at - np.repeat(begins, sizes)).astype(np.uint64)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(mixed((place << np.uint64(32) | points[at]) * np.uint64(ODD) + np.uint64(ODD)), out=sums[1:])
    return mixed(sums[starts + sizes] - sums[starts] + sizes.astype(np.uint64))


def word_bounds(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin in a flat array of code points; ``first`` has the begins of (non-empty) texts."""
    kind = classes()[points]
    n = len(points)
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[first] = True
    # the last white character before a word stands alone; a blank is part of the word
    white_end = np.flatnonzero(begins[1:] & (kind[:-1] == SPACE))
    inner = white_end[~np.isin(white_end + 1, first, assume_unique=True)] if len(white_end) else white_end
    blank = points[inner] == 0x20
    begins[inner] = True
    begins[inner[blank] + 1] = False
    # a contraction, where an apostrophe begins a word
    marks = np.flatnonzero((points == 0x27) & begins)
    if len(marks):
        padded = np.concatenate([points[: n], np.zeros(3, points.dtype)])
        text_end = np.append(first[1:], n)
        limit = text_end[np.searchsorted(first, marks, side="right") - 1]
        a, b = padded[marks + 1], padded[marks + 2]
        size = np.zeros(len(marks), np.int64)
        for c in CONTRACTIONS:
            hit = (a == ord(c[0])) & ((b == ord(c[-1])) | (len(c) == 1)) & (marks + len(c) < limit) & (size == 0)
            size[hit] = len(c)
        marks, size, limit = marks[size > 0], size[size > 0], limit[size > 0]
        begins[marks + 1] = False
        two = marks[size == 2]
        begins[two + 2] = False
        after = marks + size + 1
        begins[after[after < limit]] = True
    return np.flatnonzero(begins)


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file, by the published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    symbols = {chr(b): b for b in plain}
    spare = 256
    for b in range(256):
        if b not in plain:
            symbols[chr(spare)] = b
            spare += 1
    return symbols


class Encoder:
    """Word splitting, merge tables and a bounded word cache of one worker process."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for symbol, byte in byte_symbols().items():
            self.byte_id[byte] = vocab[symbol]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = int(max(vocab.values())) + 1
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.by_rank = merged
        self.no_rank = len(pairs)
        self.bytes_of = np.zeros(self.width, np.int64)
        for symbol, i in vocab.items():
            self.bytes_of[i] = len(symbol)  # each character stands for a byte
        self._reset()

    def _reset(self) -> None:
        self.slot_key, self.slot_place = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int64)
        self.rest_key, self.rest_place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars, self.char_starts, self.char_lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.clashing: dict[bytes, int] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word."""
        counts = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words), dtype=np.int64), counts)
        done_ids: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        while len(symbols):
            joined = owner[:-1] == owner[1:]
            keys = symbols[:-1] * self.width + symbols[1:]
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            rank = np.where(joined & (self.keys[at] == keys), self.ranks[at], self.no_rank)
            rank = np.append(rank, self.no_rank)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            spans = np.diff(np.append(first, len(owner)))
            open_word = lowest < self.no_rank
            best = np.repeat(np.where(open_word, lowest, -1), spans)
            chosen = np.flatnonzero(rank == best)
            if len(chosen) > 1 and (np.diff(chosen) == 1).any():
                # runs of touching matches (as in "aaaa"): every other one from the left of its run
                run_start = np.append(True, np.diff(chosen) != 1)
                place = np.arange(len(chosen)) - np.maximum.accumulate(np.where(run_start, np.arange(len(chosen)), 0))
                chosen = chosen[place % 2 == 0]
            if len(chosen):
                symbols[chosen] = self.by_rank[rank[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            stays = np.repeat(open_word, spans)
            closed = keep & ~stays
            done_ids.append(symbols[closed])
            done_owner.append(owner[closed])
            keep &= stays
            symbols, owner = symbols[keep], owner[keep]
        if not done_ids:
            return np.zeros(0, np.int32), counts
        ids, owners = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owners, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owners, minlength=len(words)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of words by key, -1 for unknown ones: one slot for each key, a sorted list for those whose slot was taken."""
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        places = np.where(self.slot_key[slot] == keys, self.slot_place[slot], -1)
        left = np.flatnonzero(places < 0)
        if len(left) and len(self.rest_key):
            at = np.searchsorted(self.rest_key, keys[left])
            at[at == len(self.rest_key)] = 0
            places[left] = np.where(self.rest_key[at] == keys[left], self.rest_place[at], -1)
        return places

    def _store(self, words: list[str]) -> np.ndarray:
        """Encodes words and keeps them with their code points. Returns their places."""
        ids, lengths = self.merge([w.encode("utf-8", "replace") for w in words])
        places = len(self.starts) + np.arange(len(words))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.char_starts = np.concatenate([self.char_starts, len(self.chars) + np.cumsum(sizes) - sizes])
        self.char_lengths = np.concatenate([self.char_lengths, sizes])
        self.chars = np.concatenate([self.chars, np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)])
        return places

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        places = self._store(words)
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        free = self.slot_place[slot] < 0
        _, once = np.unique(slot, return_index=True)
        own = np.zeros(len(keys), bool)
        own[once] = True
        own &= free
        self.slot_key[slot[own]], self.slot_place[slot[own]] = keys[own], places[own]
        rest_key, rest_place = np.concatenate([self.rest_key, keys[~own]]), np.concatenate([self.rest_place, places[~own]])
        order = np.argsort(rest_key)
        self.rest_key, self.rest_place = rest_key[order], rest_place[order]

    def _verify(self, places: np.ndarray, points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """Compares every word with the one it was found as; words that only share a key get places of their own."""
        sizes = ends - begins
        wrong = self.char_lengths[places] != sizes
        starts = np.where(wrong, 0, self.char_starts[places])
        seen = np.repeat(starts - begins, sizes) + np.arange(len(points))
        seen[np.repeat(wrong, sizes)] = 0
        differing = np.flatnonzero(self.chars[seen] != points)
        wrong[np.searchsorted(begins, differing, side="right") - 1] = True
        for i in np.flatnonzero(wrong).tolist():
            word = points[begins[i] : ends[i]].tobytes()
            if word not in self.clashing:
                self.clashing[word] = int(self._store([word.decode("utf-32-le", "surrogatepass")])[0])
            places[i] = self.clashing[word]

    def word_places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the cache of all words of ``texts``, and the number of words of each text.

        A word is looked up by a 64-bit key and then compared with the one that is kept there.
        """
        if len(self.starts) > CACHE_WORDS or len(self.flat) + len(self.chars) > CACHE_IDS:
            self._reset()
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        begins = word_bounds(points, first)
        ends = np.append(begins[1:], len(points))
        keys = word_keys(points, begins, ends)
        places = self._find(keys)
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            new, at = np.unique(keys[unknown], return_index=True)
            at = unknown[at]
            self._learn(new, [whole[a:b] for a, b in zip(begins[at].tolist(), ends[at].tolist())])
            places[unknown] = self._find(keys[unknown])
        self._verify(places, points, begins, ends)
        counts = np.zeros(len(texts), np.int64)
        counts[sizes > 0] = np.diff(np.append(np.searchsorted(begins, first), len(begins)))
        return places, counts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        places, words = self.word_places(texts)
        ends = np.cumsum(words)
        total = np.concatenate([[0], np.cumsum(self.lengths[places])])
        return total[ends] - total[ends - words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text in them."""
        places, words = self.word_places(texts)
        lengths, starts = self.lengths[places], self.starts[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(starts - (ends - lengths), lengths)
        ids = self.flat[shift + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
        return ids, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> Encoder:
    """The encoder of this process for one vocabulary file."""
    file = os.path.join(tokenizer_dir, f"{name}.json")
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about PART_CHARS characters, so that one batch of long texts stays small in memory."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PART_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(key, ids array<int>) of every row; an empty list for null and for empty text. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_dir, name)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                ids, bounds = own.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(key, text).mapInArrow(run, schema)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens bigint) of every row; 0 for null and for empty text. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_dir, name)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own.counts(texts[a:b]), pa.int64())], names=[key, "n_tokens"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema)


def decoded_sizes(encoded: DataFrame, key: str = "doc_id", tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(key, n_bytes bigint): bytes that the ids of each row stand for. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_dir, name)
        for batch in batches:
            ids = batch.column(1)
            total = np.concatenate([[0], np.cumsum(own.bytes_of[ids.flatten().to_numpy()])])
            ends = ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total[ends[1:]] - total[ends[:-1]])], names=[key, "n_bytes"])

    schema = T.StructType([T.StructField(key, encoded.schema[key].dataType), T.StructField("n_bytes", T.LongType())])
    return encoded.select(key, "ids").mapInArrow(run, schema)


def corpus_token_stats(encoded: DataFrame) -> DataFrame:
    """(n_docs, n_empty, n_tokens, longest) over an encoded corpus."""
    n = F.size("ids").cast("bigint")
    return encoded.agg(F.count("*").alias("n_docs"), F.count_if(n == 0).alias("n_empty"), F.coalesce(F.sum(n), F.lit(0)).alias("n_tokens"), F.coalesce(F.max(n), F.lit(0)).alias("longest"))
