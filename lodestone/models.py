"""Embedding models by name, and one without weights.

A model is anything with ``name``, ``dimension`` and ``embed_batch``; ``load_model`` makes the one
that is registered under a name. ``tokens-<n>`` is always there: the mean of one pseudo-random
unit vector for each term of a text, scaled to unit length. Texts that share terms are alike in it,
so it serves where no trained model is at hand, and in tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np

from lodestone.functions.text import tokenize


class EmbeddingModel(Protocol):
    name: str
    dimension: int

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashedTokens:
    """Mean of the vectors of a text's terms; a text without terms has no direction and is all zero."""

    def __init__(self, dimension: int = 96) -> None:
        self.name, self.dimension = f"tokens-{dimension}", dimension
        self._vector = lru_cache(maxsize=50_000)(self._make)

    def _make(self, term: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.blake2b(term.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        v = np.random.default_rng(seed).standard_normal(self.dimension)
        return v / np.linalg.norm(v)

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            terms = tokenize(text or "")
            total = np.sum([self._vector(t) for t in terms], axis=0) if terms else np.zeros(self.dimension)
            length = float(np.linalg.norm(total))
            out.append((total / length if length else total).tolist())
        return out

    def __reduce__(self) -> tuple:  # caches stay behind when a model is sent to workers
        return HashedTokens, (self.dimension,)


_MODELS: dict[str, Callable[[], EmbeddingModel]] = {}


def register_model(name: str, make: Callable[[], EmbeddingModel]) -> None:
    _MODELS[name] = make


def load_model(name: str) -> EmbeddingModel:
    """The model of a name; an unknown one is an error that names those there are."""
    if name in _MODELS:
        return _MODELS[name]()
    kind, _, size = name.partition("-")
    if kind == "tokens" and size.isdigit() and int(size) > 0:
        return HashedTokens(int(size))
    raise KeyError(f"no model {name!r}; there are {', '.join([*sorted(_MODELS), 'tokens-<n>'])}")
