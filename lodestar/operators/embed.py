"""Embedding strategies: term weights projected to a few dimensions, an injected model, and a router between them."""

from __future__ import annotations

import hashlib
import math
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .. import tables
from ..functions import text as X
from . import retrieve


def signs(term: str, dims: int) -> np.ndarray:
    """A row of the random projection: +1 or -1 for each dimension, from the term's MD5, 32 dimensions a digest.

    Any engine can compute it, and it depends on the term alone: documents embedded
    with different vocabularies stay comparable.
    """
    digits = "".join(hashlib.md5(f"{term}|{k}".encode()).hexdigest() for k in range(-(-dims // 32)))[:dims]
    return np.array([1.0 if c >= "8" else -1.0 for c in digits])


class Embedder(ABC):
    """A strategy that turns texts into unit vectors."""

    @abstractmethod
    def fit(self, texts: DataFrame, column: str = "text") -> Embedder:
        """Learns what it needs from a corpus."""

    @abstractmethod
    def embed(self, text: Column) -> Column:
        """An array<double> of length 1, or of zeros where nothing is known."""

    @property
    def available(self) -> bool:
        return True


class TermEmbedder(Embedder):
    """Log-scaled counts times idf over the commonest terms, projected by random signs.

    The vocabulary has at most ``most`` terms and travels with the function.  Without
    any term in the corpus a fixed list of terms, of equal weight, takes its place.
    """

    def __init__(self, dims: int = 256, most: int = 4096):
        self.dims, self.most, self.vocabulary = dims, most, {}

    def fit(self, texts: DataFrame, column: str = "text") -> TermEmbedder:
        tables.bound_batches(texts.sparkSession)
        statistics = retrieve.term_statistics(texts, X.term_tokens(F.col(column)))
        n = texts.agg(F.count(F.lit(1)).alias("n"))
        found = retrieve.vocabulary(statistics, n, self.most).collect()  # ``most`` rows at most
        out = TermEmbedder(self.dims, self.most)
        out.vocabulary = {r["term"]: r["idf"] for r in found} or dict.fromkeys(S.FALLBACK_TERMS, 1.0)
        out.dims = min(self.dims, max(len(out.vocabulary), 8))
        return out

    def embed(self, text: Column) -> Column:
        vocabulary, dims = self.vocabulary, self.dims
        if not vocabulary:
            raise ValueError("fit() comes first")

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            row = lru_cache(len(vocabulary))(lambda t: signs(t, dims))
            for tokens in batches:
                out = []
                for own in tokens:
                    v = np.zeros(dims)
                    for t, n in sorted(Counter(own if own is not None else ()).items()):
                        if t in vocabulary:
                            v += (1.0 + math.log(n)) * vocabulary[t] * row(t)
                    norm = math.sqrt(float(v @ v))
                    out.append(v / norm if norm > 1e-10 else v)
                yield pd.Series(out)

        return project(X.term_tokens(text))


class ModelEmbedder(Embedder):
    """A model given as a function from a list of texts to rows of numbers; None where there is none."""

    def __init__(self, model: Callable[[list[str]], Sequence[Sequence[float]]] | None):
        self.model = model

    @property
    def available(self) -> bool:
        return self.model is not None

    def fit(self, texts: DataFrame, column: str = "text") -> ModelEmbedder:
        return self

    def embed(self, text: Column) -> Column:
        model = self.model

        @F.pandas_udf("array<double>")
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                x = np.asarray(model(s.fillna("").tolist()), float).reshape(len(s), -1)
                norm = np.sqrt((x * x).sum(1, keepdims=True))
                yield pd.Series(list(np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-10)))

        return apply(text)


class Router(Embedder):
    """The first strategy that is available."""

    def __init__(self, *strategies: Embedder):
        self.strategies = strategies or (TermEmbedder(),)

    @property
    def chosen(self) -> Embedder:
        return next(s for s in self.strategies if s.available)

    @property
    def available(self) -> bool:
        return any(s.available for s in self.strategies)

    def fit(self, texts: DataFrame, column: str = "text") -> Embedder:
        return self.chosen.fit(texts, column)

    def embed(self, text: Column) -> Column:
        return self.chosen.embed(text)
