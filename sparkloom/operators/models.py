"""Stand-ins behind the model interfaces; any function of the same shape takes their place."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From texts to one vector each; runs once a batch, so that a model can be loaded once a worker.
Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(dimension: int = 64) -> Embedder:
    """Word hashes with signs, summed and scaled to length 1: the same text has the same vector everywhere."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def tracing_embedder(texts: list[str]) -> np.ndarray:
    """In a model's place where what it was given must be seen: a text's length, its last word's and its last character."""
    ends = [(len(t), len(t.rsplit(" ", 1)[-1]), ord(t[-1]) if t else 0) for t in texts]
    return np.array(ends, np.float64).reshape(len(texts), 3)


def letter_embedder(texts: list[str]) -> np.ndarray:
    """In a model's place where another language must get the same vectors: how often each of a to z occurs, to length 1."""
    counts = np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], np.float64).reshape(len(texts), 26)
    norm = np.sqrt((counts**2).sum(1, keepdims=True))
    return counts / np.where(norm == 0, 1, norm)


def embedding(embedder: Embedder) -> Callable[[Column | str], Column]:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder(texts.fillna("").tolist()).astype(np.float32)))

    return embed


#: From a query and a passage, both columns, to their score as a pair.
Scorer = Callable[[Column, Column], Column]


def cross_encoder(score: Callable[[list[str], list[str]], np.ndarray], longest: int = 512) -> Scorer:
    """A scorer that runs `score` on batches of queries and passages, each cut at `longest` words."""

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cut = lambda texts: [" ".join((t or "").split()[:longest]) for t in texts]
        for queries, passages in batches:
            yield pd.Series(np.asarray(score(cut(queries), cut(passages)), np.float64))

    return lambda query, passage: scored(query, passage)


def lexical_scorer(query: Column, passage: Column) -> Column:
    """A scorer without a model: the terms that a passage meets less those that it misses."""
    from sparkloom.operators.terms import literal_terms

    return lexical_score(literal_terms(query), passage).cast("double")


def lexical_score(terms: Column, body: Column) -> Column:
    """In a cross-encoder's place: terms met less terms missed, per term."""
    from sparkloom.functions.text import matching_terms

    n = F.size(terms)
    return F.when(n == 0, F.lit(0.0)).otherwise((2 * matching_terms(terms, body) - n) / n)
