"""A linear classifier of a query's tokens over hashed features, read from a model's bytes."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from waymark.runtime import ship_active

#: Fixed value: what a model begins with, before its dimension, number of classes, intercepts and weights.
MAGIC = b"GPML"


def token_features(tokens: list[str]) -> list[list[str]]:
    """Eleven named features of each token: itself, its neighbours, its ends, digits, length and place."""
    digits = [t != "" and t.isascii() and t.isdigit() for t in tokens]
    out, last = [], len(tokens) - 1
    for i, t in enumerate(tokens):
        before, after = tokens[i - 1] if i else "^", tokens[i + 1] if i < last else "$"
        some = any(c in "0123456789" for c in t)
        postcode = digits[i] and len(t) == 4 and i < last and len(after) == 2 and after.isalpha()
        named = {  # fixed values: the names and their order
            "w": t, "p": before, "n": after, "sfx": t[-3:], "pfx": t[:3], "dig": "1" if digits[i] else "m" if some else "0", "len": min(len(t), 7),
            "pos": "a" if i == 0 else "z" if i == last else "m", "d5": int(digits[i] and len(t) == 5), "d4n2": int(postcode), "pdig": int(i > 0 and digits[i - 1]),
        }
        out.append([f"{k}={v}" for k, v in named.items()])
    return out


class Tagger:
    """Weights by class and hashed feature; sums are made in single precision, in the order of the features."""

    def __init__(self, intercept: np.ndarray, weights: np.ndarray):
        self.intercept, self.weights = intercept.astype(np.float32), weights.astype(np.float32)
        if self.weights.ndim != 2 or len(self.intercept) != len(self.weights) or not self.weights.shape[1]:
            raise ValueError("a tagger needs a row of weights for each class")
        if not (np.isfinite(self.intercept).all() and np.isfinite(self.weights).all()):
            raise ValueError("a tagger's weights must be finite")
        self.place = lru_cache(1 << 16)(self._place)

    @classmethod
    def read(cls, model: bytes) -> Tagger:
        if model[:4] != MAGIC or len(model) < 9:
            raise ValueError("these bytes are no tagger")
        width, classes = struct.unpack_from("<IB", model, 4)
        values = np.frombuffer(model, "<f4", offset=9) if (len(model) - 9) % 4 == 0 else np.zeros(0, "<f4")
        if not classes or len(values) != classes * (1 + width):
            raise ValueError("a tagger's size doesn't fit its head")
        return cls(values[:classes], values[classes:].reshape(classes, width))

    def _place(self, feature: str) -> int:
        return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % self.weights.shape[1]

    def label(self, tokens: list[str]) -> list[int]:
        """The class of each token, the first of equals."""
        if not tokens:
            return []
        places = np.array([[self.place(f) for f in own] for own in token_features(tokens)])
        score = np.repeat(self.intercept[None, :], len(tokens), axis=0)
        for column in places.T:
            score = score + self.weights[:, column].T
        return score.argmax(axis=1).tolist()


def labels(tokens: Column, model: bytes) -> Column:
    """The class of each token of an array column, in Arrow batches; null and empty arrays have none."""
    Tagger.read(model)  # a bad model fails here, not on the executors
    ship_active()

    @F.pandas_udf("array<int>")
    def of(s: pd.Series) -> pd.Series:
        tagger = Tagger.read(model)
        return s.map(lambda t: tagger.label(list(t)) if t is not None else [])

    return of(tokens)
