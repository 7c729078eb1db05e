"""The boundary to language, vision and embedding models.

A provider is a plain object that is sent to the executors; its methods take
and return lists, so that a real one can batch its requests. Rows are filtered
before they meet a model, and replies come back as columns.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark import lexicons as L

#: Replies that are worth another try, and the seconds to wait before each (fixed values).
TRANSIENT = ("503", "429", "UNAVAILABLE", "RESOURCE_EXHAUSTED", "overloaded")
WAITS = (5, 15, 30)
BATCH = 32


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def generate(self, prompts: list[str]) -> list[str]: ...
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...
    def read(self, images: list[bytes]) -> list[tuple[str, float]]: ...
    def look(self, images: list[bytes], prompts: list[str]) -> list[str]: ...
    def match(self, images: list[bytes], phrases: list[str]) -> list[list[float]]: ...


class Offline:
    """A deterministic stand-in without any model: hashed features, word overlap, fixed replies."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width), np.float32)
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % self.width] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()

    def generate(self, prompts: list[str]) -> list[str]:
        return ['{"verdict": "uncertain", "explanation": "No model is at hand."}'] * len(prompts)

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        sets = [(set(a.lower().split()), set(b.lower().split())) for a, b in pairs]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]

    def read(self, images: list[bytes]) -> list[tuple[str, float]]:
        return [("", 0.0)] * len(images)


    def look(self, images: list[bytes], prompts: list[str]) -> list[str]:
        return [f" seen {len(x)} bytes " for x in images]

    def match(self, images: list[bytes], phrases: list[str]) -> list[list[float]]:
        return [[int(hashlib.md5(x + b"|" + p.encode()).hexdigest()[:4], 16) / 65535 for p in phrases] for x in images]


def insistent(call: Callable, *args, waits: tuple[int, ...] = L.PAGE_WAITS, other=None, sleep: Callable[[float], None] = time.sleep):
    """call(*args), tried again after any error; other once the waits are used up."""
    for wait in (*waits, None):
        try:
            return call(*args)
        except Exception:
            if wait is None:
                return other
            sleep(wait)


def patient(call: Callable, *args, sleep: Callable[[float], None] = time.sleep):
    """call(*args), tried again after transient errors."""
    for wait in (*WAITS, None):
        try:
            return call(*args)
        except Exception as e:
            if wait is None or not any(tag in str(e) for tag in TRANSIENT):
                return f"[ERROR] model call failed: {e}"
            sleep(wait)


def _column(df: DataFrame, source: str, to: str, kind: str, call: Callable[[list], list]) -> DataFrame:
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        listed = values.fillna("").tolist()
        return pd.Series([x for k in range(0, len(listed), BATCH) for x in call(listed[k : k + BATCH])], index=values.index)

    return df.withColumn(to, run(F.col(source)))


def embed(df: DataFrame, provider: Provider, text: str = "text", to: str = "embedding") -> DataFrame:
    """Add unit-length embeddings."""
    return _column(df, text, to, "array<float>", provider.embed)


def ask(df: DataFrame, provider: Provider, prompt: str = "prompt", to: str = "reply") -> DataFrame:
    """Add a model's replies; errors come back as texts that start with [ERROR]."""
    def call(prompts: list[str]) -> list[str]:
        found = patient(provider.generate, prompts)
        return [found] * len(prompts) if isinstance(found, str) else found

    return _column(df, prompt, to, "string", call)
