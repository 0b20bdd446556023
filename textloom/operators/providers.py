"""Outside models behind small interfaces, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class OfflineEmbedder:
    """Features of length, punctuation and letters, filled up with digits of the text's digest."""

    def __init__(self, size: int = 384):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        low, n = text.lower(), max(1, len(text))
        shape = [min(1.0, n / 1000), min(1.0, len(text.split()) / 200)] + [text.count(c) / n for c in ".,;:!?()"]
        letters = [low.count(chr(97 + i)) / n for i in range(26)]
        digest = [int(c, 16) / 15 for c in hashlib.md5(text.encode()).hexdigest()]
        rest = self.size - len(shape) - len(letters)
        return (shape + letters + (digest * (rest // 32 + 1))[: max(0, rest)])[: self.size]


def embedded(rows: DataFrame, text: str, provider: Embedder, batch: int = 32) -> DataFrame:
    """An embedding column, in batches; texts that fail get a zero vector."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for part in parts:
            out: list[list[float]] = []
            texts = part[text].fillna("").tolist()
            for i in range(0, len(texts), batch):
                try:
                    out += provider.embed(texts[i : i + batch])
                except Exception:  # noqa: BLE001 - any provider error
                    out += [[0.0] * provider.size] * len(texts[i : i + batch])
            yield part.assign(vector=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", vector array<double>"
    return rows.mapInPandas(run, schema)
