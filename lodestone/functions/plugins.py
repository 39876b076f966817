"""Contracts of external models, with local stand-ins that tests and offline runs can use."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F


class Embedder(Protocol):
    """A column of vectors of a column of texts."""

    def __call__(self, text: Column) -> Column: ...


class Reranker(Protocol):
    """Rescored rows of a pool (query_id, chunk_id, score, rank)."""

    def __call__(self, pool: DataFrame) -> DataFrame: ...


class Classifier(Protocol):
    """A column of classes of a column of texts."""

    def __call__(self, text: Column) -> Column: ...


def hashing_embedder(size: int = 64) -> Embedder:
    """Counts of words by hash: the same vector for the same words, and no model."""

    def embed(text: Column) -> Column:
        slots = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))

    return embed


def rule_classifier(rules: list[tuple[str, str]], otherwise: str = "GENERALE") -> Classifier:
    """The class of the first pattern that is found."""

    def classify(text: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for pattern, name in rules:
            out = out.when(text.rlike(pattern), name)
        return out.otherwise(otherwise)

    return classify
