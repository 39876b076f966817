"""Batched calls of an embedding model: each distinct text once, in batches that a service would accept, remembered by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.sources.scratch import written

BATCH_TOKENS, BATCH_DOCS = 280_000, 1000
Model = Callable[[list[str]], list[list[float]]]
#: Models that a worker has loaded, by name.
LOADED: dict[str, Model] = {}


def letters_model() -> Model:
    """A stand-in without weights: how often each letter from a to z is in the lower-cased text."""
    return lambda texts: [[float(t.lower().count(chr(c))) for c in range(97, 123)] for t in texts]


def filled(texts: list[str], tokens: int, docs: int) -> Iterator[list[str]]:
    """Texts in order, as many to a batch as its tokens and documents allow; a text that is too long alone is a batch."""
    batch, held = [], 0
    for t in texts:
        size = max(1, len(t) // 4 + 1)
        if batch and (held + size > tokens or len(batch) >= docs):
            yield batch
            batch, held = [], 0
        batch.append(t)
        held += size
    if batch:
        yield batch


def _called(model: Model, texts: list[str]) -> list[list[float] | None]:
    """A batch that fails is halved, so that only the texts that fail themselves have no vector."""
    try:
        found = model(texts)
        if len(found) != len(texts):
            raise ValueError("as many vectors as texts are needed")
        return [None if v is None else [float(x) for x in v] for v in found]
    except Exception:  # noqa: BLE001 - whatever a service raises
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return _called(model, texts[:half]) + _called(model, texts[half:])


def _embedder(name: str, load: Callable[[], Model], tokens: int, docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in LOADED:
            LOADED[name] = load()
        for batch in batches:
            vectors = [v for texts in filled(batch.column(1).to_pylist(), tokens, docs) for v in _called(LOADED[name], texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["content_hash", "embedding"])

    return run


def embedded(df: DataFrame, name: str, load: Callable[[], Model], known: DataFrame | None = None, text: str = "text", tokens: int = BATCH_TOKENS, docs: int = BATCH_DOCS) -> tuple[DataFrame, DataFrame]:
    """``df`` with content_hash and embedding; and the vectors (content_hash, embedding) that were made now, to be kept and passed as ``known`` next time.

    ``load`` makes the model once in each worker. A text is told by its SHA-256 and asked for once, however many rows hold it, if it isn't known. A null
    text, and one that the model fails on, has a null vector; failures aren't returned as made, so they are tried again.
    """
    keyed = df.withColumn("content_hash", F.sha2(F.col(text), 256))
    wanted = keyed.where(F.col(text).isNotNull()).groupBy("content_hash").agg(F.min(text).alias("text"))
    if known is not None:
        wanted = wanted.join(known.select("content_hash"), "content_hash", "left_anti")
    made = written(wanted.select("content_hash", "text").mapInArrow(_embedder(name, load, tokens, docs), "content_hash string, embedding array<float>"), "embedded").where("embedding IS NOT NULL")
    vectors = made if known is None else made.unionByName(known.select("content_hash", "embedding").dropDuplicates(["content_hash"]))
    return keyed.join(vectors, "content_hash", "left").select(*df.columns, "content_hash", "embedding"), made
