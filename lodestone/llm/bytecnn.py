"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, convolved with learned filters at every fourth place of chunks of 512 bytes that overlap by half and cover
the whole document, passed through a rectifier and max-pooled over each chunk. The document is described by the mean and
the greatest of its chunks' pooled filters; a hidden layer combines both into one probability.

The network is fitted on at most ``SAMPLE`` labelled rows (those with the smallest hashes) of ``SAMPLE_BYTES`` together, the bounds of the
documented sample; scoring runs over every document, in slabs of chunks, so memory doesn't grow with a text.

Edge cases: a null or empty text is scored as one chunk of padding; repeated rows get equal scores; without
labels of both kinds every score is the share of label 1 (0.5 without labels); an empty table gives an empty
table; a null id counts as held out; other columns are not read. An id that repeats among the labels or texts is fitted once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

CHUNK, HOP = 512, 256
KERNEL, STRIDE = 8, 4
EMBED, FILTERS, HIDDEN = 6, 24, 16
PAD = 256  # a symbol of its own for places beyond the text
SAMPLE, SAMPLE_BYTES = 3000, 64 << 20  # labelled rows, and bytes of their texts, that the network is fitted on at most
EPOCHS, LEAST_STEPS = 8, 700
TRAIN_CHUNKS, BATCH_CHUNKS = 160, 256
THRESHOLD = 0.3
SEED = 7

Params = dict[str, np.ndarray]


def start(seed: int = SEED) -> Params:
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
    return {
        "embed": rng.standard_normal((257, EMBED)).astype(np.float32) * 0.5, "filters": make(KERNEL * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32),
        "hidden": make(2 * FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": make(HIDDEN, 1), "out_bias": np.zeros(1, np.float32),
    }


def chunks(raw: bytes) -> np.ndarray:
    """Chunks x CHUNK symbols; every byte is in a chunk, and all but the edges in two."""
    symbols = np.frombuffer(raw, np.uint8).astype(np.int16)
    n = max(1, 1 + -(-(len(symbols) - CHUNK) // HOP))
    padded = np.full((n - 1) * HOP + CHUNK, PAD, np.int16)
    padded[: len(symbols)] = symbols
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


def _windows(p: Params, x: np.ndarray) -> np.ndarray:
    """(chunks, places, KERNEL * EMBED) of embedded bytes."""
    embedded = p["embed"][x].reshape(len(x), -1)
    return np.lib.stride_tricks.sliding_window_view(embedded, KERNEL * EMBED, axis=1)[:, :: STRIDE * EMBED]


def pooled(p: Params, x: np.ndarray) -> np.ndarray:
    """Filters pooled over each chunk."""
    windows = _windows(p, x)
    n, places = windows.shape[:2]
    found = np.ascontiguousarray(windows).reshape(n * places, -1) @ p["filters"]
    return np.maximum(found.reshape(n, places, -1).max(axis=1) + p["bias"], 0)


def _combine(p: Params, pool: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, hidden, log odds) of documents whose chunks begin at ``first``."""
    counts = np.diff(np.append(first, len(pool)))
    features = np.concatenate([np.add.reduceat(pool, first) / counts[:, None], np.maximum.reduceat(pool, first)], axis=1)
    hidden = np.maximum(features @ p["hidden"] + p["hidden_bias"], 0)
    return features, hidden, (hidden @ p["out"] + p["out_bias"])[:, 0]


def _gradient(p: Params, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Params:
    windows = np.ascontiguousarray(_windows(p, x))
    n, places = windows.shape[:2]
    flat = windows.reshape(n * places, -1)
    found = (flat @ p["filters"]).reshape(n, places, -1)
    best = found.argmax(axis=1)
    raw = np.take_along_axis(found, best[:, None], axis=1)[:, 0] + p["bias"]
    pool = np.maximum(raw, 0)
    features, hidden, odds = _combine(p, pool, first)
    d_odds = ((1 / (1 + np.exp(-np.clip(odds, -30, 30))) - label) * weight / len(label)).astype(np.float32)[:, None]
    d_hidden = (d_odds @ p["out"].T) * (hidden > 0)
    d_features = d_hidden @ p["hidden"].T
    counts = np.diff(np.append(first, n))
    owner = np.repeat(np.arange(len(first)), counts)
    top = pool == features[owner, FILTERS:]
    share = top / np.add.reduceat(top.astype(np.float32), first)[owner]
    d_pool = (d_features[owner, :FILTERS] / counts[owner, None] + d_features[owner, FILTERS:] * share) * (raw > 0)
    d_pool = d_pool.astype(np.float32)
    at = windows[np.arange(n)[:, None], best]  # (chunks, filters, KERNEL * EMBED)
    d_filters = np.einsum("cf,cfk->kf", d_pool, at)
    d_windows = d_pool[:, :, None] * p["filters"].T[None]  # (chunks, filters, KERNEL * EMBED)
    places_of = best[:, :, None] * STRIDE + np.arange(KERNEL)
    symbols = x[np.arange(n)[:, None, None], places_of]
    d_embed = np.zeros_like(p["embed"])
    np.add.at(d_embed, symbols.ravel(), d_windows.reshape(-1, EMBED))
    return {
        "embed": d_embed, "filters": d_filters, "bias": d_pool.sum(axis=0), "hidden": features.T @ d_hidden, "hidden_bias": d_hidden.sum(axis=0),
        "out": hidden.T @ d_odds, "out_bias": d_odds.sum(axis=0),
    }


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Params:
    """Adam over batches of whole documents; both labels weigh alike by half, so the rarer one is heard."""
    p, rng = start(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        p["out"][:] = 0
        p["out_bias"][:] = math.log(max(share, 1e-3) / max(1 - share, 1e-3)) if len(y) else 0.0
        return p
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    weight = np.sqrt(balance)
    parts = [chunks(t) for t in texts]
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step, epochs = 0, max(epochs, -(-LEAST_STEPS * TRAIN_CHUNKS // sum(map(len, parts))))
    for epoch in range(epochs):
        rate = 0.006 * (0.5 + 0.5 * math.cos(math.pi * epoch / epochs))
        order, at = rng.permutation(len(y)), 0
        while at < len(order):
            to, held = at, 0
            while to < len(order) and (to == at or held + len(parts[order[to]]) <= TRAIN_CHUNKS):
                held += len(parts[order[to]])
                to += 1
            own = order[at:to]
            sizes = np.array([len(parts[k]) for k in own])
            gradient = _gradient(p, np.concatenate([parts[k] for k in own]), np.cumsum(sizes) - sizes, y[own], weight[own])
            step += 1
            for k, g in gradient.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            at = to
    return p


def probabilities(p: Params, texts: list[bytes]) -> list[float]:
    """The probability of label 1 of every text, slab by slab of its chunks."""
    out, slab, held = [], [], 0

    def flush() -> None:
        sizes = np.array([len(x) for x in slab])
        first, pool = np.cumsum(sizes) - sizes, np.empty((int(sizes.sum()), FILTERS), np.float32)
        x = np.concatenate(slab)
        for at in range(0, len(x), BATCH_CHUNKS):
            pool[at : at + BATCH_CHUNKS] = pooled(p, x[at : at + BATCH_CHUNKS])
        odds = _combine(p, pool, first)[2].astype(np.float64)
        out.extend((1 / (1 + np.exp(-np.clip(odds, -30, 30)))).tolist())

    for text in texts:
        slab.append(chunks(text))
        held += len(slab[-1])
        if held >= 4 * BATCH_CHUNKS:
            flush()
            slab, held = [], 0
    if slab:
        flush()
    return out


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Params:
    """Fits on at most ``sample`` labelled rows that aren't held out, of ``most_bytes`` together: the bound on what reaches the driver.

    An id is one row: of several texts or labels of it the least counts.
    """
    usable = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    chosen = usable.orderBy(*order).limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    size = F.sum(F.octet_length("text")).over(Window.orderBy(*order))  # over the sample, which is bounded
    rows = found.withColumn("size", size).where(F.col("size") <= most_bytes).orderBy("doc_id").collect()
    return fit([r["text"].encode() for r in rows], [r["quality"] for r in rows])


def score(docs: DataFrame, params: Params) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(params)  # a few thousand numbers, whatever the corpus

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            found = np.round(np.array(probabilities(shared.value, texts), np.float64), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(add, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
