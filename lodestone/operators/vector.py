"""Nearest neighbours by cosine: exact, block against block, and by an inverted-file index.

Vectors travel in blocks of ``BLOCK``: ids and one flat array of numbers. A pair of blocks is one matrix product that gives each query's best of
that block, and a second step merges the best of all blocks. In the exact search every query meets every vector; the corpus is packed and
written once, and no task holds more than two blocks. The index deals vectors to lists by their nearest centroid, and a query
meets the lists of its nearest centroids only; what it meets there is scored exactly.

A vector that is null or has a null component is left out; vectors of different lengths aren't compared; one of length zero, or of zeros, scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.operators.relational import top_per
from lodestone.sources.scratch import written

BLOCK = 2048
DIGITS = 9  # of a similarity before ranks are drawn, so that equal vectors tie
SAMPLE = 20_000  # vectors that centroids are fitted on: the bound on what reaches the driver
PER_LIST, MOST_LISTS = 64, 4096  # vectors of a list, where there are few; lists, where there are many
ROUNDS = 12
RECALL, TRIED = 0.95, 512  # share of the nearest that a query's lists should hold, as measured on so many vectors of the sample


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    usable = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull())
    return df.where(usable).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their vectors."""
    widths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        yield at, flat[np.repeat(widths == width, widths)].reshape(len(at), width)


def _packed(rows: DataFrame, by_list: bool = False) -> DataFrame:
    """Blocks (list, width, ids, data) of vectors (id, v), or of (id, v, list), of one list and length each; what is near stays together, nothing is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(2).to_numpy() if by_list else np.zeros(len(ids), np.int32)
            for at, vectors in _by_width(batch.column(1)):
                order = np.argsort(lists[at], kind="stable")
                cuts = np.flatnonzero(np.diff(lists[at][order])) + 1
                for part in np.split(order, cuts):
                    for k in range(0, len(part), BLOCK):
                        own = part[k : k + BLOCK]
                        values = [[int(lists[at[own[0]]])], [vectors.shape[1]], [ids[at[own]].tolist()], [vectors[own].tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["list", "width", "ids", "data"])

    return rows.mapInArrow(pack, "list int, width int, ids array<bigint>, data binary")


def _scored(pairs: DataFrame, k: int, query_id: str, corpus_id: str) -> DataFrame:
    """The k best of each pair of blocks (q_ids, q_data, ids, data, width)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (qi, qv), (ci, cv) = ((np.array(row[f"{p}ids"], np.int64), unit(np.frombuffer(row[f"{p}data"]).reshape(-1, row["width"]) if row["width"] else np.zeros((len(row[f"{p}ids"]), 1)))) for p in ("q_", ""))
                score = np.round(qv @ cv.T, DIGITS) + 0.0
                if len(ci) > k:  # all that tie with the k-th
                    bound = np.partition(score, -k, axis=1)[:, [-k]]
                    q, c = np.nonzero(score >= bound)
                else:
                    q, c = (x.ravel() for x in np.indices(score.shape))
                order = np.lexsort((ci[c], -score[q, c], q))
                q, c = q[order], c[order]
                first = np.searchsorted(q, q)
                keep = np.arange(len(q)) - first < k
                q, c = q[keep], c[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qi[q]), pa.array(ci[c]), pa.array(score[q, c])], [query_id, corpus_id, "score"])

    found = pairs.select("width", "ids", "data", "q_ids", "q_data").mapInArrow(best, f"{query_id} bigint, {corpus_id} bigint, score double")
    return top_per(found, [query_id], [F.desc("score"), F.col(corpus_id)], k, "rank")


def _few(rows: DataFrame) -> DataFrame:
    """Queries packed to full blocks."""
    held = written(rows, "queries")
    return held.coalesce(max(1, -(-held.count() // BLOCK)))


def _asking(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("list").alias("q_list"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", corpus_id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k nearest of each query; ties go to the smaller id."""
    blocks = written(_packed(_rows(corpus, corpus_id, vector)), "vectors")
    asking = _asking(_packed(_few(_rows(queries, query_id, vector))))
    return _scored(blocks.crossJoin(asking).where(F.col("width") == F.col("q_width")), k, query_id, corpus_id)  # of blocks, not of rows


def fit_centroids(vectors: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions that the vectors gather around: means of those nearest, again and again; an empty one starts anew at the vector that fits worst."""
    rng, vectors = np.random.default_rng(42), unit(vectors)
    centroids = vectors[rng.choice(len(vectors), min(count, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = vectors @ centroids.T
        home = near.argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, home, vectors)
        gone = np.flatnonzero(np.bincount(home, minlength=len(centroids)) == 0)
        total[gone] = vectors[np.argsort(near.max(axis=1), kind="stable")[: len(gone)]]
        centroids = unit(total)
    return centroids


def fit_probes(vectors: np.ndarray, centroids: np.ndarray, target: float = RECALL, near: int = 10) -> int:
    """How many of its nearest lists a query has to probe to meet a share of its nearest neighbours, among some vectors."""
    vectors = unit(vectors)
    asked = vectors[:TRIED]
    score = asked @ vectors.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(near, len(vectors) - 1)]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)  # of each list, for each query
    needed = np.sort(np.take_along_axis(place, (vectors @ centroids.T).argmax(axis=1)[best], axis=1).ravel())
    return int(needed[int(np.ceil(target * len(needed))) - 1]) + 1 if len(needed) else 1


@dataclass
class Index:
    """Centroids, how many of its lists a query probes, and the blocks (list, width, ids, data) of all vectors in a written table, ordered by list."""

    centroids: np.ndarray
    probes: int
    blocks: DataFrame

    def _near(self, rows: DataFrame, n: int) -> DataFrame:
        """(id, v, list): the n nearest lists of each vector. A vector of another length than the centroids' is in list -1."""
        shared = rows.sparkSession.sparkContext.broadcast(self.centroids)  # at most MOST_LISTS of them

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids = shared.value
            for batch in batches:
                for at, vectors in _by_width(batch.column(1)):
                    lists = np.full((len(at), 1), -1)
                    if vectors.shape[1] == centroids.shape[1] and len(centroids):
                        lists = np.argsort(-(unit(vectors) @ centroids.T), axis=1, kind="stable")[:, :n]
                    part = batch.take(pa.array(np.repeat(at, lists.shape[1])))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists.ravel().astype(np.int32))], ["id", "v", "list"])

        return rows.mapInArrow(deal, "id bigint, v array<double>, list int")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", corpus_id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
        """(query_id, chunk_id, score, rank): the k nearest within the ``probes`` nearest lists of each query, the index's own number if not given.

        Lists are joined as blocks, so a list that holds a third of all vectors is many rows of the join, and its queries are split too.
        """
        n = probes or self.probes
        asked = written(self._near(_few(_rows(queries, query_id, vector)), n), "asked")
        ordered = asked.repartitionByRange(max(1, -(-asked.count() // BLOCK)), "list", "id").sortWithinPartitions("list")
        asking = written(_asking(_packed(ordered, True)), "asking")
        pairs = self.blocks.join(asking, (F.col("list") == F.col("q_list")) & (F.col("width") == F.col("q_width")))
        return _scored(pairs, k, query_id, corpus_id)


def build_index(corpus: DataFrame, lists: int | None = None, corpus_id: str = "chunk_id", vector: str = "embedding") -> Index:
    """An index of all vectors of a corpus: its centroids and probes come from at most ``SAMPLE`` vectors, chosen by hash; every vector is in a list.

    The corpus is shuffled once, by ranges of (list, id), so a large list is split among tasks.
    """
    rows = _rows(corpus, corpus_id, vector)
    count = rows.count()
    sample = rows.orderBy(F.xxhash64(F.lit(42), "id"), "id").limit(SAMPLE).toPandas()
    widths, times = np.unique([len(v) for v in sample["v"]], return_counts=True)
    width = int(widths[times.argmax()]) if len(widths) else 0  # the usual one
    fit = np.array([v for v in sample["v"] if len(v) == width], np.float64).reshape(int(times.max(initial=0)), width)
    wanted = lists or int(min(MOST_LISTS, max(1, count // PER_LIST)))
    centroids = fit_centroids(fit, wanted) if len(fit) else fit
    index = Index(centroids, fit_probes(fit, centroids) if len(fit) else 1, rows)
    dealt = index._near(rows, 1).repartitionByRange("list", "id").sortWithinPartitions("list", "id")
    index.blocks = written(_packed(dealt, True), "index")
    return index


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", corpus_id: str = "chunk_id") -> DataFrame:
    """One row: the share of the exact results that were found."""
    hits = exact.select(query_id, corpus_id).join(found.select(query_id, corpus_id, F.lit(1).alias("hit")), [query_id, corpus_id], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
