"""Which of many titles shares most words with each passage: every passage meets every title, block against block.

A block is up to ``BLOCK`` rows, or ``ENTRIES`` words: the rows' ids, and their words as places in the block's own list of distinct words, with weights that add up.
A pair of blocks is scored whole: words that many rows of both sides have by matrix products, the rest by going through the titles that have them. Each passage keeps its
best and next best score of the block, and a second step merges those of all blocks. Titles of the same words are met once. No task holds more than two blocks and
their table of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.sources.scratch import written

BLOCK, ENTRIES = 2048, 1_000_000
PANEL, STEP = 512, 2_000_000  # words of a matrix product; pairs of a passage's word and a title that are added at once
DENSE = 150  # products of a matrix that take as long as one such pair


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of rows that make a block; a row that is too large alone is one."""
    ends, k = np.cumsum(sizes), 0
    while k < len(sizes):
        full = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + ENTRIES, "right"))
        end = min(k + BLOCK, max(k + 1, full), len(sizes))
        yield k, end
        k = end


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packed(rows: DataFrame, weights: dict[str, float], side: str) -> DataFrame:
    """Blocks of rows: the columns that have no weight as they are, and the words of those that have one (arrays without nulls)."""
    parts = [f"{side}_{x}" for x in ("rows", "words", "at", "place", "weight")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in weights)
            for begin, end in _cuts(sizes):
                part = batch.slice(begin, end - begin)
                lists = [part.column(c) for c in weights]
                coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
                at = np.concatenate([pc.list_parent_indices(x).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int32)
                weight = np.concatenate([np.full(len(x.flatten()), w, np.float32) for x, w in zip(lists, weights.values(), strict=True)])
                kept = _ipc(part.select([c for c in part.schema.names if c not in weights]))
                words = _ipc(pa.RecordBatch.from_arrays([coded.dictionary], ["word"]))
                place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (kept, words, at.tobytes(), place.tobytes(), weight.tobytes())], parts)

    return rows.mapInArrow(pack, ", ".join(f"{x} binary" for x in parts))


@dataclass
class _Block:
    rows: pa.Table
    words: pa.Array
    at: np.ndarray
    place: np.ndarray
    weight: np.ndarray

    @classmethod
    def read(cls, row: dict[str, bytes], side: str) -> _Block:
        table = lambda x: pa.ipc.open_stream(row[f"{side}_{x}"]).read_all()
        words = table("words").column(0).combine_chunks()
        return cls(table("rows"), words, *(np.frombuffer(row[f"{side}_{x}"], t).astype(np.int64) for x, t in (("at", np.int32), ("place", np.int32))), np.frombuffer(row[f"{side}_weight"], np.float32))


def _scores(own: _Block, titles: _Block) -> np.ndarray:
    """The sum of weights of shared words, for each passage (rows) and each title (columns)."""
    n, m, size = own.rows.num_rows, titles.rows.num_rows, len(titles.words)
    found = pc.fill_null(pc.index_in(own.words, value_set=titles.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[own.place]
    shared = found >= 0
    row, word, weight = own.at[shared], found[shared], own.weight[shared]
    order = np.argsort(titles.place, kind="stable")
    title, spread = titles.at[order], np.bincount(titles.place, minlength=size)
    first = np.cumsum(spread) - spread
    usual = np.bincount(word, minlength=size) * spread * DENSE > n * m
    score = np.zeros((n, m), np.float32)
    panel, column = np.full(size, -1), np.zeros(size, np.int64)
    at = np.flatnonzero(usual)
    panel[at], column[at] = np.arange(len(at)) // PANEL, np.arange(len(at)) % PANEL
    held = panel[titles.place]
    for k in range(-(-len(at) // PANEL)):
        wide, mine, theirs = min(PANEL, len(at) - k * PANEL), panel[word] == k, held == k
        left = np.bincount(row[mine] * wide + column[word[mine]], weight[mine], n * wide).astype(np.float32).reshape(n, wide)
        right = np.zeros((wide, m), np.float32)
        right[column[titles.place[theirs]], titles.at[theirs]] = 1
        score += left @ right
    rest = ~usual[word]
    row, word, weight = row[rest], word[rest], weight[rest]
    times = spread[word]
    ends = np.cumsum(times)
    flat, k = score.reshape(-1), 0
    while k < len(word):
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + STEP, "right")))
        t = times[k:end]
        entry = np.arange(t.sum()) + np.repeat(first[word[k:end]] - (np.cumsum(t) - t), t)
        np.add.at(flat, np.repeat(row[k:end] * m, t) + title[entry], np.repeat(weight[k:end], t))
        k = end
    return score


def most_shared(passages: DataFrame, titles: DataFrame, weights: dict[str, float], passage: str = "chunk_id", title: str = "module_index") -> DataFrame:
    """(chunk_id, module_index, score, next): the title whose words weigh most in each passage, the first among equals, and the score of the next title, null where there is one only.

    Passages (chunk_id, a column of distinct words for each weight), titles (module_index, words: distinct). A score adds the weights of all columns that have a word of
    the title; weights are multiples of a half, so sums are exact. Rows of one chunk_id count as one passage.
    """
    alike = titles.groupBy(F.array_sort("words").alias("words")).agg(F.min(title).alias(title), F.count(F.lit(1)).alias("copies"))
    told = written(alike, "titles")
    asked = written(_packed(told.coalesce(max(1, -(-told.count() // BLOCK))), {"words": 1.0}, "title"), "title_blocks")
    blocks = written(_packed(passages.select(passage, *weights), weights, "own"), "passage_blocks")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pair = batch.slice(k, 1).to_pylist()[0]
                own, other = _Block.read(pair, "own"), _Block.read(pair, "title")
                by_id = pc.sort_indices(other.rows.column(title))
                place = np.empty(len(by_id), np.int64)
                place[by_id.to_numpy()] = np.arange(len(by_id))
                other.rows, other.at = other.rows.take(by_id), place[other.at]
                score, every = _scores(own, other), np.arange(own.rows.num_rows)
                home = score.argmax(axis=1)
                top = score[every, home]
                score[every, home] = -np.inf
                following = np.where(other.rows.column("copies").to_numpy()[home] > 1, top, score.max(axis=1))
                ids = (own.rows.column(passage).combine_chunks(), other.rows.column(title).combine_chunks().take(pa.array(home)))
                scored = (pa.array(top.astype(np.float64)), pa.array(following.astype(np.float64), mask=np.isinf(following)))
                yield pa.RecordBatch.from_arrays([*ids, *scored], [passage, title, "score", "next"])

    schema = StructType([passages.schema[passage], titles.schema[title], StructField("score", DoubleType()), StructField("next", DoubleType())])
    found = blocks.crossJoin(asked).mapInArrow(best, schema)  # of blocks, not of rows
    first = F.min(F.struct(-F.col("score"), F.col(title).isNull().alias("none"), title))
    merged = found.groupBy(passage).agg(first.alias("first"), F.slice(F.sort_array(F.flatten(F.collect_list(F.array("score", "next"))), False), 1, 2).alias("two"))
    return merged.select(passage, F.col("first")[title].alias(title), F.col("two")[0].alias("score"), F.get("two", F.lit(1)).alias("next"))
