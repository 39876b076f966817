"""Alignment of two tokenizers' tokens, over each distinct text once.

Documents are shuffled by their full text, and each distinct text is encoded by both tokenizers and aligned: byte offsets where tokens
of both end cut the text into groups, and every token of one that shares a group with a token of the other is linked to it. How
many documents hold a pair of ids linked is counted over the corpus, a text counting once for each of its documents. To look those counts
up without a row per text and pair, texts are gathered in chunks of ``CHUNK_BYTES``: a chunk has a dictionary of its
distinct pairs, the dictionaries' rows alone are counted and joined, and a chunk meets its own dictionary again. The measures are joined to the
documents by the hash of their text.

Edge cases: null and empty texts, and texts that the tokens of either don't spell byte for byte, have no tokens: zeros and an empty
groups_sha256. Repeated rows are documents of their own, in counts too; a null id stays null; a text of any length is
aligned whole, and pairs of a large group are counted by its distinct ids; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.sources.scratch import written

SLAB_BYTES = 1 << 20  # of text that are aligned at once
CHUNK_BYTES = 16 << 20  # of text that share a dictionary
SPREAD = 256  # links of a group that are made one by one; of a larger one by its distinct ids

# Fixed value: the pattern by which byte-level tokenizers cut words.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level tokenizer from its file: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        rules = json.loads(self.slow.to_str())
        letters, special = byte_letters(), {t["content"]: t["id"] for t in rules["added_tokens"]}
        spelled = {v: k.encode() if k in special else bytes(letters[c] for c in k) for k, v in self.slow.get_vocab(with_added_tokens=True).items()}
        self.bytes = [spelled.get(k, b"") for k in range(max(spelled) + 1)]
        self.fast = self._ranked(rules, spelled, set(special.values()))

    @staticmethod
    def _ranked(rules: dict, spelled: dict[int, bytes], special: set[int]):
        """The same merges by rank, several times as fast, where ids stand in the order of merges and words are cut by the known pattern; else None."""
        before, model = rules["pre_tokenizer"] or {}, rules["model"]
        if rules["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("dropout") or model["type"] != "BPE":
            return None
        order = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        ranks = {b: k for k, b in spelled.items() if k not in special}
        if order != sorted(order) or len(order) + 256 != len(ranks) or min(order, default=256) < 256:
            return None
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=WORD_PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except (ValueError, RuntimeError):  # a run of blanks that its patterns give up on
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """A tokenizer of pieces from its file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        of = lambda k: bytes([int(self.model.id_to_piece(k)[3:5], 16)]) if self.model.is_byte(k) else self.model.id_to_piece(k).replace("▁", " ").encode()
        self.bytes = [of(k) for k in range(size)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


@cache
def tokenizers_of(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


class Slab:
    """Some texts aligned: their measures, and the distinct linked pairs of each with how often they are linked.

    A pair of ids is one number, ``a * size_b + b``.
    """

    def __init__(self, texts: list[str], path_a: str, path_b: str):
        a_side, b_side = tokenizers_of(path_a, path_b)
        self.n = len(texts)
        self.size_a, self.size_b = len(a_side.bytes), len(b_side.bytes)
        none = np.zeros(0, np.int64)
        self.a, self.b, self.valid = [], [], np.zeros(self.n, bool)
        for k, (text, b) in enumerate(zip(texts, b_side.encode(texts), strict=True)):
            whole = b" " + text.encode() if text else b""
            a = a_side.encode(f" {text}") if text else none
            spelled = [b"".join([side.bytes[i] for i in ids.tolist()]) for side, ids in ((a_side, a), (b_side, b))]
            self.valid[k] = bool(text) and spelled[0] == whole and spelled[1] == whole
            self.a.append(a if self.valid[k] else none)
            self.b.append(b if self.valid[k] else none)
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (self.a, self.b))
        ids_a, ids_b = np.concatenate([none, *self.a]), np.concatenate([none, *self.b])
        ends_a, ends_b = (np.cumsum(np.array([len(x) for x in side.bytes], np.int64)[ids]) for side, ids in ((a_side, ids_a), (b_side, ids_b)))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)  # the ends of texts among them
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        text_of = np.repeat(np.arange(self.n), self.n_a)[first_a] if len(common) else none
        self.n_groups = np.bincount(text_of, minlength=self.n)
        self.n_links = np.zeros(self.n, np.int64)
        np.add.at(self.n_links, text_of, in_a * in_b)
        self._link(ids_a, ids_b, in_a, in_b, first_a, first_b, text_of)
        self._digest(ids_a, ids_b, group_a, group_b, in_a, in_b)

    def _link(self, ids_a, ids_b, in_a, in_b, first_a, first_b, text_of) -> None:
        span = self.size_a * self.size_b
        small = np.flatnonzero(in_a * in_b <= SPREAD)
        n = (in_a * in_b)[small]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = np.repeat(small, n)
        keys = text_of[group] * span + ids_a[first_a[group] + place // in_b[group]] * self.size_b + ids_b[first_b[group] + place % in_b[group]]
        keys.sort()
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, times = keys[starts], np.diff(starts, append=len(keys))
        more_keys, more_times = [keys], [times]
        for g in np.flatnonzero(in_a * in_b > SPREAD).tolist():
            a, n_a = np.unique(ids_a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            b, n_b = np.unique(ids_b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            more_keys.append((text_of[g] * span + a[:, None] * self.size_b + b).ravel())
            more_times.append((n_a[:, None] * n_b).ravel())
        if len(more_keys) > 1:
            keys, at = np.unique(np.concatenate(more_keys), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, at, np.concatenate(more_times))
        self.text, self.pair, self.times = keys // span, keys % span, times

    def _digest(self, ids_a, ids_b, group_a, group_b, in_a, in_b) -> None:
        """SHA-256 of each text's ids, group by group: ``a1,a2|b1;a3|b2,b3``."""
        words = np.array([f"{k}{mark}" for size, last in ((self.size_a, "|"), (self.size_b, ";")) for mark in (",", last) for k in range(size)], "S")
        place_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
        index = np.zeros(len(ids_a) + len(ids_b), np.int64)
        index[place_a] = ids_a + self.size_a * last_a
        index[place_b] = 2 * self.size_a + ids_b + self.size_b * last_b
        told = words[index]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        self.digests = [hashlib.sha256(told[s:e].tobytes().replace(b"\0", b"")[:-1]).hexdigest() if e > s else "" for s, e in zip([0, *ends], ends, strict=False)]


ALIGNED = "chunk long, key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, slots array<int>, times array<long>, a array<int>, b array<int>, docs array<long>"


def _chunk(slabs: list[tuple[pa.RecordBatch, Slab]], chunk: int) -> pa.RecordBatch:
    """A row per text, then one with the chunk's dictionary."""
    size_b = slabs[0][1].size_b
    pairs, slots = np.unique(np.concatenate([s.pair for _, s in slabs]), return_inverse=True)
    docs = np.zeros(len(pairs), np.int64)
    np.add.at(docs, slots, np.concatenate([part.column(2).to_numpy()[s.text] for part, s in slabs]))
    n = sum(s.n for _, s in slabs)
    held = np.concatenate([np.bincount(s.text, minlength=s.n) for _, s in slabs])
    offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
    lists = lambda values, kind: pa.concat_arrays([pa.ListArray.from_arrays(offsets, pa.array(values, kind)), pa.nulls(1, pa.list_(kind))])
    alone = lambda values, kind: pa.concat_arrays([pa.nulls(n, pa.list_(kind)), pa.array([values], pa.list_(kind))])
    measure = lambda name: pa.array([*np.concatenate([getattr(s, name) for _, s in slabs]).tolist(), None], pa.int64())
    columns = [
        pa.array(np.full(n + 1, chunk, np.int64)), pa.concat_arrays([*[part.column(0) for part, _ in slabs], pa.nulls(1, pa.binary())]), *map(measure, ("n_a", "n_b", "n_groups", "n_links")),
        pa.array([d for _, s in slabs for d in s.digests] + [None], pa.string()), lists(slots.astype(np.int32), pa.int32()), lists(np.concatenate([s.times for _, s in slabs]), pa.int64()),
        alone((pairs // size_b).astype(np.int32), pa.int32()), alone((pairs % size_b).astype(np.int32), pa.int32()), alone(docs, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ALIGNED.split(", ")])


def _aligner(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, slabs, held = TaskContext.get().partitionId() << 32, [], 0  # type: ignore[union-attr]
        for batch in batches:
            sizes = np.cumsum(batch.column(3).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLAB_BYTES, "right")))
                part = batch.slice(at, to - at)
                slabs.append((part, Slab(part.column(1).to_pylist(), path_a, path_b)))
                held += int(sizes[to - 1] - (sizes[at - 1] if at else 0))
                at = to
                if held >= CHUNK_BYTES:
                    yield _chunk(slabs, number)
                    number, slabs, held = number + 1, [], 0
        if slabs:
            yield _chunk(slabs, number)

    return run


def _measured(keys: tuple, texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of each text of a chunk, by its dictionary."""
    slot = pairs.column("slot").to_numpy()
    size = 1 + int(slot.max(initial=-1))
    count, top = np.zeros(size, np.int64), np.zeros(size, bool)
    count[slot], top[slot] = pairs.column("n").to_numpy(), pairs.column("top").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for chunked_slots, chunked_times in zip(texts.column("slots").chunks, texts.column("times").chunks, strict=True):
        slots, times = chunked_slots.flatten().to_numpy(), chunked_times.flatten().to_numpy()
        of = np.repeat(np.arange(len(chunked_slots)), np.diff(chunked_slots.offsets.to_numpy()))
        for out, weights in ((n_best, times * top[slots]), (count_sum, times * count[slots])):
            total = np.zeros(len(chunked_slots), np.int64)
            np.add.at(total, of, weights)
            out.extend(total.tolist())
    found = texts.select(["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return found.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: (key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each distinct text, its key being the
    SHA-256 of the text, and (a, b, n, top) of each linked pair of ids, top where no pair of the same a has a higher count."""
    texts = df.select(F.col(text_col).alias("text")).where(F.octet_length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))
    told = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies", F.octet_length("text").cast("long").alias("size"))
    found = written(told.mapInArrow(_aligner(path_a, path_b), ALIGNED), "aligned")
    own = found.where(F.col("a").isNotNull()).select("chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("slot", "p")).select("chunk", "slot", "p.a", "p.b", "p.docs")
    counted = own.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    counted = written(counted.withColumn("top", F.col("n") == F.max("n").over(Window.partitionBy("a"))), "pairs")
    looked_up = own.select("chunk", "slot", "a", "b").join(counted, ["a", "b"]).select("chunk", "slot", "n", "top")
    rows = found.where(F.col("key").isNotNull()).select(F.col("chunk").alias("own"), "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "times")
    measures = rows.groupBy("own").cogroup(looked_up.groupBy("chunk")).applyInArrow(_measured, "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return measures, counted


def report(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    measures, _ = align(df, path_a, path_b, id_col, text_col)
    keyed = df.select(F.col(id_col), F.unhex(F.sha2(F.col(text_col), 256)).alias("key"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return keyed.join(measures, "key", "left").select(id_col, *map(zero, names), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
