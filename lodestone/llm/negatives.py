"""Hard negatives of anchors by exact inner products, many candidates to one wide integer.

A block of candidates becomes one integer a component: each candidate's component, shifted to be at least zero, has a field of its
own. An anchor's component multiplies that integer once, the products of all components are added, and the fields of the sum are the
scores, exactly. Blocks of anchors, the stated query set, meet blocks of all rows in two passes: the first finds each anchor's
positives, the second the best rows of other labels within the range of scores that each positive sets. What a task hands on
is the best of all blocks that it has seen, not their scores.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part; labels change before anything
else where the id is divisible by 7. A null id is no anchor, comes last among ties and stays null. Rows of one id aren't each other's
positives or negatives; anchors that are alike in id, label and vector are one anchor, while a repeated candidate takes a place for each of its
rows. A vector that is shorter than another counts as if zeros followed it, an empty one too. A positive of score zero takes negatives of score zero, and one of
a negative score none. Components whose 256-fold is 2^53 or more, and scores beyond a long, are refused with an error. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.sources.scratch import written

SCALE = 256
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LEAST, MOST = (1, 2), (19, 20)  # of the positive's score: 50 and 95 of 100
CANDIDATES, ANCHORS = 4096, 1024  # rows of a block
BLOCK = "ids array<bigint>, labels array<bigint>, width bigint, bytes bigint, {}vectors binary"


def relabelled(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    usable = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    number, label = F.col(id_col).cast("bigint"), F.col(label_col).cast("bigint")
    changed = F.when(number % 7 == 0, (label + 1) % 10).otherwise(label)
    return df.where(label.isNotNull() & F.col(vector_col).isNotNull() & usable).select(number.alias("id"), changed.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))


def quantized(vectors: pa.Array) -> np.ndarray:
    """A row of whole numbers per vector, zeros after the shorter ones."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= 2**53:
        raise ValueError("a component is too large to be told exactly")
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat.astype(np.int64)
    return out


def _blocks(rows: DataFrame, most: int, extra: str = "") -> DataFrame:
    """Rows packed to blocks, those of a label together; ``extra`` is a column of lists that goes with them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                part = part.take(pa.array(np.argsort(part.column(1).to_numpy(), kind="stable")))
                values = quantized(part.column(2))
                top = int(np.abs(values).max(initial=0))
                kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
                lists = [[part.column(k).to_pylist()] for k in ((0, 1, 3) if extra else (0, 1))]
                data = [*lists[:2], [values.shape[1]], [int(kind[2])], *lists[2:], [values.astype(kind).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kinds, strict=True)], names)

    longs = pa.list_(pa.int64())
    names = ["ids", "labels", "width", "bytes", *([extra] if extra else []), "vectors"]
    kinds = [longs, longs, pa.int64(), pa.int64(), *([pa.list_(longs)] if extra else []), pa.binary()]
    return rows.mapInArrow(pack, BLOCK.format(f"{extra} array<array<bigint>>, " if extra else ""))


def _matrix(row: dict, prefix: str = "") -> np.ndarray:
    return np.frombuffer(row[f"{prefix}vectors"], f"<i{row[f'{prefix}bytes']}").reshape(len(row[f"{prefix}ids"]), row[f"{prefix}width"]).astype(np.int64)


class Packed:
    """Candidates in the fields of one integer a component, for anchors whose components lie in a range."""

    def __init__(self, vectors: np.ndarray, low: int, high: int):
        self.n, self.low = len(vectors), low
        self.shift = int(vectors.min(initial=0))
        raised = (vectors - self.shift).astype(np.uint64)
        most = (high - low) * int(raised.max(initial=0)) * max(1, vectors.shape[1])
        self.width = 4 if most < 2**32 else 8 if most < 2**64 else 16
        fields = np.zeros((vectors.shape[1], self.n, max(1, self.width // 8)), f"<u{min(self.width, 8)}")
        fields[:, :, 0] = raised.T
        self.columns = [int.from_bytes(x.tobytes(), "little") for x in fields]
        self.sums = raised.sum(axis=1, dtype=np.uint64)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products with all candidates; right if they fit in a long, as what is added wraps."""
        raised = [a - self.low for a in anchor]
        total = sum(a * c for a, c in zip(raised, self.columns, strict=True))
        found = np.frombuffer(total.to_bytes(self.n * self.width, "little"), f"<u{min(self.width, 8)}").reshape(self.n, -1)[:, 0].astype(np.uint64)
        rest = self.shift * sum(raised) + self.low * self.shift * len(anchor)
        return (found + np.uint64(self.low % 2**64) * self.sums + np.uint64(rest % 2**64)).view(np.int64)


def _refuse_large(anchors: np.ndarray, vectors: np.ndarray) -> None:
    most = anchors.shape[1] * int(np.abs(anchors).max(initial=0)) * int(np.abs(vectors).max(initial=0))
    if most >= 2**63 and (np.abs(anchors.astype(float) @ vectors.astype(float).T) >= 2.0**63 * (1 - 1e-9)).any():
        raise OverflowError("a score doesn't fit in a long")


def best(scores: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties by the smaller id, null ids last."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], none[at], -scores[at]))[:k]]


def _merged(held: list[tuple], new: list[tuple], k: int) -> list[tuple]:
    return sorted(held + new, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def _searcher(search, k: int, names: list[str]):
    """Runs ``search`` on each pair of blocks and keeps the k best rows of each key over all pairs of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = defaultdict(list)
        block: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                if block.get("raw") != (now := (row["ids"], row["labels"], row["vectors"])):
                    ids = np.array([i or 0 for i in row["ids"]], np.int64)
                    block = {"raw": now, "ids": ids, "none": np.array([i is None for i in row["ids"]], bool), "labels": np.array(row["labels"], np.int64), "vectors": _matrix(row), "packed": {}}
                anchors = _matrix(row, "a_")
                width = min(anchors.shape[1], block["vectors"].shape[1])
                _refuse_large(anchors[:, :width], block["vectors"][:, :width])
                low, high = int(anchors.min(initial=0)), int(anchors.max(initial=0))

                def packed(start: int, end: int, block=block, width=width, low=low, high=high) -> Packed:
                    if (at := (start, end, width, low, high)) not in block["packed"]:
                        if len(block["packed"]) > 64:
                            block["packed"].clear()
                        block["packed"][at] = Packed(block["vectors"][start:end, :width], low, high)
                    return block["packed"][at]

                for j, anchor in enumerate(anchors[:, :width].tolist()):
                    for key, found in search(row, j, anchor, block, packed):
                        held[key] = _merged(held[key], found, k)
        rows = [(*key, i, s) for key, found in held.items() for s, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    return run


def _same_label(row: dict, j: int, anchor: list[int], block: dict, packed) -> Iterator[tuple]:
    label, number = row["a_labels"][j], row["numbers"][j][1]
    start, end = (int(np.searchsorted(block["labels"], label, side)) for side in ("left", "right"))
    if start < end:
        ids, none = block["ids"][start:end], block["none"][start:end]
        scores = packed(start, end).scores(anchor)
        others = np.flatnonzero(none | (ids != row["a_ids"][j]))
        at = others[best(scores[others], ids[others], none[others], POSITIVES)]
        yield (number,), [(s, None if x else i) for s, i, x in zip(scores[at].tolist(), ids[at].tolist(), none[at].tolist(), strict=True)]


def _other_labels(row: dict, j: int, anchor: list[int], block: dict, packed) -> Iterator[tuple]:
    ids, none = block["ids"], block["none"]
    scores = packed(0, len(ids)).scores(anchor)
    number, *wanted = row["numbers"][j][1:]
    fit = (block["labels"] != row["a_labels"][j]) & (none | (ids != row["a_ids"][j]))
    for w in wanted:
        within = np.flatnonzero(fit & (scores >= -(-LEAST[0] * w // LEAST[1])) & (scores <= MOST[0] * w // MOST[1]))
        if len(within):
            at = within[best(scores[within], ids[within], none[within], NEGATIVES)]
            yield (number, w), [(s, None if x else i) for s, i, x in zip(scores[at].tolist(), ids[at].tolist(), none[at].tolist(), strict=True)]


def _first(found: DataFrame, keys: list[str], score: str, key: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(key)))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _meet(rows: DataFrame, anchors: DataFrame, search, k: int, names: list[str]) -> DataFrame:
    """Blocks of anchors against blocks of all rows. ``numbers`` starts with the anchor's id."""
    against = _blocks(anchors, ANCHORS, "numbers")
    against = against.select("numbers", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "width", "bytes", "vectors")])
    return rows.crossJoin(against).mapInArrow(_searcher(search, k, names), ", ".join(f"{n} bigint" for n in names))


def hard_negatives(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the module's docstring says what they are."""
    rows = relabelled(df, id_col, label_col, vector_col)
    blocks = written(_blocks(rows, CANDIDATES), "candidates")
    anchors = written(rows.where(F.col("id") % EVERY == 0).distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    few = anchors.coalesce(max(1, -(-anchors.count() // ANCHORS)))  # so that blocks are full
    found = _meet(blocks, few.select("id", "label", "vector", F.array("id", "anchor").alias("numbers")), _same_label, POSITIVES, ["anchor", "positive_id", "positive_score"])
    positives = written(_first(found, ["anchor"], "positive_score", "positive_id", POSITIVES).drop("rank"), "positives")
    wanted = positives.where("positive_score >= 0").groupBy("anchor").agg(F.collect_set("positive_score").alias("wanted"))  # five at most
    asked = written(anchors.join(wanted, "anchor"), "asked")
    few = asked.coalesce(max(1, -(-asked.count() // ANCHORS)))
    found = _meet(blocks, few.select("id", "label", "vector", F.concat(F.array("id", "anchor"), "wanted").alias("numbers")), _other_labels, NEGATIVES, ["anchor", "positive_score", "negative_id", "negative_score"])
    negatives = _first(found, ["anchor", "positive_score"], "negative_score", "negative_id", NEGATIVES)
    told = anchors.select("anchor", F.col("id").alias("anchor_id")).join(positives, "anchor").join(negatives, ["anchor", "positive_score"])
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
