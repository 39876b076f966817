"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints that differ in at most three of 64 bits agree on all but three of ``b`` blocks of bits, so every
fingerprint is dealt once for each choice of ``b - 3`` blocks; ``b`` grows with the corpus, so that buckets stay small.
The fingerprints of a bucket, in order, are a binary trie: pairs of nodes are traversed together from the
root, bits in which they differ add up, and a pair beyond three is pruned. All buckets of a task go down level by level
in numpy. A bucket sends a tree of links, not all pairs, and stars of links are merged until components stand.

``one_of_each`` takes a wide budget, for texts of a given similarity: there fingerprints meet in buckets of texts that share minima of
their shingles, so that buckets hold texts with common words however large the corpus is; each is a trie that is traversed under that budget,
and pairs within it are compared exactly. One row stands for all copies of a text.

A bucket larger than ``CHUNK`` is dealt by hash into chunks whose pairs are joined in tasks of their own: exact, and no
task holds more than two chunks.

Edge cases: a null, empty or blank text has fingerprint zero, which links like any other; fewer than three words are one
shingle; repeated rows share a fingerprint; a null id can't name a component, but a row of it gets one; an empty
table gives an empty table; names of columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.columns import named, place, plain
from lodestone.sources.scratch import written

BITS = 64
MOST = 3
SHINGLE = 3
SEED = 42
CHUNK = 1024
NEAR_CHUNK = 8192  # under a wide budget, where a class sends one pair a bucket
PER_BUCKET = 256
SLAB = 16384
FRONTIER = 1 << 14  # pairs of nodes at once
PAIRS = 1 << 18  # pairs of values at once
LEAF = 256  # pairs of values of two nodes that are compared as they are, under a wide budget
SKETCH = 1024
KEYS = 10  # of two minima each: texts of similarity 0.8 share none with a chance of 0.36 ** 10
_MIX = np.random.default_rng(9).integers(0, 1 << 63, (4, KEYS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE, seen: list | None = None) -> int:
    """64 bits, each set if it is set in over half of the XXH64 hashes of the word shingles, which are added to ``seen``."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, counts = len(starts), np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in pairs], np.uint64)
        if seen is not None:
            seen.append(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def meeting_keys(shingles: np.ndarray) -> list[int]:
    """Keys of a set of hashed shingles: two texts share a key if both of its minima fall on shingles that they share."""
    if not len(shingles):
        return []
    low = [np.full(KEYS, ~np.uint64(0)), np.full(KEYS, ~np.uint64(0))]
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14), None]
        low = [np.minimum(x, (part * _MIX[k]).min(axis=0)) for k, x in enumerate(low)]
    mixed = (low[0] ^ (low[0] >> np.uint64(31))) * _MIX[2] + (low[1] ^ (low[1] >> np.uint64(29))) * _MIX[3]
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64).tolist()


def with_fingerprint(df: DataFrame, text_col: str = "text", keep_text: bool = True, shingle: int = SHINGLE, with_class: bool = False) -> DataFrame:
    """``df`` with ``_s_fp``, the fingerprint as a signed long, and on demand ``_s_class``, a hash of the text's words,
    a sketch of its shingles: their number ``_s_size`` and ``_s_bits``, a bit for each of ``SKETCH`` groups that has one, and ``_s_keys``."""
    at = df.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            texts = batch.column(at).to_pylist()
            seen: list[list] = [[] for _ in texts] if with_class else [None] * len(texts)
            found = [pa.array(np.array([fingerprint(t, shingle, s) for t, s in zip(texts, seen, strict=True)], np.uint64).view(np.int64))]
            if with_class:
                sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *s])) for s in seen]
                words = (b" ".join((t or "").encode().lower().split()) for t in texts)
                found.append(pa.array(np.array([xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)))
                found += [pa.array([len(x) for x in sets], pa.int64()), pa.array([np.packbits(np.bincount((x % SKETCH).astype(np.int64), minlength=SKETCH) > 0).tobytes() for x in sets], pa.binary()), pa.array(map(meeting_keys, sets), pa.list_(pa.int64()))]
            kept = [k for k in range(batch.num_columns) if keep_text or k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *found], [*(batch.schema.names[k] for k in kept), *added])

    added = {"_s_fp": "bigint"} | ({"_s_class": "bigint", "_s_size": "bigint", "_s_bits": "binary", "_s_keys": "array<bigint>"} if with_class else {})
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if keep_text or f.name != text_col]
    return df.mapInArrow(add, ", ".join([*fields, *(f"{c} {kind}" for c, kind in added.items())]))


def _products(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs x < y of positions of pairs of nodes, in blocks."""
    rows = a1 - a0
    at = np.repeat(np.arange(len(a0)), rows)
    left = np.arange(len(at)) - np.repeat(np.cumsum(rows) - rows, rows) + a0[at]
    start = np.maximum(b0[at], left + 1)  # a node with itself: each pair once
    partners = b1[at] - start
    ends = np.cumsum(partners)
    s = 0
    while s < len(at):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, "right")))
        n = partners[s:e]
        yield np.repeat(left[s:e], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[s:e], n)
        s = e


def traverse(values: np.ndarray, group: np.ndarray, most: int = MOST, leaf: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the pairs x < y of indices within a group that differ in at most ``most`` bits; values ascend within each group.

    A node is a range of positions that share the bits so far; the walk holds pairs of nodes, at most ``FRONTIER`` at once, and goes
    down the first of them first. A pair of nodes of at most ``leaf`` pairs of values is compared value by value.
    """
    edges = np.flatnonzero(np.diff(group)) + 1
    lo = np.concatenate([[0], edges]).astype(np.int64)
    hi = np.concatenate([edges, [len(values)]]).astype(np.int64)
    many = hi - lo > 1
    waiting = [(BITS - 1, (lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int8)))]
    ones: dict[int, np.ndarray] = {}
    while waiting:
        bit, nodes = waiting.pop()
        a0, a1, b0, b1, cost = nodes
        small = ((a1 - a0) * (b1 - b0) <= leaf) | (bit < 0)  # beyond the last bit the values of a node are equal
        for x, y in _products(*(z[small] for z in nodes[:4])):
            near = np.bitwise_count(values[x] ^ values[y]) <= most
            yield x[near], y[near]
        a0, a1, b0, b1, cost = (z[~small] for z in nodes)
        if len(a0) > FRONTIER:
            waiting += [(bit, tuple(z[k : k + FRONTIER] for z in (a0, a1, b0, b1, cost))) for k in range(0, len(a0), FRONTIER)]
            continue
        if not len(a0):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        up = ones[bit]
        am, bm = a1 - (up[a1] - up[a0]), b1 - (up[b1] - up[b0])  # where each node's upper child begins
        same = a0 == b0
        made = (
            (a0, am, b0, bm, cost), (am, a1, bm, b1, cost),
            (a0, am, bm, b1, cost + 1), tuple(z[~same] for z in (am, a1, b0, bm, cost + 1)),
        )
        a0, a1, b0, b1, cost = (np.concatenate(z) for z in zip(*made, strict=True))
        live = (a1 > a0) & (b1 > b0) & (cost <= most) & ~((a0 == b0) & (a1 - a0 == 1))
        waiting.append((bit - 1, tuple(z[live] for z in (a0, a1, b0, b1, cost))))


def spanning(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest one that the pairs connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _slabs(change: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole buckets of about ``SLAB`` rows, where ``change`` marks a bucket's first row."""
    bounds, n, at = np.append(np.flatnonzero(change), len(change)), len(change), 0
    while at < n:
        k = int(np.searchsorted(bounds, at + SLAB, "right")) - 1
        to = int(bounds[k] if bounds[k] > at else bounds[k + 1])
        yield at, to
        at = to


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets; rows come sorted by bucket, and the last bucket of a batch waits for the next batch."""

    def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        change = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        group = np.cumsum(change)
        order = np.lexsort((values, group))
        values = values[order]
        out = []
        for at, to in _slabs(change):
            own = values[at:to]
            pairs = [(np.zeros(0, np.int64),) * 2, *traverse(own, group[at:to])]
            root = spanning(len(own), *(np.concatenate(x) for x in zip(*pairs, strict=True)))
            moved = np.flatnonzero(root != np.arange(len(own)))
            out.append((own[moved], own[root[moved]]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    keys, values = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)])
        values = np.concatenate([values, batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)])
        last = len(keys) - int(np.argmax((keys[::-1] != keys[-1]).any(axis=1))) if (keys != keys[-1]).any() else 0
        if last:
            yield links(keys[:last], values[:last])
            keys, values = keys[last:], values[last:]
    if len(keys):
        yield links(keys, values)


def block_masks(n: int) -> list[int]:
    """Masks (signed longs) of the bits on which a pair must agree, for so many distinct fingerprints."""
    for b in range(MOST + 1, 9):
        cuts = [round(k * BITS / b) for k in range(b + 1)]
        least = sum(sorted(y - x for x, y in zip(cuts, cuts[1:]))[: b - MOST])
        if n <= PER_BUCKET << least:
            break
    blocks = [((1 << y) - 1) ^ ((1 << x) - 1) for x, y in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in (sum(c) for c in combinations(blocks, b - MOST))]


def links(prints: DataFrame) -> DataFrame:
    """(a, b): a forest whose trees are the components of distinct fingerprints ``fp`` that have partners."""
    masks = block_masks(prints.count())
    dealt = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(m) for m in masks))).alias("c", "m"))
    counted = written(dealt.groupBy("c", "m").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    chunks = F.ceil(F.col("n") / CHUNK)
    other = F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")
    shared = dealt.join(counted, ["c", "m"]).withColumn("own", F.pmod(F.xxhash64("fp"), chunks)).select("c", "m", "own", "fp", other)
    keyed = shared.select("c", "m", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    keys = ["c", "m", "i", "j"]
    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_bucket_links, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of nodes that have edges (a, b): stars grow larger and smaller by turns until every component is one star."""

    def stars(e: DataFrame) -> bool:
        """Whether every a has one edge and is no b: as b < a, each b is then its component's least node."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1").count()

    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(with_fp: DataFrame, id_col: str) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint; component_id is the smallest id of its component."""
    prints = written(with_fp.groupBy(F.col("_s_fp").alias("fp")).agg(F.min(id_col).alias("first_id")), "prints")
    rooted = components(links(prints.select("fp"))).withColumnRenamed("node", "fp")
    rooted = written(prints.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every document."""
    prints = written(with_fingerprint(df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col)), text_col, keep_text=False), "fingerprints")
    found = prints.join(grouped(prints, id_col).withColumnRenamed("fp", "_s_fp"), "_s_fp")
    return found.select(id_col, F.lpad(F.lower(F.hex("_s_fp")), 16, "0").alias("fingerprint"), "component_id")


def _apart(similarity: float, size_a, size_b, bits_a, bits_b) -> np.ndarray:
    """Shingles that at least one of two texts lacks, as far as sizes and sketches tell (bits in which sketches differ); -1 if the
    texts can't be similar."""
    apart = np.maximum(np.bitwise_count(bits_a ^ bits_b).sum(axis=1, dtype=np.int64), abs(size_a - size_b))
    return np.where(apart * (1 + similarity) <= (1 - similarity) * (size_a + size_b) + 1e-6, apart, -1)


def _least(node: np.ndarray, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of positions the one of least ``d``, then ``node[y]``, for each ``node[x]``."""
    rank = np.lexsort((node[y], d, node[x]))
    first = rank[np.concatenate([[True], node[x][rank][1:] != node[x][rank][:-1]])] if len(rank) else rank
    return x[first], y[first], d[first]


def _near_pairs(most: int, nearest: bool, similarity: float):
    """Pairs (a, b, bits apart, root of a, root of b) of a bucket's classes that differ in at most ``most`` bits, lie in different components and can be similar: of each
    class the nearest by sketch of the smaller ones, or all."""

    def compare(rows: np.ndarray, sketch: np.ndarray, group: np.ndarray, out: list) -> None:
        values, node, root, size = rows[:, 3].view(np.uint64), rows[:, 4], rows[:, 5], rows[:, 6]
        best = [(np.zeros(0, np.int64),) * 3]
        for x, y in traverse(values, group, most, LEAF):
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            x, y = np.where(node[x] > node[y], x, y), np.where(node[x] > node[y], y, x)
            for k in range(0, len(x), 1 << 16):
                i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                d = _apart(similarity, size[i], size[j], sketch[i], sketch[j])
                best.append(_least(node, i[d >= 0], j[d >= 0], d[d >= 0]) if nearest else (i[d >= 0], j[d >= 0], d[d >= 0]))
        x, y, d = (np.concatenate(z) for z in zip(*best, strict=True))
        if nearest:
            x, y, d = _least(node, x, y, d)
        out.append((node[x], node[y], d, root[x], root[y]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
            change = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            group = np.cumsum(change)
            order = np.lexsort((rows[:, 3].view(np.uint64), group))
            rows, sketch = rows[order], sketch[order]
            out: list = [(np.zeros(0, np.int64),) * 5]
            for s, e in _slabs(change):
                compare(rows[s:e], sketch[s:e], group[s:e], out)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b", "d", "root_a", "root_b"])

        rows, sketch = np.zeros((0, 7), np.int64), np.zeros((0, SKETCH // 64), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([rows, np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)], axis=1)])
            sketch = np.concatenate([sketch, np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, SKETCH // 64)])
            last = len(rows) - int(np.argmax((rows[::-1, :3] != rows[-1, :3]).any(axis=1))) if (rows[:, :3] != rows[-1, :3]).any() else 0
            if last:
                yield found(rows[:last], sketch[:last])
                rows, sketch = rows[last:], sketch[last:]
        if len(rows):
            yield found(rows, sketch)

    return run


def near_pairs(classes: DataFrame, most: int, nearest: bool, similarity: float) -> DataFrame:
    """(a, b, root_a, root_b) of ``classes`` (class, fp, size, bits, keys, root) that share a key: see ``_near_pairs``; if ``nearest``, one b of each a."""
    dealt = classes.select("class", "root", F.explode("keys").alias("key"))
    met = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "n")
    chunks = F.ceil(F.col("n") / NEAR_CHUNK)
    shared = written(dealt.join(written(met, "met"), "key").select("class", "key", "n"), "shared")
    own = shared.join(classes.select("class", "root", "fp", "size", "bits").hint("merge"), "class").withColumn("own", F.pmod(F.xxhash64("class"), chunks))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    keys = ["key", "i", "j"]
    keyed = own.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "class", "root", "size", "bits")
    found = keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_near_pairs(most, nearest, similarity), "a bigint, b bigint, d bigint, root_a bigint, root_b bigint")
    if nearest:
        return found.groupBy("a").agg(F.min(F.struct("d", "b", "root_a", "root_b")).alias("x")).select("a", "x.b", "x.root_a", "x.root_b")
    return found.select("a", "b", "root_a", "root_b").distinct()


def _alike(shingle: int, similarity: float):
    """Of rows (a, b, x, y) the (a, b) for whose texts x and y the shingle sets have that Jaccard similarity."""

    def shingles(text: str | None) -> set:
        words = (text or "").encode().lower().split()
        return {tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k in range(batch.num_rows):
                x, y = shingles(batch.column(2)[k].as_py()), shingles(batch.column(3)[k].as_py())
                both = len(x & y)
                kept.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def similar_classes(prints: DataFrame, text_col: str, shingle: int, most: int, similarity: float) -> DataFrame:
    """(class, root): components of texts that differ in at most ``most`` bits and are as similar, of rows with fingerprints.

    The nearest pairs are compared first, and the nearest that these links don't connect; whatever isn't connected then is compared pair by
    pair, so the components are those of all pairs, while a group of copies costs a pair or two a copy. A link joins the roots that its
    texts have by then, so that each step merges only what the one before left apart.
    """
    names = ("fp", "size", "bits", "keys")
    classes = written(prints.groupBy(F.col("_s_class").alias("class")).agg(F.min("_s_row").alias("row"), *(F.first(f"_s_{c}").alias(c) for c in names)), "classes")
    rooted = classes.withColumn("root", F.col("class"))
    for nearest in (True, True, False):
        pairs = written(near_pairs(rooted, most, nearest, similarity), "pairs")
        paired = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        # One row stands for a class, so that copies of a text don't meet in a task.
        paired = written(rooted.select("class", "row").join(paired, "class", "left_semi").select(F.col("row").alias("_s_row")), "paired")
        texts = written(prints.select("_s_row", "_s_class", F.col(text_col).alias("text")).join(paired, "_s_row", "left_semi"), "texts")
        left = texts.select(F.col("_s_class").alias("a"), F.col("text").alias("x"))
        right = texts.select(F.col("_s_class").alias("b"), F.col("text").alias("y"))
        read = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("root_a", "root_b", "x", "y")
        alike = written(read.mapInArrow(_alike(shingle, similarity), "a bigint, b bigint"), "alike")
        merged = components(alike).select(F.col("root").alias("top"), F.col("node").alias("root"))
        rooted = rooted.join(merged, "root", "left").select("class", "row", *names, F.coalesce("top", "root").alias("root"))
    return rooted.select("class", "root")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most: int = 20, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` whose id is their component's smallest, one row of each component of ``similar_classes``.

    Of several rows with that id the one whose columns hash least stays, so reruns agree.
    """
    id_, text = place(df, id_col), place(df, text_col)
    columns = [F.col(f"c{k}") for k, (_, kind) in enumerate(df.dtypes) if "map<" not in kind]
    prints = with_fingerprint(plain(df), text, shingle=shingle, with_class=True)
    prints = written(prints.withColumns({"_s_row": F.monotonically_increasing_id(), "_s_hash": F.xxhash64(*columns)}), "fingerprinted")
    rooted = similar_classes(prints, text, shingle, most, similarity).select(F.col("class").alias("_s_class"), F.col("root").alias("_s_root"))
    # The row that stays is found by ids and hashes alone, of each class first; only then texts are read.
    least = lambda rank: F.min(rank).alias("least")
    firsts = prints.groupBy("_s_class").agg(least(F.struct(F.col(id_).isNull().alias("no"), F.col(id_).alias("id"), F.col("_s_hash").alias("hash"), F.col("_s_row").alias("row"))))
    chosen = firsts.join(rooted, "_s_class").groupBy("_s_root").agg(least(F.col("least"))).select(F.col("least.row").alias("_s_row"))
    kept = prints.join(written(chosen, "chosen").hint("merge"), "_s_row", "left_semi")  # the same plan at every size
    return named(kept.select(*(f"c{k}" for k in range(len(df.columns)))), df)
