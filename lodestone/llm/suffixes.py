"""Removal of repeated passages by suffix sorting.

A byte goes if it is covered by a string of 50 bytes that also starts in a document with a smaller id. Exactly:

1. Anchors. The least 16-byte hash in each window of 50 bytes is the window's anchor, so equal windows have equal anchors.
   Windows in a row with one anchor make a context. Hashes of anchors and contexts of all documents, packed by
   batch, are dealt to buckets. A context that an earlier document has too is a repeat as a whole. What is left to
   decide are the first occurrences of contexts whose anchor has other contexts as well: only their text is sent on.
2. Suffix arrays. The contexts of an anchor meet in one task, which sorts their suffixes in two stages: suffixes smaller than
   their successors are sorted directly, the rest are induced from them by a scan over the buckets of first bytes.
   Adjacent suffixes with 50 common bytes are equal windows; the smallest id among them decides whose are repeats. An
   anchor with more than ``HOT`` such contexts, or 8 MB of them, gives its single windows instead, which are spread by their own value.
3. The windows found are sent back to their documents, merged and cut out. Text moves compressed.

Contexts are told apart by 48 bits besides those of their anchor.

Edge cases: a null text is empty; texts under 50 bytes lose nothing; a null id is neither smaller nor larger than any, so its row loses
nothing and makes none lose; rows with one id aren't compared with each other, and equal rows lose the same; an empty
table gives an empty table; other columns are not read. The separator 0xFF can't occur in UTF-8.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestone.sources.scratch import written

LENGTH = 50
GRAM = 16
BUCKET_BYTES = 16 << 20  # of text for a bucket of anchors
SLAB_BYTES = 1 << 20  # of contexts in one suffix array
BLOCK_BYTES = 1 << 20  # of a text read at once
READ_BYTES = 1 << 18  # of short texts read together
HOT, HOT_BYTES = 20_000, 8 << 20
GAP = 0xFF
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93))


def grams(b: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at each place, by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    n = 1
    while n < GRAM:
        low = h[:-n] * _M1
        low ^= low >> np.uint64(29)
        h = low + h[n:] * _M2
        n *= 2
    h = (h ^ (h >> np.uint64(32))) * _M3
    return h ^ (h >> np.uint64(32))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random words for bytes, powers of an odd number and of its inverse."""
    n = BLOCK_BYTES + LENGTH
    base = 0x9FB21C651E98DF25
    power = lambda x: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(x)), dtype=np.uint64)])
    return np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), power(base), power(pow(base, -1, 1 << 64))


def contexts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, hash) of each context of a text."""
    return contexts_of([raw])[1:]


def contexts_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, anchor, first window, number of windows, hash) of each context of several texts, in their order.

    Short texts are read together. A long one is read in blocks; a context ends with its block, which changes only
    what is left to the suffix arrays.
    """
    none = np.zeros(0, np.int64)
    found, pieces, size = [(none, none.astype(np.uint64), none, none, none.astype(np.uint64))], [], 0
    for k, raw in enumerate(texts):
        for at in range(0, len(raw) - LENGTH + 1, BLOCK_BYTES):
            piece = raw[at : at + BLOCK_BYTES + LENGTH - 1]
            if pieces and size + len(piece) > min(BLOCK_BYTES, READ_BYTES):
                found.append(_contexts(pieces))
                pieces, size = [], 0
            pieces.append((k, at, piece))
            size += len(piece)
    if pieces:
        found.append(_contexts(pieces))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _contexts(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for pieces (number of the text, place in it, at least 50 bytes)."""
    raw = b"".join(piece for _, _, piece in pieces)
    symbols = np.frombuffer(raw, np.uint8)
    size = np.array([len(piece) for _, _, piece in pieces])
    begin = np.cumsum(size) - size
    least, n, width = grams(symbols), 1, LENGTH - GRAM + 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    least = np.minimum(least[: len(raw) - LENGTH + 1], least[width - n :])
    new = np.concatenate([[True], least[1:] != least[:-1]])
    new[begin] = True
    new[(begin + size - LENGTH + 1)[:-1]] = True  # from here to the next piece, windows would lie in both
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(least)))
    piece = np.searchsorted(begin, first, side="right") - 1
    whole = first - begin[piece] <= size[piece] - LENGTH
    first, windows, piece = first[whole], windows[whole], piece[whole]
    word, power, inverse = _powers()
    sums = np.concatenate([[np.uint64(0)], np.cumsum(word[symbols] * power[: len(raw)], dtype=np.uint64)])
    h = (sums[first + windows + LENGTH - 1] - sums[first]) * inverse[first] + windows.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _M3
    text, base = (np.array([p[c] for p in pieces], np.int64)[piece] for c in (0, 1))
    return text, least[first], first - begin[piece] + base, windows, h ^ (h >> np.uint64(29))


def keys(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, 32 bits of hash in the lower half; two anchors that collide cost time, not truth."""
    return (((anchor >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (anchor & np.uint64(0xFFFFFFFF))).astype(np.int64)


def context_ids(anchor: np.ndarray, h: np.ndarray) -> np.ndarray:
    """48 bits of a context, 16 of its anchor."""
    return ((h << np.uint64(16)) | (anchor & np.uint64(0xFFFF))).view(np.int64)


def two_stage_sort(text: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` in an order that is right for their first 50 bytes at least.

    With ``wanted`` (a flag for each place) only these suffixes are sorted, and those that they are induced from.
    """
    n = len(text)
    words = _words(np.concatenate([text, np.zeros(64, np.uint8)]))
    following = np.append(text[1:].astype(np.int16), -1)
    rise = np.where(text < following, 1, np.where(text > following, -1, 0)).astype(np.int8)
    # Of a run of one byte, all have the type of its last place.
    change = np.flatnonzero(rise).astype(np.int32)
    run = np.diff(change, prepend=np.int32(-1))
    kind = np.repeat(rise[change], run)
    used = np.ones(n, bool)
    if wanted is not None:
        # A larger suffix is induced from the next one, and so on until a smaller one.
        small = np.append(np.flatnonzero(kind == 1), n - 1)
        last = np.flatnonzero(wanted & (kind == -1) & ~np.append(wanted[1:], False))
        until = small[np.searchsorted(small, last)]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, last, 1)
        np.subtract.at(edge, until + 1, 1)
        used = wanted | (np.cumsum(edge[:n], out=edge[:n]) > 0)
        del small, last, until, edge
    smaller = _sorted_directly(words, np.flatnonzero(used & (kind == 1)).astype(np.int32))
    del words, following, rise
    of_smaller = np.bincount(text[smaller], minlength=256)
    cuts = np.cumsum(of_smaller)
    larger = np.flatnonzero(used & (kind == -1)).astype(np.int32)
    larger = larger[np.argsort(text[larger], kind="stable")]
    in_larger = np.bincount(text[larger], minlength=256)
    of_larger = np.cumsum(in_larger)
    order, rank = np.empty(len(smaller) + len(larger), np.int32), np.zeros(n, np.int32)
    step = np.repeat(change, run)[larger] - larger  # places to the end of its run
    at = 0
    for c in np.flatnonzero(of_smaller + in_larger):
        own = larger[of_larger[c] - in_larger[c] : of_larger[c]]
        depth = step[of_larger[c] - in_larger[c] : of_larger[c]]
        d = 0
        while len(own):
            level = own[depth == d]
            if d and d > 64:  # beyond what 50 bytes tell apart, any order will do
                level, own, depth = own, own[:0], depth[:0]
            else:
                own, depth = own[depth != d], depth[depth != d]
            after = np.where(level + 1 < n, rank[np.minimum(level + 1, n - 1)], -1)
            level = level[np.argsort(after, kind="stable")]
            order[at : at + len(level)] = level
            rank[level] = np.arange(at, at + len(level))
            at += len(level)
            d += 1
        direct = smaller[cuts[c] - of_smaller[c] : cuts[c]]
        order[at : at + len(direct)] = direct
        rank[direct] = np.arange(at, at + len(direct))
        at += len(direct)
    return order


def _sorted_directly(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in the order of the 50 bytes there: by eight bytes, and as long as some tie, these by further ones."""
    order = places[np.argsort(words[places])]
    among, key, depth = np.arange(len(order), dtype=np.int32), words[order], 8
    while depth < LENGTH:
        same = key[1:] == key[:-1]
        tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if not tied.any():
            break
        group = np.cumsum(np.concatenate([[True], ~same]), dtype=np.uint64)[tied]
        among = among[tied]
        n = min(7, (64 - int(group[-1]).bit_length()) // 8)  # bytes beside the number of the group
        group <<= np.uint64(8 * n)
        key = words[order[among] + np.int32(depth)]
        key >>= np.uint64(64 - 8 * n)
        key |= group
        del group
        by = np.argsort(key).astype(np.int32)
        order[among] = order[among[by]]
        key = key[by]
        depth += n
    return order


def _words(padded: np.ndarray) -> np.ndarray:
    """Big-endian words of the eight bytes at each place but the last seven."""
    w, n = padded.astype(np.uint64), 1
    while n < 8:
        w = (w[:-n] << np.uint64(8 * n)) | w[n:]
        n *= 2
    return w


def repeats(text: np.ndarray, sizes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Whether the window at each place of ``text`` has a smaller owner elsewhere in it.

    ``text`` holds contexts of the given sizes and owners, with a separator behind each.
    """
    wanted = np.repeat(np.arange(2 * len(sizes)) % 2 == 0, np.stack([sizes - LENGTH + 1, np.full(len(sizes), LENGTH)], axis=1).ravel())  # where a window starts
    order = two_stage_sort(text, wanted)
    order = order[wanted[order]]
    words = _words(np.concatenate([text, np.zeros(64, np.uint8)]))
    a, b = order[:-1], order[1:]
    common = words[a] == words[b]  # 50 common bytes of neighbours
    near = np.flatnonzero(common)
    for k in (8, 16, 24, 32, 40, LENGTH - 8):
        near = near[words[a[near] + k] == words[b[near] + k]]
    common[:] = False
    common[near] = True
    group = np.flatnonzero(np.concatenate([[True], ~common]))
    own = np.repeat(owners, sizes + 1)[order]
    late = np.zeros(len(text), bool)
    late[order] = np.repeat(np.minimum.reduceat(own, group), np.diff(np.append(group, len(order)))) < own
    return late


def _pack(texts: DataFrame) -> DataFrame:
    """(doc_id, th, z): what identifies a row, and its text compressed, as it moves between tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = pa.array((squeeze.compress((t.as_py() or "").encode()) for t in batch.column(2)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], ["doc_id", "th", "z"])

    return texts.mapInArrow(add, "doc_id long, th long, z binary")


def known_contexts(texts: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, ctx, repeat): contexts that an earlier document has too, and first ones that have to be looked into."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, ctx = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            ids_ = batch.column(0).to_pylist()
            for rows_, raws in _read(range(batch.num_rows), lambda k: (batch.column(2)[k].as_py() or "").encode()):  # noqa: B023
                text, anchor, _, _, h = contexts_of(raws)
                ids, key_ = context_ids(anchor, h), keys(anchor, buckets)
                cuts = np.searchsorted(text, np.arange(len(raws) + 1))
                for k, s, e in zip(rows_, cuts, cuts[1:], strict=False):
                    own, one = np.unique(ids[s:e], return_index=True)
                    key.append(key_[s:e][one])
                    ctx.append(own)
                    doc.append(np.full(len(own), ids_[k], np.int64))
            key, doc, ctx = np.concatenate(key), np.concatenate(doc), np.concatenate(ctx)
            order = np.argsort(key >> 32, kind="stable")
            key, doc, ctx = key[order], doc[order], ctx[order]
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(key >> 32) != 0])) if len(key) else np.zeros(0, np.int64)
            rows = []
            for s, e in zip(cuts, np.append(cuts, len(key))[1:], strict=True):
                change = np.flatnonzero(np.concatenate([[True], doc[s + 1 : e] != doc[s : e - 1]]))
                counts = np.diff(np.append(change, e - s)).astype("<u4")
                own = ctx[s:e].view(np.uint64)
                packed = (doc[s:e][change].tobytes(), counts.tobytes(), (key[s:e] & 0xFFFFFFFF).astype("<u4").tobytes(), (own >> np.uint64(32)).astype("<u4").tobytes(), ((own >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2").tobytes())
                rows.append((int(key[s] >> 32), *packed))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "docs", "counts", "anchors", "high", "low"])

    def find(table: pa.Table) -> pa.Table:
        kinds = ((1, np.int64), (2, "<u4"), (3, "<u4"), (4, "<u4"), (5, "<u2"))
        docs, counts, h, high, low = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(k)]) for k, kind in kinds)
        doc = np.repeat(docs, counts)
        ctx = (high.astype(np.uint64) << np.uint64(32)) | (low.astype(np.uint64) << np.uint64(16)) | (h.astype(np.uint64) & np.uint64(0xFFFF))
        order = np.lexsort((doc, ctx, h))
        doc, ctx, h = doc[order], ctx[order].view(np.int64), h[order]
        new_anchor = np.concatenate([[True], h[1:] != h[:-1]])
        new_context = new_anchor | np.concatenate([[True], ctx[1:] != ctx[:-1]])
        at, cut = np.flatnonzero(new_anchor), np.flatnonzero(new_context)
        spread = lambda value, start: np.repeat(value, np.diff(np.append(start, len(h))))
        first = spread(doc[cut], cut) == doc  # of its context: the smallest id
        several = spread(np.add.reduceat(new_context.astype(np.int64), at) > 1, at)
        shared = spread(np.maximum.reduceat(doc, at) > np.minimum.reduceat(doc, at), at)
        kept = ~first | (several & shared)
        return pa.table({"doc_id": doc[kept], "ctx": ctx[kept], "repeat": ~first[kept]})

    packed = texts.mapInArrow(pack, "bucket int, docs binary, counts binary, anchors binary, high binary, low binary")
    return packed.groupBy("bucket").applyInArrow(find, "doc_id long, ctx long, repeat boolean")


SPANS = "array<struct<s:int,e:int>>"
SPAN = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _spans(of: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(distinct values of ``of``, list of spans of each), where equal values stand together."""
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32())], fields=list(SPAN.value_type))
    return of[cut], pa.ListArray.from_arrays(pa.array(np.append(cut, len(of)), pa.int32()), pairs, type=SPAN)


def _read(rows: range, text: Callable[[int], bytes]) -> Iterator[tuple[range, list[bytes]]]:
    """Ranges of rows with their texts, a range as soon as it has ``SLAB_BYTES``."""
    raws, size, begin = [], 0, 0
    for k in rows:
        raws.append(text(k))
        size += len(raws[-1])
        if size >= SLAB_BYTES or k == rows[-1]:
            yield range(begin, k + 1), raws
            raws, size, begin = [], 0, k + 1


def told(packed: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, th, at, key, context, spans): a row of spans of each text's repeated contexts, and a row for each context to look into."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), SPAN]

        def put(n: int, *columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "th", "at", "key", "context", "spans"])

        for batch in batches:
            doc, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for rows, raws in _read(range(batch.num_rows), lambda k: unpack.decompress(batch.column(2)[k].as_py())):  # noqa: B023
                text, anchor, start, n, h = contexts_of(raws)
                ids = context_ids(anchor, h)
                whole, open_ = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
                cuts = np.searchsorted(text, np.arange(len(raws) + 1))
                for k, s, e in zip(rows, cuts, cuts[1:], strict=False):
                    for column, told_ in ((3, whole), (4, open_)):
                        own = batch.column(column)[k].values
                        if len(own) and e > s:
                            own = np.sort(own.to_numpy(zero_copy_only=False))
                            told_[s:e] = own[np.minimum(np.searchsorted(own, ids[s:e]), len(own) - 1)] == ids[s:e]
                if whole.any():
                    of, s, e = text[whole], start[whole], (start + n)[whole] + LENGTH - 1
                    gap = np.flatnonzero(np.concatenate([[True], (s[1:] > e[:-1]) | (of[1:] != of[:-1])]))  # neighbours are one span
                    last = np.append(gap[1:], len(s)) - 1
                    of, spans = _spans(of[gap], s[gap], e[last])
                    yield put(len(of), doc[rows[0] + of], th[rows[0] + of], None, None, None, spans)
                if open_.any():
                    of, s, e = text[open_], start[open_], (start + n)[open_] + LENGTH - 1
                    found = [raws[k][a:b] for k, a, b in zip(of.tolist(), s.tolist(), e.tolist(), strict=True)]
                    yield put(len(of), doc[rows[0] + of], th[rows[0] + of], s, keys(anchor[open_], buckets), found, None)

    own = known.groupBy("doc_id").agg(F.collect_set(F.when(F.col("repeat"), F.col("ctx"))).alias("whole"), F.collect_set(F.when(~F.col("repeat"), F.col("ctx"))).alias("open"))  # at most a document's contexts
    # Merge joins here and below: the same plan at every size.
    joined = packed.join(own.hint("merge"), "doc_id").select("doc_id", "th", "z", "whole", "open")
    return joined.mapInArrow(emit, f"doc_id long, th long, at int, key long, context binary, spans {SPANS}")


def _sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, spans) of rows (key, doc_id, th, at, context) that come sorted by key."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        doc, th, at = (rows.column(k).to_numpy() for k in (1, 2, 3))
        context = rows.column(4).combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(context.buffers()[1], np.int64)[context.offset : context.offset + len(context) + 1]
        sizes = np.diff(bounds)
        which = np.repeat(np.arange(len(sizes)), sizes)
        text = np.full(len(which) + len(sizes), GAP, np.uint8)
        text[np.arange(len(which)) + which] = np.frombuffer(context.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        late = repeats(text, sizes, doc)
        change = np.flatnonzero(np.diff(np.concatenate([[0], late.astype(np.int8), [0]])))
        s, e = change[::2], change[1::2]
        begins = bounds[:-1] - bounds[0] + np.arange(len(sizes))
        of = np.searchsorted(begins, s, side="right") - 1
        s, e = s - begins[of] + at[of], e - begins[of] + at[of] - 1 + LENGTH
        of, spans = _spans(of, s, e)
        return pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(th[of]), spans], ["doc_id", "th", "spans"])

    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        key = batch.column(0).to_numpy()
        bytes_ = np.cumsum(pc.binary_length(batch.column(4)).to_numpy())
        new = np.flatnonzero(np.concatenate([[len(key) > 0 and last is not None and key[0] != last], key[1:] != key[:-1]]))  # where a key starts
        done = 0
        for cut in new.tolist():
            inside = int(bytes_[cut - 1] if cut else 0) - int(bytes_[done - 1] if done else 0)
            if size + inside >= SLAB_BYTES:
                yield solve([*held, batch.slice(done, cut - done)])
                held, size, done = [], 0, cut
        if done < len(key):
            held.append(batch.slice(done))
            size += int(bytes_[-1]) - int(bytes_[done - 1] if done else 0)
            last = key[-1]
    if held:
        yield solve(held)


def looked_into(found: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, th, spans): windows of contexts (key, doc_id, th, at, context) that earlier ones have."""
    counted = found.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("context")).alias("bytes"))
    crowded = written(counted.where((F.col("n") > hot) | (F.col("bytes") > HOT_BYTES)).select("key"), "crowded")
    plain = found.join(crowded, "key", "left_anti").select("key", "doc_id", "th", "at", "context")
    plain = plain.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_repeats, f"doc_id long, th long, spans {SPANS}")
    # Windows of anchors with very many contexts, one by one: rows are spread by window, and equal ones meet by partial aggregates.
    windows = F.transform(F.sequence(F.lit(0), F.octet_length("context") - LENGTH), lambda i: F.struct((F.col("at") + i).alias("s"), F.substring(F.col("context"), i + 1, F.lit(LENGTH)).alias("window")))
    single = found.join(crowded, "key", "left_semi").select("doc_id", "th", F.explode(windows).alias("w")).select("doc_id", "th", "w.*")
    late = single.join(single.groupBy("window").agg(F.min("doc_id").alias("least")), "window").where("least < doc_id")
    return plain.unionByName(late.select("doc_id", "th", F.array(F.struct("s", (F.col("s") + LENGTH).alias("e"))).alias("spans")))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        size, removed, spans, sha, kept = [], [], [], [], []
        for k in range(batch.num_rows):
            raw = unpack.decompress(batch.column(1)[k].as_py())
            gone = batch.column(2)[k]
            n_spans = 0
            if gone.is_valid and len(raw) >= LENGTH:
                pairs = gone.values.flatten() if len(gone.values) else None
                depth = np.zeros(len(raw) + 1, np.int32)
                if pairs is not None:
                    np.add.at(depth, np.minimum(pairs[0].to_numpy(zero_copy_only=False), len(raw)), 1)
                    np.add.at(depth, np.minimum(pairs[1].to_numpy(zero_copy_only=False), len(raw)), -1)
                cover = np.cumsum(depth[:-1]) > 0
                n_spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                left = np.frombuffer(raw, np.uint8)[~cover].tobytes()
            else:
                left = raw
            size.append(len(raw))
            removed.append(len(raw) - len(left))
            spans.append(n_spans)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _sweep(df: DataFrame) -> DataFrame:
    """Lets Spark delete the shuffle files of finished phases, which it does as the driver collects garbage."""
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return df


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-total // BUCKET_BYTES))
    named = F.col("doc_id").isNotNull()
    known = _sweep(written(known_contexts(texts.where(named), buckets), "known"))
    packed = _pack(texts)
    found = _sweep(written(told(packed.where(named), known, buckets), "found"))
    open_ = found.where("key IS NOT NULL").select("key", "doc_id", "th", "at", "context")
    spans = found.where("spans IS NOT NULL").select("doc_id", "th", "spans").unionByName(looked_into(open_, hot))
    marks = _sweep(written(spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("gone")), "marks"))  # at most a document's contexts
    rows = packed.join(marks.hint("merge"), ["doc_id", "th"], "left").select("doc_id", "z", "gone")
    return rows.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text")).drop("kept")
