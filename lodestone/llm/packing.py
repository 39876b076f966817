"""Best-fit packing of token sequences, improved by swaps.

Documents are tokenized, cut only where they exceed the capacity, and the pieces are dealt at random into
groups of about ``BINS_PER_GROUP`` full bins. A group starts from best-fit decreasing; then documents are moved
between underfull bins, or exchanged one for one and two for one, wherever that increases the sum of squared fills,
until bins empty. What is left in underfull bins of all groups is dealt and packed again, until a round doesn't lessen them.

Edge cases: a null or empty text is the end token alone; repeated rows are packed as rows of their own; a null id
stays null; an empty table gives an empty table; other columns are not read; a text of any length is cut into as many
pieces as it needs. Only lengths move between tasks, never ids.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestone.sources.scratch import written

CAPACITY = 4096
END_ID = 1
BINS_PER_GROUP = 1024
FULL = 0.985
SLAB_WORDS = 400_000
ROWS = 2048  # whose words are encoded at once
HELD_BYTES = 48 << 20  # of ids that a worker holds
PIECES = "id {}, piece int, start long, length long, ids_crc32 long"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Fixed value: the pattern by which the tokenizer of the packing query cuts words, after lower-casing.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "a-z\u00e0-\u00f6\u00f8-\u00ff"  # of lower case, which no normal form changes
MARKS = string.punctuation


class Encoder:
    """Ids of words. A string is encoded once and held over all batches of a worker; what is held is bounded, and what isn't
    held is encoded again."""

    def __init__(self, tokenizer):
        self.tokenizer, self.held, self.size = tokenizer, {}, 0
        rules = json.loads(tokenizer.to_str())
        before = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        after = (rules.get("normalizer") or {}).get("normalizers") or [{}]
        # Where the tokenizer's rule is this known one, letters and the marks after them are told apart without it.
        self.splits = len(before) == 2 and before[0].get("pattern") == {"Regex": WORD_PARTS} and before[1].get("type") == "ByteLevel" and after[-1].get("type") == "Lowercase"
        if self.splits:
            from tokenizers.pre_tokenizers import ByteLevel

            spell = ByteLevel(add_prefix_space=False, use_regex=False)
            self.spelling = {k: spell.pre_tokenize_str(chr(k))[0][0] for k in range(0xE0, 0x100)}

    def _encode(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            encoding = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(some)) if len(encoding) else np.zeros(len(some), np.int64)
            raw, start = np.array(encoding.ids, np.uint32).tobytes(), 0
            for end in (4 * np.cumsum(counts)).tolist():
                out.append(raw[start:end])
                start = end
        return out

    def _encode_part(self, part: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(part if part.isascii() else part.translate(self.spelling)) if part else []
        return np.array([t.id for t in tokens], np.uint32).tobytes()

    def strings(self, values: list[str], parts: bool) -> list[bytes]:
        """32-bit ids of distinct words, or of parts of words, which the tokenizer's rule doesn't cut."""
        held = self.held
        new = [v for v in values if v not in held]
        made = [self._encode_part(v) for v in new] if parts else self._encode(new)
        coded = dict(zip(new, made, strict=True))
        found = [coded[v] if v in coded else held[v] for v in values]
        for v, ids in coded.items():
            if self.size > HELD_BYTES:
                break
            held[v] = ids
            self.size += 200 + 2 * len(v) + len(ids)
        return found

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each word has."""
        if not self.splits:
            ids = self.strings(words.to_pylist(), False)
            return np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        low = pc.utf8_lower(words)
        base = pc.ascii_rtrim(low, MARKS)
        simple = pc.and_(pc.match_substring_regex(base, f"^[{LETTERS}]*$"), pc.match_substring_regex(words, "^[\\x21-\\x7e\u00c0-\u00ff]*$"))
        base = pc.if_else(simple, base, "").dictionary_encode()
        marks = pc.if_else(simple, pc.replace_substring_regex(low, f"^[{LETTERS}]*", ""), "").dictionary_encode()
        other = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        coded = self.strings(base.dictionary.to_pylist(), True) + self.strings(marks.dictionary.to_pylist(), True) + self.strings(words.take(pa.array(other)).to_pylist(), False)
        # Of each word two places in ``coded``: its letters and its marks, or itself and nothing.
        first, second = base.indices.to_numpy().astype(np.int64), marks.indices.to_numpy() + np.int64(len(base.dictionary))
        first[other] = len(base.dictionary) + len(marks.dictionary) + np.arange(len(other))
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids, starts = np.frombuffer(b"".join(coded), np.uint32), np.cumsum(lengths) - lengths
        both = np.stack([first, second], axis=1).ravel()
        n = lengths[both]
        ends = np.cumsum(n)
        return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[both] - (ends - n), n)], lengths[first] + lengths[second]


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(_tokenizer(path))


def token_ids(texts: pa.Array, encoder: Encoder) -> Iterator[np.ndarray]:
    """Ids of each text, with the end token.

    The tokenizer never joins characters across ASCII white space, so each distinct word is encoded
    once and texts are put together from words. Texts are gathered in slabs, a long one alone.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    ids, counts = encoder.words(coded.dictionary)
    begins = np.cumsum(counts) - counts
    index, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLAB_WORDS, "right")) - 1)
        own = index[bounds[at] : bounds[to]]
        n = counts[own]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        gathered = ids[np.arange(total) + np.repeat(begins[own] - (ends - n), n)]
        cut = np.concatenate([[0], ends])[bounds[at : to + 1] - bounds[at]]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            yield np.append(gathered[s:e], np.uint32(END_ID))
        at = to


def _cutter(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            texts = (ids for at in range(0, batch.num_rows, ROWS) for ids in token_ids(batch.column(1).slice(at, ROWS), encoder))
            for k, ids in enumerate(texts):
                for j, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    row.append(k)
                    piece.append(j)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every text."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(_cutter(tokenizer_path, capacity), PIECES.format(kind))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of items, each item, largest first, where it leaves the least room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin with room r
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        left = mask >> size
        if left:
            r = size + (left & -left).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
            bins[b].append(k)
        else:
            r, b = capacity, len(bins)
            bins.append([k])
        room[r - size].append(b)
        mask |= 1 << (r - size)
    return bins


class _Bins:
    """Underfull bins: the members, fill and room of each, and the bin of every item."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.size, self.capacity = sizes, capacity
        self.members = [list(b) for b in bins]
        self.fill = np.array([int(sizes[np.array(b)].sum()) for b in bins], np.int64)
        self.item = np.array([k for b in bins for k in b], np.int64)
        self.where = np.full(len(sizes), -1)
        self.where[self.item] = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def pairs(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a bin's members, and their sums."""
        if j not in self.held:
            own = np.array(self.members[j])
            x, y = np.triu_indices(len(own), 1)
            self.held[j] = (np.stack([own[x], own[y]], axis=1), self.size[own[x]] + self.size[own[y]])
        return self.held[j]

    def step(self, g: int) -> tuple[list[int], int, list[int]] | None:
        """An exchange that takes something out of bin g: (items given, bin, items got), or None.

        It moves tokens into a bin that is at least as full, so it increases the sum of squared fills.
        """
        room = np.where(self.fill >= self.fill[g], self.capacity - self.fill, 0)
        room[g] = 0
        giver = sorted(self.members[g], key=lambda k: -self.size[k])
        for a in giver:  # move
            fits = np.flatnonzero(room >= self.size[a])
            if len(fits):
                return [a], int(fits[np.argmin(room[fits])]), []
        size, most, best, found = self.size[self.item], room[self.where[self.item]], 0, None
        for items in [[a] for a in giver] + [[a, b] for i, a in enumerate(giver) for b in giver[i + 1 :]]:  # one or two for one
            gain = self.size[items].sum() - size
            gain[gain > most] = 0
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = int(gain[k]), (items, int(self.where[self.item[k]]), [int(self.item[k])])
        if found:
            return found
        for a in giver:  # one for two
            for j in np.flatnonzero(room).tolist():
                pair, total = self.pairs(j)
                gain = self.size[a] - total
                gain[gain > room[j]] = 0
                if len(gain) and gain.max() > best:
                    k = int(np.argmax(gain))
                    best, found = int(gain[k]), ([a], j, pair[k].tolist())
            if found:
                return found
        return None

    def exchange(self, g: int, items: list[int], j: int, got: list[int]) -> None:
        self.members[g] = [k for k in self.members[g] if k not in items] + got
        self.members[j] = [k for k in self.members[j] if k not in got] + items
        gain = int(self.size[items].sum()) - int(self.size[got].sum() if got else 0)
        self.fill[g] -= gain
        self.fill[j] += gain
        self.where[items], self.where[got] = j, g
        self.held.pop(g, None)
        self.held.pop(j, None)


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins, the emptiest first, until none increases the sum of squared fills;
    stops at the least number of bins that could hold all items."""
    fill = lambda b: int(sizes[np.array(b, np.int64)].sum())
    loose = _Bins(sizes, [b for b in bins if fill(b) < FULL * capacity], capacity)
    full, least = [b for b in bins if fill(b) >= FULL * capacity], -(-int(loose.fill.sum()) // capacity)
    moved, count = True, len(loose.members)
    while moved and count > least:
        moved = False
        for g in np.argsort(loose.fill, kind="stable").tolist():
            while loose.members[g] and count > least and (step := loose.step(g)):
                loose.exchange(g, *step)
                moved = True
                count -= not loose.members[g]
    return full + [b for b in loose.members if b]


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(sizes, best_fit(sizes, capacity), capacity)


def _packer(capacity: int, round_: int):
    def packed(found: pa.Table) -> pa.Table:
        # Ids stay in Arrow: beside a null, pandas would turn long ones into doubles.
        keys = [("length", "descending"), *((c, "ascending") for c in ("id", "piece", "start", "ids_crc32"))]
        found = found.take(pc.sort_indices(found, sort_keys=keys, null_placement="at_end"))
        sizes = found.column("length").to_numpy()
        sequence, offset, filled = (np.zeros(len(sizes), np.int64) for _ in range(3))
        base = (round_ << 56) | (found.column("_p_group")[0].as_py() << 24)
        for number, b in enumerate(pack(sizes, capacity)):
            at = np.array(b, np.int64)
            ends = np.cumsum(sizes[at])
            sequence[at], offset[at], filled[at] = base + number, ends - sizes[at], ends[-1]
        for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", filled)):
            found = found.append_column(name, pa.array(values))
        return found.drop_columns("_p_group")

    return packed


def _round(found: DataFrame, capacity: int, round_: int) -> DataFrame:
    total = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, round(total / (capacity * BINS_PER_GROUP)))
    kind = found.schema["id"].dataType.simpleString()
    # By a row's place in the written table, so that equal rows are spread as well.
    deal = F.pmod(F.xxhash64(F.lit(round_), F.monotonically_increasing_id()), F.lit(groups))
    return found.withColumn("_p_group", deal).groupBy("_p_group").applyInArrow(_packer(capacity, round_), PIECES.format(kind) + ", sequence_id long, offset long, fill long")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, place there, check sum, sequence and place in the sequence.

    Underfull sequences of all groups are packed anew until a round doesn't lessen them, or they are as few as their tokens need.
    """
    underfull = F.col("fill") < FULL * capacity

    def sequences(found: DataFrame) -> tuple[int, int]:
        """How many there are, and how many their tokens need at least."""
        n, total = found.where("offset = 0").agg(F.count("*"), F.coalesce(F.sum("fill"), F.lit(0))).first()
        return n, -(-total // capacity)

    last = written(_round(written(pieces(df, tokenizer_path, capacity, id_col, text_col), "pieces"), capacity, 1), "packed")
    done, round_ = [], 1
    while True:
        rest = last.where(underfull)
        n, least = sequences(rest)
        if n <= least:
            break
        again = written(_round(rest.drop("sequence_id", "offset", "fill"), capacity, round_ + 1), "packed")
        if sequences(again)[0] >= n:
            break
        done.append(last.where(~underfull))
        last, round_ = again, round_ + 1
    for found in done:
        last = last.unionByName(found)
    return last.drop("fill").withColumnRenamed("id", id_col)
