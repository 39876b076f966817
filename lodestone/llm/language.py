"""Languages of texts by unigram models of pieces, summed over all ways to cut a word into pieces.

The pieces are those of a fixed public vocabulary, as byte strings; every byte is one, so every word can be cut. A language is a
probability for each piece. A word's probability is the sum over all its cuts of the product of its pieces, which the forward
algorithm gives; a text's is the product over its words. Pieces never join words, so words, lower-cased runs of letters behind a blank, are scored
apart, each distinct one once. The probabilities are fitted by expectation maximisation on the counts of words in each language: the
forward and backward sums give how often each piece is expected in each word. Only the table of languages and pieces, whose size is that of the vocabulary
for each language, comes to the driver.

Edge cases: a null text, and one without a letter, is ``und`` with score 0; so is every text where no row can be learnt from. A null lang
teaches nothing; a null id counts as the empty string in the split; repeated rows count each time; equal scores go to the language
of the smaller name; texts and words of any length are scored whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestone.sources.scratch import written

ROUNDS = 3  # of expectation maximisation
ALPHA = 0.1  # added to each piece's expected count
CELLS = 80_000  # words whose cuts are summed at once, times their languages
HELD = 1_200_000  # scores of words that a worker keeps
UND = "und"
ROWS = 2048  # texts that are split into words at once


class Vocabulary:
    """Byte strings of the pieces of a vocabulary file, each once, and all single bytes; and the tree of their beginnings."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = (model.id_to_piece(k).replace("▁", " ") for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k)))
        self.of = {b: k for k, b in enumerate(sorted({bytes([b]) for b in range(256)} | {t.encode() for t in texts if t}))}
        self.lengths = np.array([len(b) for b in self.of], np.int64)
        # Nodes with others below them come first, as only they have a row of the table: node and byte (256 behind a word) to node, -1 if none.
        inner = dict.fromkeys(b[:k] for b in self.of for k in range(len(b)))
        node = {b: k for k, b in enumerate([*inner, *(b for b in self.of if b not in inner)])}
        self.inner = len(inner)
        self.below = np.full((self.inner, 257), -1, np.int32)
        self.piece = np.full(len(node), -1, np.int32)
        for b, k in node.items():
            self.piece[k] = self.of.get(b, -1)
            if b:
                self.below[node[b[:-1]], b[-1]] = k


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """All cuts of some words: edges between places of the words' bytes, put one after another."""

    def __init__(self, words: list[str], known: Vocabulary):
        raw = [f" {w}".encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1  # the place before each word
        self.last = self.first + sizes
        self.places = int((sizes + 1).sum())
        data = np.full(self.places, 256, np.int16)
        word_of = np.repeat(np.arange(len(raw)), sizes + 1)
        inside = np.ones(self.places, bool)
        inside[self.last] = False
        data[inside] = np.frombuffer(b"".join(raw), np.uint8)
        found, at, node, length = [], np.arange(self.places), np.zeros(self.places, np.int64), 0
        while len(at):  # from every place down the tree, byte by byte
            node = known.below[node, data[at + length]].astype(np.int64)
            at, node, length = at[node >= 0], node[node >= 0], length + 1
            piece = known.piece[node]
            found.append((at[piece >= 0], piece[piece >= 0].astype(np.int64), length))
            at, node = at[node < known.inner], node[node < known.inner]
        start, piece = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        end = start + np.repeat([f[2] for f in found], [len(f[0]) for f in found]).astype(np.int64)
        word = word_of[start]
        level = end - self.first[word]
        order = np.argsort(level * self.places + end)
        self.word, self.piece, self.start, self.end = word[order], piece[order], start[order], end[order]
        # Edges that end equally far from their word's beginning are summed together.
        self.steps = self._steps(level[order], self.end)

    @staticmethod
    def _steps(level: np.ndarray, place: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(from, to, where each place's edges begin) of each level."""
        cuts = np.flatnonzero(np.diff(level)) + 1
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(level)], strict=True):
            if b > a:
                out.append((a, b, np.flatnonzero(np.diff(place[a:b], prepend=-1))))
        return out

    @staticmethod
    def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logarithms of sums of neighbouring exponentials."""
        top = np.maximum.reduceat(values, at)
        return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, np.diff(at, append=len(values)), axis=0)), at))

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """For each place, the logarithm of the sum over all cuts up to it; ``weight`` has a row an edge and a column a language."""
        total = np.zeros((self.places, weight.shape[1]))
        for a, b, at in self.steps:
            total[self.end[a:b][at]] = self._sum(total[self.start[a:b]] + weight[a:b], at)
        return total

    def backward(self, weight: np.ndarray) -> np.ndarray:
        level = self.first[self.word] - self.start
        order = np.argsort(level * self.places + self.start)
        total, start, end, weight = np.zeros((self.places, weight.shape[1])), self.start[order], self.end[order], weight[order]
        for a, b, at in self._steps(level[order], start):
            total[start[a:b][at]] = self._sum(total[end[a:b]] + weight[a:b], at)
        return total

    def scores(self, logs: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability in each language; ``logs`` has a row a language."""
        return self.forward(logs.T[self.piece])[self.last]

    def expected(self, logs: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How often each edge is expected to be in its word's cut; ``lang`` has the language of each edge's word."""
        weight = logs[lang, self.piece][:, None]
        ahead, behind = self.forward(weight), self.backward(weight)
        return np.exp(ahead[self.start, 0] + weight[:, 0] + behind[self.end, 0] - ahead[self.last[self.word], 0])


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some texts; the words of all texts, by their places among these; and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    told = parts.flatten().dictionary_encode()  # what stands between blanks is cut into words once
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(told.dictionary, r"[^\p{L}\p{M}]+", " "))
    words = lists.flatten()
    real = pc.match_substring_regex(words, r"\p{L}")
    of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[real.to_numpy(zero_copy_only=False)]
    words = words.filter(real).dictionary_encode()
    held = np.bincount(of, minlength=len(lists))
    part = told.indices.to_numpy()
    n = held[part]
    ends = np.cumsum(n)
    at = np.arange(n.sum()) + np.repeat((np.cumsum(held) - held)[part] - (ends - n), n)
    per_text = np.diff(np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()])
    return words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)[at], per_text


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) of the documents that may be learnt from; some texts at once hand on a row a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)):
                texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
                for at in range(0, len(texts), ROWS):
                    words, place, _ = words_of(texts.slice(at, ROWS))
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(np.bincount(place, minlength=len(words)))], ["lang", "word", "n"])

    usable = df.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    parts = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expect(path: str, langs: list[str], shared):
    """Expected counts of pieces in each language, a row a batch, language and piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = vocabulary(path), shared.value
        place = {lang: k for k, lang in enumerate(langs)}
        total = np.zeros(logs.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, CELLS // 4):
                part = batch.slice(at, CELLS // 4)
                lattice = Lattice(part.column(1).to_pylist(), known)
                lang = np.array([place[x] for x in part.column(0).to_pylist()], np.int64)[lattice.word]
                n = part.column(2).to_numpy()[lattice.word]
                np.add.at(total, (lang, lattice.piece), n * lattice.expected(logs, lang))
        lang, piece = np.nonzero(total)
        if len(lang):
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])], ["lang", "piece", "n"])

    return run


def train(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the logarithm of the probability of each piece in each: a row a language.

    Every word of every row that may be learnt from counts.
    """
    counts = written(word_counts(df, id_col, text_col, lang_col), "words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    known = vocabulary(path)
    # To begin with, a piece is the less likely the longer it is, as if its bytes were drawn one by one.
    start = -np.log(16.0) * np.minimum(known.lengths, 8)
    logs = np.tile(start - np.log(np.exp(start).sum()), (len(langs), 1))
    for _ in range(rounds if langs else 0):
        shared = df.sparkSession.sparkContext.broadcast(logs)  # vocabulary x languages, whatever the corpus
        expected = counts.mapInArrow(_expect(path, langs, shared), "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(logs.shape, ALPHA)
        total[expected["lang"], expected["piece"]] += expected["n"]
        logs = np.round(np.log(total / total.sum(axis=1, keepdims=True)), 9)  # so that the order of sums makes no difference
    return langs, logs


class Scorer:
    """Scores of words, those seen before from memory, which is bounded by ``HELD``."""

    def __init__(self, known: Vocabulary, logs: np.ndarray):
        self.known, self.logs, self.place, self.table = known, logs, {}, np.zeros((0, len(logs)))

    def words(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.place]
        if (len(self.place) + len(new)) * len(self.logs) > HELD:
            self.place, self.table, new = {}, np.zeros((0, len(self.logs))), words
        step = max(1, CELLS // len(self.logs))
        parts = [self.table] + [Lattice(new[at : at + step], self.known).scores(self.logs) for at in range(0, len(new), step)]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.table = np.concatenate(parts)
        return self.table[[self.place[w] for w in words]]

    def texts(self, texts: pa.Array) -> np.ndarray:
        """The logarithm of each text's probability in each language, NaN where it has no word."""
        words, place, counts = words_of(texts)
        out = np.full((len(texts), len(self.logs)), np.nan)
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = np.add.reduceat(self.words(words)[place], (np.cumsum(counts) - counts)[some])
        return out


def score(df: DataFrame, path: str, langs: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the likeliest language, and its share among all, each being as likely before."""
    shared = df.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(vocabulary(path), shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, shares = [UND] * part.num_rows, np.zeros(part.num_rows)
                if langs:
                    found = scorer.texts(part.column(2))
                    for k in np.flatnonzero(~np.isnan(found[:, 0])).tolist():
                        best = int(np.argmax(found[k]))
                        names[k], shares[k] = langs[best], 1 / np.exp(found[k] - found[k, best]).sum()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(np.round(shares, 6))], [id_col, "held_out", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def predict(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that aren't held out, and scores all."""
    langs, logs = train(df, path, id_col, text_col, lang_col)
    return score(df, path, langs, logs, id_col, text_col)
