"""Language models against sums over all written-out cuts, and their edge cases."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from lodestone.llm import language as lg

PATH = public_tokenizers.path("piece_bpe_32k.model")


def listed(text):
    """The words of a text, each time they stand in it."""
    words, place, counts = lg.words_of(pa.array([text], pa.string()))
    assert counts.tolist() == [len(place)]
    return [words[k] for k in place]


def test_words():
    assert listed("Ab, cd-EF 12x \u00c9t\u00e9 e\u0301a \u0301 \u4e2d\u6587 \u00bd _y_") == ["ab", "cd", "ef", "x", "\u00e9t\u00e9", "e\u0301a", "\u4e2d\u6587", "y"]
    assert listed(None) == listed("") == listed("1 2 !") == []


def cuts(word, known):
    """All ways to cut the bytes of a word into pieces."""
    raw = f" {word}".encode()

    def rest(at):
        if at == len(raw):
            yield ()
        for end in range(at + 1, len(raw) + 1):
            if raw[at:end] in known.of:
                for more in rest(end):
                    yield (known.of[raw[at:end]], *more)

    return list(rest(0))


def test_sums_over_all_cuts():
    known = lg.vocabulary(PATH)
    rng = np.random.default_rng(0)
    logs = np.log(rng.dirichlet(np.full(len(known.of), 0.5), 3) + 1e-12)
    words = ["a", "the", "été", "strada", "日本", "zzq", "x"]
    lattice = lg.Lattice(words, known)
    scores = lattice.scores(logs)
    for k, w in enumerate(words):
        for lang in range(3):
            assert scores[k, lang] == pytest.approx(math.log(sum(math.exp(logs[lang, list(c)].sum()) for c in cuts(w, known))))
    lang = np.array([k % 3 for k in range(len(words))])
    n = lattice.expected(logs, lang[lattice.word])
    for k, w in enumerate(words):
        want, total = Counter(), 0.0
        for c in cuts(w, known):
            p = math.exp(logs[k % 3, list(c)].sum())
            total += p
            for piece in c:
                want[piece] += p
        got = Counter()
        for word, piece, x in zip(lattice.word, lattice.piece, n, strict=True):
            if word == k:
                got[int(piece)] += x
        assert {p: x / total for p, x in want.items()} == pytest.approx({p: x for p, x in got.items() if p in want}) and set(got) == set(want)


def brute(rows):
    """The query's rows: models by cuts written out, rounds and smoothing as the module states them."""
    known = lg.vocabulary(PATH)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if not held(i) and lang is not None and text is not None:
            counts[lang].update(listed(text))
    langs = sorted(x for x in counts if counts[x])
    start = np.array([16.0 ** -min(len(b), 8) for b in known.of])
    p = {x: start / start.sum() for x in langs}
    for _ in range(lg.ROUNDS):
        for x in langs:
            total = np.full(len(known.of), lg.ALPHA)
            for w, n in counts[x].items():
                weights = [(c, math.prod(p[x][k] for k in c)) for c in cuts(w, known)]
                whole = sum(v for _, v in weights)
                for c, v in weights:
                    for k in c:
                        total[k] += n * v / whole
            p[x] = total / total.sum()
    out = []
    for i, text, _ in rows:
        words = listed(text)
        if not words or not langs:
            out.append((i, held(i), "und", 0.0))
            continue
        logs = [sum(math.log(sum(math.prod(p[x][k] for k in c) for c in cuts(w, known))) for w in words) for x in langs]
        best = int(np.argmax(logs))
        out.append((i, held(i), langs[best], 1 / sum(math.exp(v - logs[best]) for v in logs)))
    return out


ROWS = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and dog", "en"), ("le chat et", "fr"), ("der Hund", "de"), ("a dog The END", "en"), ("chien été", "fr"), ("und Katze", "de"), ("cat", None), ("12 34 !", "en"), ("", "fr"), (None, "de")] * 3)]


def test_predictions_equal_brute_force(spark):
    rows = [*ROWS, (None, "the dog", "en"), (5, "le chien", "fr"), (5, "le chien", "fr")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, word string, n int").repartition(3)
    got = lg.predict(df, PATH)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    order = lambda x: sorted(x, key=repr)
    want = brute(rows)
    assert order((r[0], r[1], r[2], round(r[3], 3)) for r in got.collect()) == order((r[0], r[1], r[2], round(r[3], 3)) for r in want)
    assert {r[2] for r in want} == {"en", "fr", "de", "und"}
    assert lg.predict(df.limit(0), PATH).count() == 0
    assert {r["lang_pred"] for r in lg.predict(df.withColumn("lang", df.lang.substr(9, 1)).where("lang is null"), PATH).collect()} == {"und"}


def test_long_words_and_forgotten_words(monkeypatch):
    known = lg.vocabulary(PATH)
    logs = np.log(np.full((2, len(known.of)), 1 / len(known.of)))
    scorer = lg.Scorer(known, logs)
    texts = ["ab" * 30_000, "日本語" * 3000, "one two one", "two three"]
    found = scorer.texts(pa.array(texts))
    assert np.isfinite(found).all() and found[2, 0] == pytest.approx(2 * scorer.words(["one"])[0, 0] + scorer.words(["two"])[0, 0])
    monkeypatch.setattr(lg, "HELD", 2)
    monkeypatch.setattr(lg, "CELLS", 2)
    assert np.allclose(lg.Scorer(known, logs).texts(pa.array(texts[2:])), found[2:])


def test_held_out_documents_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lg.predict(docs, PATH).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 200 and sum(r["lang"] == r["lang_pred"] for r in found) > 0.98 * len(found)
