"""Alignment of two tokenizers against a brute force over every pair of token occurrences."""

import base64
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from lodestone.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "Hello world, this is fine.", "naïve café — déjà vu", "", None, "a", " ", "   two  blanks\n\n\tand tabs ", "x▁y", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語のテキスト 中文", "🙂🙃 ‍ é ﬁ ﷺ",
    "a\x00b", "don't we'll I'VE 'tis", "12345 67890 3.14", "=" * 700, "ab" * 900, "\n" * 300, " " * 300 + "x", " nbsp　wide", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢", "Ünïcödé" * 50,
]


def tokens(text):
    """(bytes, id) of each token of both sides, by the libraries themselves."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    if not hasattr(tokens, "a"):
        tokens.a, tokens.b, tokens.decode = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), decoders.ByteLevel()
        tokens.a.encode_special_tokens = True
        ranks = map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
        tokens.spelled = {int(k): base64.b64decode(x) for x, k in ranks} | {50256: b"<|endoftext|>"}
    a = [(tokens.spelled[i], i) for i in tokens.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in tokens.b.encode(text):
        piece = tokens.b.id_to_piece(i)
        b.append((bytes([int(piece[3:5], 16)]) if tokens.b.is_byte(i) else piece.replace("▁", " ").encode(), i))
    return a, b


def brute(rows):
    """The query's rows by its definition."""
    groups_of, held = {}, {}
    for key, text in rows:
        groups = []
        if text:
            a, b = tokens(text)
            whole = (" " + text).encode()
            if b"".join(x for x, _ in a) == whole and b"".join(x for x, _ in b) == whole:
                ends = lambda side: [sum(len(x) for x, _ in side[: k + 1]) for k in range(len(side))]
                ea, eb = ends(a), ends(b)
                start = 0
                for cut in sorted(set(ea) & set(eb)):
                    groups.append(([i for (_, i), e in zip(a, ea, strict=True) if start < e <= cut], [i for (_, i), e in zip(b, eb, strict=True) if start < e <= cut]))
                    start = cut
        groups_of[key] = groups
        held[key] = Counter((x, y) for p, q in groups for x in p for y in q)
    count = Counter(pair for key in held for pair in held[key])
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for key, _ in rows:
        groups, links = groups_of[key], held[key]
        digest = hashlib.sha256(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups).encode()).hexdigest() if groups else ""
        out.append((key, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if count[k] == top[k[0]]), sum(n * count[k] for k, n in links.items()), digest))
    return sorted(out)


def test_report_equals_brute_force(spark):
    copies = [t for t in ODD for _ in range(3)] + ["Hello world, this is fine."] * 40
    rows = list(enumerate(copies))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, key string, chunk int").repartition(5)
    got = al.report(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(1 for r in want if r[1]) > 40 and any(r[1] == 0 and copies[r[0]] for r in want)
    assert al.report(df.limit(0), A, B).count() == 0
    twice = spark.createDataFrame([(None, "one two"), (7, "one two"), (7, "one two")], "doc_id long, text string")
    assert sorted((r["n_links"], r["count_sum"]) for r in al.report(twice, A, B).collect()) == [(2, 6)] * 3


def test_documents_equal_brute_force_in_small_chunks(spark, monkeypatch):
    """Chunks and slabs of a few texts give what one chunk gives."""
    docs = [(r["doc_id"], r["text"][:3000]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    monkeypatch.setattr(al, "SLAB_BYTES", 2000)
    monkeypatch.setattr(al, "CHUNK_BYTES", 9000)
    got = al.report(spark.createDataFrame(docs, "doc_id long, text string"), A, B)
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_large_groups_by_distinct_ids(monkeypatch):
    texts = [t for t in ODD if t] + ["日本語テキスト" * 40]
    whole = al.Slab(texts, A, B)
    monkeypatch.setattr(al, "SPREAD", 1)
    apart = al.Slab(texts, A, B)
    assert [whole.text.tolist(), whole.pair.tolist(), whole.times.tolist()] == [apart.text.tolist(), apart.pair.tolist(), apart.times.tolist()]


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_fast_and_slow_ids_agree(text):
    side = al.tokenizers_of(A, B)[0]
    assert side.fast is not None
    assert side.encode(text).tolist() == side.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 400_000, " " * 400_000, "ab " * 200_000, "é" * 200_000])
def test_long_runs(text):
    slab = al.Slab([text, "x"], A, B)
    assert slab.n_a[1] == 1 and slab.valid.all() and int((slab.times * (slab.text == 0)).sum()) == slab.n_links[0]
