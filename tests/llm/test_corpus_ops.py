"""Mixing, packing, quality, pages, archives and media against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bytecnn, html, media, merkle, mixing, packing, quality_rules

DOCS = "doc_id long, text string, source string"


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(f"word{x}" for x in rng.integers(0, 300, int(k))) for k in rng.integers(1, 200, n)]


def test_mix_meets_its_targets(spark, tmp_path):
    rows = [(i, t, ("b", "a", None, "c")[i % 4] if i % 7 else "a") for i, t in enumerate(texts(400))] + [(900, None, "a"), (901, "", "zero"), (None, "x y", "a")]
    df = spark.createDataFrame(rows, DOCS).withColumn("words", F.lit("clash")).withColumn("key", F.lit(1))
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left, w = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * total[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        assert r["_m_size"] == size(r["text"]) and len(r["_m_shards"]) <= 2 and r["_m_words"] == total[r["source"]]
        assert r["_m_target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["_m_size"] * len(r["_m_shards"])
    for s in order:
        assert abs(taken[s] - target[s]) <= max(10, 0.01 * target[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    copied = mixing.copies(df.withColumn("a.b", F.lit(2)).withColumn("_m_key", F.lit("k")))
    assert copied.columns == [*df.columns, "a.b", "_m_key"] and copied.count() == sum(len(r["_m_shards"]) for r in got)
    mixing.write_shards(df, str(tmp_path / "mix"))
    stored = spark.read.parquet(str(tmp_path / "mix"))
    assert Counter(r[0] for r in stored.select("shard").collect()) == Counter(s for r in got for s in r["_m_shards"])
    assert mixing.mix(df.limit(0)).count() == 0


def test_splitting_tree_is_exact():
    tree = mixing.splitting_tree([100, 0, 7, 33], 5, 1)
    assert tree.sum(axis=0).tolist() == [100, 0, 7, 33] and (tree >= 0).all()
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 3


def test_local_search_empties_bins():
    sizes = np.array([60, 60, 60, 40, 40, 25, 15])
    bins = packing.local_search(sizes, [[0], [1], [2], [3, 4], [5, 6]], 100)
    assert sorted(k for b in bins for k in b) == list(range(7)) and len(bins) == 3
    for b in bins:
        assert sizes[b].sum() <= 100
    # One for one is needed: 50 + 45 and 55 + 30 + 20 leave room only after an exchange.
    assert len(packing.pack(np.array([50, 45, 55, 30, 20]), 100)) == 2


def fewest_bins(sizes, capacity):
    """By trying all bins for each item, largest first."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                rest = list(rooms)
                rest.remove(room)
                place(k + 1, [*rest, room - sizes[k]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(map(int, sizes), reverse=True)
    place(0, [])
    return best[0]


def test_swaps_reach_what_best_fit_misses():
    """Between a quarter and a half of the capacity best fit wastes room; exchanges win bins back, and never lose any."""
    rng, better, optimal = np.random.default_rng(3), 0, 0
    for _ in range(120):
        sizes = rng.integers(24, 51, 11)
        first, bins, least = packing.best_fit(sizes, 100), packing.pack(sizes, 100), fewest_bins(sizes, 100)
        assert sorted(k for b in bins for k in b) == list(range(11)) and all(sizes[b].sum() <= 100 for b in bins)
        assert least <= len(bins) <= len(first)
        better += len(bins) < len(first)
        optimal += len(bins) == least
    print(better, optimal)
    assert better >= 5 and optimal >= 114


def test_packing_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    paths = pytest.importorskip("public_tokenizers")
    path = paths.path("word_bpe_49k.json")
    rows = list(enumerate(texts(60) + ["", None, "word " * 9000, "It's  a b\tÀÉ don't", "It's  a b\tÀÉ don't"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fill", F.lit("clash"))
    got = packing.pack_documents(df, path).collect()
    t = tokenizers.Tokenizer.from_file(path)
    want = set()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for j, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], "<u4")
            want.add((i, j, s, len(part), zlib.crc32(part.tobytes())))
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 4096
    assert len(by) == -(-sum(r["length"] for r in got) // 4096)
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_quality_counts(spark):
    rng = np.random.default_rng(2)
    junk = ["Now### all%%% words*** end$$$ in&&& signs### " * 20, "THE!! WORDS!! SHOUT!! " * 30, "same line of text\n" * 9, " ".join(f"w{k} |" for k in range(80)), "a a a a a a b"]
    rows = list(enumerate(texts(120, 5) + junk + ["", None, " \n\x0b", "é ü", "one two three four five six one two three four five six"] + [" ".join(f"w{x}" for x in rng.integers(0, 9, 300))]))
    got = {r["doc_id"]: r for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))).collect()}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, (i, text)
        assert not (r["kept"] and failed)
    assert all(got[i]["kept"] for i, t in rows[:120] if len((t or "").split()) >= 10)
    assert not any(got[i]["kept"] for i, _ in rows[120:124])
    assert quality_rules.verdicts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_votes(text):
    """The nine votes of a text, from their definitions."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, chars = len(w), "".join(w)
    c = len(chars)
    if not n:
        return (0,) * 9
    seen = Counter(tuple(w[k : k + 5]) for k in range(n - 4))
    again = len({p for k in range(n - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    same = len(lines) - len(set(lines))
    symbols, upper, letters = len(re.findall(r"[#*$%&|<>]", chars)), sum(x.isupper() for x in chars), sum(x.isalnum() for x in chars)
    doubled, bare = len(re.findall(r"([#*$%&|<>!?])\1+", text)), sum(not any(x.isalnum() for x in v) for v in w)
    stops = len(re.findall(r"\.(?=[\x20\x09-\x0D]|$)", text))
    vote = lambda bad, good: -1 if bad else int(good)
    return (
        vote(symbols > 0.04 * c, symbols <= 0.005 * c), vote(upper > 0.3 * c, upper <= 0.1 * c), vote(doubled > 0.1 * n, doubled <= 0.01 * n), vote(bare > 0.1 * n, bare <= 0.01 * n),
        vote(letters < 0.85 * c, letters >= 0.93 * c), vote(again > 0.15 * n, n >= 20 and again <= 0.05 * n), vote(n >= 50 and len(set(w)) < 0.2 * n, n >= 50 and len(set(w)) >= 0.5 * n),
        vote(same >= 3 and same > 0.3 * len(lines), len(lines) >= 3 and same == 0), vote(n >= 50 and (stops < 0.01 * n or stops > 0.3 * n), n >= 20 and 0.04 * n <= stops <= 0.2 * n),
    )


def brute_posterior(votes):
    """The probability of the good class of each document, by EM over single documents in plain Python."""
    k, docs = 9, [v for v in votes]
    claim = [[0.05] * k] + [[0.9 if j == c else 0.4 for j in range(k)] for c in range(k)]
    chance, share = [list(x) for x in claim], [0.8] + [0.2 / k] * k

    def classes(v):
        w = list(share)
        for c in range(k + 1):
            for j in range(k):
                w[c] *= chance[c][j] if v[j] < 0 else 1 - chance[c][j] if v[j] > 0 else 1
        return [x / sum(w) for x in w]

    for _ in range(60):
        p = [classes(v) for v in docs]
        for c in range(k + 1):
            for j in range(k):
                bad, cast = sum(x[c] for x, v in zip(p, docs, strict=True) if v[j] < 0), sum(x[c] for x, v in zip(p, docs, strict=True) if v[j])
                q = (bad + 10 * claim[c][j]) / (cast + 10)
                q = min(q, 0.2) if c == 0 else max(q, 0.6) if j == c - 1 else q
                chance[c][j] = min(max(q, 0.001), 0.99)
        share[:] = [(sum(x[c] for x in p) + 1) / (len(docs) + k + 1) for c in range(k + 1)]
        share[0] = max(share[0], 0.5)
        share[:] = [x / sum(share) for x in share]
    return [classes(v)[0] for v in docs]


def prose(rng, n, size=300):
    return " ".join(f"{'wxyz'[x % 4]}{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}er" + "." * (k % 10 == 9) for k, x in enumerate(rng.integers(0, size, n)))


def test_posterior_weighs_the_rules(spark):
    """Verdicts are those of an independent EM; the posterior overrules a rule that says bad, and rules that say good."""
    rng = np.random.default_rng(11)
    rows = [(k, "\n".join(prose(rng, 40, 676) for _ in range(3))) for k in range(60)]
    rows += [(100 + k, " | ".join(prose(rng, 60, 676).split())) for k in range(8)] + [(120 + k, " ".join(f"{w}{'#$%'[k % 3] * 3}" for w in prose(rng, 60, 676).split())) for k in range(8)]
    rows += [(140, "\n".join([prose(rng, 40, 676)] + ["Yes."] * 3 + [prose(rng, 40, 676)] + ["No."] * 2)), (150, ""), (151, None), (152, "five words are too few")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    votes = [brute_votes(t) for _, t in rows]
    assert [tuple(got[i]["_q_v"]) for i, _ in rows] == votes
    for (i, _), p in zip(rows, brute_posterior(votes), strict=True):
        assert got[i]["_q_p"] == pytest.approx(p, abs=1e-9)
    assert -1 in got[140]["_q_v"] and got[140]["_q_kept"]
    for i in (*range(100, 108), *range(120, 128)):
        assert 1 in got[i]["_q_v"] and not got[i]["_q_kept"]
    assert all(got[i]["_q_kept"] for i in range(60)) and not any(got[i]["_q_kept"] for i in (150, 151, 152))


def test_rows_are_kept_under_any_names(spark):
    text = prose(np.random.default_rng(1), 60, 676)
    df = spark.createDataFrame([(1, text, 1, 2), (2, "x", 3, 4)], "`a.b` long, text string, _q_f int, `q p` int")
    got = quality_rules.keep(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, text, 1, 2)]


def test_native_plan(spark):
    plan = quality_rules.features(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cnn_learns_and_covers_the_text():
    raw = bytes(range(256)) * 5
    parts = bytecnn.chunks(raw)
    assert parts.shape[1] == bytecnn.CHUNK and (parts[0] == np.frombuffer(raw[:512], np.uint8)).all() and (parts != bytecnn.PAD).sum() >= len(raw)
    good, bad = [t.encode() for t in texts(60, 1)], [("$$$ &&& ### " * (k % 9 + 3)).encode() for k in range(60)]
    p = bytecnn.fit(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    s = bytecnn.probabilities(p, good[40:] + bad[40:] + [b""])
    assert min(s[:20]) > 0.5 > max(s[20:40]) and 0 <= s[40] <= 1


def test_cnn_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in bytecnn.start(3).items()}
    x = rng.integers(0, 256, (3, bytecnn.CHUNK)).astype(np.int16)
    first, label, weight = np.array([0, 2]), np.array([1.0, 0.0]), np.ones(2)

    def loss():
        odds = bytecnn._combine(p, bytecnn.pooled(p, x), first)[2]
        return float(np.mean(np.log1p(np.exp(-np.where(label == 1, odds, -odds)))))

    g = bytecnn._gradient(p, x, first, label, weight)
    for name in ("filters", "hidden", "out", "bias"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old, step = p[name][at], 1e-5
        p[name][at] = old + step
        up = loss()
        p[name][at] = old - step
        down = loss()
        p[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(g[name][at]), rel=2e-2, abs=1e-6)


def test_cnn_scores_are_those_of_the_network():
    """Scores of fitted weights by loops over places, filters and chunks."""
    p = bytecnn.fit([t.encode() for t in texts(6, 1)] + [b"### " * 90] * 6, [1] * 6 + [0] * 6)
    for raw in (b"", b"short", texts(1, 7)[0].encode() * 9):
        symbols, pools = list(raw), []
        for at in range(0, max(1, len(raw) - 512 + 256), 256) if len(raw) > 512 else [0]:
            chunk = (symbols[at : at + 512] + [256] * 512)[:512]
            windows = [np.concatenate([p["embed"][x] for x in chunk[k : k + 8]]) for k in range(0, 505, 4)]
            pools.append([max(0.0, max(float(w @ p["filters"][:, f]) for w in windows) + float(p["bias"][f])) for f in range(24)])
        features = [sum(x[f] for x in pools) / len(pools) for f in range(24)] + [max(x[f] for x in pools) for f in range(24)]
        hidden = [max(0.0, sum(features[k] * float(p["hidden"][k, h]) for k in range(48)) + float(p["hidden_bias"][h])) for h in range(16)]
        odds = sum(hidden[h] * float(p["out"][h, 0]) for h in range(16)) + float(p["out_bias"][0])
        assert bytecnn.probabilities(p, [raw])[0] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-4)


def test_cnn_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "word " * 50) for k in range(40)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] * 2, "doc_id long, quality int, toxic int")
    seen = []
    fit = bytecnn.fit
    try:
        bytecnn.fit = lambda t, y: seen.append((len(t), sum(map(len, t)))) or fit(t[:0], y[:0])
        bytecnn.train(docs, labels)
        bytecnn.train(docs, labels, sample=10)
        bytecnn.train(docs, labels, most_bytes=1000)
    finally:
        bytecnn.fit = fit
    assert seen[0][0] <= 40 and seen[1] == (10, 2500) and seen[2] == (4, 1000)


def test_cnn_query_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (None, "x"), (1, "a b c")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = bytecnn.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0)
    assert bytecnn.classify(docs.limit(0), labels.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div>We use cookies on this site</div><!-- ad --><div class="ad">Buy {k}</div><article><h1>Head {k}</h1><p><b>First {k} &lt;tag&gt;<br><p>Second   line
of {k}.</p><p></p><div class="comments"><p>Reader {k}</p></div></article><aside>Side {k}</aside><footer>&copy; host {k}</footer>"""


def test_pages(spark):
    rows = [(k, f"http://Host.example/{k}", PAGE.format(k=k)) for k in range(6)]
    rows += [(10 + k, f"http://plain.example/{k}", f"<html><body><div>Cookie notice for all</div><p>Own text {k}</p></body></html>") for k in range(4)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://one.example/", "<p>Only <i>page</i>s</p>text &amp more")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(3))
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    for k in range(6):
        assert got[k]["text"] == f"Head {k}\n\nFirst {k} <tag>\n\nSecond line of {k}."
    for k in range(4):
        assert got[10 + k]["text"] == f"Own text {k}"
    assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "Only pages\n\ntext & more"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.main_text(df.limit(0)).count() == 0


def test_copied_pages_keep_their_text(spark):
    body = "<html><body><div><p>First words of a page.</p><p>Second words.</p></div></body></html>"
    rows = [(1, "http://mirror.example/a", body), (2, "http://mirror.example/b", body), (3, None, body), (3, None, body), (4, "odd", body)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == ["First words of a page.\n\nSecond words."] * 5


def test_constant_blocks_inside_articles_go(spark):
    page = '<html><body><article><h1>Title {0}</h1><p>Own words {0}.</p><div class="x1">Read our other stories</div></article></body></html>'
    rows = [(k, f"http://paper.example/{k}", page.format(k)) for k in range(5)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Title {k}\n\nOwn words {k}." for k in range(5)}


def test_paragraphs_that_an_article_shares_stay(spark):
    page = "<html><body><article><h1>Title {0}</h1><p>Own words {0}.</p><p>This story was first published elsewhere.</p></article></body></html>"
    rows = [(k, f"http://paper.example/{k}", page.format(k)) for k in range(5)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Title {k}\n\nOwn words {k}.\n\nThis story was first published elsewhere." for k in range(5)}


def bare(k):
    """A page of nothing but plain blocks: menu, varying side link, article with a varying number of paragraphs, list of links, footer."""
    story = "".join(f"<p>Paragraph {j} of story {k} tells what happened there on day {j * k}.</p>" for j in range(2 + k % 3))
    menu = "".join(f"<li><a href=/{j}>Part {j}</a></li>" for j in range(4 + k % 2))
    return (
        f"<html><body><div><ul>{menu}</ul></div><div><a href=/x>See also story {k}</a></div><div><h1>Head {k}</h1>{story}"
        f"<div><a href=/{k}>Related {k}</a> <a href=/{k + 1}>Related {k + 1}</a></div><div><p>All rights reserved</p></div></div><div>Page {k} of the host</div></body></html>"
    )


def test_template_finds_articles_without_marks(spark):
    rows = [(k, f"http://bare.example/{k}", bare(k)) for k in range(8)]
    rows.append((99, "http://bare.example/other", "<html><body><p>Page of another kind</p></body></html>"))
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == "\n\n".join([f"Head {k}"] + [f"Paragraph {j} of story {k} tells what happened there on day {j * k}." for j in range(2 + k % 3)])
        assert html.extract(bare(k)) != got[k]  # the page's own tags don't tell
    assert got[99] == "Page of another kind"


def test_classes_are_those_of_whole_vectors(spark):
    pages = [bare(k) for k in range(8)]
    rows = [(k, f"http://bare.example/{k}", p) for k, p in enumerate(pages)]
    found = [r.asDict() for r in html.occurrences(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    tags = {r["token"]: r for r in found if not r["flags"] & html.TEXT}
    # Brute force: vectors of counts instead of hashes, and for each tag the nearest tag around it that has another vector.
    counts = [html.tokens(p) for p in pages]
    vectors = {t: tuple(c[t][2] if t in c else 0 for c in counts) if t else (1,) * len(pages) for t in {0}.union(*counts)}
    enough = {t for t, v in vectors.items() if sum(n > 0 for n in v) >= max(2, html.SUPPORT * len(pages))}
    above = {t: c[t][0] for c in counts for t in c}
    assert set(tags) == {t for t in enough if t == 0 or not any(c[t][1] & html.TEXT for c in counts if t in c)}

    def slot(t):
        while t and vectors[above[t]] == vectors[t]:
            t = above[t]
        return (vectors[t], above[t] if t else None)

    told = html.nested(tags)
    group = lambda key: sorted(sorted(t for t in tags if key(t) == k) for k in {key(t) for t in tags})
    assert group(told.get) == group(slot) and len(group(slot)) >= 3


def test_fixity_finds_all_damage(spark):
    rng = np.random.default_rng(4)
    rows = [(f"a{k % 3}", int(o), 50, hashlib.sha256(bytes([k % 250, k // 250])).hexdigest()) for k, o in enumerate(np.arange(900) * 3000)]
    lost, spoilt = set(rng.integers(0, 900, 5).tolist()), set(rng.integers(0, 900, 5).tolist())
    other = [(a, o, n, "0" * 64 if k in spoilt else h) for k, (a, o, n, h) in enumerate(rows) if k not in lost]
    schema = "archive string, offset long, length long, sha256 string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    got = {(r["archive"], r["offset"]) for r in merkle.audit(a, b).collect()}
    assert got == {rows[k][:2] for k in lost | spoilt}
    assert merkle.audit(a, a).count() == 0 and merkle.audit(a.limit(0), a.limit(0)).count() == 0


def test_page_audit_edges(spark):
    rows = [(k, f"u{k}", f"<p>{k}</p>") for k in range(400)] + [(None, None, None), (7, "u7", "<p>7</p>"), (500, "u", "")]
    got = merkle.page_audit(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and {r["status"] for r in got} == {"ok", "corrupt", "missing"}


def test_equal_and_extra_records(spark):
    rows = [(1, "u", "<p>1</p>")] * 30 + [(k, "u", f"<p>{k}</p>") for k in range(2, 20)] + [(None, None, None)] * 5
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    copy = pages.select(F.col("page_id").alias("id"), merkle.record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    copy = copy.withColumn("named", F.sha2("record", 256))
    lone = spark.createDataFrame([(77, "a record of its own", "0" * 64)], "id long, record string, named string")
    got = merkle.page_audit(pages, copy.unionByName(lone))
    assert Counter(r["status"] for r in got.collect()) == {"ok": len(rows), "extra": 1}
    lost = merkle.page_audit(pages, copy.where("id IS NULL OR id <> 1").unionByName(copy.where("id = 1").limit(28)))
    assert Counter((r["page_id"], r["status"]) for r in lost.where("status <> 'ok'").collect()) == {(1, "missing"): 2}


def test_media_round_trip(spark):
    rows = list(enumerate(texts(30) + ["", None, "x" * 192, "é" * 5000, "x" * 192]))
    got = {r["doc_id"]: r for r in media.round_trip(spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1))).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = media.wav(padded)
        assert media.unwav(stored) == (media.MU_LAW, padded)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[32]["feature"] == got[34]["feature"] and got[30]["feature"] == got[31]["feature"]
    assert media.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def ima_by_rule(block):
    value, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = media.IMA_STEPS[index]
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + media.IMA_MOVES[code & 7]))
            out.append(value)
    return out


def feature_by_rule(data):
    mu, a = ([int(table[x]) for x in data] for table in (media.MU, media.A))
    ima = [ima_by_rule(list(data[k : k + 192])) for k in range(0, len(data), 192)]
    wide = [v for k, x in enumerate(mu) for v in (x, (x + mu[min(k + 1, len(mu) - 1)]) >> 1)]
    zero = sum((x < 0) != (y < 0) for x, y in zip(mu, mu[1:]))
    pcm = zlib.crc32(b"".join(x.to_bytes(2, "little", signed=True) for x in wide))
    return (
        f"mu:{sum(x * x for x in mu)}:{max(map(abs, mu))}:{zero};a:{sum(x * x for x in a)};"
        f"ima:{sum(x * x for b in ima for x in b)}:{sum(b[-1] for b in ima)};pcm16k:{len(wide)}:{pcm:08x}"
    )


def test_features_are_those_of_the_formats(spark):
    rows = list(enumerate(texts(5, 8) + ["", "é" * 700, bytes(range(128)).decode() * 3]))
    for r in media.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["feature"] == feature_by_rule(media.payload(rows[r["doc_id"]][1]))


def test_expansion_tables():
    assert media.MU[[0xFF, 0x7F, 0x00, 0x80]].tolist() == [0, 0, -32124, 32124]
    assert media.A[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    assert len(set(media.A.tolist())) == 256


def test_ima_blocks_match_the_sequential_rule():
    blocks = np.random.default_rng(0).integers(0, 256, (7, 192)).astype(np.uint8)
    got = media.ima_decode(blocks)
    for n, block in enumerate(blocks.tolist()):
        value = int.from_bytes(bytes(block[:2]), "little", signed=True)
        index, want = min(block[2], 88), [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = media.IMA_STEPS[index]
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + media.IMA_MOVES[code & 7]))
                want.append(value)
        assert got[:, n].tolist() == want


def test_pipeline_stages(spark, tmp_path):
    """Each stage over what its predecessor kept, against brute force, with clashing names, nulls, repeats and copies."""
    import corpus_pipeline

    from tests.llm.test_dedup import tree_by_brute_force

    rng = np.random.default_rng(8)
    clean = [(k, "\n".join(prose(rng, 30, 676) for _ in range(3)), "en", f"s{k % 3}", None) for k in range(40)]
    line = "All texts of this site may be used under its common terms."
    clean = [(k, f"{t}\n{line}" if k % 4 == 0 else t, *rest) for k, t, *rest in clean]
    near = clean[1][1].replace("\n", " ").split()
    near[20] = "changed"
    junk = [(100, "SHOUT!! " * 50, "en", "s0", 0), (101, clean[0][1], "en", "s1", 0), (102, None, "en", None, None), (103, "", None, "s1", 0), (104, " ".join(near), "en", None, 5), (2, clean[2][1], "en", "s2", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(clean + junk, schema)
    for c in ("a.b", "_m_key", "_s_fp", "_l_row", "_q_f"):
        df = df.withColumn(c, F.lit(c))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    stages, docs = dict(corpus_pipeline.STAGES), {}
    last = df
    for name in names[:4]:
        last = stages[name](spark, last, "")
        assert last.columns == df.columns
        docs[name] = last = spark.createDataFrame(last.collect(), df.schema)
    rows = [(r["doc_id"], r["text"]) for r in docs["quality_rules"].collect()]
    votes = [brute_votes(t) for _, t, *_ in clean + junk]
    kept = [r[0] for r, p in zip(clean + junk, brute_posterior(votes), strict=True) if p >= 0.5 and len((r[1] or "").split()) >= 10 and r[0] != 100]
    assert sorted(r[0] for r in rows) == sorted(kept) == sorted([*range(40), 2, 101, 104])
    want = tree_by_brute_force(rows)
    lined = [(r["doc_id"], r["text"], r["n_chars"]) for r in docs["line_dedup"].collect()]
    assert {i: t for i, t, _ in lined} == want and not any(line in t for t in want.values())
    assert all(n == len(t) for i, t, n in lined if i < 40 and i % 4 == 0)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t in want.items())}
    copies = {j for j in sets for i in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert copies == {101, 104} and sorted(r["doc_id"] for r in docs["simhash_near_dedup"].collect()) == list(range(40))
    mixed = Counter(r["doc_id"] for r in docs["mixing"].collect())
    taken = {r["doc_id"]: len(r["_m_shards"]) for r in mixing.mix(docs["simhash_near_dedup"].select("doc_id", "text", "source")).collect()}
    assert mixed == Counter({i: n for i, n in taken.items() if n})
    packed = stages["best_fit_packing"](spark, docs["mixing"], "").collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == mixed
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r["piece"] == 0) == mixed
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_token_ids_are_those_of_the_whole_text(monkeypatch):
    paths = pytest.importorskip("public_tokenizers")
    import random

    import pyarrow as pa

    t = packing._tokenizer(paths.path("word_bpe_49k.json"))
    encoder = packing.Encoder(t)
    assert encoder.splits
    rng = random.Random(1)
    parts = list("abXYZ'’sStT09 \t\n\r\x0b\x0c\x1c\x85\xa0 　éİıſKßẞ̧̌😀中ا<|>.,!-_") + ["<|endoftext|>", " <|startoftext|>", "'s", "'LL", "don't "]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", None]
    want = [t.encode(v or "", add_special_tokens=False).ids + [1] for v in values]
    for bound in (packing.HELD_BYTES, 3000):  # what is held is forgotten, and strings beyond the bound aren't held
        monkeypatch.setattr(packing, "HELD_BYTES", bound)
        for at in (0, 0, 700):
            assert [x.tolist() for x in packing.token_ids(pa.array(values[at:]), encoder)] == want[at:]
        encoder.splits = False


def test_packed_ids_beside_a_null(spark):
    from lodestone.llm.queries import tokenizer_path

    big = 2**53 + 1
    df = spark.createDataFrame([(None, "one two"), (big, "three four"), (big - 1, "five"), (-(2**63), ""), (None, "one two")], DOCS.replace(", source string", ""))
    found = packing.pack_documents(df, tokenizer_path()).collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == sorted([None, None, big, big - 1, -(2**63)], key=repr)
    assert len({r["sequence_id"] for r in found}) == 1 and sum(r["length"] for r in found) == 5 + sum(max(r["length"] - 1, 0) for r in found)
    named = spark.createDataFrame([("b", "one"), (None, "two"), ("a", None)], "doc_id string, text string")
    assert {r["doc_id"] for r in packing.pack_documents(named, tokenizer_path()).collect()} == {"a", "b", None}
