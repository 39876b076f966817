"""Line, near-duplicate and passage deduplication against brute force, and their edge cases."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import linededup, simhash, suffixes

SCHEMA = "doc_id long, text string"


def words(rng, n, size=400):
    return " ".join(chr(97 + x % 26) + chr(97 + x // 26) + "x" for x in rng.integers(0, size, n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    texts = [words(rng, int(n)) for n in rng.integers(3, 120, 60)]
    passage = words(rng, 30)
    texts += [f"{words(rng, 10)} {passage} {words(rng, 12)}" for _ in range(12)]
    texts += [texts[0]] * 3 + [texts[1] + " tail", None, "", "   ", "The " * 400, "The " * 400 + "end", "é" * 60, "x é" * 40]
    near = texts[5].split()
    for k in range(4):
        near[k] = "changed"
        texts.append(" ".join(near))
    return list(enumerate(texts))


def removed(rows):
    """n_bytes, n_removed, n_spans and hash of what is left, by the definition."""
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                cover[p : p + 50] = True
        edge = np.diff(np.concatenate([[0], cover.astype(int)]))
        out[i] = (len(b), int(cover.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("alphabet", [1, 2, 3, 5, 250])
def test_two_stage_sort(alphabet):
    text = np.random.default_rng(alphabet).integers(0, alphabet, 700).astype(np.uint8)
    order, raw = suffixes.two_stage_sort(text), text.tobytes()
    assert sorted(order.tolist()) == list(range(len(text)))
    starts = [raw[i : i + 50] for i in order]
    assert starts == sorted(starts)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 5, 250])
def test_two_stage_sort_of_some_suffixes(alphabet):
    """Only the suffixes asked for and those that they are induced from are sorted, into the same order."""
    rng = np.random.default_rng(alphabet)
    text = rng.integers(0, alphabet, 700).astype(np.uint8)
    raw = text.tobytes()
    for wanted in (np.zeros(700, bool), rng.random(700) < 0.05, np.arange(700) % 70 < 20, np.arange(700) == 699):
        order = suffixes.two_stage_sort(text, wanted)
        assert len(set(order.tolist())) == len(order) and set(np.flatnonzero(wanted).tolist()) <= set(order.tolist())
        starts = [raw[i : i + 50] for i in order if wanted[i]]
        assert starts == sorted(starts)
        if alphabet == 250:
            assert len(order) <= 4 * wanted.sum()


def test_windows_of_several_contexts_by_the_definition():
    rng = np.random.default_rng(11)
    for alphabet in (1, 2, 40):
        pool = [bytes(rng.integers(97, 97 + alphabet, 60).astype(np.uint8)) for _ in range(4)]
        parts = [pool[k][a:] + pool[j][:b] for k, j, a, b in zip(rng.integers(0, 4, 30), rng.integers(0, 4, 30), rng.integers(0, 10, 30), rng.integers(0, 60, 30), strict=True)]
        owners = rng.integers(0, 9, len(parts))
        least = {}
        for part, owner in zip(parts, owners.tolist(), strict=True):
            for p in range(len(part) - 49):
                least[part[p : p + 50]] = min(owner, least.get(part[p : p + 50], owner))
        want = [x for part, owner in zip(parts, owners.tolist(), strict=True) for x in [p <= len(part) - 50 and least[part[p : p + 50]] < owner for p in range(len(part) + 1)]]
        text = np.frombuffer(b"".join(part + b"\xff" for part in parts), np.uint8)
        assert suffixes.repeats(text, np.array([len(part) for part in parts]), owners).tolist() == want


def test_texts_read_together_have_the_contexts_of_each(corpus, monkeypatch):
    raws = [(text or "").encode() for _, text in corpus]
    for together in (1, 200, suffixes.READ_BYTES):
        monkeypatch.setattr(suffixes, "READ_BYTES", together)
        of, *got = suffixes.contexts_of(raws)
        for k, raw in enumerate(raws):
            assert [x[of == k].tolist() for x in got] == [x.tolist() for x in suffixes.contexts(raw)]


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeats_are_those_of_the_definition(spark, corpus, hot):
    got = suffixes.without_repeats(spark.createDataFrame(corpus, SCHEMA), hot=hot).collect()
    want = removed(corpus)
    assert {r["doc_id"]: tuple(r)[1:5] for r in got} == want


def test_long_texts_are_read_in_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 100)
    suffixes._powers.cache_clear()
    for _, text in corpus:
        raw = (text or "").encode()
        _, first, windows, _ = suffixes.contexts(raw)
        assert windows.sum() == max(0, len(raw) - 49)
        assert (first == np.cumsum(windows) - windows).all()
    suffixes._powers.cache_clear()


def test_repeats_edge_cases(spark):
    text = "a passage of more than fifty bytes that stands in several rows of this table"
    rows = [(1, text), (1, text), (2, text), (None, text), (3, "short"), (4, None)]
    got = {(r["doc_id"], r["n_removed"]) for r in suffixes.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0), (2, len(text)), (None, 0), (3, 0), (4, 0)}
    assert suffixes.report(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_fingerprint(text, shingle=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_components(spark, corpus):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(corpus, SCHEMA)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in corpus}
    roots = brute_components(prints)
    assert got == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}


def test_fingerprint_hash_is_sparks(spark):
    spark_hash = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64)
    assert spark_hash == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 4])
def test_dense_fingerprints(spark, monkeypatch, chunk):
    """A chain and a ball of fingerprints, also when their buckets have to be split."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    values = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 80)}
    for k in range(12):
        values.add(base ^ ((1 << 3 * k) - 1))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    roots = brute_components({v: v % (1 << 64) for v in signed})
    mine = {v: got.get(v, v) for v in signed}
    assert len(set(mine.values())) == len(set(roots.values()))
    assert len({(mine[v], roots[v]) for v in signed}) == len(set(roots.values()))


@pytest.mark.parametrize("edges", [[], [(5, 1), (9, 1), (7, 7)], [(k + 1, k) for k in range(9)], [(1, 9), (9, 4), (4, 1), (8, 3), (3, 8)]])
def test_components_are_stars_of_least_nodes(spark, edges):
    """No edges, stars that need no merging, a chain, a cycle beside a repeated edge, against merging edge by edge."""
    root = {v: v for e in edges for v in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {v: low if r == high else r for v, r in root.items()}
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((v, r) for v, r in root.items() if v != r)


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f", "k"), (2, "a b c d e f", "m"), (3, None, "n"), (4, "", "o"), (None, "x y z u v", "p"), (5, "q r s t u", "q"), (5, "q r s t u", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "5", "None"]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_near_copies_are_one(spark):
    """Texts of a five-word Jaccard similarity of 0.8 that differ in at most 20 bits are one, as by all pairs."""
    rng = np.random.default_rng(12)
    texts = []
    for k in range(12):
        base = words(rng, 150, 650).split()
        texts.append(base)
        for edits in (1, 2, 3, 12):
            near = list(base)
            for at in rng.integers(0, 150, edits):
                near[at] = f"edit{k}"
            texts.append(near)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    prints = [brute_fingerprint(" ".join(t), 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (prints[i] ^ prints[j]).bit_count() <= 20:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert len(set(root)) < len(texts) - 20
    got = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))


@pytest.mark.parametrize(("most", "leaf", "frontier"), [(0, 1, 1 << 14), (3, 1, 7), (3, 64, 1 << 14), (20, 64, 5), (64, 16, 50)])
def test_trie_pairs_are_all_pairs_within_the_budget(monkeypatch, most, leaf, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    monkeypatch.setattr(simhash, "PAIRS", 100)
    rng = np.random.default_rng(most)
    values = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = values[rng.integers(0, 40, 120)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64))
    values = np.concatenate([values, near, near[:30]])
    group = rng.integers(0, 3, len(values))
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if group[i] == group[j] and int(values[i] ^ values[j]).bit_count() <= most}
    got = [(int(i), int(j)) for x, y in simhash.traverse(values, group, most, leaf) for i, j in zip(x, y, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_one_row_stands_for_all_copies(spark):
    """Copies, rows of one id and rows without an id, beside near copies of the same text."""
    rng = np.random.default_rng(8)
    base = words(rng, 120, 650)
    rows = [(7 + k % 3, base) for k in range(300)] + [(None, base)] * 40 + [(5, base + " tail"), (None, "of its own " * 9), (None, "of its own " * 9)]
    got = sorted(map(tuple, simhash.one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()), key=str)
    assert got == [(5, base + " tail"), (None, "of its own " * 9)]


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(2)
    met = apart = 0
    for _ in range(1000):
        both, own, other = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        x, y = (set(simhash.meeting_keys(np.concatenate([both, z]))) for z in (own, other))
        met += bool(x & y)
        apart += bool(x & set(simhash.meeting_keys(rng.integers(0, 1 << 63, 180, dtype=np.uint64))))
    assert met == 1000 and apart == 0


def test_lines_of_recurring_templates_go(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(12):
        lines = [words(rng, 8) for _ in range(3)]
        lines.insert(k % 4, f"This work number {k} is licensed under the MIT terms of use")
        rows.append((k, "\n".join(lines)))
    copied = "\n".join(words(rng, 9) for _ in range(4))
    rows += [(100 + k, copied) for k in range(10)]
    rows += [(200, "This work number 77 is licensed under the MIT terms of use"), (201, None), (202, ""), (203, "\n \n")]
    got = {r["doc_id"]: r for r in linededup.drop_templates(spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1))).collect()}
    for k, text in rows[:12]:
        assert got[k]["text"] == "\n".join(x for x in text.split("\n") if "licensed" not in x)
        assert (got[k]["_l_lines"], got[k]["_l_dropped"]) == (4, 1)
    for k, text in rows[12:]:
        assert got[k]["text"] == text and got[k]["_l_dropped"] == 0
    assert linededup.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_do_not_veto_a_template(spark):
    rng = np.random.default_rng(4)
    line = "Licensed under the terms of the common license"
    rows = [(k, "\n".join([words(rng, 8), line, words(rng, 8), words(rng, 8)])) for k in range(12)]
    rows += [(100 + k, rows[0][1]) for k in range(1000)]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: text.replace(line + "\n", "") for k, text in rows}


def test_passages_and_short_lines_go(spark):
    rng = np.random.default_rng(6)
    passage = [words(rng, 9) for _ in range(4)]
    rows = [(k, "\n".join([words(rng, 8), words(rng, 8), *passage, words(rng, 8), "All rights reserved.", words(rng, 8)])) for k in range(8)]
    single = words(rng, 8)
    rows.append((50, "\n".join(x for _ in range(8) for x in (words(rng, 8), single))))
    near = [words(rng, 8) for _ in range(10)]
    for k in range(9):
        rows.append((100 + k, "\n".join([*near[:k], words(rng, 8), *near[k + 1 :]])))
    got = {r["doc_id"]: r["text"] for r in linededup.drop_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, text in rows:
        assert got[k] == ("\n".join(x for x in text.split("\n") if x not in passage and x != "All rights reserved.") if k < 8 else text)


def test_short_pages_lose_long_footers_and_near_copies_keep_their_lines(spark):
    rng = np.random.default_rng(11)
    footer, base = [words(rng, 7) for _ in range(4)], [words(rng, 10) for _ in range(12)]
    rows = [(k, "\n".join([words(rng, 9), *footer])) for k in range(60)]
    for k in range(60):  # two of twelve lines with another beginning and a word more
        t = list(base)
        for j in (k % 12, (k + 1 + k // 12) % 12):
            t[j] = f"new{words(rng, 1)} {t[j]}"
        rows.append((100 + k, "\n".join(t)))
    got = {r["doc_id"]: r["text"] for r in linededup.drop_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: text.split("\n")[0] if k < 100 else text for k, text in rows}


def tree_by_brute_force(rows):
    """What is left of each text, by the definition of the tree over single lines; a template stands once a text at most."""
    split = lambda x: re.split(r"[\x20\x09-\x0D]+", x.strip(" \t\n\x0b\f\r"))
    found = []  # (row, at, text, tokens, lead, leaf)
    for r, (_, text) in enumerate(rows):
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                t = split(line)
                found.append((r, at, text, tuple(t), (len(t), *t[:4]), (len(t), *("<*>" if re.search(r"\d", x) else x for x in t[:4]))))
    texts = {}
    for f in found:
        texts.setdefault(f[5], set()).add(f[2])
    again = {leaf for leaf, x in texts.items() if len(x) >= 5}
    placed = []
    for f in found:
        own = [g for g in found if g[0] == f[0] and g[5] not in again]
        before, after = [g[4] for g in own if g[1] < f[1]], [g[4] for g in own if g[1] > f[1]]
        if f[5] in again:
            context = tuple(x for x in (before[-1] if before else None, after[0] if after else None) if x)
            placed.append((*f, context, len(own) / sum(g[0] == f[0] for g in found)))
    shingles = lambda t: [t[k : k + 3] for k in range(max(1, len(t) - 2))]
    holders = {}  # of each shingle: the texts in whose own lines it stands, and "" if a line at a recurring leaf has it
    for f in found:
        for x in shingles(f[3]):
            holders.setdefault(x, set()).add("" if f[5] in again else f[2])

    def original(text, own):
        mine = [(x, f[5] in again) for f in found if f[0] == min(g[0] for g in found if g[2] == text) for x in shingles(f[3])]
        return own >= 0.25 or sum(not r and holders[x] == {text} for x, r in mine) > len(mine) / 9

    seen = {}
    for f in {(f[5], f[3], f[6]) for f in placed}:
        for k, x in enumerate(f[1]):
            seen[f[0], k, x] = seen.get((f[0], k, x), 0) + 1
    template, counted = {}, {}
    for f in placed:
        steady = lambda k, x: len(f[3]) < 4 or (seen[f[5], k, x] >= 5 and not re.search(r"\d", x))  # noqa: B023, E731
        t = tuple(x if steady(k, x) else "<*>" for k, x in enumerate(f[3]))
        if sum(x != "<*>" for x in t) >= 0.5 * len(t):
            template[f[0], f[1]] = (f[5], t)
            if original(f[2], f[7]):
                counted.setdefault((f[5], t), {}).setdefault(f[2], f[6])
    gone = {k for k, of in counted.items() if len(set(of.values())) >= 5 and len(set(of.values())) >= 0.3 * len(of)}
    out = []
    for r, (i, text) in enumerate(rows):
        drop = {at for (q, at), t in template.items() if q == r and t in gone}
        worded = sum(g[0] == r for g in found)
        out.append((i, text if len(drop) >= worded else "\n".join(x for at, x in enumerate(text.split("\n")) if at not in drop)))
    return dict(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_are_those_of_a_brute_force_tree(spark, seed):
    rng = np.random.default_rng(seed)
    fixed = [words(rng, int(n)) for n in rng.integers(1, 12, 14)]
    rows = []
    for k in range(70):
        lines = [words(rng, int(n), 60) for n in rng.integers(1, 12, rng.integers(1, 7))]
        for j in rng.choice(14, int(rng.integers(0, 5)), replace=False):
            t = fixed[j].split()
            if len(t) > 5 and j % 2:
                t[int(rng.integers(0, len(t)))] = f"id{k}"
            if len(t) > 6 and j % 3 == 0:
                t[5] = words(rng, 1)
            lines.insert(int(rng.integers(0, len(lines) + 1)), " ".join(t))
        rows.append((k, "\n".join(lines)))
    rows += [(100 + k, rows[0][1]) for k in range(6)]
    rows += [(200 + k, "\n".join([words(rng, 8), *fixed[:3], words(rng, 8)])) for k in range(9)]
    footer, copied = [words(rng, 6) for _ in range(5)], words(rng, 90).split()
    rows += [(300 + k, "\n".join([words(rng, 3 + k % 9), *footer])) for k in range(12)]
    for k in range(8):  # near copies: one line with another beginning, one with a word more
        t = [copied[j : j + 9] for j in range(0, 90, 9)]
        t[k] = [f"new{chr(97 + k)}", *t[k][1:]]
        rows.append((400 + k, "\n".join(" ".join(x) for x in [*t[:9], [*t[9][:5], f"more{chr(97 + k)}", *t[9][5:]]])))
    want = tree_by_brute_force(rows)
    assert sum(want[i] != t for i, t in rows) > 20
    got = {r["doc_id"]: r["text"] for r in linededup.without_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_operators_keep_any_column_names(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "\n".join(words(rng, 9) for _ in range(3)), k, "x", 1.5, None) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long, _l_row string, _s_fp double, root string")
    for got in (linededup.without_templates(df), simhash.one_of_each(df)):
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == rows


def test_one_row_of_an_id_stays_whatever_the_order(spark):
    rows = [(1, "a b c d e f g", str(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    assert len({tuple(simhash.one_of_each(df.repartition(n)).first()) for n in (1, 3, 5)}) == 1
