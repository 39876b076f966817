"""What is allocated in rounds, by ranks or by doubling, against the loops that it replaces."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import allocation as A


def quota_loop(rows, quota):
    """Modules in turn pin their best passages; what is left goes where it scores best."""
    out = set()
    for course in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == course]
        pinned, best = {}, {}
        for m in sorted({r[1] for r in own}):
            taken = 0
            for _, _, c, _ in sorted((r for r in own if r[1] == m), key=lambda r: (-(r[3] or 0.0), r[2])):
                if taken < quota and c not in pinned:
                    pinned[c] = m
                    taken += 1
        for _, m, c, s in sorted(own, key=lambda r: r[1]):
            if c not in best or (s or 0.0) > best[c][1]:
                best[c] = (m, s or 0.0)
        out |= {(course, m, c, s) for _, m, c, s in own if pinned.get(c, best[c][0]) == m}
    return out


@pytest.mark.parametrize("quota", [0, 1, 4, 100])
def test_quota_pins_equal_the_loop(spark, quota):
    rng = random.Random(quota)
    rows = [(c, m, k, rng.choice([None, 0.0, 0.1, 0.2, 0.3, 0.4, 0.5])) for c in range(3) for m in range(6) for k in range(40) if rng.random() < (0.9 if c == 0 else 0.4)]
    df = spark.createDataFrame(rows, "course_id int, module_index int, chunk_id int, score double")
    assert {tuple(r) for r in A.quota_dedup(df, quota).collect()} == quota_loop(rows, quota)
    assert A.quota_dedup(df.limit(0), quota).count() == 0


@pytest.mark.parametrize("cap", [0, 1, 3])
def test_reuse_caps_equal_the_loop(spark, cap):
    rng = random.Random(cap)
    rows = [(c, s, i, rng.randrange(4)) for c in range(3) for s in range(60) for i in range(12) if rng.random() < (1 if c == 0 else 0.3)]
    df = spark.createDataFrame(rows, "course_id int, slot int, image int, rank int")
    want = set()
    for c in range(3):
        used = defaultdict(int)
        for s in range(60):
            for _, _, i, _ in sorted((r for r in rows if r[:2] == (c, s)), key=lambda r: (r[3], r[2])):
                if used[i] < cap:
                    used[i] += 1
                    want.add((c, s, i))
                    break
    assert {tuple(r) for r in A.capped_choice(df, cap).collect()} == want
    assert A.capped_choice(df.limit(0), cap).count() == 0


def rebalance_loop(rows, modules, least, most, steps, by_margin):
    """One passage a step."""
    rows = sorted(rows, key=lambda r: (r[3], r[1]) if by_margin else r[1])
    home = {r[1]: r[2] for r in rows}
    for short, full in ((least, least + 2), (most, most)):
        for _ in range(steps):
            sizes = {m: sum(h == m for h in home.values()) for m in modules}
            takers, givers = [m for m in modules if sizes[m] < short], [m for m in modules if sizes[m] > full]
            if not takers or not givers:
                break
            if by_margin:
                free = [r[1] for r in rows if not r[4] and home[r[1]] in givers][:1]
            else:
                fullest = max(givers, key=lambda m: (sizes[m], -m))
                free = [r[1] for r in rows if home[r[1]] == fullest][-1:]
            if not free:
                break
            home[free[0]] = min(takers, key=lambda m: (sizes[m], m))
    return home


@pytest.mark.parametrize("by_margin", [True, False])
@pytest.mark.parametrize(("least", "most", "steps"), [(5, 12, 200), (8, 9, 7), (0, 3, 200), (20, 40, 200)])
def test_rebalancing_equals_the_steps(spark, by_margin, least, most, steps):
    rng = random.Random(least)
    rows, modules = [], [0, 1, 2, 3, 4]
    for course in range(4):
        weights = [rng.random() ** 3 + 0.01 for _ in modules[:-1]]
        rows += [(course, k, rng.choices(modules[:-1], weights)[0], rng.choice([0.01, 0.02, 0.03, 0.2]), rng.random() < 0.3) for k in range(10 + 25 * course)]
    df = spark.createDataFrame(rows, "course_id int, chunk_id int, module_index int, margin double, pinned boolean").withColumn("all_modules", F.array(*map(F.lit, modules)))
    got = {(r["course_id"], r["chunk_id"]): r["module_index"] for r in A.rebalance(df, least, most, steps=steps, by_margin=by_margin).collect()}
    want = {(c, k): m for c in range(4) for k, m in rebalance_loop([r for r in rows if r[0] == c], modules, least, most, steps if by_margin else 10**6, by_margin).items()}
    assert got == want and got != {r[:2]: r[2] for r in rows}


@pytest.mark.parametrize(("tokens", "docs", "block"), [(40, 5, 16), (1000, 3, 4), (25, 1000, 32), (7, 7, 8), (10**6, 10**6, 64)])
def test_batches_equal_the_loop(spark, monkeypatch, tokens, docs, block):
    monkeypatch.setattr(A, "BLOCK_ROWS", block)
    rng = random.Random(tokens)
    rows = [(g, k, None if rng.random() < 0.05 else "x" * rng.choice([0, 1, 7, 30, 60, 200])) for g, n in (("hot", 400), ("b", 37), (None, 20), ("one", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, t string").repartition(6)
    want, state = {}, {}
    for g, k, t in rows:
        size = max(1, len(t or "") // 4 + 1)
        number, held, n = state.get(g, (0, 0, 0))
        if n and (held + size > tokens or n >= docs):
            number, held, n = number + 1, 0, 0
        state[g] = (number, held + size, n + 1)
        want[g, k] = number
    assert {(r["g"], r["k"]): r["batch"] for r in A.greedy_batches(df, "g", "k", "t", tokens, docs).collect()} == want
    assert A.greedy_batches(df.limit(0), "g", "k", "t", tokens, docs).count() == 0
