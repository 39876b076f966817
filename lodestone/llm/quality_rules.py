"""Weak supervision of document quality with DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0). Documents are counted by their pattern of votes, which is a
table of at most 3 ** rules rows however large the corpus is. Expectation maximisation over that table estimates a
latent class model: good documents, and for each rule a kind of bad ones that this rule finds. It learns the share of each
class and how often each rule errs in it; the posterior probability of the good class replaces a filter that all
rules must pass. Since other rules may praise a kind of junk that one rule finds, their votes count there for as
little as they are worth; and a single rule's finding that no other rule seconds can be overruled.

Edge cases: a null or empty text has no words and fails the base rule, and all rules abstain on it; repeated rows are judged
alike; an empty table gives an empty table; a text of any length is judged whole, in time n log n of its words.
``judge`` adds columns that start with ``_q_``; ``keep`` and ``verdicts`` work under any column names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.columns import named, place, plain
from lodestone.sources.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ROUNDS = 60
KEEP_FROM = 0.5
GOOD, ERROR, FOUND, OTHER, DRAW = 0.8, 0.05, 0.9, 0.4, 10
BARE = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"  # words without a letter or digit
DOUBLED = r"([#*$%&|<>!?])\1+"


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in windows of five words that occur twice or more in the array."""
    n = F.size(words)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))

    def covered(at: Column) -> Column:
        """Size of the union of [p, p + 5) over ascending starts."""
        return F.aggregate(
            at, F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
            lambda s, p: F.struct((s["total"] + F.least(F.lit(WINDOW), p - s["last"])).alias("total"), p.alias("last")),
        )["total"]

    def starts(found: Column) -> Column:
        """Ascending starts of windows that are not alone; found: (hash, start) in order."""
        same = lambda i, j: F.coalesce(F.get(found, i)["h"] == F.get(found, j)["h"], F.lit(False))
        alike = F.filter(found, lambda x, i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(alike, lambda x: x["p"]))

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        repeated = _bind(F.sort_array(pairs), lambda found: covered(starts(found)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeated)

    return F.coalesce(_bind(windows, count), F.lit(0)).cast("long")


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts that the rules read, as struct ``_q_f``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))

    def counted(w: Column) -> Column:
        joined = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(joined).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.regexp_count(joined, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.regexp_count(joined, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"), F.regexp_count(joined, F.lit(r"[\p{L}\p{N}]")).cast("long").alias("n_alnum"),
        )

    duplicate_lines = _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    marks = {"n_stops": r"\.(?=[\x20\x09-\x0D]|$)", "n_bare": BARE, "n_doubled": DOUBLED}
    return df.withColumn("_q_f", F.struct(_bind(words, counted).alias("w"), duplicate_lines.alias("l"), *(F.regexp_count(text, F.lit(x)).cast("long").alias(name) for name, x in marks.items())))


def votes() -> dict[str, Column]:
    """Rule -> vote from ``_q_f``: bad (-1) beyond one bound, good (1) within another, and no vote between them.

    Shares are compared by cross multiplication, so there is no division by zero.
    """
    f, lines = F.col("_q_f.w"), F.col("_q_f.l")
    n, chars, stops, bare, doubled = f["n_words"], f["word_chars"], F.col("_q_f.n_stops"), F.col("_q_f.n_bare"), F.col("_q_f.n_doubled")
    vote = lambda bad, good: F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)
    return {
        "symbols": vote(f["n_symbols"] > 0.04 * chars, f["n_symbols"] <= 0.005 * chars),
        "upper": vote(f["n_upper"] > 0.30 * chars, f["n_upper"] <= 0.10 * chars),
        "doubled": vote(doubled > 0.10 * n, doubled <= 0.01 * n),
        "bare": vote(bare > 0.10 * n, bare <= 0.01 * n),
        "alphanumeric": vote(f["n_alnum"] < 0.85 * chars, f["n_alnum"] >= 0.93 * chars),
        "repeats": vote(f["n_repeat_words"] > 0.15 * n, (n >= 20) & (f["n_repeat_words"] <= 0.05 * n)),
        # A distinct share falls with length, so only a very low one speaks against a text.
        "variety": vote((n >= 50) & (f["n_distinct"] < 0.2 * n), (n >= 50) & (f["n_distinct"] >= 0.5 * n)),
        "lines": vote((lines["n_dup_lines"] >= 3) & (lines["n_dup_lines"] > 0.3 * lines["n_lines"]), (lines["n_lines"] >= 3) & (lines["n_dup_lines"] == 0)),
        "sentences": vote((n >= 50) & ((stops < 0.01 * n) | (stops > 0.3 * n)), (n >= 20) & (stops >= 0.04 * n) & (stops <= 0.2 * n)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over (votes of k rules, count): the share of each class, and classes x rules the chance that a vote says bad.

    Class 0 is good, class j the kind of bad documents that rule j - 1 finds. An abstention says nothing. Each chance
    begins at, and is drawn by ``DRAW`` pseudo votes to, what its rule claims: ``ERROR`` in the good class, ``FOUND`` in the rule's
    own kind, ``OTHER`` in other kinds. Bounds keep the classes' meanings: half of all documents are good, a rule errs on a fifth of the good
    ones at most and finds three fifths of its own kind at least.
    """
    vote, n = np.array([v for v, _ in patterns], float).reshape(-1, k), np.array([c for _, c in patterns], float)
    claim = np.full((k + 1, k), OTHER)
    claim[0] = ERROR
    own = (np.arange(1, k + 1), np.arange(k))
    claim[own] = FOUND
    chance, share = claim.copy(), np.array([GOOD, *[(1 - GOOD) / k] * k])
    for _ in range(ROUNDS):
        weight = _posterior(vote, share, chance) * n[:, None]
        chance = (weight.T @ (vote < 0) + DRAW * claim) / (weight.T @ (vote != 0) + DRAW)
        chance[0] = np.minimum(chance[0], 0.2)
        chance[own] = np.maximum(chance[own], 0.6)
        chance = np.clip(chance, 0.001, 0.99)
        share = (weight.sum(axis=0) + 1) / (n.sum() + k + 1)
        share[0] = max(share[0], 0.5)
        share /= share.sum()
    return share, chance


def _posterior(vote: np.ndarray, share: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Patterns x classes: the probability of each class."""
    odds = np.log(share) + (vote < 0) @ np.log(chance).T + (vote > 0) @ np.log(1 - chance).T
    odds = np.exp(odds - odds.max(axis=1, keepdims=True, initial=-np.inf))
    return odds / odds.sum(axis=1, keepdims=True)


def judge(df: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``_q_f`` (counts), ``_q_v`` (votes), ``_q_failed`` (base rule), ``_q_p`` (posterior) and ``_q_kept``.

    The scored table is written to the shared folder once and read for the counts and for the verdicts,
    so texts are parsed once; without ``keep_text`` the text itself isn't written.
    """
    rules = votes()
    scored = features(df, text_col).withColumn("_q_v", F.array(*rules.values()))
    scored = written(scored if keep_text else scored.drop(text_col), "votes")
    counted = scored.groupBy("_q_v").count().collect()  # 3 ** len(rules) rows at most
    share, chance = estimate(sorted((tuple(r[0]), r[1]) for r in counted), len(rules))
    f = F.col("_q_f.w")
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
    weighed = [_weight(F.col("_q_v"), float(share[c]), chance[c].tolist()) for c in range(len(share))]
    p = _bind(F.array(*weighed), lambda w: w[0] / F.aggregate(w, F.lit(0.0), lambda s, x: s + x))
    return scored.withColumns({"_q_failed": failed, "_q_p": p}).withColumn("_q_kept", ~F.col("_q_failed") & (F.col("_q_p") >= KEEP_FROM))


def _weight(vote: Column, share: float, chance: list[float]) -> Column:
    """A class's share times the chances of the votes."""
    out = F.lit(share)
    for j, bad in enumerate(chance):
        out = out * F.when(vote[j] < 0, bad).when(vote[j] > 0, 1 - bad).otherwise(1.0)
    return out


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with its columns alone."""
    return named(judge(plain(df), place(df, text_col)).where("_q_kept"), df)


def verdicts(docs: DataFrame) -> DataFrame:
    """The digest columns of every document."""
    f, lines = F.col("_q_f.w"), F.col("_q_f.l")
    return judge(docs.select("doc_id", "text"), keep_text=False).select(
        "doc_id", f["n_words"].alias("n_words"), f["word_chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"), lines["n_dup_lines"].alias("n_dup_lines"),
        f["n_repeat_words"].alias("n_repeat_words"), F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.round("_q_p", 6).alias("quality_probability"),
    )
