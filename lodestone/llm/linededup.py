"""Line deduplication by a tree of log templates.

A line is parsed down a tree of fixed depth: first by its number of tokens, then by its leading tokens; a token with a
digit counts as a variable field on the way. At a leaf each later token is kept if enough contexts have that token at that
place and is a variable field otherwise; a line's template is what remains. Templates that recur across documents are
dropped wherever they stand.

Recurrence is counted in distinct texts, each with one context: the lengths and leading tokens of the nearest lines before and
after whose leaves don't recur, so that the inner lines of a shared passage have the contexts of the passage. Boilerplate
stands between ever other lines, whereas the lines of copied documents keep their neighbours. Near copies don't count, so that copies of a
document don't make its own lines boilerplate: texts in which at most a ninth of the three-word shingles are their own, which makes texts
that share the rest similar to 0.8. A shingle is a text's own if it stands in lines that don't recur and in no other line, so that lines
that were only edited aren't; short pages with a long footer have words of their own, and lose the footer. A document that holds nothing but
recurring lines keeps its text: it is for the document deduplication to judge.

Everything is counted by groups with partial aggregates; leaves of any size are spread over tasks, and only
lines at recurring leaves are taken apart.

Edge cases: null and empty texts stay as they are, and so do blank lines; repeated rows are one context; an empty table gives an
empty table; a line of any length is parsed whole. ``drop_templates`` adds columns that start with ``_l_``; ``without_templates`` works under any
column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.columns import named, place, plain
from lodestone.sources.scratch import written

GAP = r"[\x20\x09-\x0D]+"
DEPTH = 4  # leading tokens on the way to a leaf
LEAST_TOKENS = 4  # shorter lines have no variable fields: they are templates as they stand
LEAST_CONTEXTS = 5  # and texts
OWN = 1 / 9  # of the shingles of a text that counts: (1 - OWN) / (1 + OWN) is a similarity of 0.8
PLAIN = 0.25  # of the lines of a text: from here on it counts without a look at shingles
SHINGLE = 3
SHARE = 0.3  # contexts of a template in its distinct texts: below, it recurs by near copies
SIMILARITY = 0.5  # of a template's tokens that aren't variable fields
FIELD = "<*>"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _placed(line: Column, at: Column) -> Column:
    """A line's place, text and the hashes of its number of tokens and leading tokens: as they are (``lead``), and without
    variable fields, the path to its leaf (``leaf``)."""
    lead = F.array_join(F.slice(F.split(_bare(line), GAP, DEPTH + 1), 1, DEPTH), " ")
    path = F.struct(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"), lead.alias("lead"))
    masked = lambda p: F.when(F.regexp_like(p["lead"], F.lit(r"\d")), F.regexp_replace(p["lead"], r"\S*\d\S*", FIELD)).otherwise(p["lead"])
    return _bind(path, lambda p: F.struct(at.alias("at"), line.alias("line"), p["n"].alias("n"), F.xxhash64(p["n"], p["lead"]).alias("lead"), F.xxhash64(p["n"], masked(p)).alias("leaf")))


def lines(df: DataFrame, text_col: str) -> DataFrame:
    """A row per line with a word: the row's ``_l_row``, a hash of its text, its place, its text, its lead and its leaf."""
    placed = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), _placed)
    worded = F.filter(placed, lambda x: x["n"] > 0)
    return df.select("_l_row", F.xxhash64(text_col).alias("doc"), F.explode(worded).alias("x")).select("_l_row", "doc", "x.at", "x.line", "x.n", "x.lead", "x.leaf")


def _shingles(tokens: Column) -> Column:
    """Hashes of the shingles of a line; a line of fewer words is one."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - SHINGLE + 1, F.lit(1)))
    return F.transform(starts, lambda k: F.xxhash64(F.array_join(F.slice(tokens, k, SHINGLE), " ")))


def recurring(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys whose texts have enough contexts, of one context each, and enough contexts a text; equal texts are one."""
    once = rows.groupBy(*keys, "doc").agg(F.min("context").alias("context"))
    once = once.groupBy(*keys, "context").agg(F.count("*").alias("n"))
    counted = once.groupBy(*keys).agg(F.count("*").alias("contexts"), F.sum("n").alias("n"))
    return counted.where((F.col("contexts") >= LEAST_CONTEXTS) & (F.col("contexts") >= SHARE * F.col("n")))


def framed(found: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines at ``leaves`` with their ``context`` and of their row ``own``, the share of other lines, ``size``, the number of shingles, and ``most``,
    that of the other lines."""
    marked = found.join(leaves.withColumn("again", F.lit(True)), "leaf", "left")
    held = F.greatest(F.col("n") - SHINGLE + 1, F.lit(1)).alias("held")
    marked = marked.select("_l_row", "doc", "at", "leaf", held, F.when(F.col("again"), F.col("line")).alias("line"), F.when(F.col("again").isNull(), F.col("lead")).alias("lead"))
    row, beyond = Window.partitionBy("_l_row"), (Window.unboundedPreceding, -1)
    before = F.last("lead", ignorenulls=True).over(row.orderBy("at").rangeBetween(*beyond))
    after = F.last("lead", ignorenulls=True).over(row.orderBy(F.desc("at")).rangeBetween(*beyond))
    share = F.count("lead").over(row) / F.count("*").over(row)
    most = F.coalesce(F.sum(F.when(F.col("lead").isNotNull(), F.col("held"))).over(row), F.lit(0))
    placed = marked.select("*", before.alias("before"), after.alias("after"), share.alias("own"), F.sum("held").over(row).alias("size"), most.alias("most"))
    return placed.where(F.col("line").isNotNull()).select("_l_row", "doc", "at", "leaf", "line", F.xxhash64("before", "after").alias("context"), "own", "size", "most")


def originals(keyed: DataFrame, text_col: str, near: DataFrame, leaves: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc) of texts that lie below ``PLAIN`` and whose own shingles are over ``OWN`` of theirs; ``shared``: (tokens) of the distinct lines at ``leaves``."""
    asked = near.where((F.col("own") < PLAIN) & (F.col("most") > OWN * F.col("size"))).groupBy("doc").agg(F.min("_l_row").alias("_l_row"), F.first("size").alias("size"))
    asked = written(asked, "asked")
    rows = lines(keyed.join(asked.select("_l_row"), "_l_row", "left_semi"), text_col).join(leaves, "leaf", "left_anti")
    mine = rows.select("doc", F.explode(_shingles(F.split(_bare(F.col("line")), GAP))).alias("shingle")).groupBy("shingle", "doc").agg(F.count("*").alias("n"))
    alone = mine.groupBy("shingle").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.sum("n").alias("n")).where("doc = last")
    alone = alone.join(shared.select(F.explode(_shingles(F.col("tokens"))).alias("shingle")).distinct(), "shingle", "left_anti")
    own = alone.groupBy("doc").agg(F.sum("n").alias("n"))
    return own.join(asked, "doc").where(F.col("n") > OWN * F.col("size")).select("doc")


def templates(keyed: DataFrame, text_col: str) -> DataFrame:
    """(_l_row, at) of the lines to drop, of rows with a ``_l_row``."""
    found = lines(keyed, text_col)
    # Leaves are written, so the planner knows their size: few are broadcast, many are joined by shuffling.
    leaves = found.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_CONTEXTS)
    leaves = written(leaves.select("leaf"), "leaves")
    # A hash of a leaf's line stands for it, and equal lines at a leaf are taken apart once a context.
    near = written(framed(found, leaves).withColumn("tokens", F.split(_bare(F.col("line")), GAP)).withColumn("line_hash", F.xxhash64("line")), "near")
    distinct = near.groupBy("leaf", "line_hash").agg(F.first("tokens").alias("tokens"))
    counts = written(originals(keyed, text_col, near, leaves, distinct), "originals").withColumn("counts", F.lit(True))
    weighed = near.select("leaf", "line_hash", "context").distinct().groupBy("leaf", "line_hash").agg(F.count("*").alias("contexts"))
    spread = distinct.join(weighed, ["leaf", "line_hash"]).select("leaf", "line_hash", "contexts", (F.size("tokens") < LEAST_TOKENS).alias("short"), F.posexplode("tokens").alias("place", "token"))
    spread = written(spread, "tokens")
    steady = spread.groupBy("leaf", "place", "token").agg(F.sum("contexts").alias("seen")).where(F.col("seen") >= LEAST_CONTEXTS).select("leaf", "place", "token", F.lit(True).alias("steady"))
    kept = spread.join(steady, ["leaf", "place", "token"], "left")
    token = F.when(F.col("short") | (F.col("steady") & ~F.regexp_like("token", F.lit(r"\d"))), F.col("token")).otherwise(FIELD)
    parts = F.array_sort(F.collect_list(F.struct("place", token.alias("token"))))  # of one line
    template = kept.groupBy("leaf", "line_hash").agg(parts.alias("parts")).select(
        "leaf", "line_hash", F.xxhash64(F.array_join(F.transform("parts", lambda x: x["token"]), " ")).alias("template"),
        (F.size(F.filter("parts", lambda x: x["token"] != FIELD)) >= SIMILARITY * F.size("parts")).alias("fixed"),
    )
    template = written(template.where("fixed").drop("fixed"), "templates")
    told = written(near.select("_l_row", "doc", "at", "leaf", "line_hash", "context", "own").join(template, ["leaf", "line_hash"]).join(counts, "doc", "left"), "told")
    dropped = written(recurring(told.where((F.col("own") >= PLAIN) | F.col("counts")), "leaf", "template").select("leaf", "template"), "dropped")
    return told.join(dropped, ["leaf", "template"], "left_semi").select("_l_row", "at")


def drop_templates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without the lines of recurring templates; adds ``_l_lines`` (with a word) and ``_l_dropped`` (of these)."""
    # Rows are told apart by 96 bits of their content; equal rows lose equal lines, so no number among them is needed.
    content = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind]
    row = F.struct(F.xxhash64(*content).alias("x"), F.hash(*content).alias("h"))
    keyed = df.withColumn("_l_row", row)
    gone = written(templates(keyed.select("_l_row", F.col(text_col)), text_col).distinct().groupBy("_l_row").agg(F.array_sort(F.collect_list("at")).alias("_l_gone")), "gone")
    joined = keyed.join(gone.hint("merge"), "_l_row", "left")  # the same plan at every size
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    worded = F.size(F.filter(split, lambda x: _bare(x) != "")).cast("long")
    lost = F.coalesce(F.size("_l_gone"), F.lit(0)).cast("long")
    lost = F.when(lost < worded, lost).otherwise(F.lit(0).cast("long"))
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("_l_gone", i)), "\n")
    return joined.withColumns({"_l_lines": worded, "_l_dropped": lost}).withColumn(text_col, F.when(F.col("_l_dropped") > 0, left).otherwise(F.col(text_col))).drop("_l_row", "_l_gone")


def without_templates(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` without the lines of recurring templates, with its columns alone; ``length_col`` follows a text that changes."""
    left = drop_templates(plain(df), place(df, text_col))
    if length_col:
        size = place(df, length_col)
        left = left.withColumn(size, F.when(F.col("_l_dropped") > 0, F.length(place(df, text_col)).cast(df.schema[length_col].dataType)).otherwise(F.col(size)))
    return named(left, df)


def report(docs: DataFrame) -> DataFrame:
    """Of every document: doc_id, n_lines, n_dropped, and the SHA-256 of the text that is left (null: null)."""
    return drop_templates(docs.select("doc_id", "text")).select("doc_id", F.col("_l_lines").alias("n_lines"), F.col("_l_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
