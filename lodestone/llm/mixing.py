"""Mixing sources to target weights by a multivariate hypergeometric splitting tree.

Sources weigh 3, 1, 2, repeating, in code point order, null last, and share 150 % of all words; a source gives at
most twice its words and what it can't give is shared by weight among the others. A source is cut into 4,096 blocks
by a hash of the document id; the hash also permutes them. The mix takes whole passes over the blocks, then the first
blocks of the permutation, then single documents up to the target. The quotas of blocks go down a tree that halves
the output shards and draws each half's quota from the multivariate hypergeometric law, so every shard has a fair
sample of the exact mix; shards take disjoint ranges of the permuted blocks and order their documents by hash.

Edge cases: a null or empty text has size 0, is drawn like any other and adds nothing; a null source is a source of its
own, after all others; rows that share an id are drawn together; an empty table gives an empty table. ``mix`` adds columns
that start with ``_m_``; ``copies`` and ``write_shards`` work under any column names. The driver holds a row per source, never per document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lodestone.llm.columns import named, place, plain
from lodestone.sources.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCKS = 4096
SHARDS = 16
TOP_UPS = 4
SEED = 20240131


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (key, source, words) with the target of each; a row per source, so one task sorts them."""
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.array(*map(F.lit, WEIGHTS))[((F.row_number().over(in_order) - 1) % len(WEIGHTS)).cast("int")]
    weighed = sources.withColumn("weight", weight.cast("long")).withColumn("ratio", MOST * F.col("words") / F.col("weight"))
    # The level at which the sources from this one on share what those before can't use; the true level is the largest.
    left = SHARE * F.sum("words").over(everything) - F.coalesce(MOST * F.sum("words").over(by_ratio), F.lit(0))
    levelled = weighed.withColumn("level", left / F.sum("weight").over(onward))
    level = F.max("level").over(everything)
    return levelled.withColumn("target", F.least((MOST * F.col("words")).cast("double"), level * F.col("weight"))).select("key", "words", "target")


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Shards x sources: how many blocks of each source each shard takes; columns sum to the quotas."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(first: int, n: int, quota: np.ndarray) -> None:
        if n == 1:
            out[first] = quota
            return
        half, total = n // 2, int(quota.sum())
        drawn = rng.multivariate_hypergeometric(quota, total * half // n, method="marginals") if total else quota
        split(first, half, drawn)
        split(first + half, n - half, quota - drawn)

    if quotas:
        split(0, shards, np.array(quotas, np.int64))
    return out


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = True, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``_m_size``, ``_m_words`` (the source's), ``_m_target`` and ``_m_shards`` (the shard of each copy that
    the mix takes; an empty array: not taken) and ``_m_order`` (sort a shard by it to shuffle locally)."""
    spark = df.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    mixed_hash = F.xxhash64(F.lit(seed), F.col(id_col))
    sized = df.withColumns({
        "_m_key": key, "_m_source": F.col(source_col), "_m_size": F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long"),
        "_m_block": mixed_hash.bitwiseAND(BLOCKS - 1).cast("int"), "_m_order": F.shiftrightunsigned(mixed_hash, 12),
    })
    sized = written(sized if keep_text else sized.drop(text_col), "sized")
    blocks = sized.groupBy(F.col("_m_key").alias("key"), F.col("_m_block").alias("block")).agg(F.sum("_m_size").alias("of_block"), F.first("_m_source").alias("source"))
    blocks = written(blocks, "blocks")  # a row per source and block, at most
    goals = targets(blocks.groupBy("key").agg(F.sum("of_block").alias("words"), F.first("source").alias("source")))
    permuted = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), "key", "block"), "block")
    passes = F.when(F.col("words") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("words")))).otherwise(0).cast("long")
    before = F.coalesce(F.sum("of_block").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = (
        blocks.drop("source").join(goals, "key")
        .withColumns({"passes": passes, "rank": F.row_number().over(permuted) - 1, "before": before, "n_blocks": F.count("*").over(Window.partitionBy("key"))})
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))
        .withColumn("state", F.when(F.col("rest") <= 0, -1).when(F.col("before") + F.col("of_block") <= F.col("rest"), 1).when(F.col("before") < F.col("rest"), 0).otherwise(-1))
    )
    plan = written(plan, "plan")
    # Documents of the block in which the target falls: those of its order that fit whole.
    dealt = sized.join(plan.select(F.col("key").alias("_m_key"), F.col("block").alias("_m_block"), F.struct("words", "target", "passes", "rank", "before", "n_blocks", "rest", "state").alias("_m_p")), ["_m_key", "_m_block"])
    p = F.col("_m_p")
    cut = (
        sized.select("_m_key", "_m_block", F.col(id_col).alias("id"), "_m_size", "_m_order")
        .join(plan.where("state = 0").select(F.col("key").alias("_m_key"), F.col("block").alias("_m_block"), "before", "rest"), ["_m_key", "_m_block"])
        .withColumn("upto", F.col("before") + F.sum("_m_size").over(Window.partitionBy("_m_key", "_m_block").orderBy("_m_order", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    fits = cut.where(F.col("upto") <= F.col("rest")).groupBy("_m_key").agg(F.max("_m_order").alias("last"), F.max("upto").alias("upto"))
    residual = plan.where("state = 0").select(F.col("key").alias("_m_key"), F.col("block"), "before", "rest").join(fits, "_m_key", "left").select(
        "_m_key", F.col("block").alias("cut_block"), F.coalesce("last", F.lit(-1)).alias("last"), (F.col("rest") - F.coalesce("upto", "before")).alias("short"),
        F.array().cast("array<struct<order:bigint,block:int>>").alias("more"),
    )
    ends = written(residual, "ends")  # a row per source
    free = sized.select("_m_key", "_m_block", "_m_size", "_m_order").join(plan.where("state < 1").select(F.col("key").alias("_m_key"), F.col("block").alias("_m_block")), ["_m_key", "_m_block"])
    # What is still missing is filled by the largest document of the source that fits, again and again; at last by the closest one.
    for k in range(TOP_UPS):
        last_one = k == TOP_UPS - 1
        off = F.abs(F.col("_m_size") - F.col("short"))
        open_ = (F.col("_m_block") != F.col("cut_block")) | (F.col("_m_order") > F.col("last"))
        unused = ~F.exists("more", lambda x: (x["order"] == F.col("_m_order")) & (x["block"] == F.col("_m_block")))
        found = free.join(ends, "_m_key").where(open_ & unused & (F.col("_m_size") > 0) & (off < F.col("short") if last_one else F.col("_m_size") <= F.col("short")))
        best = found.groupBy("_m_key").agg(F.min(F.struct(off.alias("off"), "_m_order", "_m_block", "_m_size")).alias("best"))
        got = F.col("best").isNotNull()
        ends = written(ends.join(best, "_m_key", "left").select(
            "_m_key", "cut_block", "last", F.when(got, F.col("short") - F.col("best._m_size")).otherwise(F.col("short")).alias("short"),
            F.when(got, F.concat("more", F.array(F.struct(F.col("best._m_order").alias("order"), F.col("best._m_block").alias("block"))))).otherwise(F.col("more")).alias("more"),
        ), "ends")

    quota = F.first("passes") * F.first("n_blocks") + F.sum(F.when(F.col("state") >= 0, 1).otherwise(0))
    counted = plan.groupBy("key").agg(quota.alias("q")).orderBy("key").collect()  # a row per source
    tree = splitting_tree([r["q"] for r in counted], shards, seed)
    offsets = [(r["key"], [int(x) for x in np.cumsum(tree[:, k])]) for k, r in enumerate(counted)]
    schema = StructType([StructField("_m_key", StringType()), StructField("_m_upto", ArrayType(LongType()))])
    per_source = written(spark.createDataFrame(offsets, schema).join(ends, "_m_key", "left"), "offsets")

    shard_of = lambda index: F.size(F.filter("_m_upto", lambda x: x <= index))
    whole = F.when(p["passes"] > 0, F.transform(F.sequence(F.lit(1), p["passes"]), lambda c: shard_of((c - 1) * p["n_blocks"] + p["rank"]))).otherwise(F.array().cast("array<int>"))
    in_cut = (F.col("_m_block") == F.col("cut_block")) & (F.col("_m_order") <= F.col("last"))
    extra = F.exists("more", lambda x: (x["order"] == F.col("_m_order")) & (x["block"] == F.col("_m_block")))
    index = p["passes"] * p["n_blocks"] + F.when(p["state"] == 1, p["rank"]).otherwise(F.element_at("_m_upto", -1) - 1 - p["passes"] * p["n_blocks"])
    partial: Column = (p["state"] == 1) | F.coalesce((p["state"] == 0) & in_cut, F.lit(False)) | F.coalesce(extra, F.lit(False))
    taken = F.when(partial, F.concat(whole, F.array(shard_of(index)))).otherwise(whole)
    return dealt.join(per_source, "_m_key").withColumns({"_m_shards": taken, "_m_words": p["words"], "_m_target": p["target"]}).drop(
        "_m_key", "_m_block", "_m_source", "_m_p", "_m_upto", "cut_block", "last", "short", "more"
    )


def _shuffled(df: DataFrame, id_col: str, text_col: str, source_col: str, **options) -> DataFrame:
    """Plain columns of each copy with its ``_m_shard``: shards apart, each in the order of its permutation.

    A shard is dealt as sixteen slices of that order, so no task holds a shard.
    """
    mixed = mix(plain(df), place(df, id_col), place(df, text_col), place(df, source_col), **options)
    taken = mixed.withColumn("_m_shard", F.explode("_m_shards"))
    return taken.repartition("_m_shard", F.shiftrightunsigned("_m_order", 48)).sortWithinPartitions("_m_shard", "_m_order")


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of ``df``, a row for each copy that is taken, shuffled locally by shard."""
    return named(_shuffled(df, id_col, text_col, source_col, **options), df)


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> None:
    """The mix as Parquet, a folder ``shard=N`` for each output shard."""
    found = _shuffled(df, id_col, text_col, source_col, **options)
    shard = "shard" + "_" * max((len(c) for c in df.columns if c.startswith("shard")), default=0)  # a name that is free
    found.select(*(F.col(f"c{k}") for k in range(len(df.columns))), "_m_shard").toDF(*df.columns, shard).write.partitionBy(shard).parquet(path)


def report(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    return mix(docs.select("doc_id", "text", "source"), keep_text=False).select(
        "doc_id", F.col("_m_size").alias("size"), F.col("_m_words").alias("source_size"), F.col("_m_target").alias("target"),
        (F.col("_m_size") * F.size("_m_shards")).alias("taken"), F.array_join(F.col("_m_shards").cast("array<string>"), ",").alias("shards"),
    )
