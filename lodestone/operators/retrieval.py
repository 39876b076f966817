"""Retrieval: BM25, fusion of rankings, decay of foreign sections, thresholds and pools; all queries of a set in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions.text import bm25_tokens
from lodestone.operators.relational import current, majority, quantile_by_index, top_per, valid_at, visible_in
from lodestone.operators.vector import top_k
from lodestone.sources.scratch import written

K1, B, EPSILON = 1.5, 0.75, 0.25
FUSION = 60
DECAY, DISCARD, LEAST_SEEN, STRONG = 0.4, 0.30, 4, 0.70
UNKNOWN = "Sconosciuto"


def bm25(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(query_id, chunk_id, score, rank) by BM25 with negative weights replaced by a share of the mean weight.

    The corpus is cut into words once. Only occurrences of asked words are shuffled, by chunk: they are counted, scored and cut
    to k where they then are. Statistics cover the whole corpus; a text without words counts as well, with length 0.
    """
    words = written(corpus.select(chunk_id, F.coalesce(bm25_tokens(F.col(text)), F.array().cast("array<string>")).alias("words")), "words")
    whole = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean_length"))  # one row
    seen = words.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count("*").alias("df")).crossJoin(whole.select("n"))
    raw = written(seen.select("token", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "weights")
    weight = raw.crossJoin(raw.agg(F.avg("raw").alias("mean"))).select("token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select(query_id, F.explode(bm25_tokens(F.col(text))).alias("token")).groupBy(query_id, "token").agg(F.count("*").alias("qtf"))
    terms = written(asked.join(weight, "token"), "terms")  # queries are few: their words, not the corpus's, decide what is joined
    found = words.select(chunk_id, F.size("words").alias("length"), F.explode("words").alias("token")).join(terms.select("token").distinct(), "token", "left_semi")
    counted = found.repartition(chunk_id).groupBy(chunk_id, "length", "token").agg(F.count("*").alias("tf"))
    joined = counted.crossJoin(whole.select("mean_length")).join(terms, "token")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = joined.groupBy(query_id, chunk_id).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return top_per(scored, [query_id], [F.desc("score"), F.col(chunk_id)], k, "rank")


def eligible(chunks: DataFrame, as_of: str, region: str, include_expired: bool = False, everywhere: tuple[str, ...] = ("NAZIONALE", "EUROPEA"), flag: str = "is_current", until: str = "effective_until", area: str = "region") -> DataFrame:
    """Passages that may be found: current, of regulations that are valid on a day, and visible in a region."""
    return visible_in(valid_at(current(chunks, flag), until, as_of, include_expired), region, area, everywhere)


def recall_both(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, embeddings: DataFrame, k: int, pool: int = 200, query_id: str = "query_id", chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """Words and vectors of the same passages, fused: (query_id, chunk_id, score, rank).

    ``chunks`` are the eligible passages. Both branches rank these alone, the statistics of words too, as one that saw more would bring back what the other leaves out. An
    embedding without its passage isn't ranked; without passages nothing is found.
    """
    chunks = written(chunks.select(chunk_id, text), "eligible")
    dense = top_k(vectors, embeddings.join(chunks.select(chunk_id), chunk_id, "left_semi"), pool, query_id, chunk_id)
    return fuse([bm25(queries, chunks, pool, query_id, chunk_id, text).select(query_id, chunk_id, "rank"), dense.select(query_id, chunk_id, "rank")], k, query_id, chunk_id)


def fuse(rankings: list[DataFrame], k: int, query_id: str = "query_id", chunk_id: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, chunk_id, rank)."""
    parts = [r.select(query_id, chunk_id, (1 / (F.lit(FUSION) + F.col("rank"))).alias("part")) for r in rankings]
    both = parts[0]
    for other in parts[1:]:
        both = both.unionByName(other)
    fused = both.groupBy(query_id, chunk_id).agg(F.round(F.sum("part"), 9).alias("score"))
    return top_per(fused, [query_id], [F.desc("score"), F.col(chunk_id)], k, "rank")


def fallback_rerank(pool: DataFrame, n: int, query_id: str = "query_id") -> DataFrame:
    """What a missing reranker leaves: the first n, scored by place; an alert never filters."""
    return pool.where(F.col("rank") <= n).withColumns({"score": F.round(1 / (F.col("rank") + 0.0), 9), "source": F.lit("rrf_fallback")})


def section_decay(pool: DataFrame, query_id: str = "query_id", strong: bool = False) -> DataFrame:
    """Pool (query_id, regulation_id, top_section, score) with ``decision`` and the decayed ``score``.

    A passage outside its regulation's dominant section loses score, and goes if little is left; with ``strong``, it goes
    at once where the section dominates by 70 %.
    """
    keys = [query_id, "regulation_id"]
    dominant = majority(pool, keys, "top_section", [UNKNOWN]).select(*keys, F.col("top_section").alias("dominant"), "observed", "ratio")
    known = F.col("top_section").isNotNull() & (F.col("top_section") != UNKNOWN)
    foreign = known & F.col("dominant").isNotNull() & (F.col("observed") >= LEAST_SEEN) & (F.col("top_section") != F.col("dominant"))
    joined = pool.join(dominant, keys, "left").withColumn("best", F.max("score").over(Window.partitionBy(query_id)))
    low = F.col("score") * DECAY < F.col("best") * DISCARD
    ladder = F.when(~F.coalesce(foreign, F.lit(False)), "kept")
    if strong:
        ladder = ladder.when((F.col("ratio") >= STRONG) & (F.col("ratio") < 1), "dropped")
    decided = joined.withColumn("decision", ladder.when(low, "dropped").otherwise("decayed"))
    return decided.withColumn("score", F.when(F.col("decision") == "kept", F.col("score")).otherwise(F.round(F.col("score") * DECAY, 9))).drop("dominant", "observed", "ratio", "best")


def thin_regulations(pool: DataFrame, least: int = 3, block: bool = False, query_id: str = "query_id") -> DataFrame:
    """Marks passages of regulations with few passages in the pool; with ``block`` drops them."""
    marked = pool.withColumn("thin", F.count("*").over(Window.partitionBy(query_id, "regulation_id")) < least)
    return marked.where("NOT thin") if block else marked


def per_module_threshold(pool: DataFrame, least_score: float = 0.3, least_rows: int = 30, query_id: str = "query_id") -> DataFrame:
    """Scores over a bound; where too few are, over the lower quartile by index instead, if that saves more."""
    w = Window.partitionBy(query_id)
    low = quantile_by_index(pool.select(query_id, "score"), [query_id], "score", 0.25, "p25")
    judged = pool.join(low, query_id).withColumns({"over": F.count_if(F.col("score") > least_score).over(w), "over_p25": F.count_if(F.col("score") > F.col("p25")).over(w)})
    rescue = (F.col("over") < least_rows) & (F.col("over_p25") > F.col("over"))
    return judged.where(F.col("score") > F.when(rescue, F.col("p25")).otherwise(F.lit(least_score))).drop("p25", "over", "over_p25")


def first_module_wins(pool: DataFrame, chunk_id: str = "chunk_id", module: str = "query_id") -> DataFrame:
    return top_per(pool, [chunk_id], [F.col(module), F.col("rank")])


IMAGES, ALIKE, REUSED = 8, 0.30, 3  # fixed values: images of a search, their least similarity, uses of one in a course


def image_search(asked: DataFrame, vectors: DataFrame, library: DataFrame, usage: DataFrame | None = None, k: int = IMAGES, least: float = ALIKE, cap: int = REUSED) -> DataFrame:
    """(query_id, image_id, score, rank, by): the nearest images of each query over a similarity, else those that share words with it as tags.

    Asked (query_id, text), vectors (query_id, embedding), library (image_id, embedding, tags), usage (query_id, image_id, n). With usage three times as
    many are looked at, and those used ``cap`` times are left out. By tags the score is the share of an image's tags that are words of the query of more than two letters; a query without
    a vector, or whose images are all too far or used up, is answered that way. Ties go to the smaller image.
    """
    wide = k if usage is None else 3 * k
    free = lambda found: found if usage is None else found.join(usage.where(F.col("n") >= cap).select("query_id", "image_id"), ["query_id", "image_id"], "left_anti")
    order = [F.desc("score"), F.col("image_id")]
    near = top_k(vectors, library, wide, "query_id", "image_id").where(F.col("score") >= least).drop("rank")
    hits = written(top_per(free(near), ["query_id"], order, k, "rank"), "hits")
    words = F.array_distinct(F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda w: F.length(w) > 2))
    rest = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.explode(words).alias("tag"))
    tagged = library.select("image_id", F.greatest(F.size("tags"), F.lit(1)).alias("_n"), F.explode(F.array_distinct("tags")).alias("tag"))
    shared = rest.join(tagged, "tag").groupBy("query_id", "image_id", "_n").agg(F.count("*").alias("_s"))
    scored = shared.select("query_id", "image_id", F.round(F.col("_s") / F.col("_n"), 9).alias("score"))
    by_tags = top_per(free(top_per(scored, ["query_id"], order, wide)), ["query_id"], order, k, "rank")
    return hits.withColumn("by", F.lit("vector")).unionByName(by_tags.withColumn("by", F.lit("tags")))
