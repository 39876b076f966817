"""Edges between passages: parents, siblings, shared references, and expansion by one hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.operators.relational import numbered_in_ranges, top_per
from lodestone.sources.scratch import written

HOP = 0.7


def parent_paths(chunks: DataFrame, key: str = "chunk_id", path: str = "hierarchy_path") -> DataFrame:
    """(key, path, parent): the nearest ancestor path of each passage that exists; passages without one are left out.

    Paths, not passages, are climbed and matched, so a path with half of the corpus is one row.
    """
    paths = chunks.select(F.col(path).alias("p")).where(F.col("p").isNotNull()).distinct()
    steps = F.split("p", " > ")
    above = F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), " > ").alias("parent"))))
    asked = paths.select("p", F.explode(above).alias("a")).select("p", "a.*")
    nearest = asked.join(paths.withColumnRenamed("p", "parent"), "parent", "left_semi").groupBy("p").agg(F.max_by("parent", "depth").alias("parent"))
    return chunks.select(key, path).join(nearest.withColumnRenamed("p", path), path).select(key, path, "parent")


def parent_classes(chunks: DataFrame, key: str = "chunk_id", path: str = "hierarchy_path") -> DataFrame:
    """(key, parent, class_id, n_links): parent edges without their pairs: the passages of ``parent`` are the parents, ``class_id`` is their least
    and ``n_links`` their number. The passages of a path are read from the corpus."""
    sizes = chunks.groupBy(F.col(path).alias("parent")).agg(F.min(key).alias("class_id"), F.count("*").alias("n_links"))
    return parent_paths(chunks, key, path).join(sizes, "parent").select(key, "parent", "class_id", "n_links")


def parent_edges(chunks: DataFrame, key: str = "chunk_id", path: str = "hierarchy_path") -> DataFrame:
    """(src, dst): the edges of :func:`parent_classes`, one for each passage and passage of its parent path: as many as their product."""
    own = parent_paths(chunks, key, path).select(F.col(key).alias("src"), F.col("parent").alias("p"))
    return own.join(chunks.select(F.col(key).alias("dst"), F.col(path).alias("p")), "p").select("src", "dst")


def sibling_classes(chunks: DataFrame, key: str = "chunk_id", path: str = "hierarchy_path") -> DataFrame:
    """(key, class_id, n_links): sibling edges without their pairs; a class is a path and named by its least passage."""
    classes = chunks.groupBy(path).agg(F.min(key).alias("class_id"), (F.count("*") - 1).alias("n_links"))
    return chunks.select(key, path).join(classes, path).select(key, "class_id", "n_links")


def links_by_source(chunks: DataFrame, key: str = "chunk_id", path: str = "hierarchy_path") -> DataFrame:
    """(key, n): how many sibling edges (src < dst) start at each passage, counted by its place in the path, not by pairs."""
    placed = numbered_in_ranges(chunks.select(key, path), [path], [F.col(key)], "_k", "_n")
    return placed.select(key, (F.col("_n") - F.col("_k")).alias("n"))


def shared_reference_gate(pairs: DataFrame, references: DataFrame, least: float = 0.15) -> DataFrame:
    """Pairs (src, dst) with shared references, and their Jaccard similarity; references: (id, refs array)."""
    side = lambda c, n: references.select(F.col("id").alias(c), F.col("refs").alias(n))
    both = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    jaccard = shared / F.greatest(F.size(F.array_union("a", "b")), F.lit(1))
    return both.where((shared > 0) | (jaccard >= least)).select("src", "dst", shared.alias("shared"), F.round(jaccard, 6).alias("jaccard"))


def reference_edges(references: DataFrame, chunks: DataFrame, regulation: str = "regulation_id", key: str = "chunk_id") -> DataFrame:
    """(src, dst, kind, weight): references (src, regulation, target, target_paragraph, intent) as edges to passages of their regulation.

    A paragraph resolves to its first passage, else to the first of its article; names are compared without case and outer blanks. What resolves to nothing, or to the
    passage itself, is no edge; a passage refers to another once for each intent. The first passage is that of the least key.
    """
    named = lambda c: F.lower(F.trim(F.col(c)))
    own = chunks.where(F.trim("article") != "").select(F.col(regulation).alias("_r"), named("article").alias("_a"), F.col("paragraph").alias("_p"), F.col(key).alias("_id"))
    exact = own.where(F.col("_p") != "").groupBy("_r", "_a", "_p").agg(F.min("_id").alias("_exact"))
    first = own.groupBy("_r", "_a").agg(F.min("_id").alias("_first"))
    asked = references.select("src", F.col(regulation).alias("_r"), named("target").alias("_a"), F.col("target_paragraph").alias("_p"), F.col("intent").alias("kind"))
    found = asked.join(exact, ["_r", "_a", "_p"], "left").join(first, ["_r", "_a"], "left").withColumn("dst", F.coalesce("_exact", "_first"))
    return found.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).select("src", "dst", "kind").distinct().withColumn("weight", F.lit(1.0))


def set_classes(sets: DataFrame, key: str = "id", items: str = "refs") -> DataFrame:
    """(class_id, items, n): equal sets once, named by their least key; null and empty sets are left out."""
    rows = sets.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(F.array_compact(F.col(items)))).alias("items"))
    return rows.where(F.size("items") > 0).groupBy("items").agg(F.min("key").alias("class_id"), F.count("*").alias("n"))


def members(sets: DataFrame, key: str = "id", items: str = "refs") -> DataFrame:
    """(key, class_id) of every set that isn't empty."""
    rows = sets.select(F.col(key), F.array_sort(F.array_distinct(F.array_compact(F.col(items)))).alias("items"))
    return rows.join(set_classes(sets, key, items).select("items", "class_id"), "items").select(key, "class_id")


def similar_sets(sets: DataFrame, least: float, key: str = "id", items: str = "refs") -> DataFrame:
    """(src, dst, shared, jaccard), src < dst: all pairs of different sets whose Jaccard similarity is at least ``least`` (over 0), by their classes.

    Items are ordered from the rarest on. Two sets that are similar enough share one of the first ``size - ceil(least * size) + 1``
    items of each, so only these are joined; the sizes rule out what can't be similar, and a pair is made by its first common item alone. No pair of
    equal sets is made: :func:`members` tells who is in a class.
    """
    classes = written(set_classes(sets, key, items).select("class_id", "items"), "classes")
    common = written(classes.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df")), "items")
    ranked = classes.select("class_id", F.explode("items").alias("item")).join(common, "item").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("o"))
    size = F.size("items")
    kept = size - F.ceil(F.lit(least) * size - 1e-9).cast("int") + 1
    ordered = ranked.select("class_id", F.transform("o", lambda x: x["item"]).alias("items"))
    rows = written(ordered.select("class_id", "items", F.slice("items", 1, kept).alias("prefix")), "prefixes")
    listed = lambda p: rows.select(F.explode("prefix").alias("item"), *[F.col(c).alias(p + c) for c in ("class_id", "items", "prefix")])
    a, b = listed("a_"), listed("b_")
    sizes = F.least(F.size("a_items"), F.size("b_items")) >= F.lit(least) * F.greatest(F.size("a_items"), F.size("b_items")) - 1e-9
    met = a.join(b, "item").where((F.col("a_class_id") < F.col("b_class_id")) & sizes & (F.get(F.array_intersect("a_prefix", "b_prefix"), F.lit(0)) == F.col("item")))
    shared = F.size(F.array_intersect("a_items", "b_items"))
    jaccard = shared / (F.size("a_items") + F.size("b_items") - shared)
    return met.where(jaccard >= least - 1e-12).select(F.col("a_class_id").alias("src"), F.col("b_class_id").alias("dst"), shared.alias("shared"), F.round(jaccard, 6).alias("jaccard"))


def expand(pool: DataFrame, edges: DataFrame, query_id: str = "query_id", chunk_id: str = "chunk_id") -> DataFrame:
    """The pool (query_id, chunk_id, score) and its neighbours, scored by the best path, without those that are in it."""
    reached = pool.join(edges.select(F.col("src").alias(chunk_id), "dst", "weight"), chunk_id)
    scored = reached.groupBy(query_id, F.col("dst").alias(chunk_id)).agg(F.round(F.max(F.col("score") * HOP * F.col("weight")), 9).alias("score"))
    fresh = scored.join(pool.select(query_id, chunk_id), [query_id, chunk_id], "left_anti")
    return pool.select(query_id, chunk_id, "score", F.lit("pool").alias("source")).unionByName(fresh.withColumn("source", F.lit("graph")))
