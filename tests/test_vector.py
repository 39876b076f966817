"""Dense search by blocks and by index, and recall over eligible passages."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import retrieval as V, vector

SCHEMA = "chunk_id long, embedding array<double>"


def brute(queries, corpus, k):
    out = set()
    for q, a in queries:
        scored = []
        for c, b in corpus:
            if b is None or any(x is None for x in b) or len(b) != len(a):
                continue
            norm = (np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)
            scored.append((-round(float(np.dot(a, b)) / norm, 9) + 0.0, c))
        out |= {(q, c, r + 1) for r, (_, c) in enumerate(sorted(scored)[:k])}
    return out


def rows_of(found):
    return {(r["query_id"], r["chunk_id"], r["rank"]) for r in found.collect()}


def test_blocks_and_index_with_all_lists_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 16)
    rng = np.random.default_rng(3)
    corpus = [(k, rng.normal(size=5).round(2).tolist()) for k in range(150)]
    corpus += [(1000 + k, [1.0, 0.0, 0.0, 0.0, 0.0]) for k in range(70)]  # one list holds a third
    corpus += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [1.0, 2.0]), (2003, [0.0] * 5), (2004, [])]
    queries = [(1, [1.0, 0.1, 0.0, 0.0, 0.0]), (2, [0.0] * 5), (3, corpus[7][1]), (4, [3.0, 4.0]), (5, [-1.0, 0.2, 0.3, 0.0, 0.9])]
    df, asked = spark.createDataFrame(corpus, SCHEMA).repartition(3), spark.createDataFrame(queries, "query_id long, embedding array<double>")
    for k in (1, 10, 80):
        assert rows_of(vector.top_k(asked, df, k)) == brute(queries, corpus, k)
    index = vector.build_index(df, lists=9)
    held = [i for r in index.blocks.collect() for i in r["ids"]]
    assert len(held) == len(set(held)) == 150 + 70 + 3 and max(len(r["ids"]) for r in index.blocks.collect()) <= 16
    wide = [q for q in queries if len(q[1]) == 5]
    assert rows_of(index.search(asked, 10, probes=9)) == brute(wide, [c for c in corpus if c[1] and len(c[1]) == 5], 10) | brute(queries[3:4], corpus, 10)
    none = vector.build_index(df.limit(0))
    assert none.search(asked, 5).count() == 0 and vector.top_k(asked, df.limit(0), 5).count() == 0 and index.search(asked.limit(0), 5).count() == 0


def test_recall_of_the_index(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked, corpus = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = vector.build_index(corpus)
    assert index.probes < len(index.centroids)
    assert vector.recall(index.search(asked, 10), vector.top_k(asked, corpus, 10)).first()[0] >= 0.9


def test_both_branches_see_the_same_passages(spark):
    chunks = spark.createDataFrame(
        [(1, "antincendio estintore", True, None, "NAZIONALE"), (2, "antincendio uscita", False, None, "NAZIONALE"), (3, "antincendio idrante", True, "2020-01-01", "EUROPEA"), (4, "antincendio porta", True, "2030-01-01", "LAZIO"), (5, "primo soccorso", True, None, "LOMBARDIA")],
        "chunk_id long, text string, is_current boolean, effective_until string, region string",
    ).withColumn("effective_until", F.col("effective_until").cast("date"))
    vectors = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(1, 8)], SCHEMA)
    words, asked = spark.createDataFrame([(9, "antincendio")], "query_id long, text string"), spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    found = lambda **kw: {r["chunk_id"] for r in V.recall_both(words, asked, V.eligible(chunks, "2024-01-15", "LAZIO", **kw), vectors, 10).collect()}
    assert found() == {1, 4} and found(include_expired=True) == {1, 3, 4}
    assert V.recall_both(words, asked, chunks.limit(0), vectors, 10).count() == 0
