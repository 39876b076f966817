"""Queries of retrieval and of the passage graph: benchmark texts ask, documents and their embeddings answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.operators import graph as G, relational as R, retrieval as V
from lodestone.operators.vector import build_index, top_k
from lodestone.plans.registry import Registry, Tables

registry = Registry()
add = registry.add


def _asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _asked_vectors(t: Tables) -> DataFrame:
    """A query's vector: the embedding of its id."""
    return t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")


def _chunks(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text", "lang", F.col("source").alias("regulation_id"))


def _vectors(t: Tables) -> DataFrame:
    known = t.documents.select(F.col("doc_id").alias("vec_id"), "lang", F.col("source").alias("regulation_id"))
    return t.embeddings.join(known, "vec_id").select(F.col("vec_id").alias("chunk_id"), "embedding", "lang", "regulation_id", F.col("label").cast("string").alias("top_section"))


_TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 2)"
_BM25 = f"""tok AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT doc_id, len({_TOKENS}) AS len FROM documents),
st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM len), idf0 AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS v FROM tf, st GROUP BY token, n), mean AS (SELECT avg(v) AS m FROM idf0),
idf AS (SELECT token, CASE WHEN v < 0 THEN 0.25 * m ELSE v END AS idf FROM idf0, mean), q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id AS query_id, tf.doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))), 6) AS score FROM tf JOIN q USING (token) JOIN idf USING (token) JOIN len ON len.doc_id = tf.doc_id, st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0)"""
_COS = "round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 9)"
_POOL = f"""dn AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS score FROM embeddings a JOIN benchmark ON a.vec_id = item_id JOIN embeddings b ON b.vec_id IN (SELECT doc_id FROM documents)),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn),
pool AS (SELECT query_id, chunk_id, score, rank, d.source AS regulation_id, CAST(e.label AS VARCHAR) AS top_section FROM dr JOIN documents d ON d.doc_id = chunk_id JOIN embeddings e ON e.vec_id = chunk_id WHERE rank <= 100)"""


def pool_of(t: Tables) -> DataFrame:
    """(query_id, chunk_id, score, rank, regulation_id, top_section): the 100 nearest passages of each query."""
    vectors = _vectors(t)
    return top_k(_asked_vectors(t), vectors, 100).join(vectors.select("chunk_id", "regulation_id", "top_section"), "chunk_id").select("query_id", "chunk_id", "score", "rank", "regulation_id", "top_section")


@add(f"WITH {_BM25} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 20")
def r2_bm25(t: Tables) -> DataFrame:
    return V.bm25(_asked(t), _chunks(t), 20)


@add(f"""WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM n) SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r3_dense(t: Tables) -> DataFrame:
    """Queries: every vector whose id is divisible by 20; against all vectors."""
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return top_k(queries, t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)


@add()
def r3_indexed(t: Tables) -> DataFrame:
    """The same by an inverted-file index over all vectors; its recall is measured against the exact form."""
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return build_index(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")).search(queries, 10)


_FUSED = f"""{_BM25}, {_POOL}, f AS (SELECT query_id, chunk_id, round(sum(p), 9) AS score FROM (SELECT query_id, chunk_id, 1 / (60 + rank) AS p FROM bm WHERE rank <= 200 UNION ALL SELECT query_id, chunk_id, 1 / (60 + rank) FROM dr WHERE rank <= 200) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f)"""


def hybrid(t: Tables, k: int) -> DataFrame:
    dense = top_k(_asked_vectors(t), _vectors(t), 200)
    return V.fuse([V.bm25(_asked(t), _chunks(t), 200).select("query_id", "chunk_id", "rank"), dense.select("query_id", "chunk_id", "rank")], k)


@add(f"WITH {_FUSED} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 200")
def r4_fusion(t: Tables) -> DataFrame:
    return hybrid(t, 200)


@add(f"WITH {_FUSED} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 20")
def r5_hybrid_recall(t: Tables) -> DataFrame:
    """Both recall branches, fused."""
    return hybrid(t, 20)


_ELIGIBLE = "el AS (SELECT * FROM documents WHERE n_chars >= 200 AND (doc_id % 3 = 0 OR DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) > DATE '2024-01-15') AND (lang IN ('en', 'fr') OR lang IS NOT DISTINCT FROM 'de'))"


@add(f"WITH {_ELIGIBLE}, {_FUSED.replace('FROM documents', 'FROM el').replace('JOIN documents', 'JOIN el')} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 20")
def r5_eligible_recall(t: Tables) -> DataFrame:
    """Both branches over current passages of regulations that are valid on a day and visible in a region."""
    until = F.when(F.col("doc_id") % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")))
    known = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("region"), (F.col("n_chars") >= 200).alias("is_current"), until.alias("effective_until"))
    found = V.eligible(known, "2024-01-15", "de", everywhere=("en", "fr"))
    return V.recall_both(_asked(t), _asked_vectors(t), found, t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), 20)


@add(f"WITH {_FUSED} SELECT query_id, chunk_id, round(1 / rank, 9) AS score, CAST(rank AS INTEGER) AS rank, 'rrf_fallback' AS source FROM fr WHERE rank <= 10")
def r6_fallback_rerank(t: Tables) -> DataFrame:
    return V.fallback_rerank(hybrid(t, 200), 10)


@add(f"""WITH {_FUSED}, c AS (SELECT fr.query_id, fr.chunk_id, dn.score FROM fr JOIN dn ON dn.query_id = fr.query_id AND dn.chunk_id = fr.chunk_id JOIN embeddings e ON e.vec_id = fr.chunk_id WHERE rank <= 100 AND e.label <> 5)
SELECT query_id, chunk_id, score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 30""")
def r7_subtopic_selector(t: Tables) -> DataFrame:
    """Of the fused 100, those with a vector and inside the regulation (not of section 5), by cosine, 30 a query."""
    from lodestone.functions.text import cosine

    vectors = _vectors(t).where("top_section <> '5'").select("chunk_id", F.col("embedding").alias("c"))
    queries = _asked_vectors(t).withColumnRenamed("embedding", "q")
    scored = hybrid(t, 100).select("query_id", "chunk_id").join(vectors, "chunk_id").join(queries, "query_id")
    return R.top_per(scored.select("query_id", "chunk_id", F.round(cosine(F.col("q"), F.col("c")), 9).alias("score")), ["query_id"], [F.desc("score"), F.col("chunk_id")], 30)


_DOMINANT = """vt AS (SELECT query_id, regulation_id, top_section, count(*) AS votes FROM pool WHERE top_section <> 'Sconosciuto' GROUP BY ALL),
dm AS (SELECT query_id, regulation_id, top_section AS dominant, sum(votes) OVER w AS observed, votes / sum(votes) OVER w AS ratio, row_number() OVER (PARTITION BY query_id, regulation_id ORDER BY votes DESC, top_section) AS k FROM vt WINDOW w AS (PARTITION BY query_id, regulation_id)),
j AS (SELECT p.*, max(score) OVER (PARTITION BY p.query_id) AS best, observed >= 4 AND top_section <> dominant AS alien, ratio FROM pool p LEFT JOIN dm ON dm.query_id = p.query_id AND dm.regulation_id = p.regulation_id AND k = 1)"""


@add(f"""WITH {_POOL}, {_DOMINANT}, x AS (SELECT *, CASE WHEN NOT coalesce(alien, false) THEN 'kept' WHEN score * 0.4 < best * 0.30 THEN 'dropped' ELSE 'decayed' END AS decision FROM j)
SELECT query_id, chunk_id, decision, CASE WHEN decision = 'kept' THEN score ELSE round(score * 0.4, 9) END AS score FROM x""")
def r8_section_decay(t: Tables) -> DataFrame:
    return V.section_decay(pool_of(t)).select("query_id", "chunk_id", "decision", "score")


@add(f"""WITH {_POOL}, {_DOMINANT}, x AS (SELECT *, CASE WHEN NOT coalesce(alien, false) THEN 'kept' WHEN ratio >= 0.7 AND ratio < 1 THEN 'dropped' WHEN score * 0.4 < best * 0.30 THEN 'dropped' ELSE 'decayed' END AS decision FROM j)
SELECT query_id, decision, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY ALL""")
def r9_strong_dominance(t: Tables) -> DataFrame:
    return V.section_decay(pool_of(t), strong=True).groupBy("query_id", "decision").agg(F.count("*").alias("n"))


@add(f"WITH {_POOL} SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id, regulation_id) < 3 AS thin FROM pool")
def r10_thin_corpus(t: Tables) -> DataFrame:
    return V.thin_regulations(pool_of(t)).select("query_id", "chunk_id", "thin")


@add(f"""WITH {_POOL}, {_DOMINANT}, x AS (SELECT *, CASE WHEN NOT coalesce(alien, false) THEN 'kept' WHEN score * 0.4 < best * 0.30 THEN 'dropped' ELSE 'decayed' END AS decision FROM j WHERE rank <= 100),
y AS (SELECT *, count(*) OVER (PARTITION BY query_id, regulation_id) < 3 AS thin FROM x WHERE decision <> 'dropped') SELECT query_id, chunk_id, decision FROM y WHERE NOT thin""")
def r11_composition(t: Tables) -> DataFrame:
    decayed = V.section_decay(pool_of(t)).where("decision <> 'dropped'")
    return V.thin_regulations(decayed, block=True).select("query_id", "chunk_id", "decision")


@add(f"WITH {_POOL} SELECT chunk_id, query_id FROM pool WHERE rank <= 30 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY query_id, rank) = 1")
def r12_materialized_skeleton(t: Tables) -> DataFrame:
    """Voices keep their pools; of a module's pool the first voice that has a passage wins."""
    return V.first_module_wins(pool_of(t).where("rank <= 30")).select("chunk_id", "query_id")


@add(f"""WITH {_POOL}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score) AS a, count(*) OVER (PARTITION BY query_id) AS n FROM pool), p AS (SELECT query_id, score AS p25 FROM k WHERE a = n // 4 + 1),
x AS (SELECT pool.*, p25, count(*) FILTER (score > 0.3) OVER w AS o, count(*) FILTER (score > p25) OVER w AS o25 FROM pool JOIN p USING (query_id) WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, score FROM x WHERE score > CASE WHEN o < 30 AND o25 > o THEN p25 ELSE 0.3 END""")
def r13_per_module_threshold(t: Tables) -> DataFrame:
    return V.per_module_threshold(pool_of(t)).select("query_id", "chunk_id", "score")


@add(f"""WITH {_POOL}, u AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY query_id, rank) = 1), a AS (SELECT query_id, count(*) AS raw FROM pool GROUP BY 1), b AS (SELECT query_id, count(*) AS kept FROM u GROUP BY 1)
SELECT query_id, CAST(raw AS BIGINT) AS raw, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(raw - coalesce(kept, 0) AS BIGINT) AS lost FROM a LEFT JOIN b USING (query_id)""")
def r15_diagnostics(t: Tables) -> DataFrame:
    pool = pool_of(t)
    raw = pool.groupBy("query_id").agg(F.count("*").alias("raw"))
    kept = R.count_per(raw, V.first_module_wins(pool).select("query_id"), "query_id", "kept")
    return kept.withColumn("lost", F.col("raw") - F.col("kept"))


@add(f"""WITH {_POOL}, u AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY query_id, rank) AS k FROM pool)
SELECT query_id, chunk_id, rank, (SELECT CAST(count(*) AS BIGINT) FROM u) AS raw, (SELECT CAST(count(*) AS BIGINT) FROM u WHERE k = 1) AS all_kept, (SELECT CAST(count(*) AS BIGINT) FROM u WHERE k > 1) AS lost FROM u WHERE k = 1""")
def r15_observed(t: Tables) -> DataFrame:
    """Passages that the first module keeps, beside how many there were, counted in the same pass."""
    first = F.row_number().over(Window.partitionBy("chunk_id").orderBy("query_id", "rank")) == 1
    kept, seen = R.kept_and_counted(pool_of(t).withColumn("first", first), F.col("first"), "kept")
    return kept.select("query_id", "chunk_id", "rank", F.lit(seen["raw"]).cast("long").alias("raw"), F.lit(seen["kept"]).cast("long").alias("all_kept"), F.lit(seen["lost"]).cast("long").alias("lost"))


@add(f"WITH {_POOL} SELECT query_id, CAST(count(*) AS BIGINT) AS before, CAST(count(*) FILTER (score > 0.2) AS BIGINT) AS after, count(*) >= 5 AND count(*) FILTER (score > 0.2) >= 5 AS enough FROM pool GROUP BY 1")
def r16_gates(t: Tables) -> DataFrame:
    before, after = F.count("*"), F.count_if(F.col("score") > 0.2)
    return pool_of(t).groupBy("query_id").agg(before.alias("before"), after.alias("after"), ((before >= 5) & (after >= 5)).alias("enough"))


@add(f"""WITH dn AS (SELECT a.vec_id AS query_id, b.vec_id AS image_id, {_COS} AS score FROM embeddings a JOIN benchmark ON a.vec_id = item_id JOIN embeddings b ON b.vec_id IN (SELECT doc_id FROM documents) AND b.label <> 3 WHERE a.label <> 5),
v AS (SELECT * FROM dn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) <= 24), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank FROM v WHERE score >= 0.30 AND (query_id + image_id) % 5 < 3 QUALIFY rank <= 8),
g AS (SELECT doc_id AS image_id, list_distinct(string_split_regex(lower(trim(text)), '\\s+')[1:12]) AS tags FROM documents), gu AS (SELECT image_id, len(tags) AS n, unnest(tags) AS tag FROM g),
w AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: length(x) > 2)) AS tag FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM h)),
s AS (SELECT query_id, image_id, round(count(*) / greatest(any_value(n), 1), 9) AS score FROM w JOIN gu USING (tag) GROUP BY 1, 2), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) <= 24),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank FROM t WHERE (query_id + image_id) % 5 < 3 QUALIFY rank <= 8)
SELECT query_id, image_id, score, CAST(rank AS INTEGER) AS rank, 'vector' AS by FROM h UNION ALL SELECT query_id, image_id, score, CAST(rank AS INTEGER), 'tags' FROM x""")
def r17_image_search(t: Tables) -> DataFrame:
    """Documents as images, their first words as tags; some queries have no vector, and an image was used from no to four times."""
    tags = F.array_distinct(F.slice(F.split(F.lower(F.trim("text")), r"\s+"), 1, 12))
    library = t.documents.select(F.col("doc_id").alias("image_id"), tags.alias("tags")).join(t.embeddings.where("label <> 3").select(F.col("vec_id").alias("image_id"), "embedding"), "image_id", "left")
    vectors = t.embeddings.where("label <> 5").select(F.col("vec_id").alias("query_id"), "embedding").join(_asked(t).select("query_id"), "query_id", "left_semi")
    usage = _asked(t).select("query_id").crossJoin(t.documents.select(F.col("doc_id").alias("image_id"))).withColumn("n", (F.col("query_id") + F.col("image_id")) % 5)
    return V.image_search(_asked(t), vectors, library, usage)


@add(f"""WITH {_POOL} SELECT query_id, chunk_id AS src, d.doc_id AS dst, d.source AS regulation_id FROM pool JOIN documents d ON d.doc_id = chunk_id + 20 WHERE rank <= 10""")
def j10_edges_of_top(t: Tables) -> DataFrame:
    """Edges of the best passages with what they lead to; an edge goes to the next document of a source."""
    targets = t.documents.select((F.col("doc_id") - 20).alias("src"), F.col("doc_id").alias("dst"), F.col("source").alias("regulation_id"))
    return pool_of(t).where("rank <= 10").select("query_id", F.col("chunk_id").alias("src")).join(targets, "src").select("query_id", "src", "dst", "regulation_id")


@add(f"""WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0) SELECT chunk_id, score FROM n ORDER BY score DESC, chunk_id LIMIT 30""")
def t5_vector_top_k(t: Tables) -> DataFrame:
    one = t.embeddings.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return top_k(one, t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), 30).select("chunk_id", "score")


_PATHS = """ch AS (SELECT doc_id AS chunk_id, concat_ws(' > ', CAST(doc_id // 7 AS VARCHAR), CASE WHEN doc_id % 3 > 0 THEN lang END, CASE WHEN doc_id % 3 > 1 THEN source END) AS p FROM documents)"""


def chunk_paths(t: Tables) -> DataFrame:
    """Seven documents in a row are the passages of one regulation: of its root, of a section by language, of a part by source."""
    k = F.col("doc_id") % 3
    path = F.concat_ws(" > ", F.floor(F.col("doc_id") / 7).cast("string"), F.when(k > 0, F.col("lang")), F.when(k > 1, F.col("source")))
    return t.documents.select(F.col("doc_id").alias("chunk_id"), path.alias("hierarchy_path"))


@add(f"""WITH {_PATHS}, s AS (SELECT chunk_id AS src, p, string_split(p, ' > ') AS a FROM ch), e AS (SELECT DISTINCT p FROM ch),
n AS (SELECT src, coalesce((SELECT p FROM e WHERE len(a) > 2 AND e.p = a[1] || ' > ' || a[2]), (SELECT p FROM e WHERE len(a) > 1 AND e.p = a[1])) AS up FROM s)
SELECT src, chunk_id AS dst FROM n JOIN ch ON ch.p = n.up""")
def kg2_parent_edges(t: Tables) -> DataFrame:
    return G.parent_edges(chunk_paths(t))


@add(f"""WITH {_PATHS}, s AS (SELECT chunk_id, p, string_split(p, ' > ') AS a FROM ch), e AS (SELECT p, min(chunk_id) AS class_id, count(*) AS n_links FROM ch GROUP BY 1),
n AS (SELECT chunk_id, coalesce((SELECT p FROM e WHERE len(a) > 2 AND e.p = a[1] || ' > ' || a[2]), (SELECT p FROM e WHERE len(a) > 1 AND e.p = a[1])) AS up FROM s)
SELECT chunk_id, up AS parent, class_id, CAST(n_links AS BIGINT) AS n_links FROM n JOIN e ON e.p = n.up""")
def kg2_parent_classes(t: Tables) -> DataFrame:
    """The same edges by the path that they lead to: a row a passage."""
    return G.parent_classes(chunk_paths(t))


@add(f"WITH {_PATHS} SELECT chunk_id, min(chunk_id) OVER w AS class_id, CAST(count(*) OVER w - 1 AS BIGINT) AS n_links FROM ch WINDOW w AS (PARTITION BY p)")
def kg3_sibling_edges(t: Tables) -> DataFrame:
    """Passages with the class of their path and their number of siblings: every edge, without n^2 rows of a path."""
    return G.sibling_classes(chunk_paths(t))


@add("""WITH r AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey)) AS refs FROM lineitem GROUP BY 1), p AS (SELECT id AS src, id + 1 AS dst FROM r)
SELECT src, dst, CAST(len(list_intersect(a.refs, b.refs)) AS INTEGER) AS shared, round(len(list_intersect(a.refs, b.refs)) / greatest(len(list_distinct(list_concat(a.refs, b.refs))), 1), 6) AS jaccard
FROM p JOIN r a ON a.id = src JOIN r b ON b.id = dst WHERE len(list_intersect(a.refs, b.refs)) > 0""")
def kg4_shared_references(t: Tables) -> DataFrame:
    refs = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("refs"))
    return G.shared_reference_gate(refs.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), refs)


_SETS = "r AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey))) AS refs FROM lineitem GROUP BY 1), c AS (SELECT refs, min(id) AS class_id FROM r GROUP BY 1)"


def _sets(t: Tables) -> DataFrame:
    """Orders as passages, their parts as references."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("refs"))


@add(f"""WITH {_SETS}, i AS (SELECT class_id, len(refs) AS size, unnest(refs) AS ref FROM c), s AS (SELECT a.class_id AS src, b.class_id AS dst, any_value(a.size + b.size) AS sizes, count(*) AS shared FROM i a JOIN i b ON a.ref = b.ref AND a.class_id < b.class_id GROUP BY 1, 2)
SELECT src, dst, CAST(shared AS INTEGER) AS shared, round(shared / (sizes - shared), 6) AS jaccard FROM s WHERE shared / (sizes - shared) >= 0.15""")
def kg4_similar_references(t: Tables) -> DataFrame:
    """All pairs at the gate, between classes of equal references."""
    return G.similar_sets(_sets(t), 0.15)


@add(f"WITH {_SETS} SELECT id, class_id FROM r JOIN c USING (refs)")
def kg4_reference_classes(t: Tables) -> DataFrame:
    return G.members(_sets(t))


@add(f"""WITH {_PATHS}, e AS (SELECT a.chunk_id AS src, b.chunk_id AS dst, 'sibling' AS kind FROM ch a JOIN ch b ON a.p = b.p AND a.chunk_id < b.chunk_id)
SELECT kind, CAST(count(*) AS BIGINT) AS proposed, CAST(count(*) FILTER (src % 2 = 1) AS BIGINT) AS added FROM e GROUP BY 1""")
def kg5_edge_persistence(t: Tables) -> DataFrame:
    """Edges that exist aren't written again: how many are proposed and how many are new. Those of even sources exist."""
    links = G.links_by_source(chunk_paths(t)).where("n > 0")
    added = F.sum(F.when(F.col("chunk_id") % 2 == 1, F.col("n")).otherwise(0))
    return links.groupBy(F.lit("sibling").alias("kind")).agg(F.sum("n").alias("proposed"), added.alias("added"))


@add(f"""WITH {_POOL}, t10 AS (SELECT query_id, chunk_id, score FROM pool WHERE rank <= 10), e AS (SELECT a.doc_id AS src, b.doc_id AS dst, 0.5 AS weight FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 20),
g AS (SELECT query_id, dst AS chunk_id, round(max(score * 0.7 * weight), 9) AS score FROM t10 JOIN e ON e.src = t10.chunk_id GROUP BY ALL)
SELECT query_id, chunk_id, score, 'pool' AS source FROM t10 UNION ALL SELECT query_id, chunk_id, score, 'graph' FROM g ANTI JOIN t10 ON g.query_id = t10.query_id AND g.chunk_id = t10.chunk_id""")
def kg6_one_hop(t: Tables) -> DataFrame:
    """Also J10. Edges: from each document to the next one of its source."""
    ids = t.documents.select("doc_id")
    edges = ids.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 20).alias("dst"), F.lit(0.5).alias("weight")).join(ids.withColumnRenamed("doc_id", "dst"), "dst", "left_semi")
    return G.expand(pool_of(t).where("rank <= 10"), edges)
