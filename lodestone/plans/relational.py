"""Relational queries of a content dashboard over the given tables: scans, filters, joins, aggregates, paging.

Stand-ins: documents are passages of regulations (source) with a region (lang); orders are courses, customers their
owners, lineitem slides, events jobs and audit entries, part the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lodestone.functions import text as X
from lodestone.operators import quality as Q, relational as R
from lodestone.plans.registry import Registry, Tables

registry = Registry()
add = registry.add
AS_OF = "1996-01-01"


@add("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def io1_scan_by_key(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def io3_json_source(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@add("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN CAST(len(l) AS BIGINT) ELSE -1 END AS n, CASE WHEN doc_id % 6 < 4 THEN l[1] END AS head FROM l""")
def io4_reply_parse(t: Tables) -> DataFrame:
    """Lines of texts as replies of six shapes: bare, under a key, fenced, under a later key than one without a list, without a list, cut off."""
    items = F.to_json(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("title"))))
    under = lambda before, after: F.concat(F.lit(before), items, F.lit(after))
    shapes = F.array(
        items, under('{"slides": ', "}"), under("```json\n", "\n```"), under('{"result": {"n": 1}, "data": ', "}"), F.lit('{"result": {"n": 1}}'), under('{"slides": ', ""),
    )
    found = t.documents.select("doc_id", X.reply_items(shapes[(F.col("doc_id") % 6).cast("int")]).alias("found"))
    n = F.when(F.col("found").isNotNull(), F.size("found").cast("bigint")).otherwise(-1)
    return found.select("doc_id", n.alias("n"), F.try_variant_get(F.get("found", F.lit(0)), "$.title", "string").alias("head"))


@add("""WITH existing AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1),
proposed AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT p.l_orderkey, p.l_partkey FROM proposed p ANTI JOIN existing e ON p.l_orderkey = e.l_orderkey AND p.l_partkey = e.l_partkey""")
def io9_idempotent_upsert(t: Tables) -> DataFrame:
    items = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    return R.new_rows(items, items.where("l_linenumber = 1"), ["l_orderkey", "l_partkey"], [F.col("l_linenumber")]).select("l_orderkey", "l_partkey")


@add("""SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'H' ELSE o_orderstatus END AS status FROM orders""")
def io11_bulk_update(t: Tables) -> DataFrame:
    held = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("held"))
    return t.orders.join(held, "o_custkey", "left").select("o_orderkey", F.when(F.col("held"), "H").otherwise(F.col("o_orderstatus")).alias("status"))


@add("""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, source || ', ' || lang) AS label FROM documents""")
def io12_conditional_backfill(t: Tables) -> DataFrame:
    labelled = t.documents.select("doc_id", "source", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("label"))
    return R.backfilled(labelled, "label", F.concat_ws(", ", "source", "lang")).select("doc_id", "label")


@add("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'pptx,pdf' WHEN o_totalprice > 200000 THEN 'pptx,audio' ELSE 'pptx' END AS outputs FROM orders""")
def io13_backfill_by_predicate(t: Tables) -> DataFrame:
    outputs = F.when(F.col("o_orderstatus") == "F", "pptx,pdf").when(F.col("o_totalprice") > 200000, "pptx,audio").otherwise("pptx")
    return t.orders.select("o_orderkey", outputs.alias("outputs"))


@add("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'archived' ELSE o_orderstatus END AS status FROM orders")
def io14_soft_delete(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_orderdate") < F.lit(AS_OF).cast("timestamp_ntz"), "archived").otherwise(F.col("o_orderstatus")).alias("status"))


@add("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT 'orders' AS name, CAST(count(*) AS BIGINT) AS left_rows FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)""")
def io15_hard_delete(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    orders = R.without(t.orders, gone, ["o_orderkey"])
    items = R.without(t.lineitem, gone.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"])
    counted = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("left_rows"))
    return counted(orders, "orders").unionByName(counted(items, "lineitem"))


@add("SELECT event_id, user_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def pf1_currency_filter(t: Tables) -> DataFrame:
    flagged = t.events.withColumn("is_current", F.from_json("props", "k BIGINT")["k"] % 2 == 0)
    return R.current(flagged).select("event_id", "user_id", "event_type")


@add("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE (CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate AS DATE) END) IS NULL OR (CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_shipdate AS DATE) END) > DATE '1996-01-01'""")
def pf2_temporal_validity(t: Tables) -> DataFrame:
    until = t.lineitem.withColumn("until", F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate")))
    return R.valid_at(until, "until", AS_OF).select("l_orderkey", "l_linenumber", "l_partkey")


@add("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr') OR lang IS NOT DISTINCT FROM 'de'")
def pf3_region_visibility(t: Tables) -> DataFrame:
    return R.visible_in(t.documents.select("doc_id", "lang"), "de", "lang", ("en", "fr"))


@add("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def pf4_in_list(t: Tables) -> DataFrame:
    return R.one_of(t.documents.select("doc_id", "source"), "doc_id", t.labels.where("toxic = 1"), "doc_id")


@add("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pf5_missing_keys(t: Tables) -> DataFrame:
    return R.missing_keys(t.documents, t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id")


@add("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def pf5_resolved(t: Tables) -> DataFrame:
    """Labelled documents; a label of an unknown document fails the job."""
    return R.resolved(t.labels, t.documents.select("doc_id", "source", "n_chars"), "doc_id")


@add("SELECT p_partkey, p_name, p_brand FROM part WHERE p_size > 10 AND (contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an'))")
def pf6_dynamic_filters(t: Tables) -> DataFrame:
    return R.optional_filters(t.part.where("p_size > 10"), {"p_type": None}, "AN", ("p_name", "p_brand")).select("p_partkey", "p_name", "p_brand")


@add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 11")
def pf7_ownership_filter(t: Tables) -> DataFrame:
    return R.optional_filters(t.orders, {"o_custkey": 11}).select("o_orderkey", "o_custkey")


@add("SELECT vec_id, label FROM embeddings WHERE nullif(label, 3) IS NULL OR nullif(label, 3) <> 5")
def pf8_null_aware_exclusion(t: Tables) -> DataFrame:
    section = F.nullif(F.col("label"), F.lit(3))
    return t.embeddings.where(section.isNull() | (section != 5)).select("vec_id", "label")


@add("""SELECT doc_id, source FROM documents WHERE NOT (source = 'src0' AND regexp_matches(text, '(?i)licensed|the mit')) AND NOT (source = 'src1' AND regexp_matches(text, '(?i)all rights'))""")
def pf9_text_drop_lists(t: Tables) -> DataFrame:
    rules = [("src0", "(?iu)licensed|the mit", True), ("src1", "(?iu)all rights", True), ("src2", "(?iu).", False)]
    return R.drop_lists(t.documents.select("doc_id", "source", "text"), "source", "text", rules).select("doc_id", "source")


@add("SELECT event_id, value FROM events WHERE value IS NOT NULL AND value <> 0 AND value > 50")
def pf10_relevance_filter(t: Tables) -> DataFrame:
    return t.events.where((F.col("value") != 0) & (F.col("value") > 50)).select("event_id", "value")


@add("""SELECT p_partkey, contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ed') AS found FROM part WHERE p_type <> 'X' AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ed')""")
def pf13_search_on_concatenation(t: Tables) -> DataFrame:
    found = F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("ed"))
    return t.part.where((F.col("p_type") != "X") & found).select("p_partkey", found.alias("found"))


@add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (contains(lower(o_orderpriority), 'urg') OR contains(lower(o_orderstatus), 'urg'))")
def pf14_multi_select_filters(t: Tables) -> DataFrame:
    found = R.optional_filters(t.orders, {}, "urg", ("o_orderpriority", "o_orderstatus"), o_orderstatus=["F", "O"], o_orderpriority=["1-URGENT", "2-HIGH"])
    return found.select("o_orderkey", "o_orderstatus")


@add("""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CAST(len(string_split(text, chr(10))) - 1 AS BIGINT) AS n FROM documents)
SELECT doc_id, concat_ws(';', CASE WHEN trim(title) = '' THEN 'empty title' END, CASE WHEN length(title) > 70 THEN 'long title' END, CASE WHEN n = 0 OR n > 8 THEN 'body lines' END) AS messages FROM d""")
def pf15_content_audit(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    title, n = lines[0], F.size(lines) - 1
    messages = F.array(F.when(F.trim(title) == "", "empty title"), F.when(F.length(title) > 70, "long title"), F.when((n == 0) | (n > 8), "body lines"))
    return t.documents.select("doc_id", F.array_join(F.array_compact(messages), ";").alias("messages"))


@add("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j1_chunks_with_regulations(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@add("SELECT l_orderkey, l_linenumber, p_partkey, p_retailprice > 1000 AS approved FROM lineitem JOIN part ON l_partkey = p_partkey")
def j2_links_with_catalog(t: Tables) -> DataFrame:
    links = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return links.join(t.part.select("p_partkey", "p_retailprice"), "p_partkey").select("l_orderkey", "l_linenumber", "p_partkey", (F.col("p_retailprice") > 1000).alias("approved"))


@add("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def j3_jobs_with_owners(t: Tables) -> DataFrame:
    owners = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.join(owners, "o_custkey").select("o_orderkey", "c_name")


@add("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j4_count_per_slug(t: Tables) -> DataFrame:
    return R.count_per(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n")


@add("""WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents), f AS (SELECT hash, min(doc_id) AS owner FROM h GROUP BY hash)
SELECT h.doc_id, f.owner FROM h JOIN f ON h.hash = f.hash WHERE h.doc_id <> f.owner""")
def j5_dedup_alias(t: Tables) -> DataFrame:
    """Documents whose text another one with a smaller id has, and that one."""
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    return hashed.join(hashed.groupBy("hash").agg(F.min("doc_id").alias("owner")), "hash").where("doc_id <> owner").select("doc_id", "owner")


@add("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON l_orderkey = o.o_orderkey")
def j6_semi_join(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").join(urgent, "l_orderkey", "left_semi")


@add("SELECT p_partkey, (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_partkey = p_partkey) AS n FROM part")
def j7_correlated_count(t: Tables) -> DataFrame:
    return R.count_per(t.part.select("p_partkey"), t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "n")


@add("""WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey, p_name, pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, l_partkey) AS k FROM f JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, substr(string_agg(p_name, '; ' ORDER BY k), 1, 200) AS label FROM r WHERE k <= 3 GROUP BY l_orderkey""")
def j8_labels_of_ids(t: Tables) -> DataFrame:
    """Ids of a slide become its first three distinct labels, in order."""
    first = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("at"))
    named = first.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    ranked = R.top_per(named, ["l_orderkey"], [F.col("at"), F.col("l_partkey")], 3, "k")
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p_name"))), lambda x: x["p_name"]), "; ")
    return ranked.groupBy("l_orderkey").agg(F.substring(label, 1, 200).alias("label"))


@add("SELECT substr(p_brand, 1, 7) AS prefix, min(p_name) AS label FROM part GROUP BY 1")
def j9_prefix_match(t: Tables) -> DataFrame:
    return t.part.groupBy(F.substring("p_brand", 1, 7).alias("prefix")).agg(F.min("p_name").alias("label"))


@add("""WITH d AS (SELECT source AS art, lang AS par, min(doc_id) AS id FROM documents GROUP BY ALL), a AS (SELECT source AS art, min(doc_id) AS id FROM documents GROUP BY source)
SELECT q.doc_id, coalesce(d.id, a.id) AS target FROM (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'xx' END AS par FROM documents) q
LEFT JOIN d ON d.art = q.source AND d.par = q.par LEFT JOIN a ON a.art = q.source""")
def j11_reference_resolution(t: Tables) -> DataFrame:
    """(article, paragraph) resolves to its first passage, else to the article's."""
    docs = t.documents.select("doc_id", "source", "lang")
    asked = docs.select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("xx").alias("lang"))
    exact = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("exact"))
    article = docs.groupBy("source").agg(F.min("doc_id").alias("article"))
    return asked.join(exact, ["source", "lang"], "left").join(article, "source", "left").select("doc_id", F.coalesce("exact", "article").alias("target"))


@add("""SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 5""")
def j12_array_containment(t: Tables) -> DataFrame:
    held = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return held.where(F.array_contains("parts", 5)).select("l_orderkey")


@add("SELECT n_nationkey, r_regionkey, CAST(abs(length(n_name) - length(r_name)) AS BIGINT) AS distance FROM nation CROSS JOIN region")
def j13_cross_with_modules(t: Tables) -> DataFrame:
    """Every passage against every module; the modules are a fixed handful, so they are broadcast."""
    pairs = t.nation.join(F.broadcast(t.region))
    return pairs.select("n_nationkey", "r_regionkey", F.abs(F.length("n_name") - F.length("r_name")).cast("bigint").alias("distance"))


@add("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'), s AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
w AS (SELECT l_orderkey, min(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, coalesce(s.q, w.q) AS q FROM l LEFT JOIN s USING (l_orderkey, l_linenumber) LEFT JOIN w USING (l_orderkey)""")
def j14_composite_key_with_fallback(t: Tables) -> DataFrame:
    slots = t.lineitem.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber").distinct()
    tracks = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_quantity")
    exact = tracks.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("exact"))
    whole = tracks.groupBy("l_orderkey").agg(F.min("l_quantity").alias("whole"))
    return slots.join(exact, ["l_orderkey", "l_linenumber"], "left").join(whole, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("exact", "whole").alias("q"))


@add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j15_positions_without_visual(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@add("SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 5)")
def j16_pending_minus_applied(t: Tables) -> DataFrame:
    return R.missing_keys(t.part, t.part.where("p_size < 5"), "p_brand")


@add("SELECT l_linenumber, max(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_linenumber")
def j17_last_row_wins(t: Tables) -> DataFrame:
    return R.top_per(t.lineitem.select("l_linenumber", "l_orderkey"), ["l_linenumber"], [F.desc("l_orderkey")])


@add("SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def a1_count_by_status(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@add("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS dirty, CAST(count(DISTINCT o_custkey) AS BIGINT) AS owners FROM orders")
def a2_global_counts(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("dirty"), F.countDistinct("o_custkey").alias("owners"))


@add("SELECT coalesce(sum(l_quantity) FILTER (l_linestatus IN ('O')), 0) AS hours FROM lineitem")
def a3_sum_of_states(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.coalesce(F.sum(F.when(F.col("l_linestatus").isin("O"), F.col("l_quantity"))), F.lit(0.0)).alias("hours"))


@add("""SELECT o_orderpriority AS target, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS approved, CAST(count(*) FILTER (o_orderstatus <> 'F') AS BIGINT) AS pending FROM orders GROUP BY 1 ORDER BY 1""")
def a4_filtered_counts(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return t.orders.groupBy(F.col("o_orderpriority").alias("target")).agg(F.count("*").alias("total"), F.count_if(done).alias("approved"), F.count_if(~done).alias("pending")).orderBy("target")


@add("""SELECT CAST(count(*) AS BIGINT) AS runs, round(coalesce(avg(value), 0), 2) AS avg_elapsed, CAST(coalesce(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)), 0) AS BIGINT) AS images
FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def a5_metrics_of_days(t: Tables) -> DataFrame:
    recent = t.events.where((F.col("event_type") == "purchase") & (F.col("ts") > F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL 7 DAY")))
    images = F.coalesce(F.from_json("props", "k BIGINT")["k"], F.lit(0))
    return recent.agg(F.count("*").alias("runs"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 2).alias("avg_elapsed"), F.coalesce(F.sum(images), F.lit(0)).alias("images"))


@add("SELECT CAST(count(*) FILTER (event_type IN ('click', 'view', 'search', 'cart')) AS BIGINT) AS depth FROM events")
def a6_queue_depth(t: Tables) -> DataFrame:
    return t.events.agg(F.count_if(F.col("event_type").isin("click", "view", "search", "cart")).alias("depth"))


@add("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def a7_distinct(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").select("l_orderkey").distinct()


@add("""SELECT m AS word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+) of', 1)) AS m FROM documents) GROUP BY m""")
def a8_regex_frequency(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+) of"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@add("SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def a9_chips(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@add("""SELECT 'lang' AS facet, lang AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, CAST(count(*) AS BIGINT) FROM documents GROUP BY source""")
def a10_facets(t: Tables) -> DataFrame:
    """Counts of each facet by one pass over grouping sets."""
    facets = t.documents.select("lang", "source")
    counted = facets.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"))
    return counted.select(F.when(F.col("g") == 0, "lang").otherwise("source").alias("facet"), F.when(F.col("g") == 0, F.col("lang")).otherwise(F.col("source")).alias("value"), "n")


@add("""WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY pos, l_partkey) AS refs, CAST(count(*) AS BIGINT) AS n_refs FROM f GROUP BY l_orderkey""")
def a12_fingerprint(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("at"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    return first.groupBy("l_orderkey").agg(F.array_join(in_order, ",").alias("refs"), F.count("*").alias("n_refs"))


@add("""SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def a13_first_module_wins(t: Tables) -> DataFrame:
    return R.top_per(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


@add("SELECT l_orderkey, string_agg(DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 8, '0'), ',' ORDER BY lpad(CAST(l_suppkey AS VARCHAR), 8, '0')) AS ids FROM lineitem GROUP BY l_orderkey")
def a14_sorted_union(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.lpad(F.col("l_suppkey").cast("string"), 8, "0"))), ",").alias("ids"))


@add("""WITH c AS (SELECT source, lang, CAST(count(*) AS BIGINT) AS votes FROM documents WHERE lang IS NOT NULL AND lang <> 'es' GROUP BY ALL),
r AS (SELECT *, sum(votes) OVER (PARTITION BY source) AS observed, row_number() OVER (PARTITION BY source ORDER BY votes DESC, lang) AS k FROM c)
SELECT source, lang, votes, CAST(observed AS BIGINT) AS observed, round(votes / observed, 6) AS ratio FROM r WHERE k = 1""")
def a15_majority_vote(t: Tables) -> DataFrame:
    return R.majority(t.documents.select("source", "lang"), ["source"], "lang", ["es"]).withColumn("ratio", F.round("ratio", 6)).select("source", "lang", "votes", "observed", "ratio")


@add("SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) < 8 AS thin FROM events")
def a16_thin_groups(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", (F.count("*").over(Window.partitionBy("user_id")) < 8).alias("thin"))


@add("SELECT l_returnflag AS severity, l_linestatus AS kind, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def a17_issue_summary(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("severity"), F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n"))


@add("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT c_nationkey, CASE WHEN coalesce(n, 0) >= 15 THEN 0 WHEN coalesce(n, 0) >= 5 THEN 1 ELSE 2 END AS rank FROM customer LEFT JOIN n ON o_custkey = c_custkey)
SELECT n_nationkey, CASE coalesce(max(rank), 2) WHEN 0 THEN 'ok' WHEN 1 THEN 'thin' ELSE 'no_coverage' END AS label FROM nation LEFT JOIN s ON c_nationkey = n_nationkey GROUP BY 1""")
def a18_worst_case(t: Tables) -> DataFrame:
    counted = R.count_per(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), t.orders.select("o_custkey"), "o_custkey", "n")
    ranked = counted.withColumn("rank", F.when(F.col("n") >= 15, 0).when(F.col("n") >= 5, 1).otherwise(2))
    worst = t.nation.select("n_nationkey").join(ranked, "n_nationkey", "left").groupBy("n_nationkey").agg(F.coalesce(F.max("rank"), F.lit(2)).alias("rank"))
    return worst.select("n_nationkey", F.when(F.col("rank") == 0, "ok").when(F.col("rank") == 1, "thin").otherwise("no_coverage").alias("label"))


@add("SELECT l_orderkey, max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS severity FROM lineitem GROUP BY 1")
def a19_max_severity(t: Tables) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return t.lineitem.groupBy("l_orderkey").agg(F.max(rank).alias("severity"))


@add("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS slides, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS images, CAST(count(*) FILTER (l_quantity < 10) AS BIGINT) AS quizzes, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS modules FROM lineitem GROUP BY 1""")
def a20_generation_report(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("slides"), F.count_if(F.col("l_returnflag") == "R").alias("images"), F.count_if(F.col("l_quantity") < 10).alias("quizzes"), F.countDistinct("l_suppkey").alias("modules")
    )


@add("""WITH m AS (SELECT l_suppkey, l_partkey % 26 AS module, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT l_suppkey, count(*) AS modules, count(*) FILTER (n < 21) AS degraded FROM m GROUP BY 1)
SELECT l_suppkey, modules, degraded, CASE WHEN CAST(degraded AS DOUBLE) / modules > 0.30 THEN 'partial' ELSE 'completed' END AS status FROM g""")
def a21_quality_gate(t: Tables) -> DataFrame:
    """Suppliers as courses, of modules of about 23 lines; 27 are expected of each."""
    return Q.course_gate(t.lineitem.select("l_suppkey", (F.col("l_partkey") % 26).alias("module")), "l_suppkey", "module")


@add("SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS reason, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def a23_reason_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy(F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high").alias("reason")).agg(F.count("*").alias("n"))


@add("""WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), c AS (SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM f WHERE k <= 20 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM c) SELECT user_id, event_type, n FROM r WHERE rank <= 2""")
def a24_top_tags(t: Tables) -> DataFrame:
    first = R.top_per(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")], 20)
    counted = first.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.top_per(counted, ["user_id"], [F.desc("n"), F.col("event_type")], 2)


@add("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS tracks, CAST(count(*) FILTER (l_quantity NOT BETWEEN 35 AND 55) AS BIGINT) AS off_target FROM lineitem GROUP BY 1")
def a25_audio_manifest(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("tracks"), F.count_if(~F.col("l_quantity").between(35, 55)).alias("off_target"))


@add("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS m FROM events)
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, max(value) FILTER (k = m // 2 + 1) AS p50, max(value) FILTER (k = m * 95 // 100 + 1) AS p95 FROM r GROUP BY 1""")
def a26_phase_telemetry(t: Tables) -> DataFrame:
    """Percentiles by index, ranked in ranges: a type may hold any share of the events."""
    ranked = R.numbered_in_ranges(t.events.select("event_type", "value", "event_id"), ["event_type"], [F.col("value"), F.col("event_id")], "k", "m")
    at = lambda p: F.max(F.when(F.col("k") == F.floor(F.col("m") * p / 100) + 1, F.col("value")))
    return ranked.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), at(50).alias("p50"), at(95).alias("p95"),
    )


@add("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events")
def w1_rank(t: Tables) -> DataFrame:
    """A type may hold any share of the events, so ranks are drawn in ranges."""
    ranked = R.numbered_in_ranges(t.events.select("event_type", "value", "event_id"), ["event_type"], [F.desc("value"), F.col("event_id")], "rank")
    return ranked.select("event_id", F.col("rank").cast("int").alias("rank"))


@add("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def w2_first_match(t: Tables) -> DataFrame:
    return R.top_per(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@add("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx FROM events")
def w3_renumber(t: Tables) -> DataFrame:
    return R.renumbered(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "idx").select("event_id", "idx")


@add("""WITH b AS (SELECT user_id, event_id AS id, 1 AS place, ts FROM events UNION ALL SELECT DISTINCT user_id, -1, 0, NULL FROM events UNION ALL SELECT DISTINCT user_id, -2, 2, NULL FROM events)
SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY place, ts, id) - 1 AS INTEGER) AS idx FROM b""")
def w4_bookends(t: Tables) -> DataFrame:
    inner = t.events.select("user_id", F.col("event_id").alias("id"), F.lit(1).alias("place"), "ts")
    end = lambda id_, place: t.events.select("user_id").distinct().select("user_id", F.lit(id_).cast("bigint").alias("id"), F.lit(place).alias("place"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    both = inner.unionByName(end(-1, 0)).unionByName(end(-2, 2))
    return R.renumbered(both, ["user_id"], [F.col("place"), F.col("ts"), F.col("id")], "idx").select("user_id", "id", "idx")


@add("""WITH c AS (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(CASE WHEN k > 1 AND prev IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM c""")
def w6_islands(t: Tables) -> DataFrame:
    return R.islands(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "island")


@add("""WITH s AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS score FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS k, lead(score, 1) OVER w AS s2, lead(score, 2) OVER w AS s3 FROM s WINDOW w AS (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey))
SELECT l_partkey, l_suppkey AS winner, score, s2 AS second, s3 AS third, score - s2 AS margin FROM r WHERE k = 1""")
def w7_winner_and_margin(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_partkey").orderBy(F.desc("score"), "l_suppkey")
    scored = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("score"))
    ranked = scored.withColumns({"k": F.row_number().over(w), "second": F.lead("score", 1).over(w), "third": F.lead("score", 2).over(w)})
    return ranked.where("k = 1").select("l_partkey", F.col("l_suppkey").alias("winner"), "score", "second", "third", (F.col("score") - F.col("second")).alias("margin"))


@add("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id, event_type) AS BIGINT) AS n FROM events QUALIFY n >= 3")
def w8_duplicate_counts(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.count("*").over(Window.partitionBy("user_id", "event_type")).alias("n")).where("n >= 3")


@add("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value AS p25 FROM r WHERE k = n // 4 + 1""")
def w9_quantile_by_index(t: Tables) -> DataFrame:
    return R.quantile_in_ranges(t.events, ["event_type"], "value", "event_id", 0.25, "p25")


@add("SELECT event_id, value >= 0.30 * max(value) OVER (PARTITION BY event_type) AS kept FROM events")
def w10_relative_threshold(t: Tables) -> DataFrame:
    """The best of each type is aggregated and joined back: no window holds a type."""
    best = t.events.groupBy("event_type").agg(F.max("value").alias("best")).withColumnRenamed("event_type", "kind")
    events = t.events.select("event_id", "event_type", "value")
    return events.join(best, events["event_type"].eqNullSafe(best["kind"])).select("event_id", (F.col("value") >= 0.30 * F.col("best")).alias("kept"))


@add("""WITH u AS (SELECT l_partkey, count(*) AS used FROM lineitem GROUP BY 1), c AS (SELECT p_partkey, p_brand, p_retailprice FROM part LEFT JOIN u ON p_partkey = l_partkey WHERE coalesce(used, 0) < 30)
SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM c) WHERE k = 1""")
def w11_reuse_budget(t: Tables) -> DataFrame:
    """The first candidate of each query that isn't used up."""
    counted = R.count_per(t.part.select("p_partkey", "p_brand", "p_retailprice"), t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "used")
    return R.top_per(counted.where("used < 30"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey")


@add("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, turn, role, text FROM r WHERE k <= 3""")
def w12_last_messages(t: Tables) -> DataFrame:
    said = t.conversations.where(F.col("role").isin("user", "assistant"))
    return R.top_per(said, ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")], 3).orderBy("conv_id", "turn").select("conv_id", "turn", "role", "text")


@add("""WITH r AS (SELECT event_id, user_id, event_type, lead(event_id) OVER w AS below, lag(event_id) OVER w AS above, row_number() OVER w AS k, lead(event_type) OVER w AS nt, lag(event_type) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(CASE WHEN k = 2 AND below IS NOT NULL AND event_type <> 'purchase' AND nt <> 'purchase' THEN 3 WHEN k = 3 AND event_type <> 'purchase' AND pt <> 'purchase' THEN 2 ELSE k END AS INTEGER) AS place FROM r""")
def w13_adjacent_swap(t: Tables) -> DataFrame:
    """Second and third change places, unless one of them is of a protected type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    free = lambda c: c != "purchase"
    k, kind = F.row_number().over(w), F.col("event_type")
    place = F.when((k == 2) & F.lead("event_id").over(w).isNotNull() & free(kind) & free(F.lead("event_type").over(w)), 3).when((k == 3) & free(kind) & free(F.lag("event_type").over(w)), 2).otherwise(k)
    return t.events.select("event_id", place.cast("int").alias("place"))


@add("""WITH n AS (SELECT source, count(*) AS total FROM documents GROUP BY 1) SELECT source, CAST(i AS INTEGER) AS module, CAST(total // 4 + CASE WHEN i < total % 4 THEN 1 ELSE 0 END AS BIGINT) AS slides FROM n CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)""")
def w14_remainder(t: Tables) -> DataFrame:
    total = t.documents.groupBy("source").agg(F.count("*").alias("total")).withColumn("module", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return total.select("source", "module", (F.floor(F.col("total") / 4) + F.when(F.col("module") < F.col("total") % 4, 1).otherwise(0)).alias("slides"))


@add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def t1_page(t: Tables) -> DataFrame:
    return R.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)


@add("SELECT CAST(count(*) AS BIGINT) AS total FROM orders WHERE o_orderstatus = 'O'")
def t2_total_beside_page(t: Tables) -> DataFrame:
    return R.optional_filters(t.orders, {"o_orderstatus": "O"}).agg(F.count("*").alias("total"))


@add("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def t3_latest_five(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5)


@add("SELECT * FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10) ORDER BY ts, event_id")
def t4_newest_in_order(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).orderBy("ts", "event_id")


@add("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey LIMIT 25")
def t6_custom_rank(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return t.orders.select("o_orderkey", "o_orderpriority").orderBy(rank, "o_orderkey").limit(25)


@add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events ORDER BY k DESC, event_id LIMIT 15")
def t7_sort_on_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k")).orderBy(F.desc("k"), "event_id").limit(15)


@add("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY 1, 2, 3 LIMIT 30")
def t8_module_then_index(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(30)


@add("SELECT user_id, max(ts) AS seen FROM events GROUP BY 1 ORDER BY seen, user_id LIMIT 10")
def t9_least_recent(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("ts").alias("seen")).orderBy("seen", "user_id").limit(10)


@add("""WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS a, list_sort(list_distinct(list(l_partkey))) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS common, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INTEGER) AS only_left, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS together FROM s""")
def set_operations(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a"), F.collect_set("l_partkey").alias("b"))
    return sets.select("l_orderkey", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_except("a", "b")).alias("only_left"), F.size(F.array_union("a", "b")).alias("together"))


@add("""SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(grouping(o_orderpriority) AS INTEGER) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def extension_rollup(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderpriority").cast("int").alias("g"))


@add("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, CASE WHEN b.c IS NULL THEN 'removed' ELSE 'added' END AS change FROM (SELECT o_custkey, 1 AS d FROM a) a FULL JOIN (SELECT o_custkey, 1 AS c FROM b) b USING (o_custkey) WHERE a.d IS NULL OR b.c IS NULL""")
def extension_snapshot_diff(t: Tables) -> DataFrame:
    owners = lambda s: t.orders.where(F.col("o_orderstatus") == s).select("o_custkey", F.lit(1).alias("one")).distinct()
    return R.snapshot_diff(owners("F"), owners("O"), ["o_custkey"], ["one"])
