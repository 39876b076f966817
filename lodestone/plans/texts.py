"""Queries of the text, number and JSON functions, of citations and of chunking, over texts from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import embedding as M, text as X
from lodestone.operators import chunking as C, graph as G
from lodestone.plans.registry import Registry, Tables

registry = Registry()
add = registry.add


def citing(t: Tables) -> DataFrame:
    """(id, text): sentences that cite decrees, with numbers and dates of the orders."""
    n, y = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy")
    d, m = F.date_format("o_orderdate", "d"), F.date_format("o_orderdate", "M")
    month = F.array(*map(F.lit, X.MONTHS))[F.month("o_orderdate") - 1]
    forms = [
        F.concat(F.lit("Attua il Decreto ministeriale "), d, F.lit(" "), month, F.lit(" "), y, F.lit(" e il D.Lgs "), n, F.lit("/"), y),
        F.concat(F.lit("D.M. "), d, F.lit("/"), m, F.lit("/"), y, F.lit("; D.M. 388/2003")), F.concat(F.lit("D.Lgs. "), n, F.lit("/"), F.substring(y, 3, 2), F.lit(" art. 46")),
        F.concat(F.lit("Reg. CE "), n, F.lit("/"), y, F.lit(", Regolamento (UE) n. "), n, F.lit("/"), y), F.concat(F.lit("Accordo Stato-Regioni "), y, F.lit("; D.P.R. 151/"), y),
        F.concat(F.lit("D.Lgs "), d, F.lit(" "), month, F.lit(" "), y, F.lit(", n. "), n), F.concat(F.lit("Stanza "), n, F.lit(" con vista panoramica")),
    ]
    pick: Column = F.when(F.lit(False), F.lit(""))
    for k, form in enumerate(forms):
        pick = pick.when(F.col("o_orderkey") % len(forms) == k, form)
    return t.orders.select(F.col("o_orderkey").alias("id"), pick.alias("text"))


_MONTH_SQL = "[" + ", ".join(f"'{m}'" for m in X.MONTHS) + "][month(o_orderdate)]"
_CITED = f"""c AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, CAST(o_orderkey AS VARCHAR) AS n, strftime(o_orderdate, '%Y') AS y, CAST(day(o_orderdate) AS VARCHAR) AS d, CAST(month(o_orderdate) AS VARCHAR) AS m, {_MONTH_SQL} AS mm FROM orders)"""


@add(f"""WITH {_CITED} SELECT id, CASE k WHEN 0 THEN 'dm_' || lpad(d, 2, '0') || '_' || lpad(m, 2, '0') || '_' || y || ',dlgs_' || n || '_' || y[3:4]
WHEN 1 THEN 'dm_' || lpad(d, 2, '0') || '_' || lpad(m, 2, '0') || '_' || y || ',dm_388_2003' WHEN 2 THEN 'dlgs_' || n || '_' || y[3:4] WHEN 3 THEN 'reg_ce_' || n || '_' || y || ',reg_ue_' || n || '_' || y
WHEN 4 THEN 'accordo_stato_regioni_' || y || ',dpr_151_' || y WHEN 5 THEN 'dlgs_' || n || '_' || y[3:4] ELSE '' END AS slugs FROM c""")
def q4_citations(t: Tables) -> DataFrame:
    return citing(t).select("id", F.array_join(X.citation_slugs(F.col("text")), ",").alias("slugs"))


@add(f"""WITH {_CITED}, s AS (SELECT id, CASE k WHEN 0 THEN ['dm_' || lpad(d, 2, '0') || '_' || lpad(m, 2, '0') || '_' || y, 'dlgs_' || n || '_' || y[3:4]]
WHEN 1 THEN ['dm_' || lpad(d, 2, '0') || '_' || lpad(m, 2, '0') || '_' || y, 'dm_388_2003'] WHEN 2 THEN ['dlgs_' || n || '_' || y[3:4]] WHEN 3 THEN ['reg_ce_' || n || '_' || y, 'reg_ue_' || n || '_' || y]
WHEN 4 THEN ['accordo_stato_regioni_' || y, 'dpr_151_' || y] WHEN 5 THEN ['dlgs_' || n || '_' || y[3:4]] ELSE [] END AS s FROM c)
SELECT id, array_to_string(list_filter(s, lambda x: x NOT IN ('dm_388_2003', 'dpr_151_1995', 'accordo_stato_regioni_1996')), ',') AS outside FROM s WHERE len(list_filter(s, lambda x: x NOT IN ('dm_388_2003', 'dpr_151_1995', 'accordo_stato_regioni_1996'))) > 0""")
def q5_citations_out_of_scope(t: Tables) -> DataFrame:
    allowed = F.array(*map(F.lit, ("dm_388_2003", "dpr_151_1995", "accordo_stato_regioni_1996")))
    outside = F.array_except(X.citation_slugs(F.col("text")), allowed)
    return citing(t).select("id", outside.alias("o")).where(F.size("o") > 0).select("id", F.array_join("o", ",").alias("outside"))


@add("""SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS words, array_to_string(regexp_extract_all(lower(text), '\\S+')[1:5], ' ') AS fingerprint,
CASE WHEN len(regexp_extract_all(text, '\\S+')) > 12 THEN array_to_string(regexp_extract_all(text, '\\S+')[1:12], ' ') || '…' ELSE text END AS short FROM documents""")
def s1_words_and_fingerprints(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", X.word_count(text).alias("words"), X.title_fingerprint(text).alias("fingerprint"), X.truncated(text, 12).alias("short"))


@add(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text || chr(10) || ' — ' || doc_id || ' — fine', '\s+', ' ', 'g'), 'Gazzetta Ufficiale.*?Serie.*?\d+', '', 'g'), '— \d+ —', '', 'g')) AS form FROM documents""")
def s2_covered_form(t: Tables) -> DataFrame:
    text = F.concat("text", F.lit("\n — "), F.col("doc_id").cast("string"), F.lit(" — fine"))
    return t.documents.select("doc_id", X.covered_form(text).alias("form"))


@add("""SELECT o_orderkey, CASE WHEN y <= 49 THEN '20' ELSE '19' END || lpad(CAST(y AS VARCHAR), 2, '0') AS year4, lpad(CAST(y AS VARCHAR), 2, '0') AS year2 FROM (SELECT o_orderkey, o_orderkey % 100 AS y FROM orders)""")
def s3_years(t: Tables) -> DataFrame:
    year = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    return t.orders.select("o_orderkey", X.year4(year).alias("year4"), X.year2(X.year4(year)).alias("year2"))


@add(r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\S+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'der', 'que')) AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END AS query FROM w""")
def s4_simplified_query(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.simplified_query(F.col("text"), ["the", "and", "der", "que"]).alias("query"))


@add("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'D.Lgs. ' || o_orderkey || '/08, art. 3, c. 4' WHEN 1 THEN 'Reg. CE ' || o_orderkey || '/2004, Allegato II' WHEN 2 THEN 'D.M. 03/08/2015, art. 7-bis'
WHEN 3 THEN 'Titolo ' || o_orderkey ELSE 'Delibera regionale ' || o_orderkey END AS label FROM orders""")
def s5_citation_labels(t: Tables) -> DataFrame:
    k, n = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    title = F.when(k == 0, F.concat(F.lit("Decreto Legislativo "), n, F.lit("/2008 sulla sicurezza"))).when(k == 1, F.concat(F.lit("Regolamento (CE) n. "), n, F.lit("/2004"))).when(k == 2, "Decreto del Ministro 3 agosto 2015").otherwise(F.concat(F.lit("Delibera regionale "), n))
    article = F.when(k == 0, "Art. 3").when(k == 1, "Allegato II").when(k == 2, "art. 7-bis")
    path = F.when(k == 3, F.concat(F.lit("Titolo "), n))
    return t.orders.select("o_orderkey", X.citation_label(X.short_title(title), article, F.when(k == 0, "Comma 4"), path).alias("label"))


@add("""WITH a AS (SELECT o_orderkey, o_orderkey % 330 AS n FROM orders) SELECT o_orderkey, CASE WHEN n = 0 THEN 'Sconosciuto' WHEN n <= 61 THEN 'Titolo I' WHEN n <= 68 THEN 'Titolo II' WHEN n <= 87 THEN 'Titolo III' WHEN n <= 160 THEN 'Titolo IV'
WHEN n <= 166 THEN 'Titolo V' WHEN n <= 171 THEN 'Titolo VI' WHEN n <= 179 THEN 'Titolo VII' WHEN n <= 220 THEN 'Titolo VIII' WHEN n <= 265 THEN 'Titolo IX' WHEN n <= 286 THEN 'Titolo X' WHEN n <= 297 THEN 'Titolo XI'
WHEN n <= 303 THEN 'Titolo XII' WHEN n <= 306 THEN 'Titolo XIII' ELSE 'external_reference' END AS section FROM a""")
def s6_top_sections(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.top_section(F.lit("dlgs_81_08"), F.concat(F.lit("Art. "), (F.col("o_orderkey") % 330).cast("string"))).alias("section"))


_VALUE = r"""(?:"[^"]*"|''[^'']*''|[^\s"''>]+)"""
_REMOTE = r"""(?:xlink:)?href\s*=\s*(?:"\s*(?:javascript:|https?:|//)[^"]*"|''\s*(?:javascript:|https?:|//)[^'']*''|(?:javascript:|https?:|//)[^\s"''>]*)"""
_BARE_TAG = "x"
for _attribute in (rf"on\w+\s*=\s*{_VALUE}", _REMOTE):
    _BARE_TAG = rf"""regexp_replace(regexp_replace({_BARE_TAG}, '[\s/]+{_attribute}', '', 'gi'), '(["'']){_attribute}', '\1', 'gi')"""


@add(rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', '', 'gis'), '<foreignObject\b.*?</foreignObject\s*>', '', 'gis') AS h FROM pages)
SELECT page_id, array_to_string(list_transform(regexp_extract_all(h, '<(?:"[^"]*"|''[^'']*''|[^''">])*>|<|[^<]+'), lambda x: CASE WHEN x LIKE '<%' THEN {_BARE_TAG} ELSE x END), '') AS svg FROM b""")
def s7_clean_svg(t: Tables) -> DataFrame:
    """Whole pages, whose scripts, handlers and links a drawing may not hold."""
    return t.pages.select("page_id", X.clean_svg(F.col("html")).alias("svg"))


@add(r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 2)) AS INTEGER) AS bm25,
CAST(len(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND x NOT IN ('the', 'and')))) AS INTEGER) AS thematic FROM documents""")
def s8_tokenizers(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", F.size(X.bm25_tokens(text)).alias("bm25"), F.size(X.thematic_tokens(text, ["the", "and"], {"zzz": ["yyy"]})).alias("thematic"))


@add("SELECT doc_id, sha256(text) AS hash FROM documents")
def s9_content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@add("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity BETWEEN s - greatest(10.0, 0.25 * s) AND s + greatest(10.0, 0.25 * s) AS on_target, CAST(greatest(3, least(15, floor(12000 / (1.6 * l_quantity * 4 + 120)))) AS INTEGER) AS batch,
CAST(least(150, floor(35 + 8 * l_quantity)) AS INTEGER) AS top_k, CAST(round_even(l_quantity * 0.55, 0) AS BIGINT) AS share, CASE WHEN q <= z THEN CAST(q AS VARCHAR) ELSE repeat(z || ',', q // z - 1) || CASE WHEN q % z BETWEEN 1 AND 2 THEN CAST(z + q % z AS VARCHAR) ELSE z || CASE WHEN q % z = 0 THEN '' ELSE ',' || q % z END END END AS split FROM (SELECT *, l_discount * 500.0 AS s, CAST(l_quantity AS INTEGER) AS q, CAST(3 + l_partkey % 13 AS INTEGER) AS z FROM lineitem)""")
def s10_numbers(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    low, high = X.duration_window(F.col("l_discount") * 500.0)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", q.between(low, high).alias("on_target"), X.batch_size(q * 4).alias("batch"),
        F.least(F.lit(150), F.floor(35 + 8 * q)).cast("int").alias("top_k"), F.bround(q * 0.55, 0).cast("bigint").alias("share"),
        F.array_join(X.batch_split(q.cast("int"), (3 + F.col("l_partkey") % 13).cast("int")), ",").alias("split"),
    )


@add("""WITH s AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(greatest(16, coalesce(list_min(list_transform(list_filter(q, lambda n: n > 30), lambda n: CAST(floor(28 * 30 / n) AS INTEGER))), 28)) AS INTEGER) AS font FROM s""")
def s11_uniform_font(t: Tables) -> DataFrame:
    slots = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("int")).alias("q"))
    return slots.select("l_orderkey", X.font_size(F.col("q"), F.lit(30), F.lit(28)).alias("font"))


@add("""WITH s AS (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey) AS v, max(length(p_name)) AS longest FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), f AS (SELECT *, greatest(16, CASE WHEN longest > 5 THEN floor(28 * 5 / longest) ELSE 28 END) AS font FROM s)
SELECT l_orderkey, array_to_string(list_transform(v, lambda x: CASE WHEN font = 16 AND length(x) > floor(5 * 28 / font) THEN rtrim(substring(x, 1, CAST(greatest(1, floor(5 * 28 / font) - 1) AS BIGINT)), ' ') || '…' ELSE x END), '|') AS slots FROM f""")
def s11_fitted_slots(t: Tables) -> DataFrame:
    """Names of an order's parts as the slots of a diagram of five characters each."""
    named = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("v"))
    return named.select("l_orderkey", F.array_join(X.fitted_slots(F.transform("v", lambda x: x["p_name"]), F.lit(5), F.lit(28)), "|").alias("slots"))


@add("""SELECT vec_id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), lambda x: x[1] * x[2])), 6) AS norm2, CAST(len(embedding) AS INTEGER) AS size FROM embeddings""")
def s12_vector_codec(t: Tables) -> DataFrame:
    """Vectors as text and back."""
    back = X.vector_of(F.to_json(F.transform("embedding", lambda x: x.cast("double"))))
    return t.embeddings.select("vec_id", F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"), F.size(back).alias("size"))


@add("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' || event_id || ';b' WHEN 2 THEN 'c;d' ELSE '' END AS ids FROM events""")
def s13_id_lists(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 1, F.concat(F.lit('["a'), F.col("event_id").cast("string"), F.lit('", "b"]'))).when(k == 2, " c, d ,").when(k == 3, " ")
    return t.events.select("event_id", F.array_join(X.id_list(raw), ";").alias("ids"))


@add("""WITH s AS (SELECT doc_id, least((CAST(regexp_matches(lower(text), 'the of') AS INTEGER) + CAST(regexp_matches(lower(text), 'and.*the') AS INTEGER)) / 2.0, 1.0) AS a, least((CAST(regexp_matches(lower(text), 'der die') AS INTEGER) + CAST(regexp_matches(lower(text), 'und') AS INTEGER)) / 2.0, 1.0) AS b FROM documents)
SELECT doc_id, CASE WHEN greatest(a, b) < 0.5 THEN NULL WHEN a >= b THEN 'flow' ELSE 'tree' END AS template FROM s""")
def s16_template_routing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.routed_template(F.col("text"), {"flow": ["the of", "and.*the"], "tree": ["der die", "und"]}).alias("template"))


@add("SELECT o_orderkey, 'Verifica ' || o_orderkey || CASE WHEN o_orderkey % 3 = 2 THEN ' come da piano' ELSE '' END AS label FROM orders")
def s17_norm_suffix(t: Tables) -> DataFrame:
    n = F.col("o_orderkey").cast("string")
    tail = F.when(F.col("o_orderkey") % 3 == 0, " secondo D.Lgs. 81/08 Art. 225").when(F.col("o_orderkey") % 3 == 1, ", ai sensi della legge").otherwise(" come da piano")
    return t.orders.select("o_orderkey", X.without_norm_suffix(F.concat(F.lit("Verifica "), n, tail)).alias("label"))


@add("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)sanzion|ammend|arrest|multa|pena') THEN 'SANZIONE' ELSE 'GENERALE' END AS kind FROM documents""")
def s14_penalty_class(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.penalty_class(F.lit("SANZIONE"), F.col("text")).alias("kind"))


@add(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, trim(body) AS body, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM p WHERE length(trim(body)) > 50),
l AS (SELECT *, lag(body) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM k)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN prev IS NOT NULL AND len(string_split(prev, '.')) > 1 THEN trim(string_split(prev, '.')[-2]) || '. ' || body ELSE body END AS body FROM l""")
def c2_paragraph_chunks(t: Tables) -> DataFrame:
    return C.paragraph_chunks(t.documents.select("doc_id", "text"), "doc_id", "text", separator="\n")


@add(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM documents), k AS (SELECT doc_id, trim(body) AS body FROM p WHERE length(trim(body)) > 50),
h AS (SELECT doc_id, body[1:100] AS head, row_number() OVER (PARTITION BY doc_id ORDER BY body) AS k FROM k), f AS (SELECT DISTINCT doc_id, head FROM h WHERE k = 1)
SELECT doc_id, body FROM k ANTI JOIN f ON k.doc_id = f.doc_id AND k.body[1:100] = f.head""")
def c3_residual(t: Tables) -> DataFrame:
    """Paragraphs that none of the chunks begins with; the chunk here is each document's first paragraph in order of text."""
    from lodestone.operators.relational import top_per

    paragraphs = C.paragraphs(t.documents.select("doc_id", "text"), "doc_id", "text", "\n").select("doc_id", "body")
    return C.residual(paragraphs, top_per(paragraphs, ["doc_id"], [F.col("body")]), "doc_id")


@add("""WITH h AS (SELECT doc_id, source, sha256(text) AS hash FROM documents), cur AS (SELECT DISTINCT hash FROM h WHERE source = 'src0'), n AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS k FROM h WHERE source <> 'src0')
SELECT n.doc_id, n.hash FROM n ANTI JOIN cur ON n.hash = cur.hash WHERE k = 1""")
def c5_content_dedup(t: Tables) -> DataFrame:
    """Of a batch, the bodies that aren't current yet, each once; the current ones are source src0's."""
    hashed = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return C.new_bodies(hashed.where("source <> 'src0'"), hashed.where("source = 'src0'"), "hash", "doc_id").select("doc_id", "hash")


@add("""WITH h AS (SELECT doc_id, source, sha256(text) AS hash FROM documents), o AS (SELECT hash, min(source) AS owner FROM h GROUP BY 1), j AS (SELECT h.source, h.hash, owner FROM h JOIN o ON h.hash = o.hash)
SELECT source, CAST(count(*) FILTER (owner = source) AS BIGINT) AS inserted, CAST(count(*) FILTER (owner <> source) AS BIGINT) AS deduped, min(owner) FILTER (owner <> source) AS alias_of FROM j GROUP BY 1""")
def c6_duplicate_documents(t: Tables) -> DataFrame:
    hashed = t.documents.select("source", F.sha2("text", 256).alias("hash"))
    owned = hashed.join(hashed.groupBy("hash").agg(F.min("source").alias("owner")), "hash")
    own = F.col("owner") == F.col("source")
    return owned.groupBy("source").agg(F.count_if(own).alias("inserted"), F.count_if(~own).alias("deduped"), F.min(F.when(~own, F.col("owner"))).alias("alias_of"))


@add(r"""WITH v AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(10) || 'Art.') WHEN 1 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS text FROM documents),
c AS (SELECT *, list_filter(string_split(text, chr(10) || 'Art.'), lambda x: trim(x) <> '') AS a, list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> '') AS b, greatest(1, length(text) // 3) AS size FROM v),
p AS (SELECT doc_id, text, CASE WHEN len(a) >= 3 THEN a WHEN len(b) >= 3 THEN b ELSE list_transform(range(0, length(text), size), lambda i: substr(text, i + 1, size)) END AS parts FROM c),
e AS (SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i FROM p), k AS (SELECT doc_id, text, unnest([0, 1, 2]) AS batch FROM p)
SELECT k.doc_id, CAST(batch AS INTEGER) AS batch, coalesce(CASE WHEN contains(k.text, 'Art.') THEN string_agg(part, E'\n\nArt.' ORDER BY i) ELSE string_agg(part, E'\n\n' ORDER BY i) END, '') AS body
FROM k LEFT JOIN e ON e.doc_id = k.doc_id AND i % 3 = batch GROUP BY k.doc_id, batch, k.text""")
def c7_cyclic_partition(t: Tables) -> DataFrame:
    """Texts with articles, with blank lines and with neither, in turn."""
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.replace("text", F.lit("\n"), F.lit("\nArt."))).when(k == 1, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    return C.cyclic_batches(t.documents.select("doc_id", text.alias("text")), "doc_id", "text", 3)


@add()
def c1_structured_chunks(t: Tables) -> DataFrame:
    return C.structured_chunks(articles(t), "id", "text")


@add()
def c4_hybrid_chunks(t: Tables) -> DataFrame:
    return C.hybrid_chunks(articles(t), "id", "text")


@add()
def a22_coverage_ratio(t: Tables) -> DataFrame:
    """Normalized characters of a document's chunks against those of the document."""
    docs = articles(t)
    covered = C.coverage(docs, "id", "text", C.structured_chunks(docs, "id", "text"))
    return covered.select("id", F.round("coverage", 6).alias("coverage"))


@add()
def kg1_reference_extraction(t: Tables) -> DataFrame:
    return C.references(C.structured_chunks(articles(t), "id", "text"), "body")


@add()
def kg1_reference_edges(t: Tables) -> DataFrame:
    """References between the passages of each regulation; none leads to itself."""
    chunks = C.structured_chunks(articles(t), "id", "text").withColumn("chunk_id", F.concat_ws("/", F.col("id").cast("string"), "hierarchy_path"))
    passages = chunks.select("chunk_id", F.col("id").alias("regulation_id"), "article", F.regexp_replace("paragraph", "^Comma ", "").alias("paragraph"))
    found = C.references(chunks.select(F.col("chunk_id").alias("src"), F.col("id").alias("regulation_id"), "body"), "body")
    return G.reference_edges(found, passages)


@add()
def s15_ssml(t: Tables) -> DataFrame:
    text = F.concat(F.substring("text", 1, 1 << 30), F.lit(" (PAUSE 3s) & <b> (PAUSE 40s)"))
    return t.documents.select("doc_id", C.ssml(text).alias("ssml"), F.regexp_count(text, F.lit(r"\(PAUSE \d+s\)")).alias("pauses"))


def articles(t: Tables) -> DataFrame:
    """(id, text): a regulation for each page host's worth of documents of one source, its lines as articles and commas."""
    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("Art. "), (i + 1).cast("string"), F.lit(". 1. "), x, F.lit(" 2. come art. 1, comma 2."))).otherwise(F.concat(F.lit("Allegato II - "), x))), "\n\n")
    return t.documents.select(F.col("doc_id").alias("id"), body.alias("text"))


@add("""SELECT doc_id, sha256(text) AS content_hash, array_to_string(list_transform(range(97, 123), lambda c: CAST(length(lower(text)) - length(replace(lower(text), chr(CAST(c AS INTEGER)), '')) AS VARCHAR)), ',') AS counts FROM documents""")
def io7_embedded_texts(t: Tables) -> DataFrame:
    """Vectors of all documents, by a stand-in model in batches; equal texts are embedded once."""
    found, _ = M.embedded(t.documents.select("doc_id", "text"), "letters", M.letters_model)
    counts = F.transform("embedding", lambda x: x.cast("bigint").cast("string"))
    return found.select("doc_id", "content_hash", F.array_join(counts, ",").alias("counts"))
