"""Queries of pacing, allocation, quality and editing: orders are courses, lineitem slides, l_suppkey % 4 the module."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.operators import allocation as A, editing as E, quality as Q, relational as R
from lodestone.operators.vector import top_k
from lodestone.plans.registry import Registry, Tables

registry = Registry()
add = registry.add

TYPES = ("CONTENT_TEXT", "CONTENT_IMAGE", "QUIZ", "DIAGRAM", "CASE_STUDY", "MODULE_OPEN", "RECAP")


def slides(t: Tables) -> DataFrame:
    """Slides: course, module, idx (its place in the course), kind, title, quantity, price."""
    kind = F.array(*map(F.lit, TYPES))[(F.col("l_partkey") % len(TYPES)).cast("int")]
    rows = t.lineitem.select(F.col("l_orderkey").alias("course"), (F.col("l_suppkey") % 4).cast("int").alias("module"), "l_partkey", "l_linenumber", "l_quantity", kind.alias("kind"))
    return R.renumbered(rows, ["course"], [F.col(c) for c in ("module", "l_linenumber", "l_partkey", "l_quantity")], "idx")


_KIND = "[" + ", ".join(f"'{x}'" for x in TYPES) + "]"
_SLIDES = f"""sl AS (SELECT *, CAST(row_number() OVER (PARTITION BY course ORDER BY module, l_linenumber, l_partkey, l_quantity) - 1 AS INTEGER) AS idx FROM
(SELECT l_orderkey AS course, CAST(l_suppkey % 4 AS INTEGER) AS module, l_partkey, l_linenumber, l_quantity, {_KIND}[l_partkey % {len(TYPES)} + 1] AS kind FROM lineitem))"""


@add("""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 8 + 1 AS h, CASE o_orderstatus WHEN 'F' THEN 0.8 WHEN 'O' THEN 1.0 ELSE 1.25 END AS f, CASE WHEN o_orderkey % 2 = 0 THEN 45.0 ELSE 90.0 END AS s FROM orders),
p AS (SELECT id, CAST(floor(h * 3600 / s * f) AS INTEGER) AS total, CASE WHEN id % 3 = 0 THEN 4 ELSE NULL END AS t FROM c), n AS (SELECT *, coalesce(t, greatest(2, CAST(ceil(total / 27) AS INTEGER))) AS n FROM p),
m AS (SELECT *, unnest(range(n)) AS i FROM n), k AS (SELECT *, total // n + CASE WHEN i < total % n THEN 1 ELSE 0 END AS c FROM m)
SELECT id, CAST(i AS INTEGER) AS module_index, CAST(c + 2 AS INTEGER) AS slide_count, CASE WHEN t IS NULL THEN 'Modulo ' || (i + 1) ELSE 'Tema ' || (i + 1) END AS title, CAST(greatest(1, round_even(c * 0.55, 0)) AS INTEGER) AS texts,
CAST(c - greatest(1, round_even(c * 0.55, 0)) - greatest(1, round_even(c * 0.25, 0)) - greatest(1, round_even(c * 0.10, 0)) - greatest(1, round_even(c * 0.05, 0)) - greatest(1, round_even(c * 0.03, 0)) AS INTEGER) AS recaps FROM k""")
def al1_pacing(t: Tables) -> DataFrame:
    density = F.when(F.col("o_orderstatus") == "F", "leggera").when(F.col("o_orderstatus") == "O", "standard").otherwise("intensiva")
    titles = F.when(F.col("o_orderkey") % 3 == 0, F.array(*(F.lit(f"Tema {k}") for k in range(1, 5))))
    courses = t.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 8 + 1).cast("double").alias("hours"), density.alias("density"),
        F.when(F.col("o_orderkey") % 2 == 0, 45.0).otherwise(90.0).alias("seconds"), titles.alias("titles"), F.lit(None).cast("map<int,int>").alias("chunks"),
    )
    split = F.col("slide_distribution")
    return A.pacing(courses).select("id", "module_index", "slide_count", "title", split["CONTENT_TEXT"].alias("texts"), split["RECAP"].alias("recaps"))


_WORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"
_BARE = r"list_distinct(string_split_regex(lower({}), '\s+'))"
_THEMES = f"""d AS (SELECT doc_id, {_WORDS.format("array_to_string([lang, source], ' ')")} AS tags, {_WORDS.format("source")} AS path, {_WORDS.format("lang || ' ' || doc_id % 7")} AS article, {_WORDS.format("substring(text, 1, 500)")} AS body, {_BARE.format("text")} AS everything FROM documents),
m AS (SELECT item_id, {_WORDS.format("text")} AS q, list_filter({_BARE.format("text")}, lambda x: x <> '') AS b FROM benchmark),
ts AS (SELECT doc_id, item_id, 3.0 * len(list_intersect(tags, q)) + 2.0 * len(list_intersect(path, q)) + len(list_intersect(article, q)) + 0.5 * len(list_intersect(body, q)) AS score, len(list_intersect(everything, b)) AS plain FROM d, m),
tr AS (SELECT *, lead(score) OVER o AS nxt, row_number() OVER o AS k, first_value(item_id) OVER (PARTITION BY doc_id ORDER BY plain DESC, item_id) AS other FROM ts WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, item_id)),
th AS (SELECT doc_id AS chunk_id, CAST(CASE WHEN score = 0 THEN other ELSE item_id END AS BIGINT) AS module_index, CAST(score AS DOUBLE) AS score, CAST(score - coalesce(nxt, 0) AS DOUBLE) AS margin, score - coalesce(nxt, 0) >= 0.08 AS pinned, CASE WHEN score = 0 THEN 'overlap' ELSE 'theme' END AS rule FROM tr WHERE k = 1)"""


def _themed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents as passages with tags, path and article; benchmark texts as titles of modules."""
    article = F.concat_ws(" ", "lang", (F.col("doc_id") % 7).cast("string"))
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.array("lang", "source").alias("tags"), F.col("source").alias("path"), article.alias("article"), F.col("text").alias("body"))
    return chunks, t.benchmark.select(F.col("item_id").alias("module_index"), F.col("text").alias("title"))


@add(f"WITH {_THEMES} FROM th")
def al2_thematic_assignment(t: Tables) -> DataFrame:
    """Every document to one of all benchmark texts."""
    return A.assign_thematically(*_themed(t))


@add(f"""WITH {_THEMES}, s AS (SELECT a.vec_id AS chunk_id, b.vec_id AS module_index, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 9) AS score FROM embeddings a JOIN documents ON a.vec_id = doc_id JOIN embeddings b ON b.vec_id IN (SELECT item_id FROM benchmark)),
r AS (SELECT *, lead(score) OVER o AS nxt, row_number() OVER o AS k FROM s WINDOW o AS (PARTITION BY chunk_id ORDER BY score DESC, module_index))
SELECT chunk_id, module_index, score, round(score - nxt, 9) AS margin, round(score - nxt, 9) >= 0.08 AS pinned, 'cosine' AS rule FROM r WHERE k = 1 UNION ALL FROM th WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings)""")
def al3_cosine_assignment(t: Tables) -> DataFrame:
    """Every document to the module whose vector is nearest; those without a vector by theme."""
    chunks, modules = _themed(t)
    vectors = t.embeddings.select(F.col("vec_id").alias("module_index"), "embedding").join(modules.select("module_index"), "module_index", "left_semi")
    known = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding").join(chunks.select("chunk_id"), "chunk_id", "left_semi").repartition(F.xxhash64("chunk_id"))
    return A.assign_by_cosine(chunks, modules, top_k(known, vectors, 2, "chunk_id", "module_index").drop("rank"))


def _candidates(t: Tables) -> DataFrame:
    """Parts as passages that compete for the modules of a supplier's course: course_id, module_index, chunk_id, score."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("course_id"), (F.col("l_linenumber") % 4).cast("int").alias("module_index"), F.col("l_partkey").alias("chunk_id")).agg(F.max("l_quantity").alias("score"))


_CANDIDATES = "cand AS (SELECT l_suppkey AS course_id, CAST(l_linenumber % 4 AS INTEGER) AS module_index, l_partkey AS chunk_id, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2, 3)"


def _pass(name: str, begin: str, short: int, full: int, steps: int = 200) -> str:
    """A step a row: the passage of the least margin that a full module may give goes to the emptiest short one."""
    sizes = "list_transform([0, 1, 2, 3], lambda m: len(list_filter(homes, lambda h: h.m = m)))"
    free = f"list_filter(homes, lambda h: NOT h.pinned AND sizes[h.m + 1] > {full})[1]"
    to = f"list_sort(list_transform(list_filter([0, 1, 2, 3], lambda m: sizes[m + 1] < {short}), lambda m: {{'n': sizes[m + 1], 'm': m}}))[1].m"
    step = f"SELECT course_id, k, homes, {free} AS f, {to} AS t FROM (SELECT *, {sizes} AS sizes FROM {name}) WHERE k < {steps}"
    moved = "list_transform(homes, lambda h: CASE WHEN h.c = f.c THEN {'margin': h.margin, 'c': h.c, 'm': CAST(t AS INTEGER), 'pinned': h.pinned} ELSE h END)"
    return f"{name} AS (SELECT course_id, 0 AS k, homes FROM {begin} UNION ALL SELECT course_id, k + 1, {moved} FROM ({step}) WHERE f IS NOT NULL AND t IS NOT NULL)"


@add(f"""WITH RECURSIVE {_CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY course_id, chunk_id ORDER BY module_index) AS k FROM cand),
b AS (SELECT course_id, list_sort(list({{'margin': score / 50, 'c': chunk_id, 'm': module_index, 'pinned': score >= 45}})) AS homes FROM o WHERE k = 1 GROUP BY 1),
{_pass("p", "b", 30, 32)}, q AS (SELECT course_id, arg_max(homes, k) AS homes FROM p GROUP BY 1), {_pass("r", "q", 150, 150)}, z AS (SELECT course_id, unnest(arg_max(homes, k)) AS h FROM r GROUP BY 1)
SELECT course_id, h.c AS chunk_id, h.m AS module_index FROM z""")
def al4_rebalanced(t: Tables) -> DataFrame:
    w = _candidates(t).select("course_id", "module_index", "chunk_id", (F.col("score") / 50).alias("margin"), (F.col("score") >= 45).alias("pinned"))
    once = R.top_per(w, ["course_id", "chunk_id"], [F.col("module_index")]).withColumn("all_modules", F.sequence(F.lit(0), F.lit(3)))
    return A.rebalance(once, 30, 150)


def _pins(m: int) -> str:
    gone = "".join(f" AND (course_id, chunk_id) NOT IN (SELECT (course_id, chunk_id) FROM p{k})" for k in range(m))
    return f"p{m} AS (SELECT course_id, chunk_id, module_index FROM cand WHERE module_index = {m}{gone} QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY score DESC, chunk_id) <= {A.QUOTA})"


@add(f"""WITH {_CANDIDATES}, {", ".join(map(_pins, range(4)))}, p AS ({" UNION ALL ".join(f"FROM p{m}" for m in range(4))}),
b AS (SELECT course_id, chunk_id, module_index FROM cand QUALIFY row_number() OVER (PARTITION BY course_id, chunk_id ORDER BY score DESC, module_index) = 1)
SELECT cand.* FROM cand JOIN b USING (course_id, chunk_id) LEFT JOIN p USING (course_id, chunk_id) WHERE cand.module_index = coalesce(p.module_index, b.module_index)""")
def r14_quota_dedup(t: Tables) -> DataFrame:
    return A.quota_dedup(_candidates(t))


@add("""WITH RECURSIVE t AS (SELECT source, doc_id, greatest(1, length(text) // 4 + 1) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT source, doc_id, k, size AS held, 1 AS n, 0 AS batch FROM t WHERE k = 1
UNION ALL SELECT source, doc_id, k, CASE WHEN fits THEN held + size ELSE size END, CASE WHEN fits THEN n + 1 ELSE 1 END, CASE WHEN fits THEN batch ELSE batch + 1 END
FROM (SELECT t.source, t.doc_id, t.k, t.size, held, n, batch, held + t.size <= 20000 AND n < 50 AS fits FROM r JOIN t ON t.source = r.source AND t.k = r.k + 1))
SELECT source, doc_id, CAST(batch AS INTEGER) AS batch FROM r""")
def io7_greedy_batches(t: Tables) -> DataFrame:
    return A.greedy_batches(t.documents, "source", "doc_id", "text", 20_000, 50)


@add("""WITH RECURSIVE c AS (SELECT l_suppkey AS course_id, l_orderkey AS slot, l_partkey % 50 AS image, min(l_quantity) AS rank FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT course_id, slot, list(image ORDER BY rank, image) AS images, row_number() OVER (PARTITION BY course_id ORDER BY slot) AS k FROM c GROUP BY 1, 2),
r AS (SELECT course_id, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS image, 0 AS k, CAST([] AS BIGINT[]) AS used FROM s WHERE k = 1
UNION ALL SELECT course_id, slot, image, k, CASE WHEN image IS NULL THEN used ELSE list_append(used, image) END FROM (SELECT s.course_id, s.slot, s.k, r.used, list_filter(s.images, lambda i: len(list_filter(r.used, lambda u: u = i)) < 3)[1] AS image
FROM r JOIN s ON s.course_id = r.course_id AND s.k = r.k + 1)) SELECT course_id, slot, image FROM r WHERE image IS NOT NULL""")
def w11_sequential_reuse(t: Tables) -> DataFrame:
    """Slots of a supplier's course choose among parts; none is used more than three times."""
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("course_id"), F.col("l_orderkey").alias("slot"), (F.col("l_partkey") % 50).alias("image")).agg(F.min("l_quantity").alias("rank"))
    return A.capped_choice(rows, 3)


@add("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(l_quantity * 0.5, 0) AS INTEGER) AS texts, CASE WHEN l_suppkey % 4 = 0 THEN 3 ELSE 0 END AS quizzes, CASE WHEN l_suppkey % 4 = 3 THEN 2 ELSE 0 END AS cases FROM lineitem""")
def al5_voice_share(t: Tables) -> DataFrame:
    texts, quizzes, cases = A.voice_share(F.col("l_quantity"), F.lit(0.5), F.col("l_suppkey") % 4, F.lit(4), F.lit(3), F.lit(2))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", texts.alias("texts"), quizzes.alias("quizzes"), cases.alias("cases"))


@add("""WITH s AS (SELECT l_orderkey, p_name, min(l_linenumber * 1000000 + l_partkey) AS pos FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS k FROM s)
SELECT l_orderkey, string_agg(p_name, ';' ORDER BY k) || repeat(';…', 5 - CAST(count(*) AS INTEGER)) AS points FROM r WHERE k <= 5 GROUP BY 1""")
def al6_module_bookends(t: Tables) -> DataFrame:
    named = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select("l_orderkey", "p_name", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"))
    return A.key_points(named, ["l_orderkey"], [F.col("pos")], "p_name").select("l_orderkey", F.array_join("points", ";").alias("points"))


def _limit(column: int) -> str:
    return "CASE kind " + " ".join(f"WHEN '{r[0]}' THEN {r[column]}" for r in Q.LIMITS) + " END"


def _lacking(t: Tables) -> DataFrame:
    """Slides that lack now this, now that."""
    k, i = F.col("l_partkey"), F.col("idx")
    image = F.struct(
        F.when(k % 5 == 1, "none").when(k % 5 == 2, "diagram").otherwise("search").alias("strategy"), F.when(k % 4 == 1, "wide").when(k % 4 == 2, "square").alias("aspect_hint"),
        F.when(k % 5 == 2, F.when(k % 2 == 0, '<svg viewBox="0 0 1 1"><g/></svg>').otherwise("<?xml?><svg><g/></svg>")).alias("diagram_code"),
    )
    return slides(t).select(
        "course", "idx", F.col("kind").alias("slide_type"), F.when(k % 3 > 0, F.col("module")).alias("module_index"), F.when(k % 5 > 0, image).alias("image"), F.when(k % 7 > 2, (k % 7).cast("int") - 2).alias("quiz_correct"),
        F.trim(F.repeat(F.lit("p "), (F.col("l_quantity") * 3).cast("int"))).alias("notes"), F.when(i % 2 == 0, F.concat(F.lit("D.Lgs. "), k.cast("string"))).alias("normative_ref"),
        F.when(k % 2 == 0, F.array(F.lit("una"))).alias("bullets"), F.lit(None).cast("array<string>").alias("sezioni"), F.col("module").alias("at_hand"),
    )


@add(f"""WITH {_SLIDES}, s AS (SELECT course, idx, module, kind, l_partkey AS k, CAST(round_even(l_quantity * 3, 0) AS INTEGER) AS n, idx % 2 = 0 AS referred, {_limit(5)} AS least FROM sl), p AS (SELECT *, CASE WHEN referred AND n < least THEN least_pads END AS pads FROM (SELECT *, CAST(least(5, ceil((least - n) / 14.0)) AS INTEGER) AS least_pads FROM s))
SELECT course, idx, module AS module_index, CASE k % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'none' WHEN 2 THEN 'diagram' ELSE 'search' END AS strategy,
CASE WHEN k % 5 = 0 THEN NULL WHEN k % 4 = 1 THEN 'landscape' WHEN k % 4 = 2 THEN 'square' WHEN k % 5 > 2 THEN 'landscape' END AS aspect,
CASE WHEN k % 5 = 2 THEN CASE WHEN k % 2 = 0 THEN '<svg viewBox="0 0 1 1"><g/></svg>' WHEN kind = 'DIAGRAM' THEN '<?xml?><svg viewBox="0 0 1760 800"><g/></svg>' ELSE '<?xml?><svg><g/></svg>' END END AS code,
CASE WHEN k % 7 BETWEEN 3 AND 5 THEN CAST(k % 7 - 2 AS VARCHAR) WHEN kind = 'QUIZ' THEN '0' WHEN k % 7 = 6 THEN '4' END AS quiz_correct,
CAST(n + coalesce(pads, 0) * 14 AS INTEGER) AS words, CASE WHEN k % 2 = 0 THEN '1' WHEN kind IN ('TITLE', 'CLOSING', 'QUIZ') THEN '0' END AS bullets,
k % 3 = 0 OR k % 5 = 0 OR (k % 5 > 0 AND (k % 4 = 1 OR (k % 4 IN (0, 3) AND k % 5 > 2))) OR (k % 5 = 2 AND k % 2 = 1 AND kind = 'DIAGRAM') OR (kind = 'QUIZ' AND k % 7 NOT BETWEEN 3 AND 5) OR coalesce(pads > 0, false) OR kind IN ('TITLE', 'CLOSING', 'QUIZ') AS completed FROM p""")
def al7_auto_completion(t: Tables) -> DataFrame:
    found = Q.completed(_lacking(t), Q.limits(t.spark), F.col("at_hand"))
    return found.select(
        "course", "idx", "module_index", "image.strategy", F.col("image.aspect_hint").alias("aspect"), F.col("image.diagram_code").alias("code"), F.col("quiz_correct").cast("string").alias("quiz_correct"),
        F.when(F.col("notes") == "", 0).otherwise(F.size(F.split("notes", r"\s+"))).alias("words"), F.when(F.col("bullets").isNotNull(), F.size("bullets")).cast("string").alias("bullets"), "completed",
    )


@add(f"""WITH {_SLIDES}, f AS (SELECT course, module, idx, kind, row_number() OVER (PARTITION BY course, module ORDER BY idx) AS k FROM sl) SELECT course, module, string_agg(kind, '; ' ORDER BY k) AS recap FROM f WHERE k <= 5 GROUP BY 1, 2""")
def al8_previous_recap(t: Tables) -> DataFrame:
    first = R.top_per(slides(t), ["course", "module"], [F.col("idx")], 5, "k")
    return first.groupBy("course", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "kind"))), lambda x: x["kind"]), "; ").alias("recap"))


@add(f"""WITH {_SLIDES}, x AS (SELECT course, idx, kind, CAST(l_quantity % 7 AS INTEGER) AS n, l_partkey % 100 AS len, l_quantity * 4 AS notes FROM sl)
SELECT course, idx, concat_ws(',', CASE WHEN len > {_limit(1)} THEN 'title' END, CASE WHEN {_limit(3)} = 0 THEN CASE WHEN kind = 'MODULE_OPEN' THEN CASE WHEN n > 1 THEN 'items' END WHEN n > 0 THEN 'items' END WHEN n > {_limit(3)} OR n < {_limit(2)} THEN 'items' END,
CASE WHEN notes > {_limit(6)} THEN 'notes' END, CASE WHEN kind IN ('CONTENT_IMAGE', 'DIAGRAM') AND idx % 2 = 0 THEN 'image' END, CASE WHEN kind = 'QUIZ' AND idx % 3 = 0 THEN 'options' END) AS violations, notes < {_limit(5)} AS notes_low FROM x""")
def pf11_constraint_validation(t: Tables) -> DataFrame:
    """At 45 seconds a slide, where limits keep their base values."""
    return Q.violations(_judged(t), Q.limits(t.spark)).select("course", "idx", F.array_join("violations", ",").alias("violations"), "notes_low")


def _judged(t: Tables) -> DataFrame:
    n, idx = F.col("l_quantity").cast("int") % 7, F.col("idx")
    options = F.when(idx % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(*map(F.lit, "abcd")))
    return slides(t).select(
        "course", "idx", F.col("kind").alias("slide_type"), F.repeat(F.lit("t"), (F.col("l_partkey") % 100).cast("int")).alias("title"),
        F.when(n > 0, F.array_repeat(F.lit("una voce"), n)).otherwise(F.array().cast("array<string>")).alias("items"), F.trim(F.repeat(F.lit("p "), (F.col("l_quantity") * 4).cast("int"))).alias("notes"),
        (idx % 2 != 0).alias("has_image"), options.alias("options"), F.lit(1).alias("correct"),
    )


_NARRATIVE = ", ".join(f"'{r[0]}'" for r in Q.LIMITS if r[9])


@add(f"""WITH {_SLIDES}, l AS (SELECT course, idx, kind, l_quantity * 4 AS notes, CAST(20 + course % 200 AS DOUBLE) AS s, {_limit(5)} AS least, {_limit(6)} AS most FROM sl),
x AS (SELECT *, CASE WHEN kind IN ({_NARRATIVE}) THEN greatest(1, round_even(least * s / 45, 0)) ELSE least END AS notes_min, CASE WHEN kind IN ({_NARRATIVE}) THEN greatest(1, round_even(most * s / 45, 0)) ELSE most END AS notes_max FROM l)
SELECT course, idx, notes > notes_max AS notes_high, notes < notes_min AS notes_low FROM x""")
def pf12_scaled_validation(t: Tables) -> DataFrame:
    """Notes against limits that grow with each course's seconds a slide."""
    found = Q.violations(_judged(t), Q.limits(t.spark), (20 + F.col("course") % 200).cast("double"))
    return found.select("course", "idx", F.array_contains("violations", "notes").alias("notes_high"), "notes_low")


@add("""SELECT o_orderkey, CAST(greatest(1, round_even(90 * s / 45, 0)) AS INTEGER) AS notes_min, CAST(greatest(1, round_even(160 * s / 45, 0)) AS INTEGER) AS notes_max FROM (SELECT o_orderkey, CAST(20 + o_orderkey % 200 AS DOUBLE) AS s FROM orders)""")
def pf12_constraint_scaling(t: Tables) -> DataFrame:
    s = (20 + F.col("o_orderkey") % 200).cast("double")
    return t.orders.select("o_orderkey", *(Q.scaled(F.lit(n), F.lit(True), s).alias(c) for n, c in ((90, "notes_min"), (160, "notes_max"))))


def issues(t: Tables) -> DataFrame:
    rows = slides(t).select(
        "course", "module", "idx", F.col("kind").alias("slide_type"), F.when(F.col("l_partkey") % 3 == 0, "none").when(F.col("l_partkey") % 3 == 1, "branded_fallback").otherwise("search").alias("strategy"),
        (F.col("l_partkey") % 4).alias("n_options"), F.col("l_quantity").alias("notes_words"), F.col("l_partkey").cast("string").alias("image"), F.concat(F.lit("Tema "), F.col("l_linenumber").cast("string")).alias("title"),
    )
    keys = ["course", "idx"]
    parts = [
        Q.slide_issues(rows, keys), Q.underpopulated(rows, "course", "module", "idx", 3), Q.repeated(rows, keys, ["course", "module"], F.col("image"), 2, "image_overused"),
        Q.near_titles(rows, keys, ["course", "module"], "title"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_ISSUES = f"""{_SLIDES}, iss AS (SELECT course, idx, 'image_missing' AS issue, 'high' AS severity FROM sl WHERE kind IN ('CONTENT_IMAGE', 'DIAGRAM') AND l_partkey % 3 = 0
UNION ALL SELECT course, idx, 'diagram_fallback', 'medium' FROM sl WHERE kind = 'DIAGRAM' AND l_partkey % 3 = 1 UNION ALL SELECT course, idx, 'quiz_options', 'high' FROM sl WHERE kind = 'QUIZ' AND l_partkey % 4 < 2
UNION ALL SELECT course, idx, 'notes_short', 'low' FROM sl WHERE l_quantity < 30 UNION ALL SELECT course, min(idx), 'module_underpopulated', 'medium' FROM sl GROUP BY course, module HAVING count(*) < 0.7 * 3
UNION ALL SELECT course, idx, 'image_overused', 'medium' FROM (SELECT *, count(*) OVER (PARTITION BY course, module, l_partkey) AS n FROM sl) WHERE n >= 2
UNION ALL SELECT course, idx, 'title_near_duplicate', 'medium' FROM (SELECT *, count(*) OVER (PARTITION BY course, module, l_linenumber) AS n FROM sl) WHERE n >= 2)"""


@add(f"WITH {_ISSUES} SELECT course, idx, issue, severity FROM iss")
def q1_q2_q3_sensors(t: Tables) -> DataFrame:
    return issues(t).select("course", "idx", "issue", "severity")


@add(f"WITH {_ISSUES} SELECT severity, issue, CAST(count(*) AS BIGINT) AS n FROM iss GROUP BY ALL")
def q6_issue_summary(t: Tables) -> DataFrame:
    return Q.summary(issues(t))


@add("""WITH n AS (SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n FROM part) SELECT p_partkey, CASE WHEN n >= 50 THEN 'generable' WHEN n >= 10 THEN 'thin' ELSE 'none' END AS label FROM n""")
def q7_coverage_labels(t: Tables) -> DataFrame:
    counted = R.count_per(t.part.select("p_partkey"), t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "n")
    return counted.select("p_partkey", F.when(F.col("n") >= 50, "generable").when(F.col("n") >= 10, "thin").otherwise("none").alias("label"))


def decks(t: Tables) -> DataFrame:
    """(course, slides): each course's slides in order."""
    one = F.struct("idx", "module", "kind", F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("title"))
    return slides(t).groupBy("course").agg(F.array_sort(F.collect_list(one)).alias("slides"))


def _told(deck: DataFrame, edited) -> DataFrame:
    text = F.array_join(F.transform(edited, lambda s: F.concat_ws("/", s["idx"].cast("string"), s["module"].cast("string"), s["title"])), ",")
    return deck.select("course", text.alias("deck"))


_DECK = f"{_SLIDES}, n AS (SELECT *, 'S' || l_partkey AS title, count(*) OVER (PARTITION BY course) AS size FROM sl)"
_TELL = "string_agg(i || '/' || module || '/' || title, ',' ORDER BY i)"
_NUM = "row_number() OVER (PARTITION BY course ORDER BY pos) - 1 AS i"


@add(f"WITH {_DECK} SELECT course, string_agg(idx || '/' || module || '/' || CASE WHEN idx = 1 THEN 'Nuovo' ELSE title END, ',' ORDER BY idx) AS deck FROM n GROUP BY 1")
def e1_merge_patch(t: Tables) -> DataFrame:
    d = decks(t)
    return _told(d, E.merge(F.col("slides"), F.lit(1), title=F.lit("Nuovo")))


@add(f"WITH {_DECK}, u AS (SELECT course, idx * 2 AS pos, module, title FROM n UNION ALL SELECT course, 1, module, 'Nuovo' FROM n WHERE idx = 0), k AS (SELECT *, {_NUM} FROM u) SELECT course, {_TELL} AS deck FROM k GROUP BY 1")
def e2_insert_after(t: Tables) -> DataFrame:
    d = decks(t)
    new = F.struct(F.lit(0).alias("idx"), F.lit(0).alias("module"), F.lit("RECAP").alias("kind"), F.lit("Nuovo").alias("title"))
    return _told(d, E.insert_after(F.col("slides"), F.lit(0), new))


@add(f"""WITH {_DECK}, z AS (SELECT a.course FROM n a JOIN n b ON a.course = b.course AND a.idx = 0 AND b.idx = 1 AND a.module = b.module AND a.kind <> 'MODULE_OPEN' AND b.kind <> 'MODULE_OPEN'),
k AS (SELECT n.course, module, title, CASE WHEN z.course IS NOT NULL AND idx < 2 THEN 1 - idx ELSE idx END AS i FROM n LEFT JOIN z ON z.course = n.course) SELECT course, {_TELL} AS deck FROM k GROUP BY 1""")
def e3_swap(t: Tables) -> DataFrame:
    d = decks(t)
    return _told(d, E.swap_next(F.col("slides"), F.lit(0)))


@add(f"WITH {_DECK}, k0 AS (SELECT *, idx AS pos FROM n WHERE NOT (idx = 0 AND size > 1 AND kind <> 'MODULE_OPEN')), k AS (SELECT *, {_NUM} FROM k0) SELECT course, {_TELL} AS deck FROM k GROUP BY 1")
def e4_delete(t: Tables) -> DataFrame:
    d = decks(t)
    return _told(d, E.delete(F.col("slides"), F.lit(0)))


@add(f"WITH {_DECK}, u AS (SELECT course, idx * 2 AS pos, module, title FROM n UNION ALL SELECT course, 1, module, title || ' (copia)' FROM n WHERE idx = 0), k AS (SELECT *, {_NUM} FROM u) SELECT course, {_TELL} AS deck FROM k GROUP BY 1")
def e5_duplicate(t: Tables) -> DataFrame:
    d = decks(t)
    return _told(d, E.duplicate(F.col("slides"), F.lit(0)))


@add("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS body FROM documents""")
def e6_bullets_and_back(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", E.to_body(E.to_bullets(F.col("text"))).alias("body"))


@add(f"WITH {_SLIDES} SELECT course, string_agg(CAST(idx + 1 AS VARCHAR), ',' ORDER BY idx) AS ordinals FROM sl WHERE kind <> 'QUIZ' OR idx >= 0 GROUP BY 1")
def e7_ordinals(t: Tables) -> DataFrame:
    numbered = E.renumber(F.col("slides"))
    return decks(t).select("course", F.array_join(F.transform(numbered, lambda s: (s["idx"] + 1).cast("string")), ",").alias("ordinals"))


_STYLED = f"{_SLIDES}, st AS (SELECT course, idx, module, kind AS slide_type, 'Tema ' || l_partkey % 9 AS title, CAST(l_quantity AS BIGINT) AS words, CASE l_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'web_search' ELSE 'diagram' END AS strategy FROM sl)"


@add(f"""WITH {_STYLED}, k AS (SELECT course, slide_type AS v, row_number() OVER (PARTITION BY course ORDER BY count(*) DESC, min(idx)) AS k FROM st GROUP BY 1, 2), w AS (SELECT course, title AS v, row_number() OVER (PARTITION BY course ORDER BY min(idx)) AS k FROM st GROUP BY 1, 2 HAVING count(*) > 1),
a AS (SELECT course, CAST(sum(words) // count(*) AS BIGINT) AS avg_words, round_even(count(*) FILTER (slide_type = 'QUIZ') / count(DISTINCT module), 1) AS avg_quizzes, round_even(count(*) FILTER (strategy <> 'none') / count(*), 2) AS image_ratio FROM st GROUP BY 1)
SELECT a.*, (SELECT string_agg(v, ';' ORDER BY k) FROM k WHERE k.course = a.course AND k <= 5) AS top_types, coalesce((SELECT string_agg(v, ';' ORDER BY k) FROM w WHERE w.course = a.course AND k <= 10), '') AS recurring_titles FROM a""")
def a11_style_profile(t: Tables) -> DataFrame:
    strategy = F.when(F.col("l_partkey") % 3 == 0, "none").when(F.col("l_partkey") % 3 == 1, "web_search").otherwise("diagram")
    title = F.concat(F.lit("Tema "), (F.col("l_partkey") % 9).cast("string"))
    rows = slides(t).select("course", "idx", "module", F.col("kind").alias("slide_type"), title.alias("title"), F.col("l_quantity").cast("bigint").alias("words"), strategy.alias("strategy"))
    return Q.style_profile(rows).withColumns({c: F.array_join(c, ";") for c in ("top_types", "recurring_titles")})
