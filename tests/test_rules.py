"""Rules and fallbacks of assignment, drawings, completion, profiles, images and references, by hand-made cases."""

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import allocation as A, graph as G, quality as Q, retrieval as V


def values(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", column(F.col("x")).alias("y")).orderBy("k").collect()
    return [r["y"] for r in rows]


def test_drawings(spark):
    dirty = {
        '<svg/onload="alert(1)"><g/></svg>': "<svg><g/></svg>", "<svg onload=alert(1)><g/></svg>": "<svg><g/></svg>", '<a id="x"onclick=\'y()\'>t</a>': '<a id="x">t</a>',
        "<image href=http://h/x/>": "<image/>", '<use xlink:href=//h/x id="1"/>': '<use id="1"/>', '<a href="#p">on one = 1, onload="x"</a>': '<a href="#p">on one = 1, onload="x"</a>',
        "<SVG ONLOAD = 'x' OnClick=\"y\">": "<SVG>", '<text title="a > b" onx="1">2 < 3</text>': '<text title="a > b">2 < 3</text>', "<svg><SCRIPT>\n1</SCRIPT ><foreignobject>x</foreignObject></svg>": "<svg></svg>",
        "": "", "plain": "plain", None: None, "<path d='M0 0' once='1'/>": "<path d='M0 0'/>", "<unclosed onload=x": "<unclosed onload=x",
    }
    assert values(spark, X.clean_svg, list(dirty)) == list(dirty.values())


def test_batches_and_slots(spark):
    split = lambda n, size: spark.range(1).select(X.batch_split(F.lit(n), F.lit(size)).alias("x")).first()["x"]
    assert [split(*x) for x in ((5, 15), (15, 15), (16, 15), (17, 15), (18, 15), (30, 15), (32, 15), (33, 15), (0, 15))] == [[5], [15], [16], [17], [15, 3], [15, 15], [15, 17], [15, 15, 3], [0]]
    fit = lambda slots, most, font: spark.range(1).select(X.fitted_slots(F.array(*map(F.lit, slots)), F.lit(most), F.lit(font)).alias("x")).first()["x"]
    assert fit(["Formazione e addestramento", "Breve"], 18, 28) == ["Formazione e addestramento", "Breve"]  # 19 points hold it
    assert fit(["x" * 60, "y" * 31, "z" * 32], 18, 28) == ["x" * 30 + "…", "y" * 31, "z" * 30 + "…"]


SCHEMA = "chunk_id int, tags array<string>, path string, article string, body string"


def test_assignment_by_theme(spark):
    modules = spark.createDataFrame([(0, "Rischio incendio"), (1, "Scarpe e DPI: uso")], "module_index int, title string")
    rows = [
        (1, ["DPI", "scarpe"], None, None, "niente"), (2, None, "Titolo > Incendio", "Art. 1", "x"), (3, None, None, None, "y" * 600 + " incendio rischio"), (4, [], "", "", "DPI: uso"), (5, None, None, None, None),
        (6, None, None, None, "nulla di simile"), (7, ["incendio"], None, None, "scarpe"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["chunk_id"]: (r["module_index"], r["score"], r["rule"]) for r in A.assign_thematically(df, modules).collect()}
    # Beyond 500 characters only the whole body's words count, and only where nothing else does.
    assert got == {1: (1, 6.0, "theme"), 2: (0, 2.0, "theme"), 3: (0, 0.0, "overlap"), 4: (1, 1.0, "theme"), 5: (0, 0.0, "overlap"), 6: (0, 0.0, "overlap"), 7: (0, 3.0, "theme")}
    few = A.assign_thematically(df.where("chunk_id < 6"), modules).collect()
    assert {r["chunk_id"]: (r["module_index"], r["rule"]) for r in few} == {k: ((k - 1) % 2, "turn") for k in range(1, 6)}
    assert A.assign_thematically(df.limit(0), modules).count() == 0
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.45), (2, 0, 0.1), (2, 1, 0.9)], "chunk_id int, module_index int, score double")
    near = {r["chunk_id"]: (r["module_index"], r["rule"], r["pinned"]) for r in A.assign_by_cosine(df.where("chunk_id < 4"), modules, scores).collect()}
    assert near == {1: (0, "cosine", False), 2: (1, "cosine", True), 3: (0, "overlap", False)}


def test_reference_edges(spark):
    chunks = spark.createDataFrame([(1, 9, "Art. 1", "1"), (2, 9, "Art. 1", "2"), (3, 9, "art. 1 ", None), (4, 9, "Allegato IV", None), (5, 8, "Art. 1", "2"), (6, 9, None, None)], "chunk_id int, regulation_id int, article string, paragraph string")
    found = [(1, 9, "Art. 1", "2", "cita"), (1, 9, "Art. 1", "7", "cita"), (2, 9, "Art. 1", "2", "cita"), (2, 9, "ART. 1", None, "modifica"), (2, 9, "Art. 1", "1", "modifica"), (4, 9, "Allegato IV", None, "cita"), (5, 8, "Allegato IV", None, "cita"), (6, 9, "allegato iv", None, "cita")]
    edges = G.reference_edges(spark.createDataFrame(found, "src int, regulation_id int, target string, target_paragraph string, intent string"), chunks)
    assert {tuple(r) for r in edges.collect()} == {(1, 2, "cita", 1.0), (2, 1, "modifica", 1.0), (6, 4, "cita", 1.0)}


def test_similar_sets(spark):
    import itertools
    import random

    rng = random.Random(2)
    sets = {k: rng.sample(range(25), rng.randrange(0, 8)) for k in range(120)} | {200: None, 201: [], 202: [1, None, 1], 203: [1]}
    df = spark.createDataFrame(list(sets.items()), "id int, refs array<int>")
    bare = {k: frozenset(set(v or []) - {None}) for k, v in sets.items()}
    first = {}
    for k in sorted(bare):
        first.setdefault(bare[k], k)
    for least in (0.15, 0.5, 1.0):
        want = {(a, b, len(x & y)) for (x, a), (y, b) in itertools.combinations(sorted(((x, k) for x, k in first.items() if x), key=lambda p: p[1]), 2) if len(x & y) >= least * len(x | y)}
        assert {(r["src"], r["dst"], r["shared"]) for r in G.similar_sets(df, least).collect()} == want
    assert {tuple(r) for r in G.members(df).collect()} == {(k, first[x]) for k, x in bare.items() if x}
    assert G.similar_sets(df.limit(0), 0.15).count() == 0


def test_images_by_vector_and_tags(spark):
    library = spark.createDataFrame([(1, [1.0, 0.0], ["estintore"]), (2, [0.9, 0.1], ["porta", "uscita"]), (3, None, ["uscita", "luce", "uscita"]), (4, [0.0, 1.0], None)], "image_id int, embedding array<double>, tags array<string>")
    asked = spark.createDataFrame([(1, "un Estintore"), (2, "uscita di  luce"), (3, "ab"), (4, None)], "query_id int, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, -1.0])], "query_id int, embedding array<double>")
    got = lambda **kw: [(r["query_id"], r["image_id"], r["rank"], r["by"], round(r["score"], 3)) for r in V.image_search(asked, vectors, library, **kw).orderBy("query_id", "rank").collect()]
    assert got(k=2) == [(1, 1, 1, "vector", 1.0), (1, 2, 2, "vector", 0.994), (2, 3, 1, "tags", 0.667), (2, 2, 2, "tags", 0.5)]
    usage = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (2, 3, 5)], "query_id int, image_id int, n int")
    assert got(k=1, usage=usage) == [(1, 2, 1, "vector", 0.994), (2, 2, 1, "tags", 0.5)]


def test_profiles_and_completion(spark):
    rows = [(1, 0, 0, "QUIZ", "a", 10, "none"), (1, 1, 0, "RECAP", "b", 11, "diagram"), (1, 2, 1, "QUIZ", "b", 12, None), (1, 3, 1, "RECAP", "a", 0, "web_search"), (1, 4, 2, "TITLE", None, 1, "none"), (2, 0, 0, "TITLE", "x", None, None)]
    got = {r["course"]: r for r in Q.style_profile(spark.createDataFrame(rows, "course int, idx int, module int, slide_type string, title string, words int, strategy string")).collect()}
    assert (got[1]["avg_words"], got[1]["top_types"], got[1]["recurring_titles"], got[1]["avg_quizzes"], got[1]["image_ratio"]) == (6, ["QUIZ", "RECAP", "TITLE"], ["a", "b"], 0.7, 0.4)
    assert got[2]["recurring_titles"] == [] and got[2]["avg_quizzes"] == 0.0
    schema = "k int, module_index int, slide_type string, image struct<strategy:string,aspect_hint:string,diagram_code:string>, quiz_correct int, notes string, normative_ref string, bullets array<string>, sezioni array<string>"
    whole = (0, 3, "QUIZ", ("none", None, None), 2, "p " * 25, "Art. 1", [], [])
    slides = [whole, (1, None, "TITLE", None, None, "p " * 20, None, None, None), (2, 1, "DIAGRAM", ("diagram", "wide", "<svg/>"), None, "p", "Art. 1", None, None), (3, 1, "QUIZ", ("search", None, None), 7, "p " * 25, " ", [], []), (4, 1, "OTHER", ("none", None, None), None, None, "x", None, None)]
    done = {r["k"]: r for r in Q.completed(spark.createDataFrame(slides, schema), Q.limits(spark), F.lit(9)).collect()}
    assert not done[0]["completed"] and not done[4]["completed"] and done[1]["completed"] and done[1]["module_index"] == 9 and done[1]["image"]["strategy"] == "none" and done[1]["bullets"] == []
    assert done[2]["image"] == ("diagram", "landscape", '<svg viewBox="0 0 1760 800"/>') and len(done[2]["notes"].split()) == 1 + 14 * 5 and done[3]["quiz_correct"] == 0 and done[3]["image"]["aspect_hint"] == "landscape"


def test_patches_are_checked_again(spark):
    slide = (1, "RECAP", "Titolo", ["a", "b", "c", "d", "e"], "p " * 100, False, None, None)
    df = spark.createDataFrame([slide], "k int, slide_type string, title string, items array<string>, notes string, has_image boolean, options array<string>, correct int")
    broken = lambda **c: Q.revalidated(df, Q.limits(spark), c).first()["violations"]
    assert broken(title=F.lit("Nuovo")) == [] and broken(title=F.lit("t" * 71)) == ["title"] and broken(items=F.array(F.lit("a"))) == ["items"]
