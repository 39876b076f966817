"""Sensors of slide quality and checks of slides against the limits of their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestone.functions.text import title_fingerprint, word_count
from lodestone.operators.relational import top_per

# Limits of each slide type: title characters, fewest and most items, words an item, fewest and most words of notes, whether
# it needs a picture and answers, whether its notes grow with the slide's length.
LIMITS = (
    ("TITLE", 70, 0, 0, 0, 20, 90, False, False, False), ("CONTENT_TEXT", 70, 4, 6, 12, 90, 160, False, False, True), ("CONTENT_IMAGE", 70, 3, 5, 10, 90, 160, True, False, True),
    ("DIAGRAM", 70, 1, 3, 20, 90, 160, True, False, True), ("QUIZ", 120, 0, 0, 0, 25, 120, False, True, False), ("CASE_STUDY", 70, 3, 3, 50, 90, 160, False, False, True),
    ("RECAP", 70, 5, 5, 10, 90, 160, False, False, True), ("CLOSING", 70, 0, 0, 0, 15, 90, False, False, False), ("MODULE_OPEN", 80, 0, 0, 0, 30, 80, False, False, False),
    ("MODULE_CLOSE", 80, 5, 5, 12, 60, 120, False, False, False),
)
SCHEMA = "slide_type string, title_max int, items_min int, items_max int, item_words int, notes_min int, notes_max int, needs_image boolean, needs_options boolean, narrative boolean"
MODULE_TARGET, MODULE_SHARE = 70, 0.7
OVERUSED, NEAR_TITLES = 3, 2
EXPECTED, ENOUGH, DEGRADED = 27, 0.8, 0.30  # slides of a module, share of them that is enough, share of modules with fewer that a course may have
ISSUES = ("image_missing", "diagram_fallback", "quiz_options", "notes_short", "module_underpopulated", "image_overused", "title_near_duplicate", "citation_out_of_scope", "title_citation_out_of_scope")


def scaled(words: Column, narrative: Column, seconds: Column) -> Column:
    """Words of notes for slides of so many seconds, of narrative types; others, and slides of unknown length, keep theirs."""
    grown = F.greatest(F.lit(1), F.bround(words * seconds / 45.0, 0).cast("int"))
    return F.when(narrative & seconds.isNotNull(), grown).otherwise(words)


def limits(spark: SparkSession, seconds: float = 45.0) -> DataFrame:
    """The table of limits, ten rows; notes of narrative types scale with the seconds of a slide."""
    return _scaled_notes(spark.createDataFrame(list(LIMITS), SCHEMA), F.lit(float(seconds)))


def _scaled_notes(rules: DataFrame, seconds: Column) -> DataFrame:
    return rules.withColumns({c: scaled(F.col(c), F.col("narrative"), seconds) for c in ("notes_min", "notes_max")})


def violations(slides: DataFrame, rules: DataFrame, seconds: Column | None = None) -> DataFrame:
    """``slides`` (slide_type, title, items, notes, has_image, options, correct) with ``violations`` and ``notes_low``.

    Slides of an unknown type pass. An opening slide may have one item, its subtitle. ``seconds`` of each slide scale limits that aren't scaled yet.
    """
    joined = slides.join(F.broadcast(rules), "slide_type", "left")  # ten rows
    if seconds is not None:
        joined = _scaled_notes(joined, seconds)
    n, opening = F.size("items"), F.col("slide_type") == "MODULE_OPEN"
    none = F.col("items_max") == 0
    long_item = F.exists("items", lambda x: word_count(x) > F.col("item_words"))
    options = F.coalesce(F.size("options"), F.lit(0))
    found = {
        "title": F.length("title") > F.col("title_max"),
        "items": F.when(none, F.when(opening, n > 1).otherwise(n > 0)).otherwise((n > F.col("items_max")) | (n < F.col("items_min"))),
        "item_words": ~none & long_item,
        "notes": word_count(F.col("notes")) > F.col("notes_max"),
        "image": F.col("needs_image") & ~F.coalesce("has_image", F.lit(False)),
        "options": F.col("needs_options") & ((options != 4) | F.coalesce(~F.col("correct").between(0, 3), F.lit(True)) | F.coalesce(F.exists("options", lambda o: F.length(o) > 80), F.lit(False))),
    }
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), k) for k, c in found.items())))
    low = F.coalesce(word_count(F.col("notes")) < F.col("notes_min"), F.lit(False))
    return joined.withColumns({"violations": names, "notes_low": low}).drop(*[c for c in rules.columns if c != "slide_type"])


def course_gate(slides: DataFrame, course: str, module: str, expected: int = EXPECTED) -> DataFrame:
    """(course, modules, degraded, status): courses of which over three tenths of the modules have under four fifths of the expected slides are partial."""
    made = slides.groupBy(course, module).agg(F.count("*").alias("n"))
    few = F.count_if(F.col("n") < int(expected * ENOUGH))
    counted = made.groupBy(course).agg(F.count("*").alias("modules"), few.alias("degraded"))
    return counted.withColumn("status", F.when(F.col("degraded") / F.col("modules") > DEGRADED, "partial").otherwise("completed"))


def slide_issues(slides: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, issue, severity) of each slide by itself: slide_type, strategy, n_options, notes_words."""
    kind = F.col("slide_type")
    checks = (
        ("image_missing", "high", kind.isin("CONTENT_IMAGE", "DIAGRAM") & F.coalesce(F.col("strategy").isin("none", "placeholder"), F.lit(True))),
        ("diagram_fallback", "medium", (kind == "DIAGRAM") & F.col("strategy").isin("branded_fallback")),
        ("quiz_options", "high", (kind == "QUIZ") & (F.col("n_options") < 2)),
        ("notes_short", "low", F.col("notes_words") < 30),
    )
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("issue"), F.lit(s).alias("severity"))) for i, s, c in checks)))
    return slides.select(*keys, F.explode(found).alias("x")).select(*keys, "x.*")


def underpopulated(slides: DataFrame, course: str, module: str, index: str, target: int = MODULE_TARGET) -> DataFrame:
    """(course, index, issue, severity): modules with under 70 % of their slides, told at their first slide."""
    counted = slides.groupBy(course, module).agg(F.count("*").alias("n"), F.min(index).alias(index))
    return counted.where(F.col("n") < MODULE_SHARE * target).select(course, index, F.lit("module_underpopulated").alias("issue"), F.lit("medium").alias("severity"))


def repeated(slides: DataFrame, keys: list[str], module: list[str], value: Column, least: int, issue: str) -> DataFrame:
    """Slides whose value occurs at least so often in their module; empty values don't count."""
    valued = slides.withColumn("_v", value).where((F.col("_v") != "") & F.col("_v").isNotNull())
    counted = valued.withColumn("_n", F.count("*").over(Window.partitionBy(*module, "_v"))).where(F.col("_n") >= least)
    return counted.select(*keys, F.lit(issue).alias("issue"), F.lit("medium").alias("severity"))


def near_titles(slides: DataFrame, keys: list[str], module: list[str], title: str) -> DataFrame:
    return repeated(slides, keys, module, title_fingerprint(F.col(title)), NEAR_TITLES, "title_near_duplicate")


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "issue").agg(F.count("*").alias("n"))


def style_profile(slides: DataFrame, course: str = "course") -> DataFrame:
    """A row a course: avg_words, top_types, recurring_titles, avg_quizzes, image_ratio, from slides (course, idx, module, slide_type, title, words, strategy).

    The five most frequent types and the first ten titles that recur; what is equally frequent stands in the order of its first slide.
    """
    of = lambda c: slides.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(course, F.col(c).alias("v")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    listed = lambda ranked: ranked.groupBy(course).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "v"))), lambda x: x["v"]).alias("v"))
    types = listed(top_per(of("slide_type"), [course], [F.desc("n"), F.col("first")], 5, "_k")).withColumnRenamed("v", "top_types")
    titles = listed(top_per(of("title").where("n > 1"), [course], [F.col("first")], 10, "_k")).withColumnRenamed("v", "recurring_titles")
    quizzes = F.count_if(F.col("slide_type") == "QUIZ") / F.greatest(F.lit(1), F.count_distinct("module"))
    whole = slides.groupBy(course).agg(
        F.floor(F.sum("words") / F.count("*")).cast("bigint").alias("avg_words"), F.bround(quizzes, 1).alias("avg_quizzes"),
        F.bround(F.count_if(F.col("strategy").isin("web_search", "diagram")) / F.count("*"), 2).alias("image_ratio"),
    )
    return whole.join(types, course, "left").join(titles, course, "left").withColumn("recurring_titles", F.coalesce("recurring_titles", F.array().cast("array<string>")))


# What is filled in where a slide lacks it.
VIEW_BOX = '<svg viewBox="0 0 1760 800"'
PAD = (" Approfondimento normativo previsto da ", " con applicazione pratica nei contesti operativi aziendali italiani.")
PADS = 5
ASPECTS = ("landscape", "portrait", "square")


def completed(slides: DataFrame, rules: DataFrame, module: Column) -> DataFrame:
    """Slides with what can be filled in without cutting anything, and ``completed``, whether something was.

    Columns: module_index, slide_type, image (struct of strategy, aspect_hint, diagram_code), quiz_correct, notes, normative_ref, bullets, sezioni. A missing
    module is the one at hand; a missing image is one of strategy none; a picture's form that is missing or unknown is landscape; a
    diagram gets a view box; a quiz without a right answer from 0 to 3 has the first; notes that are too short are padded with the reference, five times at
    most; titles, closings and quizzes without lists get empty ones.
    """
    kind = F.col("slide_type")
    none = F.struct(F.lit("none").alias("strategy"), F.lit(None).cast("string").alias("aspect_hint"), F.lit(None).cast("string").alias("diagram_code"))
    image = F.coalesce("image", none)
    aspect, strategy, code = image["aspect_hint"], image["strategy"], image["diagram_code"]
    missing = aspect.isNull() & F.coalesce(~strategy.isin("none", "diagram"), F.lit(False))
    form = F.when(missing | F.coalesce(~aspect.isin(*ASPECTS), F.lit(False)), "landscape").otherwise(aspect)
    boxed = F.when((kind == "DIAGRAM") & (code != "") & ~F.contains(code, F.lit("viewBox")), F.regexp_replace(code, r"^((?s:.*?))<svg\b", "$1" + VIEW_BOX)).otherwise(code)
    right = F.when((kind == "QUIZ") & ~F.coalesce(F.col("quiz_correct").between(0, 3), F.lit(False)), 0).otherwise(F.col("quiz_correct"))
    ref, notes = F.trim(F.coalesce("normative_ref", F.lit(""))), F.trim(F.coalesce("notes", F.lit("")))
    short = F.col("_least") - word_count(notes)
    pad = F.concat(F.lit(PAD[0]), ref, F.lit(PAD[1]))
    padded = F.trim(F.concat(notes, F.repeat(pad, F.least(F.lit(PADS), F.ceil(short / word_count(pad)).cast("int")))))
    told = F.when((short > 0) & (ref != ""), padded).otherwise(F.col("notes"))
    bare = kind.isin("TITLE", "CLOSING", "QUIZ")
    empty = F.array().cast("array<string>")
    new = {
        "module_index": F.coalesce("module_index", module), "image": F.struct(strategy.alias("strategy"), form.alias("aspect_hint"), boxed.alias("diagram_code")), "quiz_correct": right, "notes": told,
        **{c: F.when(bare, F.coalesce(F.col(c), empty)).otherwise(F.col(c)) for c in ("bullets", "sezioni")},
    }
    same = F.lit(True)
    for c, value in new.items():
        same &= value.eqNullSafe(F.col(c))
    least = rules.select("slide_type", F.col("notes_min").alias("_least"))
    return slides.join(F.broadcast(least), "slide_type", "left").withColumns({**new, "completed": ~same}).drop("_least")  # ten rows


def revalidated(slides: DataFrame, rules: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Patched slides, ``columns`` replaced, with the limits that they break now: a patch is taken where ``violations`` is empty."""
    return violations(slides.withColumns(columns), rules)
