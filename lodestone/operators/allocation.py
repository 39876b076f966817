"""Pacing of courses and allocation of passages to modules.

What depends on the order of steps is brought to a form that doesn't walk them: quota pins and reuse caps are accepted in rounds, rebalancing is matched by
rank, and greedy batches are linked and followed by doubling. A course or source may hold any share of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.operators.overlap import most_shared
from lodestone.operators.relational import numbered_in_ranges, top_per
from lodestone.sources.scratch import written

# Shares of slide types, density factors, and the bounds of a module.
SHARES = {"CONTENT_TEXT": 0.55, "CONTENT_IMAGE": 0.25, "QUIZ": 0.10, "DIAGRAM": 0.05, "CASE_STUDY": 0.03, "RECAP": 0.02}
DENSITY = {"leggera": 0.8, "standard": 1.0, "intensiva": 1.25}
PER_MODULE, LEAST, MOST, PER_CHUNK = 27, 18, 80, 1.5
SECONDS = 45.0
QUOTA = 30
MARGIN = 0.08
BATCH_TOKENS, BATCH_DOCS = 280_000, 1000


def split_types(content: Column) -> Column:
    """Slides of each type: shares rounded to even, one at least, the last type takes the rest."""
    parts = {k: F.greatest(F.lit(1), F.bround(content * s, 0).cast("int")) for k, s in list(SHARES.items())[:-1]}
    rest = content.cast("int") - sum(parts.values(), F.lit(0))
    return F.create_map(*[x for k, v in {**parts, list(SHARES)[-1]: rest}.items() for x in (F.lit(k), v.cast("int"))])


def pacing(courses: DataFrame, hours: str = "hours", density: str = "density", seconds: str = "seconds", titles: str = "titles", chunks: str = "chunks") -> DataFrame:
    """A row per module: module_index, title, slide_count (with an opening and a closing slide), distribution.

    ``titles`` is an array or null; ``chunks`` a map from module to its passages or null, used only without titles.
    """
    factor = F.element_at(F.create_map(*[F.lit(x) for k, v in DENSITY.items() for x in (k, v)]), F.col(density))
    total = F.floor(F.col(hours) * 3600 / F.col(seconds) * factor).cast("int")
    titled = F.coalesce(F.size(titles) > 0, F.lit(False))
    modules = F.when(titled, F.size(titles)).otherwise(F.greatest(F.lit(2), F.ceil(F.col("_total") / PER_MODULE).cast("int")))
    rows = courses.withColumn("_total", total).withColumn("_n", modules).withColumn("module_index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    even = F.floor(F.col("_total") / F.col("_n")).cast("int") + F.when(F.col("module_index") < F.col("_total") % F.col("_n"), 1).otherwise(0)
    own = F.try_element_at(F.col(chunks), F.col("module_index"))
    paced = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.bround(own * PER_CHUNK, 0).cast("int")))
    content = F.when(titled | own.isNull(), even).otherwise(paced)
    title = F.coalesce(F.get(titles, F.col("module_index")), F.concat(F.lit("Modulo "), (F.col("module_index") + 1).cast("string")))
    return rows.withColumn("_content", content).withColumns({"title": title, "slide_count": F.col("_content") + 2, "slide_distribution": split_types(F.col("_content"))}).drop("_total", "_n", "_content")


BODY = 500  # characters of a body whose words count
ENOUGH = 3  # passages a module, below which themes aren't compared


def theme_words(text: Column) -> Column:
    """The distinct words of a text, of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


#: What a title's word weighs that stands among a passage's tags, in its path, its article, the beginning of its body.
THEMES = {"tag_words": 3.0, "path_words": 2.0, "article_words": 1.0, "body_words": 0.5}


def by_theme(chunks: DataFrame, modules: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(chunk_id, module_index, score, margin, pinned, rule): each passage to the module of its theme, by weighted overlaps with the module's title.

    Chunks (chunk_id, tags, path, article, body), modules (module_index, title); passages of ``known`` (chunk_id) are left out. Where all scores are 0, to the one whose title
    shares most words with the whole body; ties go to the first module. Only the beginnings of bodies are compared at first, whole bodies only of passages that these leave open.
    """
    bare = lambda text: F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"))
    # A file of one row group is one task. By a hash of their own, as a join's own dealing may be undone where it turns into a broadcast.
    dealt = F.xxhash64("chunk_id")
    heads = chunks.select("chunk_id", "tags", "path", "article", F.substring("body", 1, BODY).alias("head"))
    if known is not None:
        heads = heads.join(known, "chunk_id", "left_anti")
    own = heads.repartition(dealt).select(
        "chunk_id", theme_words(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")).alias("tag_words"), theme_words(F.col("path")).alias("path_words"),
        theme_words(F.col("article")).alias("article_words"), theme_words(F.col("head")).alias("body_words"),
    )
    best = written(most_shared(own, modules.select("module_index", theme_words(F.col("title")).alias("words")), THEMES), "themes")
    ahead = F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 9)
    themed = best.where("score > 0").select("chunk_id", "module_index", "score", ahead.alias("margin"), (ahead >= MARGIN).alias("pinned"), F.lit("theme").alias("rule"))
    open_ = written(best.where("score = 0").select(F.col("chunk_id").alias("_id")), "unthemed")
    bodies = chunks.select("chunk_id", "body").join(open_, F.col("chunk_id").eqNullSafe(F.col("_id")), "left_semi").repartition(dealt)
    plain = most_shared(bodies.select("chunk_id", bare(F.col("body")).alias("all_words")), modules.select("module_index", F.array_remove(bare(F.col("title")), "").alias("words")), {"all_words": 1.0})
    return themed.unionByName(plain.select("chunk_id", "module_index", F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit(False).alias("pinned"), F.lit("overlap").alias("rule")))


def assign_thematically(chunks: DataFrame, modules: DataFrame) -> DataFrame:
    """:func:`by_theme`; where there are fewer than three passages a module, they are dealt in turn instead, by id."""
    counts = chunks.agg(F.count("*").alias("n")).crossJoin(modules.agg(F.count("*").alias("m")))
    few = written(counts.where(F.col("n") < F.col("m") * ENOUGH), "few")  # a row, or none
    themed = by_theme(chunks.join(few, how="left_anti"), modules)
    # Windows over all rows, of which there are less than three a module, or none.
    places = modules.crossJoin(few.select("m")).withColumn("at", F.row_number().over(Window.orderBy("module_index")) - 1)
    turned = chunks.select("chunk_id").join(few.select("n"), how="left_semi").withColumn("turn", F.row_number().over(Window.orderBy("chunk_id")) - 1)
    dealt = turned.join(places, F.col("turn") % F.col("m") == F.col("at"))
    return themed.unionByName(dealt.select("chunk_id", "module_index", F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit(False).alias("pinned"), F.lit("turn").alias("rule")))


def assign_by_cosine(chunks: DataFrame, modules: DataFrame, scores: DataFrame) -> DataFrame:
    """(chunk_id, module_index, score, margin, pinned, rule) by similarity ``scores`` (chunk_id, module_index, score); passages without any, as they have no
    vector, by their theme."""
    near = written(assign_best(scores).withColumn("rule", F.lit("cosine")), "near")
    rest = by_theme(chunks, modules, near.select("chunk_id"))
    return near.select("chunk_id", "module_index", "score", "margin", "pinned", "rule").unionByName(rest)


def assign_best(scores: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(chunk_id, module_index, score, margin, pinned): the best module and how far ahead of the next it is."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc("score"), "module_index")
    ahead = F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))
    ranked = scores.withColumns({"margin": F.round(ahead, 9), "_k": F.row_number().over(w)}).where("_k = 1").drop("_k")
    return ranked.withColumn("pinned", F.col("margin") >= margin)


def accepted(edges: DataFrame, keys: list[str], chooser: str, item: str, order: list[Column], takes: int, holds: int) -> DataFrame:
    """The edges by which choosers, who come one after another, each take their first ``takes`` items of which less than ``holds`` are gone.

    Deferred acceptance in rounds: every chooser asks for its first items, an item keeps the ``holds`` least choosers that ask and turns away
    all that come after them for good, and who was turned away asks for what comes next, until nobody is turned away. As all items prefer the
    same choosers, this is what the choosers would get in turn. No group of a key is put together: what a chooser asks for and an item keeps are the first rows of a
    window, which Spark cuts before it shuffles. A round after the first lowers the bound of some item, to a chooser that really asked, so there are at most as many rounds
    as choosers that are turned away, plus one; each writes a row for each full item and one for each request.
    An edge stands once for each (keys, chooser, item); ``order`` has to tell a chooser's items apart; neither keys nor items are null.
    """
    edges = written(edges, "edges")
    full = [*keys, item]
    bound: DataFrame | None = None
    while True:
        open_ = edges if bound is None else edges.join(bound, full, "left").where(F.col("_last").isNull() | (F.col(chooser) <= F.col("_last"))).drop("_last")
        asked = top_per(open_, [*keys, chooser], order, takes)
        asked = written(asked.withColumn("_place", F.row_number().over(Window.partitionBy(*full).orderBy(chooser))), "asked")
        if asked.where(F.col("_place") > holds).isEmpty():
            return asked.drop("_place")
        closed = asked.where(F.col("_place") == holds).select(*full, F.col(chooser).alias("_last"))
        # An item that is full stays so: those it keeps can only be replaced by others before them.
        bound = written(closed if bound is None else closed.unionByName(bound).groupBy(*full).agg(F.min("_last").alias("_last")), "bound")


def quota_dedup(candidates: DataFrame, quota: int = QUOTA, course: str = "course_id") -> DataFrame:
    """(course, module_index, chunk_id, score): each passage in one module.

    Modules in turn pin their best passages that aren't pinned yet, up to the quota; what is left goes where it scores best, the
    first module among equals; a null score counts as 0. A module has a passage once. A quota of 0 pins nothing.
    """
    score = F.coalesce("score", F.lit(0.0))
    best = candidates.groupBy(course, "chunk_id").agg(F.min_by("module_index", F.struct(-score, "module_index")).alias("_best"))
    homes = best.withColumn("_home", F.col("_best"))
    if quota > 0:
        pinned = accepted(candidates.select(course, "chunk_id", "module_index", score.alias("score")), [course], "module_index", "chunk_id", [F.desc("score"), F.col("chunk_id")], quota, 1)
        pins = pinned.select(course, "chunk_id", F.col("module_index").alias("_pin"))
        homes = best.join(pins, [course, "chunk_id"], "left").withColumn("_home", F.coalesce("_pin", "_best"))
    return candidates.join(homes, [course, "chunk_id"]).where(F.col("module_index") == F.col("_home")).select(course, "module_index", "chunk_id", "score")


def _evened(rows: DataFrame, modules: DataFrame, least: int, most: int, course: str, steps: int | None, by_margin: bool) -> DataFrame:
    """One pass: modules of over ``most`` passages give to those of under ``least``, in closed form.

    The k-th passage that is given goes to the k-th place that is taken. Places are taken from the emptiest module on, so they stand in the order
    of (passages that the module has by then, module). A module gives while it has over ``most``, so its first ones in its own
    order; of all modules the passages go by margin, or from the fullest module on.
    """
    sizes = modules.join(rows.groupBy(course, "module_index").agg(F.count("*").alias("_size")), [course, "module_index"], "left").withColumn("_size", F.coalesce("_size", F.lit(0)))
    short = sizes.where(F.col("_size") < least).select(course, F.col("module_index").alias("_to"), F.explode(F.sequence("_size", F.lit(least - 1))).alias("_level"))
    donors = sizes.where(F.col("_size") > most).select(course, "module_index", "_size")
    own = [F.asc_nulls_last("margin"), F.col("chunk_id")] if by_margin else [F.desc("chunk_id")]
    offered = rows.join(donors, [course, "module_index"]).where(~F.col("pinned") if by_margin else F.lit(True))
    placed = numbered_in_ranges(offered.select(course, "module_index", "chunk_id", "margin", "_size"), [course, "module_index"], own, "_k").where(F.col("_k") <= F.col("_size") - most)
    overall = own if by_margin else [F.desc(F.col("_size") - F.col("_k")), F.col("module_index"), F.col("_k")]
    if steps is None:
        given, taken = numbered_in_ranges(placed, [course], overall, "_step"), numbered_in_ranges(short, [course], [F.col("_level"), F.col("_to")], "_step")
    else:
        given, taken = top_per(placed, [course], overall, steps, "_step"), top_per(short, [course], [F.col("_level"), F.col("_to")], steps, "_step")
    moved = given.select(course, "_step", "chunk_id").join(taken.select(course, "_step", "_to"), [course, "_step"]).select(course, "chunk_id", "_to")
    return rows.join(moved, [course, "chunk_id"], "left").withColumn("module_index", F.coalesce("_to", "module_index")).drop("_to")


def rebalance(assigned: DataFrame, least: int, most: int, course: str = "course_id", steps: int = 200, by_margin: bool = True) -> DataFrame:
    """(course, chunk_id, module_index): one pass until no module has under ``least`` passages, then one until none has over ``most``.

    A step moves a passage to the emptiest module that is short. It comes from modules with over ``least + 2`` passages in the first
    pass, over ``most`` in the second: of all these the passage of the least margin that isn't pinned, within ``steps``; without
    ``by_margin`` the last one of the fullest module. Ties go to the smaller module and passage. A pass ends early when nothing can move. The
    steps are not walked: see ``_evened``. A course has a passage once; ``all_modules`` lists all modules of a course.
    """
    modules = assigned.groupBy(course).agg(F.min("all_modules").alias("m")).select(course, F.explode(F.col("m").cast("array<int>")).alias("module_index"))
    modules = written(modules, "modules")
    rows = written(assigned.select(course, "chunk_id", F.col("module_index").cast("int").alias("module_index"), *([] if not by_margin else ["pinned"]), F.col("margin") if "margin" in assigned.columns else F.lit(0.0).alias("margin")), "assigned")
    bound = steps if by_margin else None
    once = written(_evened(rows, modules, least, least + 2, course, bound, by_margin), "evened")
    return _evened(once, modules, most, most, course, bound, by_margin).select(course, "chunk_id", "module_index")


BLOCK_ROWS = 16_384  # of a group that are linked in a task, more only if a batch may hold more


def _linker(tokens: int, docs: int, block: int):
    """The next batch's start of each row of a block, and where a batch that starts at a row leads to behind the block."""

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        pos, total = rows.column("pos").to_numpy(), rows.column("sum").to_numpy()
        own = int((pos < (key[0].as_py() + 1) * block).sum())
        size = np.diff(total, prepend=total[0] - rows.column("size")[0].as_py())
        # The first row that no longer fits, within those at hand: they reach as far as a batch can.
        after = np.searchsorted(total, total[:own] - size[:own] + tokens, "right")
        after = np.maximum(np.minimum(after, np.arange(own) + docs), np.arange(own) + 1)
        exits = after.copy()
        for k in range(own - 1, -1, -1):
            if exits[k] < own:
                exits[k] = exits[exits[k]]
        first = pos[0]
        return pa.table([rows.column(c).slice(0, own) for c in ("group", "order", "pos")] + [pa.array(first + after), pa.array(first + exits)], ["group", "order", "pos", "after", "exit"])

    return link


def _marker(block: int):
    """Rows of a block with how many batches have started there so far, from where its first one does."""

    def mark(key: tuple, rows: pa.Table, entry: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        pos, after = rows.column("pos").to_numpy(), rows.column("after").to_numpy()
        starts, k = np.zeros(len(pos), np.int64), int(entry.column("start")[0].as_py() - pos[0]) if entry.num_rows else len(pos)
        while k < len(pos):
            starts[k] = 1
            k = int(after[k] - pos[0])
        return pa.table([rows.column("group"), rows.column("order"), pa.array(pos // block), pa.array(np.cumsum(starts))], ["group", "order", "block", "started"])

    return mark


def greedy_batches(df: DataFrame, group: str, order: str, text: str, tokens: int = BATCH_TOKENS, docs: int = BATCH_DOCS) -> DataFrame:
    """(group, order, batch): texts in order fill a batch until it would exceed its tokens or documents, numbered from 0.

    A text's tokens are estimated as max(1, length // 4 + 1), a null text's as 1. Where the batch that starts at a row ends is a search in sums of
    tokens; it is at most ``docs`` rows or ``tokens`` tokens further, so a block of rows and the next one are enough to find it. Following these links leads
    from a block's row into the next block. Where each block is entered is found by doubling: 1, 2, 4 and more blocks at once. A group may
    hold any share of the rows: no task holds more than two blocks of it. Groups may be null; ``order`` is unique in its group.
    """
    reach = min(docs, tokens)  # rows of a batch at most
    block = max(BLOCK_ROWS, reach)
    size = F.greatest(F.lit(1), F.floor(F.coalesce(F.length(text), F.lit(0)) / 4) + 1).cast("bigint")
    sized = df.select(F.col(group).alias("group"), F.col(order).alias("order"), F.when(F.col(text).isNull(), F.lit(1)).otherwise(size).cast("bigint").alias("size"))
    placed = numbered_in_ranges(sized, ["group"], [F.col("order")], "pos", running={"sum": "size"}).withColumn("pos", (F.col("pos") - 1).cast("bigint"))
    kinds = dict(sized.dtypes)
    # A row goes to its block, and those that a batch of the block before may reach to that one too.
    home = F.floor(F.col("pos") / block).cast("bigint")
    twice = placed.withColumn("block", F.explode(F.when((F.col("pos") % block < reach) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))))
    linked = written(twice.groupBy("block", "group").applyInArrow(_linker(tokens, docs, block), f"group {kinds['group']}, order {kinds['order']}, pos bigint, after bigint, exit bigint"), "linked")
    # Only rows near a block's beginning can be the first ones where a batch starts.
    jumps = linked.where(F.col("pos") % block < reach).select("group", "pos", F.col("exit").alias("to"))
    jumps = written(_within(jumps, jumps), "jumps")
    starts = written(linked.where("pos = 0").select("group", F.col("pos").alias("start")), "starts")
    while not jumps.isEmpty():
        on = starts.select(F.col("group").alias("g"), F.col("start").alias("s"))
        starts = written(starts.unionByName(on.join(jumps, F.col("g").eqNullSafe(F.col("group")) & (F.col("s") == F.col("pos"))).select("group", F.col("to").alias("start"))), "starts")
        on = jumps.select(F.col("group").alias("g"), F.col("pos").alias("p"), F.col("to").alias("t"))
        jumps = written(on.join(jumps, F.col("g").eqNullSafe(F.col("group")) & (F.col("t") == F.col("pos"))).select("group", F.col("p").alias("pos"), "to"), "jumps")
    rows = linked.select("group", "order", "pos", "after", home.alias("block"))
    entries = starts.select(F.col("group").alias("g"), "start", F.floor(F.col("start") / block).cast("bigint").alias("b"))
    marked = written(rows.groupBy("group", "block").cogroup(entries.groupBy("g", "b")).applyInArrow(_marker(block), f"group {kinds['group']}, order {kinds['order']}, block bigint, started bigint"), "marked")
    counts = marked.groupBy(F.col("group").alias("g"), F.col("block").alias("b")).agg(F.max("started").alias("n"))  # a row a block
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("g", "b", before.alias("before"))
    numbered = marked.join(offsets, F.col("group").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
    return numbered.select(F.col("group").alias(group), F.col("order").alias(order), (F.col("started") + F.col("before") - 1).cast("int").alias("batch"))


def _within(jumps: DataFrame, rows: DataFrame) -> DataFrame:
    """Jumps that end at a row that there is: the others leave their group."""
    there = rows.select(F.col("group").alias("g"), F.col("pos").alias("p"))
    return jumps.join(there, F.col("group").eqNullSafe(F.col("g")) & (F.col("to") == F.col("p")), "left_semi")


def capped_choice(candidates: DataFrame, cap: int, course: str = "course_id") -> DataFrame:
    """(course, slot, image): slots in turn take their first candidate that is used less than ``cap`` times in the course.

    A slot has an image once; of equal ranks the smaller image comes first. A cap of 0 gives nothing.
    """
    if cap <= 0:
        return candidates.select(course, "slot", "image").limit(0)
    found = accepted(candidates.select(course, "slot", "image", "rank"), [course], "slot", "image", [F.col("rank"), F.col("image")], 1, cap)
    return found.select(course, "slot", "image")


def voice_share(total: Column, share: Column, voice: Column, voices: Column, quizzes: Column, cases: Column) -> tuple[Column, Column, Column]:
    """Text slides by share; quizzes go to the first voice, case studies to the last."""
    return F.bround(total * share, 0).cast("int"), F.when(voice == 0, quizzes).otherwise(0), F.when(voice == voices - 1, cases).otherwise(0)


def key_points(slides: DataFrame, module: list[str], order: list[Column], title: str, n: int = 5, words: int = 12) -> DataFrame:
    """Five distinct titles of a module (told apart by 50 characters), cut to 12 words, padded with an ellipsis."""
    from lodestone.functions.text import truncated

    keyed = slides.withColumn("_key", F.substring(title, 1, 50))
    first = top_per(keyed, [*module, "_key"], order)
    ranked = top_per(first, module, order, n, "_k")
    points = F.transform(F.array_sort(F.collect_list(F.struct("_k", truncated(F.col(title), words).alias("t")))), lambda x: x["t"])
    grouped = ranked.groupBy(*module).agg(points.alias("points"))
    return grouped.withColumn("points", F.slice(F.concat("points", F.array_repeat(F.lit("…"), n)), 1, n))
