"""Splitting of regulations into chunks, content deduplication, references and spoken text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LEAST = 50
COVERAGE = 0.7
# Forms of articles, paragraphs and annexes, of references to them and of the words before a reference.
ARTICLE = r"(?is)Art(?:icolo)?\.?\s*(\d+(?:-(?:bis|ter|quater|quinquies|sexies|septies|octies|novies|decies))?)\s*[\.\-—\s]+(.+?)(?=Art(?:icolo)?\.?\s*\d+|$)"
COMMA = r"(?s)(\d+)\.\s+(.+?)(?=\d+\.\s+|$)"
ANNEX = r"(?is)(Allegato\s+[IVXLCDM\d]+(?:-(?:bis|ter))?)\s*[\.\-—\s]*(.+?)(?=Allegato\s+[IVXLCDM\d]+|$)"
ART_REF = re.compile(r"\b(?:art(?:icolo|t\.?)|articol[oi]|art)\s*\.?\s*(\d+(?:[-\s]?(?:bis|ter|quater|quinquies))?)", re.I)
COMMA_REF = re.compile(r"\b(?:comma|co\.?|c\.)\s*(\d+)\b", re.I)
ANNEX_REF = re.compile(r"\b(?:allegat[oi]|all\.?)\s+([IVX]+|\d+)\b", re.I)
CHANGES = re.compile(r"\b(?:modifica\w*|sostitu(?:isce|ito|iti)|abrog\w*|integr(?:a|ato)|aggiunge|aggiunto|sostituendo|nov[ae]ll(?:a|ato))\b", re.I)
APPLIES = re.compile(r"\b(?:in\s+attuazione|attua\w*|recepimento|recepisce|in\s+conformit[àa])\b", re.I)
PAUSE = re.compile(r"\(\s*PAUSE\s+(\d+(?:\.\d+)?)\s*s?\s*\)", re.I)


def paragraphs(df: DataFrame, key: str, text: str, separator: str = "\n\n") -> DataFrame:
    """(key, pos, body) of paragraphs over 50 characters, in order, from 1."""
    kept = F.filter(F.transform(F.split(text, re.escape(separator)), lambda p: F.trim(p)), lambda p: F.length(p) > LEAST)
    return df.select(key, F.posexplode(kept).alias("pos", "body")).withColumn("pos", F.col("pos") + 1)


def _overlapped(parts: DataFrame, key: str) -> DataFrame:
    """(key, pos, body): each paragraph after the last full sentence of the one before."""
    before = F.split(F.lag("body").over(Window.partitionBy(key).orderBy("pos")), r"\.")
    overlap = F.concat(F.trim(F.try_element_at(before, F.lit(-2))), F.lit(". "))
    return parts.select(key, "pos", F.concat(F.coalesce(overlap, F.lit("")), "body").alias("body"))


def paragraph_chunks(df: DataFrame, key: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Paragraphs, each after the last full sentence of the one before."""
    return _overlapped(paragraphs(df, key, text, separator), key)


def residual(parts: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Paragraphs (key, body, and their pos if they have one) whose first 100 characters begin no chunk of the same document."""
    head = lambda d: d.withColumn("_head", F.substring("body", 1, 100))
    return head(parts).join(head(chunks).select(key, "_head"), [key, "_head"], "left_anti").select(*parts.columns)


def structured_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, article, paragraph, hierarchy_path, body): articles, or their numbered paragraphs if there are several, then annexes."""
    groups = lambda c, p, *g: F.arrays_zip(*(F.regexp_extract_all(c, F.lit(p), F.lit(k)).alias(n) for k, n in g))
    found = df.select(key, F.explode(groups(F.col(text), ARTICLE, (1, "number"), (2, "body"))).alias("a")).select(key, F.concat(F.lit("Art. "), "a.number").alias("article"), F.trim(F.regexp_replace("a.body", r"^\s+|\s+$", "")).alias("body"))
    parted = found.withColumn("commas", groups(F.col("body"), COMMA, (1, "n"), (2, "text")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("n"), F.col("body").alias("text")))
    parted = parted.withColumn("c", F.explode(F.when(F.size("commas") > 1, F.col("commas")).otherwise(whole)))
    paragraph = F.concat(F.lit("Comma "), "c.n")
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = parted.select(key, "article", paragraph.alias("paragraph"), F.concat_ws(" > ", "article", paragraph).alias("hierarchy_path"), bare("c.text").alias("body"))
    annexes = df.select(key, F.explode(groups(F.col(text), ANNEX, (1, "name"), (2, "body"))).alias("a")).select(
        key, bare("a.name").alias("article"), F.lit(None).cast("string").alias("paragraph"), bare("a.name").alias("hierarchy_path"), bare("a.body").alias("body")
    )
    return parts.unionByName(annexes.where(F.length("body") > LEAST))


def coverage(df: DataFrame, key: str, text: str, chunks: DataFrame) -> DataFrame:
    """``df`` with ``coverage``: length of a document's joined chunks against that of its text, both without headers and page numbers."""
    from lodestone.functions.text import covered_form

    joined = chunks.groupBy(key).agg(F.array_join(F.collect_list("body"), " ").alias("_got"))
    share = F.length(covered_form(F.coalesce("_got", F.lit("")))) / F.greatest(F.length(covered_form(F.col(text))), F.lit(1))
    return df.join(joined, key, "left").withColumn("coverage", share).drop("_got")


def hybrid_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Structured chunks; where these cover under 70 % of a document's text, the paragraphs that they miss too, numbered and overlapping."""
    chunks = structured_chunks(df, key, text)
    thin = coverage(df, key, text, chunks).where(F.col("coverage") < COVERAGE).select(key, text)
    missed = residual(paragraphs(thin, key, text), chunks, key)
    number = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    added = _overlapped(missed.withColumn("pos", number), key)
    none = F.lit(None).cast("string")
    path = F.concat(F.lit("Paragrafo "), F.col("pos").cast("string"))
    return chunks.unionByName(added.select(key, none.alias("article"), none.alias("paragraph"), path.alias("hierarchy_path"), "body"))


def new_bodies(batch: DataFrame, current: DataFrame, hash_: str, order: str) -> DataFrame:
    """Rows of a batch whose hash isn't current, the first of each hash."""
    from lodestone.operators.relational import new_rows

    return new_rows(batch, current, [hash_], [F.col(order)])


def cyclic_batches(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, batch, body): parts of a text dealt to n batches in turn, all n of them.

    A text is cut at lines that begin an article; if that gives under n parts at blank lines; else into equal slices.
    """
    whole = F.col(text)
    filled = lambda separator: F.filter(F.split(whole, re.escape(separator)), lambda p: p.rlike(r"\S"))
    size = F.greatest(F.lit(1), F.floor(F.length(whole) / n).cast("int"))
    slices = F.when(F.length(whole) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / size).cast("int")), lambda k: F.substring(whole, k * size + 1, size)))
    parts = F.when(F.size("_articles") >= n, F.col("_articles")).when(F.size("_blank") >= n, F.col("_blank")).otherwise(F.coalesce(slices, F.array().cast("array<string>")))
    if n <= 1:
        parts = F.array(whole)
    cut = df.withColumns({"_articles": filled("\nArt."), "_blank": filled("\n\n")}).withColumn("_parts", parts)
    separator = F.when(F.contains(whole, F.lit("Art.")), "\n\nArt.").otherwise("\n\n")
    own = lambda b: F.filter("_parts", lambda _, k: k % max(n, 1) == b)
    dealt = cut.withColumn("_sep", separator).select(key, "_parts", "_sep", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("batch"))
    return dealt.withColumn("_own", own(F.col("batch"))).select(key, "batch", F.expr("array_join(_own, _sep)").alias("body"))


def _found(body: str | None) -> list[tuple[str, str | None, str]]:
    """(target, paragraph, intent) of a body's references, each target and intent once."""
    out: dict[tuple[str, str], str | None] = {}
    text = body or ""
    for m in ART_REF.finditer(text):
        before, after = text[max(0, m.start() - 80) : m.start()], text[m.end() : m.end() + 30]
        intent = "modifica" if CHANGES.search(before) else "attua" if APPLIES.search(before) else "cita"
        comma = COMMA_REF.search(after)
        out.setdefault((f"Art. {m[1].strip()}", intent), comma[1] if comma else None)
    for m in ANNEX_REF.finditer(text):
        out.setdefault((f"Allegato {m[1].strip()}", "cita"), None)
    return [(target, paragraph, intent) for (target, intent), paragraph in out.items()]


def references(chunks: DataFrame, body: str) -> DataFrame:
    """``chunks`` without the body, a row per reference: target, target_paragraph, intent."""
    kind = "array<struct<target string, target_paragraph string, intent string>>"

    @F.pandas_udf(kind)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda b: [dict(zip(("target", "target_paragraph", "intent"), x, strict=True)) for x in _found(b)])

    rest = [c for c in chunks.columns if c != body]
    return chunks.select(*rest, F.explode(find(body)).alias("r")).select(*rest, "r.*")


def ssml(text: Column) -> Column:
    """Spoken text: XML-escaped, its first ten pause marks, in any case and with fractions, as breaks of at most ten seconds."""

    @F.pandas_udf("string")
    def speak(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from xml.sax.saxutils import escape

        for texts in parts:
            yield texts.map(lambda x: None if x is None else "<speak>" + PAUSE.sub(lambda m: f'<break time="{min(float(m[1]), 10.0)}s"/>', escape(x, {'"': "&quot;", "'": "&apos;"}), count=10) + "</speak>")

    return speak(text)
