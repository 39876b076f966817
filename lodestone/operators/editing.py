"""Edits of a course's slides, an array of structs with ``idx``, ``module`` and ``title``; every edit numbers them anew."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PROTECTED = ("TITLE", "CLOSING", "MODULE_OPEN", "MODULE_CLOSE")


def renumber(slides: Column) -> Column:
    return F.transform(slides, lambda s, i: s.withField("idx", i.cast("int")))


def merge(slides: Column, at: Column, **fields: Column) -> Column:
    """The slide at a place with some fields replaced."""

    def patched(s: Column, i: Column) -> Column:
        out = s
        for name, value in fields.items():
            out = out.withField(name, value)
        return F.when(i == at, out).otherwise(s)

    return F.transform(slides, patched)


def insert_after(slides: Column, at: Column, new: Column) -> Column:
    """A slide behind another one, in the same module."""
    own = new.withField("module", F.get(slides, at)["module"])
    return renumber(F.concat(F.slice(slides, F.lit(1), at + 1), F.array(own), F.slice(slides, at + 2, F.size(slides))))


def swap_next(slides: Column, at: Column) -> Column:
    """Two neighbours change places, if they are of one module and neither is protected."""
    a, b = F.get(slides, at), F.get(slides, at + 1)
    free = b.isNotNull() & (a["module"] == b["module"]) & ~a["kind"].isin(*PROTECTED) & ~b["kind"].isin(*PROTECTED)
    swapped = F.transform(slides, lambda s, i: F.when(i == at, b).when(i == at + 1, a).otherwise(s))
    return F.when(F.coalesce(free, F.lit(False)), renumber(swapped)).otherwise(slides)


def delete(slides: Column, at: Column) -> Column:
    """Without a slide, unless it is protected or the last one."""
    refused = F.get(slides, at)["kind"].isin(*PROTECTED) | (F.size(slides) <= 1)
    return F.when(F.coalesce(refused, F.lit(False)), slides).otherwise(renumber(F.filter(slides, lambda s, i: i != at)))


def duplicate(slides: Column, at: Column) -> Column:
    one = F.get(slides, at)
    copy = one.withField("title", F.substring(F.concat(one["title"], F.lit(" (copia)")), 1, 200))
    return insert_after(slides, at, copy)


def to_bullets(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def to_body(bullets: Column) -> Column:
    return F.array_join(bullets, "\n")
