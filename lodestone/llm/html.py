"""Main text of web pages by equivalence classes of template tokens.

Tokens are block tags in their place (tag and names of the block and of all blocks around it; blocks that hold others are also told apart
by their number among their like) and whole text nodes in theirs. A token's occurrence vector over the pages of its host is kept as a hash that
partial aggregates can join, so no task gathers a host's pages. Tokens of one host that share a vector and stand in the same slot of the
class around them form an equivalence class; classes that enough pages support are valid and nest into the host's template. Each of its tags
opens a slot, what pages put there. Slots are told apart by what varies in them: the main text is the block, met once a
page, that holds most of the varying words outside links; within it go slots whose text never varies and blocks that are mostly
links. Tags and names break ties: they mark the article among blocks of like volume, and inside it what varies as an article does (comments,
adverts). Pages without the template's main block, and hosts without a valid class (few pages, or no two alike), use their own tags.

Edge cases: null or empty html gives an empty text; a null or odd url belongs to the empty host; pages of a host with
equal html count once; a host whose main text never varies (copies that differ elsewhere) is left to the tags; an empty table gives an empty
table; unclosed and truncated markup is read as far as it goes; columns besides page_id, url and html are not read. No text is cut, however long.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.sources.scratch import written

SUPPORT = 0.5
LEAST_PAGES = 3  # that share all text of a slot in the main text, before it is template
MOST = 0.7  # of the varying words of a block: a block inside it that holds as many is the main text instead
MARKED = 0.3  # of the varying words of a page: an article of as many is the main text
LINKS = 0.5  # of a block's words in links: beyond, it is a list of links
# Tags and names of parts that aren't main text.
RAW = frozenset("script style noscript template textarea title svg iframe select button".split())
ASIDE_TAGS = frozenset("nav footer aside form head menu dialog".split()) | RAW
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ASIDE_NAMES = frozenset(
    """ad ads advert advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs footer
    header masthead sidebar side widget related recommended share sharing social comment comments disqus reply replies respond
    cookie cookies consent notice gdpr popup modal newsletter subscribe subscription login signup search pagination pager""".split()
)
TITLE_NAMES = frozenset("header masthead banner widget".split())  # inside an article these hold its title
TEXT, MARKED_TAG, BESIDE, CONTAINER, HEADING = 1, 2, 4, 8, 16  # flags of a token
VOID = frozenset("br img hr meta link input source track wbr area base col embed param".split())
BLOCKS = frozenset(
    """html head body title header footer nav aside main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td
    th caption blockquote pre figure figcaption form fieldset address details summary hr menu dialog script style noscript template
    textarea svg iframe select button option""".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RECORDS = HEADINGS | frozenset("p li dt dd tr td th pre blockquote figure figcaption caption option hr summary".split())  # not numbered

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|</(?P<close>[a-zA-Z][\w:-]*)[^>]*>|<(?P<open>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


class _Part:
    """An open block: its token, and whether it is beside the main text or inside the article."""

    __slots__ = ("tag", "above", "token", "beside", "main", "marked", "like", "kept")

    def __init__(self, tag: str, attrs: str, above: _Part | None):
        names, role = [], ""
        if "=" in attrs:
            for key, value in NAMES.findall(attrs):
                value = value.strip("\"'").lower()
                if key.lower() == "role":
                    role = value
                else:
                    names += re.split(r"[^a-z0-9]+", value)
        inside = above is not None and above.main
        named = any(x in ASIDE_NAMES and not (inside and x in TITLE_NAMES) for x in names) and tag not in ("html", "body")
        label = tag + "".join(f".{x}" for x in sorted(set(names)) if x)
        if above is not None and tag not in RECORDS:
            above.like[label] = n = above.like.get(label, 0) + 1
            label = f"{label} {n}"
        self.tag, self.above, self.like, self.kept = tag, above, {}, None
        self.token = _hash("tag", str(above.token), label) if above is not None else 0
        self.beside = (above is not None and above.beside) or tag in ASIDE_TAGS or role in ASIDE_ROLES or named or (tag == "header" and not inside)
        self.marked = tag in MAIN or role == "main"
        self.main = inside or self.marked

    def flags(self) -> int:
        return MARKED_TAG * self.marked + BESIDE * self.beside + CONTAINER * (self.tag not in RECORDS) + HEADING * (self.tag in HEADINGS)

    def within(self, main: int, dropped: frozenset[int]) -> bool:
        """Whether the block lies in the main block, and in no dropped one."""
        if self.kept is None:
            around = self.above is not None and self.above.within(main, dropped)
            self.kept = (around or self.token == main) and self.token not in dropped
        return self.kept


def walk(page: str) -> Iterator[tuple[str, _Part, str]]:
    """("tag", part, "") as blocks open, ("text" or, in links, "link", part, raw text) and ("break", part, "") as blocks end."""
    top = _Part("", "", None)
    stack, at, kind = [top], 0, "text"
    for m in MARKUP.finditer(page):
        if m.start() > at:
            yield kind, stack[-1], page[at : m.start()]
        at = m.end()
        if tag := m["open"]:
            tag = tag.lower()
            if tag == "a":
                kind = "link"
            elif tag == "br":
                yield "text", stack[-1], " "
            elif tag == "hr":
                yield "break", stack[-1], ""
            elif tag in BLOCKS:
                kind = "text"  # an unclosed link ends with its block
                ends = CLOSES.get(tag, ())
                while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in ends):
                    stack.pop()
                part = _Part(tag, m["attrs"], stack[-1])
                if not m["attrs"].endswith("/") and tag not in VOID:
                    stack.append(part)
                yield "tag", part, ""
        elif tag := m["close"]:
            tag = tag.lower()
            if tag == "a":
                kind = "text"
            elif tag in BLOCKS:
                kind = "text"
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                yield "break", stack[-1], ""
    if at < len(page):
        yield kind, stack[-1], page[at:]


def _hash(*parts: str) -> int:
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest("\x00".join(parts))
    return h - (1 << 64) if h >= 1 << 63 else h


def _squeeze(text: str) -> str:
    return " ".join(references.unescape(text).split())


def tokens(page: str) -> dict[int, list[int]]:
    """Template tokens of a page: hash -> [the token around it, flags, occurrences, characters outside links, characters in links],
    a tag's characters being those of its own slot."""
    found: dict[int, list[int]] = {}
    for kind, part, text in walk(page):
        if kind == "tag":
            found.setdefault(part.token, [part.above.token, part.flags(), 0, 0, 0])[2] += 1
        elif kind != "break" and (text := _squeeze(text)):
            row = found.setdefault(_hash("text", str(part.token), text), [part.token, TEXT, 0, 0, 0])
            row[2] += 1
            row[4 if kind == "link" else 3] += len(text)
            if part.token in found:
                found[part.token][4 if kind == "link" else 3] += len(text)
    return found


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "token", "above", "flags", "pages", "vector", "most", "plain", "linked"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32()] + [pa.int64()] * 5
    for batch in batches:
        held: dict[tuple, list[int]] = {}
        for host, key, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = tokens(page or "")
            found[0] = [0, 0, 1, 0, 0]  # the page itself
            for token, (above, flags, n, plain, linked) in found.items():
                row = held.setdefault((host, token, above, flags), [0, 0, 0, 0, 0])
                row[0] += 1
                row[1] ^= _hash(str(key), str(n))
                row[2] = max(row[2], n)
                row[3] += plain
                row[4] += linked
        columns = list(zip(*(k + tuple(v) for k, v in held.items()), strict=True)) if held else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, above, flags, pages, vector, most, plain, linked, of_host) of the tokens that enough pages of their host hold: together at
    most 1 / SUPPORT times the tokens of its mean page."""
    kinds = "host string, token long, above long, flags int, pages long, vector long, most long, plain long, linked long"
    # Equal bodies of a host are one page; only those that have copies are moved.
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("key"), "html")
    copied = written(keyed.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1").select("host", "key"), "copied")
    once = keyed.join(copied, ["host", "key"], "left_semi").dropDuplicates(["host", "key"])
    bodies = keyed.join(copied, ["host", "key"], "left_anti").unionByName(once)
    sums = [F.sum(c).alias(c) for c in ("pages", "plain", "linked")]
    found = bodies.mapInArrow(_tokenize, kinds).groupBy("host", "token", "above", "flags").agg(*sums, F.bit_xor("vector").alias("vector"), F.max("most").alias("most"))
    found = written(found.where("pages > 1"), "tokens")
    total = found.where("token = 0").select("host", F.col("pages").alias("of_host"))
    return found.join(total, "host").where(F.col("pages") >= SUPPORT * F.col("of_host"))


def nested(tags: dict[int, dict]) -> dict[int, tuple]:
    """The class of every tag: (vector, pages, slot of the class around it). A block is met on no more pages than the one around it, so
    that one is among ``tags`` too."""
    classes: dict[int, tuple] = {0: (tags[0]["vector"], tags[0]["pages"], None)}

    def of(token: int) -> tuple:
        chain = []
        while token not in classes:
            chain.append(token)
            token = tags[token]["above"]
        for token in reversed(chain):
            row, around = tags[token], classes[tags[token]["above"]]
            same = around[:2] == (row["vector"], row["pages"])
            classes[token] = around if same else (row["vector"], row["pages"], row["above"])
        return classes[token]

    for token in tags:
        of(token)
    return classes


def deduce(rows: list[dict]) -> tuple[int, list[int], list[int]] | None:
    """(main block, dropped blocks, constant texts) of a host's valid tokens; None if they show no main text."""
    tags = {r["token"]: r for r in rows if not r["flags"] & TEXT}
    constant = [r for r in rows if r["flags"] & TEXT and r["above"] in tags]
    if len(tags) < 2:
        return None
    classes = nested(tags)
    inner: dict[int, list[int]] = {t: [] for t in tags}
    for t, r in tags.items():
        if t:
            inner[r["above"]].append(t)
    varying = {t: r["plain"] + r["linked"] for t, r in tags.items()}
    plain = {t: r["plain"] for t, r in tags.items()}
    for r in constant:
        varying[r["above"]] -= r["plain"] + r["linked"]
        plain[r["above"]] -= r["plain"]
    order, at = [0], 0
    while at < len(order):
        order += inner[order[at]]
        at += 1
    prose, moving, linked, words, heads = {}, {}, {}, {}, {}
    for t in reversed(order):  # sums over blocks, innermost first
        prose[t] = 0 if tags[t]["flags"] & BESIDE else plain[t] + sum(prose[x] for x in inner[t])
        moving[t] = varying[t] + sum(moving[x] for x in inner[t])
        linked[t] = tags[t]["linked"] + sum(linked[x] for x in inner[t])
        words[t] = tags[t]["plain"] + tags[t]["linked"] + sum(words[x] for x in inner[t])
        heads[t] = bool(tags[t]["flags"] & HEADING) or any(heads[x] for x in inner[t])
    if not prose[0]:
        return None
    once = lambda t: tags[t]["most"] == 1 and tags[t]["flags"] & CONTAINER and not tags[t]["flags"] & BESIDE and inner[t]
    main = 0
    while step := [t for t in inner[main] if once(t) and prose[t] >= MOST * prose[main]]:
        main = max(step, key=lambda t: (prose[t], t))
    around = [main]
    while around[-1]:
        around.append(tags[around[-1]]["above"])
    marked = [t for t in around if tags[t]["flags"] & MARKED_TAG]
    if not marked:
        marked = [t for t in order if tags[t]["flags"] & MARKED_TAG and once(t) and prose[t] >= MARKED * prose[0]][:1]
    if marked:
        main = marked[-1]
    elif main and not heads[main] and any(tags[t]["flags"] & HEADING for t in inner[tags[main]["above"]]):
        main = tags[main]["above"]  # its title stands beside it
    held, dropped = [main], []
    for t in held:
        for x in inner[t]:
            still = words[x] and not moving[x] and tags[x]["pages"] >= (LEAST_PAGES if marked else 2)
            listed = tags[x]["flags"] & CONTAINER and words[x] and linked[x] > LINKS * words[x]
            if still or listed:
                dropped.append(x)
            else:
                held.append(x)
    # In a block that isn't marked as an article, constant text goes from varying slots too, if a class holds it in its place.
    of_tags = {c[:2] for c in classes.values()}
    texts = [] if marked else [r["token"] for r in constant if r["most"] == 1 and (r["vector"], r["pages"]) in of_tags]
    return main, dropped, texts


def _deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, mains, drops, texts = [], [], [], []
        for host, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (found := deduce(rows)) is not None:
                for column, value in zip((hosts, mains, drops, texts), (host, *found), strict=True):
                    column.append(value)
        lists = pa.list_(pa.int64())
        columns = [pa.array(hosts, pa.string()), pa.array(mains, pa.int64()), pa.array(drops, lists), pa.array(texts, lists)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "main", "dropped", "texts"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, dropped, texts): of each host with a template its main block, the blocks in it that aren't main text, and the
    texts that are part of the template wherever they stand."""
    row = F.struct("token", "above", "flags", "pages", "vector", "most", "plain", "linked")
    gathered = occurrences(pages).groupBy("host").agg(F.collect_list(row).alias("rows"))  # bounded by its mean page
    return gathered.mapInArrow(_deduced, "host string, main long, dropped array<long>, texts array<long>")


def extract(page: str, main: int | None = None, dropped: frozenset[int] = frozenset(), texts: frozenset[int] = frozenset()) -> str:
    """Text of the main block's slots; if there is no template (None) or the page lacks its main block, the page's own tags decide."""
    parts = list(walk(page))
    templated = main is not None and (main == 0 or any(kind == "tag" and part.token == main for kind, part, _ in parts))
    article = any(kind == "tag" and part.main and not part.beside for kind, part, _ in parts)
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held and (text := _squeeze("".join(held))):
            blocks.append(text)
        held.clear()

    for kind, part, text in parts:
        if kind in ("tag", "break"):
            close()
        elif not part.beside and (part.within(main, dropped) if templated else part.main or not article):
            if not (templated and texts) or _hash("text", str(part.token), _squeeze(text)) not in texts:
                held.append(text)
    close()
    return "\n\n".join(blocks)


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: dict[str, tuple] = {}
        texts = []
        for k in range(batch.num_rows):
            page, host, main = (batch.column(c)[k].as_py() for c in (2, 3, 4))
            if main is not None and host not in sets:
                sets[host] = tuple(frozenset(batch.column(c)[k].as_py() or ()) for c in (5, 6))
            texts.append(extract(page or "", main, *sets.get(host, ())))
        sizes = pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    The templates are a written table: the planner broadcasts them if their files are small, and else joins by host,
    where it can split the pages of a hot host.
    """
    known = written(templates(pages), "templates")
    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(known, "host", "left").select("page_id", "url", "html", "host", "main", "dropped", "texts")
    return joined.mapInArrow(_extractor, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
