"""Main-text extraction by template deduction from equivalence classes of tokens.

The pages of a host come from a few templates.  Tokens are elements with their
place in the document tree, and blocks of text with theirs; a token's occurrence
vector says how often each page of the host has it.

1. Every page is read once, and its tokens are counted over *all* pages of the host:
   pages, occurrences, and a sum of hashes of (page, count) that stands for the
   occurrence vector.  Exact copies of a page count once, and so do pages that agree in
   their longest block, if that is a passage and in no named element: near copies of a text are no template.
2. Tokens with one vector form an equivalence class.  A class is valid if it is
   large (an element counts twice, for its two tags) and frequent.  A token's place
   is part of it, so the tokens of a class nest alike on all pages, and a class lies
   in the innermost element of another that holds its place.  Elements that stand
   once on a page, in a valid class, are the template's elements; blocks of text in
   a valid class, or directly nested into one, are its text if they stand on at
   least nine in ten of the pages that have their place.  What a template element holds
   beside that is its slot, and the mean number of words in it is the slot's weight.
3. Every page is read again beside the template of its host.  The main slot is found
   by going down from the root into the template element that holds nearly all of
   what slots hold, as far as there is one; the tag name only ends the way, at an
   article or main element.  The slot's blocks without the template's text are the
   main text; a heading of the template stays if text that is not the template's goes with it.

Names of elements (``nav``, ``comments``, ...) are a prior: they lower an element's
weight on the way, and an element named so inside the slot is an inset where it is an
element of the template, or holds less than half of the slot's words, or stands beside
sentences without such a name.  A name alone never drops all there is.  Pages that meet no template (a host with
one or two pages) have only their elements: article, else main, else all, without
such insets.

No step gathers the pages of a host.  Counts are combined before each shuffle; a
host's template is bounded by the size of its pages, not by their number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import in_small_batches, stored
from tidewell.llm.markup import HIDDEN, HOLDS, NAMED, STOPS, TITLE, Page, read

#: Text of a template stands on so many pages, and on this share of those that have its place.
FREQUENT, SHARE = 3, 0.9
#: A passage has so many words; copies of a page that share their longest one count once.
PASSAGE = 20
#: A sentence beside a named element has so many words.
SENTENCE = 12
#: A valid class has so many tokens.
LARGE = 3
#: Elements of a template stand on this share of a host's pages, and on two at least.
ELEMENT_SHARE = 0.001
#: An element is gone down into if it holds this share of what slots hold; named ones count less, and are left sooner.
DOMINANT, NAMED_WEIGHT, NAMED_DOMINANT = 0.8, 0.25, 0.5
#: Templates of all hosts together go to every task up to this many tokens; beyond, they meet the pages in a shuffle.
BROADCAST_TOKENS = 1_000_000
#: Pages of a host in one group of that shuffle.
GROUP_PAGES = 4096
#: Repeated contents that are told to every task; beyond, they meet the pages in a shuffle.
BROADCAST_COPIES = 200_000

_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
_ENDS = frozenset(".!?…。！？\"'”’)»")

_COUNTS = "host long, path long, seg long, n long, once long, words long, a long, b long, parent long, flags int"
_TEMPLATE = "host long, groups int, path array<long>, weight array<double>, direct array<double>, element array<boolean>, seg array<long>"
_TEXTS = "page_id long, url string, text string, n_chars long"


def _segment(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}") >> 1 or 1


def tokens(page: Page) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """A page's tokens: places with [occurrences, words below, parent's place, flags], blocks with [occurrences, words, place]."""
    words = [0] * len(page.parent)
    segments: dict[int, list[int]] = {}
    for at, text in page.blocks:
        n = text.count(" ") + 1
        words[at] += n
        key = _segment(page.path[at], text)
        if key in segments:
            segments[key][0] += 1
            segments[key][1] += n
        else:
            segments[key] = [1, n, page.path[at]]
    for at in range(len(words) - 1, 0, -1):
        words[page.parent[at]] += words[at]
    elements: dict[int, list[int]] = {}
    for at, path in enumerate(page.path):
        if page.flags[at] & HIDDEN:
            continue
        if path in elements:
            elements[path][0] += 1
            elements[path][1] += words[at]
        else:
            elements[path] = [1, words[at], page.path[page.parent[at]] if at else 0, page.flags[at]]
    return elements, segments


def passage(page: Page) -> str | None:
    """The longest block of a page outside of named elements; of equal ones the first by code points; None if there is no passage."""
    named = [False] * len(page.parent)
    for at in range(1, len(page.parent)):
        named[at] = named[page.parent[at]] or bool(page.flags[at] & NAMED)
    longest = max(((t.count(" "), len(t), t) for at, t in page.blocks if not named[at]), default=(0, 0, ""))
    return longest[2] if longest[0] + 1 >= PASSAGE else None


def _mixed(page: int, n: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{page}*{n}")


def _count(batches: Iterable[pa.RecordBatch]):
    """Token counts of single pages, in the columns of their sums."""
    for batch in batches:
        out: list[tuple] = []
        for host, key, content in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html")), strict=True):
            elements, segments = tokens(read(content))
            vector = {}
            for path, (n, words, parent, flags) in elements.items():
                v = vector.get(n) or vector.setdefault(n, _mixed(key, n))
                out.append((host, path, 0, 1, int(n == 1), words, v >> 34, v & 0x3FFFFFFF, parent, flags))
            for seg, (n, words, path) in segments.items():
                v = vector.get(n) or vector.setdefault(n, _mixed(key, n))
                out.append((host, path, seg, 1, int(n == 1), words, v >> 34, v & 0x3FFFFFFF, 0, 0))
        columns = list(zip(*out, strict=True)) if out else [[]] * 10
        types = [pa.int64()] * 9 + [pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), types, strict=True)], names=[c.split()[0] for c in _COUNTS.split(", ")])


def deduce(rows: pd.DataFrame) -> dict[str, object]:
    """The template of one host from its frequent tokens, with the size of each token's class.

    ``path`` are the places seen often, from the root down, with the slots' mean
    ``weight`` of words below, ``direct`` words that are in no template element
    further down, and whether a place is an ``element`` of the template; ``seg`` is
    the template's text.
    """
    places = rows[rows["seg"] == 0]
    info = {r.path: r for r in places.itertuples(index=False)}
    valid = {p for p, r in info.items() if r.size >= LARGE and r.n >= 2}
    element = {p for p in valid if info[p].once == info[p].n} | {p for p, r in info.items() if r.parent == 0}
    fixed: dict[int, float] = defaultdict(float)
    seg = []
    for r in rows[rows["seg"] != 0].itertuples(index=False):
        at = info.get(r.path)
        if at is not None and r.n >= max(FREQUENT, SHARE * at.n) and (r.size >= LARGE or r.path in element or at.parent in valid or r.path in valid):
            seg.append(r.seg)
            fixed[r.path] += r.words
    depth: dict[int, int] = {}
    for p in info:
        chain = []
        while p in info and p not in depth:
            chain.append(p)
            p = info[p].parent
        d = depth.get(p, -1)
        for q in reversed(chain):
            depth[q] = d = d + 1
    order = sorted(info, key=lambda p: (-depth[p], p))
    # Words that vary below a place: all, less the template's; named elements count less further up.
    below: dict[int, float] = {}
    less: dict[int, float] = defaultdict(float)
    inner: dict[int, float] = defaultdict(float)
    direct: dict[int, float] = {}
    for p in order:
        r = info[p]
        below[p] = max(0.0, r.words - less[p] - fixed[p])
        direct[p] = max(0.0, below[p] - inner[p])
        counts = below[p] * (NAMED_WEIGHT if r.flags & NAMED else 1.0)
        less[r.parent] += r.words - counts
        inner[r.parent] += counts if p in element else inner[p] * (NAMED_WEIGHT if r.flags & NAMED else 1.0)
    order.reverse()
    return {
        "path": order,
        "weight": [below[p] / info[p].n for p in order],
        "direct": [direct[p] / info[p].n for p in order],
        "element": [p in element for p in order],
        "seg": seg,
    }


class Template:
    """A host's template as a page meets it."""

    def __init__(self, path=(), weight=(), direct=(), element=(), seg=()):
        self.known = set(path)
        self.weight = {p: (w, d) for p, w, d, e in zip(path, weight, direct, element, strict=True) if e}
        self.text = set(seg)

    def slot(self, page: Page) -> int | None:
        """The element of the page that is its main slot; None if the page meets no template."""
        if len(self.weight) < 2:
            return None
        above = [0] * len(page.parent)
        inside: dict[int, list[int]] = defaultdict(list)
        for at in range(1, len(page.parent)):
            up = page.parent[at]
            above[at] = at if page.path[at] in self.weight and not page.flags[at] & HIDDEN else above[up]
            if above[at] == at:
                inside[above[up]].append(at)
        at, met = 0, False
        while True:
            held = [(self.weight[page.path[k]][0] * (NAMED_WEIGHT if page.flags[k] & NAMED else 1), page.path[k], k) for k in inside[at]]
            if not held:
                break
            best, path, to = max(held)
            least = NAMED_DOMINANT if page.flags[to] & NAMED else DOMINANT
            if not page.flags[to] & HOLDS or best <= 0 or best < least * (sum(h[0] for h in held) + self.weight[page.path[at]][1]):
                break
            at, met = to, True
            if page.flags[at] & STOPS:
                break
        return at if met or self.text else None


def _speaks(page: Page, live: list[bool], tops: list[int]) -> bool:
    """Whether some elements hold a sentence that is in no named element below them."""
    free = [False] * len(page.parent)
    for at in range(len(page.parent)):
        free[at] = at in tops or (at > 0 and free[page.parent[at]] and not page.flags[at] & NAMED)
    return any(ok and free[at] and page.kind[at] not in _HEADINGS and t.count(" ") + 1 >= SENTENCE and t[-1] in _ENDS for (at, t), ok in zip(page.blocks, live, strict=True))


def extract(page: Page, template: Template | None = None) -> list[str]:
    """The blocks of a page's main text."""
    slot = template.slot(page) if template else None
    text = template.text if slot is not None else ()
    live = [_segment(page.path[at], t) not in text for at, t in page.blocks] if text else [True] * len(page.blocks)
    words = [0] * len(page.parent)
    for (at, t), ok in zip(page.blocks, live, strict=True):
        words[at] += ok * (t.count(" ") + 1)
    for at in range(len(words) - 1, 0, -1):
        words[page.parent[at]] += words[at]
    # A heading goes with what it stands over.
    live = [ok or (page.kind[at] in _HEADINGS and words[page.parent[at]] > 0) for (at, _), ok in zip(page.blocks, live, strict=True)]
    tops = [0] if slot is None else [slot]
    if slot is None:
        # Without a template the outermost articles, else main elements, that hold any text.
        for kind in ("article", "main"):
            mark = [page.flags[at] & STOPS and page.kind[at] == kind and not page.flags[at] & NAMED and words[at] > 0 for at in range(len(words))]
            found: list[int] = []
            covered = [False] * len(words)
            for at in range(1, len(words)):
                covered[at] = covered[page.parent[at]]
                if mark[at] and not covered[at]:
                    covered[at] = True
                    found.append(at)
            if found:
                tops = found
                break
    whole = sum(words[t] for t in tops)
    spoken = _speaks(page, live, tops)
    # 1: in the slot; 2: beside a template's slot, where only a heading of the first level is text.
    state = [0 if slot is None else 2] * len(words)
    for t in tops:
        state[t] = 1
    ways = set()
    for t in tops:
        while t > 0:
            t = page.parent[t]
            ways.add(t)
    chosen = set(tops)
    for at in range(len(words)):
        if at and at not in chosen:
            up = state[page.parent[at]]
            state[at] = up
            if page.flags[at] & NAMED and at not in ways:
                known = slot is not None and page.path[at] in template.known
                if up != 1 or known or spoken or 2 * words[at] < whole:
                    state[at] = 0
    return [t for (at, t), ok in zip(page.blocks, live, strict=True) if ok and (state[at] == 1 or (state[at] == 2 and page.flags[at] & TITLE))]


def _frequent(counted: DataFrame) -> DataFrame:
    """The tokens that a template can have, with the number of tokens in their class and the pages of their host."""
    pages = counted.where("seg = 0 and parent = 0").select("host", F.col("n").alias("pages"))
    seen = counted.where("n >= 2")
    size = seen.groupBy("host", "n", "a", "b").agg(F.sum(F.when(F.col("seg") == 0, 2).otherwise(1)).alias("size"))
    seen = seen.join(size, ["host", "n", "a", "b"]).join(pages, "host")
    places = seen.where("seg = 0").select("host", "path", F.col("n").alias("place_n"))
    texts = seen.where(f"seg <> 0 and n >= {FREQUENT}").join(places, ["host", "path"]).where(F.col("n") >= SHARE * F.col("place_n")).drop("place_n")
    both = seen.where("seg = 0").unionByName(texts)
    return both.where(F.col("n") >= ELEMENT_SHARE * F.col("pages"))


def templates(pages: DataFrame) -> DataFrame:
    """The template of every host with two different pages or more; ``pages`` has host, key and html."""
    counted = in_small_batches(pages).mapInArrow(_count, _COUNTS)
    total = {c: F.sum(c).alias(c) for c in ("n", "once", "words", "a", "b")}
    counted = counted.groupBy("host", "path", "seg").agg(*total.values(), F.max("parent").alias("parent"), F.max("flags").alias("flags"))
    counted = stored(counted.where("n >= 2"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        groups = -(-int(rows["pages"].iloc[0]) // GROUP_PAGES)
        return pd.DataFrame([{"host": rows["host"].iloc[0], "groups": groups, **deduce(rows)}])

    return stored(_frequent(counted).groupBy("host").applyInPandas(run, _TEMPLATE))


def _texts(pages: list[tuple], template_of) -> pa.RecordBatch:
    out = []
    for page_id, url, host, content in pages:
        text = "\n".join(extract(read(content), template_of(host)))
        out.append((page_id, url, text, len(text)))
    columns = zip(*out, strict=True) if out else [[]] * 4
    types = (pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["page_id", "url", "text", "n_chars"])


def _first_copies(rows: DataFrame) -> DataFrame:
    """One row of each content of a host."""
    copies = rows.groupBy("host", "key").agg(F.min(F.struct("page_id", "url")).alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    copies = stored(copies)
    if copies.count() <= BROADCAST_COPIES:
        copies = F.broadcast(copies)
    both = rows.join(copies, ["host", "key"], "left")
    return both.where(F.col("keep").isNull() | F.struct("page_id", "url").eqNullSafe(F.col("keep"))).select("host", "key", "html")


def _passages(batches: Iterable[pa.RecordBatch]):
    """The hash of each page's passage, null without one."""
    for batch in batches:
        found = [passage(read(content)) for content in batch.column("html").to_pylist()]
        marks = pa.array([None if t is None else xxhash.xxh3_64_intdigest(t) >> 1 for t in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), marks], names=["host", "key", "mark"])


def _first_near_copies(rows: DataFrame) -> DataFrame:
    """One page, that with the least key, of those of a host that share their passage; and all without one."""
    marks = stored(in_small_batches(rows).mapInArrow(_passages, "host long, key long, mark long").where("mark IS NOT NULL"))
    first = marks.groupBy("host", "mark").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    later = marks.join(first, ["host", "mark"]).where("key <> first").select("host", "key").distinct()
    later = stored(later)
    return rows.join(F.broadcast(later) if later.count() <= BROADCAST_COPIES else later, ["host", "key"], "left_anti")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", content: str = "html", broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """The main text of every page.

    Returns ``page_id, url, text, n_chars``, one row per input row: ``text`` joins
    the main blocks in page order by newlines and is empty if there is none,
    ``n_chars`` counts its code points.  A null or empty page gives an empty text;
    pages whose url is null or has no host form a host of their own.  Copies of a
    page on a host count once for its template; rows alike in all columns stay
    repeated, and count as often as they occur.  An empty table gives an empty
    result; other columns do not matter.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.xxhash64(host).alias("host"),
        F.xxhash64(F.col(content).cast("string")).alias("key"),
        F.col(content).cast("string").alias("html"),
    )
    found = templates(_first_near_copies(_first_copies(rows)))
    size = found.agg(F.coalesce(F.sum(F.size("path") + F.size("seg")), F.lit(0))).first()[0]
    rows = rows.drop("key")
    if size <= broadcast_tokens:
        table = found.drop("groups").toArrow()
        fields = [f for f in table.column_names if f != "host"]
        shared = pages.sparkSession.sparkContext.broadcast(table)

        def beside(batches):
            at = {h.as_py(): k for k, h in enumerate(shared.value.column("host"))}
            known: dict[int, Template | None] = {}

            def template_of(host: int) -> Template | None:
                if host not in known:
                    known[host] = Template(**{f: shared.value.column(f)[at[host]].as_py() for f in fields}) if host in at else None
                return known[host]

            for batch in batches:
                yield _texts(list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "html")), strict=True)), template_of)

        return in_small_batches(rows).mapInArrow(beside, _TEXTS)

    # Each group of a host's pages is led by a copy of its template.
    groups = found.select("host", "groups")
    dealt = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_COPIES else groups, "host", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("groups", F.lit(1))).cast("int")).drop("groups")
    lead = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    both = dealt.withColumn("follows", F.lit(True)).unionByName(lead.withColumn("follows", F.lit(False)), allowMissingColumns=True)

    def follow(batches):
        held, template = None, None
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                key = row["host"], row["part"]
                if not row["follows"]:
                    held, template = key, Template(**{f: row[f] for f in ("path", "weight", "direct", "element", "seg")})
                elif key != held:
                    held, template = key, None
                if row["follows"]:
                    ready.append((row["page_id"], row["url"], template, row["html"]))
            yield _texts(ready, lambda t: t)

    both = both.repartition("host", "part").sortWithinPartitions("host", "part", "follows")
    return in_small_batches(both).mapInArrow(follow, _TEXTS)
