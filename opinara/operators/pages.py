"""Review records in web pages: containers and their fields, by sets of selectors.

A selector set is compiled to tests of single elements; one pass over a page's tags keeps the
stack of open elements and, beside it, the open containers and the fields that are being
read.  An element that a field's selector names belongs to every open container that has not
got that field yet, so each field is the first in its container, in document order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("text", "reviewer", "rating", "date")

# Selector sets, tried in order; the first one with a container on the page counts.
SELECTOR_SETS = [
    {
        "container": "[itemtype*='Review'], [itemprop='review']",
        "text": "[itemprop='reviewBody'], [itemprop='description']",
        "reviewer": "[itemprop='author']",
        "rating": "[itemprop='ratingValue']",
        "date": "[itemprop='datePublished']",
    },
    {
        "container": ".review, .comment, .feedback-item, li.review",
        "text": ".review-text, .comment-text, .body, p",
        "reviewer": ".reviewer, .author, .username",
        "rating": ".rating, .stars, [data-rating]",
        "date": ".date, time",
    },
]

# Elements without content, and elements whose content is no text.
VOID = set("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
SILENT = {"script", "style", "template"}

#: Pages turned into Python objects at a time.
SLICE = 32
Test = Callable[[str, dict[str, str]], bool]
_PART = re.compile(r"\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$~]?=)(?P<q>['\"]?)(?P<val>[^'\"\]]*)(?P=q))?\]")


def _part(m: re.Match) -> Test:
    if m["cls"]:
        return lambda _, have: m["cls"] in have.get("class", "").split()
    attr, op, want = m["attr"] or "id", m["op"] or ("=" if m["id"] else ""), m["id"] or m["val"] or ""
    held = {
        "": lambda v: True, "=": lambda v: v == want, "*=": lambda v: bool(want) and want in v, "^=": lambda v: bool(want) and v.startswith(want),
        "$=": lambda v: bool(want) and v.endswith(want), "~=": lambda v: want in v.split(),
    }[op]
    return lambda _, have: attr in have and held(have[attr])


def compiled(selector: str | None) -> Test:
    """A test of one element for a list of selectors, each a tag, classes, an id and attributes without
    blanks between them; anything else (combinators, pseudo-classes) raises."""
    choices: list[list[Test]] = []
    for one in (s.strip() for s in re.split(r",(?![^\[]*\])", selector or "")):
        if not one:
            continue
        tag = re.match(r"[A-Za-z][\w-]*|\*|", one).group()
        tests: list[Test] = [lambda name, _, tag=tag.lower(): name == tag] if tag not in ("", "*") else []
        at = len(tag)
        while at < len(one):
            m = _PART.match(one, at)
            if not m:
                raise ValueError(f"unsupported selector: {one!r}")
            tests.append(_part(m))
            at = m.end()
        choices.append(tests)
    return lambda name, have: any(all(t(name, have) for t in tests) for tests in choices)


class _Found:
    """A container: its own text and the texts of its fields, in pieces."""

    def __init__(self):
        self.whole: list[str] = []
        self.fields: dict[str, list[str]] = {}


class _Page(HTMLParser):
    def __init__(self, sets: list[dict[str, Test]]):
        super().__init__(convert_charrefs=True)
        self.sets, self.found = sets, [[] for _ in sets]
        self.stack: list[str] = []
        # what is open, with the depth of its element: containers of each set, and pieces that text goes to
        self.open: list[list[tuple[int, _Found]]] = [[] for _ in sets]
        self.reading: list[tuple[int, list[str]]] = []
        self.said: list[str] = []
        self.silent = 0

    def flush(self):
        text, self.said = "".join(self.said).strip(), []
        if text and not self.silent:
            for _, pieces in self.reading:
                pieces.append(text)

    def handle_starttag(self, tag, attrs):
        self.flush()
        have = {k: v or "" for k, v in attrs}
        depth = len(self.stack) + 1
        for s, tests in enumerate(self.sets):
            if self.open[s]:
                for name in FIELDS:
                    waiting = [c for _, c in self.open[s] if name not in c.fields]
                    if waiting and tests[name](tag, have):
                        pieces: list[str] = []
                        for c in waiting:
                            c.fields[name] = pieces
                        self.reading.append((depth, pieces))
            if tests["container"](tag, have):
                c = _Found()
                self.found[s].append(c)
                self.open[s].append((depth, c))
                self.reading.append((depth, c.whole))
        self.stack.append(tag)
        self.silent += tag in SILENT
        if tag in VOID:
            self.close_to(len(self.stack) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        self.flush()
        # an end tag closes the last open element of its name and what stands in it; without one it says nothing
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == tag:
                return self.close_to(k)

    def close_to(self, k: int):
        self.silent -= sum(t in SILENT for t in self.stack[k:])
        del self.stack[k:]
        self.reading = [x for x in self.reading if x[0] <= k]
        self.open = [[x for x in o if x[0] <= k] for o in self.open]

    def handle_data(self, data):
        self.said.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def _rating(text: str | None) -> float | None:
    """The first number of a text, where it is one from 0 to 5."""
    m = re.search(r"[\d.]+", text or "")
    try:
        value = float(m.group()) if m else None
    except ValueError:
        return None
    return value if value is not None and 0 <= value <= 5 else None


def read(html: str | None, sets: list[dict[str, Test]]) -> tuple[int | None, list[tuple]]:
    """The number of the set that counts, and (text, reviewer, rating, date) of each container, in order."""
    page = _Page(sets)
    page.feed(html or "")
    page.close()
    page.flush()
    chosen = next((s for s, found in enumerate(page.found) if found), None)
    rows = []
    for c in page.found[chosen] if chosen is not None else []:
        text = {name: "".join(c.fields.get(name, [])) or None for name in FIELDS}
        rows.append((text["text"] or "".join(c.whole) or None, text["reviewer"], _rating(text["rating"]), text["date"]))
    return chosen, rows


def records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", selectors: dict[str, str] | None = None) -> DataFrame:
    """(id, selector_set, k, text, reviewer, rating, date) of every container of each page.

    ``selectors`` (container, text, reviewer, rating, date), where given, are the only set.  A
    container without text is a record with a null text; a page without containers has none."""
    given = [selectors] if selectors and selectors.get("container") else SELECTOR_SETS
    for one in given:
        for name in ("container", *FIELDS):
            compiled(one.get(name))  # a bad selector fails here, not in a task

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [{name: compiled(one.get(name)) for name in ("container", *FIELDS)} for one in given]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [(i, *read(html, sets)) for i, html in enumerate(part.column(1).to_pylist())]
                rows = [(i, s, k, *row) for i, s, some in found for k, row in enumerate(some)]
                if rows:
                    i, s, k, *fields = zip(*rows)
                    columns = [part.column(0).take(pa.array(i)), pa.array(s, pa.int32()), pa.array(k, pa.int32()), *(pa.array(f, t) for f, t in zip(fields, (pa.string(), pa.string(), pa.float64(), pa.string())))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "selector_set", "k", *FIELDS])

    typed = pages.schema[id_col].dataType.simpleString()
    got = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html")).mapInArrow(work, f"id {typed}, selector_set int, k int, text string, reviewer string, rating double, date string")
    return got.withColumnRenamed("id", id_col)
