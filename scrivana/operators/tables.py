"""Tables inside transcripts: rendering, tolerant parsing, row alignment, cell comparison."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from functools import wraps
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from scrivana.functions.text import NormalisationPolicy, html_escape, normalised_all

def uncollected(f: Callable) -> Callable:
    """``f`` without the search for cycles: it makes many small lists at a time and no cycles, and the search goes through
    all of them again and again."""

    @wraps(f)
    def run(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return f(*args)
        finally:
            if on:
                gc.enable()

    return run


#: Spans beyond this are cut, as texts come from anywhere.
LARGEST_SPAN = 64
GRID = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))
#: Joins the cells of a row; it can't stand in a cell.
UNIT = "\x1f"

CELL = "struct<text:string,colspan:int,rowspan:int>"


def span_of(value: str | None) -> int:
    """Absent, not a number or below one: 1."""
    try:
        return min(max(int(value.strip()), 1), LARGEST_SPAN) if value is not None else 1
    except ValueError:
        return 1


class Outline(HTMLParser):
    """Tables as rows of raw cells (pieces of text, colspan, rowspan), in the order in which tables open.

    Only where things are open matters: a row needs an open table, a cell an open row, text an open cell. Opening a
    table ends the one around it for good.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[list[str], int, int]]]] = []
        self.rows = self.row = self.text = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.rows, self.row, self.text = [], None, None
            self.tables.append(self.rows)
        elif tag == "tr" and self.rows is not None:
            self.row, self.text = [], None
            self.rows.append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            named = dict(attrs)
            self.text = []
            self.row.append((self.text, span_of(named.get("colspan")), span_of(named.get("rowspan"))))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.text = None
            self.row = self.row if tag in ("td", "th") else None
            self.rows = self.rows if tag != "table" else None

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)


#: The tags of tables, written as any renderer writes them.
TAG = re.compile(r"""<(/?)(td|th|tr|table|thead|tbody)((?: (?:col|row)span=(?:"\w*"|'\w*'|\w+))*)>""")
SPAN = re.compile(r"""(col|row)span=["']?(\w*)""")


def plain_outline(page: str) -> list[list[list[tuple[list[str], int, int]]]] | None:
    """What ``Outline`` finds, by one split, where a page has no other tags than those of ``TAG``; else None."""
    parts = TAG.split(page)
    if page.count("<") != len(parts) // 4:
        return None
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    rows = row = text = None
    each = iter(parts)
    next(each)
    for closing, tag, attributes, data in zip(each, each, each, each):
        if closing:
            if tag in ("td", "th"):
                text = None
            elif tag in ("tr", "table"):
                row = text = None
                rows = rows if tag == "tr" else None
        elif tag in ("td", "th"):
            if row is not None:
                text = []
                if attributes:
                    named = dict(SPAN.findall(attributes))
                    row.append((text, span_of(named.get("col")), span_of(named.get("row"))))
                else:
                    row.append((text, 1, 1))
        elif tag == "tr":
            if rows is not None:
                row, text = [], None
                rows.append(row)
        elif tag == "table":
            rows, row, text = [], None, None
            tables.append(rows)
        if data and text is not None:
            text.append(unescape(data) if "&" in data else data)
    return tables


def lay_out(rows: list[list[tuple[list[str], int, int]]]) -> list[list[str]]:
    """Cell texts by place: spans repeat their text, cells from above come first where they reach down.

    A cell from the first column over the whole width of the first row heads the rows below it: it takes one place.
    """
    from_above: dict[tuple[int, int], str] = {}
    grid: list[list[str]] = []
    width = 0
    for y, row in enumerate(rows):
        out: list[str] = []
        x = 0
        if not from_above and all(wide == tall == 1 for _, wide, tall in row):
            out = ["".join(pieces).strip() for pieces, _, _ in row]
            grid.append(out)
            width = width or len(out)
            continue
        for pieces, wide, tall in [*row, (None, 0, 0)]:
            while (y, x) in from_above:
                out.append(from_above[y, x])
                x += 1
            if pieces is None:
                break
            text = "".join(pieces).strip()
            places = 1 if 0 < width <= wide and x == 0 else wide
            out.extend([text] * places)
            from_above.update({(y + down, x + right): text for down in range(1, tall) for right in range(places)})
            x += wide
        grid.append(out)
        width = width or len(out)
    return grid


def read_tables(page: str) -> list[list[list[str]]]:
    if "<" not in page:
        return []
    found = plain_outline(page)
    if found is None:
        outline = Outline()
        outline.feed(page)
        outline.close()
        found = outline.tables
    return [lay_out(rows) for rows in found]


def nested(pages: list[list[list[list[str]]] | None]) -> pa.Array:
    """Grids as an Arrow array, level by level."""

    def level(lists: list[list]) -> pa.Array:
        return pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32())

    there = [p or [] for p in pages]
    grids = list(chain.from_iterable(there))
    rows = list(chain.from_iterable(grids))
    cells = pa.array(list(chain.from_iterable(rows)), pa.string())
    absent = pa.array([p is None for p in pages])
    whole = pa.ListArray.from_arrays(level(grids), pa.ListArray.from_arrays(level(rows), cells))
    return pa.ListArray.from_arrays(level(there), whole, mask=absent)


@arrow_udf(GRID)
def parse_tables(pages: pa.Array) -> pa.Array:
    """Every table of a page as rows of cell texts; null for null."""
    return nested(uncollected(lambda texts: [None if t is None else read_tables(t) for t in texts])(pages.to_pylist()))


#: Pairs of rows for which two bytes each are held at a time.
HELD_PAIRS = 4 << 20
#: Pairs of rows that plain Python compares sooner than numpy starts.
FEW_PAIRS = 256


def align(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """A shortest edit script between two lists as pairs of positions; None: no counterpart.

    Equal ends are taken off first; among equally short scripts, walking back from the end, a deletion is preferred,
    then an insertion, then a replacement. Lists of more than ``HELD_PAIRS`` pairs are halved where that walk crosses the
    middle of the first, so memory follows the lists' lengths and not their product.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    if n * m <= min(FEW_PAIRS, HELD_PAIRS):
        middle = _walk_back_few(a[head : head + n], b[head : head + m])
        return [(k, k) for k in range(head)] + [(None if i is None else head + i, None if j is None else head + j) for i, j in reversed(middle)] + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    numbers: dict = {}
    x, y = (np.array([numbers.setdefault(v, len(numbers)) for v in part], dtype=np.int64) for part in (a[head : len(a) - tail], b[head : len(b) - tail]))
    middle = []
    todo = [(0, len(x), 0, len(y))]  # the last part first, as the walk goes
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i1 - i0 > 1 and (i1 - i0 + 1) * (j1 - j0 + 1) > HELD_PAIRS:
            half = (i0 + i1) // 2
            at = j0 + _crossing(x[i0:i1], y[j0:j1], half - i0)
            todo += [(i0, half, j0, at), (half, i1, at, j1)]
        else:
            middle += ((None if i is None else head + i0 + i, None if j is None else head + j0 + j) for i, j in _walk_back(x[i0:i1], y[j0:j1]))
    ends = [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    return [(k, k) for k in range(head)] + middle[::-1] + ends


def _next_row(last: np.ndarray, item: int, y: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The next row of the table of distances."""
    best = last + 1
    best[1:] = np.minimum(best[1:], last[:-1] + (y != item))
    return np.minimum.accumulate(best - steps) + steps


def _crossing(x: np.ndarray, y: np.ndarray, half: int) -> int:
    """The column at which the preferred walk back from the end comes to row ``half``: each place of a row takes it over
    from the place that the walk goes on to."""
    steps = np.arange(len(y) + 1)
    last, crossed = steps, steps
    for i in range(1, len(x) + 1):
        row = _next_row(last, x[i - 1], y, steps)
        if i > half:
            deletes = row == last + 1
            inserts = np.zeros(len(row), dtype=bool)
            inserts[1:] = (row[1:] == row[:-1] + 1) & ~deletes[1:]
            above = np.where(deletes, crossed, np.concatenate([crossed[:1], crossed[:-1]]))
            crossed = above[np.maximum.accumulate(np.where(inserts, 0, steps))]
        last = row
    return int(crossed[-1])


def _walk_back(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int | None, int | None]]:
    """The preferred script from its end on."""
    n, m, steps = len(x), len(y), np.arange(len(y) + 1)
    deletes, inserts = np.zeros((2, n + 1, m + 1), dtype=bool)
    inserts[0, 1:], deletes[1:, 0] = True, True
    last = steps
    for i in range(1, n + 1):
        row = _next_row(last, x[i - 1], y, steps)
        deletes[i], inserts[i, 1:] = row == last + 1, row[1:] == row[:-1] + 1
        last = row
    i, j = n, m
    while i or j:
        if deletes[i, j]:
            i -= 1
            yield i, None
        elif inserts[i, j]:
            j -= 1
            yield None, j
        else:
            i, j = i - 1, j - 1
            yield i, j


def _walk_back_few(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """The same for short lists."""
    n, m = len(a), len(b)
    if n == m == 1:
        return [(0, 0)]
    if not n or not m:
        return [(i, None) for i in range(n - 1, -1, -1)] + [(None, j) for j in range(m - 1, -1, -1)]
    cost = [list(range(m + 1))]
    for i, item in enumerate(a):
        last, row = cost[-1], [i + 1]
        for j, other in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (item != other)))
        cost.append(row)
    i, j, out = n, m, []
    while i or j:
        if i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        elif j and cost[i][j] == cost[i][j - 1] + 1:
            j -= 1
            out.append((None, j))
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out


def compare_row(reference: list[str], prediction: list[str]) -> tuple[int, int]:
    """(correct, misplaced) of a pair of rows.

    The width is the reference's; a short prediction is padded with blanks. Misplaced: wrong, not blank, and found
    at another place of the whole predicted row.
    """
    theirs = prediction + [""] * (len(reference) - len(prediction))
    wrong = [i for i, cell in enumerate(reference) if cell != theirs[i]]
    there = set(prediction)
    return len(reference) - len(wrong), sum(reference[i] != "" and reference[i] in there for i in wrong)


FIELDS = ("table_cells_compared", "table_cells_correct", "table_cells_misplaced", "table_rows_missing", "table_rows_spurious", "table_count_ref", "table_count_pred")


#: Characters of pages that are parsed at a time.
HELD_CHARS = 1 << 20
Grids = list[list[list[str]]]


def compare_grids(ref: Grids, pred: Grids) -> tuple[int, ...]:
    """FIELDS of one page: tables are paired by position, rows by alignment, cells by place."""
    compared = correct = misplaced = missing = spurious = 0
    for a, b in zip_longest(ref, pred, fillvalue=[]):
        compared += sum(map(len, a))
        for i, j in align([UNIT.join(row) for row in a], [UNIT.join(row) for row in b]):
            if i is None or j is None:
                missing, spurious = missing + (j is None), spurious + (i is None)
            elif a[i] == b[j]:
                correct += len(a[i])
            else:
                right, moved = compare_row(a[i], b[j])
                correct, misplaced = correct + right, misplaced + moved
    return compared, correct, misplaced, missing, spurious, len(ref), len(pred)


@uncollected
def compare_pages(pairs: list[tuple[str, str]], policy: NormalisationPolicy | None) -> list[tuple[int, ...]]:
    """FIELDS of each pair of pages.

    Cells are normalised after parsing, so an entity counts as its character and no character turns into markup; those
    of all pages together, each distinct one once.
    """
    read = [(read_tables(a), None if a == b else read_tables(b)) for a, b in pairs]
    if policy is not None:
        texts = list({cell for a, b in read if b is not None for cell in chain.from_iterable(chain(*a, *b))})
        form = dict(zip(texts, normalised_all(texts, policy))).__getitem__
        read = [(a, b) if b is None else tuple([[list(map(form, row)) for row in grid] for grid in x] for x in (a, b)) for a, b in read]
    return [compare_grids(a, a if b is None else b) for a, b in read]


def table_fields(reference: Column, prediction: Column, policy: NormalisationPolicy | None = NormalisationPolicy()) -> Column:
    """FIELDS of pages of HTML as a struct; null where either is null."""

    @arrow_udf(T.StructType([T.StructField(name, T.IntegerType()) for name in FIELDS]))
    def fields(references: pa.Array, predictions: pa.Array) -> pa.Array:
        found: list[tuple[int | None, ...]] = [(None,) * len(FIELDS)] * len(references)
        held: list[tuple[int, str, str]] = []
        size = 0

        def settle() -> None:
            for (k, _, _), x in zip(held, compare_pages([(a, b) for _, a, b in held], policy)):
                found[k] = x

        for k, (a, b) in enumerate(zip(references, predictions)):
            a, b = a.as_py(), b.as_py()
            if a is None or b is None:
                continue
            if held and size + len(a) + len(b) > HELD_CHARS:
                settle()
                held, size = [], 0
            held.append((k, a, b))
            size += len(a) + len(b)
        settle()
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.int32()) for k in range(len(FIELDS))], names=list(FIELDS))

    return fields(reference, prediction)


def cell_error_rate() -> Column:
    """Null where the reference has no cells."""
    return F.when(F.col("table_cells_compared") > 0, (F.col("table_cells_compared") - F.col("table_cells_correct")) / F.col("table_cells_compared"))


def score_tables(pages: DataFrame, key: list[str], reference: str, prediction: str, policy: NormalisationPolicy | None = NormalisationPolicy()) -> DataFrame:
    """The eight table fields of each page."""
    rows = pages.select(*key, table_fields(F.col(reference), F.col(prediction), policy).alias("_f")).select(*key, "_f.*")
    return rows.withColumn("table_cell_error_rate", cell_error_rate())


def row_width(cells: Column) -> Column:
    """Columns that a row of cells covers."""
    return F.aggregate(cells, F.lit(0), lambda n, c: n + c["colspan"])


def padded_row(cells: Column, width: int | Column) -> Column:
    """The row with blank cells up to ``width``; a wider row fails."""
    missing = F.lit(width) - row_width(cells) if isinstance(width, int) else width - row_width(cells)
    blank = F.struct(F.lit("").alias("text"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
    return F.when(missing >= 0, F.concat(cells, F.array_repeat(blank, F.greatest(missing, F.lit(0))))).otherwise(F.raise_error(F.lit("the row is wider than its table")).cast(f"array<{CELL}>"))


def render_cell(cell: Column, tag: str) -> Column:
    def attribute(name: str) -> Column:
        return F.when(cell[name] != 1, F.concat(F.lit(f' {name}="'), cell[name].cast("string"), F.lit('"'))).otherwise("")

    return F.concat(F.lit(f"<{tag}"), attribute("colspan"), attribute("rowspan"), F.lit(">"), html_escape(cell["text"]), F.lit(f"</{tag}>"))


def render_row(cells: Column, header: Column) -> Column:
    """A table row; cells owned from above (rowspan 0) are left out."""
    own = F.filter(cells, lambda c: c["rowspan"] > 0)
    return F.concat(F.lit("<tr>"), F.array_join(F.when(header, F.transform(own, lambda c: render_cell(c, "th"))).otherwise(F.transform(own, lambda c: render_cell(c, "td"))), ""), F.lit("</tr>"))


def render_tables(rows: DataFrame, table: list[str], order: str, cells: str = "cells", header: str = "header") -> DataFrame:
    """(table, html): header rows in a head, the rest in a body; a table without header rows gets a blank one."""
    drawn = rows.withColumn("_html", render_row(F.col(cells), F.col(header)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(header).alias("h"), F.col("_html").alias("html"))))
    whole = drawn.groupBy(*table).agg(parts.alias("_parts"), F.max(row_width(F.col(cells))).alias("_width"))

    def joined(head: bool) -> Column:
        return F.array_join(F.transform(F.filter("_parts", lambda x: x["h"] == head), lambda x: x["html"]), "")

    blank = F.concat(F.lit("<tr>"), F.repeat(F.lit("<th></th>"), F.col("_width")), F.lit("</tr>"))
    head = F.when(F.exists("_parts", lambda x: x["h"]), joined(True)).otherwise(blank)
    return whole.select(*table, F.concat(F.lit("<table><thead>"), head, F.lit("</thead><tbody>"), joined(False), F.lit("</tbody></table>")).alias("html"))


def header_faults(rows: DataFrame, table: list[str], order: str, cells: str = "cells", header: str = "header") -> DataFrame:
    """Tables whose header rows aren't the first rows, or differ in width."""
    body = F.min(F.when(~F.col(header), F.col(order)))
    head = F.max(F.when(F.col(header), F.col(order)))
    widths = F.count_distinct(F.when(F.col(header), row_width(F.col(cells))))
    found = rows.groupBy(*table).agg(head.alias("last_header"), body.alias("first_body"), widths.alias("widths"))
    return found.where((F.col("last_header") > F.col("first_body")) | (F.col("widths") > 1))
