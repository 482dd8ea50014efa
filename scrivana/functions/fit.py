"""Places and sizes on a page: regions divided in whole pixels, parameters with defaults, texts fitted into boxes.

Widths of texts come from a table of advances (thousandths of the font size for each character), so no font library is
needed; a text is laid out whole or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FITTED = "struct<lines:array<string>,size:int,fault:string>"
TO_FIT = "array<struct<texts:array<string>,budget:int>>"
STRATEGIES = ("shrink", "wrap", "shrink_then_wrap")


def divide(x: Column, width: Column, n: Column, gap: Column) -> Column:
    """``n`` columns (x, width) of a region with gaps between them: widths differ by a pixel at most, wider ones first,
    and the last ends where the region does. No column, or none of a pixel, fails."""
    usable = width - gap * (n - 1)
    each, over = F.floor(usable / n), F.pmod(usable, n)
    place = lambda i: F.struct((x + i * (gap + each) + F.least(i, over)).cast("int").alias("x"), (each + F.when(i < over, 1).otherwise(0)).cast("int").alias("width"))
    columns = F.transform(F.sequence(F.lit(0), n - 1), place)
    return F.when((n >= 1) & (usable >= n), columns).otherwise(F.raise_error(F.lit("a region too narrow for its columns")).cast("array<struct<x:int,width:int>>"))


def divide_widths(x: Column, width: Column, widths: Column, gap: Column) -> Column:
    """Columns of stated widths, side by side with gaps; more than the region holds fails."""
    before = lambda i: F.aggregate(F.slice(widths, F.lit(1), i), F.lit(0), lambda a, w: a + w + gap)
    columns = F.transform(widths, lambda w, i: F.struct((x + before(i)).cast("int").alias("x"), w.cast("int").alias("width")))
    total = F.aggregate(widths, F.lit(0), lambda a, w: a + w) + gap * (F.size(widths) - 1)
    return F.when((F.size(widths) > 0) & (total <= width), columns).otherwise(F.raise_error(F.lit("columns wider than their region")).cast("array<struct<x:int,width:int>>"))


def parameter(block: Column, defaults: Column, key: str, block_key: str | None = None) -> Column:
    """A block's own value (also a null one), else its layout's default, else failure. Both are maps of strings."""
    own = block_key or key
    fail = F.raise_error(F.lit(f"no value for {own} and no default for {key}")).cast("string")
    return F.when(F.map_contains_key(block, own), block[own]).when(F.map_contains_key(defaults, key), defaults[key]).otherwise(fail)


@dataclass(frozen=True)
class Advances:
    """Widths of characters in thousandths of the font size."""

    by_character: dict[str, int]
    other: int = 600

    def of(self, text: str) -> int:
        return sum(self.by_character.get(c, self.other) for c in text)


@dataclass(frozen=True)
class Budget:
    """The box of a field: its width in pixels, the font sizes it may take, its lines, and what gives way first."""

    width: int
    size: int
    least_size: int
    lines: int = 1
    fit: str = "shrink"

    def __post_init__(self):
        if self.fit not in STRATEGIES:
            raise ValueError(f"fit {self.fit!r}; expected one of {STRATEGIES}")


def wrapped(words: list[str], widths: np.ndarray, space: int, room: float) -> list[str] | None:
    """As many words on each line as fit; None if one doesn't fit by itself. Words are never cut."""
    if (widths > room).any():
        return None
    ends = np.cumsum(widths + space)  # where each word ends, its space included
    lines, at = [], 0
    while at < len(words):
        start = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, start + room + space, side="right"))
        lines.append(" ".join(words[at:to]))
        at = to
    return lines


def fitted(text: str, budget: Budget, advances: Advances) -> tuple[list[str] | None, int | None, str | None]:
    """(lines, size, fault): the largest size at which the whole text fits by its budget's strategy."""
    words = text.split(" ")
    widths, space, whole = np.array([advances.of(w) for w in words]), advances.of(" "), advances.of(text)
    least = budget.size if budget.fit == "wrap" else budget.least_size
    for size in range(budget.size, least - 1, -1):
        room = budget.width * 1000 / size
        if whole <= room:
            return [text], size, None
        lines = wrapped(words, widths, space, room) if budget.fit != "shrink" else None
        if lines is not None and len(lines) <= budget.lines:
            return lines, size, None
    return None, None, f"does not fit {budget.width} pixels by {budget.fit}"


def fit_text(text: Column, budget: Budget, advances: Advances) -> Column:
    """(lines, size, fault) of each text; null for null."""

    @arrow_udf(FITTED)
    def run(texts: pa.Array) -> pa.Array:
        found = [None if t.as_py() is None else dict(zip(("lines", "size", "fault"), fitted(t.as_py(), budget, advances))) for t in texts]
        return pa.array(found, pa.struct([("lines", pa.list_(pa.string())), ("size", pa.int32()), ("fault", pa.string())]))

    return run(text)


def fit_lists(asked: Column, budgets: list[Budget], advances: Advances) -> Column:
    """What came of lists of texts, each fitted by the budget that it names by number: an array of arrays of (lines, size,
    fault), null for null. All texts of a page, and of many pages, take one call; equal texts of a batch are fitted once."""

    @arrow_udf(f"array<array<{FITTED}>>")
    def run(pages: pa.Array) -> pa.Array:
        known: dict[tuple[str, int], dict] = {}

        def one(text: str | None, budget: int) -> dict | None:
            if text is not None and (text, budget) not in known:
                known[text, budget] = dict(zip(("lines", "size", "fault"), fitted(text, budgets[budget], advances)))
            return None if text is None else known[text, budget]

        found = [None if page is None else [[one(t, x["budget"]) for t in x["texts"]] if x["texts"] is not None else None for x in page] for page in pages.to_pylist()]
        kind = pa.struct([("lines", pa.list_(pa.string())), ("size", pa.int32()), ("fault", pa.string())])
        return pa.array(found, pa.list_(pa.list_(kind)))

    return run(asked)
