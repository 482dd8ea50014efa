"""Projections of page events: transcripts, layout annotations, and tables captured as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivana.functions.text import joined_pair

# Block kinds, and the category each drawn block gets.
TEXT_KINDS = ("title", "line", "pair")
STRUCTURE = ("panel_open", "panel_close", "split_open", "split_close", "column_open", "column_close")
TABLE_KINDS = ("table_open", "row_open", "cell", "cell_sub_line", "row_close", "table_close")
CATEGORIES = {"text": "text_block", "pair": "text_block", "block": "text_block", "banner": "title", "table": "table", "rule": None, "spacer": None, "panel": None, "split": None}


def block_text(kind: Column, text: Column, label: Column, value: Column) -> Column:
    """What a text event adds to a transcript; null for structure; an unknown kind fails."""
    known = [*TEXT_KINDS, *STRUCTURE, *TABLE_KINDS]
    return F.when(kind == "title", F.concat(F.lit("# "), text)).when(kind == "line", text).when(kind == "pair", joined_pair(label, value)).when(~kind.isin(known), F.raise_error(F.concat(F.lit("unknown event kind "), kind)))


def transcripts(blocks: DataFrame, page: list[str], order: str, text: str) -> DataFrame:
    """(page, transcript): blocks in order, a blank line between them; nulls add nothing. Texts stay as captured."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return blocks.groupBy(*page).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("transcript"))


def table_numbers(events: DataFrame, page: list[str], seq: str = "seq", kind: str = "kind") -> DataFrame:
    """Events with the numbers of the table and row they stand in (from 1), and null outside tables."""
    upto = Window.partitionBy(*page).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.count_if(F.col(kind) == "table_open").over(upto)
    closed = F.count_if((F.col(kind) == "table_close")).over(Window.partitionBy(*page).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    inside = opened > F.coalesce(closed, F.lit(0))
    return events.withColumns({"table_no": F.when(inside, opened), "row_no": F.when(inside, F.count_if(F.col(kind) == "row_open").over(upto))})


def unbalanced(events: DataFrame, page: list[str], kind: str = "kind") -> DataFrame:
    """Pages whose opening and closing events don't match in number."""
    pairs = [("table_open", "table_close"), ("row_open", "row_close"), ("panel_open", "panel_close"), ("split_open", "split_close"), ("column_open", "column_close")]
    balance = [(F.count_if(F.col(kind) == a) - F.count_if(F.col(kind) == b)).alias(a) for a, b in pairs]
    return events.groupBy(*page).agg(*balance).where(" or ".join(f"{a} <> 0" for a, _ in pairs))


def table_rows(events: DataFrame, page: list[str], seq: str = "seq", sub_line_join: str = "\n", newline_join: str = "\n") -> DataFrame:
    """(page, table_no, row_no, header, cells): captured cells by row, sub-lines folded into their column's cell.

    ``sub_line_join`` stands between a cell and its sub-lines, ``newline_join`` for line ends inside any of them, as the
    serialisation policy says. A sub-line joins the cell of its column in the same row, or in the row before where its own row has none.
    """
    numbered = table_numbers(events, page, seq).where(F.col("kind").isin("cell", "cell_sub_line"))
    table = [*page, "table_no"]
    cell = F.struct(F.col(seq).alias("_seq"), "column_key", "text", F.col("colspan").cast("int").alias("colspan"), F.col("rowspan").cast("int").alias("rowspan"))
    line = F.struct(F.col(seq).alias("_line"), F.col("text").alias("_sub"), "column_key")
    is_cell = F.col("kind") == "cell"
    rows = numbered.groupBy(*table, "row_no").agg(
        F.bool_or(F.when(is_cell, F.col("header"))).alias("header"), F.collect_list(F.when(is_cell, cell)).alias("_cells"), F.collect_list(F.when(~is_cell & F.col("table_no").isNotNull(), line)).alias("_lines"))
    # a page is put together once: its rows stay where its events are, and a row asks the next one for sub-lines without a cell
    after = Window.partitionBy(*table).orderBy("row_no")
    homeless = F.filter("_lines", lambda s: ~F.exists("_cells", lambda c: F.coalesce(c["column_key"] == s["column_key"], F.lit(False))))
    follows = F.lead("row_no").over(after) == F.col("row_no") + 1
    rows = rows.withColumn("_homeless", homeless).withColumn("_subs", F.array_sort(F.concat("_lines", F.when(follows, F.lead("_homeless").over(after)).otherwise(F.slice("_lines", 1, 0)))))

    def folded(c: Column) -> Column:
        own = F.filter("_subs", lambda s: s["column_key"] == c["column_key"])
        text = F.concat(c["text"], F.array_join(F.transform(own, lambda s: F.concat(F.lit(sub_line_join), s["_sub"])), ""))
        text = F.replace(text, F.lit("\n"), F.lit(newline_join)) if newline_join != "\n" else text
        return F.struct(text.alias("text"), c["colspan"].alias("colspan"), c["rowspan"].alias("rowspan"))

    return rows.where(F.size("_cells") > 0).select(*table, "row_no", "header", F.transform(F.array_sort("_cells"), folded).alias("cells"))


def bounding_box(polygons: Column) -> Column:
    """Eight numbers (four corners) around all polygons of eight numbers."""
    xs = F.flatten(F.transform(polygons, lambda p: F.filter(p, lambda v, i: i % 2 == 0)))
    ys = F.flatten(F.transform(polygons, lambda p: F.filter(p, lambda v, i: i % 2 == 1)))
    left, right, top, bottom = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.array(left, top, right, top, right, bottom, left, bottom)


def box_holds(polygon: Column) -> Column:
    """No negative corner, and an area."""
    return (F.array_min(polygon) >= 0) & (F.element_at(polygon, 3) > F.element_at(polygon, 1)) & (F.element_at(polygon, 6) > F.element_at(polygon, 2))


def layout_annotations(events: DataFrame, page: list[str], html: DataFrame | None = None) -> DataFrame:
    """(page, layout_dets): events with a category and drawn spans, nulls of order last; tables carry their HTML and no spans."""
    drawn = events.where(F.col("category_type").isNotNull() & (F.size("spans") > 0))
    w = Window.partitionBy(*page).orderBy("seq")
    drawn = drawn.withColumn("anno_id", (F.row_number().over(w) - 1).cast("int"))
    is_table = F.col("category_type") == "table"
    if html is not None:
        drawn = drawn.withColumn("table_no", F.when(is_table, F.count_if(is_table).over(w)))
        drawn = drawn.join(html, [*page, "table_no"], "left")
    else:
        drawn = drawn.withColumn("html", F.lit(None).cast("string"))
    record = F.struct("category_type", bounding_box(F.transform("spans", lambda s: s["poly"])).alias("poly"), "anno_id", "order", "text", "html", F.lit(False).alias("ignore"), F.when(~is_table, F.col("spans")).alias("line_with_spans"))
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col("order").isNull().alias("_last"), F.col("order").alias("_order"), F.col("anno_id").alias("_id"), F.to_json(record).alias("json"))))
    return drawn.groupBy(*page).agg(F.transform(sorted_rows, lambda x: x["json"]).alias("layout_dets"))


#: What a walk over a page logs: scopes that open and close, events that are emitted, texts that are drawn.
LOG_OPS = ("block_open", "block_close", "decoration_open", "decoration_close", "emit", "draw")


def _scoped(log: DataFrame, page: list[str]) -> DataFrame:
    """The log with, at each row, the event that a draw there belongs to (``_event``) and whether it is decoration.

    A block starts without an event and without decoration, and what held before comes back when it closes; so each row
    asks its own block only: the latest opening at its depth tells which block that is.
    """
    upto = Window.partitionBy(*page).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    closing = (F.col("op") == "block_close").cast("int")
    depth = F.count_if(F.col("op") == "block_open").over(upto) - F.count_if(F.col("op") == "block_close").over(upto) + closing
    rows = log.withColumn("_depth", depth)
    level = Window.partitionBy(*page, "_depth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_block", F.coalesce(F.last(F.when(F.col("op") == "block_open", F.col("at")), ignorenulls=True).over(level), F.lit(-1)))
    own = Window.partitionBy(*page, "_depth", "_block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.count_if(F.col("op") == "decoration_open").over(own) - F.count_if(F.col("op") == "decoration_close").over(own)
    return rows.withColumns({"_event": F.last(F.when(F.col("op") == "emit", F.col("at")), ignorenulls=True).over(own), "_decoration": opened > 0})


def captured(log: DataFrame, page: list[str]) -> DataFrame:
    """(page, seq, kind, text, category_type, order, spans, poly) of the events that a walk emitted, with what was drawn for each.

    log: (page, at, op of LOG_OPS, kind, text, category_type, poly). Decoration is ink without an event; an event's poly
    is the box around its spans.
    """
    rows = _scoped(log, page)
    drawn = rows.where((F.col("op") == "draw") & ~F.col("_decoration") & F.col("_event").isNotNull())
    spans = drawn.groupBy(*page, "_event").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text", "poly"))), lambda x: F.struct(x["text"].alias("text"), x["poly"].alias("poly"))).alias("spans"))
    w = Window.partitionBy(*page).orderBy("at")
    emitted = log.where("op = 'emit'").withColumns({
        "seq": (F.row_number().over(w) - 1).cast("int"),
        "order": F.when(F.col("category_type").isNotNull(), F.count("category_type").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"),
    })
    both = emitted.withColumn("_event", F.col("at")).join(spans, [*page, "_event"], "left")
    box = F.when(F.col("spans").isNotNull(), bounding_box(F.transform("spans", lambda s: s["poly"])))
    none = F.array().cast(dict(spans.dtypes)["spans"])
    return both.select(*page, "seq", "kind", "text", "category_type", "order", F.coalesce("spans", none).alias("spans"), box.alias("poly"))


def uncovered(log: DataFrame, page: list[str]) -> DataFrame:
    """Draws that no event of their block allows and that aren't decoration: ink that a transcript would omit."""
    rows = _scoped(log, page)
    return rows.where((F.col("op") == "draw") & ~F.col("_decoration") & F.col("_event").isNull()).select(*page, "at", "text")
