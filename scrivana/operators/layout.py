"""Layout bodies compiled to expressions: what a page's blocks say, as events, without drawing anything.

A body is a small tree of configuration, so it is compiled once on the driver into one array expression over
``fields`` (a map of strings); every page of the layout is then expanded by the executors, without a shuffle.

Blocks: text, banner (title), pair, block, rule, spacer, panel, split, table. ``when`` names a field that must be
present. Tables take rows from parallel pipe lists or from a row provider, with grouping none, inline (repeated dates
blanked) or dedicated_row (a band row where the date changes; a leading synthetic row stands below the first band),
header groups over the labels, sub-lines below a cell, and one column merged over runs of equal values.

Blocks are measured first: texts with a budget are fitted, all texts of a page in one call, and every event says how far
what follows stands below it. Then one prefix scan over a page's heights places all of them: x and width of their region
and y from the page's ``top``, in whole pixels, by the line advances, heights, paddings and gaps of ``defaults``. Columns
of a split begin at one height, and what follows stands below the longest. A text that can't be fitted fails.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.fit import FITTED, TO_FIT, Advances, Budget, fit_lists
from scrivana.functions.lists import interpolate, is_present, let, sums_before
from scrivana.functions.providers import PROVIDERS, listed
from scrivana.functions.values import format_amount, long_date
from scrivana.operators.events import CATEGORIES
from scrivana.sources.config import ConfigError

EVENT = "struct<kind:string,text:string,label:string,value:string,column_key:string,header:boolean,colspan:int,rowspan:int,category:string,x:int,width:int,y:int,lines:int,size:int>"
EVENTS = f"array<{EVENT}>"

REQUIRED = {"text": set(), "banner": set(), "pair": {"label", "field"}, "block": {"lines"}, "rule": set(), "spacer": set(), "panel": {"children"}, "split": {"columns"}, "table": {"columns"}}
OPTIONAL = {
    "text": {"content", "from_layout", "title", "suppress_if_equals", "role", "budget"},
    "banner": {"content", "from_layout", "role"},
    "pair": {"currency", "value_align", "separator", "role", "budget", "min_gap"},
    "block": {"heading", "role"},
    "rule": set(),
    "spacer": {"height"},
    "panel": {"padding", "height"},
    "split": {"gap", "widths"},
    "table": {"rows", "provider", "params", "grouping", "group_key", "header", "header_groups", "span_key"},
}
GROUPINGS = ("none", "inline", "dedicated_row")
COLUMN_KEYS = {"key", "label", "budget", "currency", "sub_line"}


def event(kind: str | None, text: Column | str | None = None, category: str | None = None, **more: Column | str | bool | int | None) -> Column:
    def at(value, of: str) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast(of)

    return F.struct(
        F.lit(kind).cast("string").alias("kind"), at(text, "string").alias("text"), at(more.get("label"), "string").alias("label"), at(more.get("value"), "string").alias("value"),
        at(more.get("column_key"), "string").alias("column_key"), at(more.get("header"), "boolean").alias("header"), at(more.get("colspan"), "int").alias("colspan"),
        at(more.get("rowspan"), "int").alias("rowspan"), F.lit(category).cast("string").alias("category"),
        *(at(more.get(k), "int").alias(k) for k in ("x", "width", "y", "lines", "size")),
    )


def several(*events: Column) -> Column:
    return F.array(*events).cast(EVENTS)


def nothing() -> Column:
    return F.array().cast(EVENTS)


#: Pixels of a line, a row, a rule and a spacer where a layout's defaults say nothing.
ADVANCE = 20


def space(height: Column | int) -> Column:
    """Room without an event; it goes once everything is placed."""
    return several(event(None, y=height))


def height_of(events: Column) -> Column:
    return F.aggregate(events, F.lit(0), lambda a, e: a + e["y"])


class Body:
    """Compiles the blocks of one layout. Until events are placed their y is a height: how far the next one stands below.

    ``to_fit`` collects (texts, budget) to be fitted beforehand; ``measured`` holds what came of them, in the same order.
    """

    def __init__(self, layout: dict, fields: Column, measured: Column):
        self.layout, self.fields, self.measured, self.defaults = layout, fields, measured, layout.get("defaults") or {}
        self.to_fit: list[tuple[Column, Budget]] = []

    def said(self, template: str) -> Column:
        return interpolate(F.lit(template), self.fields)

    def advance(self, b: dict, default_role: str = "role") -> int:
        role = b.get("role", self.defaults.get(default_role, "body"))
        return (self.defaults.get("line_advance") or {}).get(role, ADVANCE)

    def fit(self, texts: Column, budget: str) -> Column:
        """(lines, size, fault) of each text."""
        box = self.layout["field_budgets"][budget]
        size = box.get("size", DEFAULT_SIZE)
        self.to_fit.append((texts, Budget(box["width"], size, box.get("least_size", size), box.get("lines", 1), box.get("fit", "shrink"))))
        return self.measured[len(self.to_fit) - 1]

    def fitted_one(self, text: Column, b: dict) -> tuple[Column | int, Column | int | None]:
        """(lines, size) of a block's text."""
        if "budget" not in b:
            return 1, None
        f = self.fit(F.array(text), b["budget"])[0]
        return lines_of(f), f["size"]

    def blocks(self, blocks: list[dict], x: int, width: int) -> Column:
        parts = [self.block(b, x, width) for b in blocks]
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else nothing()

    def block(self, b: dict, x: int, width: int) -> Column:
        out = getattr(self, "of_" + b["type"])(b, x, width)
        return only_if(is_present(self.fields[b["when"]]), out) if "when" in b else out

    def content(self, b: dict) -> Column:
        return F.lit(self.layout[b["from_layout"]]) if "from_layout" in b else self.said(b["content"])

    def of_text(self, b: dict, x: int, width: int) -> Column:
        text = self.content(b)
        lines, size = self.fitted_one(text, b)
        more = {"x": x, "width": width, "y": lines * self.advance(b), "lines": lines, "size": size}
        one = several(event("title", text, "title", **more) if b.get("title") else event("line", text, CATEGORIES["text"], **more))
        if "suppress_if_equals" in b:
            return only_if((text != "") & (text != self.layout[b["suppress_if_equals"]]), one)
        return one

    def of_banner(self, b: dict, x: int, width: int) -> Column:
        return several(event("title", self.content(b), CATEGORIES["banner"], x=x, width=width, y=self.advance(b, "banner_role"), lines=1))

    def of_pair(self, b: dict, x: int, width: int) -> Column:
        value = F.when(is_present(self.fields[b["field"]]), self.fields[b["field"]]).otherwise("")
        if b.get("currency"):
            value = F.when(value == "", value).otherwise(format_amount(F.regexp_replace(value, ",", "").try_cast("decimal(18,2)")))
        lines, size = self.fitted_one(value, b)
        more = {"x": x, "width": width, "y": lines * self.advance(b), "lines": lines, "size": size}
        return several(event("pair", None, CATEGORIES["pair"], label=b["label"] + b.get("separator", ":"), value=value, **more))

    def of_block(self, b: dict, x: int, width: int) -> Column:
        lines = ([b["heading"]] if b.get("heading") else []) + list(b["lines"])
        return several(*(event("line", self.said(t), CATEGORIES["block"], x=x, width=width, y=self.advance(b), lines=1) for t in lines))

    def of_rule(self, b: dict, x: int, width: int) -> Column:
        return space(self.defaults.get("rule_height", ADVANCE))

    def of_spacer(self, b: dict, x: int, width: int) -> Column:
        return space(b.get("height", self.defaults.get("spacer_height", ADVANCE)))

    def of_panel(self, b: dict, x: int, width: int) -> Column:
        padding = b.get("padding", self.defaults.get("panel_padding", 0))
        opened, closed = (several(event(kind, x=x, width=width, y=y)) for kind, y in (("panel_open", padding), ("panel_close", 0)))
        inside = self.blocks(b["children"], x + padding, width - 2 * padding)
        rest = (lambda p: b["height"] - padding - height_of(p)) if b.get("height") is not None else (lambda p: F.lit(padding))
        return let(inside, lambda p: F.concat(opened, p, space(rest(p)), closed))

    def of_split(self, b: dict, x: int, width: int) -> Column:
        n, gap = len(b["columns"]), b.get("gap", self.defaults.get("split_gap", 0))
        each, over = divmod(width - gap * (n - 1), n)
        widths = b.get("widths") or [each + (i < over) for i in range(n)]
        columns, at = [], x
        for column, own in zip(b["columns"], widths):
            place = {"x": at, "width": own}
            inside, opened = self.blocks(column["children"], at, own), several(event("column_open", y=0, **place))
            columns.append(let(inside, lambda p, opened=opened, place=place: F.concat(opened, p, several(event("column_close", y=height_of(p), **place)))))
            at += own + gap
        place = {"x": x, "width": width}
        return let(
            F.array(*columns),
            lambda all_: F.concat(
                several(event("split_open", value=str(n), y=0, **place)), F.flatten(F.transform(all_, returning)),
                space(F.array_max(F.transform(all_, lambda p: F.element_at(p, -1)["y"]))), several(event("split_close", y=0, **place)),
            ),
        )

    def rows(self, b: dict) -> Column:
        """A table's rows: an array of structs with a field for each key, and ``synthetic``."""
        if "provider" in b:
            return PROVIDERS[b["provider"]](self.fields, **(b.get("params") or {}))
        return F.transform(listed(self.fields, b["rows"]), lambda r: F.struct(*(r[k].alias(k) for k in b["rows"]), F.lit(False).alias("synthetic")))

    def of_table(self, b: dict, x: int, width: int) -> Column:
        columns, place = b["columns"], {"x": x, "width": width}
        grouping, group, span = b.get("grouping", "none"), b.get("group_key"), b.get("span_key")
        step, line_step = self.defaults.get("row_height", ADVANCE), self.defaults.get("cell_line_advance", ADVANCE)
        money = {c["key"] for c in columns if c.get("currency")}
        value = lambda r, key: shown(r[key], key in money)
        rows = self.rows(b)
        texts = lambda key: F.transform(rows, lambda r: value(r, key))
        fits = {c["key"]: self.fit(texts(c["key"]), c["budget"]) for c in columns if "budget" in c}

        def drawn_row(cells: list[Column], height: Column | int) -> Column:
            return F.concat(several(event("row_open", y=0, **place)), *cells, several(event("row_close", y=height, **place)))

        def cell(text: Column | str, key: str | None, header: bool = False, **more) -> Column:
            return several(event("cell", text, column_key=key, header=header, y=0, **{"colspan": 1, "rowspan": 1, **place, **more}))

        def sub_line(r: Column, c: dict) -> tuple[Column, Column]:
            """The sub-line of a column, drawn from its row's top and then back up there, and what it adds to the row."""
            line, text = c["sub_line"], r[c["sub_line"]["key"]]
            down = line.get("offset_y", line_step)
            drawn = F.concat(space(down), several(event("cell_sub_line", text, column_key=c["key"], y=-down, **place)))
            return only_if(is_present(text), drawn), F.when(is_present(text), line.get("height", line_step)).otherwise(0)

        def drawn(all_: Column) -> Column:
            before = lambda i: F.try_element_at(all_, F.when(i > 0, i))  # the row above row i (from 0)

            def changes(r: Column, i: Column) -> Column:
                above = before(i)
                return ~r["synthetic"] & (above.isNull() | above["synthetic"] | ~r[group].eqNullSafe(above[group]))

            def row(r: Column, i: Column) -> Column:
                cells, lines, under = [], [F.lit(1), F.lit(1)], [F.lit(0), F.lit(0)]
                for c in columns:
                    key, text = c["key"], value(r, c["key"])
                    if grouping != "none" and key == group:
                        text = F.lit("") if grouping == "dedicated_row" else F.when(changes(r, i), text).otherwise("")
                    more = {"lines": 1}
                    if key in fits:
                        f = F.get(fits[key], i)
                        more = {"lines": lines_of(f), "size": f["size"]}
                        lines.append(more["lines"])
                    if key == span:
                        one = F.get(runs, i)
                        cells.append(only_if(one > 0, cell(text, key, rowspan=one, **more)))
                    else:
                        cells.append(cell(text, key, **more))
                for c in columns:
                    if "sub_line" in c:
                        events, adds = sub_line(r, c)
                        cells.append(events)
                        under.append(adds)
                body = drawn_row(cells, step + (F.greatest(*lines) - 1) * line_step + F.greatest(*under))
                if grouping != "dedicated_row":
                    return body
                leads = (i == 0) & r["synthetic"]  # a leading synthetic row goes below the first band
                dated = F.when(leads, F.try_element_at(all_, F.lit(2))[group]).otherwise(r[group])
                opens = F.when(leads, F.size(all_) > 1).when((i == 1) & before(i)["synthetic"], False).otherwise(changes(r, i))
                band = F.concat(only_if(i > 0, space(self.defaults.get("group_gap", 0))), drawn_row([cell(long_date(dated), None, colspan=len(columns))], step))
                return F.when(opens, F.concat(band, body)).otherwise(body)

            runs = run_lengths(all_, span) if span else None
            return F.flatten(F.transform(all_, row)).cast(EVENTS)

        head = []
        if groups := b.get("header_groups"):
            head.append(drawn_row([cell(g["label"], g["span"][0], True, colspan=len(g["span"])) for g in groups], self.defaults.get("header_group_height", step)))
        if b.get("header", True):
            head.append(drawn_row([cell(c["label"], c["key"], True) for c in columns], step))
        opened, closed = several(event("table_open", None, CATEGORIES["table"], y=0, **place)), several(event("table_close", y=0, **place))
        return F.concat(opened, *head, let(rows, drawn), closed)


def only_if(there: Column, events: Column) -> Column:
    return F.when(there, events).otherwise(nothing())


def returning(column: Column) -> Column:
    """A split's column that ends where it began: its closing event takes the column's height back."""
    return F.transform(column, lambda e, i: e.withField("y", F.when(i == F.size(column) - 1, -e["y"]).otherwise(e["y"])))


def lines_of(fit: Column) -> Column:
    """How many lines a fitted text takes; one that doesn't fit fails, an absent one takes one."""
    fault = F.raise_error(F.concat(F.lit("text "), fit["fault"])).cast("int")
    return F.when(fit["fault"].isNotNull(), fault).otherwise(F.coalesce(F.size(fit["lines"]), F.lit(1)))


def shown(value: Column, money: bool) -> Column:
    """What a cell says: nothing for an absent value, amounts as currency."""
    said = F.when(is_present(value.cast("string")), value.cast("string")).otherwise("")
    return F.when(said == "", said).otherwise(format_amount(F.regexp_replace(said, "[$,]", "").try_cast("decimal(18,2)"))) if money else said


def run_lengths(rows: Column, key: str) -> Column:
    """For each row the length of the run of equal values that it begins, 0 inside a run. Synthetic rows stand alone.

    Runs are found from the last row up, each row adding one to the run below it, so the work is that of one pass.
    """
    joins = lambda r, i: ~r["synthetic"] & F.coalesce(~F.try_element_at(rows, F.when(i > 0, i))["synthetic"], F.lit(False)) & r[key].eqNullSafe(F.try_element_at(rows, F.when(i > 0, i))[key])
    starts = lambda marks: F.filter(F.transform(marks, lambda m, i: F.when(~m, i)), lambda p: p.isNotNull())
    ends = lambda s, n: F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.array(n))
    spread = lambda s, n: F.flatten(F.zip_with(s, ends(s, n), lambda a, z: F.concat(F.array(z - a), F.array_repeat(F.lit(0), z - a - 1))))
    found = let(F.transform(rows, joins), lambda marks: let(starts(marks), lambda s: spread(s, F.size(marks))))
    return F.when(F.size(rows) > 0, found).otherwise(F.array().cast("array<int>"))


#: Font size of a budget that names none.
DEFAULT_SIZE = 12


def compiled(layout: dict, fields: Column, measured: Column) -> tuple[Column, list[tuple[Column, Budget]]]:
    """(events with heights, texts to be fitted with their budgets) of a page of this layout."""
    body = Body(layout, fields, measured)
    return body.blocks(layout["body"], layout.get("left", 0), layout.get("content_width", 0)), body.to_fit


def placed(events: Column, top: Column) -> Column:
    """Events whose heights have become places below ``top``; bare room goes."""
    at = lambda all_: F.zip_with(all_, sums_before(F.transform(all_, lambda e: e["y"])), lambda e, y: e.withField("y", (y + top).cast("int")))
    return F.filter(let(events, at), lambda e: e["kind"].isNotNull())


def expand(entries: DataFrame, layouts: dict[str, dict], keep: list[str], advances: Advances = Advances({})) -> DataFrame:
    """(keep, seq, event columns) of every entry whose layout is known; its ``fields`` are a map of strings."""
    body, top, texts, budgets = F.lit(None).cast(EVENTS), F.lit(0), F.lit(None).cast(TO_FIT), []
    for name, layout in sorted(layouts.items()):
        events, to_fit = compiled(layout, F.col("fields"), F.col("_fitted"))
        here = F.col("layout") == name
        body, top = F.when(here, events).otherwise(body), F.when(here, layout.get("top", 0)).otherwise(top)
        asked = [F.struct(t.alias("texts"), F.lit(len(budgets) + i).alias("budget")) for i, (t, _) in enumerate(to_fit)]
        budgets += [b for _, b in to_fit]
        texts = F.when(here, F.array(*asked).cast(TO_FIT)).otherwise(texts) if asked else texts
    known = entries.where(F.col("layout").isin(*layouts)).select(*keep, "layout", "fields")
    measured = known.withColumn("_fitted", fit_lists(texts, budgets, advances)) if budgets else known.withColumn("_fitted", F.lit(None).cast(f"array<array<{FITTED}>>"))
    return measured.select(*keep, F.posexplode(placed(body, top)).alias("seq", "e")).select(*keep, "seq", "e.*")


def skipped(entries: DataFrame, layouts: dict[str, dict]) -> DataFrame:
    """(case_id, warning) of the entries that ``expand`` passes over because their layout isn't known."""
    unknown = entries.where(~F.coalesce(F.col("layout").isin(*layouts), F.lit(False)))
    return unknown.select("case_id", F.concat(F.lit("skipped: no layout "), F.coalesce("layout", F.lit("stated"))).alias("warning"))


def faults(name: str, layout: dict, known_fields: set[str]) -> list[str]:
    """What is wrong with a layout, every fault at once."""
    found: list[str] = []

    def say(where: str, what: str, expected: str) -> None:
        found.append(str(ConfigError(what, f"layouts.{name}.{where}", expected, "correct the layout")))

    def references(where: str, template: str) -> None:
        if re.search(r"[{}]", re.sub(r"\{[^{}]*\}", "", template)):
            say(where, f"unbalanced braces in {template!r}", "whole {FIELD} placeholders")
        for f in re.findall(r"\{([^{}]*)\}", template):
            if f not in known_fields:
                say(where, f"unknown field {f!r}", "a field of the document type")

    def check(where: str, b: dict) -> None:
        kind = b.get("type")
        if kind not in REQUIRED:
            return say(where, f"block type {kind!r}", f"one of {sorted(REQUIRED)}")
        if missing := REQUIRED[kind] - set(b):
            return say(where, f"missing keys {sorted(missing)}", f"{sorted(REQUIRED[kind])}")
        if unknown := set(b) - REQUIRED[kind] - OPTIONAL[kind] - {"type", "when"}:
            say(where, f"unknown keys {sorted(unknown)}", f"some of {sorted(REQUIRED[kind] | OPTIONAL[kind])}")
        if "when" in b and b["when"] not in known_fields:
            say(where, f"unknown field {b['when']!r} in when", "a field of the document type")
        if kind in ("text", "banner"):
            if ("content" in b) == ("from_layout" in b):
                say(where, "content and from_layout", "exactly one of them")
            elif "content" in b:
                references(where, b["content"])
            for k in ("from_layout", "suppress_if_equals"):
                if k in b and b[k] not in layout:
                    say(where, f"{k} names {b[k]!r}", "a key of the layout")
        if kind == "pair" and b["field"] not in known_fields:
            say(where, f"unknown field {b['field']!r}", "a field of the document type")
        if kind == "block":
            for x in b["lines"]:
                references(where, x)
        for i, child in enumerate(b.get("children", ()) if kind == "panel" else ()):
            check(f"{where}.children[{i}]", child)
        if kind == "split":
            for j, column in enumerate(b["columns"]):
                for i, child in enumerate(column.get("children", ())):
                    check(f"{where}.columns[{j}].children[{i}]", child)
        if kind == "table":
            keys = [c.get("key") for c in b["columns"]]
            if not keys or any(not c.get("key") or "label" not in c for c in b["columns"]) or len(set(keys)) < len(keys):
                say(where, "columns", "a non-empty list, each with its own key and a label")
            for i, c in enumerate(b["columns"]):
                if stray := sorted(set(c) - COLUMN_KEYS):
                    say(f"{where}.columns[{i}]", f"unknown keys {stray}", f"some of {sorted(COLUMN_KEYS)}")
            if ("rows" in b) == ("provider" in b):
                say(where, "rows and provider", "exactly one of them")
            elif "provider" in b and b["provider"] not in PROVIDERS:
                say(where, f"unknown provider {b['provider']!r}", f"one of {sorted(PROVIDERS)}")
            for k in [*keys, *(c["sub_line"].get("key") for c in b["columns"] if "sub_line" in c)] if "rows" in b else ():
                if b["rows"].get(k) not in known_fields:
                    say(where, f"rows of column {k!r}", "a field of the document type")
            if "header_groups" in b and [k for g in b["header_groups"] for k in g.get("span", ())] != keys:
                say(f"{where}.header_groups", "spans", "the table's columns, each once and in order")
            if "span_key" in b and (b["span_key"] not in keys or b.get("grouping") == "dedicated_row"):
                say(where, f"span_key {b['span_key']!r}", "a column of the table, without bands between its rows")
            if b.get("grouping", "none") not in GROUPINGS:
                say(where, f"grouping {b['grouping']!r}", f"one of {GROUPINGS}")
            if b.get("grouping", "none") != "none" and b.get("group_key") not in keys:
                say(where, f"group_key {b.get('group_key')!r}", "a column of the table")

    for i, b in enumerate(layout.get("body") or ()):
        check(f"body[{i}]", b)
    if not layout.get("body"):
        say("body", "no blocks", "a non-empty list")
    return found


#: Keys of a layout that are read somewhere; a body may name others by from_layout or suppress_if_equals.
LAYOUT_KEYS = {"body", "defaults", "content_width", "left", "top", "field_budgets", "field_providers", "font_sizes", "font_family", "page"}
SPOKEN = ("text", "pair", "block", "banner")


def inner_blocks(b: dict) -> list[tuple[str, list[dict]]]:
    """(place, blocks) of what a container holds."""
    if b.get("type") == "panel":
        return [("children", b.get("children", []))]
    return [(f"columns[{i}].children", c.get("children", [])) for i, c in enumerate(b["columns"])] if b.get("type") == "split" else []


def geometry_faults(name: str, layout: dict, providers: dict[str, set[str]] | None = None) -> list[str]:
    """What doesn't fit in a layout whose structure is sound, every fault at once.

    Roles without a line advance, keys that nothing reads, budgets that aren't defined or are wider than their region,
    panels and splits that leave their contents no pixel, and field providers (name -> what it emits) that are unknown
    or emit what another one does.
    """
    found: list[str] = []
    defaults, budgets = layout.get("defaults") or {}, layout.get("field_budgets") or {}
    roles, named = set(), set()

    def say(where: str, what: str, expected: str) -> None:
        found.append(str(ConfigError(what, f"layouts.{name}.{where}", expected, "correct the layout")))

    def check(where: str, b: dict, width: int) -> None:
        kind = b["type"]
        named.update(b[k] for k in ("from_layout", "suppress_if_equals") if k in b)
        if kind in SPOKEN:
            roles.add(b.get("role", defaults.get("banner_role" if kind == "banner" else "role", "body")))
        if "budget" in b:
            if b["budget"] not in budgets:
                say(f"{where}.budget", f"no budget {b['budget']!r}", f"one of {sorted(budgets)}")
            elif budgets[b["budget"]]["width"] > width:
                say(f"{where}.budget", f"budget of {budgets[b['budget']]['width']} pixels in a region of {width}", f"{width} or less")
            if kind == "pair" and b.get("value_align", defaults.get("pair_value_align")) == "right" and b.get("min_gap", defaults.get("pair_min_gap", 0)):
                say(f"{where}.min_gap", "a least gap beside a budget and a value on the right", "no least gap: the budget sets the place")
        for i, c in enumerate(b["columns"] if kind == "table" else ()):
            if "budget" in c and c["budget"] not in budgets:
                say(f"{where}.columns[{i}].budget", f"no budget {c['budget']!r}", f"one of {sorted(budgets)}")
        inner = [width]
        if kind == "panel":
            padding = b.get("padding", defaults.get("panel_padding", 0))
            inner = [width - 2 * padding]
            if inner[0] < 1:
                return say(f"{where}.padding", f"padding {padding} in a region of {width} pixels", f"less than {width / 2:g}")
            if b.get("height") is not None and b["height"] < 2 * padding:
                say(f"{where}.height", f"height {b['height']} with padding {padding}", f"{2 * padding} or more")
        if kind == "split":
            n, gap = len(b["columns"]), b.get("gap", defaults.get("split_gap", 0))
            room = width - gap * (n - 1)
            inner = list(b.get("widths") or [room // n] * n)
            if len(inner) != n or min(inner) < 1 or sum(inner) > room:
                return say(where, f"columns {inner} with gap {gap} in a region of {width} pixels", f"{n} columns of {max(room, 0)} pixels together")
        for (place, blocks), own in zip(inner_blocks(b), inner):
            for i, child in enumerate(blocks):
                check(f"{where}.{place}[{i}]", child, own)

    for i, b in enumerate(layout["body"]):
        check(f"body[{i}]", b, layout["content_width"])
    if lacking := sorted(roles - set(defaults.get("line_advance") or {})):
        say("defaults.line_advance", f"no line advance for roles {lacking}", "one for each role of the body")
    if unread := sorted(set(layout) - LAYOUT_KEYS - named):
        say("", f"keys {unread} that nothing reads", f"some of {sorted(LAYOUT_KEYS | named)}")
    taken: dict[str, str] = {}
    for i, spec in enumerate(layout.get("field_providers") or ()):
        if spec["name"] not in (providers or {}):
            say(f"field_providers[{i}]", f"unknown provider {spec['name']!r}", f"one of {sorted(providers or ())}")
            continue
        if twice := sorted(providers[spec["name"]] & set(taken)):
            say(f"field_providers[{i}]", f"{spec['name']} emits {twice}, as {sorted({taken[k] for k in twice})} do", "fields of its own")
        taken |= dict.fromkeys(providers[spec["name"]], spec["name"])
    return found


def with_provided(entries: DataFrame, provided: dict[str, Column], emits: set[str]) -> DataFrame:
    """Entries whose ``fields`` also hold what a provider derives; a key it doesn't declare fails before anything runs."""
    if undeclared := sorted(set(provided) - emits):
        raise ConfigError(f"a provider returns {undeclared}, which it doesn't declare", "emits", f"some of {sorted(emits)}", "declare them or leave them out")
    more = F.create_map(*(x for k, v in provided.items() for x in (F.lit(k), v.cast("string"))))
    kept = F.map_filter("fields", lambda k, _: ~k.isin(*provided))
    return entries.withColumn("fields", F.map_concat(kept, more)) if provided else entries
