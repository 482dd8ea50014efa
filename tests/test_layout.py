import copy
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scrivana.functions import lists, providers
from scrivana.operators import layout
from scrivana.sources.config import ConfigError

BODY = {
    "name": "Shop",
    "body": [
        {"type": "banner", "from_layout": "name"},
        {"type": "text", "content": "Hello {WHO}", "when": "WHO"},
        {"type": "text", "content": "{NONE}", "suppress_if_equals": "name"},
        {"type": "panel", "children": [{"type": "pair", "label": "Total", "field": "T", "currency": True}]},
        {"type": "split", "columns": [{"children": [{"type": "block", "lines": ["a {WHO}", "b"]}]}, {"children": [{"type": "rule"}]}]},
        {"type": "table", "columns": [{"key": "d", "label": "Date"}, {"key": "x", "label": "Item"}], "rows": {"d": "DATES", "x": "ITEMS"}, "grouping": "dedicated_row", "group_key": "d"},
    ],
}
FIELDS = {"WHO": "Ann", "NONE": "NOT_FOUND", "T": "1234.5", "DATES": "07/10/2023|07/10/2023|08/10/2023", "ITEMS": "p|q|r"}


def said(spark, body, fields):
    df = spark.createDataFrame([("c", "L", fields)], "case_id string, layout string, fields map<string,string>")
    return [(r.kind, r.text if r.kind != "pair" else (r.label, r.value)) for r in layout.expand(df, {"L": body}, ["case_id"]).orderBy("seq").collect()]


def test_expand(spark):
    got = said(spark, BODY, FIELDS)
    assert got[:9] == [("title", "Shop"), ("line", "Hello Ann"), ("panel_open", None), ("pair", ("Total:", "$1,234.50")), ("panel_close", None), ("split_open", None), ("column_open", None), ("line", "a Ann"), ("line", "b")]
    cells = [t for k, t in got if k == "cell"]
    assert cells == ["Date", "Item", "Sat 07 Oct 2023", "", "p", "", "q", "Sun 08 Oct 2023", "", "r"]
    table = {**BODY["body"][-1], "grouping": "inline"}
    assert [t for k, t in said(spark, {"body": [table]}, FIELDS) if k == "cell"][2:] == ["07/10/2023", "p", "", "q", "08/10/2023", "r"]
    assert [k for k, _ in said(spark, {"body": [table]}, {"DATES": "NOT_FOUND", "ITEMS": "NOT_FOUND"})] == ["table_open", "row_open", "cell", "cell", "row_close", "table_close"]


def test_places(spark):
    """Where blocks stand, against a walk over the same body by hand."""
    body = {
        "top": 100, "left": 7, "content_width": 400, "name": "Shop",
        "defaults": {"line_advance": {"body": 20, "header": 30}, "banner_role": "header", "panel_padding": 10, "split_gap": 9, "row_height": 15, "rule_height": 3},
        "body": [
            {"type": "banner", "from_layout": "name"},
            {"type": "text", "content": "x", "when": "NONE"},
            {"type": "rule"},
            {"type": "panel", "children": [{"type": "block", "heading": "h", "lines": ["a", "b"]}, {"type": "spacer", "height": 4}]},
            {"type": "split", "columns": [{"children": [{"type": "text", "content": "l"}]}, {"children": [{"type": "block", "lines": ["r", "s"], "when": "WHO"}]}]},
            {"type": "table", "columns": [{"key": "d", "label": "Date"}, {"key": "x", "label": "Item"}], "rows": {"d": "DATES", "x": "ITEMS"}, "grouping": "dedicated_row", "group_key": "d"},
            {"type": "text", "content": "end"},
        ],
    }
    df = spark.createDataFrame([("c", "L", FIELDS)], "case_id string, layout string, fields map<string,string>")
    got = [(r.kind, r.text, r.x, r.width, r.y) for r in layout.expand(df, {"L": body}, ["case_id"]).orderBy("seq").collect()]
    lines = [x for x in got if x[0] in ("title", "line")]
    assert lines == [("title", "Shop", 7, 400, 100), ("line", "h", 17, 380, 143), ("line", "a", 17, 380, 163), ("line", "b", 17, 380, 183), ("line", "l", 7, 196, 217), ("line", "r", 212, 195, 217), ("line", "s", 212, 195, 237), ("line", "end", 7, 400, 347)]
    rows = [x[4] for x in got if x[0] == "row_open"]
    assert rows == [257, 272, 287, 302, 317, 332]  # header, band, p, q, band, r
    assert [x[4] for x in got if x[0] in ("panel_open", "panel_close", "split_close", "table_close")] == [133, 217, 257, 347]


def test_faults():
    assert layout.faults("L", BODY, set(FIELDS)) == []
    bad = {"body": [{"type": "text"}, {"type": "pair", "label": "x", "field": "NO"}, {"type": "wheel"}, {"type": "text", "content": "{WHO", "colour": 1}, {"type": "table", "columns": [], "rows": {}}]}
    assert len(layout.faults("L", bad, set(FIELDS))) == 6


FITTING = {
    "content_width": 400,
    "title": "T",
    "defaults": {"line_advance": {"body": 20, "header": 30}, "role": "body", "banner_role": "header", "panel_padding": 10, "split_gap": 20},
    "field_budgets": {"amount": {"width": 180}},
    "field_providers": [{"name": "till"}],
    "body": [
        {"type": "banner", "from_layout": "title"},
        {"type": "split", "columns": [{"children": [{"type": "pair", "label": "x", "field": "A", "budget": "amount"}]}, {"children": []}]},
        {"type": "panel", "children": [{"type": "text", "content": "y"}]},
    ],
}


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda x: x["field_budgets"]["amount"].update(width=200), "budget of 200 pixels in a region of 190"),
        (lambda x: x["field_budgets"].clear(), "no budget 'amount'"),
        (lambda x: x["body"].append({"type": "table", "columns": [{"key": "k", "label": "K", "budget": "wide"}], "rows": {"k": "A"}}), "no budget 'wide'"),
        (lambda x: x["body"][2].update(padding=200), "padding 200"),
        (lambda x: x["body"][2].update(height=19), "height 19"),
        (lambda x: x["body"][1].update(widths=[300, 100]), "columns [300, 100]"),
        (lambda x: x["body"][1].update(gap=400), "columns [0, 0]"),
        (lambda x: x["body"][2]["children"][0].update(role="small"), "no line advance for roles ['small']"),
        (lambda x: x.update(other=1), "keys ['other']"),
        (lambda x: x["field_providers"].append({"name": "slip"}), "slip emits ['TIME']"),
        (lambda x: x["field_providers"].append({"name": "none"}), "unknown provider 'none'"),
        (lambda x: x["body"][1]["columns"][0]["children"][0].update(value_align="right", min_gap=5), "a least gap"),
    ],
)
def test_geometry_faults(change, said):
    providers = {"till": {"TIME"}, "slip": {"TIME", "PAN"}}
    assert layout.geometry_faults("L", FITTING, providers) == []
    bad = copy.deepcopy(FITTING)
    change(bad)
    found = layout.geometry_faults("L", bad, providers)
    assert len(found) == 1 and said in found[0]


def test_provided_fields(spark):
    entries = spark.createDataFrame([("a", {"X": "1", "Y": "2"})], "case_id string, fields map<string,string>")
    got = layout.with_provided(entries, {"Y": F.lit("3"), "Z": F.col("case_id")}, {"Y", "Z", "W"}).first().fields
    assert got == {"X": "1", "Y": "3", "Z": "a"}
    with pytest.raises(ConfigError, match="doesn't declare"):
        layout.with_provided(entries, {"Q": F.lit("3")}, {"Y"})


# Blocks are measured, then placed: against a walk by hand over random bodies.

WIDE = {"w": {"width": 60, "size": 10, "lines": 99, "fit": "wrap"}}


def wrapped_lines(text, width=60, size=10):
    """Greedy lines of words whose characters take 0.6 of the size each."""
    room, lines = width * 1000 / size, [""]
    for word in text.split(" "):
        more = f"{lines[-1]} {word}" if lines[-1] else word
        if 600 * len(more) <= room or not lines[-1]:
            lines[-1] = more
        else:
            lines.append(word)
    return len(lines)


def walk(blocks, x, width, y, fields, out):
    """(kind, text, x, width, y) of text, panel, split and table blocks; returns where the next one stands."""
    for b in blocks:
        if "when" in b and fields.get(b["when"], "NOT_FOUND") in ("", "NOT_FOUND"):
            continue
        if b["type"] == "text":
            out.append(("line", b["content"], x, width, y))
            y += 20 * (wrapped_lines(b["content"]) if "budget" in b else 1)
        elif b["type"] == "spacer":
            y += b["height"]
        elif b["type"] == "panel":
            out.append(("panel_open", None, x, width, y))
            low = walk(b["children"], x + b["padding"], width - 2 * b["padding"], y + b["padding"], fields, out) + b["padding"]
            y = y + b["height"] if "height" in b else low
            out.append(("panel_close", None, x, width, y))
        elif b["type"] == "split":
            n = len(b["columns"])
            each, over = divmod(width - 4 * (n - 1), n)
            out.append(("split_open", None, x, width, y))
            at, lows = x, [y]
            for i, c in enumerate(b["columns"]):
                own = each + (i < over)
                out.append(("column_open", None, at, own, y))
                lows.append(walk(c["children"], at, own, y, fields, out))
                out.append(("column_close", None, at, own, lows[-1]))
                at += own + 4
            y = max(lows)
            out.append(("split_close", None, x, width, y))
        else:
            y = walk_table(b, x, width, y, fields, out)
    return y


def walk_table(b, x, width, y, fields, out):
    rows = list(zip(*([v.strip() for v in fields[b["rows"][k]].split("|")] for k in ("a", "s", "n"))))
    out.append(("table_open", None, x, width, y))
    for head in ([g["label"] for g in b["header_groups"]], [c["label"] for c in b["columns"]]):
        out.append(("row_open", None, x, width, y))
        out.extend(("cell", t, x, width, y) for t in head)
        out.append(("row_close", None, x, width, y))
        y += 20
    for i, (a, s, n) in enumerate(rows):
        out.append(("row_open", None, x, width, y))
        out.append(("cell", a, x, width, y))
        if i == 0 or rows[i - 1][1] != s:
            out.append(("cell", s, x, width, y))
        if n != "NOT_FOUND":
            out.append(("cell_sub_line", n, x, width, y + 12))
        out.append(("row_close", None, x, width, y))
        y += 20 * wrapped_lines(a) + (15 if n != "NOT_FOUND" else 0)
    out.append(("table_close", None, x, width, y))
    return y


def random_blocks(rng, depth=0):
    out = []
    for _ in range(rng.randint(0 if depth else 1, 4)):
        kind = rng.choice(["text", "text", "spacer", "table"] + (["panel", "split"] if depth < 2 else []))
        b = {"type": kind}
        if kind == "text":
            b["content"] = " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 8)))
            b |= {"budget": "w"} if rng.random() < 0.5 else {}
        elif kind == "spacer":
            b["height"] = rng.randint(0, 30)
        elif kind == "panel":
            b |= {"padding": rng.randint(0, 5), "children": random_blocks(rng, depth + 1)} | ({"height": rng.randint(10, 200)} if rng.random() < 0.3 else {})
        elif kind == "split":
            b["columns"] = [{"children": random_blocks(rng, depth + 1)} for _ in range(rng.randint(1, 3))]
        else:
            b |= {
                "columns": [{"key": "a", "label": "A", "budget": "w", "sub_line": {"key": "n", "offset_y": 12, "height": 15}}, {"key": "s", "label": "S"}],
                "rows": {"a": "AS", "s": "SS", "n": "NS"}, "header_groups": [{"label": "both", "span": ["a", "s"]}], "span_key": "s",
            }
        if rng.random() < 0.2:
            b["when"] = rng.choice(["WHO", "NONE"])
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_places_of_random_bodies(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 12)
    fields = {"WHO": "Ann", "NONE": "NOT_FOUND", "AS": "|".join(" ".join("y" * rng.randint(1, 8) for _ in range(rng.randint(1, 5))) for _ in range(n)), "SS": "|".join(rng.choice("pq") for _ in range(n)), "NS": "|".join(rng.choice(["note", "NOT_FOUND"]) for _ in range(n))}
    body = {"top": 9, "left": 3, "content_width": 500, "field_budgets": WIDE, "defaults": {"split_gap": 4}, "body": random_blocks(rng)}
    assert layout.faults("L", body, set(fields)) == []
    expected = []
    walk(body["body"], 3, 500, 9, fields, expected)
    df = spark.createDataFrame([("c", "L", fields)], "case_id string, layout string, fields map<string,string>")
    assert [(r.kind, r.text, r.x, r.width, r.y) for r in layout.expand(df, {"L": body}, ["case_id"]).orderBy("seq").collect()] == expected


def test_sums_and_runs(spark):
    rng = random.Random(4)
    rows = [[rng.randint(-9, 9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 17, 100, 1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<int>")
    assert [r.s for r in df.orderBy("i").select(lists.sums_before(F.col("v")).alias("s")).collect()] == [[sum(v[:i]) for i in range(len(v))] for v in rows]
    marked = [[(rng.choice(["a", "b", None]), rng.random() < 0.2) for _ in range(n)] for n in (0, 1, 2, 9, 60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(marked)], "i int, v array<struct<k:string,synthetic:boolean>>")
    got = [r.n for r in df.orderBy("i").select(layout.run_lengths(F.col("v"), "k").alias("n")).collect()]
    for v, runs in zip(marked, got):
        expected, i = [], 0
        while i < len(v):
            z = i + 1
            while z < len(v) and not v[i][1] and not v[z][1] and v[z][0] == v[i][0]:
                z += 1
            expected += [z - i] + [0] * (z - i - 1)
            i = z
        assert runs == expected


STATEMENT = {
    "TRANSACTION_DATES": "07/10/2023|07/10/2023|08/10/2023", "TRANSACTION_DESCRIPTIONS": "rent|pay|tea", "TRANSACTION_AMOUNTS_PAID": "20.00|NOT_FOUND|5.50",
    "TRANSACTION_AMOUNTS_RECEIVED": "NOT_FOUND|100.00|NOT_FOUND", "TRANSACTION_BALANCES": "-10.00|90.00|84.50",
}


def test_bank_rows(spark):
    """The row before the first and the one after the last, references, texts of balances; totals; no rows, ragged rows."""
    made = lambda fields, f: spark.createDataFrame([(fields,)], "f map<string,string>").select(F.inline(f(F.col("f")))).collect()
    got = made(STATEMENT, lambda f: providers.bank_transactions(f, brought_forward="Brought forward", carried_forward="Carried forward", reference_prefix="Ref: ", reference_leader="..", balance_suffix=("DR", "CR")))
    assert [(r.description, r.balance, r.synthetic, r.bold) for r in got] == [("Brought forward", "$10.00 CR", True, False), ("rent", "$10.00 DR", False, False), ("pay", "$90.00 CR", False, False), ("tea", "$84.50 CR", False, False), ("Carried forward", "$84.50 CR", True, True)]
    rent = int(hashlib.sha256(b"rent").hexdigest(), 16) % 10**10
    assert [got[0].reference, got[1].reference, got[4].reference] == [None, f"Ref: {rent:010d}..", None] and got[2].debit is None
    totals = made(STATEMENT, lambda f: providers.bank_transaction_totals(f, "Totals"))
    assert [(str(r.debit), str(r.credit), r.balance, r.bold) for r in totals] == [("25.50", "100.00", None, True)]
    absent = dict.fromkeys(STATEMENT, "NOT_FOUND")
    assert made(absent, lambda f: providers.bank_transactions(f, opening_balance="x", carried_forward="y")) == []
    assert [str(r.debit) for r in made(absent, lambda f: providers.bank_transaction_totals(f, "Totals"))] == ["0.00"]
    one = {**absent, "TRANSACTION_DATES": "07/10/2023", "TRANSACTION_DESCRIPTIONS": "rent", "TRANSACTION_AMOUNTS_PAID": "2.00", "TRANSACTION_BALANCES": "3.00"}
    assert [(str(r.balance), r.credit) for r in made(one, lambda f: providers.bank_transactions(f, opening_balance="x"))] == [("5.00", None), ("3.00", None)]
    with pytest.raises(Exception, match="ragged"):
        made(STATEMENT | {"TRANSACTION_DATES": "07/10/2023"}, providers.bank_transactions)
    with pytest.raises(ValueError, match="keep one"):
        providers.bank_transactions(F.col("f"), opening_balance="x", brought_forward="y")


def test_bank_table(spark):
    """Under bands the row that is brought forward stands below the first date, and no synthetic row opens a band."""
    table = {"type": "table", "columns": [{"key": "date", "label": "Date"}, {"key": "description", "label": "What"}, {"key": "debit", "label": "Out", "currency": True}, {"key": "balance", "label": "Balance", "currency": True}], "provider": "bank_transactions", "params": {"brought_forward": "Brought forward", "carried_forward": "Carried forward"}, "group_key": "date", "header": False}
    cells = lambda b: [t for k, t in said(spark, {"body": [b]}, STATEMENT) if k == "cell"]
    assert cells({**table, "grouping": "dedicated_row"}) == [
        "Sat 07 Oct 2023", "", "Brought forward", "", "$10.00", "", "rent", "$20.00", "$-10.00", "", "pay", "", "$90.00", "Sun 08 Oct 2023", "", "tea", "$5.50", "$84.50", "", "Carried forward", "", "$84.50",
    ]
    assert cells({**table, "grouping": "inline"})[0::4] == ["", "07/10/2023", "", "08/10/2023", ""]
    assert layout.faults("L", {"body": [{**table, "grouping": "dedicated_row", "span_key": "date"}]}, set()) != []
    assert layout.faults("L", {"body": [{**table, "provider": "none"}]}, set()) != []


def test_unfit_text_fails(spark):
    body = {"field_budgets": {"b": {"width": 10, "size": 10}}, "body": [{"type": "text", "content": "{WHO}", "budget": "b"}]}
    with pytest.raises(Exception, match="does not fit 10 pixels"):
        said(spark, body, FIELDS)
