import json
import random

from pyspark.sql import functions as F

from scrivana.functions import lists, values
from scrivana.operators import events, index, tables
from scrivana.sources import readers
from scrivana.streaming import live


def test_layout_annotations(spark):
    span = "array<struct<text:string,poly:array<int>>>"
    box = [0, 0, 4, 0, 4, 2, 0, 2]
    rows = [("p", 0, "title", 1, [("t", box), ("u", [2, 1, 9, 1, 9, 3, 2, 3])]), ("p", 1, "table", 0, [("c", box)]), ("p", 2, None, None, [("x", box)]), ("p", 3, "text_block", None, [("y", box)]), ("p", 4, "text_block", 2, [])]
    df = spark.createDataFrame(rows, f"page string, seq int, category_type string, `order` int, spans {span}").withColumn("text", F.lit("t"))
    html = spark.createDataFrame([("p", 1, "<table></table>")], "page string, table_no long, html string")
    dets = [json.loads(x) for x in events.layout_annotations(df, ["page"], html).first().layout_dets]
    assert [d["category_type"] for d in dets] == ["table", "title", "text_block"]
    assert dets[0]["html"] == "<table></table>" and "line_with_spans" not in dets[0]
    assert dets[1]["poly"] == [0, 0, 9, 0, 9, 3, 0, 3] and len(dets[1]["line_with_spans"]) == 2
    assert spark.range(1).select(events.box_holds(F.array(*map(F.lit, box))), events.box_holds(F.array(*map(F.lit, [0] * 8)))).first()[:] == (True, False)


def test_upsert_stream(spark, tmp_path):
    for i, rows in enumerate([[(1, "a", 0), (2, "b", 1)], [(2, "B", 0), (3, "c", 1)]]):
        spark.createDataFrame(rows, "k int, v string, seq int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = spark.readStream.schema("k int, v string, seq int").json(str(tmp_path / "in"))
        live.upsert_stream(source, ["k"], "seq", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.k: r.v for r in spark.read.parquet(str(tmp_path / "out" / "1")).collect()}
    assert got == {1: "a", 2: "B", 3: "c"}


def test_small_readers(spark, tmp_path):
    rows = spark.createDataFrame([("s", "old", 1), ("s", "new", 2), ("t", "x", 1)], "stem string, v string, n int")
    assert sorted((r.stem, r.v) for r in readers.last_by_stem(rows, "n").collect()) == [("s", "new"), ("t", "x")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    assert readers.file_hashes(spark, str(tmp_path / "f")).first().sha256.startswith("ba7816bf")
    record = {"case_id": "c", "doc_type": "d", "layout_id": "l", "events": [{"seq": 0, "kind": "pair", "meta": {"label": "x", "value": "1"}}]}
    (tmp_path / "e.jsonl").write_text(json.dumps(record) + "\n")
    assert readers.page_events(readers.json_lines(spark, str(tmp_path / "e.jsonl"), readers.EVENTS)).first().label == "x"
    (tmp_path / "r.jsonl").write_text(json.dumps({"model": "m"}) + "\n")
    assert readers.rows_with_columns(spark, [str(tmp_path / "r.jsonl")], ["model"]).count() == 1
    try:
        readers.rows_with_columns(spark, [str(tmp_path / "r.jsonl")], ["corpus"])
        raise AssertionError
    except ValueError as e:
        assert "lacks" in str(e)
    readers.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_header_faults_and_clean(spark):
    cells = "array<struct<text:string,colspan:int,rowspan:int>>"
    one = [("a", 1, 1)]
    df = spark.createDataFrame([(1, 0, True, one), (1, 1, False, one), (2, 0, False, one), (2, 1, True, one), (3, 0, True, one), (3, 1, True, one * 2)], f"t int, o int, header boolean, cells {cells}")
    assert sorted(r.t for r in tables.header_faults(df, ["t"], "o").collect()) == [2, 3]
    try:
        index.require_clean(spark.createDataFrame([("x",)], "corpus string"))
        raise AssertionError
    except ValueError:
        pass


def test_small_values(spark):
    df = spark.createDataFrame([("07/10/2023", "14:05", {"A": "1"})], "d string, t string, fields map<string,string>").withColumn("case_id", F.lit("c"))
    assert df.select(values.long_timestamp(F.col("d"), F.col("t"))).first()[0] == "07 Oct 2023 at 02:05 PM"
    assert lists.flatten_fields(df, ["A", "B"]).first()[:] == ("c", "1", "NOT_FOUND")
    assert float(df.select(values.subtotal(F.lit(11).cast("decimal(18,2)"), F.lit(1).cast("decimal(18,2)"))).first()[0]) == 10
    money = F.lit("-1234.505").cast("decimal(18,3)")
    row = df.select(values.signed_balance(money), values.currency(-money, "plain", "Cr"), values.counted_description(F.lit("tea"), F.lit("2")), values.counted_description(F.lit("tea"), F.lit("1"))).first()
    assert row[:] == ("$1,234.51 DR", "1,234.51 Cr", "2x tea", "tea")


def test_captured_events_against_a_stack(spark):
    """Random logs of nested scopes, against a walk that keeps what holds on a stack."""
    rng = random.Random(11)
    rows, want, faults = [], {}, set()
    for page in range(40):
        stack, event, decorated, seq, order, depth, at = [], None, 0, 0, 0, 0, 0
        for at in range(rng.randint(0, 60)):
            op = rng.choice(events.LOG_OPS)
            if op == "block_close" and not stack or op == "decoration_close" and not decorated:
                op = "emit"
            text, category, poly = f"t{at}", rng.choice([None, "title"]), [at, 0, at + 2, 0, at + 2, 3, at, 3]
            rows.append((page, at, op, "line", text, category, poly))
            if op == "block_open":
                stack.append((event, decorated))
                event, decorated = None, 0
            elif op == "block_close":
                event, decorated = stack.pop()
            elif op == "decoration_open":
                decorated += 1
            elif op == "decoration_close":
                decorated -= 1
            elif op == "emit":
                event, seq = seq, seq + 1
                want[page, event] = [text, order if category else None, []]
                order += category is not None
            elif not decorated and event is None:
                faults.add((page, at))
            elif not decorated:
                want[page, event][2].append(text)
    log = spark.createDataFrame(rows, "page int, at int, op string, kind string, text string, category_type string, poly array<int>").repartition(5)
    got = {(r.page, r.seq): [r.text, r.order, [s.text for s in r.spans]] for r in events.captured(log, ["page"]).collect()}
    assert got == want and sum(len(x[2]) for x in want.values()) > 50
    assert {(r.page, r["at"]) for r in events.uncovered(log, ["page"]).collect()} == faults and faults
    box = events.captured(log.where("page = 0"), ["page"]).where("size(spans) > 0").collect()
    assert all(r.poly[0] == min(s.poly[0] for s in r.spans) and r.poly[2] == max(s.poly[2] for s in r.spans) for r in box)
