"""Corpora and models in folders, exports, run files and boxes, with planted faults."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivana.functions import fit, png
from scrivana.operators import corpus, events, index, layout, score
from scrivana.sources import config, readers


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture
def scored(tmp_path):
    """Two corpora of two pages; model one answered both, model two the first corpus only, without its second page."""
    base, said = tmp_path / "corpora", tmp_path / "predictions"
    matrix = []
    for name, family in (("clean", "clean"), ("scan_light", "scan")):
        for folder in ("images", "transcripts"):
            (base / name / folder).mkdir(parents=True)
        rows = []
        for case, text in (("A", "total: 12.50"), ("B", "<table><tr><td>x</td></tr></table>")):
            stem = f"{case}_receipt"
            (base / name / "images" / f"{stem}.png").write_bytes(f"{name}{case}".encode())
            (base / name / "transcripts" / f"{stem}.md").write_text(text)
            rows.append({"image": f"images/{stem}.png", "transcript": f"transcripts/{stem}.md", "doc_type": "receipt", "sha256": sha(f"{name}{case}")})
        (base / name / "manifest.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        (base / name / "prompt.md").write_text("read this")
        matrix.append({"corpus": name, "family": family, "severity": "none", "pages": 2, "doc_types": ["receipt"], "manifest_sha256": sha((base / name / "manifest.jsonl").read_bytes())})
        for model in ("one", "two"):
            if (model, name) == ("two", "scan_light"):
                continue
            at = said / model / name
            at.mkdir(parents=True)
            run = {k: "x" for k in ("model_id", "model_revision", "generated_at", "host")} | {"corpus": name, "prompt_sha256": sha("read this"), "corpus_manifest_sha256": matrix[-1]["manifest_sha256"]}
            (at / "run.json").write_text(json.dumps(run, indent=1))
            (at / "A_receipt.md").write_text("total: 12.5")
            if model == "one":
                (at / "B_receipt.md").write_text("<table><tr><td>y</td></tr></table>")
    (base / "matrix.jsonl").write_text("".join(json.dumps(r) + "\n" for r in matrix))
    return base, said


def scores(spark, scored, **options):
    return score.score_folders(spark, f"{scored[0]}/matrix.jsonl", str(scored[1]), **options)


def test_scored_folders(spark, scored):
    got = {(r.model, r.corpus, r.case_id): r for r in scores(spark, scored, allow_missing=True).collect()}
    assert sorted(got) == sorted([(m, c, x) for m, c in (("one", "clean"), ("one", "scan_light"), ("two", "clean")) for x in "AB"])
    assert got["one", "clean", "A"].strict_edit_distance == 1 and got["one", "scan_light", "A"].family == "scan"
    assert got["one", "clean", "B"].table_cell_error_rate == 1 and got["one", "clean", "B"].doc_type == "receipt"
    missing = got["two", "clean", "B"]
    assert not missing.prediction_present and missing.strict_cer is None and missing.table_cell_error_rate is None and missing.verified
    assert not scores(spark, scored, allow_missing=True, verify=False).first().verified


def test_scoring_refuses(spark, scored):
    base, said = scored
    with pytest.raises(Exception, match="no prediction"):
        scores(spark, scored).collect()
    (base / "clean" / "images" / "A_receipt.png").write_bytes(b"other")
    with pytest.raises(ValueError, match="differ from their manifest"):
        scores(spark, scored, allow_missing=True)
    assert scores(spark, scored, allow_missing=True, verify=False).count() == 6
    run = said / "one" / "clean" / "run.json"
    run.write_text(run.read_text().replace(sha("read this"), sha("other")))
    with pytest.raises(ValueError, match="another prompt"):
        scores(spark, scored, allow_missing=True, verify=False)
    (base / "scan_light" / "manifest.jsonl").write_text((base / "scan_light" / "manifest.jsonl").read_text() + "\n")
    with pytest.raises(ValueError, match="exported again"):
        scores(spark, scored, allow_missing=True, verify=False)


def test_extraction_export(spark, tmp_path):
    definitions = config.FieldDefinitions(("DOCUMENT_TYPE", "TOTAL"), {}, {}, {"RECEIPT": (("ITEMS", "PRICES"),), "STATEMENT": (("DATES",),)}, {"ITEMS": "ITEM", "PRICES": "PRICE", "DATES": "DATE"})
    rows = [("B", "receipts", {"DOCUMENT_TYPE": "RECEIPT", "TOTAL": "3.00", "ITEMS": "tea | bun", "PRICES": "1.00|2.00"}), ("A", "statements", {"DOCUMENT_TYPE": "STATEMENT", "DATES": "01/01/2024"}), ("C", "receipts", {"DOCUMENT_TYPE": "RECEIPT", "ITEMS": "NOT_FOUND", "PRICES": "NOT_FOUND"}), ("D", "receipts", {"DOCUMENT_TYPE": "RECEIPT"})]
    entries = spark.createDataFrame(rows, "case_id string, doc_type string, fields map<string,string>")
    manifest = spark.createDataFrame([(f"images/{c}_{t}.png",) for c, t, _ in rows], "image string")
    corpus.export_extraction(entries, manifest, definitions, str(tmp_path / "out"))
    truth = {r.case_id: r for r in spark.read.json(str(tmp_path / "out" / "ground_truth")).collect()}
    assert truth["A"].TOTAL == "NOT_FOUND" and truth["B"].image == "B_receipts.png" and len(truth) == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "ground_truth_csv")).count() == 4
    items = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "line_items")).collect()]
    assert sorted((x["case_id"], x["line_no"], x.get("ITEM"), x.get("PRICE"), x.get("DATE")) for x in items) == [("A", 0, None, None, "01/01/2024"), ("B", 0, "tea", "1.00", None), ("B", 1, "bun", "2.00", None)]
    assert all(("DATE" in x) != ("ITEM" in x) for x in items)
    with pytest.raises(Exception, match="[Aa]lready|exists"):
        corpus.export_extraction(entries, manifest, definitions, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="only the corpus has: \\(1, \\['E_receipts'\\]\\)"):
        corpus.export_extraction(entries, manifest.union(spark.createDataFrame([("E_receipts.png",)], "image string")), definitions, str(tmp_path / "other"))


def test_export_writes_texts_and_description(spark, tmp_path):
    span = "array<struct<text:string,poly:array<int>>>"
    box = [0, 0, 4, 0, 4, 2, 0, 2]
    events = spark.createDataFrame([("a", 0, "table", 0, [("c", box)]), ("a", 1, "title", 1, [("t", box), ("u", box)])], f"stem string, seq int, category_type string, `order` int, spans {span}").withColumn("text", F.lit("x"))
    rows = spark.createDataFrame([("a", 1, 1, False, [("x", 1, 1)])], "stem string, table_no long, row_no long, header boolean, cells array<struct<text:string,colspan:int,rowspan:int>>")
    files = spark.createDataFrame([("a", "h", "p")], "stem string, sha256 string, pixels_sha256 string")
    texts = spark.createDataFrame([("a", "één")], "stem string, text string")
    pages = spark.createDataFrame([("a", "r", "l", "scan", "light")], "stem string, doc_type string, layout string, family string, severity string")
    manifest = corpus.manifest_rows(pages, files, texts).withColumn("tables", F.lit(None).cast("string"))
    corpus.export(spark, manifest, events, rows, str(tmp_path / "out"), texts, "My corpus")
    assert (tmp_path / "out" / "transcripts" / "a.md").read_text() == "één"
    told = (tmp_path / "out" / "README.md").read_text()
    assert told.startswith("# My corpus") and "| spans | title | 2 |" in told and "| blocks | table | 1 |" in told and "| tables | pages with several | 0 |" in told
    record = spark.read.json(str(tmp_path / "out" / "manifest")).first()
    assert (record.transcript_sha256, record.image, record.tables) == (sha("één"), "images/a.png", "tables/a")
    with pytest.raises(Exception, match="no image or transcript"):
        corpus.manifest_rows(pages, files.where("false"), texts).collect()


def write(tmp_path, name, text):
    (tmp_path / "config").mkdir(exist_ok=True)
    (tmp_path / "config" / name).write_text(text)
    return tmp_path / "config" / name


def test_run_config(tmp_path, monkeypatch):
    monkeypatch.setenv("STORE", str(tmp_path / "store"))
    types = "document_types:\n  r: {ground_truth: g, layouts: l, output_subdir: s}\n"
    got = config.run_config(write(tmp_path, "a.yml", "dataset_root: ${STORE}/v1\nground_truth_dir: truth\n" + types))
    assert got.output_dir == tmp_path / "store" / "v1" / "output" and got.derived_dir.name == "derived" and got.ground_truth_dir == "truth"
    got = config.run_config(write(tmp_path, "b.yml", "dataset_root: data\noutput_dir: /elsewhere\nground_truth_dir: t\n" + types))
    assert str(got.output_dir) == "/elsewhere" and got.dataset_root == tmp_path / "data"
    for bad, said in (("ground_truth_dir: t\n" + types, "missing"), ("dataset_root: d\nground_truth_dir: t\nexports_dir: x\n" + types, "no longer read"), ("dataset_root: ${NOT_SET_X}\nground_truth_dir: t\n" + types, "unset"), ("dataset_root: d\nground_truth_dir: t\ndocument_types: {r: {layouts: l}}\n", "missing")):
        with pytest.raises(config.ConfigError, match=said):
            config.run_config(write(tmp_path, "c.yml", bad))


def test_field_definitions(tmp_path):
    text = "all_columns: [A, B]\ndocument_fields: {receipt: [A]}\nlayout_fields: {big: [C]}\nparallel_field_groups: {RECEIPT: [[X, Y]]}\nline_item_column_names: {X: x, Y: y}\n"
    path = write(tmp_path, "f.yml", text)
    got = config.field_definitions(path)
    assert got.of_type("receipts") == got.of_type("receipt") == {"A"} and got.layout_fields["big"] == ("C",) and got is config.field_definitions(path)
    with pytest.raises(config.ConfigError, match="no fields for"):
        got.of_type("letters")
    with pytest.raises(config.ConfigError, match="no item column"):
        config.field_definitions(write(tmp_path, "g.yml", text.replace(", Y: y", "")))
    with pytest.raises(config.ConfigError, match="missing"):
        config.field_definitions(write(tmp_path, "h.yml", "all_columns: []\n"))


POLICY = """title_style: atx_h1
pair_separator: ": "
pair_strip_trailing_colon: true
table_style: html
empty_cell_token: ""
cell_sub_line_join: " "
cell_newline_join: " "
split_order: column_major
headerless_table: empty_header_row
carry_group_key: down
block_separator: "\\n\\n"
emphasis: none
decoration_glyphs: ".-"
decoration_min_run: 4
"""


def test_serialisation_policy(tmp_path):
    assert config.serialisation_policy(write(tmp_path, "s.yml", POLICY)).decoration_min_run == 4
    for old, new in (("title_style: atx_h1", "title_style: big"), ("decoration_min_run: 4", "decoration_min_run: 1"), ("decoration_min_run: 4", "decoration_min_run: true"), ('decoration_glyphs: ".-"', 'decoration_glyphs: ""'), ("emphasis: none\n", ""), ("emphasis: none", "emphasis: none\nother: 1")):
        with pytest.raises(config.ConfigError):
            config.serialisation_policy(write(tmp_path, "s.yml", POLICY.replace(old, new)))


def test_fitted_texts():
    wide = fit.Advances({"i": 300, "m": 900, " ": 250}, 600)

    def room(text, size):
        return sum({"i": 300, "m": 900, " ": 250}.get(c, 600) for c in text) * size / 1000

    for strategy in fit.STRATEGIES:
        for width in (10, 25, 40, 60, 120):
            for text in ("mmm iii", "a", "", "two words here", "m" * 9, "a  b", "x y z w v u"):
                lines, size, fault = fit.fitted(text, fit.Budget(width, 12, 8, 2, strategy), wide)
                if fault is None:
                    assert " ".join(lines) == text and all(room(x, size) <= width for x in lines) and len(lines) <= (1 if strategy == "shrink" else 2)
                    assert all(room(" ".join([a, b.split(" ")[0]]), size) > width for a, b in zip(lines, lines[1:]))
                else:
                    assert room(text, 8 if strategy != "wrap" else 12) > width
    with pytest.raises(ValueError):
        fit.Budget(1, 1, 1, 1, "cut")


def test_regions(spark):
    got = spark.range(1).select(fit.divide(F.lit(7), F.lit(100), F.lit(3), F.lit(4)), fit.divide_widths(F.lit(0), F.lit(50), F.array(F.lit(20), F.lit(25)), F.lit(5))).first()
    assert [tuple(x) for x in got[0]] == [(7, 31), (42, 31), (77, 30)] and [tuple(x) for x in got[1]] == [(0, 20), (25, 25)]
    for bad in (fit.divide(F.lit(0), F.lit(5), F.lit(3), F.lit(2)), fit.divide_widths(F.lit(0), F.lit(40), F.array(F.lit(20), F.lit(25)), F.lit(5)), fit.parameter(F.create_map(F.lit("a"), F.lit("b")), F.create_map(F.lit("c"), F.lit("d")), "k")):
        with pytest.raises(Exception, match="narrow|wider|no value"):
            spark.range(1).select(bad).collect()


TERMINAL = """payment_terminal:
  receipt_method_weights: {Visa: 2, Cash: 1, Phone: 1}
  acquirers: [First]
  schemes:
    Visa: {display: VISA, aid: A01, pan_digits: 16, account_types: [CR]}
  wallets: {Phone: PhonePay}
  entry_modes: {card: (c), wallet: (t)}
  wallet_presentation_weights: {none: 2, Phone: 1}
  bank_description_methods: {VISA: Visa}
  cash_tender_step: 5
  cash_extra_notes: 3
pos_terminal:
  staff_names: [Ana]
  hour_min: 8
  hour_span: 12
  register_min: 1
  register_span: 8
  receipt_number_prefix: R-
  receipt_number_digest_length: 6
"""


def test_terminal_and_till_pools(tmp_path):
    got = config.terminal_pools(write(tmp_path, "p.yml", TERMINAL))
    assert got.schemes["Visa"].pan_digits == 16 and got.tender_step == 5 and got.bank_prefixes == {"VISA": "Visa"}
    assert config.pos_pools(write(tmp_path, "p.yml", TERMINAL)).number_prefix == "R-"
    for old, new in (("cash_extra_notes: 3", "cash_extra_notes: 0"), ("VISA: Visa}", "VISA: Other}"), ("pan_digits: 16, ", ""), ("acquirers: [First]", "acquirers: []"), ("Cash: 1, Phone: 1}", "Cash: 1, Watch: 1}"), ("account_types: [CR]", "account_types: []")):
        with pytest.raises(config.ConfigError):
            config.terminal_pools(write(tmp_path, "p.yml", TERMINAL.replace(old, new)))
    for old, new in (("hour_span: 12", "hour_span: 0"), ("staff_names: [Ana]", "staff_names: [1]"), ("hour_min: 8", "hour_min: true")):
        with pytest.raises(config.ConfigError):
            config.pos_pools(write(tmp_path, "p.yml", TERMINAL.replace(old, new)))


def test_index_and_folders(spark, tmp_path):
    named = spark.createDataFrame([("scan", "a/manifest.jsonl"), ("fax", "b/manifest.jsonl"), ("raw", None)], "corpus string, manifest string")
    there = spark.createDataFrame([("a/manifest.jsonl",)], "path string")
    got = index.index_faults(named, ["manifest"], there)
    assert sorted(tuple(r) for r in got.collect()) == [("clean", "not in the index"), ("fax", "no file b/manifest.jsonl")]
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    paths = [f"{tmp_path}/real", f"{tmp_path}/link", f"file:{tmp_path}/real/", "s3://x/y", "s3://x/y/"]
    assert readers.distinct_folders(paths) == [paths[0], "s3://x/y"]


def test_skipped_entries_and_joins(spark):
    entries = spark.createDataFrame([("a", "plain", {}), ("b", "other", {}), ("c", None, {})], "case_id string, layout string, fields map<string,string>")
    assert {r.case_id: r.warning for r in layout.skipped(entries, {"plain": {"body": []}}).collect()} == {"b": "skipped: no layout other", "c": "skipped: no layout stated"}
    row = [(1, 0, "table_open", None, None), (1, 1, "row_open", None, None), (1, 2, "cell", "a\nb", "k"), (1, 3, "row_close", None, None), (1, 4, "cell_sub_line", "c", "k"), (1, 5, "table_close", None, None)]
    events_ = spark.createDataFrame(row, "page int, seq int, kind string, text string, column_key string").withColumns({"header": F.lit(False), "colspan": F.lit(1), "rowspan": F.lit(1)})
    cells = lambda **how: events.table_rows(events_, ["page"], **how).first().cells[0].text
    assert cells() == "a\nb\nc" and cells(sub_line_join=" ", newline_join="; ") == "a; b c"


def test_png(spark):
    rng = np.random.default_rng(3)
    page = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    assert (png.decode(png.encode(page)) == page).all()

    def file(colour, samples, lines, palette=b""):
        body = zlib.compress(b"".join(bytes([f]) + bytes(x) for f, x in lines))
        out = png.SIGNATURE
        for kind, content in ((b"IHDR", struct.pack(">IIBBBBB", len(lines[0][1]) // samples, len(lines), 8, colour, 0, 0, 0)), (b"PLTE", palette), (b"IDAT", body), (b"IEND", b"")):
            out += struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content)) if content or kind != b"PLTE" else b""
        return out

    def filtered(rows, kind, step):
        """The samples of rows as a filter would write them, by the format's own words."""
        out, above = [], [0] * len(rows[0])
        for row in rows:
            line = []
            for x, v in enumerate(row):
                a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
                p = a + b - c
                nearest = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                line.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
            out.append((kind, line))
            above = row
        return out

    for colour, step in ((0, 1), (2, 3), (4, 2), (6, 4)):
        samples = rng.integers(0, 256, (6, 5 * step)).astype(int).tolist()
        for kind in range(5):
            got = png.decode(file(colour, step, filtered(samples, kind, step)))
            want = np.array(samples).reshape(6, 5, step)
            assert (got == (want[:, :, :3] if step >= 3 else np.repeat(want[:, :, :1], 3, axis=2))).all()
    assert png.decode(file(3, 1, [(0, [1, 0])], bytes([1, 2, 3, 4, 5, 6]))).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    whole = png.encode(page)
    for bad in (b"x" + whole, whole[:-5], whole[:40] + bytes([whole[40] ^ 1]) + whole[41:], whole.replace(b"\x08\x02\x00\x00\x00", b"\x10\x02\x00\x00\x00", 1)):
        with pytest.raises(png.PngError):
            png.decode(bad)
    df = spark.createDataFrame([(bytearray(whole),), (None,)], "content binary").select(png.read_png(F.col("content")).alias("r"))
    back = df.select(png.write_png(F.col("r.page"), F.col("r.height"), F.col("r.width")).alias("f"), "r").collect()
    assert bytes(back[0].f) == whole and (back[0].r.height, back[0].r.width) == (9, 7) and back[1].f is None
