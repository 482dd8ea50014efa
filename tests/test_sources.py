import json

import pytest

from scrivana.operators import events, report
from scrivana.sources import config, readers
from scrivana.streaming import live


def test_config_is_closed(tmp_path):
    p = tmp_path / "g.yml"
    p.write_text("C1:\n  layout: l\n  fields: {A: 'x', B: true, C: 1.5}\n")
    assert config.ground_truth(p) == [{"case_id": "C1", "layout": "l", "fields": {"A": "x", "B": "true", "C": "1.5"}}]
    p.write_text("C1:\n  layout: l\n")
    with pytest.raises(config.ConfigError, match="missing keys"):
        config.ground_truth(p)
    p.write_text("layouts: {a: {body: []}}\n_anchor: 1\nstray: 2\n")
    with pytest.raises(config.ConfigError, match="stray"):
        config.layouts(p)
    p.write_text("scan:\n  light: {suffix: s, geometry: {mode: skew}}\n  heavy: {suffix: s, geometry: {mode: warp}}\n")
    with pytest.raises(config.ConfigError, match="suffix"):
        config.tiers(p)
    with pytest.raises(config.ConfigError):
        config.resolve_path("${SURELY_NOT_SET}/x", tmp_path)


def test_scoring_policy(tmp_path):
    good = "normalisation: {unicode_form: NFKC, fold_dashes: true, fold_quotes: true, strip_markdown: true, collapse_whitespace: true, fold_case: false}\nreporting: {degenerate_length_multiple: 3.0, percentiles: [50, %s]}\ntables: {cell_comparison: strict}\n"
    p = tmp_path / "s.yml"
    p.write_text(good % "90")
    assert config.scoring_policy(p).percentiles == (50, 90)
    p.write_text(good % "true")
    with pytest.raises(config.ConfigError):
        config.scoring_policy(p)


def test_readers(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "A_receipt.md").write_text("one\ntwo")
    assert readers.texts(spark, str(tmp_path / "p")).collect()[0][:] == ("A_receipt", "one\ntwo")
    m = tmp_path / "manifest.jsonl"
    m.write_text(json.dumps({"image": "i/A_receipt.png", "transcript": "t/A_receipt.md", "doc_type": "receipt"}) + "\n")
    row = readers.manifest(spark, str(m)).first()
    assert row.stem == "A_receipt" and len(row.manifest_sha256) == 64
    run = tmp_path / "run.json"
    run.write_text(json.dumps({"model_id": "m", "host": ""}) + "\n")
    assert {r[0] for r in readers.run_faults(spark, str(run)).collect()} == {"model_revision", "prompt_sha256", "corpus", "corpus_manifest_sha256", "generated_at", "host"}
    readers.write_json(spark.range(1), str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        readers.write_json(spark.range(1), str(tmp_path / "out"))


def test_events(spark):
    rows = [("p", i, k, None, False, "c", 1, 1) if k not in ("cell", "cell_sub_line") else ("p", i, k, t, False, "c", 1, 1) for i, (k, t) in enumerate([("table_open", 0), ("row_open", 0), ("cell", "a"), ("cell_sub_line", "b"), ("row_close", 0), ("table_close", 0), ("line", 0)])]
    df = spark.createDataFrame(rows, "page string, seq int, kind string, text string, header boolean, column_key string, colspan int, rowspan int")
    assert events.unbalanced(df, ["page"]).count() == 0
    row = events.table_rows(df, ["page"]).first()
    assert (row.table_no, row.row_no, row.cells[0].text) == (1, 1, "a\nb")
    assert events.table_numbers(df, ["page"]).where("kind = 'line'").first().table_no is None


def test_report_rejects_unknown_keys(spark):
    with pytest.raises(ValueError, match="unknown group keys"):
        report.report(spark.range(1), ["colour"])
    assert report.as_markdown(spark.createDataFrame([("a|b", 1.5, None)], "k string, v double, n string")).endswith("| a\\|b | 1.5000 | — |\n")


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:{i:02d}:00", "m", float(i) if i % 3 else None) for i in range(20)], "t string, model string, cer double").selectExpr("cast(t as timestamp) t", "model", "cer")
    rows.write.json(str(tmp_path / "in"))
    stream = live.windowed_report(live.scored_rows(spark, str(tmp_path / "in"), "t timestamp, model string, cer double"), "t", ["model"], "cer")
    stream.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(r.window_start, r.pages, r.missing, r["mean"]) for r in spark.table("live").collect()}
    want = {(r.window_start, r.pages, r.missing, r["mean"]) for r in live.windowed_report(rows, "t", ["model"], "cer").collect()}
    assert got == want and len(got) == 2
