"""Queries on configurations, images and tables in odd spellings, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.functions import image, png
from scrivana.operators import tables
from scrivana.plans.common import Query, table
from scrivana.plans.corpora import order_lines
from scrivana.sources import config, readers
from scrivana.staging import spread

QUERIES: dict[str, Query] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return keep


def parsed(text: str, read: Callable, name: str = "given.yml", *more):
    """What a reader makes of a YAML text. Configurations are the driver's own files, so they lie beside it."""
    with tempfile.TemporaryDirectory() as folder:
        os.mkdir(f"{folder}/config")
        path = f"{folder}/config/{name}"
        with open(path, "w", encoding="utf-8") as out:
            out.write(text)
        return read(path, *more)


@query("""
SELECT n_nationkey::varchar AS case_id, 'plain' AS layout, 'notes' AS doc_type, CASE n_nationkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN n_regionkey::varchar ELSE NULL END AS flag, n_name AS name FROM nation
""")
def yaml_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as authored entries in YAML, whose scalars become strings."""
    rows = table(spark, sf_dir, "nation").collect()  # 25 rows, as a file that people write
    flag = lambda r: [True, r.n_regionkey, None][r.n_nationkey % 3]
    text = yaml.safe_dump({str(r.n_nationkey): {"layout": "plain", "fields": {"NAME": r.n_name, "FLAG": flag(r)}} for r in rows})
    entries = parsed(text, lambda path: readers.entries(spark, {"notes": path}))
    return entries.select("case_id", "layout", "doc_type", F.col("fields")["FLAG"].alias("flag"), F.col("fields")["NAME"].alias("name"))


SERIALISATION = """
title_style: atx_h1
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
SCORING = """
normalisation: {unicode_form: NFKC, fold_dashes: true, fold_quotes: true, strip_markdown: true, collapse_whitespace: true, fold_case: false}
reporting: {degenerate_length_multiple: 3.0, percentiles: [50, 90]}
tables: {cell_comparison: normalised}
"""
TIERS = "scan: {light: {suffix: _sl, geometry: {mode: skew}}, heavy: {suffix: _sh, geometry: {mode: skew}}}\nphoto: {light: {suffix: _pl, geometry: {mode: warp}}}\n"
FIELDS = "all_columns: [A, B]\ndocument_fields: {receipt: [A]}\nlayout_fields: {big: [C]}\nparallel_field_groups: {RECEIPT: [[X, Y]]}\nline_item_column_names: {X: x, Y: y}\n"


@query("""
SELECT * FROM (VALUES ('run', 'output', 'v1/output'), ('run', 'derived', 'v1/derived'), ('run', 'retired', 'refused'), ('serialisation', 'carry_group_key', 'down'), ('serialisation', 'decoration_min_run', '4'), ('serialisation', 'unknown', 'refused'),
  ('scoring', 'percentiles', '50,90'), ('scoring', 'zero', 'refused'), ('tiers', 'suffixes', '_sl,_sh,_pl'), ('tiers', 'turned', 'refused'), ('fields', 'receipts', 'A'), ('fields', 'unnamed', 'refused'),
  ('layouts', 'ids', 'a,b'), ('layouts', 'stray', 'refused'), ('selection', 'families', 'scan'), ('selection', 'twice', 'refused'), ('pools', 'staff', 'Ana'), ('pools', 'empty', 'refused')) t(file, key, value)
""")
def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What configurations say, and planted faults in them that are refused."""

    def refused(text: str, read: Callable, *more) -> str:
        try:
            parsed(text, read, "given.yml", *more)
            return "taken"
        except config.ConfigError:
            return "refused"

    run = "dataset_root: /data/v1\nground_truth_dir: truth\ndocument_types: {r: {ground_truth: g, layouts: l, output_subdir: s}}\n"
    got = parsed(run, config.run_config)
    policy, scoring = parsed(SERIALISATION, config.serialisation_policy), parsed(SCORING, config.scoring_policy)
    staff = {"staff_names": list}
    rows = [
        ("run", "output", str(got.output_dir.relative_to("/data"))), ("run", "derived", str(got.derived_dir.relative_to("/data"))), ("run", "retired", refused(run + "exports_dir: x\n", config.run_config)),
        ("serialisation", "carry_group_key", policy.carry_group_key), ("serialisation", "decoration_min_run", str(policy.decoration_min_run)), ("serialisation", "unknown", refused(SERIALISATION + "more: 1\n", config.serialisation_policy)),
        ("scoring", "percentiles", ",".join(map(str, scoring.percentiles))), ("scoring", "zero", refused(SCORING.replace("[50, 90]", "[0]"), config.scoring_policy)),
        ("tiers", "suffixes", ",".join(t.suffix for t in parsed(TIERS, config.tiers))), ("tiers", "turned", refused(TIERS.replace("warp", "turn"), config.tiers)),
        ("fields", "receipts", ",".join(sorted(parsed(FIELDS, config.field_definitions).of_type("receipts")))), ("fields", "unnamed", refused(FIELDS.replace(", Y: y", ""), config.field_definitions)),
        ("layouts", "ids", ",".join(parsed("_x: &x {t: 1}\nlayouts: {a: *x, b: {t: 2}}\n", config.layouts))), ("layouts", "stray", refused("other: {}\nlayouts: {a: {}}\n", config.layouts)),
        ("selection", "families", ",".join(parsed("doc_types: [r]\nfamilies: [scan]\n", config.selection, "s.yml", ["r"], ["scan", "photo"]).families)), ("selection", "twice", refused("doc_types: [r]\nfamilies: [scan, scan]\n", config.selection, ["r"], ["scan"])),
        ("pools", "staff", ",".join(parsed("pos: {staff_names: [Ana]}\n", config.pools, "p.yml", "pos", staff)["staff_names"])), ("pools", "empty", refused("pos: {staff_names: []}\n", config.pools, "pos", staff)),
    ]
    return spark.createDataFrame(rows, "file string, key string, value string")


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(['TOTAL', 'DATE', p_brand, p_type])), ',') AS known FROM part
""")
def known_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared fields and those that a provider emits, each once."""
    declared, emitted = F.array(F.lit("TOTAL"), F.lit("DATE"), F.col("p_brand")), F.array(F.col("p_brand"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(declared, emitted)), ",").alias("known"))


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, (3 * n)::int AS table_cells_compared, (3 * n - CASE WHEN l_orderkey % 3 = 0 THEN 1 WHEN l_orderkey % 3 = 1 THEN 2 ELSE 0 END)::int AS table_cells_correct, (CASE WHEN l_orderkey % 3 = 1 THEN 2 ELSE 0 END)::int AS table_cells_misplaced,
  0 AS table_rows_missing, ((l_orderkey % 5 = 0)::int + (l_orderkey % 7 = 0)::int)::int AS table_rows_spurious, 1 AS table_count_ref, (1 + (l_orderkey % 7 = 0)::int)::int AS table_count_pred FROM n
""")
def table_score_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in other spellings (entities, ligatures, wide letters, odd spaces and quotes) are right; of the tables, every
    third has a wrong cell in its first row, the next ones two cells there that changed places, every fifth a row too many,
    every seventh a table of one empty row too many."""
    key = F.col("l_orderkey")
    by = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")))
    rows = order_lines(spark, sf_dir).groupBy("l_orderkey").agg(by.alias("x"))
    row = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))
    ours = lambda x, i: row(F.concat(F.lit("&#xFB01;x ＜"), x["l_partkey"].cast("string"), F.lit("／table＞")), F.concat(F.lit("“"), i.cast("string"), F.lit("”")), F.concat(x["q"].cast("string"), F.lit("&nbsp;–"), x["l_returnflag"]))

    def theirs(x, i):
        name, place = F.concat(F.lit("fix &lt;"), x["l_partkey"].cast("string"), F.lit("/table&gt;")), F.concat(F.lit('"'), i.cast("string"), F.lit('"'))
        last = F.concat(x["q"].cast("string"), F.lit(" -"), x["l_returnflag"])
        wrong = row(name, place, F.lit("other"))
        return F.when((i == 0) & (key % 3 == 0), wrong).when((i == 0) & (key % 3 == 1), row(place, name, last)).otherwise(row(name, place, last))

    whole = lambda f: F.concat(F.lit("<table>"), F.array_join(F.transform("x", f), ""))
    extra = F.when(key % 5 == 0, "<tr><td>more</td></tr>").otherwise("")
    second = F.when(key % 7 == 0, "<table><tr></tr></table>").otherwise("")
    pages = rows.select("l_orderkey", F.concat(whole(ours), F.lit("</table>")).alias("reference"), F.concat(whole(theirs), extra, F.lit("</table>"), second).alias("prediction"))
    return tables.score_tables(pages, ["l_orderkey"], "reference", "prediction").drop("table_cell_error_rate")


@query("""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) || '000000' AS h FROM documents),
p AS (SELECT doc_id, substr(h, 1, length(h) - length(h) % 6) AS h FROM t)
SELECT doc_id, 1 AS height, (length(h) // 6)::int AS width, sha256('RGB' || (length(h) // 6) || 'x1' || chr(0) || h) AS pixels FROM p
""")
def png_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of texts as the pixels of pages of one line, written as PNG and read again."""
    raw = F.concat(F.hex(F.coalesce("text", F.lit(""))), F.lit("000000"))
    whole = F.unhex(F.substring(raw, F.lit(1), F.length(raw) - F.length(raw) % 6))
    pages = table(spark, sf_dir, "documents").select("doc_id", png.write_png(whole, F.lit(1), (F.length(whole) / 3).cast("int")).alias("file"))
    read = pages.select("doc_id", png.read_png(F.col("file")).alias("r")).select("doc_id", "r.height", "r.width", F.hex("r.page").alias("h"))
    return read.select("doc_id", "height", "width", F.sha2(F.concat(F.lit("RGB"), F.col("width").cast("string"), F.lit("x1"), F.lit("\0"), F.col("h")), 256).alias("pixels"))


@query("""
WITH p AS (SELECT p_partkey, 40 + p_size AS c, p_type = 'PROMO' AS faded FROM part),
d AS (SELECT *, floor(c * 0.5 + 0.5)::int AS dark FROM p)
SELECT p_partkey, sha256(unhex(hex('RGB4x3') || repeat(printf('%02X', dark), 36))) AS last_sha256, 'effects:blur,' || CASE WHEN faded THEN 'effects:light,' ELSE '' END || 'marks:folds,placement:skew,photometrics:dark' AS steps FROM d
""")
def treated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat pages through a treatment whose steps leave them flat, but for one that halves their brightness."""
    treatment = image.Treatment(
        photometrics=(image.Step("dark", image.brightness(0.5)),), placement=(image.Step("skew", image.skew(0.0)),), marks=(image.Step("folds", image.folds((1, 2), (0.2, 0.3), 0.0)),),
        effects=(image.Step("blur", image.soften(1.5)), image.Step("light", image.lighting(255, 30, 0.0), frozenset({"PROMO"}))),
    )
    level = F.format_string("%02X", 40 + F.col("p_size"))
    page = F.unhex(F.repeat(level, 36))
    states = image.digests(page, F.lit(3), F.lit(4), F.col("p_partkey"), treatment, F.col("p_name"), F.col("p_type"))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_type")).select("p_partkey", states.alias("s"))
    said = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["phase"], x["step"])), ",")
    return rows.select("p_partkey", F.element_at("s", -1)["sha256"].alias("last_sha256"), said.alias("steps"))
