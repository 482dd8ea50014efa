"""Queries through files: what the writers write into the shared folder, the readers read back, beside the SQL for it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.operators import corpus, index, score
from scrivana.plans.common import Query, table
from scrivana.plans.corpora import edits_sql, misread, misread_sql
from scrivana.plans.reports import order_lists
from scrivana.sources import readers, vintages
from scrivana.sources.config import FieldDefinitions
from scrivana.staging import Scratch, shared_dir, spread

QUERIES: dict[str, Query] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return keep


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT conv_id::varchar AS case_id, 'plain' AS layout_id, turn::int AS seq, CASE role WHEN 'assistant' THEN 'pair' ELSE 'line' END AS kind, CASE WHEN role <> 'assistant' THEN text END AS text, CASE WHEN role = 'assistant' THEN 'Answer' END AS label, CASE WHEN role = 'assistant' THEN text END AS value FROM conversations""")
def events_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as event records, one a line, and back as events."""
    answer = F.col("role") == "assistant"
    meta = F.struct(F.when(answer, "Answer").alias("label"), F.when(answer, F.col("text")).alias("value"))
    event = F.struct(F.col("turn").cast("int").alias("seq"), F.when(answer, "pair").otherwise("line").alias("kind"), F.when(~answer, F.col("text")).alias("text"), meta.alias("meta"))
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("case_id"))
    records = turns.agg(F.array_sort(F.collect_list(event), lambda a, b: a["seq"] - b["seq"]).alias("events")).select("case_id", F.lit("talk").alias("doc_type"), F.lit("plain").alias("layout_id"), "events")
    at = folder(spark, "events")
    readers.write_json(records, at)
    return readers.page_events(readers.json_lines(spark, at, readers.EVENTS)).select("case_id", "layout_id", "seq", "kind", "text", "label", "value")


@query("""
SELECT doc_id || '_' || lang AS stem, 'images/' || doc_id || '_' || lang || '.png' AS image, 'transcripts/' || doc_id || '_' || lang || '.md' AS transcript, lang AS doc_type, source AS family,
  sha256(doc_id::varchar) AS sha256, sha256(lang) AS pixels_sha256, sha256(coalesce(text, '')) AS transcript_sha256 FROM documents
""")
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("stem", F.concat_ws("_", F.col("doc_id").cast("string"), "lang"))
    pages = docs.select("stem", F.col("lang").alias("doc_type"), F.lit("plain").alias("layout"), F.col("source").alias("family"), F.lit("clean").alias("severity"))
    files = docs.select("stem", F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), F.sha2("lang", 256).alias("pixels_sha256"))
    at = folder(spark, "manifest")
    readers.write_json(corpus.manifest_rows(pages, files, docs.select("stem", F.coalesce("text", F.lit("")).alias("text"))), at)
    back = readers.json_lines(spark, at, readers.MANIFEST).withColumn("stem", readers.stem_of("transcript"))
    return back.select("stem", "image", "transcript", "doc_type", "family", "sha256", "pixels_sha256", "transcript_sha256")


@query("""
SELECT source AS corpus, 'f' || lang AS family, 'light' AS severity, count(*)::int AS pages, array_to_string(list_sort(list(DISTINCT CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END)), ',') AS doc_types, sha256(source) AS manifest_sha256
FROM documents GROUP BY source, lang
""")
def matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.concat(F.lit("f"), "lang").alias("family"), F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("doc_type"))
    rows = index.matrix(docs, ["corpus", "family"]).withColumns({"severity": F.lit("light"), "manifest_sha256": F.sha2("corpus", 256)})
    at = folder(spark, "matrix")
    readers.write_json(rows, at)
    back = readers.json_lines(spark, at, readers.MATRIX)
    return back.select("corpus", "family", "severity", "pages", F.array_join("doc_types", ",").alias("doc_types"), "manifest_sha256")


@query("""SELECT conv_id || '_' || turn AS stem, length(text)::int AS chars, sha256(text) AS sha256, strlen(text)::bigint AS bytes FROM conversations""")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a turn, as page texts are written, read back whole."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stem"), "text")
    at = folder(spark, "texts")
    corpus.write_pages(turns.where(F.col("text").isNotNull()), at)
    texts = vintages.texts_below(spark, at).unionByName(turns.where(F.col("text").isNull()))  # what is no text has no file
    return texts.select("stem", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("""
SELECT source AS corpus, CASE WHEN n % 2 = 0 THEN 'scan' ELSE 'photo' END AS family, doc_id::varchar AS stem, sha256(coalesce(text, '')) AS sha256
FROM documents JOIN (SELECT source, length(source) + ascii(right(source, 1)) AS n FROM documents GROUP BY 1) USING (source)
WHERE source LIKE 'src1%' AND n % 2 = 0
""")
def pruned_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one vintage of a corpus a source, of which those of one family and one beginning are read."""
    docs = table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    even = (F.length("source") + F.ascii(F.right("source", F.lit(1)))) % 2 == 0
    index_row = F.to_json(F.struct(F.col("source").alias("corpus"), F.when(even, "scan").otherwise("photo").alias("family"), F.lit("light").alias("severity")))
    lines = docs.select("source").distinct().select(index_row.alias("line")).groupBy().agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    texts = vintages.files_of(docs, F.concat("source", F.lit("/transcripts/"), "doc_id", F.lit(".md")), F.col("text"))
    at = folder(spark, "corpora")
    vintages.write_vintage(texts.unionByName(vintages.files_of(lines, F.lit("matrix.jsonl"), F.col("lines"))), at)
    read = vintages.folder_texts(spark, at).where((F.col("family") == "scan") & F.col("corpus").startswith("src1"))
    return read.select("corpus", "family", "stem", F.sha2("text", 256).alias("sha256"))


@query("""
SELECT l_orderkey::varchar AS case_id, 'orders' AS doc_type, l_orderkey || '_orders.png' AS image, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1)::int AS line_no,
  l_partkey::varchar AS part, (l_quantity::int)::varchar AS quantity, l_returnflag AS flag FROM lineitem
""")
def extraction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an extraction export; its items read back."""
    entries, definitions = extraction(spark, sf_dir)
    at = folder(spark, "extraction")
    corpus.export_extraction(entries, entries.select(F.concat("case_id", F.lit("_orders.png")).alias("image")), definitions, at)
    return spark.read.schema("case_id string, doc_type string, image string, line_no int, part string, quantity string, flag string").json(f"{at}/line_items")


def extraction(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FieldDefinitions]:
    lists_ = order_lists(spark, sf_dir)
    fields = F.create_map(F.lit("DOCUMENT_TYPE"), F.lit("ORDER"), F.lit("PARTS"), F.col("parts"), F.lit("QUANTITIES"), F.col("quantities"), F.lit("FLAGS"), F.col("flags"))
    entries = lists_.select(F.col("l_orderkey").cast("string").alias("case_id"), F.lit("orders").alias("doc_type"), fields.alias("fields"))
    groups = {"ORDER": (("PARTS", "QUANTITIES", "FLAGS"),)}
    entries = Scratch(spark, "entries").put("entries", entries)  # the export reads them many times
    return entries, FieldDefinitions(("DOCUMENT_TYPE", "PARTS", "TOTAL"), {}, {}, groups, {"PARTS": "part", "QUANTITIES": "quantity", "FLAGS": "flag"})


@query("""
WITH l AS (SELECT l_orderkey, string_agg(l_partkey::varchar, '|' ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS parts FROM lineitem GROUP BY 1)
SELECT l_orderkey::varchar AS case_id, 'orders' AS doc_type, l_orderkey || '_orders.png' AS image, 'ORDER' AS DOCUMENT_TYPE, parts AS PARTS, 'NOT_FOUND' AS TOTAL FROM l
""")
def extraction_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of the same export as CSV, read back."""
    entries, definitions = extraction(spark, sf_dir)
    at = folder(spark, "extraction")
    readers.write_csv(corpus.extraction_rows(entries, definitions.columns), at)
    return spark.read.option("header", True).csv(at)


@query(f"""
WITH c AS (SELECT doc_id, lang, source, text, m.model, CASE WHEN doc_id % 9 <> 0 THEN CASE m.model WHEN 'alpha' THEN {misread_sql("text", "0")} ELSE {misread_sql("text", "1")} END END AS p
  FROM documents, (VALUES ('alpha'), ('beta')) m(model) WHERE lang <> 'de' OR model = 'alpha'),
d AS (SELECT *, {edits_sql("text", "p")} AS d FROM c)
SELECT model, lang AS corpus, doc_id::varchar AS case_id, source AS doc_type, 'scan' AS family, 'light' AS severity, true AS verified, length(text)::int AS ref_chars,
  length(p)::int AS pred_chars, p IS NOT NULL AS prediction_present, CASE WHEN p IS NOT NULL THEN d::int END AS strict_edit_distance,
  CASE WHEN p IS NOT NULL THEN round(CASE WHEN length(text) = 0 THEN 0 ELSE d / length(text) END, 6) END AS strict_cer,
  length(p) > 0 AND (length(text) = 0 OR length(p) > 3.0 * length(text)) AS degenerate FROM d
""")
def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for two models, each of which misreads in its own way; one has nothing for one corpus, and
    every ninth page has no prediction."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.concat_ws("_", F.col("doc_id").cast("string"), "source").alias("stem"), F.col("doc_id").cast("string").alias("case_id"), F.col("source").alias("doc_type"), F.col("text").alias("reference"), "doc_id")
    corpora = docs.select("corpus").distinct().select("corpus", F.sha2("corpus", 256).alias("manifest_sha256"), F.sha2(F.lit("prompt"), 256).alias("prompt_sha256"))
    matrix = corpora.select("corpus", "manifest_sha256", F.lit("scan").alias("family"), F.lit("light").alias("severity"))
    models = F.explode(F.array(F.struct(F.lit("alpha").alias("model"), F.lit(0).alias("kind")), F.struct(F.lit("beta").alias("model"), F.lit(1).alias("kind")))).alias("m")
    answered = (F.col("corpus") != "de") | (F.col("m.model") == "alpha")
    runs = corpora.select("corpus", "prompt_sha256", F.col("manifest_sha256").alias("corpus_manifest_sha256"), models).where(answered).select("m.model", "corpus", "prompt_sha256", "corpus_manifest_sha256")
    said = spread(docs.select("corpus", "stem", "doc_id", "reference")).select("*", models).where(answered)
    predictions = said.select("m.model", "corpus", "stem", F.when(F.col("doc_id") % 9 != 0, misread(F.col("reference"), F.col("m.kind"))).alias("prediction"))
    rows = score.score_corpora(matrix, corpora, docs, runs, predictions, allow_missing=True)
    return rows.select(*score.ROW, "ref_chars", "pred_chars", "prediction_present", "strict_edit_distance", F.round("strict_cer", 6).alias("strict_cer"), "degenerate")


@query("""
SELECT 'alpha' AS model, lang AS corpus, doc_id::varchar AS case_id, round(n_chars / 1000, 3) AS strict_cer FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 'beta', lang, doc_id::varchar, round(n_chars / 1000, 3) FROM documents WHERE doc_id % 2 = 1
""")
def scored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows of two files read as one; between them they hold every document."""
    docs = table(spark, sf_dir, "documents").withColumn("model", F.when(F.col("doc_id") % 2 == 0, "alpha").otherwise("beta"))
    rows = docs.select("model", F.col("lang").alias("corpus"), F.col("doc_id").cast("string").alias("case_id"), F.round(F.col("n_chars") / 1000, 3).alias("strict_cer"))
    at = folder(spark, "scored")
    for model in ("alpha", "beta"):
        readers.write_json(rows.where(F.col("model") == model), f"{at}/{model}")
    return readers.rows_with_columns(spark, [f"{at}/alpha", f"{at}/beta"], ["model", "corpus", "strict_cer"]).select("model", "corpus", "case_id", "strict_cer")


@query("""
SELECT key, count(*) AS records FROM (SELECT unnest(list_filter(['model_id', 'model_revision', 'generated_at', 'host'],
  lambda k: CASE k WHEN 'model_id' THEN c_custkey % 7 = 0 WHEN 'model_revision' THEN c_mktsegment = 'BUILDING' WHEN 'generated_at' THEN c_acctbal < 0 ELSE c_custkey % 3 = 0 END)) AS key FROM customer) GROUP BY key
""")
def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run record a customer; how many leave which key out, or empty."""
    key = F.col("c_custkey")
    records = table(spark, sf_dir, "customer").select(
        F.when(key % 7 != 0, key.cast("string")).alias("model_id"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("model_revision"),
        F.lit("p").alias("prompt_sha256"), F.lit("c").alias("corpus"), F.sha2("c_name", 256).alias("corpus_manifest_sha256"),
        F.when(F.col("c_acctbal") >= 0, "2024-01-01").alias("generated_at"), F.when(key % 3 == 0, "").otherwise("h").alias("host"))
    at = folder(spark, "run")
    readers.write_json(records, at, keep_nulls=False)
    return readers.run_faults(spark, at).groupBy("key").agg(F.count(F.lit(1)).alias("records"))
