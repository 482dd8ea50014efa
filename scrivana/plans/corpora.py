"""Queries on corpora, derivations, tables and events, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.functions import lists, payments, values
from scrivana.operators import corpus, events, index, score, tables
from scrivana.plans.common import Query, table
from scrivana.plans.reports import NORMAL
from scrivana.staging import spread

QUERIES: dict[str, Query] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return keep


@query("""SELECT d.doc_id, d.lang, l.quality, l.doc_id IS NOT NULL AS present FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def left_join_allow_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", "lang")
    predictions = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("prediction"))
    joined = score.with_predictions(pages, predictions, ["doc_id"], allow_missing=True)
    return joined.select("doc_id", "lang", "quality", F.col("prediction").isNotNull().alias("present"))


@query("""
SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def completeness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.set_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS t FROM documents),
b AS (SELECT CASE WHEN doc_id % 13 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'x' ELSE sha256(text) END AS t FROM documents)
SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'only_left' WHEN a.doc_id IS NULL THEN 'only_right' WHEN coalesce(a.t <> b.t, false) THEN 'different' ELSE 'same' END AS status
FROM a FULL JOIN b USING (doc_id)
""")
def vintage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, against itself with every 13th id moved, every 11th text changed and every 17th hash unstated."""
    key, digest = F.col("doc_id"), F.sha2("text", 256)
    docs = table(spark, sf_dir, "documents")
    left = docs.select("doc_id", digest.alias("transcript_sha256"))
    moved = F.when(key % 13 == 0, -key - 1).otherwise(key)
    right = docs.select(moved.alias("doc_id"), F.when(key % 17 == 0, F.lit(None)).when(key % 11 == 0, "x").otherwise(digest).alias("transcript_sha256"))
    return index.vintage_diff(left, right, "doc_id", ["transcript_sha256"])


@query("""
SELECT lang, sha256(string_agg(lpad(doc_id::varchar, 12, '0') || chr(0) || sha256(text) || chr(10), '' ORDER BY doc_id)) AS fingerprint, count(*) AS rows FROM documents GROUP BY lang
""")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("stem"), F.sha2("text", 256).alias("digest"))
    return index.fingerprint(docs, ["lang"], "stem", "digest")


@query("""
WITH p AS (SELECT DISTINCT l_returnflag, l_partkey % 250 * 10 + l_linenumber AS page FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_partkey % 250 = 7))
SELECT page, count(*) AS held_by, (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS groups FROM p GROUP BY page HAVING count(*) < (SELECT count(DISTINCT l_returnflag) FROM lineitem)
""")
def matched_page_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that not every flag has; those of one part are taken from one flag."""
    lines = table(spark, sf_dir, "lineitem")
    planted = lines.where(~((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 250 == 7)))
    return index.unmatched_members(planted.select("l_returnflag", (F.col("l_partkey") % 250 * 10 + F.col("l_linenumber")).alias("page")), ["l_returnflag"], ["page"])


@query("""SELECT lang AS family, source AS corpus, count(*) AS pages, array_to_string(list_sort(list(DISTINCT CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END)), ',') AS doc_types FROM documents GROUP BY ALL""")
def matrix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("family"), F.col("source").alias("corpus"), F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("doc_type"))
    return index.matrix(docs, ["family", "corpus"]).withColumn("doc_types", F.array_join("doc_types", ","))


@query("""
SELECT source AS corpus, 'doc_' || doc_id AS case_id, lang AS doc_type FROM documents UNION ALL SELECT 'pages', 'page_' || page_id, 'html' FROM pages
""")
def pooled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.concat(F.lit("doc_"), "doc_id", F.lit("_"), "lang").alias("stem"), F.col("lang").alias("doc_type"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("corpus"), F.concat(F.lit("page_"), "page_id", F.lit("_html")).alias("stem"), F.lit("html").alias("doc_type"))
    return docs.unionByName(pages).select("corpus", index.case_of(F.col("stem"), F.col("doc_type")).alias("case_id"), "doc_type")


@query("""
WITH old AS (SELECT o_orderkey, o_orderstatus AS v, o_orderkey AS seq FROM orders),
new AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_orderpriority AS v, -o_orderkey AS seq FROM orders),
gone AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 15 = 0),
b AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.v, o.v) AS v, o.o_orderkey IS NULL AS a, coalesce(o.seq, n.seq) AS s FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
      WHERE n.o_orderkey IS NOT NULL OR o.o_orderkey NOT IN (FROM gone))
SELECT o_orderkey, v, (row_number() OVER (ORDER BY a, s) - 1)::bigint AS position FROM b
""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, upserted by itself with every third key moved; of those, the images of every fifth are gone."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    old = orders.select("o_orderkey", F.col("o_orderstatus").alias("v"), key.alias("seq"))
    new = orders.select(F.when(key % 3 == 0, -key - 1).otherwise(key).alias("o_orderkey"), F.col("o_orderpriority").alias("v"), (-key).alias("seq"))
    there = orders.where(key % 15 != 0).select("o_orderkey")
    return index.numbered(index.keyed_upsert(old, new, ["o_orderkey"], "seq", there), "place")


@query("""SELECT n_nationkey, r_name AS tier FROM nation CROSS JOIN region""")
def model_corpus_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = table(spark, sf_dir, "region").select(F.col("r_name").alias("tier"))
    return corpus.in_tiers(table(spark, sf_dir, "nation").select("n_nationkey"), tiers)


_PREFIXES = [("STANDARD", "s1"), ("STANDARD ANODIZED", "s2"), ("SMALL", "m1"), ("ECONOMY", "e1"), ("ECONOMY BRUSHED", "e2"), ("PROMO", "p1"), ("LARGE BURNISHED", "l2")]
_PREFIX_VALUES = ", ".join(f"('{p}', '{s}')" for p, s in _PREFIXES)


@query(f"""
WITH x(prefix, scheme) AS (VALUES {_PREFIX_VALUES})
SELECT p_partkey, p_type, arg_max(scheme, length(prefix)) AS scheme FROM part LEFT JOIN x ON starts_with(p_type, prefix) GROUP BY ALL
""")
def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = spark.createDataFrame(_PREFIXES, "prefix string, scheme string")
    return index.longest_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", prefixes, "prefix", "scheme")


@query("""
WITH b(name) AS (VALUES ('Asia NATION_1'), ('EUROPE nation_2'), ('africa Nowhere'), ('ASIA FRANCE'), ('Europe germany'), ('AMERICA CANADA extra'))
SELECT DISTINCT name FROM b JOIN region ON true JOIN nation ON true WHERE lower(name) = lower(r_name) || ' ' || lower(n_name)
""")
def reachable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.createDataFrame([(x,) for x in ("Asia NATION_1", "EUROPE nation_2", "africa Nowhere", "ASIA FRANCE", "Europe germany", "AMERICA CANADA extra")], "name string")
    return index.reachable_names(table(spark, sf_dir, "region").select(F.col("r_name").alias("word")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")), blocked)


_WEIGHTS = ", ".join(map(str, values.ABN_WEIGHTS))


@query(f"""
WITH d AS (SELECT c_custkey, substr(sha256(c_custkey::varchar), 1, 15) AS h FROM customer),
n AS (SELECT c_custkey, lpad((('0x' || h)::bigint % 100000000000)::varchar, 11, '0') AS abn FROM d)
SELECT c_custkey, abn, list_sum(list_transform(range(1, 12), lambda i: (substr(abn, i, 1)::int - (i = 1)::int) * [{_WEIGHTS}][i])) % 89 = 0 AS valid FROM n
""")
def abn_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = values.hash_slice(F.sha2(F.col("c_custkey").cast("string"), 256), 0, 15) % 100000000000
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(number.cast("string"), 11, "0").alias("abn"))
    return rows.select("c_custkey", "abn", values.abn_is_valid(F.col("abn")).alias("valid"))


POOLS = payments.TerminalPools(
    method_weights={"Visa": 3, "Cash": 2, "Amex": 1}, acquirers=("First", "Second"),
    schemes={"Visa": payments.Scheme("VISA CREDIT", "A01", 16, ("CR",)), "Amex": payments.Scheme("AMERICAN EXPRESS", "A25", 15, ("CR",)), "Debit": payments.Scheme("eftpos", "A38", 16, ("SAV", "CHQ"))},
    wallets={"Phone Pay": "PhonePay"}, presentation_weights={"none": 2, "Phone Pay": 1}, bank_prefixes={"VISA": "Visa", "VISA DEBIT": "Debit", "EFTPOS": "Debit"},
)


@query("""
WITH h AS (SELECT doc_id, sha256(doc_id || '|' || lang || '|' || source) AS x, sha256('CASE' || doc_id || ':pos:01/02/2024') AS t FROM documents)
SELECT doc_id, ('0x' || substr(x, 1, 8))::bigint & 2147483647 AS seed,
  ['Amex', 'Cash', 'Cash', 'Visa', 'Visa', 'Visa'][(('0x' || substr(t, 11, 4))::bigint % 6 + 1)::int] AS method,
  lpad((8 + ('0x' || substr(t, 1, 2))::bigint % 12)::varchar, 2, '0') || ':' || lpad((('0x' || substr(t, 3, 2))::bigint % 60)::varchar, 2, '0') AS pos_time FROM h
""")
def hash_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    case, date = F.concat(F.lit("CASE"), F.col("doc_id").cast("string")), F.lit("01/02/2024")
    slip = payments.slip(case, date, F.col("n_chars").cast("decimal(18,2)"), F.lit("10:00"), POOLS)
    till = values.receipt_pos(case, date, values.PosPools(("Ana", "Ben", "Cleo")))
    return docs.select("doc_id", values.page_seed(F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("seed"), slip["method"].alias("method"), till["POS_TIME"].alias("pos_time"))


@query("""
WITH h AS (SELECT o_orderkey, sha256(o_orderkey::varchar) AS x FROM orders),
c AS (SELECT o_orderkey, list_transform(range(0, 16), lambda i: ('0x' || substr(x, (i * 4 + 1)::int, 4))::hugeint) AS c FROM h)
SELECT o_orderkey, lpad((list_reduce(c, lambda a, b: (a * 65536 + b) % 10000000000))::varchar, 10, '0') AS reference FROM c
""")
def bank_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", values.bank_reference(F.col("o_orderkey").cast("string")).alias("reference"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders)
SELECT o_orderstatus, count(*) AS rows, array_to_string(list(o_orderkey ORDER BY o_orderkey) FILTER (k <= 3), ',') AS examples FROM r GROUP BY 1
""")
def top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.examples(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey", 3)
    return found.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one order in one place, so that what is put together by order moves once."""
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"), "l_orderkey")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as the rows of a table with a header row."""

    def cells(*texts):
        return F.array(*(F.struct(t.cast("string").alias("text"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan")) for t in texts))

    place = (F.col("l_linenumber") * 10000000000 + F.col("l_partkey")) * 256 + F.ascii("l_returnflag")
    lines = order_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct(place.alias("place"), "l_linenumber", "l_partkey", "l_returnflag")).alias("x"))

    def row(place, header: bool, *texts):
        return F.struct(place.alias("place"), F.lit(header).alias("header"), cells(*texts).alias("cells"))

    head = row(F.lit(0).cast("long"), True, F.lit("No"), F.lit("Item"), F.lit("Flag"))
    body = F.transform("x", lambda x: row(x["place"], False, x["l_linenumber"], F.concat(F.lit("A&B <"), x["l_partkey"].cast("string"), F.lit(">")), x["l_returnflag"]))
    return lines.select("l_orderkey", F.explode(F.concat(F.array(head), body)).alias("r")).select("l_orderkey", "r.*")


@query("""
SELECT l_orderkey, '<table><thead><tr><th>No</th><th>Item</th><th>Flag</th></tr></thead><tbody>' || string_agg('<tr><td>' || l_linenumber || '</td><td>A&amp;B &lt;' || l_partkey || '&gt;</td><td>' || l_returnflag || '</td></tr>', '' ORDER BY l_linenumber, l_partkey, l_returnflag) || '</tbody></table>' AS html
FROM lineitem GROUP BY l_orderkey
""")
def table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.render_tables(order_rows(spark, sf_dir), ["l_orderkey"], "place")


@query("""
SELECT l_orderkey, 0 AS row_no, 'No|Item|Flag' AS cells FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag)::int, l_linenumber || '|A&B <' || l_partkey || '>|' || l_returnflag FROM lineitem
""")
def table_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = table_render(spark, sf_dir).select("l_orderkey", tables.parse_tables("html")[0].alias("grid"))
    return grids.select("l_orderkey", F.posexplode("grid").alias("row_no", "row")).select("l_orderkey", "row_no", F.array_join("row", "|").alias("cells"))


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, (3 * (n + 1))::int AS table_cells_compared, (CASE WHEN l_orderkey % 2 = 0 THEN 3 * n WHEN l_orderkey % 3 = 0 THEN 3 * (n + 1) - 1 ELSE 3 * (n + 1) END)::int AS table_cells_correct,
  0 AS table_cells_misplaced, (l_orderkey % 2 = 0)::int AS table_rows_missing, 0 AS table_rows_spurious, 1 AS table_count_ref, 1 AS table_count_pred,
  round(CASE WHEN l_orderkey % 2 = 0 THEN 3 WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END / (3 * (n + 1)), 6) AS table_cell_error_rate FROM n
""")
def table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders lose their header row; of the rest, every third has one heading changed."""
    key = F.col("l_orderkey")
    lost = F.regexp_replace("html", "<thead>.*</thead>", "")
    changed = F.replace(F.col("html"), F.lit("<th>Flag</th>"), F.lit("<th>Flags</th>"))
    pages = table_render(spark, sf_dir).select("l_orderkey", F.col("html").alias("reference"), F.when(key % 2 == 0, lost).when(key % 3 == 0, changed).otherwise(F.col("html")).alias("prediction"))
    return tables.score_tables(pages, ["l_orderkey"], "reference", "prediction").withColumn("table_cell_error_rate", F.round("table_cell_error_rate", 6))


@query("""
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '# ' || text WHEN 'user' THEN text ELSE 'Answer: ' || text END, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id
""")
def transcript_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "title").when(F.col("role") == "user", "line").otherwise("pair")
    blocks = table(spark, sf_dir, "conversations").select("conv_id", "turn", events.block_text(kind, F.col("text"), F.lit("Answer:"), F.col("text")).alias("block"))
    return events.transcripts(blocks, ["conv_id"], "turn", "block")


#: How predictions misread their texts: letters replaced, then ``tion`` shortened (0), lengthened (1) or left (2).
#: The wrong letter stands in no text, so each one costs an edit, and a shorter text as many more as it lacks; no text
#: both lacks and gains letters. tests/test_text.py holds the query against whole tables of distances.
MISREAD = (("ing", "жng"), ("ein", "жin"), ("le", "lж"), ("os", "жs"))
RESIZED = ("tж", "tжжion", "tion")


def misread(text: Column, kind: Column) -> Column:
    out = F.when(kind == 0, F.replace(text, F.lit("tion"), F.lit(RESIZED[0]))).when(kind == 1, F.replace(text, F.lit("tion"), F.lit(RESIZED[1]))).otherwise(text)
    for right, wrong in MISREAD:
        out = F.replace(out, F.lit(right), F.lit(wrong))
    return out


def misread_sql(text: str, kind: str) -> str:
    out = f"CASE {kind} WHEN 0 THEN replace({text}, 'tion', '{RESIZED[0]}') WHEN 1 THEN replace({text}, 'tion', '{RESIZED[1]}') ELSE {text} END"
    for right, wrong in MISREAD:
        out = f"replace({out}, '{right}', '{wrong}')"
    return out


def edits_sql(reference: str, prediction: str) -> str:
    return f"(length({prediction}) - length(replace({prediction}, 'ж', '')) + greatest(length({reference}) - length({prediction}), 0))"


@query(f"""
WITH p AS (SELECT doc_id, text AS r, CASE WHEN doc_id % 9 <> 0 THEN {misread_sql("text", "doc_id % 3")} END AS p FROM documents),
n AS (SELECT *, {NORMAL.format('r')} AS rn, {NORMAL.format('p')} AS pn FROM p),
w AS (SELECT *, {edits_sql("r", "p")} AS d, {edits_sql("rn", "pn")} AS dn, list_filter(string_split(pn, ' '), lambda x: x <> '') AS ws FROM n)
SELECT doc_id, length(r)::int AS ref_chars, length(p)::int AS pred_chars, p IS NOT NULL AS prediction_present,
  CASE WHEN p IS NOT NULL THEN d::int END AS strict_edit_distance, CASE WHEN p IS NULL THEN NULL WHEN length(r) = 0 THEN 0 ELSE d / length(r) END AS strict_cer,
  CASE WHEN p IS NOT NULL THEN dn::int END AS normalised_edit_distance, CASE WHEN p IS NULL THEN NULL WHEN length(rn) = 0 THEN 0 ELSE dn / length(rn) END AS normalised_cer,
  CASE WHEN p IS NULL THEN NULL WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda x: contains(x, 'ж'))) / len(ws) END AS normalised_wer,
  length(p) > 0 AND (length(r) = 0 OR length(p) > 3.0 * length(r)) AS degenerate FROM w
""")
def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against itself misread: replaced, dropped and added letters; every ninth has no prediction."""
    docs, key = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), F.col("doc_id")
    pages = docs.select("doc_id", F.col("text").alias("reference"), F.when(key % 9 != 0, misread(F.col("text"), key % 3)).alias("prediction"))
    return score.score_pages(pages, ["doc_id"], tables=False).drop("reference", "prediction")


@query("""
SELECT c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment || ',' AS text FROM customer
""")
def interpolate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("NAME"), F.col("c_name"), F.lit("SEGMENT"), F.col("c_mktsegment"), F.lit("NONE"), F.lit("NOT_FOUND"))
    return table(spark, sf_dir, "customer").select("c_custkey", lists.interpolate(F.lit("Dear {NAME}{NONE} of {SEGMENT},"), fields).alias("text"))


@query("""SELECT o_orderkey, ((floor(o_totalprice::decimal(18,2) / 5) + 1 + o_orderkey % 3) * 5)::double AS tendered FROM orders""")
def cash_tender(spark: SparkSession, sf_dir: str) -> DataFrame:
    tendered, _ = values.cash_tender(F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey") % 3, 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", tendered.cast("double").alias("tendered"))
