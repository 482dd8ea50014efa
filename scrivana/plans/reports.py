"""Queries on reports, texts and lists, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivana.functions import lists, text, values
from scrivana.operators import report, windows
from scrivana.plans.common import Query, table

QUERIES: dict[str, Query] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return keep



@query("""
WITH r AS (SELECT l_returnflag, l_linestatus, l_returnflag <> 'N' AS present, l_discount AS m, l_tax AS t, l_quantity > 45 AS bad, l_linenumber AS k, l_tax < 0.08 OR l_returnflag <> 'R' AS v FROM lineitem),
g AS (SELECT l_returnflag AS family, l_linestatus AS severity, count(*) AS pages, count(*) FILTER (NOT present) AS missing, count(*) FILTER (bad) AS degenerate,
  coalesce(sum(k) FILTER (present), 0)::bigint AS table_rows_missing, list_sort(list(m) FILTER (present)) AS ms, list_sort(list(t) FILTER (present)) AS ts,
  avg(m) FILTER (present) AS am, avg(t) FILTER (present) AS tm, bool_and(v) AS verified FROM r GROUP BY ALL)
SELECT family, severity, pages, missing, degenerate, table_rows_missing, verified,
  ms[greatest(1, (50 * len(ms) + 99) // 100)] AS strict_cer_p50, ms[greatest(1, (90 * len(ms) + 99) // 100)] AS strict_cer_p90, ms[greatest(1, len(ms))] AS strict_cer_p100, round(am, 6) AS strict_cer_mean,
  ts[greatest(1, (50 * len(ts) + 99) // 100)] AS normalised_wer_p50, ts[greatest(1, (90 * len(ts) + 99) // 100)] AS normalised_wer_p90, ts[greatest(1, len(ts))] AS normalised_wer_p100, round(tm, 6) AS normalised_wer_mean
FROM g
""")
def report_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("severity"), (F.col("l_returnflag") != "N").alias("prediction_present"),
        F.col("l_discount").alias("strict_cer"), F.col("l_tax").alias("normalised_wer"), (F.col("l_quantity") > 45).alias("degenerate"),
        F.col("l_linenumber").alias("table_rows_missing"), ((F.col("l_tax") < 0.08) | (F.col("l_returnflag") != "R")).alias("verified"))
    out = report.report(rows, ["family", "severity"], metrics=("strict_cer", "normalised_wer"), counts=("table_rows_missing",))
    return out.withColumns({c: F.round(c, 6) for c in ("strict_cer_mean", "normalised_wer_mean")})


@query("""
WITH r AS (SELECT l_returnflag AS model, l_linestatus AS corpus, l_linenumber::varchar AS doc_type, CASE WHEN l_quantity < 25 THEN 'scan' WHEN l_quantity < 50 THEN 'photo' END AS family, o_orderpriority AS severity,
  l_returnflag <> 'N' OR l_linenumber = 2 AS present, sqrt(l_extendedprice) AS m, CASE WHEN l_linenumber <> 3 THEN sqrt(l_discount + l_tax + 0.01) END AS t, l_quantity > 45 AS bad, l_linenumber AS k, l_tax < 0.08 OR l_returnflag <> 'R' AS v
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT grouping(model, corpus, doc_type, family, severity)::int AS grouping, model, corpus, doc_type, family, severity, count(*) AS pages, count(*) FILTER (NOT present) AS missing, count(*) FILTER (bad) AS degenerate,
  coalesce(sum(k) FILTER (present), 0)::bigint AS table_rows_missing, coalesce(list_sort(list(m) FILTER (present)), []) AS ms, coalesce(list_sort(list(t) FILTER (present AND t IS NOT NULL)), []) AS ts,
  avg(m) FILTER (present) AS am, avg(t) FILTER (present) AS tm, bool_and(v) AS verified FROM r GROUP BY CUBE (model, corpus, doc_type, family, severity))
SELECT grouping, model, corpus, doc_type, family, severity, pages, missing, degenerate, table_rows_missing, verified,
  ms[greatest(1, (50 * len(ms) + 99) // 100)] AS strict_cer_p50, ms[greatest(1, (90 * len(ms) + 99) // 100)] AS strict_cer_p90, ms[greatest(1, len(ms))] AS strict_cer_p100, round(am, 4) AS strict_cer_mean,
  ts[greatest(1, (50 * len(ts) + 99) // 100)] AS normalised_wer_p50, ts[greatest(1, (90 * len(ts) + 99) // 100)] AS normalised_wer_p90, ts[greatest(1, len(ts))] AS normalised_wer_p100, round(tm, 6) AS normalised_wer_mean
FROM g
""")
def report_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items reported by all 32 subsets of five keys, one of which is null for some."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    rows = lines.select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("corpus"), F.col("l_linenumber").cast("string").alias("doc_type"), F.when(F.col("l_quantity") < 25, "scan").when(F.col("l_quantity") < 50, "photo").alias("family"),
        F.col("o_orderpriority").alias("severity"), ((F.col("l_returnflag") != "N") | (F.col("l_linenumber") == 2)).alias("prediction_present"), F.sqrt("l_extendedprice").alias("strict_cer"),
        F.when(F.col("l_linenumber") != 3, F.sqrt(F.col("l_discount") + F.col("l_tax") + 0.01)).alias("normalised_wer"), (F.col("l_quantity") > 45).alias("degenerate"),
        F.col("l_linenumber").alias("table_rows_missing"), ((F.col("l_tax") < 0.08) | (F.col("l_returnflag") != "R")).alias("verified"))
    out = report.report_cube(rows, list(report.KEYS), metrics=("strict_cer", "normalised_wer"), counts=("table_rows_missing",))
    return out.withColumns({"strict_cer_mean": F.round("strict_cer_mean", 4), "normalised_wer_mean": F.round("normalised_wer_mean", 6)})


@query("""
WITH g AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS x FROM orders GROUP BY 1)
SELECT o_orderpriority, x[greatest(1, (1 * len(x) + 99) // 100)] AS o_totalprice_p1, x[greatest(1, (7 * len(x) + 99) // 100)] AS o_totalprice_p7,
  x[greatest(1, (50 * len(x) + 99) // 100)] AS o_totalprice_p50, x[greatest(1, (90 * len(x) + 99) // 100)] AS o_totalprice_p90, x[len(x)] AS o_totalprice_p100 FROM g
""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.nearest_ranks(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_totalprice"], (1, 7, 50, 90, 100))


#: The default policy for texts that no compatibility form changes and that hold no dashes or quotes beyond ASCII; so it is
#: for all documents of the tables. tests/test_text.py holds the query against Python on texts that need every step.
NORMAL = r"""trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace({0},
  '(?m)^[\s\x1c-\x1f]*\|?[\s\x1c-\x1f:\-|]+\|?[\s\x1c-\x1f]*$', ' ', 'g'), '(?m)^[\s\x1c-\x1f]{{0,3}}#{{1,6}}[\s\x1c-\x1f]+', '', 'g'), '\*{{1,3}}|_{{1,3}}|`+', '', 'g'), '|', ' '), '[\s\x0b\x1c-\x1f]+', ' ', 'g'))"""


@query(f"""SELECT doc_id, {NORMAL.format('text')} AS normalised FROM documents""")
def doc_normalise_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the default policy."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("normalised"))


@query(f"""SELECT doc_id, replace(lower({NORMAL.format('text')}), 'ß', 'ss') AS normalised FROM documents""")
def doc_normalise_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with case folded."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text"), text.NormalisationPolicy(fold_case=True)).alias("normalised"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's priority and status against the customer's next order, as short texts."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    said = F.concat_ws(" ", F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice").cast("long").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("reference"), F.lead(said).over(w).alias("prediction"))


_NEIGHBOURS = """n AS (SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus || ' ' || trunc(o_totalprice)::bigint AS reference,
  lead(o_orderpriority || ' ' || o_orderstatus || ' ' || trunc(o_totalprice)::bigint) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prediction FROM orders)"""


@query(f"""
WITH {_NEIGHBOURS}
SELECT o_orderkey, levenshtein(reference, prediction)::int AS strict_edit_distance,
  round(CASE WHEN prediction IS NULL THEN NULL WHEN length(reference) = 0 THEN (length(prediction) > 0)::int ELSE levenshtein(reference, prediction) / length(reference) END, 6) AS strict_cer,
  length(prediction) > 0 AND (length(reference) = 0 OR length(prediction) > 3.0 * length(reference)) AS degenerate FROM n
""")
def cer_neighbour_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, pred = F.col("reference"), F.col("prediction")
    rate = F.when(pred.isNotNull(), text.character_error_rate(ref, pred))
    return neighbours(spark, sf_dir).select("o_orderkey", text.edit_distance(ref, pred).alias("strict_edit_distance"), F.round(rate, 6).alias("strict_cer"), text.is_degenerate(ref, pred, 3.0).alias("degenerate"))


@query(f"""
WITH {_NEIGHBOURS},
w AS (SELECT *, string_split(reference, ' ') AS a, string_split(prediction, ' ') AS b FROM n),
c AS (SELECT *, list_distinct(list_concat(a, b)) AS k FROM w)
SELECT o_orderkey, round(CASE WHEN prediction IS NULL THEN NULL ELSE levenshtein(
  array_to_string(list_transform(a, lambda x: chr(64 + list_position(k, x)::int)), ''), array_to_string(list_transform(b, lambda x: chr(64 + list_position(k, x)::int)), '')) / len(a) END, 6) AS normalised_wer FROM c
""")
def wer_neighbour_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, pred = F.col("reference"), F.col("prediction")
    rate = F.when(pred.isNotNull(), text.word_error_rate(ref, pred))
    return neighbours(spark, sf_dir).select("o_orderkey", F.round(rate, 6).alias("normalised_wer"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[.!$%&*#]{2,}\s*$', ''), '\s+$', '') AS bare FROM documents""")
def strip_decoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_decoration(F.col("text"), ".!$%&*#", 2).alias("bare"))


@query("""
SELECT c_custkey, coalesce(max(o_orderpriority) FILTER (o_orderstatus = 'O'), 'NOT_FOUND') AS open_priority,
  coalesce(max(o_orderpriority) FILTER (o_orderstatus = 'F'), 'NOT_FOUND') AS filled_priority, count(o_orderkey) > 0 AS has_orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def flatten_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderpriority").alias("p"))
    fields = orders.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "p"))).alias("fields"))
    entries = table(spark, sf_dir, "customer").join(fields, F.col("c_custkey") == F.col("o_custkey"), "left")
    has = F.col("fields").isNotNull()
    flat = entries.withColumn("has_orders", has)
    return flat.select("c_custkey", lists.or_not_found(F.col("fields")["O"]).alias("open_priority"), lists.or_not_found(F.col("fields")["F"]).alias("filled_priority"), "has_orders")


def order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as parallel pipe lists."""
    by = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", F.col("l_returnflag").alias("flag"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(by.alias("x"))

    def joined(f):
        return F.array_join(F.transform("x", f), "|")

    return rows.select("l_orderkey", joined(lambda x: x["l_partkey"].cast("string")).alias("parts"), joined(lambda x: x["l_quantity"].cast("int").cast("string")).alias("quantities"), joined(lambda x: x["flag"]).alias("flags"))


@query("""
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1)::int AS line_no,
  l_partkey::varchar AS part, (l_quantity::int)::varchar AS quantity, l_returnflag AS flag FROM lineitem
""")
def line_item_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.explode_group(order_lists(spark, sf_dir), {"parts": "part", "quantities": "quantity", "flags": "flag"}, ["l_orderkey"])


@query("""SELECT l_orderkey, l_orderkey % 10 <> 3 AS agrees FROM lineitem GROUP BY l_orderkey""")
def parallel_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = order_lists(spark, sf_dir).withColumn("flags", F.when(F.col("l_orderkey") % 10 == 3, F.concat("flags", F.lit("|X"))).otherwise(F.col("flags")))
    return planted.select("l_orderkey", lists.counts_agree(*(lists.split_pipes(F.col(c)) for c in ("parts", "quantities", "flags"))).alias("agrees"))


@query(r"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d,
  CASE WHEN o_orderkey % 11 = 0 THEN '$' ELSE '' END || (o_totalprice::decimal(18,2))::varchar AS a FROM orders)
SELECT o_orderkey, regexp_full_match(d, '\d{2}/\d{2}/\d{4}') AS date_ok, regexp_full_match(a, '-?\d+\.\d{2}') AS amount_ok FROM o
""")
def format_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivana.operators.rules import FORMATS

    key = F.col("o_orderkey")
    d = F.when(key % 7 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    a = F.concat(F.when(key % 11 == 0, "$").otherwise(""), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.rlike(FORMATS["date"]).alias("date_ok"), a.rlike(FORMATS["amount"]).alias("amount_ok"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice::decimal(12,2) / 11::decimal(4,0), 2)::decimal(18,2) AS gst_in,
  round(l_extendedprice::decimal(12,2) * 0.10::decimal(3,2), 2)::decimal(18,2) AS gst_ex FROM lineitem
""")
def gst_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.gst_inclusive(price).alias("gst_in"), values.gst_exclusive(price).alias("gst_ex"))


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each customer: balances after each order, one in 50 of them off by one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    paid = F.col("o_totalprice").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "orders").withColumn("paid", paid).withColumn("balance", (F.lit(0) - F.sum("paid").over(w)).cast("decimal(28,2)"))
    return rows.withColumn("balance", F.when(F.col("o_orderkey") % 50 == 0, F.col("balance") + 1).otherwise(F.col("balance")).cast("decimal(28,2)")).withColumn("received", F.lit(None).cast("decimal(18,2)"))


_RUNNING = """p AS (SELECT *, o_totalprice::decimal(18,2) AS paid FROM orders),
b AS (SELECT *, (-sum(paid) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END)::decimal(28,2) AS balance FROM p)"""


@query(f"""
WITH {_RUNNING}
SELECT o_custkey, o_orderkey, coalesce(lag(balance) OVER w - paid = balance, true) AS holds FROM b WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def balance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.balance_breaks(running(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"], "paid", "received", "balance").select("o_custkey", "o_orderkey", "holds")


@query(f"""
WITH {_RUNNING}
SELECT o_custkey, (first(balance ORDER BY o_orderdate, o_orderkey) + first(paid ORDER BY o_orderdate, o_orderkey))::double AS opening,
  last(balance ORDER BY o_orderdate, o_orderkey)::double AS closing FROM b GROUP BY o_custkey
""")
def opening_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.opening_balance(running(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"], "paid", "received", "balance")
    return out.select("o_custkey", F.col("opening").cast("double").alias("opening"), F.col("closing").cast("double").alias("closing"))


@query("""
WITH f AS (SELECT event_id, user_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS s, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(s::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT event_id, user_id, event_type, CASE WHEN s THEN count(*) OVER (PARTITION BY user_id, run) ELSE 0 END::int AS rowspan FROM r
""")
def row_span_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.span_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type", "rowspan")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%a %d %b %Y') AS long_date, coalesce(strftime(o_orderdate, '%d/%m/%Y') <> lag(strftime(o_orderdate, '%d/%m/%Y')) OVER w, true) AS new_band
FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_orderkey)
""")
def date_band_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("date", F.date_format("o_orderdate", "dd/MM/yyyy"))
    banded = windows.date_bands(rows, ["o_orderstatus", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "date")
    return banded.select("o_orderkey", values.long_date(F.col("date")).alias("long_date"), "new_band")


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS first, CASE WHEN event_id % 5 = 1 THEN '' ELSE event_id::varchar END AS second, event_id % 97 = 0 AS header FROM events),
m AS (SELECT *, NOT header AND first = '' AS blank, NOT header AND first <> '' AND second = '' AS band, CASE WHEN NOT header AND first <> '' THEN first END AS k FROM e),
a AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, sum(band::int) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bands FROM m),
t AS (SELECT *, max((blank AND above IS NOT NULL)::int) OVER (PARTITION BY user_id, bands) AS taken FROM a)
SELECT user_id, event_id, CASE WHEN blank AND above IS NOT NULL THEN above ELSE first END AS first, second FROM t WHERE NOT (band AND taken = 1)
""")
def carry_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    cells = F.array(F.when(key % 3 == 0, "").otherwise(F.col("event_type")), F.when(key % 5 == 1, "").otherwise(key.cast("string")))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", cells.alias("cells"), (key % 97 == 0).alias("header"))
    out = windows.carry_group_key(rows, ["user_id"], "event_id")
    return out.select("user_id", "event_id", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"))


@query("""
WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o FROM conversations WHERE role <> 'system')
SELECT conv_id, turn, o::int AS "order" FROM n
""")
def dense_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("category", F.when(F.col("role") != "system", F.col("role")))
    return windows.reading_order(turns, ["conv_id"], "turn", "category").select("conv_id", "turn", "order")


@query("""
WITH t AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 0 WHEN conv_id % 5 = 0 THEN turn + 1 WHEN conv_id % 7 = 0 AND turn > 1 THEN turn + 1 ELSE turn END::int AS turn FROM conversations)
SELECT conv_id, count(*) AS n, max(turn)::int AS last FROM t GROUP BY conv_id HAVING count(*) <> count(DISTINCT turn) OR max(turn) <> count(*) - 1 OR min(turn) <> 0
""")
def dense_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns have a planted duplicate, a late start or a gap."""
    conv, turn = F.col("conv_id"), F.col("turn")
    planted = F.when((conv % 3 == 0) & (turn == 1), 0).when(conv % 5 == 0, turn + 1).when((conv % 7 == 0) & (turn > 1), turn + 1).otherwise(turn)
    turns = table(spark, sf_dir, "conversations").withColumn("order", planted.cast("int"))
    return windows.order_faults(turns, ["conv_id"]).select("conv_id", "n", "last")


@query("""
WITH x AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey FROM x WHERE r <= 2
""")
def take_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("""
WITH s AS (SELECT user_id % 20 AS run, user_id AS shard, count(*) AS images, max(value) AS seconds, bool_or(event_type = 'click') AS l FROM events GROUP BY user_id)
SELECT run, sum(images)::bigint AS images, round(max(seconds), 6) AS seconds, bool_or(l) AS is_floor, round(60 * sum(images) / max(seconds), 6) AS images_per_minute FROM s GROUP BY run
""")
def shard_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("run"), F.col("user_id").alias("shard")).agg(F.count(F.lit(1)).alias("images"), F.max("value").alias("seconds"), F.bool_or(F.col("event_type") == "click").alias("includes_load"))
    out = report.merge_shards(shards, ["run"])
    return out.select("run", "images", F.round("seconds", 6).alias("seconds"), "is_floor", F.round("images_per_minute", 6).alias("images_per_minute"))
