"""Queries on rules, derived values, events and layouts, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.functions import fit, image, lists, payments, providers, text, values
from scrivana.operators import corpus, events, index, layout, rules, tables
from scrivana.plans.common import Query, table
from scrivana.plans.corpora import POOLS, order_lines
from scrivana.staging import spread

QUERIES: dict[str, Query] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return keep


def string_map(**fields) -> F.Column:
    return F.create_map(*(x for name, value in fields.items() for x in (F.lit(name), value)))


# texts

@query("""
SELECT p_partkey, trim(regexp_replace(p_name || ' - ' || p_type || ' ''' || p_brand || ''' "x"', '\\s+', ' ', 'g')) AS normalised FROM part
""")
def fold_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashes, quotes, ligatures, wide letters and odd spaces planted into plain texts come out plain."""
    dash = F.element_at(F.array(*map(F.lit, text.DASHES)), (F.col("p_partkey") % len(text.DASHES)).cast("int") + 1)
    single = F.element_at(F.array(*map(F.lit, text.SINGLE_QUOTES)), (F.col("p_partkey") % 4).cast("int") + 1)
    double = F.element_at(F.array(*map(F.lit, text.DOUBLE_QUOTES)), (F.col("p_partkey") % 4).cast("int") + 1)
    name = F.translate(F.replace(F.col("p_name"), F.lit("fi"), F.lit("ﬁ")), "ae", "ａｅ")
    planted = F.concat(name, F.lit("  "), dash, F.lit(" "), F.col("p_type"), F.lit(" "), single, F.col("p_brand"), single, F.lit("\x85"), double, F.lit("x"), double)
    return table(spark, sf_dir, "part").select("p_partkey", text.normalise(planted).alias("normalised"))


@query("""SELECT c_custkey, lower(c_name) || ' strasse ' || lower(c_mktsegment) AS folded FROM customer""")
def folded_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, " STRAßE ").otherwise(" STRASSE "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalise(said, text.NormalisationPolicy(fold_case=True)).alias("folded"))


# rules: every entry carries one planted fault or none

def planted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an authored entry; the order's number says what is wrong with it."""
    key = F.col("o_orderkey")
    case = lambda n: key % 12 == n
    total = F.col("o_totalprice").cast("decimal(18,2)")
    gst = values.gst_inclusive(total)
    whole = string_map(
        TOTAL_AMOUNT=total.cast("string"), GST_AMOUNT=F.when(case(1), gst + 1).otherwise(gst).cast("string"), IS_GST_INCLUDED=F.lit(" True "),
        INVOICE_DATE=F.when(case(2), F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")),
        DATES=F.when(case(3), "01/02/2024|1/2/2024|NOT_FOUND").otherwise("01/02/2024|NOT_FOUND"),
        ITEMS=F.when(case(4), "a|b|c").otherwise("a|b"), PRICES=F.lit("1.00|2.00"),
        BUSINESS_ABN=F.when(case(5), "51 824 753 557").when(case(0), "NOT_FOUND").otherwise("51 824 753 556"),
        TRANSACTION_BALANCES=F.when(case(6), "100.00|80.00|95.00").otherwise("100.00|80.00|90.00"), TRANSACTION_AMOUNTS_PAID=F.lit("NOT_FOUND|20.00|NOT_FOUND"),
        TRANSACTION_AMOUNTS_RECEIVED=F.lit("100.00|NOT_FOUND|10.00"), ACCOUNT_BALANCE=F.when(case(6), "95.00").when(case(7), "91.00").otherwise("90.00"),
        OPENING=F.lit("1,000"), EARNED=F.lit("50"), BONUS=F.lit("0"), REDEEMED=F.lit("100"), CLOSING=F.when(case(8), "951").otherwise("950"),
    )
    fields = F.when(case(9), F.map_filter(whole, lambda k, _: k != "PRICES")).otherwise(whole)
    kind, chosen = F.when(case(10), "letter").otherwise("invoice"), F.when(case(11), "unknown").otherwise("plain")
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"))
    return orders.select(key.cast("string").alias("case_id"), kind.alias("doc_type"), chosen.alias("layout"), fields.alias("fields"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 12 AS n, o_orderkey::varchar AS case_id, o_orderdate, o_totalprice::decimal(18,2) AS t FROM orders),
g AS (SELECT *, round(t / 11::decimal(4,0), 2)::decimal(18,2) AS gst FROM o)
SELECT case_id, 'GST_AMOUNT' AS field, NULL::int AS position, 'gst' AS rule, 'expected ' || gst::varchar AS message FROM g WHERE n = 1
UNION ALL SELECT case_id, 'INVOICE_DATE', NULL, 'format_date', 'not a valid value: ' || strftime(o_orderdate, '%Y/%m/%d') FROM g WHERE n = 2
UNION ALL SELECT case_id, 'DATES', 1, 'format_date', 'not a valid value: 1/2/2024' FROM g WHERE n = 3
UNION ALL SELECT case_id, 'items', NULL, 'parallel', 'counts 3, 2' FROM g WHERE n = 4
UNION ALL SELECT case_id, 'BUSINESS_ABN', NULL, 'abn', 'checksum fails: 51 824 753 557' FROM g WHERE n = 5
UNION ALL SELECT case_id, 'TRANSACTION_BALANCES', 2, 'balance', 'expected 90.00' FROM g WHERE n = 6
UNION ALL SELECT case_id, 'ACCOUNT_BALANCE', NULL, 'closing', 'isn''t the last balance' FROM g WHERE n = 7
UNION ALL SELECT case_id, 'CLOSING', NULL, 'rewards', 'expected 950' FROM g WHERE n = 8
UNION ALL SELECT case_id, 'PRICES', NULL, 'required', 'missing' FROM g WHERE n = 9
UNION ALL SELECT case_id, NULL, NULL, 'doc_type', 'unknown type letter' FROM g WHERE n = 10
UNION ALL SELECT case_id, NULL, NULL, 'layout', 'no layout unknown' FROM g WHERE n = 11
""")
def planted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = planted_entries(spark, sf_dir)
    known = spark.createDataFrame([("plain",)], "layout string")
    return rules.check(
        rules.with_layouts(entries, known),
        rules.required_fields({"invoice": ["TOTAL_AMOUNT", "ITEMS", "PRICES"]}), rules.unknown_layouts(),
        rules.formats({"date": ["INVOICE_DATE"], "amount": ["TOTAL_AMOUNT", "GST_AMOUNT", "ACCOUNT_BALANCE"]}), rules.list_formats({"date": ["DATES"], "amount": ["PRICES"]}),
        rules.business_numbers(), rules.parallel_counts({"items": ["ITEMS", "PRICES"]}), rules.tax(), rules.balances(),
        rules.rewards("OPENING", "EARNED", "BONUS", "REDEEMED", "CLOSING"),
    )


@query("""
SELECT c_custkey::varchar AS case_id, 'NAME' AS field, NULL::int AS position, 'overflow' AS rule, 'does not fit 90 pixels by shrink' AS message
FROM customer WHERE 600 * length(c_name || ' ' || c_mktsegment) * 8 > 90000
""")
def overflow_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), string_map(NAME=F.concat_ws(" ", "c_name", "c_mktsegment")).alias("fields"))
    return rules.check(entries, rules.overflows({"NAME": fit.Budget(90, 12, 8)}, fit.Advances({})))


@query("""
WITH w AS (SELECT c_custkey, c_name || ' ' || c_mktsegment AS t, length(c_name) AS a, length(c_mktsegment) AS b FROM customer),
s AS (SELECT *, max(size) FILTER (600 * (a + b + 1) * size <= 150000) AS one, max(size) FILTER (600 * greatest(a, b) * size <= 150000) AS two FROM w, range(8, 13) r(size) GROUP BY ALL),
m AS (SELECT c_custkey, t, max(one) AS one, max(two) AS two FROM s GROUP BY ALL)
SELECT c_custkey, greatest(coalesce(one, 0), coalesce(two, 0))::int AS size, CASE WHEN coalesce(one, 0) >= two THEN t ELSE replace(t, ' ', '|') END AS lines FROM m
""")
def fitted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat_ws(" ", "c_name", "c_mktsegment")
    laid = table(spark, sf_dir, "customer").select("c_custkey", fit.fit_text(said, fit.Budget(150, 12, 8, 2, "shrink_then_wrap"), fit.Advances({})).alias("f"))
    return laid.select("c_custkey", F.col("f.size").alias("size"), F.array_join("f.lines", "|").alias("lines"))


@query("""
WITH p AS (SELECT p_partkey, 1 + p_size % 7 AS n, 200 + p_size * 3 AS w FROM part),
u AS (SELECT *, w - 5 * (n - 1) AS usable FROM p)
SELECT p_partkey, i::int AS i, (10 + i * (5 + usable // n) + least(i, usable % n))::int AS x, (usable // n + (i < usable % n)::int)::int AS width FROM u, range(0, 7) r(i) WHERE i < n
""")
def region_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, width = 1 + F.col("p_size") % 7, 200 + F.col("p_size") * 3
    columns = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(fit.divide(F.lit(10), width, n, F.lit(5))).alias("i", "c"))
    return columns.select("p_partkey", "i", "c.x", "c.width")


@query("""
SELECT p_partkey, p.i::int AS i, (CASE p.i WHEN 0 THEN 0 WHEN 1 THEN p_size + 4 ELSE 2 * p_size + 8 END)::int AS x, (CASE WHEN p.i < 2 THEN p_size ELSE 30 END)::int AS width,
  CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE 'default' END AS colour FROM part, range(0, 3) p(i)
""")
def stated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    block = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("role"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    colour = fit.parameter(block, F.create_map(F.lit("banner_role"), F.lit("default")), "banner_role", "role")
    columns = fit.divide_widths(F.lit(0), F.lit(500), F.array(size, size, F.lit(30)), F.lit(4))
    return table(spark, sf_dir, "part").select("p_partkey", colour.alias("colour"), F.posexplode(columns).alias("i", "c")).select("p_partkey", "i", "c.x", "c.width", "colour")


# derived values

@query("""
SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS shown, format('{:,.2f}', o_totalprice) || ' Cr' AS plain,
  '$' || format('{:,.2f}', o_totalprice) || CASE WHEN o_orderkey % 2 = 0 THEN ' CR' ELSE ' DR' END AS signed, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS parsed FROM orders
""")
def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    money, key = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey")
    signed = F.when(key % 2 == 0, money).otherwise(-money)
    said = F.when(key % 10 == 0, "NOT_FOUND").when(key % 5 == 0, "").otherwise(money.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.format_amount(money).alias("shown"), values.currency(money, "plain", "Cr").alias("plain"), values.signed_balance(signed).alias("signed"), values.amount(said).cast("double").alias("parsed"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') || ' at 0' || (1 + o_orderkey % 9) || ':05 PM' AS stamp, CASE WHEN o_orderkey % 4 = 0 THEN 'someday' ELSE strftime(o_orderdate, '%a %d %b %Y') END AS long_date FROM orders
""")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, date = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    time = F.format_string("%02d:05", 13 + key % 9)
    return table(spark, sf_dir, "orders").select("o_orderkey", values.long_timestamp(date, time).alias("stamp"), values.long_date(F.when(key % 4 == 0, "someday").otherwise(date)).alias("long_date"))


@query("""
WITH b AS (SELECT c_custkey, lpad((c_custkey * 7654321987 % 1000000000)::varchar, 9, '0') AS body FROM customer),
s AS (SELECT *, (89 - list_sum(list_transform(range(1, 10), lambda i: substr(body, i, 1)::int * [3, 5, 7, 9, 11, 13, 15, 17, 19][i])) % 89) % 89 AS lead FROM b),
d AS (SELECT c_custkey, ((lead // 10) + 1)::bigint::varchar || (lead % 10)::bigint::varchar || body AS n FROM s)
SELECT c_custkey, substr(n, 1, 2) || ' ' || substr(n, 3, 3) || ' ' || substr(n, 6, 3) || ' ' || substr(n, 9, 3) AS abn, true AS valid FROM d
""")
def made_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.struct(values.make_abn(F.col("c_custkey") * 7654321987).alias("abn")).alias("m"))
    return made.select("c_custkey", "m.abn", values.abn_is_valid(F.col("m.abn")).alias("valid"))


def cycle_sql(position: str, n: str, seed: int) -> str:
    """DuckDB's form of ``values.cycle_place``."""
    head = f"'{seed}|' || ({position} // {n}) || '|' || r"
    other = f"((({_drawn_sql(head)} % {n}) - x) % {n} + {n}) % {n}"
    return f"list_reduce(range(0, {values.SWAPS}), lambda x, r: CASE WHEN {_drawn_sql(f"{head} || '|' || greatest(x, {other})")} % 2 = 1 THEN {other} ELSE x END, {position} % {n})"


def _drawn_sql(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 12))::bigint"


@query(f"""
SELECT c_custkey, ['Net 7', 'Net 14', 'Net 30'][{cycle_sql("c_custkey", "3", 5)} + 1] AS cycled, ['Net 7', 'Net 14', 'Net 30'][(('0x' || substr(sha256(c_custkey::varchar), 1, 12))::bigint % 3 + 1)::int] AS chosen FROM customer
""")
def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, key = ["Net 7", "Net 14", "Net 30"], F.col("c_custkey")
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", values.cycled_choice(pool, key, 5).alias("cycled"), values.seeded_choice(F.array(*map(F.lit, pool)), key).alias("chosen"))


@query(f"""
WITH p AS (SELECT p_name AS member, row_number() OVER (ORDER BY p_partkey) - 1 AS place, count(*) OVER () AS n FROM part),
c AS (SELECT c_custkey, (SELECT max(n) FROM p) AS n FROM customer)
SELECT c_custkey, member FROM (SELECT c_custkey, {cycle_sql("c_custkey", "n", 9)} AS place FROM c) JOIN p USING (place)
""")
def cycled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's part, none again before all parts have been taken."""
    pool = index.numbered(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("member")), "p_partkey", "place")
    return values.cycled_from(table(spark, sf_dir, "customer").select("c_custkey"), pool, "c_custkey", "place", 9)


@query("""
WITH h AS (SELECT c_custkey, sha256('person|' || c_custkey) AS p, sha256('address|' || c_custkey) AS a FROM customer)
SELECT c_custkey, ['Ana', 'Ben', 'Cleo'][(('0x' || substr(p, 1, 12))::bigint % 3 + 1)::int] || ' ' || ['Ng', 'Roy'][(('0x' || substr(p, 13, 12))::bigint % 2 + 1)::int] AS full_name,
  (('0x' || substr(a, 1, 8))::bigint % 200 + 1) || ' ' || ['High St', 'Mill Rd', 'Elm Ave'][(('0x' || substr(a, 9, 12))::bigint % 3 + 1)::int] || ', ' || ['Perth WA 6000', 'Hobart TAS 7000'][(('0x' || substr(a, 21, 12))::bigint % 2 + 1)::int] AS address FROM h
""")
def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    who = values.person(["Ana", "Ben", "Cleo"], ["Ng", "Roy"], key)["full_name"]
    return table(spark, sf_dir, "customer").select("c_custkey", who.alias("full_name"), values.address(["High St", "Mill Rd", "Elm Ave"], ["Perth WA 6000", "Hobart TAS 7000"], key).alias("address"))


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'VISA DEBIT PURCHASE' WHEN o_orderkey % 4 = 2 THEN 'VISA PURCHASE' ELSE 'EFTPOS SHOP' END AS row_,
  strftime(o_orderdate, '%d/%m/%Y') AS d, o_orderdate, o_totalprice::decimal(18,2) AS t FROM orders),
h AS (SELECT *, sha256(o_orderkey || ':pos:' || d) AS x FROM o),
f AS (SELECT *, CASE WHEN row_ LIKE 'VISA DEBIT%' OR row_ LIKE 'EFTPOS%' THEN 'Debit' WHEN row_ LIKE 'VISA%' THEN 'Visa' END AS forced,
  ['Amex', 'Cash', 'Cash', 'Visa', 'Visa', 'Visa'][(('0x' || substr(x, 11, 4))::bigint % 6 + 1)::int] AS drawn, ['Phone Pay', 'none', 'none'][(('0x' || substr(x, 11, 4))::bigint % 3 + 1)::int] AS shown FROM h),
m AS (SELECT *, CASE WHEN forced IS NULL THEN drawn WHEN shown = 'none' THEN forced ELSE shown END AS method, coalesce(forced, drawn) AS scheme FROM f),
c AS (SELECT *, method = 'Cash' AS cash, method = 'Phone Pay' AS wallet, ('0x' || substr(x, 17, 2))::bigint AS s FROM m)
SELECT o_orderkey, method, CASE WHEN cash THEN 'cash' WHEN wallet THEN 'wallet' ELSE 'card' END AS kind, CASE WHEN cash THEN '' WHEN scheme = 'Debit' THEN 'eftpos' WHEN scheme = 'Visa' THEN 'VISA CREDIT' ELSE 'AMERICAN EXPRESS' END AS scheme_display,
  CASE WHEN cash THEN '' WHEN scheme = 'Debit' THEN ['SAV', 'CHQ'][(s % 2 + 1)::int] ELSE 'CR' END AS account_type,
  CASE WHEN cash THEN '' ELSE repeat('x', CASE WHEN scheme = 'Amex' THEN 11 ELSE 12 END) || printf('%04d', ('0x' || substr(x, 19, 4))::bigint % 10000) END AS masked_pan,
  CASE WHEN cash THEN '' WHEN wallet THEN '(t)' ELSE '(c)' END AS entry_mode, CASE WHEN wallet THEN 'PhonePay' ELSE '' END AS wallet_label,
  strftime(o_orderdate, '%d %b %Y') || ' at 02:05 PM' AS stamp, CASE WHEN cash THEN ((floor(t / 5) + 1 + ('0x' || substr(x, 39, 2))::bigint % 3) * 5)::double END AS tendered FROM c
""")
def payment_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, date = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    bank = F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, "VISA DEBIT PURCHASE").when(key % 4 == 2, "VISA PURCHASE").otherwise("EFTPOS SHOP")
    slip = payments.slip(key.cast("string"), date, F.col("o_totalprice").cast("decimal(18,2)"), F.lit("14:05"), POOLS, bank)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", slip.alias("s"))
    names = ("method", "kind", "scheme_display", "account_type", "masked_pan", "entry_mode", "wallet_label")
    return rows.select("o_orderkey", *(F.col(f"s.{n}") for n in names), F.col("s.timestamp").alias("stamp"), F.col("s.tendered").cast("double").alias("tendered"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity::int = 1 OR l_linenumber = 3 THEN '' ELSE l_quantity::int || 'x ' END || 'part ' || l_partkey AS line FROM lineitem""")
def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.when(F.col("l_linenumber") == 3, "NOT_FOUND").otherwise(F.col("l_quantity").cast("int").cast("string"))
    line = values.counted_description(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), quantity)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", line.alias("line"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'NAME|SIZE' WHEN 1 THEN 'BRAND' ELSE '' END AS names, p_partkey % 3 <> 2 AS balanced, p_partkey % 4 NOT IN (0, 1) AS there FROM part
""")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    said = F.when(key % 3 == 0, "{NAME} of {SIZE}").when(key % 3 == 1, "{BRAND}.").otherwise("{NAME")
    value = F.when(key % 4 == 0, "").when(key % 4 == 1, "NOT_FOUND").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(lists.placeholders(said), "|").alias("names"), lists.braces_balanced(said).alias("balanced"), lists.is_present(value).alias("there"))


@query("""SELECT doc_id, sha256('RGB' || coalesce(length(text), 0) || 'x1' || coalesce(text, '')) AS pixels FROM documents""")
def pixel_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stand in for pixels: what is hashed is mode, size and bytes."""
    said = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", image.pixel_sha256(said.cast("binary"), F.lit(1), F.length(said)).alias("pixels"))


@query("""
SELECT o_custkey, coalesce(sum(o_totalprice::decimal(18,2)) FILTER (o_orderstatus <> 'P'), 0)::double AS debits, coalesce(sum(o_totalprice::decimal(18,2)) FILTER (o_orderstatus = 'P'), 0)::double AS credits FROM orders GROUP BY 1
""")
def side_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debits and credits of each account; the side that a row isn't on says NOT_FOUND."""
    money = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    credit = F.col("o_orderstatus") == "P"
    rows = table(spark, sf_dir, "orders").select("o_custkey", credit.alias("credit"), F.when(credit, "NOT_FOUND").otherwise(money).alias("d"), F.when(credit, money).otherwise("NOT_FOUND").alias("c"))
    return rows.groupBy("o_custkey").agg(F.sum(values.amount(F.col("d"))).cast("double").alias("debits"), F.sum(values.amount(F.col("c"))).cast("double").alias("credits"))


# events and tables

def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as the events of one table: a header row, then a row a line, whose item has a sub-line."""
    by = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")))
    lines = order_lines(spark, sf_dir).groupBy("l_orderkey").agg(by.alias("x"))

    def one(kind: str, said=None, key: str | None = None, header: bool | None = None, colspan: int | None = None):
        said = F.lit(None).cast("string") if said is None else said
        return F.struct(F.lit(kind).alias("kind"), said.alias("text"), F.lit(key).cast("string").alias("column_key"), F.lit(header).cast("boolean").alias("header"), F.lit(colspan).cast("int").alias("colspan"), F.lit(1 if colspan else None).cast("int").alias("rowspan"))

    head = F.array(one("table_open"), one("row_open"), one("cell", F.lit("Item"), "item", True, 1), one("cell", F.lit("Qty"), "qty", True, 1), one("row_close"))
    row = lambda x: F.array(one("row_open"), one("cell", F.concat(F.lit("<"), x["l_partkey"].cast("string"), F.lit(">")), "item", False, 1), one("cell", x["q"].cast("string"), "qty", False, 1), one("row_close"), one("cell_sub_line", F.concat(F.lit("flag "), x["l_returnflag"]), "item"))
    whole = F.concat(head, F.flatten(F.transform("x", row)), F.array(one("table_close")))
    return lines.select("l_orderkey", F.posexplode(whole).alias("seq", "e")).select("l_orderkey", "seq", "e.*")


@query("""
SELECT l_orderkey, '<table><thead><tr><th>Item</th><th>Qty</th></tr></thead><tbody>' || string_agg('<tr><td>&lt;' || l_partkey || '&gt;' || chr(10) || 'flag ' || l_returnflag || '</td><td>' || l_quantity::int || '</td></tr>', '' ORDER BY l_linenumber, l_partkey, l_quantity::int, l_returnflag) || '</tbody></table>' AS html
FROM lineitem GROUP BY 1
""")
def table_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.table_rows(line_events(spark, sf_dir), ["l_orderkey"])
    return tables.render_tables(rows, ["l_orderkey", "table_no"], "row_no").select("l_orderkey", "html")


@query("""
WITH p AS (SELECT o_orderkey, o_orderkey % 5 AS n FROM orders) SELECT o_orderkey, (CASE n WHEN 1 THEN 1 ELSE 0 END)::int AS late_header, (n = 2)::int AS other_width FROM p WHERE n IN (1, 2)
""")
def header_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of four rows: some with a header row after the body began, some with header rows of two widths."""
    n = F.col("o_orderkey") % 5
    cell = lambda span: F.struct(F.lit("x").alias("text"), span.cast("int").alias("colspan"), F.lit(1).alias("rowspan"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row_no"))
    header = (F.col("row_no") < 2) | ((F.col("n") == 1) & (F.col("row_no") == 3))
    cells = F.array(cell(F.lit(1)), cell(F.when((F.col("n") == 2) & (F.col("row_no") == 1), 2).otherwise(1)))
    found = tables.header_faults(rows.select("o_orderkey", "row_no", header.alias("header"), cells.alias("cells")), ["o_orderkey"], "row_no")
    return found.select("o_orderkey", F.coalesce((F.col("last_header") > F.col("first_body")).cast("int"), F.lit(0)).alias("late_header"), (F.col("widths") > 1).cast("int").alias("other_width"))


@query("""
WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity::int, l_returnflag) AS i, l_partkey, l_quantity::int AS q, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, 0 AS row_no, 'Order|Part|Part|Qty' AS cells FROM lineitem GROUP BY 1
UNION ALL SELECT l_orderkey, 1, 'all lines' FROM lineitem GROUP BY 1
UNION ALL SELECT l_orderkey, (i + 1)::int, CASE WHEN i <= 64 THEN 'no ' || l_orderkey || '|' ELSE '' END || l_partkey || '|' || l_partkey || '|' || q FROM r
""")
def spanning_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell that owns the first column of all rows, cells of two columns, and a band over the whole width."""
    lines = order_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag"))).alias("x"))
    first = F.concat(F.lit("<td rowspan='"), F.size("x").cast("string"), F.lit("'>no "), F.col("l_orderkey").cast("string"), F.lit("</td>"))
    row = lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), F.lit('<td colspan="2">'), x["l_partkey"].cast("string"), F.lit("</td><td rowspan=0>"), x["q"].cast("string"), F.lit("</td></tr>"))
    html = F.concat(F.lit("<table><tr><th>Order<th colspan=2>Part<th colspan=x>Qty</tr><tr><td colspan=4>all lines</td></tr>"), F.array_join(F.transform("x", row), ""), F.lit("</table>"))
    grids = lines.select("l_orderkey", tables.parse_tables(html)[0].alias("grid"))
    return grids.select("l_orderkey", F.posexplode("grid").alias("row_no", "row")).select("l_orderkey", "row_no", F.array_join("row", "|").alias("cells"))


@query("""
WITH e AS (SELECT conv_id, turn, role, text, (turn * 10)::int AS y, length(text)::int AS w FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS anno_id, CASE role WHEN 'user' THEN 'text_block' ELSE 'title' END AS category_type, turn::int AS "order",
  0::int AS x0, y AS y0, (w + 1)::int AS x1, (y + 8)::int AS y1, 2 AS spans FROM e WHERE role <> 'system' AND w > 0
""")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as drawn blocks of two spans; system turns have no category, empty ones no spans."""
    y, width = (F.col("turn") * 10).cast("int"), F.length("text").cast("int")
    corner = lambda x0, y0, x1, y1: F.array(x0, y0, x1, y0, x1, y1, x0, y1)
    span = lambda *box: F.struct(F.col("text"), corner(*box).alias("poly"))
    spans = F.when(width > 0, F.array(span(F.lit(0), y, width, y + 4), span(F.lit(1), y + 3, width + 1, y + 8))).otherwise(F.array().cast("array<struct<text:string,poly:array<int>>>"))
    kind = F.when(F.col("role") == "user", "text_block").when(F.col("role") != "system", "title")
    drawn = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("seq"), kind.alias("category_type"), F.col("turn").cast("int").alias("order"), "text", spans.alias("spans"))
    dets = events.layout_annotations(drawn, ["conv_id"]).select("conv_id", F.explode("layout_dets").alias("j"))
    one = dets.select("conv_id", F.from_json("j", "category_type string, poly array<int>, anno_id int, `order` int, line_with_spans array<struct<text:string>>").alias("d"))
    at = lambda i: F.element_at("d.poly", i)
    return one.select("conv_id", "d.anno_id", "d.category_type", "d.order", at(1).alias("x0"), at(2).alias("y0"), at(5).alias("x1"), at(6).alias("y1"), F.size("d.line_with_spans").alias("spans"))


@query("""
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS seq, text, CASE WHEN role = 'system' THEN 0 ELSE 2 END AS spans, CASE WHEN role = 'system' THEN NULL ELSE 10 * turn + 12 END::int AS bottom FROM conversations
""")
def captured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a block that emits an event and draws two lines, with a decoration and an empty block between them;
    system turns draw decoration only."""
    def op(at: int, name: str, low: int = 0):
        y = (F.col("turn") * 10 + low).cast("int")
        return F.struct((F.col("turn") * 100 + at).alias("at"), F.lit(name).alias("op"), F.array(F.lit(0), y, F.lit(5), y, F.lit(5), y + 6, F.lit(0), y + 6).alias("poly"))

    drawn = F.array(op(0, "block_open"), op(1, "emit"), op(2, "draw"), op(3, "decoration_open"), op(4, "draw", 90), op(5, "decoration_close"), op(6, "block_open"), op(7, "block_close"), op(8, "draw", 6), op(9, "block_close"))
    plain = F.array(op(0, "emit"), op(1, "decoration_open"), op(2, "draw"), op(3, "decoration_close"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "text", F.explode(F.when(F.col("role") == "system", plain).otherwise(drawn)).alias("o"))
    log = turns.select("conv_id", "text", "o.*", F.lit("line").alias("kind"), F.lit("text_block").alias("category_type"))
    found = events.captured(log, ["conv_id"])
    return found.select("conv_id", "seq", "text", F.size("spans").alias("spans"), F.element_at("poly", 6).alias("bottom"))


LAYOUT = {
    "title": "Statement", "top": 50, "left": 10, "content_width": 400,
    "defaults": {"line_advance": {"body": 22, "header": 30}, "banner_role": "header", "rule_height": 5, "row_height": 16},
    "body": [
        {"type": "banner", "content": "{NAME}"},
        {"type": "text", "from_layout": "title", "title": True},
        {"type": "pair", "label": "Segment", "field": "SEGMENT"},
        {"type": "pair", "label": "Balance", "field": "BALANCE", "currency": True, "when": "BALANCE"},
        {"type": "rule"},
        {"type": "table", "columns": [{"key": "k", "label": "Order"}, {"key": "p", "label": "Price"}], "rows": {"k": "KEYS", "p": "PRICES"}},
    ],
}


@query("""
WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks, list(o_totalprice::decimal(18,2) ORDER BY o_orderkey) AS ps FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal::decimal(18,2) AS b, c_custkey % 3 <> 0 AS shown, ks, ps FROM customer JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, '# ' || c_name || chr(10) || '# Statement' || chr(10) || 'Segment: ' || c_mktsegment || CASE WHEN shown THEN chr(10) || 'Balance: $' || format('{:,.2f}', b::double) ELSE '' END AS said,
  10 AS x, 400 AS width, 50 + 30 + 22 + 22 + 5 + CASE WHEN shown THEN 22 ELSE 0 END AS table_top, 50 + 30 + 22 + 22 + 5 + CASE WHEN shown THEN 22 ELSE 0 END + 16 * (len(ks) + 1) AS table_end,
  2 + 2 * len(ks) AS cells, len(ks) + 1 AS drawn_rows, 'Order,Price,' || array_to_string(flatten(list_transform(range(1, len(ks) + 1), lambda i: [ks[i]::varchar, ps[i]::varchar])), ',') AS row_text FROM c
""")
def compiled_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout compiled to events for every customer with orders: titles, pairs (one of them only where stated), a table, and
    where they stand."""
    by = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(by.alias("x"))
    joined = lambda f: F.array_join(F.transform("x", f), "|")
    balance = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).otherwise("NOT_FOUND")
    fields = string_map(NAME=F.col("c_name"), SEGMENT=F.col("c_mktsegment"), BALANCE=balance, KEYS=joined(lambda x: x["o_orderkey"].cast("string")), PRICES=joined(lambda x: x["p"].cast("string")))
    entries = table(spark, sf_dir, "customer").join(orders, "c_custkey").select("c_custkey", F.lit("plain").alias("layout"), fields.alias("fields"))
    out = layout.expand(entries, {"plain": LAYOUT}, ["c_custkey"])
    block = events.block_text(F.col("kind"), F.col("text"), F.col("label"), F.col("value"))
    ordered = lambda value, where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct(F.col("seq"), value.alias("v"))))), lambda x: x["v"])
    return out.groupBy("c_custkey").agg(
        F.array_join(ordered(block, block.isNotNull()), "\n").alias("said"), F.count_if(F.col("kind") == "cell").alias("cells"), F.count_if(F.col("kind") == "row_open").alias("drawn_rows"),
        F.array_join(ordered(F.col("text"), F.col("kind") == "cell"), ",").alias("row_text"),
        F.min("x").alias("x"), F.min("width").alias("width"), *(F.max(F.when(F.col("kind") == k, F.col("y"))).alias(to) for k, to in (("table_open", "table_top"), ("table_close", "table_end"))),
    )


MEASURED = {
    "top": 40, "left": 10, "content_width": 300,
    "field_budgets": {"orders": {"width": 300, "size": 10, "lines": 100000, "fit": "wrap"}},
    "defaults": {"row_height": 20, "header_group_height": 25, "split_gap": 20},
    "body": [
        {"type": "text", "content": "{KEYS}", "budget": "orders"},
        {"type": "split", "columns": [{"children": [{"type": "text", "content": "{KEYS}", "when": "EVEN"}]}, {"children": [{"type": "spacer", "height": 7}]}]},
        {"type": "table", "rows": {"k": "LIST", "s": "STATUSES", "n": "NOTES"}, "span_key": "s", "header_groups": [{"label": "all", "span": ["k", "s"]}],
         "columns": [{"key": "k", "label": "Order", "sub_line": {"key": "n", "offset_y": 12, "height": 15}}, {"key": "s", "label": "Status"}]},
        {"type": "text", "content": "end"},
    ],
}


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER w - 1 AS i, o_orderkey % 2 = 0 AS noted, o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w AS starts FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
g AS (SELECT *, sum(starts::int) OVER w AS run, sum(noted::int) OVER w - noted::int AS noted_before FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY i ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, run) AS length FROM g),
c AS (SELECT o_custkey, count(*) AS n, sum(noted::int) AS noted, string_agg(length::varchar, ',' ORDER BY i) FILTER (starts) AS spans, coalesce(sum(20 * i + 15 * noted_before + 12) FILTER (noted), 0) AS below,
  40 + 20 * ceil(count(*) / 5)::int + CASE WHEN o_custkey % 2 = 0 THEN 20 ELSE 7 END AS t FROM r GROUP BY o_custkey)
SELECT o_custkey AS c_custkey, ceil(n / 5)::int AS lines, t::int AS table_top, spans, noted AS sub_lines, (below + noted * (t + 45))::bigint AS sub_line_places, (t + 45 + 20 * n + 15 * noted)::int AS table_end, (t + 45 + 20 * n + 15 * noted)::int AS end_place FROM c
""")
def measured_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as a page whose text is wrapped (five keys of eight digits a line), beside it a split, below it
    a table with a header group, sub-lines on every second order or so, and statuses merged over runs."""
    by = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(by.alias("o"))
    joined = lambda f, sep: F.array_join(F.transform("o", f), sep)
    key = lambda x: F.lpad(x["o_orderkey"].cast("string"), 8, "0")
    note = lambda x: F.when(x["o_orderkey"] % 2 == 0, "even").otherwise("NOT_FOUND")
    fields = string_map(KEYS=joined(key, " "), LIST=joined(key, "|"), STATUSES=joined(lambda x: x["o_orderstatus"], "|"), NOTES=joined(note, "|"), EVEN=F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("NOT_FOUND"))
    out = layout.expand(orders.select("c_custkey", F.lit("plain").alias("layout"), fields.alias("fields")), {"plain": MEASURED}, ["c_custkey"])
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("y")))
    sub, merged = F.col("kind") == "cell_sub_line", (F.col("kind") == "cell") & (F.col("column_key") == "s") & ~F.col("header")
    return out.groupBy("c_custkey").agg(
        F.max("lines").alias("lines"), at("table_open").alias("table_top"), at("table_close").alias("table_end"), F.max(F.when(F.col("text") == "end", F.col("y"))).alias("end_place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(merged, F.struct("seq", "rowspan")))), lambda x: x["rowspan"].cast("string")), ",").alias("spans"),
        F.count_if(sub).alias("sub_lines"), F.coalesce(F.sum(F.when(sub, F.col("y"))), F.lit(0)).alias("sub_line_places"),
    )


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, (o_totalprice::decimal(18,2)) AS p, o_orderkey % 3 = 0 AS comes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
b AS (SELECT *, (sum(CASE WHEN comes THEN p ELSE -p END) OVER (PARTITION BY o_custkey ORDER BY i ROWS UNBOUNDED PRECEDING) + 5000)::decimal(18,2) AS balance FROM o),
r AS (SELECT o_custkey, i, 'order ' || o_orderkey AS description, CASE WHEN NOT comes THEN p END AS debit, CASE WHEN comes THEN p END AS credit, balance, false AS synthetic FROM b
UNION ALL SELECT o_custkey, 0, 'Brought forward', NULL, NULL, 5000::decimal(18,2), true FROM b WHERE i = 1
UNION ALL SELECT o_custkey, count(*) + 1, 'Carried forward', NULL, NULL, last(balance ORDER BY i), true FROM b GROUP BY 1
UNION ALL SELECT o_custkey, -1, 'Totals', coalesce(sum(p) FILTER (NOT comes), 0)::decimal(18,2), coalesce(sum(p) FILTER (comes), 0)::decimal(18,2), NULL, true FROM b GROUP BY 1)
SELECT o_custkey AS c_custkey, i::int AS i, description, debit, credit, CASE WHEN balance IS NOT NULL THEN '$' || format('{:,.2f}', abs(balance)::double) || CASE WHEN balance < 0 THEN ' DR' ELSE ' CR' END END AS balance, synthetic FROM r
""")
def bank_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every customer's statement with what is brought and carried forward, and its totals (as row -1)."""
    p, comes = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey") % 3 == 0
    by = F.array_sort(F.collect_list(F.struct("o_orderkey", F.when(~comes, p).alias("d"), F.when(comes, p).alias("c"))))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(by.alias("o"))
    joined = lambda f: F.array_join(F.transform("o", f), "|")
    zero = F.lit(0).cast("decimal(18,2)")
    moved = F.transform("o", lambda x: (F.coalesce(x["c"], zero) - F.coalesce(x["d"], zero)).cast("decimal(18,2)"))
    chain = F.aggregate(moved, F.array(F.lit(5000).cast("decimal(18,2)")), lambda a, m: F.concat(a, F.array((F.element_at(a, -1) + m).cast("decimal(18,2)"))))
    balances = F.array_join(F.transform(F.slice(chain, F.lit(2), F.size("o")), lambda x: x.cast("string")), "|")
    fields = string_map(
        TRANSACTION_DATES=joined(lambda x: F.lit("01/02/2024")), TRANSACTION_DESCRIPTIONS=joined(lambda x: F.concat(F.lit("order "), x["o_orderkey"].cast("string"))), TRANSACTION_BALANCES=balances,
        TRANSACTION_AMOUNTS_PAID=joined(lambda x: lists.or_not_found(x["d"].cast("string"))), TRANSACTION_AMOUNTS_RECEIVED=joined(lambda x: lists.or_not_found(x["c"].cast("string"))),
    )
    pages = orders.select("c_custkey", fields.alias("f"))
    rows = pages.select("c_custkey", F.posexplode(providers.bank_transactions(F.col("f"), brought_forward="Brought forward", carried_forward="Carried forward", balance_suffix=("DR", "CR"))).alias("i", "r"))
    totals = pages.select("c_custkey", F.lit(-1).alias("i"), F.explode(providers.bank_transaction_totals(F.col("f"), "Totals")).alias("r"))
    shown = [F.col(f"r.{k}").alias(k) for k in ("description", "debit", "credit")]
    return rows.select("c_custkey", "i", *shown, "r.balance", "r.synthetic").union(totals.select("c_custkey", "i", *shown, F.col("r.balance").cast("string").alias("balance"), "r.synthetic"))


# corpora

@query("""
SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'photo' END, CASE WHEN doc_id % 2 = 0 THEN 'scan' ELSE 'fax' END) AS family, CASE WHEN doc_id % 2 = 0 THEN 'light' ELSE 'heavy' END AS severity FROM documents
""")
def named_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    stated = table(spark, sf_dir, "documents").select("doc_id", F.when(key % 3 == 0, "photo").alias("family"), F.lit("").alias("severity"))
    return corpus.family_and_severity(stated, F.when(key % 2 == 0, "scan_light").otherwise("fax_heavy")).select("doc_id", "family", "severity")


@query("""
SELECT doc_id::varchar AS stem, CASE doc_id % 4 WHEN 0 THEN 'missing' ELSE 'hash' END AS fault, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'root/' || lang || '/' || doc_id || '.png' ELSE 'root/' || doc_id || '.png' END AS path
FROM documents WHERE doc_id % 4 IN (0, 1)
""")
def checked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, some of them in a folder of their type, against a manifest: every fourth is missing, every fourth changed."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    stem = key.cast("string")
    manifest = docs.select(stem.alias("stem"), F.col("lang").alias("doc_type"), F.sha2("text", 256).alias("sha256"))
    place = F.concat(F.lit("root/"), F.when(key % 3 == 0, F.concat("lang", F.lit("/"))).otherwise(""), stem, F.lit(".png"))
    files = docs.select(F.when(key % 4 == 0, "root/stray.png").otherwise(place).alias("path"), F.when(key % 4 == 0, "stray").otherwise(stem).alias("stem"), F.when(key % 4 == 1, "x").otherwise(F.sha2("text", 256)).alias("sha256"))
    return corpus.file_faults(manifest, files).join(corpus.nested_or_flat(manifest.select("stem", "doc_type"), files), "stem").select("stem", "fault", "path")


@query("""
SELECT 'doc_type' AS what, lang AS name, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'family', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'tables', 'pages with tables', count(*) FILTER (n_chars > 2000) FROM documents
UNION ALL SELECT 'blocks', CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'title' END, count(*) FROM documents WHERE n_chars > 2000 GROUP BY 2
UNION ALL SELECT 'spans', CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'title' END, 1 * count(*) FROM documents WHERE n_chars > 2000 GROUP BY 2
UNION ALL SELECT 'tables', 'pages with several', 0
""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    manifest = docs.select(F.col("lang").alias("doc_type"), F.col("source").alias("family"), F.when(F.col("n_chars") > 2000, "t").alias("tables"))
    span = F.array(F.struct(F.lit("x").alias("text"), F.array(*map(F.lit, (0, 0, 1, 0, 1, 1, 0, 1))).alias("poly")))
    drawn = docs.where("n_chars > 2000").select(key.alias("stem"), F.when(key % 2 == 0, "table").otherwise("title").alias("category_type"), span.alias("spans"))
    return corpus.summary(manifest, drawn)


@query("""SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE lang IN ('de', 'fr')) WHERE r <= 5""")
def chosen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages of each of two types: the limit is what the query shows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_type"))
    chosen = corpus.limited(corpus.of_types(docs, ["de", "fr"], ["de", "en", "es", "fr"]), 5, "doc_type", "doc_id")
    return chosen.select("doc_id", F.col("doc_type").alias("lang"))


@query("""SELECT source AS corpus, CASE WHEN source LIKE '%3' THEN 'x' ELSE sha256(source) END AS manifest_sha256, CASE WHEN source LIKE '%4' THEN NULL ELSE sha256(source) END AS found FROM documents WHERE source LIKE '%3' OR source LIKE '%4' GROUP BY source""")
def stale_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus")).distinct()
    digest = F.sha2("corpus", 256)
    stated = sources.select("corpus", F.when(F.col("corpus").like("%3"), "x").otherwise(digest).alias("manifest_sha256"))
    return corpus.vintage_faults(stated, sources.where(~F.col("corpus").like("%4")).select("corpus", digest.alias("manifest_sha256")))


@query("""SELECT doc_id, lang, source FROM documents SEMI JOIN labels USING (doc_id)""")
def refreshed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carried metadata of exactly the pages that a tier names: here the labelled documents."""
    carried = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"), "lang", "source")
    return corpus.refreshed(carried, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("stem"))).withColumnRenamed("stem", "doc_id")


@query("""
WITH r AS (SELECT * FROM (VALUES (1)) t(x)) SELECT '| ' || l_returnflag || ' | ' || count(*) || ' | ' || format('{:.4f}', avg(l_discount)) || ' | — |' AS line FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT '| flag | rows | discount | none |' UNION ALL SELECT '|---|---|---|---|'
""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivana.operators.report import as_markdown

    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("rows"), F.avg("l_discount").alias("discount")).withColumn("none", F.lit(None).cast("double"))
    return spark.createDataFrame([(x,) for x in as_markdown(rows).splitlines()], "line string")


@query("""SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents""")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.struct("n_chars", "doc_id").alias("place"))
    return index.numbered(rows, "place")
