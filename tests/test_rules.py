import pytest
from pyspark.sql import functions as F

from scrivana.functions import lists, values
from scrivana.operators import rules

ENTRY = "case_id string, doc_type string, layout string, fields map<string,string>"


def entries(spark, **fields):
    return spark.createDataFrame([("c", "receipt", "l", fields)], ENTRY)


def found(df):
    return sorted((r.field, r.position, r.rule) for r in df.collect())


def test_planted_faults(spark):
    e = entries(spark, D="1/2/2024", A="12.5", T="110.00", G="10.01", I="true", X="1|2", Y="1", L="1.00|x|NOT_FOUND", N="51 824 753 556", M="51 824 753 557")
    assert found(rules.check(e, rules.formats({"date": ["D"], "amount": ["A", "T"]}))) == [("A", None, "format_amount"), ("D", None, "format_date")]
    assert found(rules.check(e, rules.list_formats({"amount": ["L"]}))) == [("L", 1, "format_amount")]
    assert found(rules.check(e, rules.parallel_counts({"g": ["X", "Y"]}))) == [("g", None, "parallel")]
    assert found(rules.check(e, rules.tax("T", "G", "I"))) == [("G", None, "gst")]
    assert found(rules.check(e, rules.business_numbers("N"))) == []
    assert found(rules.check(e, rules.business_numbers("M"))) == [("M", None, "abn")]
    assert found(rules.check(e, rules.required_fields({"receipt": ["D", "Q"]}))) == [("Q", None, "required")]
    assert found(rules.check(rules.with_layouts(e, spark.createDataFrame([("m",)], "layout string")), rules.unknown_layouts())) == [(None, None, "layout")]


def test_balances(spark):
    e = entries(spark, TRANSACTION_BALANCES="10.00|5.00|9.00", TRANSACTION_AMOUNTS_PAID="NOT_FOUND|5.00|NOT_FOUND", TRANSACTION_AMOUNTS_RECEIVED="10.00|NOT_FOUND|3.00", ACCOUNT_BALANCE="8.00")
    assert found(rules.check(e, rules.balances())) == [("ACCOUNT_BALANCE", None, "closing"), ("TRANSACTION_BALANCES", 2, "balance")]


def test_rewards(spark):
    e = entries(spark, O="1,000", E="50", B="0", R="100", C="951")
    assert found(rules.check(e, rules.rewards("O", "E", "B", "R", "C"))) == [("C", None, "rewards")]


def test_ragged_group_fails(spark):
    ragged = spark.createDataFrame([("c", "a|b", "1")], "k string, x string, y string")
    with pytest.raises(Exception, match="ragged"):
        lists.explode_group(ragged, {"x": "item", "y": "n"}, ["k"]).collect()
    absent = spark.createDataFrame([("c", "NOT_FOUND", "NOT_FOUND")], "k string, x string, y string")
    assert lists.explode_group(absent, {"x": "item", "y": "n"}, ["k"]).count() == 0


def test_amounts(spark):
    df = spark.createDataFrame([("2.345",), ("NOT_FOUND",), ("",), ("1234.5",)], "v string")
    assert [str(r[0]) for r in df.select(values.format_amount(values.amount(F.col("v"), "decimal(18,3)"))).collect()] == ["$2.35", "$0.00", "$0.00", "$1,234.50"]
    with pytest.raises(Exception, match="not an amount"):
        spark.createDataFrame([("x",)], "v string").select(values.amount(F.col("v"))).collect()


def test_interpolation(spark):
    df = spark.createDataFrame([({"A": "x", "B": "NOT_FOUND"},)], "f map<string,string>")
    assert df.select(lists.interpolate(F.lit("{A}-{B}."), F.col("f"))).first()[0] == "x-."
    with pytest.raises(Exception, match="unknown field"):
        df.select(lists.interpolate(F.lit("{C}"), F.col("f"))).collect()
    assert df.select(lists.placeholders(F.lit("{A} {B}"))).first()[0] == ["A", "B"]
    assert df.select(lists.braces_balanced(F.lit("{A")), lists.braces_balanced(F.lit("{A}"))).first()[:] == (False, True)


def test_rules_take_one_pass(spark):
    from oracle import SF

    from scrivana.plans import registry

    plan = registry.queries()["planted_findings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1
