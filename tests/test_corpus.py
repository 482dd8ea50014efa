import pytest
from pyspark.sql import functions as F

from scrivana.functions import values
from scrivana.operators import corpus
from scrivana.sources import config


def test_selection_of_pages(spark):
    pages = spark.createDataFrame([(f"c{i}", "ab"[i % 2]) for i in range(10)], "case_id string, doc_type string")
    assert corpus.of_types(pages, ["a"], ["a", "b"]).count() == 5
    with pytest.raises(ValueError, match="unknown document types"):
        corpus.of_types(pages, ["z"], ["a", "b"])
    assert corpus.limited(pages, 2, "doc_type").count() == 4
    assert corpus.limited(pages, 3).count() == 3 and corpus.limited(pages, 0).count() == 10


def test_family(spark):
    m = spark.createDataFrame([(None, None), ("photo", "")], "family string, severity string")
    assert [r[:] for r in corpus.family_and_severity(m, F.lit("scan_light")).collect()] == [("scan", "light"), ("photo", "light")]
    assert corpus.family_and_severity(m, F.lit("x"), "a", "b").first()[:] == ("a", "b")
    with pytest.raises(Exception, match="for corpus x"):
        corpus.family_and_severity(m, F.lit("x")).collect()


def test_files(spark):
    files = spark.createDataFrame([("r/receipt/a.png", "a", "1"), ("r/b.png", "b", "2")], "path string, stem string, sha256 string")
    wanted = spark.createDataFrame([("a", "receipt"), ("b", "receipt"), ("c", "receipt")], "stem string, doc_type string")
    assert {r.stem: r.path for r in corpus.nested_or_flat(wanted, files).collect()} == {"a": "r/receipt/a.png", "b": "r/b.png", "c": None}
    manifest = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "stem string, sha256 string")
    assert sorted(r[:] for r in corpus.file_faults(manifest, files).collect()) == [("b", "hash"), ("c", "missing")]
    assert [r.stem for r in corpus.refreshed(manifest, files.where("stem = 'a'")).collect()] == ["a"]
    index = spark.createDataFrame([("clean", "h"), ("scan", "i")], "corpus string, manifest_sha256 string")
    assert [r.corpus for r in corpus.vintage_faults(index, index.where("corpus = 'clean'")).collect()] == ["scan"]


def test_write(spark, tmp_path):
    pages = spark.createDataFrame([("a", "één"), ("b", None)], "stem string, text string")
    corpus.write_pages(pages, str(tmp_path / "md"))
    assert sum(f.stat().st_size for f in (tmp_path / "md").glob("*.md")) == 5
    assert (tmp_path / "md" / "a.md").read_text() == "één"
    m = spark.createDataFrame([("a", "r", "scan", "t"), ("b", "r", "scan", None)], "stem string, doc_type string, family string, tables string")
    assert "| doc_type | r | 2 |" in corpus.readme(m, "T") and "| tables | pages with tables | 1 |" in corpus.readme(m, "T")
    span = "array<struct<text:string,poly:array<int>>>"
    events = spark.createDataFrame([("a", 0, "table", 0, [("c", [0, 0, 4, 0, 4, 2, 0, 2])])], f"stem string, seq int, category_type string, `order` int, spans {span}").withColumn("text", F.lit(None).cast("string"))
    rows = spark.createDataFrame([("a", 1, 1, False, [("x", 1, 1)])], "stem string, table_no long, row_no long, header boolean, cells array<struct<text:string,colspan:int,rowspan:int>>")
    corpus.export(spark, m, events, rows, str(tmp_path / "out"))
    assert {r.stem: r.tables for r in spark.read.json(str(tmp_path / "out" / "manifest")).collect()} == {"a": "tables/a", "b": None}
    with pytest.raises(ValueError, match="no annotation"):
        corpus.export(spark, m, events.withColumn("category_type", F.lit(None).cast("string")), rows, str(tmp_path / "other"))


def test_derived_values(spark):
    df = spark.range(0, 40).withColumn("abn", values.make_abn(F.col("id") * 7654321987))
    assert df.where(~values.abn_is_valid(F.col("abn"))).count() == 0 and df.first().abn[2] == " "
    pool = ["a", "b", "c", "d"]
    got = [r[0] for r in df.orderBy("id").select(values.cycled_choice(pool, F.col("id"), 3)).collect()]
    assert all(sorted(got[i : i + 4]) == pool for i in range(0, 40, 4)) and len({tuple(got[i : i + 4]) for i in range(0, 40, 4)}) > 1
    assert set(r[0] for r in df.select(values.seeded_choice(F.array(*map(F.lit, pool)), F.col("id"))).collect()) == set(pool)


def test_pools(tmp_path):
    p = tmp_path / "p.yml"
    p.write_text("pos: {staff_names: [A], hour_min: 8}\n")
    assert config.pools(p, "pos", {"staff_names": list, "hour_min": int})["hour_min"] == 8
    with pytest.raises(config.ConfigError):
        config.pools(p, "pos", {"hour_span": int})
    p.write_text("doc_types: [r]\nfamilies: [scan, scan]\n")
    with pytest.raises(config.ConfigError):
        config.selection(p, ["r"], ["scan"])


def test_cycles_take_each_place_once(spark):
    for n in (1, 2, 3, 10, 57):
        df = spark.range(n * 4).select("id", values.cycle_place(F.col("id"), n, 3).alias("place"))
        got = [r.place for r in df.orderBy("id").collect()]
        rounds = [got[k : k + n] for k in range(0, len(got), n)]
        assert all(sorted(r) == list(range(n)) for r in rounds) and (n < 10 or len(set(map(tuple, rounds))) == 4)
    # every order of three comes up, about equally often
    orders = spark.range(3 * 3000).select(F.floor(F.col("id") / 3).alias("turn"), "id", values.cycle_place(F.col("id"), 3, 8).alias("p")).orderBy("id").collect()
    seen = {}
    for k in range(0, len(orders), 3):
        key = tuple(r.p for r in orders[k : k + 3])
        seen[key] = seen.get(key, 0) + 1
    assert len(seen) == 6 and min(seen.values()) > 400
    pool = spark.range(1_000_000).select(F.col("id").alias("place"), (F.col("id") * 2).alias("member"))
    taken = values.cycled_from(spark.range(500), pool, "id", "place", 4).collect()
    assert len({r.member for r in taken}) == 500
    with pytest.raises(ValueError, match="empty"):
        values.cycled_from(spark.range(5), pool.limit(0), "id", "place", 4)


def test_tiers_are_counted(spark, monkeypatch):
    monkeypatch.setattr(corpus, "MOST_TIERS", 3)
    assert corpus.in_tiers(spark.range(5), spark.range(3).toDF("tier")).count() == 15
    with pytest.raises(ValueError, match="4 tiers"):
        corpus.in_tiers(spark.range(5), spark.range(4).toDF("tier"))
