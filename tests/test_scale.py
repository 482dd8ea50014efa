"""What keeps queries' time in step with their tables: work dealt over all cores, and steps that cost what they should."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivana import ship
from scrivana.functions import edits, image, values
from scrivana.functions.text import NormalisationPolicy, normalised, normalised_all, word_codes
from scrivana.operators import corpus, events, rules, tables
from scrivana.plans import corpora, formats
from scrivana.sources import vintages
from scrivana.staging import LEAST_ROWS, spread


def test_small_files_are_dealt_over_the_cores(spark, tmp_path):
    spark.range(40 * LEAST_ROWS).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert one.rdd.getNumPartitions() == 1
    assert spread(one).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert spread(one.limit(5)).rdd.getNumPartitions() == 1
    assert sorted(r.id for r in spread(one).collect()) == list(range(40 * LEAST_ROWS))


def test_a_width_is_searched_once():
    assert image.kernel(1.25) is image.kernel(1.25)


def test_blur_of_small_sides_takes_the_same_weights():
    rng = np.random.default_rng(3)
    for shape in ((3, 4, 3), (1, 1, 3), (30, 5, 3), (5, 60, 3), (9, 3)):
        page, weights = rng.integers(0, 256, shape, dtype=np.uint8), image.kernel(1.5)
        reach, out = len(weights) // 2, page.astype(np.int64)
        for axis in (0, 1):
            n = out.shape[axis]
            out = (sum(w * out.take(np.clip(np.arange(n) + k - reach, 0, n - 1), axis=axis) for k, w in enumerate(weights)) + 32768) >> 16
        assert (image.blur(page, 1.5) == out).all()


def test_plain_tables_are_read_as_the_parser_reads_them(monkeypatch):
    """Random pages of table tags in any order: one split finds what the tolerant parser finds."""
    rng = random.Random(5)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<thead>", "</tbody>", '<td colspan="2">', "<td rowspan=3>", "<th colspan='x' rowspan=\"0\">", '<td colspan="" colspan=3>',
            "a", " b ", "&amp;lt;", "&#xFB01;", "x > y", "&nbsp", "c&d", "\n"]
    odd = ["<b>", "<TD>", "<!-- <td> -->", "<td class=x>", "<", "</td >", "<br/>", "<script>", "<td colspan = 2>"]
    pages = ["<table><tr>" * rng.randint(0, 1) + "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    mixed = ["".join(rng.choice(bits + odd) for _ in range(20)) for _ in range(500)]
    assert all(tables.plain_outline(p) is not None for p in pages)
    assert any(tables.plain_outline(p) is None for p in mixed)
    quick = [tables.read_tables(p) for p in pages + mixed]
    monkeypatch.setattr(tables, "plain_outline", lambda page: None)
    assert [tables.read_tables(p) for p in pages + mixed] == quick


def test_cells_normalised_together_are_those_normalised_alone():
    rng = random.Random(6)
    bits = ["a", "B", " ", "\n", "#", "# ", "-", ":", "|", "*", "_", "`", "ﬁ", "＜", "“", "–", "́", "e", "ᄀ", "ᅡ", "\x85", "　", "ß", "\x1f", "---"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(8000)]
    for policy in (NormalisationPolicy(), NormalisationPolicy(fold_case=True), NormalisationPolicy(strip_markdown=False, fold_dashes=False), NormalisationPolicy(collapse_whitespace=False), NormalisationPolicy("NFD")):
        assert normalised_all(texts, policy) == [normalised(t, policy) for t in texts]
    assert normalised_all(["a\0 b", "ﬁ"], NormalisationPolicy()) == [normalised(t, NormalisationPolicy()) for t in ("a\0 b", "ﬁ")]
    assert normalised_all([], NormalisationPolicy()) == []


def test_short_lists_are_aligned_without_numpy(monkeypatch):
    rng = random.Random(7)
    pairs = [[[rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in "xy"] for _ in range(500)]
    quick = [tables.align(a, b) for a, b in pairs]
    monkeypatch.setattr(tables, "FEW_PAIRS", -1)
    assert [tables.align(a, b) for a, b in pairs] == quick


def test_nulls_and_pages_without_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "<table></table>"), (4, "<table><tr></tr><tr><td>a</table>")], "k int, h string")
    assert [r.g for r in df.select("k", tables.parse_tables("h").alias("g")).orderBy("k").collect()] == [None, [], [[]], [[[], ["a"]]]]


def test_table_rows_move_events_once(spark):
    """Sub-lines before and after their cell, in the next row, without any cell, without a key; outside of tables."""
    e = [(1, 0, "table_open"), (1, 1, "row_open"), (1, 2, "cell_sub_line", "a", "early"), (1, 3, "cell", "a", "x", True), (1, 4, "cell", "b", "y", False), (1, 5, "cell_sub_line", "a", "late"), (1, 6, "cell_sub_line", None, "lost"),
         (1, 7, "row_open"), (1, 8, "cell_sub_line", "b", "up"), (1, 9, "cell", "a", "z", None), (1, 10, "cell_sub_line", "c", "lost"), (1, 11, "row_open"), (1, 12, "row_open"), (1, 13, "cell", "a", "w", False), (1, 14, "cell_sub_line", "b", "lost"),
         (1, 15, "table_close"), (1, 16, "cell", "a", "outside", None), (1, 17, "cell_sub_line", "a", "lost")]
    rows = [(*x, *(None,) * (6 - len(x)), 1, 1) for x in e]
    df = spark.createDataFrame(rows, "page int, seq int, kind string, column_key string, text string, header boolean, colspan int, rowspan int")
    out = events.table_rows(df, ["page"])
    got = {(r.table_no, r.row_no): (r.header, [c.text for c in r.cells]) for r in out.collect()}
    assert got == {(1, 1): (True, ["x\nearly\nlate", "y\nup"]), (1, 2): (None, ["z"]), (1, 4): (False, ["w"]), (None, None): (None, ["outside"])}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_numbers_are_made_once(spark):
    """A number's own digits aren't made anew for each digit that is checked."""
    made = spark.range(3).select(values.abn_is_valid(values.make_abn(F.col("id"))).alias("valid"))
    assert [r.valid for r in made.collect()] == [True] * 3
    assert made._jdf.queryExecution().optimizedPlan().toString().count("lpad(") == 1
    odd = spark.createDataFrame([(None,), ("",), ("51 824 753 556",), ("51 824 753 557",), ("5182475355",)], "v string")
    assert [r[0] for r in odd.select(values.abn_is_valid(F.col("v"))).collect()] == [False, False, True, False, False]


def test_places_of_a_cycle_are_computed_once(spark):
    pool = spark.range(7).select(F.col("id").alias("place"), F.col("id").cast("string").alias("member"))
    out = values.cycled_from(spark.range(21).withColumnRenamed("id", "k"), pool, "k", "place", 4)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert sorted(r.member for r in out.collect()) == sorted([str(i) for i in range(7)] * 3)


def test_entries_stay_where_they_are_for_few_layouts(spark):
    entries = spark.createDataFrame([("1", "plain"), ("2", "none")], "case_id string, layout string")
    out = rules.with_layouts(entries, spark.createDataFrame([("plain",), ("plain",)], "layout string"))
    assert sorted((r.case_id, r._layout_is_known) for r in out.collect()) == [("1", True), ("2", None)]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_exported_entries_are_put_together_once(spark):
    entries, _ = formats.extraction(spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in entries._jdf.queryExecution().optimizedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_a_corpus_take_only_the_distances_asked_for(spark):
    """Texts aren't normalised for strict distances alone, and don't move to as many tasks as there are corpora."""
    plan = optimized(formats.corpus_scores(spark, "/root/testdata/sf0.001"))
    assert plan.count("ArrowEvalPython [text_distance(") == 1 and plan.count("ArrowEvalPython") == 1
    assert "RepartitionByExpression" in plan or "Repartition" in plan
    assert "strategy=broadcast" in plan


def test_documents_of_one_file_are_scored_by_all_cores(spark, tmp_path):
    spark.range(20 * LEAST_ROWS).select(F.col("id").alias("doc_id"), F.lit("nation").alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpora.score_documents(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert out.where("doc_id = 1").first().strict_edit_distance == 2


def test_distances_from_both_ends_take_half_of_the_diagonals(monkeypatch):
    rng = random.Random(9)
    a = "".join(rng.choices("etaoin shrdlu", k=3000))
    b = "".join(rng.choice("xyz") if rng.random() < 0.03 else c for c in a)
    steps, slide = [], edits.Both.slide
    monkeypatch.setattr(edits.Both, "slide", lambda self, x, *more: (steps.append(x.size), slide(self, x, *more))[1])
    (d,) = edits.by_diagonals([(a, b)])
    assert d == edits.by_table(a, b) > 50 and sum(steps) < 0.6 * d * d + 4 * d


def test_distances_beyond_the_ends():
    """Short and very unequal sequences, whose diagonals run out of the table from both ends."""
    rng = random.Random(10)
    for _ in range(40):
        pairs = [tuple("".join(rng.choices("ab", k=rng.randint(1, top))) for top in rng.choice([(3, 40), (40, 3), (6, 6), (30, 30)])) for _ in range(50)]
        want = [edits.by_table(a, b) for a, b in pairs]
        assert all(x in (y, -1) and (x == y or y > edits.most_edits(len(a), len(b))) for x, y, (a, b) in zip(edits.by_diagonals(pairs), want, pairs))


def test_words_as_characters(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(rng.choices(["a", "b", "ab", "ж", "世", "😀"], k=rng.randint(0, 9))) for _ in range(200)] + [" ".join(map(str, range(70_000)))]
    codes = word_codes(texts)
    assert [len(c) for c in codes] == [len(t.split()) for t in texts]
    known = {}
    assert all(known.setdefault(w, c) == c for t, code in zip(texts, codes) for w, c in zip(t.split(), code)) and len(set(known.values())) == len(known)
    monkeypatch.setattr("scrivana.functions.text.MOST_CODES", 3)
    assert word_codes(texts) is None


def test_files_of_turns_are_read_by_few_tasks(spark, tmp_path):
    """Empty turns have a file, absent ones none; both have their row, and thirty files don't make a task."""
    rows = [(k, 0, "user", None if k == 3 else "" if k == 4 else f"é{k}") for k in range(150)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    out = formats.text_files(spark, str(tmp_path))
    got = {r.stem: (r.chars, r.bytes) for r in out.collect()}
    assert len(got) == 150 and got["3_0"] == (None, None) and got["4_0"] == (0, 0) and got["149_0"] == (4, 5)
    assert out.where("chars > 0").rdd.getNumPartitions() <= 2


def test_pages_are_written_by_all_cores(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(corpus, "write_vintage", lambda parts, folder: written.append(parts.rdd.getNumPartitions()))
    corpus.write_pages(spark.range(20 * LEAST_ROWS).coalesce(1).select(F.col("id").alias("stem"), F.lit("x").alias("text")), str(tmp_path / "md"))
    assert written == [4 * spark.sparkContext.defaultParallelism]


def test_texts_below_a_folder(spark, tmp_path):
    ship(spark)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, text in (("a.md", "one\ntwo\n"), ("deep/er/b.md", ""), ("deep/c.txt", "no")):
        (tmp_path / name).write_text(text)
    assert sorted(r[:] for r in vintages.texts_below(spark, f"file://{tmp_path}").collect()) == [("a", "one\ntwo\n"), ("b", "")]
    with pytest.raises(Exception, match="nowhere"):
        vintages.texts_below(spark, str(tmp_path / "nowhere")).collect()


def test_steps_of_misread_texts_follow_their_length(monkeypatch):
    """A text with many edits is settled between places where both texts agree, not by the square of its edits."""
    rng = random.Random(12)
    steps, slide = [], edits.Both.slide
    monkeypatch.setattr(edits.Both, "slide", lambda self, x, *more: (steps.append(x.size), slide(self, x, *more))[1])
    taken = []
    for n in (20_000, 40_000):
        a = "".join(rng.choices("etaoin shrdlu", k=n))
        replaced = "".join("ж" if rng.random() < 0.03 else c for c in a)
        dropped = "".join(c for c in a if rng.random() > 0.03)
        both = "".join(rng.choice(["ж", ""]) if rng.random() < 0.03 else c for c in a)
        steps.clear()
        assert edits.distances([(a, replaced), (a, dropped), (dropped, a), (both, a)]) == [replaced.count("ж"), n - len(dropped), n - len(dropped), n - len(both) + both.count("ж")]
        taken.append(sum(steps))
    assert taken[0] < taken[1] < 2.5 * taken[0] and taken[1] < 2 * 40_000


def test_bounds_of_distances(monkeypatch):
    """Whatever is cut where, bounds hold, and distances are those of whole tables: texts of one or many kinds of items,
    with swapped passages, and edits that surplus items don't tell."""
    rng = random.Random(13)
    monkeypatch.setattr(edits, "MANY", 2)
    for rare in (1, 3):
        monkeypatch.setattr(edits, "RARE", rare)
        pairs = []
        for _ in range(400):
            letters = rng.choice(["ab", "etaoin shrdlu", "abж世😀é"])
            a = rng.choices(letters, k=rng.randint(1, rng.choice([6, 50, 200])))
            k, other = rng.randrange(len(a)), rng.choice([letters, "ж", letters + "XYZ"])
            b = [x for c in a for x in ([c], [], [rng.choice(other)], [c, rng.choice(other)])[int(rng.random() < 0.2) * rng.randrange(4)]] or ["b"]
            pairs.append(("".join(a), "".join(rng.choice([b, b, b, a[k:] + a[:k]]))))
        want = [edits.by_table(a, b) for a, b in pairs]
        assert edits.distances(pairs) == want == edits.distances([([x * 300 for x in map(ord, a)], [x * 300 for x in map(ord, b)]) for a, b in pairs])
        texts = [t for p in pairs for t in p]
        codes, lengths = edits.coded(texts), np.array([len(t) for t in texts])
        for c in (codes, codes.astype(np.uint32) * 5000):  # counted by kind, or sorted where kinds are many
            least = edits.surplus(c, lengths)
            assert least.tolist() == [max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total()) for a, b in pairs]
            assert (least <= want).all() and (edits.in_pieces(c, lengths, least) >= want).all()
    assert [edits.rising(x) for x in ([], [3], [1, 9, 2, 3, 0, 4], [3, 2, 1])] == [[], [0], [0, 2, 3, 5], [2]]


def test_repeated_passages_are_cut_too(monkeypatch):
    """What both texts have equally often is matched in order; a piece may have all edits that its pair's bound allows."""
    rng = random.Random(14)
    steps, slide = [], edits.Both.slide
    monkeypatch.setattr(edits.Both, "slide", lambda self, x, *more: (steps.append(x.size), slide(self, x, *more))[1])
    passage = "".join(rng.choices("etaoin shrdlu", k=6000)).replace("sh", "tion")
    a = passage * 4
    b = a.replace("tion", "tж").replace("lu", "жu")
    assert edits.distances([(a, b)]) == [b.count("ж") + len(a) - len(b)] and sum(steps) < len(a)
    a = "nation " * 300 + passage
    b = a.replace("tion", "tжжion")
    codes, lengths = edits.coded([a, b]), np.array([len(a), len(b)])
    assert edits.in_pieces(codes, lengths, edits.surplus(codes, lengths)) == edits.surplus(codes, lengths) == [b.count("ж")]
