import random

from pyspark.sql import functions as F

from scrivana.operators import tables as T


def test_read_tables():
    read = T.read_tables
    assert read("<table><tr><th>a<th>b<tr><td colspan=2>band<tr><td>1<td>2</table>") == [[["a", "b"], ["band"], ["1", "2"]]]
    assert read("<table><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>") == [[["x", "1"], ["x", "2"]]]
    assert read("<table><tr><td>a<table><tr><td>b</table>") == [[["a"]], [["b"]]]
    assert read("<td>no</td><table><tr><td>&amp; <b>c</b></td></tr>") == [[["& c"]]]
    assert len(read('<table><tr><td colspan="999">w</table>')[0][0]) == 64
    assert read('<table><tr><td colspan="x">w<td colspan="0">v</table>') == [[["w", "v"]]]


def test_align_counts():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in "xy")
        script = T.align(a, b)
        assert [i for i, _ in script if i is not None] == list(range(len(a)))
        assert [j for _, j in script if j is not None] == list(range(len(b)))
    assert T.align(list("abc"), list("ac")) == [(0, 0), (1, None), (2, 1)]


def score(spark, ref, pred, policy=T.NormalisationPolicy()):
    df = spark.createDataFrame([(1, ref, pred)], "k int, r string, p string")
    return T.score_tables(df, ["k"], "r", "p", policy).first().asDict()


def grid(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_score_tables(spark):
    ref = grid(("a", "b", ""), ("1", "", "3"))
    assert score(spark, ref, ref)["table_cell_error_rate"] == 0
    moved = score(spark, ref, grid(("a", "b", ""), ("1", "3", "")))
    assert (moved["table_cells_correct"], moved["table_cells_misplaced"]) == (4, 1)
    lost = score(spark, ref, grid(("a", "b", "")))
    assert (lost["table_rows_missing"], lost["table_cells_compared"]) == (1, 6)
    extra = score(spark, ref, ref.replace("</table>", "<tr><td>z</td></tr></table>"))
    assert (extra["table_rows_spurious"], extra["table_cell_error_rate"]) == (1, 0)
    assert score(spark, "text", ref)["table_cell_error_rate"] is None
    dash = grid(("a", "-"))
    assert score(spark, grid(("a", "")), dash)["table_cells_correct"] == 2
    assert score(spark, grid(("a", "")), dash, None)["table_cells_correct"] == 1


def test_cells_are_normalised_after_parsing(spark):
    assert score(spark, grid(("&#xFB01;n", "x")), grid(("fin", "x")))["table_cells_correct"] == 2
    assert score(spark, grid(("&#xFB01;n", "x")), grid(("fin", "x")), None)["table_cells_correct"] == 1
    cut = score(spark, grid(("a \uff1c/table\uff1e", "z")), grid(("a \uff1c/table\uff1e", "y")))
    assert (cut["table_cells_compared"], cut["table_cells_correct"]) == (2, 1)
    folded = T.NormalisationPolicy(fold_case=True)
    assert score(spark, grid(("stra\u00dfe", "A")), grid(("STRASSE", "a")), folded)["table_cells_correct"] == 2
    assert score(spark, grid(("a\u00a0 b", "\u201cq\u201d")), grid((" a b", '"q"')))["table_cells_correct"] == 2


def test_align_is_the_script_found_by_walking_back():
    """Against the whole table of distances, walked back with deletions first, then insertions, then replacements."""

    def plain(a, b):
        cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        i, j, out = len(a), len(b), []
        while i or j:
            if i and cost[i][j] == cost[i - 1][j] + 1:
                i, pair = i - 1, (i - 1, None)
            elif j and cost[i][j] == cost[i][j - 1] + 1:
                j, pair = j - 1, (None, j - 1)
            else:
                i, j, pair = i - 1, j - 1, (i - 1, j - 1)
            out.append(pair)
        return out[::-1]

    rng = random.Random(8)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in "xy")
        head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        rest_a, rest_b = a[head:], b[head:]
        tail = next((k for k, (x, y) in enumerate(zip(rest_a[::-1], rest_b[::-1])) if x != y), min(len(rest_a), len(rest_b)))
        middle = plain(rest_a[: len(rest_a) - tail], rest_b[: len(rest_b) - tail])
        want = [(k, k) for k in range(head)] + [(None if i is None else head + i, None if j is None else head + j) for i, j in middle]
        want += [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
        assert T.align(a, b) == want


def test_long_tables(spark):
    rows = [(f"r{i}", str(i)) for i in range(1500)]
    got = score(spark, grid(*rows), grid(*(r for i, r in enumerate(rows) if i % 3)))
    assert (got["table_rows_missing"], got["table_rows_spurious"], got["table_cells_correct"]) == (500, 0, 2000)


def test_render_blank_header(spark):
    cell = "struct<text:string,colspan:int,rowspan:int>"
    rows = spark.createDataFrame([(1, 0, False, [("<x>", 2, 1)]), (1, 1, False, [("a", 1, 2), ("b", 1, 0)])], f"t int, o int, header boolean, cells array<{cell}>")
    html = T.render_tables(rows, ["t"], "o").first()["html"]
    assert html == '<table><thead><tr><th></th><th></th></tr></thead><tbody><tr><td colspan="2">&lt;x&gt;</td></tr><tr><td rowspan="2">a</td></tr></tbody></table>'
    wide = rows.select(T.padded_row(F.col("cells"), 3).alias("c")).select(F.size("c")).collect()
    assert [r[0] for r in wide] == [2, 3]


def test_long_lists_are_aligned_in_parts(monkeypatch):
    """Halved lists give the very script of the whole table, ties included."""
    rng = random.Random(12)
    pairs = []
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.2] if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        pairs.append((a, b))
    whole = [T.align(a, b) for a, b in pairs]
    for held in (1, 9, 60):
        monkeypatch.setattr(T, "HELD_PAIRS", held)
        assert [T.align(a, b) for a, b in pairs] == whole


def test_alignment_takes_memory_by_length(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(T, "HELD_PAIRS", 1 << 16)
    rng = random.Random(13)
    a = [rng.randint(0, 400) for _ in range(4000)]
    b = [rng.randint(0, 400) if rng.random() < 0.1 else x for x in a if rng.random() > 0.05]
    tracemalloc.start()
    script = T.align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # the whole table takes 30 MB
    assert [i for i, _ in script if i is not None] == list(range(4000)) and [j for _, j in script if j is not None] == list(range(len(b)))
