import random
import re
import time
import unicodedata

from oracle import SF
from pyspark.sql import functions as F

from scrivana.functions import edits
from scrivana.functions import text as T
from scrivana.plans import registry


def normalise(s):
    s = unicodedata.normalize("NFKC", s)
    for c in T.DASHES:
        s = s.replace(c, "-")
    for cs, to in ((T.SINGLE_QUOTES, "'"), (T.DOUBLE_QUOTES, '"')):
        for c in cs:
            s = s.replace(c, to)
    s = re.sub(r"(?m)^\s*\|?[\s:\-|]+\|?\s*$", " ", s)
    s = re.sub(r"(?m)^\s{0,3}#{1,6}\s+", "", s)
    s = re.sub(r"\*{1,3}|_{1,3}|`+", "", s).replace("|", " ")
    return re.sub(r"\s+", " ", s).strip()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_normalise_matches_python(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab# \t\n\r\x0b\x1c\x85\u00a0\u2028|:-*_`–‘”ﬁé") for _ in range(rng.randint(0, 30))) for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in rows.select("i", T.normalise(F.col("t"))).collect()}
    assert got == {i: normalise(t) for i, t in enumerate(texts)}


def test_doc_normalise_default_has_every_document(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", "plain *ascii*", "ﬁn – “é”\u00a0x"] + ["".join(rng.choices("ab# \t\n\x1c\x85\u2028|:-*_`–‘”ﬁé", k=rng.randint(0, 400))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.normalised) for r in registry.queries()["doc_normalise_default"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(i, None if t is None else normalise(t)) for i, t in enumerate(texts)]
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = [(r.doc_id, r.normalised) for r in registry.queries()["doc_normalise_default"](spark, SF).collect()]
    assert sorted(got) == sorted((r.doc_id, normalise(r.text)) for r in rows)


def test_rates(spark):
    rng = random.Random(5)
    pairs = [tuple(" ".join(rng.choice(["a", "bb", "é", "d"]) for _ in range(rng.randint(0, 6))) for _ in "ab") for _ in range(200)] + [("", ""), ("", "x"), ("x", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, p string")
    got = df.select("i", T.character_error_rate(F.col("r"), F.col("p")), T.word_error_rate(F.col("r"), F.col("p")), T.is_degenerate(F.col("r"), F.col("p"), 3.0)).collect()
    for i, cer, wer, runaway in got:
        r, p = pairs[i]
        assert cer == (distance(r, p) / len(r) if r else float(bool(p)))
        a, b = r.split(), p.split()
        assert wer == (distance(a, b) / len(a) if a else float(bool(b)))
        assert runaway == (bool(p) and (not r or len(p) > 3 * len(r)))


def test_long_word_distances_are_quick(spark):
    rng = random.Random(2)
    pairs = [[" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 900)) for _ in range(3000)) for _ in "ab"] for _ in range(8)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, p string")
    df.select(T.word_distance("r", "p")).collect()
    began = time.perf_counter()
    got = {r[0]: r[1] for r in df.select("i", T.word_distance("r", "p")).collect()}
    assert time.perf_counter() - began < 2
    assert got[0] == distance(*(x.split() for x in pairs[0]))


def test_ascii_goes_to_python_as_nulls(spark):
    df = spark.createDataFrame([("abc",), ("ﬁn",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.unicode_form(F.col("t"), "NFKC")).collect()] == ["abc", "fin", None, ""]
    plan = df.select(T.unicode_form(F.col("t"), "NFKC"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN NOT" in plan.upper() or "IF(NOT" in plan.upper().replace(" ", "") or "WHEN NOT" in plan.upper()


def test_python_form_of_normalise(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aB# \t\n\x0b\x1c\x85\u00a0\u2028|:-*_`–‘”ﬁßé") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for policy in (T.NormalisationPolicy(), T.NormalisationPolicy("NFD", False, False, False, True, True), T.NormalisationPolicy("NFC", True, False, True, False, False)):
        got = {r[0]: r[1] for r in df.select("i", T.normalise(F.col("t"), policy)).collect()}
        assert got == {i: T.normalised(t, policy) for i, t in enumerate(texts)}


def test_casefold_and_nulls(spark):
    df = spark.createDataFrame([("Straße",), (None,), ("ABC",)], "t string")
    assert [r[0] for r in df.select(T.casefold(F.col("t"))).collect()] == ["strasse", None, "abc"]


def edited(rng, items, others, rate, moves=0):
    out = []
    for x in items:
        chance = rng.random() / rate
        out += [] if chance < 0.33 else [rng.choice(others)] if chance < 0.66 else [x, rng.choice(others)] if chance < 1 else [x]
    for _ in range(moves):
        if out:
            out.insert(rng.randrange(len(out)), out.pop(rng.randrange(len(out))))
    return out


def test_distances(monkeypatch):
    rng = random.Random(7)
    pairs = []
    for _ in range(900):
        a = rng.choices("abcé世😀"[: rng.randint(1, 6)], k=rng.randint(0, 60))
        b = rng.choice([rng.choices("abcé", k=rng.randint(0, 40)), a[: rng.randint(0, 40)], [x for x in a if x != "b"], a[::-1], edited(rng, a, "abxyz", 0.1, 2)])
        pairs.append(("".join(a), "".join(b)))
    pairs += [("", ""), ("a", ""), ("", "b"), ("x" * 3000, "x" * 2990), ("ab" * 900, "ba" * 900), ("\ud800a", "a\ud800")]
    want = [distance(a, b) for a, b in pairs]
    assert edits.distances(pairs) == want == [edits.by_table(a, b) for a, b in pairs]
    monkeypatch.setattr(edits, "TOGETHER", 90)
    monkeypatch.setattr(edits, "WINDOWS", 1)
    assert edits.distances([(list(a), list(b)) for a, b in pairs]) == want
    a, b = (rng.choices(range(900), k=1200) for _ in "ab")
    assert edits.distances([(a, b), (a, a)]) == [distance(a, b), 0]


def test_distances_of_long_edited_texts():
    """Replaced, dropped, added and moved words and letters: diagonals agree with the table, and are used."""
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoin", k=rng.randint(1, 9))) for _ in range(400)]
    for n in (50, 400, 3000):
        a = rng.choices(words, k=n)
        b = edited(rng, a, words, 0.02, n // 150)
        c, d = " ".join(a), "".join(edited(rng, " ".join(a), "etaoin ", 0.02))
        pairs = [(a, b), (c, " ".join(b)), (c, d), (c.split(), d.split())]
        found = edits.by_diagonals(pairs)
        assert all(x == y or (x == -1 and y > edits.most_edits(len(p), len(q))) for x, (p, q) in zip(found, pairs) for y in [edits.by_table(p, q)])
        assert found[0] >= 0 and found[2] >= 0
    assert distance(a[:300], b[:300]) == edits.distances([(a[:300], b[:300])])[0]


def test_time_of_diagonals_follows_the_edits():
    rng = random.Random(4)
    a = "".join(rng.choices("etaoin shrdlu", k=60_000))
    b = "".join(edited(rng, a, "etaoin", 0.01))
    began = time.perf_counter()
    assert edits.by_diagonals([(a, b)])[0] > 0
    quick = time.perf_counter() - began
    began = time.perf_counter()
    edits.by_table(a, b)
    assert quick < (time.perf_counter() - began) / 3


def misread(text, kind):
    text = text.replace("tion", ("tж", "tжжion", "tion")[kind])
    for right, wrong in (("ing", "жng"), ("ein", "жin"), ("le", "lж"), ("os", "жs")):
        text = text.replace(right, wrong)
    return text


def test_score_documents_scores_every_document(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", "Short, one.", " ... ", "a, ing c! " * 400, " ".join(rng.choices(["tion", "sting", "le*le", "a", "os", "|", "\u00a0#", "\n-", "ein–", "**"], k=900)), "nation " * 320]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.queries()["score_documents"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [i for i, _ in rows]
    known = {}
    for i, ref in rows:
        pred = None if ref is None or i % 9 == 0 else misread(ref, i % 3)
        r = got[i]
        assert (r["ref_chars"], r["pred_chars"], r["prediction_present"]) == (None if ref is None else len(ref), None if pred is None else len(pred), pred is not None)
        if pred is None:
            assert all(r[c] is None for c in ("strict_edit_distance", "strict_cer", "normalised_edit_distance", "normalised_cer", "normalised_wer", "degenerate"))
            continue
        a, b = normalise(ref), normalise(pred)
        if (ref, pred) not in known:
            known[ref, pred] = distance(ref, pred), distance(a, b), distance(a.split(), b.split())
        strict, normal, words = known[ref, pred]
        assert (r["strict_edit_distance"], r["normalised_edit_distance"]) == (strict, normal)
        assert r["strict_cer"] == (strict / len(ref) if ref else float(bool(pred)))
        assert r["normalised_cer"] == (normal / len(a) if a else float(bool(b)))
        assert r["normalised_wer"] == (words / len(a.split()) if a.split() else float(bool(b.split())))
        assert r["degenerate"] == (bool(pred) and (not ref or len(pred) > 3 * len(ref)))
